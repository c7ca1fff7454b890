"""Queries of entity associations and name matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from wherry.functions.exprs import STOPWORDS, idf_clamped, npmi, recency_boost, tokens_of
from wherry.operators import association as A
from wherry.operators import vault as V
from wherry.plans.book import Book
from wherry.plans.graph import AS_OF
from wherry.plans.usage import events
from wherry.session import link_key, table

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
#: DuckDB's levenshtein counts bytes: accented letters are put as capitals, which lower-cased names don't have.
_PLAIN = "translate({0}, 'àáâäãåçèéêëìíîïñòóôöõùúûüý', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
_EDITS = f"levenshtein({_PLAIN.format('{0}')}, {_PLAIN.format('{1}')})"
book = Book(
    V.VAULT_SQL
    + """, ekeys AS (SELECT id, regexp_replace(lower(trim(name)), '\\.md$', '') AS key FROM ents UNION SELECT id, regexp_replace(lower(trim(a)), '\\.md$', '') FROM (SELECT id, unnest(aliases) AS a FROM ents)),
owner AS (SELECT key, min(id) AS id FROM ekeys WHERE key <> '' GROUP BY 1), men AS (SELECT DISTINCT src AS note, id AS entity FROM links JOIN owner ON key = dst),
degn AS (SELECT note, count(*) AS deg FROM men GROUP BY 1), pairs AS (SELECT x.entity AS a, y.entity AS b, round(sum(CASE WHEN deg >= 3 THEN 1 / ln(deg) ELSE 1.0 END), 6) AS weight, count(*) AS n FROM men x JOIN men y ON x.note = y.note AND x.entity < y.entity JOIN degn ON degn.note = x.note GROUP BY 1, 2),
edf AS (SELECT entity, count(*) AS df FROM men GROUP BY 1), tot AS (SELECT count(DISTINCT note) AS n FROM men)
"""
)
add = book.add


def mentions(spark, d):
    """Which entity stands in which note, by its links."""
    e = V.entities(spark, d)
    keys = e.select("id", F.explode(F.concat(F.array("name"), "aliases")).alias("a")).select("id", link_key("a").alias("dst")).where("dst <> ''").groupBy("dst").agg(F.min("id").alias("entity"))
    return V.links(spark, d).join(keys, "dst").select(F.col("src").alias("note"), "entity").distinct()


@add("SELECT a, b, weight, n FROM pairs WHERE n >= 2")
def assoc_adamic_adar(spark, d):
    """Entities mentioned together, with weights."""
    return A.adamic_adar(mentions(spark, d)).where("n >= 2")


@add("SELECT a, b, round(CASE WHEN p.n * 1.0 / tot.n >= 1 THEN 1.0 ELSE greatest(0.0, least(1.0, ln((p.n * 1.0 / tot.n) / ((x.df * 1.0 / tot.n) * (y.df * 1.0 / tot.n))) / -ln(p.n * 1.0 / tot.n))) END, 6) AS npmi FROM pairs p JOIN edf x ON x.entity = a JOIN edf y ON y.entity = b, tot WHERE p.n >= 2")
def assoc_npmi(spark, d):
    """Normalized mutual information of entity pairs."""
    return npmi_pairs(mentions(spark, d))


def npmi_pairs(m):
    """``a, b, npmi`` of pairs in two notes or more for ``mentions(note, entity)``."""
    df = m.groupBy("entity").agg(F.count(F.lit(1)).alias("df"))
    n = m.agg(F.countDistinct("note").alias("total"))
    p = A.adamic_adar(m).where("n >= 2").join(df.toDF("a", "da"), "a").join(df.toDF("b", "db"), "b").crossJoin(F.broadcast(n))
    return p.select("a", "b", F.round(npmi(F.col("n"), F.col("da"), F.col("db"), F.col("total")), 6).alias("npmi"))


@add("SELECT entity, round(greatest(0.7, least(1.8, ln((tot.n + 1.0) / (df + 1)))), 6) AS rarity FROM edf, tot")
def assoc_rarity(spark, d):
    """Rarity multiplier of each entity."""
    m = mentions(spark, d)
    n = m.agg(F.countDistinct("note").alias("n"))
    return m.groupBy("entity").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("entity", F.round(idf_clamped(F.col("df"), F.col("n"), 0.7, 1.8), 6).alias("rarity"))


@add("SELECT entity, max(modified) AS last_mentioned, count(*) AS n_mentions, CASE WHEN max(modified) >= TIMESTAMP '2026-06-01' - INTERVAL 1 HOUR THEN 8 WHEN max(modified) >= TIMESTAMP '2026-06-01' - INTERVAL 24 HOUR THEN 5 WHEN max(modified) >= TIMESTAMP '2026-06-01' - INTERVAL 72 HOUR THEN 3 WHEN max(modified) >= TIMESTAMP '2026-06-01' - INTERVAL 168 HOUR THEN 1 ELSE 0 END AS boost FROM men JOIN notes ON notes.k = men.note GROUP BY 1")
def assoc_recency(spark, d):
    """Last mention of each entity and its recency boost."""
    n = V.notes(spark, d).select(F.col("k").alias("note"), "modified")
    g = mentions(spark, d).join(n, "note").groupBy("entity").agg(F.max("modified").alias("last_mentioned"), F.count(F.lit(1)).alias("n_mentions"))
    return g.withColumn("boost", recency_boost(F.col("last_mentioned"), AS_OF))


@add(f"""WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(regexp_replace(lower(text), '\\[\\[([^\\]|]*\\|)?([^\\]]*)\\]\\]', '\\2', 'g'), '([a-z][a-z0-9]{{2,}})', 1), lambda w: w NOT IN ({_STOP}))) AS w FROM documents WHERE text IS NOT NULL), n AS (SELECT count(*) AS n FROM w), t AS (SELECT term, count(*) AS df FROM (SELECT unnest(w) AS term FROM w) GROUP BY 1)
SELECT term, df, round(greatest(0.5, least(2.5, ln((n + 1.0) / (df + 1)))), 6) AS idf FROM t, n""", common=False)
def assoc_token_idf(spark, d):
    """Weight of each word of the documents."""
    x = table(spark, d, "documents").where("text is not null").select(F.array_distinct(tokens_of(F.col("text"))).alias("w"))
    n = x.agg(F.count(F.lit(1)).alias("n"))
    t = x.select(F.explode("w").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return t.crossJoin(F.broadcast(n)).select("term", "df", F.round(idf_clamped(F.col("df"), F.col("n"), 0.5, 2.5), 6).alias("idf"))


@add("""WITH r AS (SELECT user_id || '-' || CAST(ts AS DATE) AS session, CAST(json_extract_string(props, '$.k') AS BIGINT) AS note, ts FROM events), s AS (SELECT session, list_sort(list(DISTINCT note)) AS es, max(ts) AS at_ FROM r GROUP BY 1 HAVING count(DISTINCT note) >= 2),
x AS (SELECT session, unnest(es) AS note, len(es) AS n, at_ FROM s) SELECT a.note AS a, b.note AS b, round(sum(exp(-ln(2) * greatest((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(a.at_)) / 86400000000.0, 0) / 7) / CASE WHEN a.n > 2 THEN ln(a.n) ELSE 1 END), 6) AS weight FROM x a JOIN x b ON a.session = b.session AND a.note < b.note GROUP BY 1, 2""", common=False)
def assoc_co_retrieval(spark, d):
    """Notes read together in sessions, recent ones more."""
    e = events(spark, d, "session", "note", "ts").select(F.concat_ws("-", "session", F.to_date("ts")).alias("session"), "note", F.col("ts").alias("at"))
    return A.co_retrieval(e, "2024-01-31")


@add(f"""WITH dead AS (SELECT DISTINCT dst AS term FROM res WHERE target_k IS NULL AND len(dst) >= 4), nm AS (SELECT DISTINCT lower(name) AS name FROM ents WHERE len(name) >= 3),
c AS (SELECT term, name, round(1 - {_EDITS.format('term', 'name')} / greatest(len(term), len(name)), 6) AS sim FROM dead JOIN nm ON {_EDITS.format('term', 'name')} <= CASE WHEN len(term) > 10 THEN 2 ELSE 1 END)
SELECT term, min(name) AS match, sim FROM c WHERE sim = (SELECT max(sim) FROM c x WHERE x.term = c.term) GROUP BY term, sim""")
def join_fuzzy_dead_links(spark, d):
    """The nearest entity name of each dead link within one edit, two for targets above ten letters."""
    n = V.notes(spark, d)
    e = V.entities(spark, d)
    r = V.resolved(V.links(spark, d), V.entity_keys(n, e))
    return A.fuzzy_best(r.where(F.col("to").isNull()).select(F.col("dst").alias("term")).distinct(), e.select(F.lower("name").alias("name")).distinct())


@add("SELECT lower(a) AS alias, count(DISTINCT name) AS n_owners FROM (SELECT name, unnest(aliases) AS a FROM ents) GROUP BY 1 HAVING count(DISTINCT name) > 1")
def join_ambiguous_aliases(spark, d):
    """Aliases of more than one entity."""
    return V.entities(spark, d).select("name", F.explode("aliases").alias("a")).groupBy(F.lower("a").alias("alias")).agg(F.countDistinct("name").alias("n_owners")).where("n_owners > 1")


@add("WITH al AS (SELECT id, lower(unnest(aliases)) AS a FROM ents) SELECT DISTINCT al.id AS alias_of, e.id AS name_of, al.a AS text FROM al JOIN ents e ON lower(e.name) = al.a AND e.id <> al.id")
def join_alias_collisions(spark, d):
    """Aliases that are another entity's name."""
    e = V.entities(spark, d)
    a = e.select(F.col("id").alias("alias_of"), F.explode("aliases").alias("x")).select("alias_of", F.lower("x").alias("text"))
    return a.join(e.select(F.col("id").alias("name_of"), F.lower("name").alias("text")), "text").where("alias_of <> name_of").select("alias_of", "name_of", "text").distinct()


@add("""WITH w AS (SELECT id, name, category, list_filter(string_split_regex(name, '\\s+'), lambda x: x <> '') AS w FROM ents),
c AS (SELECT id, upper(array_to_string(list_transform(list_filter(string_split_regex(name, '[\\s-]+'), lambda x: x <> ''), lambda x: x[1]), '')) AS alias, 'acronym' AS kind FROM w WHERE len(w) >= 2
UNION SELECT id, w[1], 'first' FROM w WHERE category = 'people' AND len(w) = 2 UNION SELECT id, w[-1], 'last' FROM w WHERE category = 'people' AND len(w) = 2 UNION SELECT id, replace(name, '-', ' '), 'plain' FROM w WHERE contains(name, '-')),
t AS (SELECT lower(name) AS t FROM ents UNION SELECT lower(unnest(aliases)) FROM ents) SELECT id, alias, kind FROM c WHERE lower(alias) NOT IN (SELECT t FROM t)""")
def assoc_alias_candidates(spark, d):
    """Aliases that could be added to the entities."""
    return A.alias_candidates(V.entities(spark, d))


@add("""WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(coalesce(lower(text), ''), '[\\p{L}\\p{N}]+')) AS w FROM documents), e AS (SELECT id, list_distinct(regexp_extract_all(lower(name), '[\\p{L}\\p{N}]+')) AS w FROM ents),
tt AS (SELECT doc_id, unnest(w) AS token FROM t), ee AS (SELECT id, len(w) AS n, unnest(w) AS token FROM e), c AS (SELECT doc_id, id, n, count(*) AS hit FROM tt JOIN ee USING (token) GROUP BY 1, 2, 3) SELECT doc_id, id FROM c WHERE CASE WHEN n <= 2 THEN hit = n ELSE hit >= 0.75 * n END""")
def join_token_coverage(spark, d):
    """Entities whose words stand in documents."""
    return A.token_coverage(table(spark, d, "documents"), "doc_id", F.col("text"), V.entities(spark, d))


@add(f"""WITH e AS (SELECT id, lower(name) AS name, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS fk, regexp_replace(regexp_replace(regexp_replace(lower(name), '[.\\-_]', '', 'g'), 'js$', ''), 'ts$', '') AS plain FROM ents WHERE name IS NOT NULL),
p AS (SELECT x.id AS a, y.id AS b, x.name AS na, y.name AS nb, (x.fk = y.fk AND x.fk <> '') OR (x.plain = y.plain AND len(x.plain) >= 3) AS fold, least(len(x.name), len(y.name)) AS s, greatest(len(x.name), len(y.name)) AS l, {_EDITS.format('x.name', 'y.name')} AS d FROM e x JOIN e y ON x.id < y.id),
c AS (SELECT a, b, CASE WHEN na = nb THEN 0.95 WHEN fold THEN 0.85 WHEN s >= 3 AND 2 * s > l AND (contains(na, nb) OR contains(nb, na)) THEN round(0.6 + 0.2 * (s / l), 6) WHEN s >= 4 AND 100 * d < 35 * l THEN round(0.5 + 0.4 * (1 - d / l), 6) END AS score,
  CASE WHEN na = nb THEN 'exact' WHEN fold THEN 'same' WHEN s >= 3 AND 2 * s > l AND (contains(na, nb) OR contains(nb, na)) THEN 'substring' ELSE 'near' END AS reason FROM p)
SELECT a, b, CAST(score AS DOUBLE) AS score, reason FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY score DESC, reason DESC) AS rn FROM c WHERE score IS NOT NULL) WHERE rn = 1""")
def join_merge_candidates(spark, d):
    """Entities that may be the same."""
    return A.merge_candidates(V.entities(spark, d))


@add("""WITH x AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^\\p{L}\\p{N}_])([A-Z][a-z]+[A-Z][A-Za-z]+)(?:$|[^\\p{L}\\p{N}_])', 1)) AS name, 'camel' AS kind FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^\\p{L}\\p{N}_])([A-Z]{2,6}-[0-9]+)(?:$|[^\\p{L}\\p{N}_])', 1)), 'ticket' FROM documents WHERE text IS NOT NULL
UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^\\p{L}\\p{N}_])([A-Z]{3,8})(?:$|[^\\p{L}\\p{N}_])', 1)), 'acronym' FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^\\p{L}\\p{N}_])([A-Z][a-z]{2,} [A-Z][a-z]{2,})(?:$|[^\\p{L}\\p{N}_])', 1)), 'proper' FROM documents WHERE text IS NOT NULL)
SELECT kind, name, count(DISTINCT doc_id) AS n_docs FROM x GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 3""")
def assoc_implicit_entities(spark, d):
    """Names that documents use without a link, by their form, in at least three documents."""
    t = table(spark, d, "documents").where("text is not null")
    forms = {"camel": r"(?:^|[^\p{L}\p{N}_])([A-Z][a-z]+[A-Z][A-Za-z]+)(?:$|[^\p{L}\p{N}_])", "ticket": r"(?:^|[^\p{L}\p{N}_])([A-Z]{2,6}-[0-9]+)(?:$|[^\p{L}\p{N}_])", "acronym": r"(?:^|[^\p{L}\p{N}_])([A-Z]{3,8})(?:$|[^\p{L}\p{N}_])", "proper": r"(?:^|[^\p{L}\p{N}_])([A-Z][a-z]{2,} [A-Z][a-z]{2,})(?:$|[^\p{L}\p{N}_])"}
    found = F.concat(*[F.transform(F.regexp_extract_all("text", F.lit(p), 1), _tag(k)) for k, p in forms.items()])
    return t.select("doc_id", F.explode(found).alias("x")).groupBy("x.kind", "x.name").agg(F.countDistinct("doc_id").alias("n_docs")).where("n_docs >= 3")


def _tag(kind):
    return lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("name"))


QUERIES, SQL = book.queries, book.sql
