"""Search queries: ranked text, vectors, and their fusion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wherry.functions.exprs import STOPWORDS, recency_decay
from wherry.operators import retrieval as R
from wherry.operators import search as S
from wherry.operators import vault as V
from wherry.plans.book import Book
from wherry.plans.graph import AS_OF
from wherry.session import table

QUERY = 'backlink count of the "tag set" index digest'
TERMS = ["backlink", "digest", "index"]
_W = "regexp_extract_all(coalesce(lower({0}), ''), '[\\p{{L}}\\p{{N}}]+')"
_BM = """ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * t{i} * 2.2 / (t{i} + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))"""
book = Book()
add = book.add


def _bm25_sql(source: str, key: str, fields: dict[str, float], terms: list[str], limit: str) -> str:
    """BM25 of a few terms in SQL."""
    terms = sorted(set(terms))
    w = ", ".join(f"{_W.format(c)} AS w_{c}" for c in fields)
    tf = ", ".join("(" + " + ".join(f"len(list_filter(w_{c}, lambda v: v = '{t}')) * {float(x)}" for c, x in fields.items()) + f") AS t{i}" for i, t in enumerate(terms))
    any_ = " + ".join(f"t{i}" for i in range(len(terms)))
    dfs = ", ".join(f"count(*) FILTER (WHERE t{i} > 0) AS d{i}" for i in range(len(terms)))
    return f"""w AS (SELECT {key}, {w} FROM {source}), t AS (SELECT {key}, {' + '.join(f'len(w_{c})' for c in fields)} AS dl, {tf} FROM w), st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {dfs} FROM t),
scored AS (SELECT {key}, round({' + '.join(_BM.format(i=i) for i in range(len(terms)))}, 6) AS score FROM t, st WHERE {any_} > 0 {limit})
"""


_TOP = "ORDER BY score DESC, doc_id LIMIT 20"


@add("WITH " + _bm25_sql("documents", "doc_id", {"text": 1.0}, TERMS, _TOP) + "SELECT doc_id, score FROM scored")
def search_bm25(spark, d):
    """The 20 best documents for a query."""
    return S.bm25(table(spark, d, "documents"), "doc_id", {"text": 1.0}, TERMS)


def note_bm25(spark, d, fields, terms, k):
    """The best notes by their title (weight 5) and other fields. Contents are counted where they stand; only counts are shuffled to pick each note's newest version."""
    n = V.notes(spark, d, **S.term_counts(fields, terms))
    own = S.term_counts({"title": 5.0}, terms)
    return S.bm25_counted(n.select("k", *[(F.col(c) + x).alias(c) for c, x in own.items()]), "k", len(own) - 1, k)


@add(V.VAULT_SQL + ", " + _bm25_sql("notes", "k", {"title": 5.0, "frontmatter": 10.0, "content": 1.0}, TERMS, "ORDER BY score DESC, k LIMIT 20") + "SELECT k, score FROM scored")
def search_bm25_fields(spark, d):
    """The 20 best notes with weights for title, frontmatter and content."""
    return note_bm25(spark, d, {"frontmatter": 10.0, "content": 1.0}, TERMS, 20)


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


@add(f"""WITH q AS (SELECT DISTINCT item_id AS query_id, unnest({_W.format('text')}) AS term FROM eval_items), q2 AS (SELECT * FROM q WHERE len(term) > 3 AND term NOT IN ({_STOP})),
w AS (SELECT doc_id, {_W.format('text')} AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w), x AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM w),
p AS (SELECT doc_id, dl, term, count(*) AS tf FROM x WHERE term IN (SELECT term FROM q2) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM p JOIN df USING (term) JOIN q2 USING (term), st GROUP BY 1, 2)
SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5""")
def search_bm25_batch(spark, d):
    """The five best documents for each evaluation item."""
    q = table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.explode(S.words(F.col("text"))).alias("term"))
    return S.bm25_batch(table(spark, d, "documents"), "doc_id", "text", q.where((F.length("term") > 3) & ~F.col("term").isin(*STOPWORDS)), 5)


@add(f"SELECT count(DISTINCT doc_id) AS n_docs FROM documents WHERE contains(' ' || array_to_string({_W.format('text')}, ' ') || ' ', ' tag set ')")
def search_phrase_count(spark, d):
    """Documents with a phrase."""
    return S.phrase_count(table(spark, d, "documents"), "doc_id", "text", "tag set")


@add(f"SELECT doc_id FROM documents WHERE len(list_filter({_W.format('text')}, lambda w: starts_with(w, 'frontm'))) > 0")
def search_prefix(spark, d):
    """Documents with a word of a prefix."""
    return table(spark, d, "documents").where(F.exists(S.words(F.col("text")), lambda w: F.startswith(w, F.lit("frontm")))).select("doc_id")


@add(V.VAULT_SQL + ", e AS (SELECT id, name, array_to_string(aliases, ' ') AS al, category FROM ents), " + _bm25_sql("e", "id", {"name": 1.0, "al": 1.0, "category": 1.0}, ["pipeline", "crew", "people"], "ORDER BY score DESC, id LIMIT 20") + "SELECT id, score FROM scored")
def search_entities(spark, d):
    """The 20 best entities by name, aliases and category."""
    e = V.entities(spark, d).withColumn("al", F.array_join("aliases", " "))
    return S.bm25(e, "id", {"name": 1.0, "al": 1.0, "category": 1.0}, ["pipeline", "crew", "people"])


@add(V.VAULT_SQL + "SELECT id, name FROM ents WHERE starts_with(lower(name), 'th') OR len(list_filter(aliases, lambda a: starts_with(lower(a), 'th'))) > 0")
def search_entity_prefix(spark, d):
    """Entities whose name or an alias has a prefix."""
    return V.entities(spark, d).where(F.startswith(F.lower("name"), F.lit("th")) | F.exists("aliases", lambda a: F.startswith(F.lower(a), F.lit("th")))).select("id", "name")


@add(f"""WITH c AS (SELECT doc_id, string_split_regex(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '(?s)```.*?```', ' ', 'g'), '`[^`]*`', ' ', 'g'), 'https?://\\S+', ' ', 'g'), '\\[\\[([^\\]|]*\\|)?([^\\]]*)\\]\\]', '\\2', 'g'), '[^\\p{{L}}\\s]', ' ', 'g'), '\\s+') AS w FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, list_filter(w, lambda x: len(x) > 2 AND x NOT IN ({_STOP})) AS w FROM c), x AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM f), g AS (SELECT doc_id, term, count(*) AS tf, min(pos) AS pos FROM x GROUP BY 1, 2)
SELECT doc_id, term, tf, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, pos) AS rank FROM g) WHERE rank <= 15""")
def search_key_terms(spark, d):
    """The 15 key terms of each document."""
    return S.key_terms(table(spark, d, "documents").where("text is not null"), "doc_id", "text")


@add("""WITH p AS (SELECT doc_id, regexp_split_to_array(text, '\\n\\n+') AS p FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, unnest(p) AS paragraph, unnest(range(len(p))) AS pos FROM p),
s AS (SELECT *, """ + " + ".join(f"CASE WHEN list_contains({_W.format('paragraph')}, '{t}') THEN 10 ELSE 0 END" for t in TERMS) + """ AS score FROM x)
SELECT doc_id, pos, score, paragraph FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rn FROM s WHERE score > 0) WHERE rn = 1""")
def search_snippets(spark, d):
    """The best paragraph of each document for a query."""
    return S.best_paragraph(table(spark, d, "documents").where("text is not null"), "doc_id", "text", TERMS)


_MON = "(" + "|".join(R.MONTHS) + ")"
_MM = "lpad(CAST(list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], lower(substr({0}, 1, 3))) AS VARCHAR), 2, '0')"
_US, _EU, _MY = f"(?i)\\b{_MON}\\s+(\\d{{1,2}}),?\\s+(\\d{{4}})\\b", f"(?i)\\b(\\d{{1,2}})\\s+{_MON}\\s+(\\d{{4}})\\b", f"(?i)\\b({'|'.join(R.LONG_MONTHS)})\\s+(\\d{{4}})\\b"
_G = "regexp_extract(m, '{0}', {1})"


@add(f"""WITH d AS (SELECT doc_id, list_sort(list_distinct(list_concat(regexp_extract_all(text, '\\b(\\d{{4}}-\\d{{2}}-\\d{{2}})\\b', 1), list_transform(regexp_extract_all(text, '{_US}', 0), lambda m: {_G.format(_US, 3)} || '-' || {_MM.format(_G.format(_US, 1))} || '-' || lpad({_G.format(_US, 2)}, 2, '0')),
list_transform(regexp_extract_all(text, '{_EU}', 0), lambda m: {_G.format(_EU, 3)} || '-' || {_MM.format(_G.format(_EU, 2))} || '-' || lpad({_G.format(_EU, 1)}, 2, '0')), list_transform(regexp_extract_all(text, '{_MY}', 0), lambda m: {_G.format(_MY, 2)} || '-' || {_MM.format(_G.format(_MY, 1))} || '-01')))) AS dates FROM documents WHERE text IS NOT NULL)
SELECT doc_id, dates FROM d WHERE len(dates) > 0""")
def search_dates(spark, d):
    """Dates in each document, in any of four forms."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", R.dates(F.col("text")).alias("dates")).where(F.size("dates") > 0)


@add()
def search_stemmed(spark, d):
    """Documents by stemmed terms: the distinct vocabulary is stemmed once, the words with a stem of the query are counted in each text."""
    return S.stemmed_counts(table(spark, d, "documents"), "doc_id", "text", [S.porter(t) for t in TERMS])


_EMB = "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


@add(_EMB + ", q AS (SELECT v AS q FROM e WHERE vec_id = (SELECT min(vec_id) FROM e)) SELECT vec_id, round(list_cosine_similarity(v, q), 6) AS sim FROM e, q WHERE vec_id <> (SELECT min(vec_id) FROM e) ORDER BY sim DESC, vec_id LIMIT 10")
def vector_knn(spark, d):
    """The ten nearest vectors of the first one, itself left out."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    first = e.agg(F.min_by("v", "vec_id").alias("q"), F.min("vec_id").alias("first"))
    near = S.knn(e, "vec_id", first.select("q"), 11)
    return near.crossJoin(F.broadcast(first.select("first"))).where("vec_id <> first").select("vec_id", "sim").orderBy(F.desc("sim"), "vec_id").limit(10)


@add(_EMB + """, x AS (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS pos FROM e), m AS (SELECT label, pos, avg(x) AS x FROM x GROUP BY 1, 2 HAVING count(*) >= 3), c AS (SELECT label, list(x ORDER BY pos) AS c FROM m GROUP BY 1),
s AS (SELECT vec_id, c.label, round(list_cosine_similarity(v, c), 6) AS sim FROM e, c) SELECT vec_id, label, sim FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS rn FROM s) WHERE rn = 1 AND sim >= 0.2""")
def vector_classify(spark, d):
    """The nearest class centroid of every vector."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("v"))
    return S.classify(e.drop("label"), "vec_id", S.centroids(e), 0.2)


@add(_EMB + " SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 5) AS norm FROM e")
def vector_norms(spark, d):
    """Norm of every vector."""
    return table(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), 5).alias("norm"))


@add()
def vector_mmr(spark, d):
    """Ten diverse vectors near each class's first vector."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("v"))
    q = e.groupBy("label").agg(F.min_by("v", "vec_id").alias("q"), F.min("vec_id").alias("query_id"))
    from wherry.functions.exprs import cosine

    s = e.drop("label").crossJoin(F.broadcast(S.few(q))).select("query_id", F.col("vec_id").alias("key"), cosine(F.col("v"), F.col("q")).alias("score"), "v").where("key <> query_id")
    top = s.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))).where("r <= 40").drop("r")
    return S.mmr(top, 10)


_H = (
    V.VAULT_SQL
    + ", "
    + _bm25_sql("notes", "k", {"title": 5.0, "content": 1.0}, TERMS, "ORDER BY score DESC, k LIMIT 40")
    + """, text_c AS (SELECT k, row_number() OVER (ORDER BY score DESC, k) AS rank FROM scored),
edge_c AS (SELECT k, row_number() OVER (ORDER BY w DESC, k) AS rank FROM (SELECT target_k AS k, round(sum(weight), 6) AS w FROM res WHERE target_k IS NOT NULL GROUP BY 1 ORDER BY w DESC, k LIMIT 40)),
new_c AS (SELECT k, row_number() OVER (ORDER BY modified DESC, k) AS rank FROM (SELECT k, modified FROM notes ORDER BY modified DESC, k LIMIT 40)),
allc AS (SELECT k, rank, 1 AS a, 0 AS b, 0 AS c FROM text_c UNION ALL SELECT k, rank, 0, 1, 0 FROM edge_c UNION ALL SELECT k, rank, 0, 0, 1 FROM new_c),
fused AS (SELECT k, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, max(a) = 1 AS in_text, max(b) = 1 AS in_edges, max(c) = 1 AS in_recent FROM allc GROUP BY 1)
"""
)


def _channels(spark, d):
    text = S.rank_by(note_bm25(spark, d, {"content": 1.0}, TERMS, 40), F.desc("score"), "k")
    r = V.resolved(V.links(spark, d), V.entity_keys(V.notes(spark, d), V.entities(spark, d)))
    edges = r.where(F.col("to").isNotNull()).groupBy(F.col("to").alias("k")).agg(F.round(F.sum("weight"), 6).alias("w")).orderBy(F.desc("w"), "k").limit(40)
    recent = V.notes(spark, d).select("k", "modified").orderBy(F.desc("modified"), "k").limit(40)
    return {"text": text, "edges": S.rank_by(edges, F.desc("w"), "k"), "recent": S.rank_by(recent, F.desc("modified"), "k")}, r


@add(_H + "SELECT k, rrf, in_text, in_edges, in_recent FROM fused")
def hybrid_rrf(spark, d):
    """Text, link and recency lists fused by reciprocal rank."""
    c, _ = _channels(spark, d)
    return S.fuse(c, "k")


@add(_H + "SELECT f.k, round(rrf + CASE WHEN lower(title) = 'index' THEN 0.5 WHEN starts_with(lower(title), 'index') THEN 0.2 ELSE 0 END, 6) AS score FROM fused f JOIN notes USING (k) ORDER BY score DESC, f.k LIMIT 25")
def hybrid_title_boost(spark, d):
    """The fused list with boosts for titles that are or begin with the query."""
    c, _ = _channels(spark, d)
    t = F.lower("title")
    boost = F.when(t == "index", 0.5).when(F.startswith(t, F.lit("index")), 0.2).otherwise(0.0)
    return S.fuse(c, "k").join(V.notes(spark, d).select("k", "title"), "k").select("k", F.round(F.col("rrf") + boost, 6).alias("score")).orderBy(F.desc("score"), "k").limit(25)


_DECAY = f"greatest(0.1, 1 - (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(modified)) / 86400000000.0 / 180)"


@add(_H + f"SELECT f.k, round(rrf + (least(coalesce(e.w, 0) * 3, 6) + 5 * {_DECAY}) / 50, 6) AS score FROM fused f JOIN notes USING (k) LEFT JOIN (SELECT target_k AS k, avg(weight) AS w FROM res WHERE target_k IS NOT NULL GROUP BY 1) e ON e.k = f.k")
def hybrid_graph_rerank(spark, d):
    """The fused list re-ranked by mean link weight and recency."""
    c, r = _channels(spark, d)
    e = r.where(F.col("to").isNotNull()).groupBy(F.col("to").alias("k")).agg(F.avg("weight").alias("w"))
    n = V.notes(spark, d).select("k", "modified")
    boost = F.least(F.coalesce("w", F.lit(0.0)) * 3, F.lit(6.0)) + 5 * recency_decay(F.col("modified"), AS_OF)
    return S.fuse(c, "k").join(n, "k").join(e, "k", "left").select("k", F.round(F.col("rrf") + boost / 50, 6).alias("score"))


@add(_H + ", top10 AS (SELECT k, row_number() OVER (ORDER BY rrf DESC, k) AS rank FROM (SELECT k, rrf FROM fused ORDER BY rrf DESC, k LIMIT 10)) SELECT k, CAST(CASE WHEN (SELECT count(*) FROM top10) < 3 THEN rank - 1 WHEN (rank - 1) % 2 = 0 THEN (rank - 1) // 2 ELSE (SELECT count(*) FROM top10) - 1 - (rank - 1) // 2 END AS INTEGER) AS pos FROM top10")
def hybrid_sandwich(spark, d):
    """The ten best with the strongest at both ends."""
    c, _ = _channels(spark, d)
    top = S.rank_by(S.fuse(c, "k").orderBy(F.desc("rrf"), "k").limit(10), F.desc("rrf"), "k")
    return S.sandwich(top, "k")


@add(_H + """, par AS (SELECT k FROM (SELECT k, rrf FROM fused ORDER BY rrf DESC, k LIMIT 10)), hop AS (SELECT DISTINCT p.k AS parent, r.target_k AS k FROM par p JOIN res r ON r.src = p.k WHERE r.target_k IS NOT NULL AND r.target_k NOT IN (SELECT k FROM par)),
cap AS (SELECT parent, k, row_number() OVER (PARTITION BY parent ORDER BY k) AS rn FROM hop), c AS (SELECT k, min(parent) AS via FROM cap WHERE rn <= 10 GROUP BY 1) SELECT k, via FROM c""")
def hybrid_multihop(spark, d):
    """Notes one link beyond the ten best, at most ten per parent, with the parent they come from."""
    c, r = _channels(spark, d)
    par = S.fuse(c, "k").orderBy(F.desc("rrf"), "k").limit(10).select("k")
    hop = r.where(F.col("to").isNotNull()).join(par.toDF("src"), "src").select(F.col("src").alias("parent"), F.col("to").alias("k")).distinct().join(par, "k", "left_anti")
    w = Window.partitionBy("parent").orderBy("k")
    return hop.withColumn("rn", F.row_number().over(w)).where("rn <= 10").groupBy("k").agg(F.min("parent").alias("via"))


@add(_H + """, top10 AS (SELECT k FROM (SELECT k, rrf FROM fused ORDER BY rrf DESC, k LIMIT 10)), o AS (SELECT DISTINCT src, target_k AS t FROM res WHERE target_k IS NOT NULL AND src IN (SELECT k FROM top10)),
b AS (SELECT x.src AS a, y.src AS b, x.t FROM o x JOIN o y ON x.t = y.t AND x.src < y.src) SELECT a, b, count(*) AS n_bridges FROM b GROUP BY 1, 2""")
def hybrid_bridges(spark, d):
    """Targets shared between the ten best notes."""
    c, r = _channels(spark, d)
    top = S.fuse(c, "k").orderBy(F.desc("rrf"), "k").limit(10).select("k")
    o = r.where(F.col("to").isNotNull()).join(top.toDF("src"), "src", "left_semi").select("src", F.col("to").alias("t")).distinct()
    return o.toDF("a", "t").join(o.toDF("b", "t"), "t").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_bridges"))


QUERIES, SQL = book.queries, book.sql
