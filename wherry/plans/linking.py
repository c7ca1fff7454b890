"""Queries that find and write links in prose, and the summed suggestion score."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wherry.functions.exprs import beta_mean, half_up, idf_clamped
from wherry.operators import linking as L
from wherry.operators import vault as V
from wherry.plans import learning
from wherry.plans.association import mentions
from wherry.plans.book import Book
from wherry.session import link_key, table

book = Book()
add = book.add


def patterns(spark, d):
    """Names and aliases of entities, of two letters or more, as an entity's name must be."""
    e = V.entities(spark, d)
    return e.select("id", F.explode(F.concat(F.array("name"), "aliases")).alias("pattern")).where(F.length(F.trim("pattern")) >= 2)


@add()
def link_positions(spark, d):
    """Where entities stand in documents, outside code, links and headings."""
    return L.find_mentions(table(spark, d, "documents"), "doc_id", "text", patterns(spark, d))


@add()
def link_applied(spark, d):
    """Documents with the first mention of each entity written as a link."""
    docs = table(spark, d, "documents")
    found = L.first_mentions(L.find_mentions(docs, "doc_id", "text", patterns(spark, d)))
    return L.apply_links(docs, "doc_id", "text", found, V.entities(spark, d).select("id", "name"))


#: Least score, least share of a name's words, and the share of content a link needs, by strictness.
STRICTNESS = {"conservative": (18, 0.6), "balanced": (10, 0.6), "aggressive": (5, 0.3)}


def suggestion_scores(spark, d, strictness="balanced", disabled=()):
    """``doc_id, id, score`` and one column per layer; a layer named in ``disabled`` counts 0.

    Layers: words of the name or an alias in the text, whichever has more (10 each, 8 more for a full one), scaled by the entity's rarity; hub, edge and category; feedback.
    Candidates come from shared words only, so documents and entities are never all paired. Documents and entities without any shared word give nothing.
    """
    least, share = STRICTNESS[strictness]
    on = lambda name, c: F.lit(0.0) if name in disabled else c.cast("double")
    e = V.entities(spark, d)
    hit = learning.name_hits(table(spark, d, "documents"), e, share)
    e = e.where(F.length("name") <= 25).select("id", link_key("name").alias("entity"))
    m = mentions(spark, d)
    total = m.agg(F.countDistinct("note").alias("total"))
    rarity = m.groupBy(F.col("entity").alias("id")).agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(total)).select("id", idf_clamped(F.col("df"), F.col("total"), 0.7, 1.8).alias("rarity"))
    layers = learning.QUERIES["suggest_layers"](spark, d).select("id", "hub", "edge", "kind")
    post = learning.stats(learning.feedback(spark, d), "entity").select("entity", beta_mean(F.col("good"), F.col("bad")).alias("p"))
    fb = e.select("id", "entity").join(post, "entity").select("id", F.when(F.col("p") < 0.45, half_up(-15 * (1 - F.col("p") / 0.45))).when(F.col("p") < 0.55, -5.0).when(F.col("p") >= 0.85, 4.0).otherwise(0.0).alias("feedback"))
    x = hit.join(rarity, "id", "left").join(layers, "id", "left").join(fb, "id", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    lexical = F.col("points") * F.coalesce("rarity", F.lit(1.3))
    x = x.select("doc_id", "id", F.round(on("lexical", lexical), 6).alias("lexical"), on("hub", z("hub")).alias("hub"), on("edge", z("edge")).alias("edge"), on("kind", z("kind")).alias("kind"), on("feedback", z("feedback")).alias("feedback"))
    s = F.round(F.col("lexical") + F.col("hub") + F.col("edge") + F.col("kind") + F.col("feedback"), 6)
    return x.withColumn("score", s).where(F.col("score") >= least)


@add()
def suggest_scored(spark, d):
    """The five best entities for each document by the sum of the layers."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "id")
    return suggestion_scores(spark, d).withColumn("rank", F.row_number().over(w)).where("rank <= 5")


@add(
    V.VAULT_SQL
    + """, mv AS (SELECT from_k, to_k FROM (WITH ev AS (SELECT DISTINCT seq, regexp_replace(lower(trim(path)), '\\.md$', '') AS k, type, ts FROM file_events WHERE path IS NOT NULL), u AS (SELECT seq, k, regexp_extract(k, '[^/]*$') AS stem, epoch_us(ts) AS us FROM ev WHERE type = 'unlink'), a AS (SELECT seq, k, regexp_extract(k, '[^/]*$') AS stem, epoch_us(ts) AS us FROM ev WHERE type = 'add'),
p AS (SELECT u.k AS from_k, a.k AS to_k, u.seq AS unlink_seq, a.seq AS add_seq, abs(u.us - a.us) AS gap, regexp_extract(u.k, '^(.*)/[^/]*$', 1) <> regexp_extract(a.k, '^(.*)/[^/]*$', 1) AS away FROM u JOIN a ON u.stem = a.stem AND u.k <> a.k AND abs(u.us - a.us) <= 5000000 AND (regexp_extract(u.k, '^(.*)/[^/]*$', 1) = regexp_extract(a.k, '^(.*)/[^/]*$', 1) OR regexp_replace(u.stem, '\\.[^.]+$', '') NOT IN ('readme', 'index', 'todo', 'changelog', 'license', 'notes'))), r AS (SELECT *, row_number() OVER (PARTITION BY unlink_seq ORDER BY away, gap, add_seq) AS ru, row_number() OVER (PARTITION BY add_seq ORDER BY away, gap, unlink_seq) AS ra FROM p) SELECT from_k, to_k, row_number() OVER (PARTITION BY from_k ORDER BY unlink_seq DESC) AS last FROM r WHERE ru = 1 AND ra = 1) WHERE last = 1)
SELECT link_id, coalesce(a.to_k, src) AS src, coalesce(b.to_k, dst) AS dst FROM links LEFT JOIN mv a ON a.from_k = src LEFT JOIN mv b ON b.from_k = dst WHERE a.to_k IS NOT NULL OR b.to_k IS NOT NULL"""
)
def mutate_move_links(spark, d):
    """Links whose note or target was moved, with the new paths: the cascade of renames. The moves are few and joined by key."""
    from wherry.plans.changes import log
    from wherry.streaming.changes import renames

    mv = renames(log(spark, d)).groupBy("from_k").agg(F.max_by("to_k", "unlink_seq").alias("to_k"))
    a, b = mv.toDF("src", "new_src"), mv.toDF("dst", "new_dst")
    x = V.links(spark, d).join(a, "src", "left").join(b, "dst", "left").where("new_src is not null or new_dst is not null")
    return x.select("link_id", F.coalesce("new_src", "src").alias("src"), F.coalesce("new_dst", "dst").alias("dst"))


@add(
    V.VAULT_SQL
    + """, q AS (SELECT id, regexp_replace(lower(trim(name)), '\\.md$', '') AS key FROM ents), s AS (SELECT l.src AS note_path, q.id AS entity, max(l.weight) AS score, max(l.wt) AS wt FROM links l JOIN q ON q.key = l.dst GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY note_path ORDER BY score DESC, entity) AS per_note, row_number() OVER (PARTITION BY CAST(wt AS DATE) ORDER BY score DESC, entity, note_path) AS per_day FROM s WHERE score >= 0.4 AND wt IS NOT NULL) SELECT note_path, entity, round(score, 6) AS score FROM r WHERE per_note <= 2 AND per_day <= 10"""
)
def stream_queue_drained(spark, d):
    """Queued suggestions to apply: the best per note and day within their caps."""
    e = V.entities(spark, d).select(F.col("id").alias("entity"), link_key("name").alias("dst"))
    s = V.links(spark, d).join(e, "dst").groupBy(F.col("src").alias("note_path"), "entity").agg(F.max("weight").alias("score"), F.max("at").alias("at")).where("score >= 0.4 and at is not null")
    by_note = Window.partitionBy("note_path").orderBy(F.desc("score"), "entity")
    by_day = Window.partitionBy(F.to_date("at")).orderBy(F.desc("score"), "entity", "note_path")
    s = s.withColumn("n", F.row_number().over(by_note)).withColumn("m", F.row_number().over(by_day))
    return s.where("n <= 2 and m <= 10").select("note_path", "entity", F.round("score", 6).alias("score"))


#: What a question asks for, by its words; the first rule wins (fixed values).
ROUTES = {
    "temporal": r"(?i)\b(history|timeline|timelines|evolution|stale notes?|around date|weekly review|monthly review|quarterly review)\b",
    "graph": r"(?i)\b(backlinks?|forward links?|connections?|link path|hubs?|orphans?|clusters?|bridges?)\b",
    "schema": r"(?i)\b(schema|schemas|frontmatter conventions?|rename field|rename tag|migrate)\b",
    "wikilinks": r"(?i)\b(wikilinks?|link suggestions?|stubs?|unlinked mentions?)\b",
}


def _route_sql(text: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}') THEN '{k}'" for k, p in ROUTES.items()) + " END"


def route(text):
    """The category a question belongs to; null if no rule says."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(k)) for k, p in ROUTES.items()])


@add(f"SELECT item_id, {_route_sql('text')} AS expected FROM (SELECT DISTINCT item_id, text FROM eval_items)")
def route_by_rules(spark, d):
    """The category each evaluation question should be routed to by its words; null where no rule fits."""
    return table(spark, d, "eval_items").select("item_id", "text").distinct().select("item_id", route(F.col("text")).alias("expected"))


@add(f"""WITH q AS (SELECT doc_id, lower(trim(source)) AS tool, text FROM documents WHERE text IS NOT NULL AND trim(text) <> '' AND source IS NOT NULL), r AS (SELECT doc_id, tool, {_route_sql('text')} AS expected FROM q)
SELECT tool, expected, count(*) AS n, min(doc_id) AS first_doc FROM r WHERE expected IS NOT NULL AND NOT contains(tool, expected) GROUP BY 1, 2""")
def agg_misroutes(spark, d):
    """Texts whose words ask for another category than the source they came by, counted by both."""
    q = table(spark, d, "documents").where(F.col("source").isNotNull() & (F.trim("text") != "")).select("doc_id", F.lower(F.trim("source")).alias("tool"), route(F.col("text")).alias("expected"))
    return q.where(F.col("expected").isNotNull() & ~F.contains("tool", "expected")).groupBy("tool", "expected").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


@add(
    V.VAULT_SQL
    + """, al AS (SELECT key, min(name) AS name FROM (SELECT regexp_replace(lower(trim(a)), '\\.md$', '') AS key, name FROM (SELECT unnest(aliases) AS a, name FROM ents)) WHERE key <> '' AND key NOT IN (SELECT regexp_replace(lower(trim(name)), '\\.md$', '') FROM ents WHERE name IS NOT NULL) GROUP BY 1),
m AS (SELECT doc_id, trim(x) AS target FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\[\\[([^\\]|#\\n]+)', 1)) AS x FROM documents WHERE text IS NOT NULL)) SELECT doc_id, target, '[[' || al.name || '|' || target || ']]' AS resolved, count(*) AS n FROM m JOIN al ON al.key = regexp_replace(lower(target), '\\.md$', '') GROUP BY 1, 2, 3"""
)
def link_aliases_resolved(spark, d):
    """Links of documents that name an entity by an alias, with the link to its canonical name that keeps the text. Links are taken out of the texts before anything is shuffled."""
    e = V.entities(spark, d)
    names = e.where("name is not null").select(link_key("name").alias("key"))
    al = e.select(F.explode("aliases").alias("a"), "name").select(link_key("a").alias("key"), "name").where("key <> ''").join(names, "key", "left_anti").groupBy("key").agg(F.min("name").alias("name"))
    m = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\[\[([^\]|#\n]+)"), 1)).alias("x")).select("doc_id", F.trim("x").alias("target"))
    m = m.withColumn("key", link_key("target")).join(al, "key")
    return m.groupBy("doc_id", "target", F.concat(F.lit("[["), "name", F.lit("|"), "target", F.lit("]]")).alias("resolved")).agg(F.count(F.lit(1)).alias("n"))


QUERIES, SQL = book.queries, book.sql
