"""Reports that combine several tables: timelines, briefs, gaps, suggestions of values, expansions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wherry.operators import association as A
from wherry.operators import markdown as M
from wherry.operators import search as S
from wherry.operators import vault as V
from wherry.plans.association import book as assoc_book
from wherry.plans.association import mentions
from wherry.plans.book import Book
from wherry.plans.graph import base
from wherry.plans.notes import DOC_SQL, docs, lines
from wherry.session import link_key, table

book = Book()
add = book.add
_TASK = "^[ \\t]*[-*+] \\[([ xX-])\\] (.*)$"
_HEAD = "^(#{1,6}) +(.*?)[ \\t]*$"


@add(
    DOC_SQL
    + f"""SELECT coalesce(context, '(no heading)') AS heading, count(*) AS n_tasks, count(*) FILTER (WHERE mark = 'x') AS n_done FROM (SELECT lower(regexp_extract(line, '{_TASK}', 1)) AS mark, line,
last_value(CASE WHEN regexp_matches(line, '{_HEAD}') THEN regexp_extract(line, '{_HEAD}', 2) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS context FROM lines) WHERE regexp_matches(line, '{_TASK}') GROUP BY 1"""
)
def agg_tasks_by_heading(spark, d):
    """Tasks by the heading they stand under."""
    t = M.tasks(lines(spark, d), "doc_id")
    return t.groupBy(F.coalesce("context", F.lit("(no heading)")).alias("heading")).agg(F.count(F.lit(1)).alias("n_tasks"), F.count_if(F.col("status") == "completed").alias("n_done"))


@add("SELECT source, CAST(date_trunc('week', last_seen_at) AS DATE) AS week, count(*) AS n, CAST(sum(CAST(round(coalesce(score, 0) * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100) AS mean_score FROM (SELECT DISTINCT sighting_id, source, last_seen_at, score FROM prospect_ledger) GROUP BY 1, 2")
def agg_layer_series(spark, d):
    """Mean score of sightings by source and ISO week."""
    p = table(spark, d, "prospect_ledger").select("sighting_id", "source", "last_seen_at", "score").distinct()
    cents = F.sum(F.round(F.coalesce("score", F.lit(0.0)) * 100).cast("long")).cast("double")
    return p.groupBy("source", F.to_date(F.date_trunc("week", "last_seen_at")).alias("week")).agg(F.count(F.lit(1)).alias("n"), (cents / (F.count(F.lit(1)) * 100)).alias("mean_score"))


@add(
    V.VAULT_SQL
    + """, ev AS (SELECT regexp_replace(lower(trim(term)), '\\.md$', '') AS key, CAST(seen_day AS DATE) AS day, 'sighting' AS event FROM (SELECT DISTINCT * FROM prospect_ledger) WHERE term IS NOT NULL UNION ALL SELECT dst, CAST(wt AS DATE), 'link' FROM links WHERE wt IS NOT NULL
UNION ALL SELECT regexp_replace(lower(trim(term)), '\\.md$', ''), CAST(updated_at AS DATE), 'summary' FROM (SELECT DISTINCT * FROM prospect_summary) WHERE term IS NOT NULL)
SELECT id, day, event, count(*) AS n FROM ev JOIN (SELECT min(id) AS id, regexp_replace(lower(trim(name)), '\\.md$', '') AS key FROM ents WHERE name IS NOT NULL GROUP BY 2) e USING (key) GROUP BY 1, 2, 3"""
)
def agg_entity_timeline(spark, d):
    """What happened to each entity by day: sightings, links and summaries under its name."""
    e = V.entities(spark, d).where("name is not null").groupBy(link_key("name").alias("key")).agg(F.min("id").alias("id"))
    s = table(spark, d, "prospect_ledger").distinct().where("term is not null").select(link_key("term").alias("key"), F.to_date("seen_day").alias("day"), F.lit("sighting").alias("event"))
    k = V.links(spark, d).where("at is not null").select(F.col("dst").alias("key"), F.to_date("at").alias("day"), F.lit("link").alias("event"))
    u = table(spark, d, "prospect_summary").distinct().where("term is not null").select(link_key("term").alias("key"), F.to_date("updated_at").alias("day"), F.lit("summary").alias("event"))
    return s.unionByName(k).unionByName(u).join(e, "key").groupBy("id", "day", "event").agg(F.count(F.lit(1)).alias("n"))


@add(
    V.VAULT_SQL
    + "SELECT CAST(modified AS DATE) AS day, top, count(*) AS n FROM notes WHERE abs(CAST(modified AS DATE) - DATE '2025-06-15') <= 21 GROUP BY 1, 2"
)
def agg_context_window(spark, d):
    """Notes changed within three weeks of a day, by day and folder."""
    n = V.notes(spark, d).withColumn("day", F.to_date("modified"))
    return n.where(F.abs(F.datediff("day", F.lit("2025-06-15").cast("date"))) <= 21).groupBy("day", "top").agg(F.count(F.lit(1)).alias("n"))


@add(
    DOC_SQL
    + """, st AS (SELECT doc_id, min(value) AS value FROM fields WHERE field = 'status' AND value <> '' GROUP BY 1), c AS (SELECT source, value, count(*) AS n FROM docs JOIN st USING (doc_id) GROUP BY 1, 2),
best AS (SELECT source, value, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, value) AS r FROM c) WHERE r = 1) SELECT docs.doc_id, best.value AS suggestion, best.n FROM docs JOIN best USING (source) WHERE docs.doc_id NOT IN (SELECT doc_id FROM st)"""
)
def schema_suggest_values(spark, d):
    """A status for each document without one: the commonest of its source, one row per source being joined."""
    t = docs(spark, d, "source", "text")
    st = M.fields(t, "doc_id", F.col("text")).where("field = 'status' and value <> ''").groupBy("doc_id").agg(F.min("value").alias("value"))
    t = t.drop("text")
    c = t.join(st, "doc_id").groupBy("source", "value").agg(F.count(F.lit(1)).alias("n"))
    best = c.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "value"))).where("r = 1").select("source", F.col("value").alias("suggestion"), "n")
    return t.join(st, "doc_id", "left_anti").join(best, "source").select("doc_id", "suggestion", "n")


@add(assoc_book.common + "SELECT p.a, p.b, p.n FROM pairs p WHERE p.n >= 10 AND (p.a NOT IN (SELECT id FROM ents WHERE regexp_replace(lower(trim(path)), '\\.md$', '') IN (SELECT k FROM notes)) OR p.b NOT IN (SELECT id FROM ents WHERE regexp_replace(lower(trim(path)), '\\.md$', '') IN (SELECT k FROM notes)))")
def graph_cooccurrence_gaps(spark, d):
    """Entities mentioned together ten times or more of which one has no note."""
    there = V.entities(spark, d).select(F.col("id"), link_key("path").alias("k")).join(V.notes(spark, d).select("k"), "k", "left_semi").select("id").distinct().withColumn("ok", F.lit(True))
    p = A.adamic_adar(mentions(spark, d)).where("n >= 10")
    j = p.join(there.toDF("a", "ok_a"), "a", "left").join(there.toDF("b", "ok_b"), "b", "left")
    return j.where("ok_a is null or ok_b is null").select("a", "b", "n")


@add(
    DOC_SQL
    + f"""SELECT h.doc_id, h.line_no AS line_start, h.heading, count(l.line_no) AS n_lines, coalesce(CAST(sum(len(l.line)) AS BIGINT), 0) AS n_chars FROM (SELECT *, coalesce((SELECT min(x.line_no) FROM heads x WHERE x.doc_id = heads.doc_id AND x.line_no > heads.line_no AND x.level <= heads.level), 2147483647) AS stop FROM heads) h
LEFT JOIN lines l ON l.doc_id = h.doc_id AND l.line_no > h.line_no AND l.line_no < h.stop GROUP BY 1, 2, 3"""
)
def scan_section_sizes(spark, d):
    """Lines and characters of each section with its subsections: running totals over line lengths, differences at the ends, no join of lines."""
    x = lines(spark, d).select("doc_id", "line_no", F.length("line").cast("long").alias("c"), F.when(F.col("line").rlike(M.HEADING), F.length(F.regexp_extract("line", M.HEADING, 1))).alias("level"), F.when(F.col("line").rlike(M.HEADING), F.regexp_extract("line", M.HEADING, 2)).alias("heading"))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    x = x.withColumn("chars", F.sum("c").over(w)).withColumn("n", F.row_number().over(w)).withColumn("all_c", F.sum("c").over(Window.partitionBy("doc_id"))).withColumn("all_n", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    h = x.where("level is not null")
    below = w.rowsBetween(1, Window.unboundedFollowing)
    end = F.least(*[F.when(F.lit(k) <= F.col("level"), F.min(F.when(F.col("level") == k, F.struct("line_no", (F.col("n") - 1).alias("n"), (F.col("chars") - F.col("c")).alias("chars")))).over(below)) for k in range(1, 7)])
    h = h.withColumn("end", end)
    return h.select("doc_id", F.col("line_no").alias("line_start"), "heading", (F.coalesce("end.n", "all_n") - F.col("n")).cast("long").alias("n_lines"), (F.coalesce("end.chars", "all_c") - F.col("chars")).alias("n_chars"))


@add()
def search_similar_notes(spark, d):
    """Notes like the one with the most links, by the BM25 of its 15 key terms; itself and the notes it links to are left out. Only those terms reach the driver."""
    _, _, e = base(spark, d)
    root = e.groupBy("src").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "src").limit(1).select(F.col("src").alias("k"))
    # one note's content is read for its terms; of the others only counts leave their rows
    raw = table(spark, d, "notes_fts").where(F.col("path").isNotNull()).select(link_key("path").alias("k"), "path", "modified", "content")
    own = raw.join(F.broadcast(root), "k").groupBy("k").agg(F.max_by("content", F.struct("modified", "path")).alias("content")).where("content is not null")
    terms = [x["term"] for x in S.key_terms(own, "k", "content").orderBy("rank").collect()]
    if not terms:
        return root.select("k", F.lit(0.0).alias("score")).limit(0)
    n = V.notes(spark, d, **S.term_counts({"content": 1.0}, terms))
    hits = S.bm25_counted(n, "k", len(set(terms)), None)
    linked = e.join(root.toDF("src"), "src", "left_semi").select(F.col("dst").alias("k")).union(root)
    return hits.join(linked, "k", "left_anti").orderBy(F.desc("score"), "k").limit(20)


@add(
    V.VAULT_SQL
    + """, hit AS (SELECT k FROM notes WHERE contains(lower(title), 'index') ORDER BY modified DESC, k LIMIT 5) SELECT DISTINCT e.name AS term FROM res JOIN hit ON res.src = hit.k JOIN enotes e ON e.k = res.target_k ORDER BY term LIMIT 10"""
)
def hybrid_expansion_terms(spark, d):
    """Up to ten names to widen a query with: entities that its five best notes link to."""
    n, r, _ = base(spark, d)
    hit = n.where(F.contains(F.lower("title"), F.lit("index"))).orderBy(F.desc("modified"), "k").limit(5).select(F.col("k").alias("src"))
    e = V.entities(spark, d).where("path is not null").select(F.col("name").alias("term"), link_key("path").alias("to"))
    return r.join(hit, "src", "left_semi").join(e, "to").select("term").distinct().orderBy("term").limit(10)


QUERIES, SQL = book.queries, book.sql
