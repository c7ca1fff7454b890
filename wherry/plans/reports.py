"""Reports over the whole vault: staleness, periodic notes, unlinked mentions, briefs, health, growth, projections of results, frontmatter out of prose."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wherry.functions.exprs import age_days, folder_of, half_up, link_key
from wherry.operators import markdown as M
from wherry.operators import memory as MEM
from wherry.operators import vault as V
from wherry.plans import memory as MP
from wherry.plans.association import mentions
from wherry.plans.book import Book
from wherry.plans.graph import AS_OF, base
from wherry.plans.notes import DOC_SQL, docs, lines
from wherry.plans.vault_scan import _PERIODIC, is_periodic
from wherry.session import table

_OWN = """, ekeys AS (SELECT id, regexp_replace(lower(trim(name)), '\\.md$', '') AS key FROM ents UNION SELECT id, regexp_replace(lower(trim(a)), '\\.md$', '') FROM (SELECT id, unnest(aliases) AS a FROM ents)),
owner AS (SELECT key, min(id) AS id FROM ekeys WHERE key <> '' GROUP BY 1), men AS (SELECT DISTINCT src AS note, id AS entity FROM links JOIN owner ON key = dst)
"""
book = Book(V.VAULT_SQL + _OWN)
add = book.add
_DAYS = f"CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(modified)) / 86400000000.0) AS BIGINT)"


@add(
    f"""WITH bl AS (SELECT target_k AS k, count(DISTINCT src) AS n FROM res WHERE target_k IS NOT NULL GROUP BY 1), ol AS (SELECT src AS k, count(*) AS n FROM (SELECT DISTINCT src, dst FROM links) GROUP BY 1), hub AS (SELECT name_lower, max(hub_score) AS h FROM ents WHERE hub_score > 0 GROUP BY 1),
act AS (SELECT entity FROM men JOIN notes ON notes.k = men.note GROUP BY 1 HAVING max(modified) >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY), ar AS (SELECT l.src AS k, count(act.entity) AS n FROM (SELECT DISTINCT src, dst FROM links) l LEFT JOIN owner ON owner.key = l.dst LEFT JOIN act ON act.entity = owner.id GROUP BY 1),
x AS (SELECT notes.k, {_DAYS} AS days, coalesce(bl.n, 0) AS b, coalesce(hub.h, 0) AS h, coalesce(ol.n, 0) AS o, coalesce(ar.n * 1.0 / ol.n, 0) AS r, regexp_matches(coalesce(content, ''), '(?m)^[ \\t]*[-*+] \\[ \\] ') AS t, regexp_matches(coalesce(frontmatter, ''), '\\bactive\\b') AS a FROM notes LEFT JOIN bl ON bl.k = notes.k LEFT JOIN ol ON ol.k = notes.k LEFT JOIN ar ON ar.k = notes.k LEFT JOIN hub ON hub.name_lower = lower(title) WHERE modified < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND NOT ({_PERIODIC.replace("regexp_extract(k,", "regexp_extract(notes.k,")}) AND top <> 'templates'),
s AS (SELECT *, least(b / 10.0, 1) * 30 + least(h / 20.0, 1) * 20 + least(o / 5.0, 1) * 15 + CASE WHEN t THEN 20 ELSE 0 END + CASE WHEN a THEN 15 ELSE 0 END AS importance, least(days / 180.0, 1) * 40 + (1 - r) * 30 + CASE WHEN t THEN 20 ELSE 0 END + CASE WHEN a AND days > 30 THEN 10 ELSE 0 END AS risk FROM x)
SELECT k, days AS days_stale, floor(CAST(importance AS DOUBLE) * 10 + 0.5) / 10 AS importance, floor(CAST(risk AS DOUBLE) * 10 + 0.5) / 10 AS risk, CASE WHEN importance < 20 AND days > 180 AND NOT t THEN 'archive' WHEN importance >= 50 AND r > 0 THEN 'update' WHEN t OR a THEN 'review' ELSE 'low_priority' END AS advice FROM s"""
)
def agg_staleness(spark, d):
    """Importance, risk of being out of date and advice for every note not changed for 30 days, periodic notes and templates left out. Contents are tested where they stand."""
    n = V.notes(spark, d, open_task=F.coalesce("content", F.lit("")).rlike(r"(?m)^[ \t]*[-*+] \[ \] "), active=F.coalesce("frontmatter", F.lit("")).rlike(r"\bactive\b"))
    e = V.entities(spark, d)
    ln = V.links(spark, d)
    r = V.resolved(ln, V.entity_keys(n.select("k"), e))
    b = r.where(F.col("to").isNotNull()).groupBy(F.col("to").alias("k")).agg(F.countDistinct("src").alias("b"))
    hub = e.where("hub_score > 0").groupBy(F.col("name_lower").alias("t")).agg(F.max("hub_score").alias("h"))
    m = mentions(spark, d)
    active = m.join(n.select(F.col("k").alias("note"), "modified"), "note").groupBy("entity").agg(F.max("modified").alias("last")).where(F.col("last") >= F.lit(AS_OF).cast("timestamp_ntz") - F.expr("interval 30 days")).select("entity", F.lit(1).alias("act"))
    keys = e.select("id", F.explode(F.concat(F.array("name"), "aliases")).alias("a")).select("id", link_key("a").alias("dst")).where("dst <> ''").groupBy("dst").agg(F.min("id").alias("entity"))
    o = ln.select("src", "dst").distinct().join(keys, "dst", "left").join(active, "entity", "left").groupBy(F.col("src").alias("k")).agg(F.count(F.lit(1)).alias("o"), F.count("act").alias("na"))
    x = n.where((F.col("modified") < F.lit(AS_OF).cast("timestamp_ntz") - F.expr("interval 30 days")) & ~is_periodic() & (F.col("top") != "templates")).withColumn("t", F.lower("title"))
    x = x.join(b, "k", "left").join(o, "k", "left").join(hub, "t", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    days = F.floor(age_days(F.col("modified"), AS_OF))
    ratio = F.coalesce(F.col("na") / F.col("o"), F.lit(0.0))
    task, on = F.when(F.col("open_task"), 20).otherwise(0), F.when(F.col("active"), 15).otherwise(0)
    importance = F.least(z("b") / 10, F.lit(1.0)) * 30 + F.least(z("h") / 20, F.lit(1.0)) * 20 + F.least(z("o") / 5, F.lit(1.0)) * 15 + task + on
    risk = F.least(days / 180, F.lit(1.0)) * 40 + (1 - ratio) * 30 + task + F.when(F.col("active") & (days > 30), 10).otherwise(0)
    advice = F.when((importance < 20) & (days > 180) & ~F.col("open_task"), "archive").when((importance >= 50) & (ratio > 0), "update").when(F.col("open_task") | F.col("active"), "review").otherwise("low_priority")
    return x.select("k", days.alias("days_stale"), half_up(importance, 1).alias("importance"), half_up(risk, 1).alias("risk"), advice.alias("advice"))


#: Forms of the names of periodic notes and the folders they are usually in (fixed values).
PERIODS = {"daily": (r"^\d{4}-\d{2}-\d{2}$", ["daily", "daily-notes", "journal"]), "weekly": (r"^\d{4}-w\d{2}$", ["weekly", "weekly-notes"]), "monthly": (r"^\d{4}-\d{2}$", ["monthly", "monthly-notes"]), "quarterly": (r"^\d{4}-q[1-4]$", ["quarterly"]), "yearly": (r"^\d{4}$", ["yearly"])}
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(stem, '{p}') THEN '{k}'" for k, (p, _) in PERIODS.items()) + " END"
_USUAL = "CASE kind " + " ".join(f"WHEN '{k}' THEN last IN ({', '.join(map(repr, f))})" for k, (_, f) in PERIODS.items()) + " END"


@add(
    f"""WITH p AS (SELECT DISTINCT regexp_replace(lower(trim(path)), '\\.md$', '') AS k, max(ts) OVER (PARTITION BY regexp_replace(lower(trim(path)), '\\.md$', '')) AS at_ FROM file_events WHERE path IS NOT NULL UNION SELECT k, modified FROM notes), u AS (SELECT k, max(at_) AS at_ FROM p GROUP BY 1),
q AS (SELECT k, at_, regexp_extract(k, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(k, '[^/]*$') AS stem FROM u), al AS (SELECT folder, count(*) AS n FROM q GROUP BY 1), m AS (SELECT folder, {_KIND} AS kind, at_ FROM q),
g AS (SELECT folder, kind, count(*) AS n, count(*) FILTER (WHERE at_ >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS fresh, regexp_extract(folder, '[^/]*$') AS last FROM m WHERE kind IS NOT NULL GROUP BY 1, 2)
SELECT g.folder, kind, g.n, fresh, round(0.4 * least(g.n / 30.0, 1) + 0.3 * least(fresh / 7.0, 1) + CASE WHEN {_USUAL} THEN 0.2 ELSE 0 END + 0.1 * (g.n * 1.0 / al.n), 6) AS score FROM g JOIN al ON al.folder = g.folder"""
)
def agg_periodic_folders(spark, d):
    """How likely each folder holds the vault's daily, weekly, monthly, quarterly or yearly notes: by their number, their recency, the folder's name and the share of its notes. Paths of the change log count too."""
    logged = table(spark, d, "file_events").where("path is not null").groupBy(link_key("path").alias("k")).agg(F.max("ts").alias("at"))
    u = logged.unionByName(V.notes(spark, d).select("k", F.col("modified").alias("at"))).groupBy("k").agg(F.max("at").alias("at"))
    stem = F.element_at(F.split("k", "/"), -1)
    q = u.select(folder_of(F.col("k")).alias("folder"), "at", F.coalesce(*[F.when(stem.rlike(p), F.lit(k)) for k, (p, _) in PERIODS.items()]).alias("kind"))
    g = q.groupBy("folder", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("at") >= F.lit(AS_OF).cast("timestamp_ntz") - F.expr("interval 30 days")).alias("fresh"))
    all_ = g.groupBy("folder").agg(F.sum("n").alias("all_n"))
    last = F.element_at(F.split("folder", "/"), -1)
    usual = F.lit(False)
    for k, (_, folders) in PERIODS.items():
        usual = usual | ((F.col("kind") == k) & last.isin(*folders))
    score = 0.4 * F.least(F.col("n") / 30, F.lit(1.0)) + 0.3 * F.least(F.col("fresh") / 7, F.lit(1.0)) + F.when(usual, 0.2).otherwise(0.0) + 0.1 * (F.col("n") / F.col("all_n"))
    return g.where("kind is not null").join(all_, "folder").select("folder", "kind", "n", "fresh", F.round(score, 6).alias("score"))


@add(
    """WITH w AS (SELECT k, ' ' || array_to_string(regexp_extract_all(lower(coalesce(content, '')), '[\\p{L}\\p{N}]+'), ' ') || ' ' AS t FROM notes), e AS (SELECT id, array_to_string(regexp_extract_all(lower(name), '[\\p{L}\\p{N}]+'), ' ') AS t FROM ents WHERE name IS NOT NULL),
n AS (SELECT e.id, count(*) AS mentions FROM e JOIN w ON contains(w.t, ' ' || e.t || ' ') WHERE e.t <> '' GROUP BY 1), l AS (SELECT entity AS id, count(DISTINCT note) AS linked FROM men GROUP BY 1)
SELECT n.id, mentions, coalesce(linked, 0) AS linked, greatest(0, mentions - coalesce(linked, 0) - 1) AS unlinked FROM n LEFT JOIN l ON l.id = n.id"""
)
def agg_unlinked_mentions(spark, d):
    """Notes that hold each entity's name, those that link to it, and how many mention it without a link. Names meet texts on their rarest word and are then looked for word by word in a row."""
    from wherry.operators.association import word_hits
    from wherry.operators.search import words

    e = V.entities(spark, d).where("name is not null").select("id", words(F.col("name")).alias("ws")).where("size(ws) > 0").withColumn("w", F.array_distinct("ws"))
    n = V.notes(spark, d, ws=words(F.col("content"))).select("k", "ws")
    n = n.withColumn("words", F.array_distinct("ws"))
    met = word_hits(n.select("k", "words"), "k", e.select("id", F.lit(0).alias("p"), "w", F.size("w").alias("least"))).select("k", "id")
    in_row = F.contains(F.concat(F.lit(" "), F.array_join("text", " "), F.lit(" ")), F.concat(F.lit(" "), F.array_join("ws", " "), F.lit(" ")))
    m = met.join(e.select("id", "ws"), "id").join(n.select("k", F.col("ws").alias("text")), "k").where(in_row).groupBy("id").agg(F.count(F.lit(1)).alias("mentions"))
    linked = mentions(spark, d).groupBy(F.col("entity").alias("id")).agg(F.countDistinct("note").alias("linked"))
    x = m.join(linked, "id", "left").withColumn("linked", F.coalesce("linked", F.lit(0)))
    return x.withColumn("unlinked", F.greatest(F.lit(0), F.col("mentions") - F.col("linked") - 1))


_SECTIONS = """sec AS (
SELECT 1 AS prio, session AS item, session AS text, ended AS ord FROM (SELECT user_id::VARCHAR AS session, epoch_us(max(ts)) AS ended FROM events GROUP BY 1)
UNION ALL SELECT 2, CAST(id AS VARCHAR), name, at_ FROM (SELECT e.id, any_value(e.name) AS name, epoch_us(max(n.modified)) AS at_ FROM men JOIN ents e ON e.id = men.entity JOIN notes n ON n.k = men.note WHERE e.name IS NOT NULL GROUP BY 1)
UNION ALL SELECT 3, CAST(id AS VARCHAR), value, epoch_us(updated) FROM (SELECT *, row_number() OVER (PARTITION BY key, owner ORDER BY updated DESC, id DESC) AS rn FROM (SELECT DISTINCT sighting_id AS id, lower(trim(term)) AS key, coalesce(display_name, term) AS value, pattern AS owner, last_seen_at AS updated FROM prospect_ledger WHERE trim(term) <> '')) WHERE rn = 1
UNION ALL SELECT 4, CAST(summary_id AS VARCHAR), term, epoch_us(updated_at) FROM (SELECT DISTINCT summary_id, term, updated_at FROM prospect_summary WHERE status = 'dismissed' AND trim(term) <> '')
UNION ALL SELECT 5, k, title, epoch_us(modified) FROM notes
UNION ALL SELECT 6, dst, dst, n * 1000 FROM (SELECT dst, count(*) AS n FROM res WHERE target_k IS NULL AND dst <> '' GROUP BY 1))"""


@add(f"""WITH {_SECTIONS}, r AS (SELECT prio, item, greatest(1, CAST(ceil(len(text) / 4.0) AS BIGINT)) AS tokens, row_number() OVER (PARTITION BY prio ORDER BY ord DESC, item) AS rank FROM sec WHERE ord IS NOT NULL),
t AS (SELECT * FROM r WHERE rank <= 10), u AS (SELECT *, CAST(sum(tokens) OVER (ORDER BY prio, rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM t) SELECT prio, rank, item, used FROM u WHERE used <= 300""")
def agg_brief(spark, d):
    """A brief of six sections in order: recent sessions, active entities, current memories, corrections, newest notes, dead targets. Ten items each, packed into 300 estimated tokens; the last section may be cut."""
    n, r, _ = base(spark, d)
    e = V.entities(spark, d).where("name is not null").select("id", "name")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    s1 = table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("item")).agg(F.max("ts").alias("at")).select(F.lit(1).alias("prio"), "item", F.col("item").alias("text"), us("at").alias("ord"))
    s2 = mentions(spark, d).join(n.select(F.col("k").alias("note"), "modified"), "note").groupBy(F.col("entity").alias("id")).agg(F.max("modified").alias("at")).join(e, "id").select(F.lit(2).alias("prio"), F.col("id").cast("string").alias("item"), F.col("name").alias("text"), us("at").alias("ord"))
    s3 = MEM.current(MP.memories(spark, d)).select(F.lit(3).alias("prio"), F.col("id").cast("string").alias("item"), F.col("value").alias("text"), us("updated").alias("ord"))
    s4 = table(spark, d, "prospect_summary").where("status = 'dismissed' and trim(term) <> ''").select("summary_id", "term", "updated_at").distinct().select(F.lit(4).alias("prio"), F.col("summary_id").cast("string").alias("item"), F.col("term").alias("text"), us("updated_at").alias("ord"))
    s5 = n.select(F.lit(5).alias("prio"), F.col("k").alias("item"), F.col("title").alias("text"), us("modified").alias("ord"))
    s6 = r.where(F.col("to").isNull() & (F.col("dst") != "")).groupBy("dst").agg(F.count(F.lit(1)).alias("n")).select(F.lit(6).alias("prio"), F.col("dst").alias("item"), F.col("dst").alias("text"), (F.col("n") * 1000).alias("ord"))
    both = s1
    for s in (s2, s3, s4, s5, s6):
        both = both.unionByName(s)
    top = both.where("ord is not null").withColumn("rank", F.row_number().over(Window.partitionBy("prio").orderBy(F.desc("ord"), "item"))).where("rank <= 10")
    tokens = F.greatest(F.lit(1), F.ceil(F.length("text") / 4)).cast("long")
    used = F.sum(tokens).over(Window.orderBy("prio", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # at most 60 rows
    return top.select("prio", "rank", "item", used.alias("used")).where("used <= 300")


@add(
    f"""WITH nn AS (SELECT count(*) AS n FROM notes), ne AS (SELECT count(*) AS n FROM ents), v AS (SELECT count(DISTINCT regexp_replace(lower(trim(path)), '\\.md$', '')) AS n FROM note_embeddings WHERE path IS NOT NULL), w AS (SELECT count(DISTINCT entity_name) AS n FROM entity_embeddings),
dl AS (SELECT count(*) FILTER (WHERE target_k IS NULL) AS dead, count(*) AS n FROM res), orp AS (SELECT count(*) AS n FROM notes WHERE k NOT IN (SELECT target_k FROM res WHERE target_k IS NOT NULL)), last_ AS (SELECT max(ts) AS t FROM file_events), cache AS (SELECT max(built_at) AS t FROM vault_index_cache)
SELECT 'notes' AS name, CASE WHEN nn.n > 0 THEN 'ok' ELSE 'error' END AS status, CAST(nn.n AS DOUBLE) AS value FROM nn UNION ALL SELECT 'note_vectors', CASE WHEN v.n * 2 < nn.n THEN 'warning' ELSE 'ok' END, round(v.n * 1.0 / nn.n, 4) FROM v, nn UNION ALL SELECT 'entity_vectors', CASE WHEN w.n * 2 < ne.n THEN 'warning' ELSE 'ok' END, round(w.n * 1.0 / ne.n, 4) FROM w, ne
UNION ALL SELECT 'dead_links', CASE WHEN dead * 5 > dl.n THEN 'warning' ELSE 'ok' END, round(dead * 1.0 / dl.n, 4) FROM dl UNION ALL SELECT 'orphans', CASE WHEN orp.n * 2 > nn.n THEN 'warning' ELSE 'ok' END, round(orp.n * 1.0 / nn.n, 4) FROM orp, nn
UNION ALL SELECT 'log_age_days', CASE WHEN t < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY THEN 'warning' ELSE 'ok' END, round((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(t)) / 86400000000.0, 4) FROM last_ UNION ALL SELECT 'cache_age_days', CASE WHEN t < TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY THEN 'warning' ELSE 'ok' END, round((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(t)) / 86400000000.0, 4) FROM cache"""
)
def agg_health_checks(spark, d):
    """Named checks of the vault with their status and figure: notes, vectors, dead links, orphans, age of log and cache."""
    n, r, _ = base(spark, d)
    one = lambda df, **k: df.agg(*[v.alias(c) for c, v in k.items()])  # noqa: E731  one row each
    c = F.count(F.lit(1))
    x = one(n, nn=c).crossJoin(one(V.entities(spark, d), ne=c)).crossJoin(one(table(spark, d, "note_embeddings").where("path is not null"), v=F.countDistinct(link_key("path")))).crossJoin(one(table(spark, d, "entity_embeddings"), w=F.countDistinct("entity_name")))
    x = x.crossJoin(one(r, dead=F.count_if(F.col("to").isNull()), links=c)).crossJoin(one(n.join(r.select(F.col("to").alias("k")), "k", "left_anti"), orphans=c)).crossJoin(one(table(spark, d, "file_events"), log=F.max("ts"))).crossJoin(one(table(spark, d, "vault_index_cache"), cache=F.max("built_at")))
    warn = lambda cond: F.when(cond, "warning").otherwise("ok")
    age = lambda col: age_days(F.col(col), AS_OF)
    rows = [
        ("notes", F.when(F.col("nn") > 0, "ok").otherwise("error"), F.col("nn").cast("double")),
        ("note_vectors", warn(F.col("v") * 2 < F.col("nn")), F.round(F.try_divide("v", "nn"), 4)),
        ("entity_vectors", warn(F.col("w") * 2 < F.col("ne")), F.round(F.try_divide("w", "ne"), 4)),
        ("dead_links", warn(F.col("dead") * 5 > F.col("links")), F.round(F.try_divide("dead", "links"), 4)),
        ("orphans", warn(F.col("orphans") * 2 > F.col("nn")), F.round(F.try_divide("orphans", "nn"), 4)),
        ("log_age_days", warn(age("log") > 7), F.round(age("log"), 4)),
        ("cache_age_days", warn(age("cache") > 1), F.round(age("cache"), 4)),
    ]
    return x.select(F.explode(F.array(*[F.struct(F.lit(a).alias("name"), s.alias("status"), v.cast("double").alias("value")) for a, s, v in rows])).alias("x")).select("x.*")


@add("""WITH m AS (SELECT CAST(date_trunc('month', coalesce(created, modified)) AS DATE) AS month, count(*) AS n FROM notes WHERE coalesce(created, modified) IS NOT NULL GROUP BY 1), l AS (SELECT CAST(date_trunc('month', wt) AS DATE) AS month, count(*) AS n FROM links WHERE wt IS NOT NULL GROUP BY 1), u AS (SELECT month FROM m UNION SELECT month FROM l)
SELECT u.month, coalesce(m.n, 0) AS n_notes, coalesce(l.n, 0) AS n_links, CAST(sum(coalesce(m.n, 0)) OVER (ORDER BY u.month) AS BIGINT) AS notes_so_far, CAST(sum(coalesce(l.n, 0)) OVER (ORDER BY u.month) AS BIGINT) AS links_so_far, coalesce(m.n, 0) - lag(coalesce(m.n, 0)) OVER (ORDER BY u.month) AS note_trend FROM u LEFT JOIN m ON m.month = u.month LEFT JOIN l ON l.month = u.month""")
def agg_growth(spark, d):
    """Notes and links by month, their running totals, and the change from the month before."""
    at = F.coalesce("created", "modified")
    m = V.notes(spark, d).where(at.isNotNull()).groupBy(F.to_date(F.date_trunc("month", at)).alias("month")).agg(F.count(F.lit(1)).alias("n_notes"))
    k = V.links(spark, d).where("at is not null").groupBy(F.to_date(F.date_trunc("month", "at")).alias("month")).agg(F.count(F.lit(1)).alias("n_links"))
    x = m.join(k, "month", "full_outer").select("month", F.coalesce("n_notes", F.lit(0)).alias("n_notes"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    w = Window.orderBy("month")  # one row a month
    return x.select("month", "n_notes", "n_links", F.sum("n_notes").over(w).alias("notes_so_far"), F.sum("n_links").over(w).alias("links_so_far"), (F.col("n_notes") - F.lag("n_notes").over(w)).alias("note_trend"))


@add(f"""WITH r AS (SELECT o_orderpriority AS name, CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS mean FROM orders GROUP BY 1, 2), w AS (SELECT name, day, mean, first_value(mean) OVER (PARTITION BY name ORDER BY day) AS first, last_value(mean) OVER (PARTITION BY name ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last, row_number() OVER (PARTITION BY name ORDER BY day DESC) AS rn FROM r)
SELECT name, day, round(mean, 4) AS mean, round((last - first) / first, 6) AS trend FROM w WHERE rn <= 30""", common=False)
def agg_benchmark_history(spark, d):
    """The last 30 runs of each benchmark with the change from its first to its last (order priorities stand for benchmarks, their mean price for the time)."""
    r = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("name"), F.to_date("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("mean"))
    ends = r.groupBy("name").agg(F.min_by("mean", "day").alias("first"), F.max_by("mean", "day").alias("last"))
    x = r.withColumn("rn", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("day")))).where("rn <= 30").join(ends, "name")
    return x.select("name", "day", F.round("mean", 4).alias("mean"), F.round((F.col("last") - F.col("first")) / F.col("first"), 6).alias("trend"))


@add("WITH t AS (SELECT event_type AS tool, count(*) AS n, count(*) FILTER (WHERE value < 20) AS wrong FROM events GROUP BY 1) SELECT tool, n, wrong, round(wrong * 1.0 / n, 6) AS wrong_rate, round((n - wrong + 4.0) / (n + 5.0), 6) AS posterior FROM t WHERE wrong > 0 ORDER BY wrong_rate DESC, tool LIMIT 10", common=False)
def agg_tool_selection(spark, d):
    """The ten tools chosen wrongly most often, with the posterior of their being right (calls of low value stand for wrong choices)."""
    t = table(spark, d, "events").groupBy(F.col("event_type").alias("tool")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") < 20).alias("wrong"))
    return t.where("wrong > 0").select("tool", "n", "wrong", F.round(F.col("wrong") / F.col("n"), 6).alias("wrong_rate"), F.round((F.col("n") - F.col("wrong") + 4.0) / (F.col("n") + 5.0), 6).alias("posterior")).orderBy(F.desc("wrong_rate"), "tool").limit(10)


# ---- projections ------------------------------------------------------------------------------------------------------------

_PAGE = "page AS (SELECT k FROM notes ORDER BY modified DESC, k LIMIT 20)"


@add(f"""WITH {_PAGE}, o AS (SELECT src AS k, target_k AS other, row_number() OVER (PARTITION BY src ORDER BY max(weight) DESC, target_k) AS rn FROM res WHERE target_k IS NOT NULL AND src IN (SELECT k FROM page) GROUP BY src, target_k), b AS (SELECT target_k AS k, src AS other, row_number() OVER (PARTITION BY target_k ORDER BY max(weight) DESC, src) AS rn FROM res WHERE target_k IN (SELECT k FROM page) GROUP BY target_k, src)
SELECT p.k, n.title, n.modified, coalesce((SELECT list(other ORDER BY rn) FROM o WHERE o.k = p.k AND rn <= 3), []) AS links, coalesce((SELECT list(other ORDER BY rn) FROM b WHERE b.k = p.k AND rn <= 3), []) AS backlinks, (SELECT count(*) FROM o WHERE o.k = p.k) AS n_links, (SELECT count(*) FROM b WHERE b.k = p.k) AS n_backlinks FROM page p JOIN notes n ON n.k = p.k""")
def result_full(spark, d):
    """A page of results in full: the heaviest three links each way, and their numbers. Light and compact results are columns of this one."""
    n, r, _ = base(spark, d)
    page = n.select("k", "title", "modified").orderBy(F.desc("modified"), "k").limit(20)
    both = lambda a, b: r.where(F.col("to").isNotNull()).select(F.col(a).alias("k"), F.col(b).alias("other"), "weight").join(F.broadcast(page.select("k")), "k").groupBy("k", "other").agg(F.max("weight").alias("w"))  # noqa: E731  a page of 20

    def first(x, name):
        w = Window.partitionBy("k").orderBy(F.desc("w"), "other")
        y = x.withColumn("rn", F.row_number().over(w))
        lists = y.groupBy("k").agg(F.array_sort(F.collect_list(F.when(F.col("rn") <= 3, F.struct("rn", "other")))).alias("x"), F.count(F.lit(1)).alias(f"n_{name}"))
        return lists.select("k", F.transform("x", lambda s: s["other"]).alias(name), f"n_{name}")

    j = page.join(first(both("src", "to"), "links"), "k", "left").join(first(both("to", "src"), "backlinks"), "k", "left")
    none = F.array().cast("array<string>")
    return j.select("k", "title", "modified", F.coalesce("links", none).alias("links"), F.coalesce("backlinks", none).alias("backlinks"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_backlinks", F.lit(0)).alias("n_backlinks"))


@add("SELECT e.id, e.name, e.category, len(e.aliases) AS n_aliases, n.k AS note, coalesce(b.n, 0) AS n_backlinks, coalesce(m.n, 0) AS n_mentions FROM ents e LEFT JOIN notes n ON n.k = regexp_replace(lower(trim(e.path)), '\\.md$', '') LEFT JOIN (SELECT target_k AS k, count(DISTINCT src) AS n FROM res WHERE target_k IS NOT NULL GROUP BY 1) b ON b.k = n.k LEFT JOIN (SELECT entity, count(*) AS n FROM men GROUP BY 1) m ON m.entity = e.id")
def result_entities(spark, d):
    """Every entity as a result: its note if it has one, backlinks and mentions."""
    n, r, _ = base(spark, d)
    b = r.where(F.col("to").isNotNull()).groupBy(F.col("to").alias("k")).agg(F.countDistinct("src").alias("b"))
    m = mentions(spark, d).groupBy(F.col("entity").alias("id")).agg(F.count(F.lit(1)).alias("m"))
    e = V.entities(spark, d).select("id", "name", "category", F.size("aliases").cast("long").alias("n_aliases"), link_key("path").alias("k"))
    x = e.join(n.select("k", F.col("k").alias("note")), "k", "left").join(b.withColumnRenamed("k", "note"), "note", "left").join(m, "id", "left")
    return x.select("id", "name", "category", "n_aliases", "note", F.coalesce("b", F.lit(0)).alias("n_backlinks"), F.coalesce("m", F.lit(0)).alias("n_mentions"))


# ---- frontmatter out of prose -----------------------------------------------------------------------------------------------

_KV = "^[ \\t]*(?:[-*+] )?\\*{0,2}([A-Za-z][A-Za-z ]{1,30}?)\\*{0,2}:[ \\t]+(.+?)[ \\t]*$"


@add(DOC_SQL + f"""SELECT doc_id, field, list_sort(list(DISTINCT value)) AS found, min(line_no) AS first_line, CASE WHEN bool_or(link) THEN 0.9 ELSE 0.7 END AS confidence FROM (SELECT doc_id, line_no, replace(lower(trim(regexp_extract(line, '{_KV}', 1))), ' ', '_') AS field, regexp_extract(line, '{_KV}', 2) AS value, regexp_matches(regexp_extract(line, '{_KV}', 2), '^\\[\\[.*\\]\\]$') AS link FROM lines WHERE regexp_matches(line, '{_KV}')) x
WHERE NOT EXISTS (SELECT 1 FROM fields f WHERE f.doc_id = x.doc_id AND replace(f.field, ' ', '_') = x.field) GROUP BY 1, 2""", common=False)
def schema_from_prose(spark, d):
    """Fields that the prose of a document gives as ``Key: value`` and its frontmatter lacks; surer where the value is a link."""
    m = lines(spark, d).where(F.col("line").rlike(_KV)).select("doc_id", "line_no", F.replace(F.lower(F.trim(F.regexp_extract("line", _KV, 1))), F.lit(" "), F.lit("_")).alias("field"), F.regexp_extract("line", _KV, 2).alias("value"))
    have = M.fields(docs(spark, d, "text"), "doc_id", F.col("text")).select("doc_id", F.replace("field", F.lit(" "), F.lit("_")).alias("field")).distinct()
    g = m.join(have, ["doc_id", "field"], "left_anti").groupBy("doc_id", "field").agg(F.array_sort(F.collect_set("value")).alias("found"), F.min("line_no").alias("first_line"), F.max(F.col("value").rlike(r"^\[\[.*\]\]$")).alias("link"))
    return g.select("doc_id", "field", "found", "first_line", F.when(F.col("link"), 0.9).otherwise(0.7).alias("confidence"))


@add(DOC_SQL + """, ek AS (SELECT key, min(name) AS name FROM (SELECT lower(name) AS key, name FROM (SELECT DISTINCT name FROM entities WHERE name IS NOT NULL)) GROUP BY 1), fv AS (SELECT DISTINCT doc_id, field, trim(regexp_replace(trim(v), '^["'']+|["'']+$', '', 'g')) AS value FROM (SELECT doc_id, field, unnest(string_split(regexp_replace(value, '^\\[|\\]$', '', 'g'), ',')) AS v FROM fields WHERE kind IN ('string', 'array')))
SELECT doc_id, field, value, '[[' || ek.name || ']]' AS suggestion FROM fv JOIN ek ON ek.key = lower(value)""", common=False)
def schema_link_values(spark, d):
    """Frontmatter values that are an entity's name and should be a link."""
    f = M.fields(docs(spark, d, "text"), "doc_id", F.col("text")).where(F.col("kind").isin("string", "array"))
    v = F.trim(F.regexp_replace(F.trim("v"), "^[\"']+|[\"']+$", ""))
    f = f.select("doc_id", "field", F.explode(F.split(F.regexp_replace("value", r"^\[|\]$", ""), ",")).alias("v")).select("doc_id", "field", v.alias("value")).distinct()
    e = V.entities(spark, d).where("name is not null").groupBy(F.lower("name").alias("key")).agg(F.min("name").alias("name"))
    return f.withColumn("key", F.lower("value")).join(e, "key").select("doc_id", "field", "value", F.concat(F.lit("[["), "name", F.lit("]]")).alias("suggestion"))


QUERIES, SQL = book.queries, book.sql
