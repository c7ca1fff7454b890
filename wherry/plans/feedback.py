"""The feedback loop: boosts by folder, overrides, aliases, removals, corrections, dashboards and journeys.

Bindings are those of ``plans.learning``: links are the feedback log (a weight of 0.5 or more confirms), their target the entity, the first
folder of their note the folder. A link without a time of change stands for implicit feedback. Sightings are the suggestion log: ``score``
is the total score, ``confidence`` its status, ``source`` its layer.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wherry.functions.exprs import beta_mean, half_up, link_key
from wherry.operators import vault as V
from wherry.plans.book import Book
from wherry.plans.graph import AS_OF
from wherry.plans.learning import book as learn_book
from wherry.plans.learning import feedback, stats
from wherry.session import table

#: Bounds of suppression, and of the penalty (fixed values).
SUPPRESSED, ENOUGH, MILD = 0.45, 15, 0.55
_P = "((good + 4) / (good + bad + 5))"
_PEN = "CASE WHEN {0} < 0.45 THEN floor(-15 * (1 - {0} / 0.45) + 0.5) WHEN {0} < 0.55 THEN -5 ELSE 0 END"
_TIER = "CASE WHEN acc >= 0.85 AND n >= 5 THEN 10 WHEN acc >= 0.70 AND n >= 3 THEN 6 ELSE 0 END"
book = Book(
    learn_book.common
    + """, stf AS (SELECT entity, folder, count(*) AS n, sum(CASE WHEN ok THEN w ELSE 0 END) AS good, sum(CASE WHEN ok THEN 0 ELSE w END) AS bad, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS acc FROM fb GROUP BY 1, 2),
sta AS (SELECT entity, count(*) AS n, sum(CASE WHEN ok THEN w ELSE 0 END) AS good, sum(CASE WHEN ok THEN 0 ELSE w END) AS bad, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS acc FROM fb GROUP BY 1),
sug AS (SELECT DISTINCT sighting_id AS id, lower(trim(term)) AS entity, note_path, source AS layer, confidence AS status, coalesce(score, 0) AS score, last_seen_at AS at_ FROM prospect_ledger WHERE trim(term) <> '')
"""
)
add = book.add


def scored(fb, *keys):
    """Weighted totals with accuracy."""
    acc = fb.groupBy(*keys).agg(F.avg(F.when(F.col("ok"), 1.0).otherwise(0.0)).alias("acc"))
    return stats(fb, *keys).join(acc, list(keys))


def tier(p, acc, n):
    """Penalty of a low posterior, else the boost of a high accuracy."""
    return F.when(p < SUPPRESSED, half_up(-15 * (1 - p / SUPPRESSED)).cast("int")).when(p < MILD, -5).when((acc >= 0.85) & (n >= 5), 10).when((acc >= 0.7) & (n >= 3), 6).otherwise(0)


def suggestions(spark, d):
    """The suggestion log."""
    p = table(spark, d, "prospect_ledger").where(F.trim("term") != "")
    return p.select(F.col("sighting_id").alias("id"), F.lower(F.trim("term")).alias("entity"), "note_path", F.col("source").alias("layer"), F.col("confidence").alias("status"), F.coalesce("score", F.lit(0.0)).alias("score"), F.col("last_seen_at").alias("at")).distinct()


@add(f"""WITH b AS (SELECT f.entity, f.folder, CASE WHEN f.n >= 5 THEN CASE WHEN (f.good + 4) / (f.good + f.bad + 5) < 0.55 THEN {_PEN.format('((f.good + 4) / (f.good + f.bad + 5))')} WHEN f.acc >= 0.85 AND f.n >= 5 THEN 10 WHEN f.acc >= 0.70 THEN 6 ELSE 0 END
ELSE CASE WHEN (a.good + 4) / (a.good + a.bad + 5) < 0.55 THEN {_PEN.format('((a.good + 4) / (a.good + a.bad + 5))')} WHEN a.acc >= 0.85 AND a.n >= 5 THEN 10 WHEN a.acc >= 0.70 AND a.n >= 3 THEN 6 ELSE 0 END END AS boost, f.n >= 5 AS by_folder FROM stf f JOIN sta a ON a.entity = f.entity)
SELECT entity, folder, CAST(boost AS INTEGER) AS boost, by_folder FROM b""")
def learn_boosts_by_folder(spark, d):
    """Boost of each entity in each folder: that of the folder where it has five feedbacks or more, else that of all folders."""
    fb = feedback(spark, d)
    g = scored(fb, "entity").select("entity", tier(beta_mean(F.col("good"), F.col("bad")), F.col("acc"), F.col("n")).alias("of_all"))
    f = scored(fb, "entity", "folder").withColumn("own", tier(beta_mean(F.col("good"), F.col("bad")), F.col("acc"), F.col("n")))
    by = F.col("n") >= 5
    return f.join(g, "entity").select("entity", "folder", F.when(by, F.col("own")).otherwise(F.col("of_all")).cast("int").alias("boost"), by.alias("by_folder"))


_OVER = "SELECT DISTINCT lower(trim(term)) AS entity, status = 'dismissed' AS suppressed FROM prospect_summary WHERE status IN ('dismissed', 'resolved') AND trim(term) <> ''"


@add(f"""WITH ov AS (SELECT entity, max(suppressed) AS suppressed FROM ({_OVER}) GROUP BY 1)
SELECT f.entity, f.folder, CASE WHEN ov.suppressed IS NOT NULL THEN ov.suppressed WHEN (a.good + 4) / (a.good + a.bad + 5) < {SUPPRESSED} AND a.n >= {ENOUGH} THEN TRUE ELSE (f.good + 4) / (f.good + f.bad + 5) < {SUPPRESSED} AND f.n >= 5 END AS suppressed,
CASE WHEN ov.suppressed IS NOT NULL THEN 'override' WHEN (a.good + 4) / (a.good + a.bad + 5) < {SUPPRESSED} AND a.n >= {ENOUGH} THEN 'list' ELSE 'folder' END AS decided_by FROM stf f JOIN sta a ON a.entity = f.entity LEFT JOIN ov ON ov.entity = f.entity""")
def learn_is_suppressed(spark, d):
    """Whether each entity is suppressed in each folder: an override first, then the list, then the folder's own posterior."""
    fb = feedback(spark, d)
    low = beta_mean(F.col("good"), F.col("bad")) < SUPPRESSED
    g = stats(fb, "entity").select("entity", (low & (F.col("n") >= ENOUGH)).alias("listed"))
    f = stats(fb, "entity", "folder").select("entity", "folder", (low & (F.col("n") >= 5)).alias("here"))
    o = table(spark, d, "prospect_summary").where(F.col("status").isin("dismissed", "resolved") & (F.trim("term") != "")).groupBy(F.lower(F.trim("term")).alias("entity")).agg(F.max(F.col("status") == "dismissed").alias("override"))
    x = f.join(g, "entity").join(o, "entity", "left")
    return x.select("entity", "folder", F.when(F.col("override").isNotNull(), F.col("override")).when(F.col("listed"), True).otherwise(F.col("here")).alias("suppressed"), F.when(F.col("override").isNotNull(), "override").when(F.col("listed"), "list").otherwise("folder").alias("decided_by"))


_ALIAS = """al AS (SELECT id, name, regexp_replace(lower(trim(a)), '\\.md$', '') AS term FROM (SELECT id, name, unnest(aliases) AS a FROM ents)),
at_ AS (SELECT id, term, count(*) AS n, sum(CASE WHEN ok THEN w ELSE 0 END) AS good, sum(CASE WHEN ok THEN 0 ELSE w END) AS bad FROM fb JOIN (SELECT DISTINCT id, term FROM al WHERE term <> '') x ON x.term = fb.entity GROUP BY 1, 2)"""


@add(f"WITH {_ALIAS} SELECT id, term, n, round({_P}, 6) AS posterior, CAST({_PEN.format(_P)} AS INTEGER) AS penalty FROM at_")
def learn_alias_penalties(spark, d):
    """Posterior of each alias by its own feedback, and the penalty it gives."""
    return _alias_stats(spark, d).select("id", "term", "n", F.round("p", 6).alias("posterior"), F.when(F.col("p") < SUPPRESSED, half_up(-15 * (1 - F.col("p") / SUPPRESSED)).cast("int")).when(F.col("p") < MILD, -5).otherwise(0).alias("penalty"))


@add(f"WITH {_ALIAS} SELECT id, term FROM at_ WHERE {_P} < {MILD} AND n >= 3")
def learn_suppressed_aliases(spark, d):
    """Aliases of three feedbacks or more and a low posterior."""
    return _alias_stats(spark, d).where((F.col("p") < MILD) & (F.col("n") >= 3)).select("id", "term")


def _alias_stats(spark, d):
    a = V.entities(spark, d).select("id", F.explode("aliases").alias("a")).select("id", link_key("a").alias("term")).where("term <> ''").distinct()
    return stats(feedback(spark, d).withColumnRenamed("entity", "term").join(a, "term"), "id", "term").withColumn("p", beta_mean(F.col("good"), F.col("bad")))


@add("SELECT CASE WHEN wt IS NULL THEN 'implicit' ELSE 'explicit' END AS origin, count(*) AS n, count(*) FILTER (WHERE weight >= 0.5) AS n_good, count(DISTINCT dst) AS n_entities FROM links WHERE weight IS NOT NULL GROUP BY 1")
def learn_sources(spark, d):
    """Feedback by origin, implicit or explicit."""
    x = V.links(spark, d).where("weight is not null")
    return x.groupBy(F.when(F.col("at").isNull(), "implicit").otherwise("explicit").alias("origin")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("weight") >= 0.5).alias("n_good"), F.countDistinct("dst").alias("n_entities"))


_AGE_D = f"((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(wt)) / 86400000000.0)"


@add(
    f"""WITH gone AS (SELECT l.link_id, l.src, l.dst, l.wt FROM links l JOIN (SELECT DISTINCT k, content FROM notes) n ON n.k = l.src WHERE l.wt IS NOT NULL AND NOT contains(lower(coalesce(n.content, '')), '[[' || l.dst))
SELECT src AS note, dst AS entity, max(wt) AS applied, CASE WHEN min({_AGE_D}) < 1 THEN 1.0 WHEN min({_AGE_D}) < 7 THEN 0.85 ELSE 0.7 END AS confidence FROM gone GROUP BY 1, 2"""
)
def learn_removals(spark, d):
    """Links that no longer stand in their note's text: implicit negative feedback, the surer the younger the link was.

    Links are extracted from contents before anything is shuffled; note and target are then matched by key.
    """
    from wherry.functions.exprs import age_days

    here = V.notes(spark, d, refs=F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("content", F.lit(""))), F.lit(r"\[\[([^\[\]\n]*)"), 1)))
    has = here.select(F.col("k").alias("src"), "refs")
    x = V.links(spark, d).where("at is not null").join(has, "src").where(~F.exists("refs", lambda r: F.startswith(r, F.col("dst"))))
    age = F.min(age_days(F.col("at"), AS_OF))
    return x.groupBy(F.col("src").alias("note"), F.col("dst").alias("entity")).agg(F.max("at").alias("applied"), F.when(age < 1, 1.0).when(age < 7, 0.85).otherwise(0.7).alias("confidence"))


@add("WITH c AS (SELECT DISTINCT lower(trim(term)) AS entity, regexp_replace(lower(trim(resolved_entity_path)), '\\.md$', '') AS right_ FROM prospect_summary WHERE status = 'resolved' AND resolved_entity_path IS NOT NULL AND trim(term) <> '') SELECT fb.entity, fb.note, min(c.right_) AS corrected_to, FALSE AS ok, 1.0 AS confidence FROM fb JOIN c ON c.entity = fb.entity GROUP BY 1, 2")
def learn_corrections(spark, d):
    """Resolved terms as corrections: negative feedback for each note that links the term itself, with what it should have been."""
    c = table(spark, d, "prospect_summary").where("status = 'resolved' and resolved_entity_path is not null and trim(term) <> ''").groupBy(F.lower(F.trim("term")).alias("entity")).agg(F.min(link_key("resolved_entity_path")).alias("corrected_to"))
    return feedback(spark, d).select("entity", "note").distinct().join(c, "entity").select("entity", "note", "corrected_to", F.lit(False).alias("ok"), F.lit(1.0).alias("confidence"))


@add("WITH c AS (SELECT DISTINCT lower(trim(term)) AS entity FROM prospect_summary WHERE status IN ('resolved', 'dismissed') AND trim(term) <> '') SELECT id, entity, note_path FROM sug WHERE entity NOT IN (SELECT entity FROM c)")
def learn_uncorrected(spark, d):
    """Suggestions whose entity has no correction: what is left after the exclusion pairs."""
    c = table(spark, d, "prospect_summary").where(F.col("status").isin("resolved", "dismissed") & (F.trim("term") != "")).select(F.lower(F.trim("term")).alias("entity"))
    return suggestions(spark, d).join(c, "entity", "left_anti").select("id", "entity", "note_path")


@add("SELECT entity, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(CASE WHEN status <> 'low' THEN 1.0 ELSE 0.0 END), 6) AS pass_rate FROM sug GROUP BY 1 ORDER BY n DESC, entity LIMIT 10")
def agg_top_suggested(spark, d):
    """The ten entities suggested most, with mean score and the share that passed."""
    return suggestions(spark, d).groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg(F.when(F.col("status") != "low", 1.0).otherwise(0.0)), 6).alias("pass_rate")).orderBy(F.desc("n"), "entity").limit(10)


@add("SELECT status, count(*) AS n, count(DISTINCT entity) AS n_entities FROM sug GROUP BY 1")
def agg_application_status(spark, d):
    """Suggestions by status."""
    return suggestions(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("entity").alias("n_entities"))


@add(f"""WITH t AS (SELECT CASE WHEN {_P} < 0.55 THEN 'penalty' WHEN acc >= 0.85 AND n >= 5 THEN 'champion' WHEN acc >= 0.70 AND n >= 3 THEN 'good' ELSE 'neutral' END AS item, n, acc FROM sta)
SELECT 'tier' AS section, item, count(*) AS n, round(avg(acc), 6) AS value FROM t GROUP BY 2 UNION ALL SELECT 'source', CASE WHEN wt IS NULL THEN 'implicit' ELSE 'explicit' END, count(*), round(avg(CASE WHEN weight >= 0.5 THEN 1.0 ELSE 0.0 END), 6) FROM links WHERE weight IS NOT NULL GROUP BY 2
UNION ALL SELECT 'status', status, count(*), round(avg(score), 6) FROM sug GROUP BY 2 UNION ALL SELECT 'day', CAST(CAST(wt AS DATE) AS VARCHAR), count(*), round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) FROM fb WHERE wt >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND wt < TIMESTAMP '{AS_OF}' GROUP BY 2""")
def agg_feedback_dashboard(spark, d):
    """Feedback by tier, origin, status and day in one long table."""
    fb = feedback(spark, d)
    p = beta_mean(F.col("good"), F.col("bad"))
    t = scored(fb, "entity").select(F.when(p < MILD, "penalty").when((F.col("acc") >= 0.85) & (F.col("n") >= 5), "champion").when((F.col("acc") >= 0.7) & (F.col("n") >= 3), "good").otherwise("neutral").alias("item"), F.col("acc").alias("v"))
    good = F.when(F.col("weight") >= 0.5, 1.0).otherwise(0.0)
    s = V.links(spark, d).where("weight is not null").select(F.when(F.col("at").isNull(), "implicit").otherwise("explicit").alias("item"), good.alias("v"))
    a = suggestions(spark, d).select(F.col("status").alias("item"), F.col("score").alias("v"))
    end = F.lit(AS_OF).cast("timestamp_ntz")
    days = fb.where((F.col("at") >= end - F.expr("interval 30 days")) & (F.col("at") < end)).select(F.to_date("at").cast("string").alias("item"), F.when(F.col("ok"), 1.0).otherwise(0.0).alias("v"))
    parts = [x.select(F.lit(name).alias("section"), "item", "v") for name, x in (("tier", t), ("source", s), ("status", a), ("day", days))]
    both = parts[0]
    for x in parts[1:]:
        both = both.unionByName(x)
    return both.groupBy("section", "item").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("value"))


@add(
    """WITH s AS (SELECT entity, min(at_) AS discovered, count(*) AS n_suggested, max(score) AS best_score FROM sug GROUP BY 1), l AS (SELECT dst AS entity, count(*) AS n_applied, min(wt) AS first_applied FROM links GROUP BY 1),
j AS (SELECT s.*, coalesce(n_applied, 0) AS n_applied, first_applied, st.n AS n_feedback, (st.good + 4) / (st.good + st.bad + 5) AS p FROM s LEFT JOIN l ON l.entity = s.entity LEFT JOIN st ON st.entity = s.entity)
SELECT entity, discovered, n_suggested, round(best_score, 6) AS best_score, n_applied, first_applied, coalesce(n_feedback, 0) AS n_feedback, round(coalesce(p, 0.8), 6) AS posterior, CASE WHEN n_feedback > 0 AND p < 0.55 THEN 'adapt' WHEN n_feedback > 0 THEN 'learn' WHEN n_applied > 0 THEN 'apply' WHEN best_score > 0 THEN 'suggest' ELSE 'discover' END AS stage FROM j"""
)
def agg_entity_journey(spark, d):
    """Each term's way: discovered, suggested, applied, learned from, adapted; with the figures of every step."""
    s = suggestions(spark, d).groupBy("entity").agg(F.min("at").alias("discovered"), F.count(F.lit(1)).alias("n_suggested"), F.max("score").alias("best"))
    a = V.links(spark, d).groupBy(F.col("dst").alias("entity")).agg(F.count(F.lit(1)).alias("n_applied"), F.min("at").alias("first_applied"))
    f = stats(feedback(spark, d), "entity").select("entity", F.col("n").alias("n_feedback"), beta_mean(F.col("good"), F.col("bad")).alias("p"))
    j = s.join(a, "entity", "left").join(f, "entity", "left")
    some = F.coalesce("n_feedback", F.lit(0)) > 0
    stage = F.when(some & (F.col("p") < MILD), "adapt").when(some, "learn").when(F.coalesce("n_applied", F.lit(0)) > 0, "apply").when(F.col("best") > 0, "suggest").otherwise("discover")
    return j.select("entity", "discovered", "n_suggested", F.round("best", 6).alias("best_score"), F.coalesce("n_applied", F.lit(0)).alias("n_applied"), "first_applied", F.coalesce("n_feedback", F.lit(0)).alias("n_feedback"), F.round(F.coalesce("p", F.lit(0.8)), 6).alias("posterior"), stage.alias("stage"))


@add("SELECT entity, CAST(at_ AS DATE) AS day, round(score, 6) AS score, id, note_path FROM (SELECT *, row_number() OVER (PARTITION BY entity, CAST(at_ AS DATE) ORDER BY score DESC, at_ DESC, note_path DESC, id DESC) AS rn FROM sug WHERE at_ IS NOT NULL) WHERE rn = 1")
def agg_score_timeline(spark, d):
    """The best suggestion of each entity and day, ties to the latest."""
    s = suggestions(spark, d).where("at is not null").groupBy("entity", F.to_date("at").alias("day")).agg(F.max(F.struct("score", "at", "note_path", "id")).alias("x"))
    return s.select("entity", "day", F.round("x.score", 6).alias("score"), "x.id", "x.note_path")


@add("SELECT layer, count(*) AS n, round(avg(abs(score)), 3) AS mean_abs, CASE WHEN count(*) FILTER (WHERE score <> 0) = 0 THEN 'zero-data' WHEN avg(abs(score)) < 0.5 THEN 'dormant' ELSE 'contributing' END AS status FROM sug GROUP BY 1")
def agg_layer_health(spark, d):
    """Each layer's mean absolute share and whether it contributes."""
    mean = F.avg(F.abs("score"))
    return suggestions(spark, d).groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.round(mean, 3).alias("mean_abs"), F.when(F.count_if(F.col("score") != 0) == 0, "zero-data").when(mean < 0.5, "dormant").otherwise("contributing").alias("status"))


@add(f"WITH a AS (SELECT src, dst, wt FROM links WHERE wt IS NOT NULL), e AS (SELECT regexp_replace(lower(trim(path)), '\\.md$', '') AS k, max(ts) AS last_edit FROM file_events WHERE type <> 'unlink' AND path IS NOT NULL GROUP BY 1) SELECT CAST(wt AS DATE) AS day, count(*) AS n_applied, count(*) FILTER (WHERE last_edit >= wt + INTERVAL 1 DAY) AS n_edited_later, count(DISTINCT src) AS n_notes FROM a LEFT JOIN e ON e.k = a.src GROUP BY 1")
def agg_linking_survival(spark, d):
    """Links by day of their application, and how many stand in notes that were edited a day later or more."""
    e = table(spark, d, "file_events").where("type <> 'unlink' and path is not null").groupBy(link_key("path").alias("src")).agg(F.max("ts").alias("last_edit"))
    a = V.links(spark, d).where("at is not null").join(e, "src", "left")
    return a.groupBy(F.to_date("at").alias("day")).agg(F.count(F.lit(1)).alias("n_applied"), F.count_if(F.col("last_edit") >= F.col("at") + F.expr("interval 1 day")).alias("n_edited_later"), F.countDistinct("src").alias("n_notes"))


@add(
    f"""WITH q AS (SELECT dst AS entity, src AS note, max(round(weight * 10, 3)) AS score, max(wt) AS queued FROM links WHERE wt IS NOT NULL AND weight * 10 >= 20 GROUP BY 1, 2)
SELECT entity, note, score, queued, queued + INTERVAL 7 DAY AS expires FROM q WHERE queued + INTERVAL 7 DAY >= TIMESTAMP '{AS_OF}' - INTERVAL 200 DAY"""
)
def stream_queue_enqueued(spark, d):
    """The queue after an upsert of all suggestions of 20 points or more: the greatest score and latest time of each note and entity, expired ones left out."""
    q = V.links(spark, d).where("at is not null and weight * 10 >= 20").groupBy(F.col("dst").alias("entity"), F.col("src").alias("note")).agg(F.max(F.round(F.col("weight") * 10, 3)).alias("score"), F.max("at").alias("queued"))
    q = q.withColumn("expires", F.col("queued") + F.expr("interval 7 days"))
    return q.where(F.col("expires") >= F.lit(AS_OF).cast("timestamp_ntz") - F.expr("interval 200 days"))


QUERIES, SQL = book.queries, book.sql
