"""Feedback learning, prospects, link suggestion and agent memory.

The vault's own tables stand for the feedback logs: a link with a weight of 0.5 or more is a confirmed suggestion, one below a rejected one,
its weight the confidence and its time the time of the feedback. Prospect sightings stand for keyed memories: the term is the key.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wherry.functions.exprs import age_days, beta_mean, edge_boost, half_life, half_up, hub_boost, top_folder
from wherry.operators import vault as V
from wherry.plans.association import mentions
from wherry.plans.book import Book
from wherry.plans.graph import AS_OF, base
from wherry.session import link_key, table

_AGE = f"((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us({{0}})) / 86400000000.0)"
_HALF = "exp(-ln(2) * greatest(" + _AGE + ", 0) / {1})"
book = Book(
    V.VAULT_SQL
    + f""", fb AS (SELECT dst AS entity, src AS note, split_part(src, '/', 1) AS folder, weight >= 0.5 AS ok, weight AS confidence, wt, {_HALF.format('wt', 30)} * weight AS w FROM links WHERE wt IS NOT NULL AND weight IS NOT NULL),
st AS (SELECT entity, count(*) AS n, sum(w) AS total, sum(CASE WHEN ok THEN w ELSE 0 END) AS good, sum(CASE WHEN ok THEN 0 ELSE w END) AS bad FROM fb GROUP BY 1),
pr AS (SELECT DISTINCT * FROM prospect_ledger WHERE trim(term) <> ''),
ps0 AS (SELECT lower(trim(term)) AS term, count(DISTINCT note_path) AS notes_, count(DISTINCT seen_day) AS days_, CAST(sum(sighting_count) AS BIGINT) AS sightings, max(backlink_count) AS backlinks, max(score) AS score, min(first_seen_at) AS first_seen, max(last_seen_at) AS last_seen, max(CASE source WHEN 'high_score' THEN 3 WHEN 'dead_link' THEN 2 ELSE 1 END) AS src_rank FROM pr GROUP BY 1),
pc AS (SELECT term, least(count(DISTINCT l.dst), 10) AS cooc FROM (SELECT DISTINCT lower(trim(term)) AS term, regexp_replace(lower(trim(note_path)), '\\.md$', '') AS src FROM pr WHERE source = 'high_score') h JOIN links l ON l.src = h.src GROUP BY 1),
ps AS (SELECT ps0.*, coalesce(pc.cooc, 0) AS cooc FROM ps0 LEFT JOIN pc ON pc.term = ps0.term)
"""
)
add = book.add


def feedback(spark, d):
    """The feedback log with decayed weights."""
    x = V.links(spark, d).where(F.col("at").isNotNull() & F.col("weight").isNotNull())
    return x.select(F.col("dst").alias("entity"), F.col("src").alias("note"), top_folder(F.col("src")).alias("folder"), (F.col("weight") >= 0.5).alias("ok"), F.col("weight").alias("confidence"), "at", (half_life(F.col("at"), AS_OF, 30.0) * F.col("weight")).alias("w"))


def stats(fb, *keys):
    """Weighted totals of good and bad feedback."""
    return fb.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("total"), F.sum(F.when(F.col("ok"), F.col("w")).otherwise(0.0)).alias("good"), F.sum(F.when(F.col("ok"), 0.0).otherwise(F.col("w"))).alias("bad"))


def suppressed(fb, least: float = 0.45, enough: int = 15):
    """``entity, posterior`` of those below ``least`` with ``enough`` feedbacks."""
    p = beta_mean(F.col("good"), F.col("bad"))
    return stats(fb, "entity").where((p < least) & (F.col("n") >= enough)).select("entity", F.round(p, 6).alias("posterior"))


def prospects(spark, d):
    """One row per folded term."""
    p = table(spark, d, "prospect_ledger").where(F.trim("term") != "").distinct()
    rank = F.when(F.col("source") == "high_score", 3).when(F.col("source") == "dead_link", 2).otherwise(1)
    return p.groupBy(F.lower(F.trim("term")).alias("term")).agg(F.countDistinct("note_path").alias("notes_"), F.countDistinct("seen_day").alias("days_"), F.sum("sighting_count").alias("sightings"), F.max("backlink_count").alias("backlinks"), F.max("score").alias("score"), F.min("first_seen_at").alias("first_seen"), F.max("last_seen_at").alias("last_seen"), F.max(rank).alias("src_rank"))


@add("SELECT entity, count(*) AS n, count(*) FILTER (WHERE ok) AS n_good, count(*) FILTER (WHERE NOT ok) AS n_bad, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM fb GROUP BY 1")
def learn_feedback_counts(spark, d):
    """Feedback by entity."""
    return feedback(spark, d).groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_good"), F.count_if(~F.col("ok")).alias("n_bad"), F.round(F.avg(F.when(F.col("ok"), 1.0).otherwise(0.0)), 6).alias("accuracy"))


@add("SELECT entity, n, round(good, 6) AS good, round(bad, 6) AS bad, round((good + 4) / (good + bad + 5), 6) AS posterior FROM st")
def learn_posteriors(spark, d):
    """Decay-weighted Beta posterior of each entity."""
    return stats(feedback(spark, d), "entity").select("entity", "n", F.round("good", 6).alias("good"), F.round("bad", 6).alias("bad"), F.round(beta_mean(F.col("good"), F.col("bad")), 6).alias("posterior"))


@add("SELECT entity, folder, round((sum(CASE WHEN ok THEN w ELSE 0 END) + 4) / (sum(w) + 5), 6) AS posterior, count(*) AS n FROM fb GROUP BY 1, 2")
def learn_posteriors_by_folder(spark, d):
    """The same by entity and folder."""
    return stats(feedback(spark, d), "entity", "folder").select("entity", "folder", F.round((F.col("good") + 4) / (F.col("total") + 5), 6).alias("posterior"), "n")


@add("SELECT entity, round((good + 4) / (good + bad + 5), 6) AS posterior FROM st WHERE (good + 4) / (good + bad + 5) < 0.45 AND n >= 15")
def learn_suppressed(spark, d):
    """Entities with a low posterior and enough feedback."""
    return suppressed(feedback(spark, d))


@add("SELECT entity, CASE WHEN p < 0.45 THEN CAST(floor(-15 * (1 - p / 0.45) + 0.5) AS BIGINT) WHEN p < 0.55 THEN -5 WHEN acc >= 0.85 AND n >= 5 THEN 10 WHEN acc >= 0.70 AND n >= 3 THEN 6 ELSE 0 END AS boost FROM (SELECT st.entity, n, (good + 4) / (good + bad + 5) AS p, acc FROM st JOIN (SELECT entity, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS acc FROM fb GROUP BY 1) a ON a.entity = st.entity)")
def learn_boost_tiers(spark, d):
    """Penalty or boost of each entity by its posterior, accuracy and feedback."""
    fb = feedback(spark, d)
    acc = fb.groupBy("entity").agg(F.avg(F.when(F.col("ok"), 1.0).otherwise(0.0)).alias("acc"))
    x = stats(fb, "entity").join(acc, "entity").withColumn("p", beta_mean(F.col("good"), F.col("bad")))
    boost = F.when(F.col("p") < 0.45, half_up(-15 * (1 - F.col("p") / 0.45)).cast("long")).when(F.col("p") < 0.55, -5).when((F.col("acc") >= 0.85) & (F.col("n") >= 5), 10).when((F.col("acc") >= 0.7) & (F.col("n") >= 3), 6).otherwise(0)
    return x.select("entity", boost.alias("boost"))


@add("SELECT CAST(wt AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE ok) AS n_good FROM fb GROUP BY 1")
def learn_timeline(spark, d):
    """Feedback by day."""
    return feedback(spark, d).groupBy(F.to_date("at").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_good"))


@add("WITH s AS (SELECT user_id || '-' || CAST(ts AS DATE) AS session, CAST(json_extract_string(props, '$.k') AS BIGINT) AS note FROM events), a AS (SELECT note, count(*) AS reads, count(DISTINCT session) AS sessions FROM s WHERE note IS NOT NULL GROUP BY 1) SELECT note, round(1 + 0.5 * least(sessions, 3) + least(0.5 * sessions, 3) + least(0.2 * reads, 2), 3) AS weight FROM a", common=False)
def learn_edge_weights(spark, d):
    """Edge weight of each note read: 1, its survivals, sessions and reads, each capped."""
    from wherry.plans.usage import events

    s = events(spark, d, "session", "note", "ts").where("note is not null").select("note", F.concat_ws("-", "session", F.to_date("ts")).alias("session"))
    a = s.groupBy("note").agg(F.count(F.lit(1)).alias("reads"), F.countDistinct("session").alias("sessions"))
    return a.select("note", F.round(1 + 0.5 * F.least("sessions", F.lit(3)) + F.least(0.5 * F.col("sessions"), F.lit(3.0)) + F.least(0.2 * F.col("reads"), F.lit(2.0)), 3).alias("weight"))


@add("SELECT term, notes_, days_, sightings, backlinks, round(score, 6) AS score, first_seen, last_seen, CASE src_rank WHEN 3 THEN 'high_score' WHEN 2 THEN 'dead_link' ELSE 'implicit' END AS best_source FROM ps")
def prospect_summaries(spark, d):
    """Summary of each prospect's sightings."""
    s = prospects(spark, d)
    return s.withColumn("best_source", F.when(F.col("src_rank") == 3, "high_score").when(F.col("src_rank") == 2, "dead_link").otherwise("implicit")).withColumn("score", F.round("score", 6)).drop("src_rank")


_PROMO = "(3 * least(notes_, 10) + 2 * least(days_, 10) + 2 * least(coalesce(backlinks, 0), 10) + cooc + 0.5 * least(coalesce(score, 0), 10)) * (0.8 + 0.1 * src_rank)"


@add(f"SELECT term, round({_PROMO}, 6) AS promotion, round({_PROMO} * {_HALF.format('last_seen', 60)}, 6) AS effective, least(6.0, round({_PROMO} * {_HALF.format('last_seen', 60)}, 6) / 10) AS boost FROM ps WHERE round({_PROMO} * {_HALF.format('last_seen', 60)}, 6) > 5")
def prospect_scores(spark, d):
    """Promotion score, its decayed value and the boost it gives."""
    s = prospects(spark, d).join(cooccurring(spark, d).groupBy("term").agg(F.least(F.count(F.lit(1)), F.lit(10)).alias("cooc")), "term", "left")
    promo = (3 * F.least("notes_", F.lit(10)) + 2 * F.least("days_", F.lit(10)) + 2 * F.least(F.coalesce("backlinks", F.lit(0)), F.lit(10)) + F.coalesce("cooc", F.lit(0)) + 0.5 * F.least(F.coalesce("score", F.lit(0.0)), F.lit(10.0))) * (0.8 + 0.1 * F.col("src_rank"))
    s = s.select("term", F.round(promo, 6).alias("promotion"), F.round(promo * half_life(F.col("last_seen"), AS_OF, 60.0), 6).alias("effective")).where("effective > 5")
    return s.withColumn("boost", F.least(F.lit(6.0), F.col("effective") / 10))


@add("SELECT ps.term, notes_ FROM ps WHERE NOT EXISTS (SELECT 1 FROM ents WHERE lower(name) = ps.term) AND NOT EXISTS (SELECT 1 FROM (SELECT lower(unnest(aliases)) AS a FROM ents) x WHERE a = ps.term) AND notes_ >= 2")
def prospect_candidates(spark, d):
    """Prospects in two notes or more that no entity is named after."""
    e = V.entities(spark, d)
    known = e.select(F.lower("name").alias("term")).union(e.select(F.explode("aliases").alias("a")).select(F.lower("a")))
    return prospects(spark, d).where("notes_ >= 2").join(known, "term", "left_anti").select("term", "notes_")


@add("SELECT term, note_path, rn AS rank FROM (SELECT term, note_path, row_number() OVER (PARTITION BY term ORDER BY note_path) AS rn FROM (SELECT DISTINCT lower(trim(term)) AS term, note_path FROM pr)) WHERE rn <= 3")
def prospect_samples(spark, d):
    """Up to three notes of each prospect."""
    p = table(spark, d, "prospect_ledger").where(F.trim("term") != "").select(F.lower(F.trim("term")).alias("term"), "note_path").distinct()
    return p.withColumn("rank", F.row_number().over(Window.partitionBy("term").orderBy("note_path"))).where("rank <= 3")


@add("SELECT DISTINCT ps.term, l.dst AS entity FROM (SELECT DISTINCT lower(trim(term)) AS term, regexp_replace(lower(trim(note_path)), '\\.md$', '') AS src FROM pr WHERE source = 'high_score') ps JOIN links l ON l.src = ps.src")
def prospect_cooccurring(spark, d):
    """Targets of the notes in which high-scored prospects were seen."""
    return cooccurring(spark, d)


def cooccurring(spark, d):
    """``term, entity`` once each."""
    p = table(spark, d, "prospect_ledger").where((F.trim("term") != "") & (F.col("source") == "high_score")).select(F.lower(F.trim("term")).alias("term"), link_key("note_path").alias("src")).distinct()
    return p.join(V.links(spark, d).select("src", F.col("dst").alias("entity")).distinct(), "src").select("term", "entity").distinct()


# ---- link suggestion -----------------------------------------------------------------------------------------------------


@add("""WITH deg0 AS (SELECT target_k AS k, count(DISTINCT src) AS n FROM res WHERE target_k IS NOT NULL GROUP BY 1), wt0 AS (SELECT dst, avg(weight) AS w FROM links GROUP BY 1),
c AS (SELECT e.id, least(floor(log2(n) * 6 + 0.5) / 10, 4.0) AS hub, CASE WHEN coalesce(w, 0) * 3 > 1 THEN least((w * 3 - 1) * 2, 4.0) ELSE 0.0 END AS edge, CASE e.category WHEN 'people' THEN 5 WHEN 'projects' THEN 3 WHEN 'technologies' THEN 2 ELSE 1 END AS kind FROM ents e JOIN enotes en ON en.name = e.name JOIN deg0 ON deg0.k = en.k LEFT JOIN wt0 ON wt0.dst = regexp_replace(lower(trim(e.name)), '\\.md$', ''))
SELECT id, round(hub, 6) AS hub, round(edge, 6) AS edge, kind, round(hub + edge + kind, 6) AS score FROM c""")
def suggest_layers(spark, d):
    """Content-free layers of the suggestion score of each entity: hub, edge and category, each a column that can be left out."""
    n, r, _ = base(spark, d)
    deg = r.where(F.col("to").isNotNull()).groupBy(F.col("to").alias("k")).agg(F.countDistinct("src").alias("n"))
    w = V.links(spark, d).groupBy("dst").agg(F.avg("weight").alias("w"))
    e = V.entities(spark, d).where("path is not null").select("id", "name", "category", link_key("path").alias("k"), link_key("name").alias("dst")).join(n.select("k"), "k", "left_semi")
    e = e.join(deg, "k").join(w, "dst", "left")
    kind = F.when(F.col("category") == "people", 5).when(F.col("category") == "projects", 3).when(F.col("category") == "technologies", 2).otherwise(1)
    x = e.select("id", hub_boost(F.col("n")).alias("hub"), edge_boost(F.coalesce("w", F.lit(0.0)) * 3).alias("edge"), kind.alias("kind"))
    return x.select("id", F.round("hub", 6).alias("hub"), F.round("edge", 6).alias("edge"), "kind", F.round(F.col("hub") + F.col("edge") + F.col("kind"), 6).alias("score"))


def name_hits(docs, entities, share):
    """``doc_id, id, points, ratio``: the best of each entity's name and aliases in each document: 10 for each of its words there, 8 more for all of them. At least ``share`` of the words must be there; names above 25 letters are left out."""
    from wherry.operators.association import word_hits, words_of

    e = entities.where(F.length("name") <= 25).select("id", F.posexplode(F.concat(F.array("name"), "aliases")).alias("p", "a")).select("id", "p", words_of(F.col("a")).alias("w")).where("size(w) > 0")
    # as many words as give the share, by the same division that the share is checked with
    least = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1))), F.lit(0), lambda s, i: F.when((s == 0) & (i / F.greatest(F.size("w"), F.lit(1)) >= share), i).otherwise(s))
    h = word_hits(docs.select("doc_id", words_of(F.col("text")).alias("words")), "doc_id", e.withColumn("least", least))
    h = h.select("doc_id", "id", F.size("found").alias("hit"), F.size("w").alias("n")).withColumn("ratio", F.col("hit") / F.col("n"))
    best = h.groupBy("doc_id", "id").agg(F.max(F.struct((F.col("hit") * 10 + F.when(F.col("hit") == F.col("n"), 8).otherwise(0)).alias("points"), "ratio")).alias("x"))
    return best.select("doc_id", "id", "x.points", "x.ratio")


@add("""WITH dw AS (SELECT doc_id, list_distinct(regexp_extract_all(coalesce(lower(text), ''), '[\\p{L}\\p{N}]+')) AS w FROM documents), dt AS (SELECT doc_id, unnest(w) AS token FROM dw),
en AS (SELECT id, unnest(list_concat([name], aliases)) AS a, unnest(range(len(aliases) + 1)) AS p FROM ents WHERE len(name) <= 25), ew AS (SELECT id, p, list_distinct(regexp_extract_all(lower(a), '[\\p{L}\\p{N}]+')) AS w FROM en WHERE a IS NOT NULL), et AS (SELECT DISTINCT id, p, len(w) AS n, unnest(w) AS token FROM ew),
h AS (SELECT doc_id, id, p, n, count(*) AS hit FROM dt JOIN et USING (token) GROUP BY 1, 2, 3, 4), b AS (SELECT doc_id, id, hit * 10 + CASE WHEN hit = n THEN 8 ELSE 0 END AS score, hit * 1.0 / n AS ratio FROM h WHERE hit * 1.0 / n >= 0.6),
s AS (SELECT doc_id, id, score, ratio FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, id ORDER BY score DESC, ratio DESC) AS rn FROM b) WHERE rn = 1)
SELECT doc_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ratio DESC, id) AS rank FROM s WHERE score >= 10) WHERE rank <= 8""")
def suggest_links(spark, d):
    """Up to eight entities to link from each document: names and aliases matched by words, at least 60 % of them, full ones with a bonus."""
    s = name_hits(table(spark, d, "documents"), V.entities(spark, d), 0.6).withColumnRenamed("points", "score").where("score >= 10")
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), F.desc("ratio"), "id"))).where("rank <= 8").select("doc_id", "id", "score", "rank")


@add("SELECT e.category, count(*) FILTER (WHERE m.entity IS NOT NULL) AS n_mentioned, count(*) AS n_entities FROM ents e LEFT JOIN (SELECT DISTINCT id AS entity FROM (SELECT id, regexp_replace(lower(trim(name)), '\\.md$', '') AS key FROM ents UNION SELECT id, regexp_replace(lower(trim(a)), '\\.md$', '') FROM (SELECT id, unnest(aliases) AS a FROM ents)) k JOIN links ON links.dst = k.key WHERE key <> '' AND id = (SELECT min(id) FROM (SELECT id, regexp_replace(lower(trim(name)), '\\.md$', '') AS key FROM ents UNION SELECT id, regexp_replace(lower(trim(a)), '\\.md$', '') FROM (SELECT id, unnest(aliases) AS a FROM ents)) z WHERE z.key = k.key)) m ON m.entity = e.id GROUP BY 1")
def suggest_coverage(spark, d):
    """Entities with and without a mention, by category."""
    e = V.entities(spark, d).select("id", "category")
    m = mentions(spark, d).select(F.col("entity").alias("id"), F.lit(1).alias("hit")).distinct()
    return e.join(m, "id", "left").groupBy("category").agg(F.count("hit").alias("n_mentioned"), F.count(F.lit(1)).alias("n_entities"))


# ---- memory --------------------------------------------------------------------------------------------------------------


@add("SELECT key, value, updated FROM (SELECT lower(trim(term)) AS key, display_name AS value, last_seen_at AS updated, row_number() OVER (PARTITION BY lower(trim(term)) ORDER BY last_seen_at DESC, sighting_id DESC) AS rn FROM pr) WHERE rn = 1")
def memory_latest(spark, d):
    """The latest value of each key: an upsert by key."""
    p = table(spark, d, "prospect_ledger").where(F.trim("term") != "")
    g = p.groupBy(F.lower(F.trim("term")).alias("key")).agg(F.max(F.struct("last_seen_at", "sighting_id", "display_name")).alias("x"))
    return g.select("key", F.col("x.display_name").alias("value"), F.col("x.last_seen_at").alias("updated"))


@add("SELECT key, value, newer FROM (SELECT lower(trim(term)) AS key, display_name AS value, lead(display_name) OVER (PARTITION BY lower(trim(term)) ORDER BY last_seen_at, sighting_id) AS newer FROM pr) WHERE newer IS NOT NULL AND value <> newer")
def memory_contradictions(spark, d):
    """Values of a key that the next version contradicts."""
    p = table(spark, d, "prospect_ledger").where(F.trim("term") != "").select("sighting_id", F.lower(F.trim("term")).alias("key"), F.col("display_name").alias("value"), "last_seen_at").distinct()
    return p.withColumn("newer", F.lead("value").over(Window.partitionBy("key").orderBy("last_seen_at", "sighting_id"))).where("newer is not null and value <> newer").select("key", "value", "newer")


@add(f"SELECT sighting_id, round(CASE WHEN {_AGE.format('last_seen_at')} > 7 THEN greatest(0.1, least(coalesce(score, 0), 20) / 20 * {_HALF.format('last_seen_at', 30)}) ELSE least(coalesce(score, 0), 20) / 20 END, 6) AS confidence FROM pr")
def memory_decay(spark, d):
    """Confidence after decay: halved in 30 days once idle for a week, never below 0.1."""
    p = table(spark, d, "prospect_ledger").where(F.trim("term") != "").select("sighting_id", "score", "last_seen_at").distinct()
    c = F.least(F.coalesce("score", F.lit(0.0)), F.lit(20.0)) / 20
    return p.select("sighting_id", F.round(F.when(age_days(F.col("last_seen_at"), AS_OF) > 7, F.greatest(F.lit(0.1), c * half_life(F.col("last_seen_at"), AS_OF, 30.0))).otherwise(c), 6).alias("confidence"))


@add(f"SELECT sighting_id FROM pr WHERE {_AGE.format('last_seen_at')} > 30 * sighting_count")
def memory_expired(spark, d):
    """Memories past their time to live."""
    p = table(spark, d, "prospect_ledger").where(F.trim("term") != "").select("sighting_id", "sighting_count", "last_seen_at").distinct()
    return p.where(age_days(F.col("last_seen_at"), AS_OF) > 30 * F.col("sighting_count")).select("sighting_id")


@add("""WITH m AS (SELECT sighting_id, 5 * CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.6 ELSE 0.3 END + CASE source WHEN 'high_score' THEN 3 WHEN 'dead_link' THEN 2 ELSE 1 END AS score, CAST(ceil(len(coalesce(display_name, '')) / 4.0) AS BIGINT) AS tokens, seen_day FROM pr), r AS (SELECT *, row_number() OVER (PARTITION BY seen_day ORDER BY score DESC, sighting_id) AS rank, sum(tokens) OVER (PARTITION BY seen_day ORDER BY score DESC, sighting_id ROWS UNBOUNDED PRECEDING) AS used FROM m)
SELECT seen_day, rank, sighting_id, round(score, 6) AS score, CAST(used AS BIGINT) AS used FROM r WHERE used <= 20""")
def memory_brief(spark, d):
    """The best memories of each day that fit into a budget of tokens."""
    p = table(spark, d, "prospect_ledger").where(F.trim("term") != "").select("sighting_id", "seen_day", "display_name", "confidence", "source").distinct()
    score = 5 * F.when(F.col("confidence") == "high", 1.0).when(F.col("confidence") == "medium", 0.6).otherwise(0.3) + F.when(F.col("source") == "high_score", 3).when(F.col("source") == "dead_link", 2).otherwise(1)
    w = Window.partitionBy("seen_day").orderBy(F.desc("score"), "sighting_id")
    r = p.select("seen_day", "sighting_id", score.alias("score"), F.ceil(F.length(F.coalesce("display_name", F.lit(""))) / 4).cast("long").alias("tokens"))
    r = r.withColumn("rank", F.row_number().over(w)).withColumn("used", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return r.where("used <= 20").select("seen_day", "rank", "sighting_id", F.round("score", 6).alias("score"), "used")


QUERIES, SQL = book.queries, book.sql
