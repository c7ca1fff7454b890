"""Which entities a note should link to: one wide table of notes by candidate entities with a column for every layer, each of which can be left out.

Candidates share words of a name or alias with the note's text, or go with entities that the note mentions. Nothing pairs all notes with all
entities. Layers: words (with aliases and rarity), stems, kind, context, folder, recency, hub, edge, feedback, prospects, co-occurrence. A
vector layer needs an embedded query text and isn't there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wherry.functions.exprs import STOPWORDS, edge_boost, hub_boost, idf_clamped, link_key, recency_boost, tokens_of
from wherry.operators import association as A
from wherry.operators import search as S
from wherry.operators import vault as V
from wherry.plans import feedback as FB
from wherry.plans import learning
from wherry.plans.association import _STOP, mentions
from wherry.plans.book import Book
from wherry.plans.graph import AS_OF
from wherry.plans.learning import _HALF, _PROMO
from wherry.session import cut

#: Boosts of categories; in contexts; folders that stand for no subject; forms of article titles; limits of names (fixed values).
KIND = {"people": 5, "animals": 3, "projects": 3, "organizations": 2, "events": 2, "media": 2, "health": 2, "vehicles": 2, "locations": 1, "concepts": 1, "documents": 1, "food": 1, "hobbies": 1, "finance": 2, "periodical": 1, "technologies": 0, "acronyms": 0, "other": 0}
CONTEXT = {"daily": {"people": 5, "animals": 3, "events": 3, "projects": 2, "food": 2, "health": 2}, "project": {"projects": 5, "technologies": 2, "documents": 2}, "tech": {"technologies": 5, "acronyms": 3}}
CONTEXT_PATHS = {"daily": ["daily-notes", "daily/", "journal", "logs/", "/log/"], "project": ["projects/", "project/", "systems/", "initiatives/"], "tech": ["tech/", "code/", "engineering/", "docs/", "documentation/"]}
GENERIC = ["daily-notes", "weekly-notes", "clippings", "templates", "new"]
ARTICLE = r"(?i)\bguide\s+to\b|\bhow\s+to\b|\bcomplete\s+|\bultimate\s+|\bchecklist\b|\bcheatsheet\b|\bcheat\s+sheet\b|\bbest\s+practices\b|\bintroduction\s+to\b|\btutorial\b|\bworksheet\b"
LONGEST, MOST_WORDS = 25, 3
#: By strictness: least score, least share of a name's words, bonus of a word, of a stem, least words of relevance, cap without it, gate of co-occurrence (fixed values).
STRICTNESS = {
    "conservative": {"least": 18, "share": 0.6, "exact": 10, "stem": 3, "floor": 5, "cap": 12, "gate": 6},
    "balanced": {"least": 10, "share": 0.6, "exact": 10, "stem": 5, "floor": 5, "cap": 9, "gate": 6},
    "aggressive": {"least": 5, "share": 0.3, "exact": 10, "stem": 6, "floor": 3, "cap": 18, "gate": 3},
}
LAYERS = ("lexical", "stems", "kind", "context", "folder", "recency", "hub", "edge", "feedback", "prospect", "cooc")
EXEMPT = ["people", "animals", "projects", "organizations"]


def context_of(path: Column) -> Column:
    """What kind of note a path stands for; null for none."""
    low = F.lower(path)
    has = lambda ps: F.exists(F.array(*[F.lit(p) for p in ps]), lambda p: F.contains(low, p))
    return F.when(has(CONTEXT_PATHS["daily"]), "daily").when(has(CONTEXT_PATHS["project"]), "project").when(has(CONTEXT_PATHS["tech"]), "tech")


def table_of(values: dict[str, int], key: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))]), key), F.lit(0))


def context_boost(context: Column, category: Column) -> Column:
    """Boost of a category in a context."""
    out = F.lit(0)
    for name, values in CONTEXT.items():
        out = F.when(context == name, table_of(values, category)).otherwise(out)
    return out


def folder_boost(entity: Column, note: Column) -> Column:
    """3 in the same second folder, 2 in the same first one, 0 for an entity of a generic folder, -1 for a note of one, else -3; 0 without a path."""
    e, n = F.split(entity, "/"), F.split(note, "/")
    a, b = F.get(e, F.lit(0)), F.get(n, F.lit(0))
    second = F.coalesce((F.get(e, F.lit(1)) != "") & (F.get(e, F.lit(1)) == F.get(n, F.lit(1))), F.lit(False))
    return F.when(entity.isNull() | note.isNull() | (a == "") | (b == ""), 0).when(a == b, F.when(second, 3).otherwise(2)).when(a.isin(*GENERIC), 0).when(b.isin(*GENERIC), -1).otherwise(-3)


def threshold(length: Column, least: int) -> Column:
    """The least score by the length of the text: less for short ones, a fifth more for long ones."""
    long = F.lit(least) if least <= 5 else F.floor(F.lit(least) * 1.2)
    return F.when(length < 50, F.greatest(F.lit(5), F.floor(F.lit(least) * 0.6))).when(length > 200, long).otherwise(F.lit(least))


def fits(entities: DataFrame) -> DataFrame:
    """Entities that may be suggested: no article titles, no long names."""
    words = F.size(F.filter(F.split("name", r"\s+"), lambda w: w != ""))
    return entities.where(F.col("name").isNotNull() & ~F.col("name").rlike(ARTICLE) & (words <= MOST_WORDS) & (F.length("name") <= LONGEST))


def lexical(notes: DataFrame, entities: DataFrame, c: dict, stems: bool) -> DataFrame:
    """``k, id, lexical, stems``: the best of an entity's name and aliases in each note: ``exact`` for each word there, scaled by its weight, 8 more for a whole alias; ``stem`` for each further word whose stem is there."""
    n_all = notes.agg(F.count(F.lit(1)).alias("total"))
    words = F.array_distinct("tokens")
    names = entities.select("id", F.posexplode(F.concat(F.array("name"), "aliases")).alias("p", "a")).select("id", "p", F.array_distinct(tokens_of(F.col("a"))).alias("w")).where("size(w) > 0")
    if stems:
        # a name's words and their stems side by side; the vocabulary is stemmed once, and texts are matched on stems
        v = S.stem_words(names.select(F.explode("w").alias("word")).union(notes.select(F.explode(words).alias("word"))).distinct())
        v = cut(v)
        ns = names.select("id", "p", F.explode("w").alias("word")).join(v, "word").groupBy("id", "p").agg(F.collect_set("word").alias("w"), F.collect_set("stem").alias("s"))
        ts = notes.select("k", F.explode(words).alias("word")).join(v, "word").groupBy("k").agg(F.collect_set("stem").alias("words"))
        key, plain = "s", notes.select("k", words.alias("plain"))
    else:
        ns, ts, key = names.withColumn("s", F.col("w")), notes.select("k", words.alias("words")), "w"
        plain = None
    share = c["share"]
    least = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size("x"), F.lit(1))), F.lit(0), lambda s, i: F.when((s == 0) & (i / F.greatest(F.size("x"), F.lit(1)) >= share), i).otherwise(s))
    look = ns.select("id", "p", F.col(key).alias("x"), "w").withColumn("least", least)
    hits = A.word_hits(ts, "k", look.select("id", "p", F.col("x").alias("w"), "least"))
    df = notes.select(F.explode(words).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    used = ns.select(F.explode("w").alias("t")).distinct().join(df, "t", "left").crossJoin(F.broadcast(n_all)).select("t", idf_clamped(F.coalesce("df", F.lit(0)), F.col("total"), 0.5, 2.5).alias("idf"))
    weighted = ns.select("id", "p", F.explode("w").alias("t")).join(used, "t").groupBy("id", "p").agg(F.collect_list(F.struct("t", "idf")).alias("ws"))
    # as many names as go to the tasks for the hits take their weights there, and no hit is shuffled for them
    few = names.count() <= A.MOST_NAMES
    h = hits.select("k", "id", "p", "found").join(F.broadcast(weighted) if few else weighted, ["id", "p"])
    if plain is not None:
        h = h.join(plain, "k").withColumn("exact", F.filter("ws", lambda x: F.array_contains("plain", x["t"]))).drop("plain")
        extra = F.size("found") - F.size("exact")
    else:
        h = h.withColumn("exact", F.filter("ws", lambda x: F.array_contains("found", x["t"])))
        extra = F.lit(0)
    total = F.aggregate("exact", F.lit(0.0), lambda s, x: s + x["idf"] * c["exact"])
    full = F.when((F.col("p") > 0) & (F.size("exact") == F.size("ws")), 8.0).otherwise(0.0)
    mean = F.aggregate("ws", F.lit(0.0), lambda s, x: s + x["idf"]) / F.greatest(F.size("ws"), F.lit(1))
    h = h.select("k", "id", F.round(total + full, 6).alias("lexical"), F.round(F.greatest(extra, F.lit(0)) * mean * c["stem"], 6).alias("stems"))
    return h.groupBy("k", "id").agg(F.max(F.struct((F.col("lexical") + F.col("stems")).alias("s"), "lexical", "stems")).alias("x")).select("k", "id", "x.lexical", "x.stems")


def cooc(candidates: DataFrame, mentions_: DataFrame, pairs: DataFrame) -> DataFrame:
    """``k, id, v, seeds``: for candidates ``(k, id)`` the greatest mutual information with what stands in the note and how much of that goes with it."""
    both = pairs.select(F.col("a").alias("seed"), F.col("b").alias("id"), "npmi").unionByName(pairs.select(F.col("b").alias("seed"), F.col("a").alias("id"), "npmi"))
    met = candidates.join(mentions_.withColumnRenamed("id", "seed"), "k").join(both, ["seed", "id"])
    return met.groupBy("k", "id").agg(F.max("npmi").alias("v"), F.count(F.lit(1)).alias("seeds"))


def note_suggestions(spark, d, strictness: str = "balanced", disabled: tuple[str, ...] = ()) -> DataFrame:
    """``k, id``, a column for each layer, ``total``: candidates of every note that pass all gates. A layer named in ``disabled`` counts 0.

    What the note links to already and what is suppressed in its folder are left out; so are single common words that the text doesn't hold as
    the name is written. A total without words in common is capped. Candidates by co-occurrence alone need a strong one from two entities.
    """
    c = STRICTNESS[strictness]
    content = F.coalesce("content", F.lit(""))
    notes = cut(V.notes(spark, d, tokens=tokens_of(content), size=F.length(content)).select(F.col("k").alias("path_key"), "top", "tokens", "size", F.monotonically_increasing_id().alias("k")))
    e = fits(V.entities(spark, d)).select("id", "name", "aliases", "category", link_key("path").alias("path"), link_key("name").alias("entity"), "hub_score")
    m = cut(mentions(spark, d))
    # notes go by number until the end; what stands in no note of the table counts in the statistics alone
    own = cut(m.join(notes.select(F.col("path_key").alias("note"), "k"), "note").select("k", F.col("entity").alias("id")))
    words = cut(lexical(notes.select("k", "tokens"), e, c, "stems" not in disabled).join(own, ["k", "id"], "left_anti"))
    total = m.agg(F.countDistinct("note").alias("total"))
    rarity = m.groupBy(F.col("entity").alias("id")).agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(total)).select("id", idf_clamped(F.col("df"), F.col("total"), 0.7, 1.8).alias("rarity"))
    from wherry.plans.association import npmi_pairs

    pairs = cut(npmi_pairs(m).where("npmi > 0"))
    last = m.join(V.notes(spark, d).select(F.col("k").alias("note"), "modified"), "note").groupBy(F.col("entity").alias("id")).agg(F.max("modified").alias("last"))
    recent = cut(last.select("id", recency_boost(F.col("last"), AS_OF).alias("recency")))
    # only what has words or a pair at the gate can be admitted, so nothing else meets a note's pairs
    strong = A.strong_pairs(pairs, recent.select(F.col("id").alias("entity"), (F.col("recency") > 0).alias("up")), c["gate"])
    gated = own.withColumnRenamed("id", "seed").join(strong.withColumnRenamed("entity", "id"), "seed").select("k", "id").distinct().join(own, ["k", "id"], "left_anti")
    go = cooc(words.select("k", "id").unionByName(gated).distinct(), own, pairs)
    go = go.join(recent, "id", "left").select("k", "id", "seeds", F.least(F.floor(F.col("v") * 12 * F.when(F.coalesce("recency", F.lit(0)) > 0, 1.5).otherwise(0.5) + 0.5), F.lit(12)).alias("cooc")).where("cooc > 0")
    x = words.join(go, ["k", "id"], "full_outer").join(e.drop("aliases"), "id").join(notes.select("k", "path_key", "top", "size"), "k").drop("k").withColumnRenamed("path_key", "k")
    edges = V.links(spark, d).where("weight > 1").groupBy(F.col("dst").alias("entity")).agg(F.avg("weight").alias("mean"))
    fb = FB.learn_boosts_by_folder(spark, d).select("entity", F.col("folder").alias("top"), F.col("boost").alias("feedback"))
    off = FB.learn_is_suppressed(spark, d).where("suppressed").select("entity", F.col("folder").alias("top"))
    pr = learning.prospect_scores(spark, d).where("effective > 5").select(F.col("term").alias("entity"), F.col("boost").alias("prospect"))
    x = x.join(off, ["entity", "top"], "left_anti").join(rarity, "id", "left").join(recent, "id", "left").join(edges, "entity", "left").join(fb, ["entity", "top"], "left").join(pr, "entity", "left")
    z = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    value = {
        "lexical": F.round(z("lexical") * F.coalesce("rarity", F.lit(1.3)), 6),
        "stems": F.round(z("stems") * F.coalesce("rarity", F.lit(1.3)), 6),
        "kind": table_of(KIND, F.col("category")),
        "context": context_boost(context_of(F.col("k")), F.col("category")),
        "folder": folder_boost(F.col("path"), F.col("k")),
        "recency": z("recency"),
        "hub": hub_boost(F.col("hub_score")),
        "edge": F.round(edge_boost(z("mean")), 6),
        "feedback": z("feedback"),
        "prospect": F.round(z("prospect"), 6),
        "cooc": z("cooc"),
    }
    x = x.select("k", "id", "name", "category", "size", F.coalesce("seeds", F.lit(0)).alias("seeds"), *[(F.lit(0.0) if n in disabled else v.cast("double")).alias(n) for n, v in value.items()])
    relevance = F.col("lexical") + F.col("stems")
    raw = F.round(sum((F.col(n) for n in LAYERS), F.lit(0.0)), 6)
    x = x.withColumn("total", F.when(relevance < c["floor"], F.least(raw, F.lit(float(c["cap"])))).otherwise(raw))
    admitted = (relevance > 0) | ((F.col("cooc") >= c["gate"]) & (F.col("seeds") >= 2))
    common = F.lower("name").isin(*STOPWORDS) & ~F.col("category").isin(*EXEMPT)
    return x.where(admitted & ~common & (F.col("total") >= threshold(F.col("size"), c["least"]))).select("k", "id", *LAYERS, "total")


def _case(values: dict[str, int], key: str) -> str:
    return "CASE " + key + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " ELSE 0 END"


def _has(ps: list[str]) -> str:
    return "(" + " OR ".join(f"contains(k, '{p}')" for p in ps) + ")"


_TOK = "list_distinct(list_filter(regexp_extract_all(regexp_replace(lower({0}), '\\[\\[([^\\]|]*\\|)?([^\\]]*)\\]\\]', '\\2', 'g'), '([a-z][a-z0-9]{{2,}})', 1), lambda w: w NOT IN (" + _STOP + ")))"
_PEN = FB._PEN
book = Book(
    FB.book.common
    + f""", ekeys AS (SELECT id, regexp_replace(lower(trim(name)), '\\.md$', '') AS key FROM ents UNION SELECT id, regexp_replace(lower(trim(a)), '\\.md$', '') FROM (SELECT id, unnest(aliases) AS a FROM ents)),
owner AS (SELECT key, min(id) AS id FROM ekeys WHERE key <> '' GROUP BY 1), men AS (SELECT DISTINCT src AS note, id AS entity FROM links JOIN owner ON key = dst), tot AS (SELECT count(DISTINCT note) AS n FROM men), edf AS (SELECT entity, count(*) AS df FROM men GROUP BY 1),
pairs AS (SELECT x.entity AS a, y.entity AS b, count(*) AS n FROM men x JOIN men y ON x.note = y.note AND x.entity < y.entity GROUP BY 1, 2),
np AS (SELECT a, b, round(CASE WHEN p.n * 1.0 / tot.n >= 1 THEN 1.0 ELSE greatest(0.0, least(1.0, ln((p.n * 1.0 / tot.n) / ((x.df * 1.0 / tot.n) * (y.df * 1.0 / tot.n))) / -ln(p.n * 1.0 / tot.n))) END, 6) AS v FROM pairs p JOIN edf x ON x.entity = a JOIN edf y ON y.entity = b, tot WHERE p.n >= 2),
np2 AS (SELECT a AS seed, b AS id, v FROM np WHERE v > 0 UNION ALL SELECT b, a, v FROM np WHERE v > 0),
rec AS (SELECT entity AS id, CASE WHEN max(modified) >= TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR THEN 8 WHEN max(modified) >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR THEN 5 WHEN max(modified) >= TIMESTAMP '{AS_OF}' - INTERVAL 72 HOUR THEN 3 WHEN max(modified) >= TIMESTAMP '{AS_OF}' - INTERVAL 168 HOUR THEN 1 ELSE 0 END AS recency FROM men JOIN notes ON notes.k = men.note GROUP BY 1),
go AS (SELECT k, g.id, seeds, least(floor(v * 12 * CASE WHEN coalesce(rec.recency, 0) > 0 THEN 1.5 ELSE 0.5 END + 0.5), 12) AS cooc FROM (SELECT men.note AS k, np2.id, max(v) AS v, count(*) AS seeds FROM men JOIN np2 ON np2.seed = men.entity GROUP BY 1, 2) g LEFT JOIN rec ON rec.id = g.id),
nt AS (SELECT k, top, len(coalesce(content, '')) AS size, {_TOK.format("coalesce(content, '')")} AS w FROM notes), ntx AS (SELECT k, unnest(w) AS t FROM nt), tdf AS (SELECT t, count(*) AS df FROM ntx GROUP BY 1),
fit AS (SELECT *, regexp_replace(lower(trim(path)), '\\.md$', '') AS ek, regexp_replace(lower(trim(name)), '\\.md$', '') AS entity FROM ents WHERE name IS NOT NULL AND NOT regexp_matches(name, '{ARTICLE}') AND len(list_filter(string_split_regex(name, '\\s+'), lambda x: x <> '')) <= {MOST_WORDS} AND len(name) <= {LONGEST}),
fn AS (SELECT id, unnest(list_concat([name], aliases)) AS a, unnest(range(len(aliases) + 1)) AS p FROM fit), fw AS (SELECT id, p, {_TOK.format('a')} AS w FROM fn WHERE a IS NOT NULL), ft AS (SELECT id, p, len(w) AS n, unnest(w) AS t FROM fw WHERE len(w) > 0),
fi AS (SELECT ft.*, greatest(0.5, least(2.5, ln(((SELECT count(*) FROM notes) + 1.0) / (coalesce(df, 0) + 1)))) AS idf FROM ft LEFT JOIN tdf USING (t)),
hit AS (SELECT k, id, p, n, count(*) AS h, round(sum(idf * 10) + CASE WHEN p > 0 AND count(*) = n THEN 8.0 ELSE 0.0 END, 6) AS s FROM ntx JOIN fi USING (t) GROUP BY 1, 2, 3, 4), lex AS (SELECT k, id, max(s) AS lexical FROM hit WHERE h * 1.0 / n >= 0.6 GROUP BY 1, 2),
wg AS (SELECT dst AS entity, avg(weight) AS mean FROM links WHERE weight > 1 GROUP BY 1),
fbb AS (SELECT f.entity, f.folder, CASE WHEN f.n >= 5 THEN CASE WHEN (f.good + 4) / (f.good + f.bad + 5) < 0.55 THEN {_PEN.format('((f.good + 4) / (f.good + f.bad + 5))')} WHEN f.acc >= 0.85 THEN 10 WHEN f.acc >= 0.70 THEN 6 ELSE 0 END
  ELSE CASE WHEN (a.good + 4) / (a.good + a.bad + 5) < 0.55 THEN {_PEN.format('((a.good + 4) / (a.good + a.bad + 5))')} WHEN a.acc >= 0.85 AND a.n >= 5 THEN 10 WHEN a.acc >= 0.70 AND a.n >= 3 THEN 6 ELSE 0 END END AS feedback FROM stf f JOIN sta a ON a.entity = f.entity),
ov AS (SELECT entity, max(suppressed) AS suppressed FROM ({FB._OVER}) GROUP BY 1), off_ AS (SELECT f.entity, f.folder FROM stf f JOIN sta a ON a.entity = f.entity LEFT JOIN ov ON ov.entity = f.entity WHERE CASE WHEN ov.suppressed IS NOT NULL THEN ov.suppressed WHEN (a.good + 4) / (a.good + a.bad + 5) < 0.45 AND a.n >= 15 THEN TRUE ELSE (f.good + 4) / (f.good + f.bad + 5) < 0.45 AND f.n >= 5 END),
prs AS (SELECT term AS entity, least(6.0, round({_PROMO} * {_HALF.format('last_seen', 60)}, 6) / 10) AS prospect FROM ps WHERE round({_PROMO} * {_HALF.format('last_seen', 60)}, 6) > 5),
cand AS (SELECT coalesce(lex.k, go.k) AS k, coalesce(lex.id, go.id) AS id, lexical, cooc, seeds FROM lex FULL JOIN (SELECT * FROM go WHERE cooc > 0) go ON go.k = lex.k AND go.id = lex.id),
wide AS (SELECT c.k, c.id, f.name, f.category, nt.size, coalesce(c.seeds, 0) AS seeds, round(coalesce(lexical, 0) * CASE WHEN edf.df IS NULL THEN 1.3 ELSE greatest(0.7, least(1.8, ln((tot.n + 1.0) / (edf.df + 1)))) END, 6) AS lexical, {_case(KIND, 'f.category')} AS kind,
  CASE WHEN {_has(CONTEXT_PATHS['daily']).replace('(k,', '(c.k,')} THEN {_case(CONTEXT['daily'], 'f.category')} WHEN {_has(CONTEXT_PATHS['project']).replace('(k,', '(c.k,')} THEN {_case(CONTEXT['project'], 'f.category')} WHEN {_has(CONTEXT_PATHS['tech']).replace('(k,', '(c.k,')} THEN {_case(CONTEXT['tech'], 'f.category')} ELSE 0 END AS context,
  CASE WHEN f.ek IS NULL OR split_part(f.ek, '/', 1) = '' OR split_part(c.k, '/', 1) = '' THEN 0 WHEN split_part(f.ek, '/', 1) = split_part(c.k, '/', 1) THEN CASE WHEN split_part(f.ek, '/', 2) <> '' AND split_part(f.ek, '/', 2) = split_part(c.k, '/', 2) THEN 3 ELSE 2 END WHEN split_part(f.ek, '/', 1) IN ({', '.join(map(repr, GENERIC))}) THEN 0 WHEN split_part(c.k, '/', 1) IN ({', '.join(map(repr, GENERIC))}) THEN -1 ELSE -3 END AS folder,
  coalesce(rec.recency, 0) AS recency, CASE WHEN f.hub_score > 0 THEN least(floor(log2(f.hub_score) * 6 + 0.5) / 10, 4.0) ELSE 0 END AS hub, round(CASE WHEN wg.mean > 1 THEN least((wg.mean - 1) * 2, 4.0) ELSE 0 END, 6) AS edge, coalesce(fbb.feedback, 0) AS feedback, round(coalesce(prs.prospect, 0), 6) AS prospect, coalesce(c.cooc, 0) AS cooc
  FROM cand c JOIN fit f ON f.id = c.id JOIN nt ON nt.k = c.k CROSS JOIN tot LEFT JOIN men m ON m.note = c.k AND m.entity = c.id LEFT JOIN edf ON edf.entity = c.id LEFT JOIN rec ON rec.id = c.id LEFT JOIN wg ON wg.entity = f.entity LEFT JOIN fbb ON fbb.entity = f.entity AND fbb.folder = nt.top LEFT JOIN off_ o ON o.entity = f.entity AND o.folder = nt.top LEFT JOIN prs ON prs.entity = f.entity
  WHERE m.note IS NULL AND o.entity IS NULL),
summed AS (SELECT *, round(lexical + kind + context + folder + recency + hub + edge + feedback + prospect + cooc, 6) AS raw FROM wide), gated AS (SELECT *, CASE WHEN lexical < 5 THEN least(raw, 9.0) ELSE raw END AS total FROM summed),
passed AS (SELECT * FROM gated WHERE (lexical > 0 OR (cooc >= 6 AND seeds >= 2)) AND NOT (lower(name) IN ({_STOP}) AND category NOT IN ({', '.join(map(repr, EXEMPT))})) AND total >= CASE WHEN size < 50 THEN 6 WHEN size > 200 THEN 12 ELSE 10 END)
"""
)
add = book.add


def best(x: DataFrame, k: int = 5) -> DataFrame:
    """The best suggestions of each note, ties to the smaller id."""
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("total"), "id"))).where(F.col("rank") <= k)


@add("SELECT k, id, round(lexical, 4) AS lexical, kind, context, folder, recency, CAST(hub AS DOUBLE) AS hub, CAST(edge AS DOUBLE) AS edge, CAST(feedback AS INTEGER) AS feedback, round(CAST(prospect AS DOUBLE), 4) AS prospect, CAST(cooc AS INTEGER) AS cooc, round(total, 4) AS total, rank FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY total DESC, id) AS rank FROM passed) WHERE rank <= 5")
def suggest_notes(spark, d):
    """The five best suggestions of each note with all layers but stems."""
    x = best(note_suggestions(spark, d, disabled=("stems",)))
    whole = ["kind", "context", "folder", "recency", "feedback", "cooc"]
    return x.select("k", "id", F.round("lexical", 4).alias("lexical"), *[F.col(c).cast("int").alias(c) for c in whole], "hub", "edge", F.round("prospect", 4).alias("prospect"), F.round("total", 4).alias("total"), "rank")


@add()
def suggest_notes_stemmed(spark, d):
    """The same with stems."""
    return best(note_suggestions(spark, d))


@add("""SELECT layer, count(*) FILTER (WHERE v <> 0) AS n_used, round(avg(abs(v)), 4) AS mean_abs FROM (SELECT unnest(['lexical', 'kind', 'context', 'folder', 'recency', 'hub', 'edge', 'feedback', 'prospect', 'cooc']) AS layer, unnest([lexical, kind, context, folder, recency, hub, edge, feedback, prospect, cooc]::DOUBLE[]) AS v FROM passed) GROUP BY 1""")
def suggest_layer_report(spark, d):
    """How often each layer counts among all suggestions that pass, and how much."""
    x = note_suggestions(spark, d, disabled=("stems",))
    long = x.select(F.explode(F.array(*[F.struct(F.lit(n).alias("layer"), F.col(n).alias("v")) for n in LAYERS if n != "stems"])).alias("x")).select("x.*")
    return long.groupBy("layer").agg(F.count_if(F.col("v") != 0).alias("n_used"), F.round(F.avg(F.abs("v")), 4).alias("mean_abs"))


QUERIES, SQL = book.queries, book.sql
