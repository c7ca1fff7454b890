"""Queries of the operators in this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wherry.llm import canonical, conversations, cooccur, encoding, knn, leakage, mixing, splitting
from wherry.session import cut, link_key, table

MODELS = {"vault-mini-v2": 64, "vault-base-v1": 96}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The entity that each sighting's term means, or -1."""
    return _resolved(spark, d).select("sighting_id", "entity_id").distinct()


def p2_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Terms that mean no entity, with their sightings."""
    return _resolved(spark, d).where("entity_id = -1").groupBy("term").agg(F.count(F.lit(1)).alias("n_sightings"))


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    return canonical.resolve_sightings(table(spark, d, "prospect_ledger").select("sighting_id", "term"), table(spark, d, "entities").select("id", "name", "aliases_json"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Usable vectors of notes and entities."""
    n = knn.usable(table(spark, d, "note_embeddings"), "note_embeddings", "path", MODELS)
    return n.unionByName(knn.usable(table(spark, d, "entity_embeddings"), "entity_embeddings", "entity_name", MODELS))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of each usable vector."""
    return knn.nearest(vectors(spark, d)).select("src", F.col("key").alias("vec_key"), F.col("near").alias("near_key"))


def p3_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the index against brute force, by group, with the vectors whose key's hash is divisible by 100 as queries against all vectors."""
    v = cut(vectors(spark, d))
    q = v.where(F.pmod(F.xxhash64("key"), F.lit(100)) == 0)
    exact = knn.brute_force(v, q)
    got = knn.nearest(v).select("src", "model", "key", "near", F.lit(1).alias("hit"))
    j = exact.join(got, ["src", "model", "key", "near"], "left")
    return j.groupBy("src", "model").agg(F.countDistinct("key").alias("n_queries"), F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1)), 6).alias("recall_at_5"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Messages of whole sessions in order."""
    return conversations.build(table(spark, d, "warmup")).where("whole").select("session_id", "turn_no", "msg_key")


def p4_dropped(spark: SparkSession, d: str) -> DataFrame:
    """Sessions left out, counted by what is wrong with them."""
    m = conversations.build(table(spark, d, "warmup")).where("not whole and turn_no = 0")
    return m.groupBy("unparsed", "bad_turn", "bad_start", "bad_end", "bad_call").agg(F.count(F.lit(1)).alias("n_sessions"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Oversized notes with their kind."""
    big = splitting.newest_oversized(table(spark, d, "notes_fts").select("path", "content", "modified"))
    return splitting.pieces(big, "path", "content", with_text=False).select(F.col("key").alias("path"), "kind").distinct()


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every oversized note, with its text."""
    big = splitting.newest_oversized(table(spark, d, "notes_fts").select("path", "content", "modified"))
    return splitting.pieces(big, "path", "content").withColumnRenamed("key", "path")


def link_baskets(spark: SparkSession, d: str) -> DataFrame:
    """Targets by note."""
    return table(spark, d, "note_links").select(link_key("note_path").alias("basket"), link_key("target").alias("item"))


def summary_baskets(spark: SparkSession, d: str) -> DataFrame:
    """Names by summary row."""
    arr = F.from_json("cooccurring_entities", "array<string>", {"allowSingleQuotes": "false"})
    bare = F.when(F.trim("cooccurring_entities").rlike('^".*"$'), F.array(F.get_json_object(F.concat(F.lit('{"a":'), F.col("cooccurring_entities"), F.lit("}")), "$.a")))
    return table(spark, d, "prospect_summary").select(F.col("summary_id").alias("basket"), F.explode(F.coalesce(arr, bare)).alias("x")).select("basket", link_key("x").alias("item"))


def _pairs(spark: SparkSession, d: str, lift: float) -> DataFrame:
    a = cooccur.together(link_baskets(spark, d), "basket", "item", 5, lift).withColumn("src", F.lit("note_links"))
    b = cooccur.together(summary_baskets(spark, d), "basket", "item", 5, lift).withColumn("src", F.lit("prospect_summary"))
    return a.unionByName(b)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that stand together at least three times as often as chance."""
    return _pairs(spark, d, 3.0).select("src", "item_a", "item_b")


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Counts, lift and log-likelihood ratio of those pairs."""
    return _pairs(spark, d, 3.0).select("src", "item_a", "item_b", "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"), F.round("llr", 4).alias("llr"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the items that leaked into them."""
    return leakage.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text").select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Items that leaked, with the number of documents and the greatest part of the item in one of them."""
    x = leakage.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")
    return x.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.max("coverage"), 6).alias("most_coverage"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The copies drawn for each mix, in the mix's order."""
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_targets(spark: SparkSession, d: str) -> DataFrame:
    """The targets as they are read: per mix and source its share among the sources that have texts, and its cap."""
    rows = mixing.clean_targets(table(spark, d, "mix_targets"))
    t = spark.createDataFrame(rows, "mix string, source string, weight double, max_repeats int")
    there = table(spark, d, "documents").where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"(?U)\S")).select(F.lower(F.trim("source")).alias("source"), F.lit(1).alias("there")).distinct()
    j = t.join(there, "source", "left").withColumn("w", F.when(F.col("there") == 1, F.col("weight")).otherwise(F.lit(0.0)))
    return j.select("mix", "source", "max_repeats", F.round(F.coalesce(F.try_divide(F.col("w"), F.sum("w").over(Window.partitionBy("mix"))), F.lit(0.0)), 9).alias("target_share"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares asked for and drawn."""
    return mixing.actual_shares(*mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a passage read with a wrong encoding."""
    return encoding.garbled_ids(table(spark, d, "documents")).distinct()


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """Those documents with the chain that was undone and the restored text."""
    return encoding.garbled(table(spark, d, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_unmatched, p3_found, p3_recall, p4_found, p4_dropped, p5_found, p5_pieces, p6_found, p6_pairs, p8_found, p8_items, p9_mix, p9_targets, p9_shares, p10_found, p10_restored)
}

_KEY = "regexp_replace(lower(trim({0})), '\\.md$', '')"
_P5 = """
WITH newest AS (SELECT lower(path) AS k, max(modified) AS m FROM notes_fts WHERE path IS NOT NULL GROUP BY 1)
SELECT DISTINCT n.path, CASE WHEN regexp_matches(n.content, '[^\\s\\x0b\\x1c-\\x1f\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]{1000}') AND
  list_max(list_transform(regexp_split_to_array(n.content, '[\\s\\x0b\\x1c-\\x1f\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]'), lambda x: length(x))) > 6000 THEN 'hard' ELSE 'soft' END AS kind
FROM notes_fts n JOIN newest w ON lower(n.path) = w.k AND n.modified = w.m WHERE length(n.content) > 6000
"""
_P6 = f"""
WITH rows AS (SELECT 'note_links' AS src, {_KEY.format('note_path')} AS basket, {_KEY.format('target')} AS item FROM note_links
  UNION ALL SELECT 'prospect_summary', CAST(summary_id AS VARCHAR), {_KEY.format('x')} FROM (SELECT summary_id, unnest(from_json(cooccurring_entities, '["VARCHAR"]')) AS x
    FROM prospect_summary WHERE json_valid(cooccurring_entities) AND json_type(cooccurring_entities) = 'ARRAY')),
b AS (SELECT DISTINCT src, basket, item FROM rows WHERE basket IS NOT NULL AND item <> ''),
n AS (SELECT src, count(DISTINCT basket) AS n FROM b GROUP BY 1), i AS (SELECT src, item, count(*) AS c FROM b GROUP BY 1, 2),
p AS (SELECT x.src, x.item AS item_a, y.item AS item_b, count(*) AS n_ab FROM b x JOIN b y ON x.src = y.src AND x.basket = y.basket AND x.item < y.item GROUP BY 1, 2, 3 HAVING count(*) >= 5),
t AS (SELECT p.*, ia.c AS n_a, ib.c AS n_b, n.n FROM p JOIN i ia ON ia.src = p.src AND ia.item = item_a JOIN i ib ON ib.src = p.src AND ib.item = item_b JOIN n ON n.src = p.src WHERE n_ab * n.n >= 3 * ia.c * ib.c)
"""
_H = "(CASE WHEN {0} > 0 THEN ({0}) * ln(CAST({0} AS DOUBLE) / n) ELSE 0 END)"
_LLR = "2 * (" + " + ".join(_H.format(x) for x in ("n_ab", "(n_a - n_ab)", "(n_b - n_ab)", "(n - n_a - n_b + n_ab)")) + " - " + " - ".join(_H.format(x) for x in ("n_a", "(n - n_a)", "n_b", "(n - n_b)")) + ")"
_P8 = """
WITH it AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
iw AS (SELECT item_id, len(w) AS n, unnest(list_transform(range(1, greatest(2, len(w) - 11)), lambda p: list_slice(w, p, p + 12))) AS g FROM it WHERE len(w) > 0),
ig AS (SELECT DISTINCT item_id, g, least(n, 13) AS size FROM iw), sizes AS (SELECT DISTINCT size FROM ig),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(1, len(w) - size + 2)), lambda p: list_slice(w, p, p + size - 1))) AS g FROM dw, sizes),
hit AS (SELECT DISTINCT doc_id, item_id, g FROM dg JOIN ig USING (g)), tot AS (SELECT item_id, count(*) AS n FROM ig GROUP BY 1)
"""
SQL = {
    "p5_found": _P5,
    "p6_found": _P6 + "SELECT src, item_a, item_b FROM t",
    "p6_pairs": _P6 + f"SELECT src, item_a, item_b, n_ab, n_a, n_b, round(CAST(n_ab AS DOUBLE) * n / (n_a * n_b), 6) AS lift, round(greatest({_LLR}, 0), 4) AS llr FROM t",
    "p8_found": _P8 + "SELECT DISTINCT doc_id, item_id FROM hit",
    "p9_targets": """
WITH t AS (SELECT mix, lower(trim(source)) AS source, max(weight) AS w, max(coalesce(max_repeats, 1)) AS max_repeats FROM mix_targets WHERE mix IS NOT NULL AND source IS NOT NULL AND weight > 0 AND coalesce(max_repeats, 1) > 0 GROUP BY ALL),
there AS (SELECT DISTINCT lower(trim(source)) AS source FROM documents WHERE source IS NOT NULL AND regexp_matches(text, '[^\\s\\p{Z}]')),
j AS (SELECT mix, t.source, max_repeats, CASE WHEN there.source IS NULL THEN 0 ELSE w END AS w FROM t LEFT JOIN there ON there.source = t.source)
SELECT mix, source, max_repeats, round(coalesce(w / nullif(sum(w) OVER (PARTITION BY mix), 0), 0), 9) AS target_share FROM j""",
    "p8_items": _P8 + "SELECT item_id, count(*) AS n_docs, round(max(c), 6) AS most_coverage FROM (SELECT doc_id, hit.item_id, count(*) / any_value(tot.n) AS c FROM hit JOIN tot ON tot.item_id = hit.item_id GROUP BY 1, 2) GROUP BY 1",
}
