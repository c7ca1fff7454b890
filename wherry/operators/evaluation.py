"""Retrieval metrics: recall, precision, reciprocal rank, discounted gain, token overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def retrieval_metrics(retrieved: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Means over the queries of ``relevant(query_id, doc)`` for ``retrieved(query_id, rank, doc)``: recall, precision, reciprocal rank and NDCG at ``k``. A query with nothing retrieved counts as 0."""
    rel = relevant.distinct()
    n = rel.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel"))
    hit = retrieved.where(F.col("rank") <= k).join(rel, ["query_id", "doc"])
    per = hit.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_rel", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    j = n.join(per, "query_id", "left")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    mean = lambda c: F.round(F.avg(c), 6)
    return j.agg(F.count(F.lit(1)).alias("n_queries"), mean(z(F.col("hits") / F.col("n_rel"))).alias("recall"), mean(z(F.col("hits") / F.lit(k))).alias("precision"), mean(z(1 / F.col("first"))).alias("mrr"), mean(z(F.col("dcg") / ideal)).alias("ndcg"))


def token_f1(pred: Column, truth: Column) -> Column:
    """F1 of two texts' words as bags."""
    w = lambda c: F.regexp_extract_all(F.coalesce(F.lower(c), F.lit("")), F.lit(r"[\p{L}\p{N}]+"), 0)
    a, b = w(pred), w(truth)
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    same = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))
    return F.when(same > 0, 2.0 * same / (F.size(a) + F.size(b))).otherwise(F.lit(0.0))
