"""A store of keyed memories with owners and versions: reads by precedence, listing, search and superseding as plans over ``mem``.

``mem(id, key, value, kind, owner, confidence, created, updated, thread)``: a null owner is shared. Rows of the same key are versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wherry.operators.search import bm25


def visible(mem: DataFrame, agent: str | None) -> DataFrame:
    """Shared memories and the agent's own."""
    own = F.col("owner").isNull() if agent is None else F.col("owner").isNull() | (F.col("owner") == agent)
    return mem.where(own)


def get(mem: DataFrame, agent: str | None) -> DataFrame:
    """One row per key: the agent's own before a shared one, then the latest, then the greater id. One aggregate, so a key of many versions is combined before it is shuffled."""
    rest = [c for c in mem.columns if c != "key"]
    v = visible(mem, agent).groupBy("key").agg(F.max(F.struct(F.col("owner").isNotNull().alias("own"), F.col("updated").alias("u"), F.col("id").alias("i"), F.struct(*rest).alias("m"))).alias("x"))
    return v.select("key", "x.m.*")


def current(mem: DataFrame) -> DataFrame:
    """The latest version of each key and owner."""
    rest = [c for c in mem.columns if c not in ("key", "owner")]
    return mem.groupBy("key", "owner").agg(F.max(F.struct("updated", "id", F.struct(*rest).alias("m"))).alias("x")).select("key", "owner", "x.m.*")


def supersede(mem: DataFrame, by: str) -> DataFrame:
    """``id, superseded_by``: each version's next one by time within the same ``by`` column and owner; the last one isn't superseded. Null values of ``by`` supersede nothing."""
    w = Window.partitionBy(by, "owner").orderBy("updated", "id")
    return mem.where(F.col(by).isNotNull()).withColumn("superseded_by", F.lead("id").over(w)).where("superseded_by is not null").select("id", "superseded_by")


def unsupersede(links: DataFrame, ids: DataFrame) -> DataFrame:
    """The same links without those that point from or to ``ids(id)``."""
    return links.join(ids, "id", "left_anti").join(ids.toDF("superseded_by"), "superseded_by", "left_anti").select("id", "superseded_by")


def search(mem: DataFrame, agent: str | None, terms: list[str], least: float, k: int) -> DataFrame:
    """``id, key, score``: the ``k`` best of the current visible memories of at least that confidence, by BM25 over key and value."""
    live = current(visible(mem, agent)).where(F.col("confidence") >= least)
    hits = bm25(live.select("id", "key", "value"), "id", {"key": 1.0, "value": 1.0}, terms, k)
    return hits.join(live.select("id", "key"), "id").select("id", "key", "score")


def confidence_of(word: Column) -> Column:
    """A number for a word of confidence."""
    return F.when(word == "high", 1.0).when(word == "medium", 0.6).otherwise(0.3)
