"""Session defaults and the few things every operator needs from a session: tables, cuts of lineage, counts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster the caller's own session is used unchanged."""
    b = SparkSession.builder.master(master).appName("wherry")
    defaults = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; only where that is unset, a folder of this machine for local runs."""
    jsc = spark.sparkContext._jsc.sc()
    current = jsc.getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="wherry-", dir=os.environ.get("TMPDIR"))
    spark.sparkContext.setCheckpointDir(named)
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hot_keys(left: DataFrame, key: str, share: int = 256) -> tuple[list, bool]:
    """The keys with more than 1/``share`` of the rows, fewer than ``share`` of them, and whether nulls are that many; from a sketch of frequent items in one pass."""
    n, top = left.agg(F.count(F.lit(1)), F.expr(f"approx_top_k(`{key}`, {share}, 8192)")).first()
    many = [r["item"] for r in top if r["count"] > max(1000, n // share)]
    return [k for k in many if k is not None], None in many


def hot_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", share: int = 256) -> DataFrame:
    """Joins ``left`` with ``right`` (one row per key) on ``key`` without piling a hot key into one task.

    A key is hot if it holds more than 1/``share`` of the left rows, so there are fewer than ``share`` hot keys whatever the data.
    Their right rows are broadcast: ``right`` must be unique per key, which bounds that broadcast to ``share`` rows. All other keys
    take the ordinary shuffled join. Null keys match nothing and, on a left join, are kept; many of them stay where they are. Nothing is
    dropped or sampled. The left side is read once for the sketch and, if a key is hot, twice for the join.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be left or inner")
    hot, nulls = hot_keys(left, key, share)
    if not hot and not nulls:
        return left.join(right, key, how)
    k = F.col(key)
    cold = left.where(k.isNotNull() & ~k.isin(hot)) if hot else left.where(k.isNotNull())
    warm = left.where((k.isin(hot) if hot else F.lit(False)) | k.isNull()) if how == "left" else left.where(k.isin(hot) if hot else F.lit(False))
    few = F.broadcast(right.where(k.isin(hot)) if hot else right.limit(0))
    return cold.join(right, key, how).unionByName(warm.join(few, key, how))


def link_key(c: Column | str) -> Column:
    """Blanks around it removed, lower-cased, without an ending ``.md``."""
    c = F.col(c) if isinstance(c, str) else c
    blanks = r"(?U)^\s+|\s+$"
    return F.regexp_replace(F.lower(F.regexp_replace(c, blanks, "")), r"\.md$", "")
