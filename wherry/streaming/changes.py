"""The vault's change stream: coalescing, renames, content hashes, survival counters and cooldowns, in batch and as Structured Streaming.

The batch functions are what ``foreachBatch`` calls on each micro-batch, so a stream and a recomputation give the same tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wherry.session import link_key

SCHEMA = "seq long, path string, type string, ts timestamp_ntz, content_hash string"


def coalesce(events: DataFrame) -> DataFrame:
    """``k, action, seq, content_hash``: one action per path, its last event deciding: an unlink deletes, anything else upserts. Repeated rows count once."""
    g = events.where(F.col("path").isNotNull()).groupBy(link_key("path").alias("k")).agg(F.max(F.struct("seq", "type", "content_hash")).alias("x"))
    return g.select("k", F.when(F.col("x.type") == "unlink", "delete").otherwise("upsert").alias("action"), F.col("x.seq").alias("seq"), F.col("x.content_hash").alias("content_hash"))


def changed(actions: DataFrame, known: DataFrame) -> DataFrame:
    """Upserts whose hash differs from the known one of ``known(k, content_hash)``, and all deletes."""
    same = known.select("k", "content_hash")
    return actions.join(same, ["k", "content_hash"], "left_anti")


#: Stems too common to be a move between folders (fixed values).
COMMON_STEMS = ["readme", "index", "todo", "changelog", "license", "notes"]


def renames(events: DataFrame, within_seconds: int = 5) -> DataFrame:
    """``from_k, to_k, unlink_seq, add_seq``: an unlink and an add of the same file stem within a short time, paired one to one: each takes one of its own folder first, then its nearest, and only mutual choices count. Common stems don't move between folders.

    Joined on stem and time bucket, so a stem used by many files costs no more than those close in time.
    """
    e = events.distinct().select("seq", "type", link_key("path").alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).where(F.col("type").isin("unlink", "add") & F.col("us").isNotNull())
    e = e.withColumn("stem", F.element_at(F.split("k", "/"), -1))
    span = within_seconds * 1_000_000
    u = e.where("type = 'unlink'").select("stem", F.col("k").alias("from_k"), F.col("seq").alias("unlink_seq"), F.col("us").alias("u"), F.explode(F.array(*[F.floor(F.col("us") / span) + i for i in (-1, 0, 1)])).alias("b"))
    a = e.where("type = 'add'").select("stem", F.col("k").alias("to_k"), F.col("seq").alias("add_seq"), F.col("us").alias("a"), F.floor(F.col("us") / span).alias("b"))
    p = u.join(a, ["stem", "b"]).where((F.col("from_k") != F.col("to_k")) & (F.abs(F.col("u") - F.col("a")) <= span)).withColumn("gap", F.abs(F.col("u") - F.col("a")))
    p = p.withColumn("away", F.regexp_extract("from_k", r"^(.*)/[^/]*$", 1) != F.regexp_extract("to_k", r"^(.*)/[^/]*$", 1))
    p = p.where(~F.col("away") | ~F.regexp_replace("stem", r"\.[^.]+$", "").isin(*COMMON_STEMS))
    by_u, by_a = Window.partitionBy("unlink_seq").orderBy("away", "gap", "add_seq"), Window.partitionBy("add_seq").orderBy("away", "gap", "unlink_seq")
    return p.withColumn("ru", F.row_number().over(by_u)).withColumn("ra", F.row_number().over(by_a)).where("ru = 1 and ra = 1").select("from_k", "to_k", "unlink_seq", "add_seq")


def survival(events: DataFrame, least: int = 3) -> DataFrame:
    """``k, n_edits, survived``: edits since a path was last added, and whether it survived ``least`` of them."""
    e = events.distinct().select(link_key("path").alias("k"), "seq", "type")
    w = Window.partitionBy("k").orderBy("seq")
    life = F.sum(F.when(F.col("type").isin("add", "unlink"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    x = e.withColumn("life", life)
    last = x.groupBy("k").agg(F.max("life").alias("life"))
    g = x.join(last, ["k", "life"]).groupBy("k").agg(F.count_if(F.col("type") == "change").alias("n_edits"), F.max_by("type", "seq").alias("t"))
    return g.where("t <> 'unlink'").select("k", "n_edits", (F.col("n_edits") >= least).alias("survived"))


def upsert(table: DataFrame, batch: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Latest version of each key over a table and a batch: what a merge would leave."""
    both = table.unionByName(batch)
    rest = [c for c in both.columns if c not in (*keys, version)]
    return both.groupBy(*keys).agg(F.max(F.struct(version, *rest)).alias("x")).select(*keys, "x.*")


def merge_upsert(table: DataFrame, batch: DataFrame, keys: list[str], greatest: list[str] = (), total: list[str] = (), ranked: dict[str, list[str]] | None = None) -> DataFrame:
    """An upsert that merges: of each key the greatest value of some columns, the sum of others, and of ``ranked`` ones the value that stands first in its list. Nulls give way; values outside a list come last."""
    both = table.unionByName(batch)
    out = [F.max(c).alias(c) for c in greatest] + [F.sum(c).alias(c) for c in total]
    for c, order in (ranked or {}).items():
        place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(c))
        place = F.when(F.col(c).isNull(), len(order) + 2).when(place == 0, len(order) + 1).otherwise(place)
        out.append(F.min_by(c, F.struct(place, F.col(c))).alias(c))
    return both.groupBy(*keys).agg(*out)


def read_changes(spark: SparkSession, path: str, files_per_trigger: int = 50) -> DataFrame:
    """The change log as a stream of Parquet files."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_stream(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, every: str = "1 second") -> StreamingQuery:
    """Runs ``each`` on every micro-batch; ``once`` drains what there is and stops."""
    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()


def windowed(stream: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Changes by type in event-time windows; rows later than the watermark are left out by the engine."""
    s = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return s.groupBy(F.window("at", length).alias("w"), "type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "type", "n")


def fresh(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """The first row of each path and content hash within the watermark."""
    return stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["path", "content_hash"])


def cooldown(stream: DataFrame, hours: float = 24.0) -> DataFrame:
    """``k, seq, ts``: changes of a path at least ``hours`` after the last one let through; the time of that one is the path's only state."""
    gap = int(hours * 3600 * 1_000_000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["us", "seq"])
        out = []
        for seq, us in zip(rows["seq"], rows["us"]):
            if last is None or us - last >= gap:
                out.append((key[0], seq, us))
                last = us
        if last is not None:
            state.update((int(last),))
        yield pd.DataFrame(out, columns=["k", "seq", "us"]) if out else pd.DataFrame({"k": pd.Series([], dtype=object), "seq": pd.Series([], dtype="int64"), "us": pd.Series([], dtype="int64")})

    s = stream.where(F.col("ts").isNotNull() & F.col("path").isNotNull()).select(link_key("path").alias("k"), "seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return s.groupBy("k").applyInPandasWithState(step, "k string, seq long, us long", "last long", "append", "NoTimeout")
