"""Sources and sinks: folders of markdown notes, CSV seeds, JSON lines, server logs, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_NOTE_BYTES = 10 * 1024 * 1024
#: Folders that hold no notes.
SYSTEM_FOLDERS = (".git", ".obsidian", ".trash", "node_modules", ".DS_Store")
LONGEST_PATH = 260


def read_vault(spark: SparkSession, root: str) -> DataFrame:
    """``path, content, modified`` of all markdown files below a folder; system folders, too long paths, too large files and files with NUL bytes are left out."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    rel = F.regexp_replace(F.col("path"), r"^.*?" + _quote(root.rstrip("/")) + "/", "")
    parts = F.split(rel, "/")
    ok = (F.col("length") <= MAX_NOTE_BYTES) & (F.length(rel) < LONGEST_PATH) & ~F.exists(parts, lambda x: x.isin(*SYSTEM_FOLDERS))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return f.where(ok).select(rel.alias("path"), text.alias("content"), F.col("modificationTime").alias("modified")).where(~F.contains("content", F.lit("\0")))


def _quote(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in "/_-" else c for c in s)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header and a stated schema; malformed rows give nulls."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with a stated schema; lines that don't parse give nulls."""
    return spark.read.schema(schema).json(path)


def read_log(spark: SparkSession, path: str, since: str | None = None, component: str | None = None) -> DataFrame:
    """Log lines ``ts, component, message`` from JSON lines, filtered in the scan."""
    log = read_jsonl(spark, path, "ts timestamp, component string, message string")
    if since is not None:
        log = log.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    return log.where(F.col("component") == component) if component is not None else log


def write_snapshot(df: DataFrame, path: str, built_at: str) -> None:
    """A derived table with its row count and time, so that a reader can tell whether it still holds. An empty table never replaces a filled one."""
    if df.isEmpty() and _exists(df.sparkSession, path):
        raise ValueError("an empty snapshot would replace a filled one")
    df.write.mode("overwrite").parquet(f"{path}/data")
    n = df.sparkSession.read.parquet(f"{path}/data").count()
    df.sparkSession.createDataFrame([(n, built_at)], "n long, built_at string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def read_snapshot(spark: SparkSession, path: str, n_now: int, now: str, tolerance: float = 0.05, max_age_hours: float = 24.0) -> DataFrame | None:
    """The snapshot if its count is within the tolerance of today's and it is young enough, else ``None``."""
    if not _exists(spark, path):
        return None
    m = spark.read.schema("n long, built_at string").json(f"{path}/meta")
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("built_at").cast("timestamp"))) / 3600
    ok = m.where((F.abs(F.col("n") - n_now) <= tolerance * n_now) & (age <= max_age_hours) & (age >= 0)).count()
    return spark.read.parquet(f"{path}/data") if ok else None


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def salvage(target: DataFrame, backup: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the backup whose keys the target lacks, added to it; only columns of the target are kept, missing ones are null."""
    cols = [c for c in backup.columns if c in target.columns]
    missing = backup.select(*cols).dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(missing, allowMissingColumns=True)
