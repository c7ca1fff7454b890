"""References to records that do not exist, found by runs of integer parent keys.

Every key (of parents and of references) gets a dense integer inside its hash bucket: ``id = rank in the sorted bucket``. Parents
then form contiguous runs of integers; consecutive parents with no foreign key between them compress into one run. A reference is
matched as-of to the run with the greatest start at or before it, and is an orphan if it lies beyond that run's end. Ranks, runs and
the as-of match share one partitioning by bucket, so the whole match costs a single shuffle of distinct keys. References are reduced
to distinct keys before that shuffle: a key with a third of all rows is one row there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wherry.session import hot_join, link_key

#: A bucket is one window group. With 2^14 buckets a billion distinct keys give 61,000 to a group.
BUCKETS = 1 << 14


def key_runs(keys: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Numbers (``key``, ``is_parent``), one row per key, and compresses the parents into runs.

    Returns ``bucket, id, key, is_parent, run_start, run_end``: the last run that starts at or before ``id`` in the bucket (null if none).
    """
    w = Window.partitionBy("bucket").orderBy("key")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by_run = Window.partitionBy("bucket", "run_start")
    return (
        keys.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
        .withColumn("id", F.row_number().over(w))
        .withColumn("opens", F.col("is_parent") & ~F.coalesce(F.lag("is_parent").over(w), F.lit(False)))
        .withColumn("run_start", F.last(F.when(F.col("opens"), F.col("id")), ignorenulls=True).over(upto))
        .withColumn("run_end", F.max(F.when(F.col("is_parent"), F.col("id"))).over(by_run))
        .select("bucket", "id", "key", "is_parent", "run_start", "run_end")
    )


def match_keys(references: DataFrame, parents: DataFrame, key: str = "key") -> DataFrame:
    """The distinct non-null ``key`` of ``references`` with ``found``: whether ``parents`` has it.

    Null keys name nothing and are left out; repeated rows count once; empty tables give an empty result or no match. Columns beside
    ``key`` are ignored, whatever their names.
    """
    r = references.select(F.col(key).alias("key")).where(F.col("key").isNotNull()).select("key", F.lit(False).alias("p"), F.lit(True).alias("r"))
    p = parents.select(F.col(key).alias("key")).where(F.col("key").isNotNull()).select("key", F.lit(True).alias("p"), F.lit(False).alias("r"))
    keys = r.unionByName(p).groupBy("key").agg(F.max("p").alias("is_parent"), F.max("r").alias("is_ref"))
    # the reference flag rides along by rank: key_runs keeps every key, so it is joined back without a second shuffle of its own
    runs = key_runs(keys.select("key", "is_parent", "is_ref").withColumn("key", F.struct("key", "is_ref")))
    return runs.where(F.col("key.is_ref")).select(F.col("key.key").alias("key"), F.coalesce(F.col("id") <= F.col("run_end"), F.lit(False)).alias("found"))


def stem(key: Column | str) -> Column:
    """Last segment of a path key."""
    return F.element_at(F.split(key, "/"), -1)


def vault_parents(notes: DataFrame, events: DataFrame, entities: DataFrame) -> DataFrame:
    """All that a reference can name, one row per ``(space, name)``: ``live``, ``created`` of the newest version, ``gone``.

    Spaces: ``e`` entity names and aliases, ``p`` note paths, ``s`` file stems. A stem of several notes takes the earliest creation,
    as one of them being there is enough, and no time at all if one of them has none.
    """
    live = notes.groupBy(link_key("path").alias("name")).agg(F.max_by("created", "modified").alias("created"))
    gone = events.where(F.col("type") == "unlink").select(link_key("path").alias("name")).where(F.col("name").isNotNull()).distinct()
    aliases = F.from_json("aliases_json", "array<string>")
    ents = entities.select(F.explode(F.concat(F.array("name"), F.coalesce(aliases, F.array().cast("array<string>")))).alias("n")).select(link_key("n").alias("name"))
    null_ts = F.lit(None).cast("timestamp_ntz")
    paths = live.select("name", F.lit(True).alias("live"), F.col("created").cast("timestamp_ntz").alias("created"), F.lit(False).alias("gone")).unionByName(
        gone.select("name", F.lit(False).alias("live"), null_ts.alias("created"), F.lit(True).alias("gone"))
    )
    both = paths.select(F.explode(F.array(F.struct(F.lit("p").alias("space"), F.col("name").alias("name")), F.struct(F.lit("s").alias("space"), stem("name").alias("name")))).alias("x"), "live", "created", "gone")
    all_ = both.select("x.space", "x.name", "live", "created", "gone").unionByName(
        ents.where(F.col("name").isNotNull()).select(F.lit("e").alias("space"), "name", F.lit(True).alias("live"), null_ts.alias("created"), F.lit(False).alias("gone"))
    )
    unknown = F.max(F.col("live") & F.col("created").isNull())
    return all_.groupBy("space", "name").agg(F.max("live").alias("live"), F.when(~unknown, F.min("created")).alias("created"), F.max("gone").alias("gone"))


def vault_orphans(notes: DataFrame, events: DataFrame, entities: DataFrame, links: DataFrame) -> DataFrame:
    """Every reference of the vault that names a note or entity that isn't there: ``src, field, ref_id, kind, at``.

    ``kind`` is ``deleted``, ``missing`` or, for links only, ``late``; ``at`` is the time of a link. Null and unparsable values name
    nothing. Rows repeated exactly come out once. A key of any share of the rows is reduced to one row before it is matched, and its
    verdict is brought back to the rows by ``hot_join``.
    """
    parents = vault_parents(notes, events, entities)
    refs = links.select(F.lit("note_links").alias("src"), F.col("link_id").alias("ref_id"), F.col("weight_updated_at").cast("timestamp_ntz").alias("at"), F.explode(F.array(F.struct(F.lit("note_path").alias("field"), link_key("note_path").alias("key")), F.struct(F.lit("target").alias("field"), link_key("target").alias("key")))).alias("x")).select(
        "src", "ref_id", "at", "x.field", "x.key"
    ).unionByName(entities.select(F.lit("entities").alias("src"), F.col("id").alias("ref_id"), F.lit(None).cast("timestamp_ntz").alias("at"), F.lit("path").alias("field"), link_key("path").alias("key")))
    refs = refs.where(F.col("key").isNotNull()).withColumn("as_name", (F.col("field") == "target")).withColumn("rk", F.concat(F.when(F.col("as_name"), F.lit("t:")).otherwise(F.lit("p:")), "key"))
    verdict = reference_verdicts(refs, parents)
    named = hot_join(refs, verdict, "rk", "inner")
    late = (F.col("src") == "note_links") & (F.col("state") == "live") & (F.col("made") > F.col("at"))
    kind = F.when(F.col("state") != "live", F.col("state")).when(late, F.lit("late"))
    return named.withColumn("kind", kind).where(F.col("kind").isNotNull()).select("src", "field", "ref_id", "kind", "at").distinct()


def reference_verdicts(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """For each distinct ``rk`` of the references: ``state`` (live, deleted, missing) and ``made``, the note's creation time."""
    asked = refs.select("rk", "as_name", "key").distinct()
    spaces = F.when(F.col("as_name"), F.array(F.lit("e"), F.lit("p"), F.lit("s"))).otherwise(F.array(F.lit("p")))
    asked = asked.select("rk", F.posexplode(spaces).alias("rank", "space"), F.col("key").alias("name"))
    parents = parents.withColumn("key", F.concat_ws(":", "space", "name"))
    wanted = asked.withColumn("key", F.concat_ws(":", "space", "name"))
    found = match_keys(wanted, parents.where("live"))
    facts = parents.select("key", "created", "gone")
    got = wanted.join(found, "key").join(facts, "key", "left").select("rk", "rank", F.col("found").alias("live"), "created", F.coalesce("gone", F.lit(False)).alias("gone"))
    best = F.min(F.when(F.col("live"), F.struct("rank", "created")))
    return got.groupBy("rk").agg(best.alias("hit"), F.max("gone").alias("gone")).select(
        "rk", F.when(F.col("hit").isNotNull(), F.lit("live")).when(F.col("gone"), F.lit("deleted")).otherwise(F.lit("missing")).alias("state"), F.col("hit.created").alias("made")
    )


def orphans_by_period(orphans: DataFrame) -> DataFrame:
    """Orphan references counted by table, field, kind and month; references without a time have a null month."""
    return orphans.groupBy("src", "field", "kind", F.date_format("at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n_refs"))
