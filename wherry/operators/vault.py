"""The vault's model tables: notes, links and the keys by which a link finds a note."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wherry.functions.exprs import file_stem, link_key, top_folder
from wherry.session import hot_join, table


def json_list(c: Column | str) -> Column:
    """A JSON array of strings; null if it isn't one."""
    return F.from_json(c, "array<string>", {"allowSingleQuotes": "false"})


def notes(spark: SparkSession, d: str, *extra: str, **derived: Column) -> DataFrame:
    """One row per note, its newest version: ``k, path, title, top, modified, created`` and the columns named. Only those are read and shuffled.

    ``derived`` columns are worked out of the raw rows, so that what is taken from long contents is shuffled and the contents aren't.
    """
    cols = ["modified", "path", "created", "title", *[c for c in extra if c not in ("modified", "path", "created", "title")]]
    n = table(spark, d, "notes_fts").where(F.col("path").isNotNull()).select(*cols, *[c.alias(name) for name, c in derived.items()])
    newest = n.groupBy(link_key("path").alias("k")).agg(F.max(F.struct(*cols, *derived)).alias("x")).select("k", "x.*")
    return newest.withColumn("title", F.coalesce("title", file_stem(F.col("path")))).withColumn("top", top_folder(F.col("k")))


def links(spark: SparkSession, d: str) -> DataFrame:
    """Links once each: ``link_id, src, dst, weight, at``; ``src`` and ``dst`` are link keys."""
    raw = table(spark, d, "note_links").where(F.col("note_path").isNotNull() & F.col("target").isNotNull())
    return raw.select("link_id", link_key("note_path").alias("src"), link_key("target").alias("dst"), "weight", F.col("weight_updated_at").alias("at")).distinct()


def entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities once each with ``aliases`` as an array (empty if it can't be read)."""
    e = table(spark, d, "entities").distinct()
    return e.withColumn("aliases", F.coalesce(json_list("aliases_json"), F.array().cast("array<string>"))).drop("aliases_json")


def entity_keys(notes_: DataFrame, entities_: DataFrame) -> DataFrame:
    """``key, k``: which note a key leads to. A full path wins over a file stem, a stem over an entity's name, that over an alias; ties to the smaller note key."""
    by_path = notes_.select(F.col("k").alias("key"), F.lit(0).alias("prio"), "k")
    by_stem = notes_.select(F.element_at(F.split("k", "/"), -1).alias("key"), F.lit(1).alias("prio"), "k")
    e = entities_.where(F.col("path").isNotNull()).select("name", "aliases", link_key("path").alias("k")).join(notes_.select("k"), "k")
    by_name = e.select(link_key("name").alias("key"), F.lit(2).alias("prio"), "k")
    by_alias = e.select(F.explode("aliases").alias("a"), "k").select(link_key("a").alias("key"), F.lit(3).alias("prio"), "k")
    keys = by_path.unionByName(by_stem).unionByName(by_name).unionByName(by_alias).where(F.col("key").isNotNull() & (F.col("key") != ""))
    return keys.groupBy("key").agg(F.min(F.struct("prio", "k")).alias("x")).select("key", F.col("x.k").alias("k"))


def resolved(links_: DataFrame, keys: DataFrame) -> DataFrame:
    """Links with ``to``, the note they lead to (null if there is none). A target that very many links name is joined where they stand."""
    return hot_join(links_, keys.select(F.col("key").alias("dst"), F.col("k").alias("to")), "dst", "left")


#: The same tables for DuckDB.
KEY = "regexp_replace(lower(trim({0})), '\\.md$', '')"
STEM = "regexp_extract({0}, '[^/]*$')"
VAULT_SQL = f"""
WITH notes0 AS (SELECT *, {KEY.format('path')} AS k, row_number() OVER (PARTITION BY {KEY.format('path')} ORDER BY modified DESC, path DESC) AS rn FROM notes_fts WHERE path IS NOT NULL),
notes AS (SELECT k, path, coalesce(title, regexp_replace({STEM.format('path')}, '(?i)\\.md$', '')) AS title, split_part(k, '/', 1) AS top, modified, created, content, frontmatter FROM notes0 WHERE rn = 1),
links AS (SELECT DISTINCT link_id, {KEY.format('note_path')} AS src, {KEY.format('target')} AS dst, weight, weight_updated_at AS wt FROM note_links WHERE note_path IS NOT NULL AND target IS NOT NULL),
ents AS (SELECT DISTINCT id, name, name_lower, path, category, hub_score, description, CASE WHEN json_valid(aliases_json) AND json_type(aliases_json) = 'ARRAY' THEN from_json(aliases_json, '["VARCHAR"]') ELSE [] END AS aliases FROM entities),
enotes AS (SELECT e.name, e.aliases, n.k FROM ents e JOIN notes n ON n.k = {KEY.format('e.path')}),
keys0 AS (SELECT k AS key, 0 AS prio, k FROM notes UNION ALL SELECT {STEM.format('k')}, 1, k FROM notes UNION ALL SELECT {KEY.format('name')}, 2, k FROM enotes UNION ALL SELECT {KEY.format('a')}, 3, k FROM (SELECT unnest(aliases) AS a, k FROM enotes)),
keys AS (SELECT key, k FROM (SELECT key, k, row_number() OVER (PARTITION BY key ORDER BY prio, k) AS rn FROM keys0 WHERE key <> '') WHERE rn = 1),
res AS (SELECT l.*, keys.k AS target_k FROM links l LEFT JOIN keys ON keys.key = l.dst)
"""
