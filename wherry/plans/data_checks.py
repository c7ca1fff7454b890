"""Queries of the core data-quality operators (orphan references, nested records) and their SQL."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wherry.operators.orphans import orphans_by_period, vault_orphans
from wherry.operators.shred import read_child, vault_children, write_tables
from wherry.session import ensure_checkpoint_dir, table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return vault_orphans(
        table(spark, d, "notes_fts").select("path", "created", "modified"),
        table(spark, d, "file_events").select("path", "type"),
        table(spark, d, "entities").select("id", "name", "path", "aliases_json"),
        table(spark, d, "note_links").select("link_id", "note_path", "target", "weight_updated_at"),
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every orphan reference of the vault."""
    return _orphans(spark, d).select("src", "field", "ref_id", "kind").distinct()


def p1_by_month(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references by table, field, kind and month."""
    return orphans_by_period(_orphans(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Every child element with its record and positions."""
    t = vault_children(table(spark, d, "warmup"), table(spark, d, "vault_index_cache"))
    return t.select("src", "rec_id", F.col("tag").alias("child"), "pos", "sub_pos").distinct()


def p7_tool_results(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of transcripts joined to their own elements through the written child tables, counted by block type and element type."""
    # one folder for each application and input: a repeated run replaces it
    path = f"{ensure_checkpoint_dir(spark)}/children-{spark.sparkContext.applicationId}-{zlib.crc32(d.encode())}"
    write_tables(vault_children(table(spark, d, "warmup"), table(spark, d, "vault_index_cache")).distinct(), path)
    blocks = read_child(spark, path, "warmup", "content", "type string, tool_use_id string, name string")
    parts = read_child(spark, path, "warmup", "content.content", "type string")
    return (
        blocks.join(parts.select(F.col("parent_pk").alias("pk"), F.col("data.type").alias("part_type"), F.lit(1).alias("n")), "pk", "left")
        .groupBy(F.col("data.type").alias("block_type"), "part_type")
        .agg(F.countDistinct("pk").alias("n_blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_parts"))
    )


_KEY = "regexp_replace(lower(trim({0})), '\\.md$', '')"
_P1 = f"""
WITH gone AS (SELECT DISTINCT {_KEY.format('path')} AS name FROM file_events WHERE type = 'unlink'),
parts AS (SELECT name FROM entities WHERE name IS NOT NULL UNION ALL
  SELECT unnest(from_json(aliases_json, '["VARCHAR"]')) FROM entities WHERE json_valid(aliases_json) AND json_type(aliases_json) = 'ARRAY'),
ents AS (SELECT DISTINCT {_KEY.format('name')} AS name FROM parts WHERE name IS NOT NULL),
newest AS (SELECT n.name, (SELECT any_value(created) FROM (SELECT {_KEY.format('path')} AS k, created, modified FROM notes_fts) v WHERE v.k = n.name AND v.modified = n.m) AS created
  FROM (SELECT {_KEY.format('path')} AS name, max(modified) AS m FROM notes_fts GROUP BY 1) n),
stems AS (SELECT regexp_extract(name, '[^/]*$') AS stem, CASE WHEN count(*) = count(created) THEN min(created) END AS created FROM newest GROUP BY 1),
gstems AS (SELECT DISTINCT regexp_extract(name, '[^/]*$') AS stem FROM gone),
links AS (SELECT DISTINCT link_id, note_path, target, weight_updated_at AS wt FROM note_links),
refs AS (
  SELECT 'note_links' AS src, 'note_path' AS field, link_id AS ref_id, {_KEY.format('note_path')} AS k, wt FROM links WHERE note_path IS NOT NULL
  UNION ALL SELECT 'entities', 'path', id, {_KEY.format('path')}, NULL FROM (SELECT DISTINCT id, path FROM entities) WHERE path IS NOT NULL),
a AS (SELECT src, field, ref_id, r.wt, CASE WHEN n.name IS NOT NULL THEN (CASE WHEN src = 'note_links' AND n.created > r.wt THEN 'late' END)
    WHEN g.name IS NOT NULL THEN 'deleted' ELSE 'missing' END AS kind
  FROM refs r LEFT JOIN newest n ON n.name = r.k LEFT JOIN gone g ON g.name = r.k),
b AS (SELECT 'note_links' AS src, 'target' AS field, link_id AS ref_id, l.wt, CASE WHEN e.name IS NOT NULL THEN NULL
    WHEN n.name IS NOT NULL THEN (CASE WHEN n.created > l.wt THEN 'late' END)
    WHEN s.stem IS NOT NULL THEN (CASE WHEN s.created > l.wt THEN 'late' END)
    WHEN g.name IS NOT NULL OR gs.stem IS NOT NULL THEN 'deleted' ELSE 'missing' END AS kind
  FROM (SELECT *, {_KEY.format('target')} AS k FROM links WHERE target IS NOT NULL) l
  LEFT JOIN ents e ON e.name = l.k LEFT JOIN newest n ON n.name = l.k LEFT JOIN stems s ON s.stem = l.k
  LEFT JOIN gone g ON g.name = l.k LEFT JOIN gstems gs ON gs.stem = l.k),
found AS (SELECT DISTINCT src, field, ref_id, kind, wt FROM (SELECT src, field, ref_id, kind, wt FROM a UNION ALL SELECT src, field, ref_id, kind, wt FROM b) WHERE kind IS NOT NULL)
"""
_P7 = """
WITH w AS (SELECT DISTINCT line_id, message, mcp_servers FROM warmup),
m AS (SELECT line_id, CASE WHEN json_valid(j) THEN j::JSON END AS j FROM (SELECT line_id, CASE WHEN json_type(message) = 'VARCHAR' THEN message::JSON ->> '$' ELSE message END AS j FROM w WHERE json_valid(message))),
c AS (SELECT line_id, json_extract(j, '$.content') AS c FROM m WHERE json_type(j) = 'OBJECT'),
blocks AS (SELECT line_id, i AS pos, b FROM (SELECT line_id, unnest(CASE json_type(c) WHEN 'ARRAY' THEN c::JSON[] ELSE [c] END) AS b, unnest(range(CASE json_type(c) WHEN 'ARRAY' THEN json_array_length(c)::BIGINT ELSE 1 END)) AS i FROM c WHERE c IS NOT NULL AND json_type(c) <> 'NULL')),
kids AS (SELECT line_id, pos, json_extract(b, '$.content') AS c FROM blocks WHERE json_type(b) = 'OBJECT'),
parts AS (SELECT line_id, pos, unnest(CASE json_type(c) WHEN 'ARRAY' THEN c::JSON[] ELSE [c] END) AS b, unnest(range(CASE json_type(c) WHEN 'ARRAY' THEN json_array_length(c)::BIGINT ELSE 1 END)) AS i FROM kids WHERE c IS NOT NULL AND json_type(c) NOT IN ('NULL', 'VARCHAR')),
s0 AS (SELECT line_id, mcp_servers::JSON AS c FROM w WHERE json_valid(mcp_servers)),
s AS (SELECT line_id, unnest(CASE json_type(c) WHEN 'ARRAY' THEN c::JSON[] ELSE [c] END) AS b, unnest(range(CASE json_type(c) WHEN 'ARRAY' THEN json_array_length(c)::BIGINT ELSE 1 END)) AS i FROM s0 WHERE json_type(c) <> 'NULL'),
tk AS (SELECT line_id, i AS pos, json_extract(b, '$.tools') AS c FROM s WHERE json_type(b) = 'OBJECT'),
t AS (SELECT line_id, pos, unnest(CASE json_type(c) WHEN 'ARRAY' THEN c::JSON[] ELSE [c] END) AS b, unnest(range(CASE json_type(c) WHEN 'ARRAY' THEN json_array_length(c)::BIGINT ELSE 1 END)) AS i FROM tk WHERE c IS NOT NULL AND json_type(c) <> 'NULL'),
v AS (SELECT DISTINCT id, data::JSON AS j FROM vault_index_cache WHERE json_valid(data)),
n0 AS (SELECT id, json_extract(j, '$.notes') AS c FROM v WHERE json_type(j) = 'OBJECT'),
n AS (SELECT id, unnest(CASE json_type(c) WHEN 'ARRAY' THEN c::JSON[] ELSE [c] END) AS b, unnest(range(CASE json_type(c) WHEN 'ARRAY' THEN json_array_length(c)::BIGINT ELSE 1 END)) AS i FROM n0 WHERE c IS NOT NULL AND json_type(c) <> 'NULL'),
f0 AS (SELECT id, i AS pos, k.child, json_extract(b, k.path) AS c FROM n, (VALUES ('notes.outlinks', '$.outlinks'), ('notes.aliases', '$.aliases'), ('notes.tags', '$.tags'), ('notes.frontmatter.attendees', '$.frontmatter.attendees')) AS k(child, path) WHERE json_type(b) = 'OBJECT'),
f AS (SELECT id, pos, child, unnest(CASE json_type(c) WHEN 'ARRAY' THEN c::JSON[] ELSE [c] END) AS b, unnest(range(CASE json_type(c) WHEN 'ARRAY' THEN json_array_length(c)::BIGINT ELSE 1 END)) AS i FROM f0 WHERE c IS NOT NULL AND json_type(c) <> 'NULL'),
b0 AS (SELECT id, json_extract(j, '$.backlinks') AS c FROM v WHERE json_type(j) = 'OBJECT'),
b1 AS (SELECT id, unnest(CASE json_type(c) WHEN 'ARRAY' THEN c::JSON[] ELSE [c] END) AS b, unnest(range(CASE json_type(c) WHEN 'ARRAY' THEN json_array_length(c)::BIGINT ELSE 1 END)) AS i FROM b0 WHERE c IS NOT NULL AND json_type(c) <> 'NULL'),
b2 AS (SELECT id, i AS pos, json_extract(b, '$[1]') AS c FROM b1 WHERE json_type(b) = 'ARRAY'),
b3 AS (SELECT id, pos, unnest(CASE json_type(c) WHEN 'ARRAY' THEN c::JSON[] ELSE [c] END) AS b, unnest(range(CASE json_type(c) WHEN 'ARRAY' THEN json_array_length(c)::BIGINT ELSE 1 END)) AS i FROM b2 WHERE c IS NOT NULL AND json_type(c) <> 'NULL')
SELECT src, rec_id, child, CAST(pos AS INTEGER) AS pos, CAST(sub_pos AS INTEGER) AS sub_pos FROM (
SELECT 'warmup' AS src, line_id AS rec_id, 'content' AS child, pos, -1 AS sub_pos FROM blocks WHERE b IS NOT NULL AND json_type(b) <> 'NULL'
UNION ALL SELECT 'warmup', line_id, 'content.content', pos, i FROM parts WHERE b IS NOT NULL AND json_type(b) <> 'NULL'
UNION ALL SELECT 'warmup', line_id, 'mcp_servers', i, -1 FROM s WHERE b IS NOT NULL AND json_type(b) <> 'NULL'
UNION ALL SELECT 'warmup', line_id, 'mcp_servers.tools', pos, i FROM t WHERE b IS NOT NULL AND json_type(b) <> 'NULL'
UNION ALL SELECT 'vault_index_cache', id, 'notes', i, -1 FROM n WHERE b IS NOT NULL AND json_type(b) <> 'NULL'
UNION ALL SELECT 'vault_index_cache', id, child, pos, i FROM f WHERE b IS NOT NULL AND json_type(b) <> 'NULL'
UNION ALL SELECT 'vault_index_cache', id, 'backlinks', pos, i FROM b3 WHERE b IS NOT NULL AND json_type(b) <> 'NULL')
"""

QUERIES = {"p1_found": p1_found, "p1_by_month": p1_by_month, "p7_found": p7_found, "p7_tool_results": p7_tool_results}
SQL = {
    "p1_found": _P1 + "SELECT src, field, ref_id, kind FROM found",
    "p1_by_month": _P1 + "SELECT src, field, kind, strftime(wt, '%Y-%m') AS month, count(*) AS n_refs FROM found GROUP BY 1, 2, 3, 4",
    "p7_found": _P7,
}
