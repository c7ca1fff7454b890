"""Nested JSON into flat related tables by one depth-first pass.

A visitor walks each parsed record once, depth first, and emits one tagged row for every child element: the table's tag, the element's
key, its parent's key, its position and its payload as JSON. Keys are paths of positions under the record's own key, so a child names
its parent without any counter shared between tasks, and a record that is read again after a lost executor yields the same keys. The rows are
written partitioned by tag, and a schema is applied to the payload of one tag when that table is read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A level of a specification: where to look below the parent, the tag of its elements, and the levels below those.
#: ``text_is_leaf``: a plain text in place of an array has no elements. ``pair``: elements are pairs of a key and an array; the
#: children are the array's elements and the pair itself is no row.
Level = dict[str, Any]

TAGGED = "src string, rec_id long, tag string, pk string, parent_pk string, pos int, sub_pos int, payload string"
_ARROW = pa.schema([("src", pa.string()), ("rec_id", pa.int64()), ("tag", pa.string()), ("pk", pa.string()), ("parent_pk", pa.string()), ("pos", pa.int32()), ("sub_pos", pa.int32()), ("payload", pa.string())])

MESSAGE_LEVELS: list[Level] = [{"at": ("content",), "tag": "content", "below": [{"at": ("content",), "tag": "content.content", "text_is_leaf": True}]}]
SERVER_LEVELS: list[Level] = [{"at": (), "tag": "mcp_servers", "below": [{"at": ("tools",), "tag": "mcp_servers.tools"}]}]
CACHE_LEVELS: list[Level] = [
    {
        "at": ("notes",),
        "tag": "notes",
        "below": [
            {"at": ("outlinks",), "tag": "notes.outlinks"},
            {"at": ("aliases",), "tag": "notes.aliases"},
            {"at": ("tags",), "tag": "notes.tags"},
            {"at": ("frontmatter", "attendees"), "tag": "notes.frontmatter.attendees"},
        ],
    },
    {"at": ("backlinks",), "tag": "backlinks", "pair": True},
]


def parse(text: str | None) -> Any:
    """The value of a JSON text, decoded once more if it was encoded twice; ``None`` if it doesn't parse."""
    if not text:
        return None
    try:
        v = json.loads(text)
        return json.loads(v) if isinstance(v, str) else v
    except (ValueError, RecursionError):
        return None


def _elements(v: Any, text_is_leaf: bool = False) -> list[Any]:
    """An array as it is, a bare value as an array of one, null or (where text is a leaf) plain text as none."""
    if v is None or (text_is_leaf and isinstance(v, str)):
        return []
    return v if isinstance(v, list) else [v]


def _reach(v: Any, path: tuple[str, ...]) -> Any:
    for k in path:
        v = v.get(k) if isinstance(v, dict) else None
    return v


def visit(value: Any, levels: list[Level], root: str, parent: str, pos: int | None = None) -> Iterator[tuple[str, str, str, int, int, str]]:
    """Depth-first ``(tag, pk, parent_pk, pos, sub_pos, payload)``; at the first level ``sub_pos`` is -1. Null elements count as positions only."""
    for level in levels:
        tag = level["tag"]
        for i, x in enumerate(_elements(_reach(value, level["at"]), level.get("text_is_leaf", False))):
            if x is None:
                continue
            if level.get("pair"):
                if isinstance(x, list) and len(x) > 1:
                    for j, y in enumerate(_elements(x[1])):
                        if y is not None:
                            yield tag, f"{root}/{tag}:{i}.{j}", parent, i, j, json.dumps({"key": x[0], "value": y}, ensure_ascii=False)
                continue
            here = (i, -1) if pos is None else (pos, i)
            pk = f"{root}/{tag}:{here[0]}" + (f".{i}" if pos is not None else "")
            yield tag, pk, parent, *here, json.dumps(x, ensure_ascii=False)
            if "below" in level and isinstance(x, dict):
                yield from visit(x, level["below"], root, pk, here[0])


def shred(df: DataFrame, src: str, key: str, columns: dict[str, list[Level]]) -> DataFrame:
    """Tagged rows of the JSON in ``columns`` of ``df``; ``key`` is the record's own integer key.

    Every row is visited once, in its own task, with no shuffle; memory holds one record at a time beside a batch of output. JSON that
    is null, empty, cut off or not JSON has no children; JSON encoded twice is decoded twice. Records repeated exactly come out as often
    as they stand; the queries take distinct rows. Columns other than those named are never read.
    """
    names = list(columns)
    levels = [columns[c] for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for b in batches:
            ids = b.column(0).to_pylist()
            for c, lv in enumerate(levels):
                texts = b.column(c + 1)
                for k, rec in enumerate(ids):
                    if rec is None or not texts[k].is_valid:
                        continue
                    value = parse(texts[k].as_py())
                    if value is None:
                        continue
                    for row in visit(value, lv, f"{src}:{rec}", f"{src}:{rec}"):
                        out.append((src, rec, *row))
                        size += len(row[5])
                        if len(out) >= 20_000 or size > 16_000_000:
                            yield _batch(out)
                            out, size = [], 0
        if out:
            yield _batch(out)

    return df.select(F.col(key).cast("long").alias("k"), *[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(names)]).mapInArrow(run, TAGGED)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def write_tables(tagged: DataFrame, path: str) -> None:
    """All child tables in one write, a folder for each tag."""
    tagged.write.mode("overwrite").partitionBy("src", "tag").parquet(path)


def read_child(spark: SparkSession, path: str, src: str, tag: str, schema: T.StructType | str) -> DataFrame:
    """One child table with its schema: keys and positions, then the payload's fields as ``data``. Only that tag's folder is read."""
    return (
        spark.read.parquet(path)
        .where((F.col("src") == src) & (F.col("tag") == tag))
        .select("rec_id", "pk", "parent_pk", "pos", "sub_pos", F.from_json("payload", schema).alias("data"))
    )


def vault_children(warmup: DataFrame, cache: DataFrame) -> DataFrame:
    """Tagged children of transcripts (``message``, ``mcp_servers``) and index snapshots (``data``)."""
    return shred(warmup, "warmup", "line_id", {"message": MESSAGE_LEVELS, "mcp_servers": SERVER_LEVELS}).unionByName(shred(cache, "vault_index_cache", "id", {"data": CACHE_LEVELS}))
