"""Links written into prose: mentions of entities found by one automaton pass, outside protected zones, the longest first and never overlapping.

The dictionary is bounded: up to ``MOST_PATTERNS`` it goes to the tasks with their code; a larger one is cut into blocks, each with its own
pass, and the mentions of all blocks are reconciled per text, so no size of dictionary is refused.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_PATTERNS = 100_000
#: Zones of a text in which nothing is linked: frontmatter, fences, code spans, links, addresses, comments, headings.
ZONES = re.compile(r"\A---\n.*?\n---(?:\n|\Z)|^[ \t]*(?:```|~~~).*?(?:^[ \t]*(?:```|~~~)[^\n]*$|\Z)|`[^`\n]*`|!?\[\[[^\]]*\]\]|\[[^\]\n]*\]\([^)\n]*\)|https?://\S+|<!--.*?-->|%%.*?%%|^#{1,6} [^\n]*$", re.S | re.M)
MENTIONS = "key long, start int, stop int, entity_id long"


def zones(text: str) -> list[tuple[int, int]]:
    """Protected stretches in order, without overlap."""
    return [m.span() for m in ZONES.finditer(text)]


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def mentions_in(text: str, machine: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """``(start, stop, entity id)`` of whole-word mentions outside the zones, whatever their case, longest first among those that overlap, then the earlier."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose small form is longer; positions would shift
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    closed = zones(text)
    starts = [a for a, _ in closed]
    found = []
    for end, (n, ident) in machine.iter(low) if len(machine) else ():
        a, b = end - n + 1, end + 1
        if (a and _word(low[a - 1])) or (b < len(low) and _word(low[b])):
            continue
        z = bisect_right(starts, b - 1) - 1  # the last zone that starts before the mention's end
        if z < 0 or closed[z][1] <= a:
            found.append((a, b, ident))
    return longest_first(found)


def longest_first(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of overlapping mentions the longest, then the earlier, then the smaller id."""
    begins: list[int] = []
    taken: dict[int, tuple[int, int, int]] = {}
    for a, b, ident in sorted(found, key=lambda m: (m[0] - m[1], m[0], m[2])):
        i = bisect_right(begins, a)
        if (i and taken[begins[i - 1]][1] > a) or (i < len(begins) and begins[i] < b):
            continue
        begins.insert(i, a)
        taken[a] = (a, b, ident)
    return [taken[a] for a in begins]


def machine(patterns: list[tuple[str, int]]) -> ahocorasick.Automaton:
    """Automaton over lower-cased patterns; of several owners of a pattern the smallest id."""
    m = ahocorasick.Automaton()
    for p, i in sorted(patterns, key=lambda x: (x[0].lower(), -x[1])):
        if len(p) > 1:
            m.add_word(p.lower(), (len(p), i))
    m.make_automaton()
    return m


def find_mentions(texts: DataFrame, key: str, text: str, patterns: DataFrame, most: int = MOST_PATTERNS) -> DataFrame:
    """``key, start, stop, entity_id`` of the mentions of ``patterns(pattern, id)``. Null texts and patterns are left out; an empty dictionary gives none."""
    p = patterns.where(F.col("pattern").isNotNull() & (F.length("pattern") > 1) & F.col("id").isNotNull()).select("pattern", F.col("id").cast("long").alias("id")).distinct()
    n = p.count()
    spark = texts.sparkSession
    if n == 0:
        return spark.createDataFrame([], MENTIONS)
    blocks = -(-n // most)
    out = None
    for b in range(blocks):
        block = p if blocks == 1 else p.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == b)
        pairs = [tuple(r) for r in block.collect()]  # at most about ``most`` patterns
        part = texts.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(_finder(pairs), MENTIONS)
        out = part if out is None else out.unionByName(part)
    return out if blocks == 1 else _reconciled(out)


def _reconciled(found: DataFrame) -> DataFrame:
    """Mentions of several blocks without overlap; a group holds the mentions of one text."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = longest_first(list(zip(pdf["start"], pdf["stop"], pdf["entity_id"])))
        return pd.DataFrame({"key": pdf["key"].iloc[0], "start": [r[0] for r in rows], "stop": [r[1] for r in rows], "entity_id": [r[2] for r in rows]})

    return found.groupBy("key").applyInPandas(run, MENTIONS)


def _finder(pairs: list[tuple[str, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(pairs)
        for b in batches:
            rows = [(k, *x) for k, t in zip(b.column(0).to_pylist(), b.column(1)) if k is not None and t.is_valid for x in mentions_in(t.as_py(), m)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.int64()))], names=["key", "start", "stop", "entity_id"])

    return run


def first_mentions(found: DataFrame) -> DataFrame:
    """Of each entity only its first mention in a text."""
    w = Window.partitionBy("key", "entity_id").orderBy("start")
    return found.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def apply_links(texts: DataFrame, key: str, text: str, found: DataFrame, names: DataFrame) -> DataFrame:
    """``key, text``: texts with their mentions written as links, ``[[Name]]`` or ``[[Name|as it stands]]``. Texts without a mention are left out."""
    named = found.join(names.select(F.col("id").alias("entity_id"), "name"), "entity_id")
    per = named.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "name"))).alias("ms"))
    j = texts.select(F.col(key).cast("long").alias("key"), F.col(text).alias("t")).join(per, "key")
    link = lambda m: F.when(F.substr("t", m["start"] + 1, m["stop"] - m["start"]) == m["name"], F.concat(F.lit("[["), m["name"], F.lit("]]"))).otherwise(F.concat(F.lit("[["), m["name"], F.lit("|"), F.substr("t", m["start"] + 1, m["stop"] - m["start"]), F.lit("]]")))
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    built = F.aggregate("ms", zero, lambda s, m: F.struct(F.concat(s["out"], F.substr("t", s["at"] + 1, m["start"] - s["at"]), link(m)).alias("out"), m["stop"].alias("at")), lambda s: F.concat(s["out"], F.substr("t", s["at"] + 1, F.length("t"))))
    return j.select("key", built.alias("text"))
