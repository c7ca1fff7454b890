"""Oversized texts into overlapping pieces that end at natural boundaries, by agglomerative merging.

The text is cut into atomic segments (lines and sentences; words only inside a sentence that is itself too large; single stretches
without white space are cut hard). Every boundary has a strength: hard cut 0, word 1, sentence or line of a fence 2, line 3, blank line 4, heading 5.
A heap holds the adjacent pairs; the weakest boundary is merged first, the smaller result first among equals, as long as the merged
size plus the overlap stays within the limit. What is left are the pieces; each but the first starts ``overlap`` characters early.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 6000, 200
HARD, WORD, SENTENCE, LINE, BLANK, HEADING = range(6)

_END = re.compile(r"[.!?…。！？؟।]+[\"'”’»)\]]*\s+|[。！？]+[”’」』]*|\n+[^\S\n]*\n+|\n")
_WORD = re.compile(r"\s+")
_FENCE = re.compile(r"^\s*(```|~~~)")
_HEADING = re.compile(r"#{1,6}\s")
PIECES = "key string, piece_no int, start int, stop int, ends_at int, kind string, text string"
_ARROW = pa.schema([("key", pa.string()), ("piece_no", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("ends_at", pa.int32()), ("kind", pa.string()), ("text", pa.string())])


def atoms(text: str, cap: int) -> list[tuple[int, int]]:
    """``(stop, strength of the boundary there)`` of the atomic segments, none longer than ``cap``; the last boundary is the text's end."""
    cuts: list[tuple[int, int]] = []
    fenced, line_start, last = False, 0, 0

    def add(stop: int, strength: int) -> None:
        nonlocal last
        if stop <= last:
            return
        if stop - last > cap:
            _words(text, last, stop, cap, cuts)
        cuts.append((stop, strength))
        last = stop

    for m in _END.finditer(text):
        gap, stop = m.group(), m.end()
        if "\n" in gap:
            if _FENCE.match(text, line_start, m.start()) or _FENCE.match(text[line_start : line_start + 8]):
                fenced = not fenced
            line_start = stop
            if fenced:
                strength = SENTENCE
            elif _HEADING.match(text, stop):
                strength = HEADING
            else:
                strength = BLANK if gap.count("\n") > 1 else LINE
        else:
            strength = WORD if fenced else SENTENCE
        add(stop, strength)
    add(len(text), HEADING)
    return cuts


def _words(text: str, start: int, stop: int, cap: int, cuts: list[tuple[int, int]]) -> None:
    """Boundaries inside one segment that is larger than ``cap``: between its words, and hard ones inside a word larger than ``cap``."""
    last = start
    ends = [m.end() for m in _WORD.finditer(text, start, stop)]
    for e in [*ends, stop]:
        while e - last > cap:
            at = last + cap
            while at > last + cap - 64 and (unicodedata.combining(text[at]) or text[at] in "‍️︎" or text[at - 1] == "‍"):
                at -= 1
            cuts.append((at, HARD))
            last = at
        if last < e < stop:
            cuts.append((e, WORD))
            last = e


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """``(start, stop, strength of the boundary at stop)`` of the pieces.

    A text within the limit is one piece, an empty text none. Cores (pieces without their overlap) cover the text without a gap; a piece
    is its core and the ``overlap`` characters before it, never more than ``limit`` together.
    """
    if not text:
        return []
    if len(text) <= limit:
        return [(0, len(text), HEADING)]
    cap = limit - overlap
    if cap <= 0:
        raise ValueError("overlap must be below limit")
    cuts = atoms(text, cap)
    n = len(cuts)
    begin = [0, *(c[0] for c in cuts[:-1])]
    end = [c[0] for c in cuts]
    strength = [c[1] for c in cuts]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    gone = [False] * n
    heap = [(strength[i], end[i + 1] - begin[i], i, i + 1) for i in range(n - 1) if end[i + 1] - begin[i] <= cap]
    heapq.heapify(heap)
    while heap:
        _, size, i, j = heapq.heappop(heap)
        if gone[i] or gone[j] or after[i] != j or end[j] - begin[i] != size:
            continue
        end[i], strength[i], after[i], gone[j] = end[j], strength[j], after[j], True
        if after[i] < n:
            before[after[i]] = i
            if end[after[i]] - begin[i] <= cap:
                heapq.heappush(heap, (strength[i], end[after[i]] - begin[i], i, after[i]))
        if (k := before[i]) >= 0 and end[i] - begin[k] <= cap:
            heapq.heappush(heap, (strength[k], end[i] - begin[k], k, i))
    return [(max(0, begin[i] - overlap), end[i], strength[i]) for i in range(n) if not gone[i]]


def newest_oversized(notes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``path, content`` of the notes whose newest version has more than ``limit`` characters; a path's case doesn't matter.

    Only paths and times of all notes are shuffled; contents are shuffled only where they are over the limit. Null paths and contents
    are left out. Of several oversized rows with the newest time the one with the greatest ``(content, path)`` counts, so exact repeats give one.
    """
    key = F.lower("path")
    newest = notes.select(key.alias("k"), "modified").where(F.col("k").isNotNull()).groupBy("k").agg(F.max("modified").alias("m"))
    big = notes.where(F.char_length("content") > limit).select(key.alias("k"), "modified", "path", "content").where(F.col("k").isNotNull())
    newest = newest.withColumnRenamed("k", "nk")
    kept = big.join(newest, (big["k"] == newest["nk"]) & big["modified"].eqNullSafe(newest["m"]))
    return kept.groupBy("k").agg(F.max(F.struct("content", "path")).alias("x")).select("x.path", "x.content")


def pieces(texts: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """One row for each piece of each text: ``key, piece_no, start, stop, ends_at, kind, text``.

    ``kind`` is ``hard`` if the text has a stretch of more than ``limit`` characters without white space, else ``soft``. Each text is
    split in its own task without any shuffle. Null and empty texts have no pieces; repeated keys are each split; other columns are not read.
    """
    stretch = re.compile(rf"\S{{{limit + 1}}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            held = 0
            for k, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py()
                if not t:
                    continue
                kind = "hard" if stretch.search(t) else "soft"
                for no, (s, e, at) in enumerate(split(t, limit, overlap)):
                    rows.append((k, no, s, e, at, kind, t[s:e] if with_text else None))
                    held += e - s
                if held > 8_000_000:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    return texts.select(F.col(key).cast("string"), F.col(text).cast("string")).mapInArrow(run, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
