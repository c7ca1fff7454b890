"""Evaluation texts that leak into a corpus, by a prefix-filtered set join with exact verification.

Every item is cut into windows of ``WINDOW`` words (the whole item if it is shorter). A document contains a window only if it has all
of the window's words, so one necessary word per window is enough as its prefix: the rarest by document frequency over the whole
corpus. At each occurrence of a prefix word the window's place in the document is fixed by the word's offset (positional bound); it must
lie inside the document (length bound) and equal the window exactly.

Items of at most ``SENT_LETTERS`` letters (counted first) go to the tasks as an index by prefix word, and the corpus isn't shuffled. More
items are joined: occurrences of prefix words, kept by a bitmap of fixed size, meet the windows on the prefix word. Either way the corpus is
read twice, for the frequencies and for the matches, whatever the number of items, and both give the same rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wherry.session import cut

WINDOW = 13
#: The most letters of items whose index is sent to the tasks: an index of some 100 MB.
SENT_LETTERS = 2_000_000
#: Bits of the map of prefix words, a power of two; words a task counts before it sends them on.
BITS, COUNTED = 1 << 26, 500_000
_WORDS = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Runs of letters and digits, lower-cased."""
    return _WORDS.findall(text.lower())


def windows(ws: list[str], size: int = WINDOW) -> list[tuple[str, ...]]:
    """All windows of an item; an item with fewer words is one window, an item without words none."""
    if not ws:
        return []
    return [tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))]


def word_frequency(docs: DataFrame, text: str, vocabulary: set[str]) -> dict[str, int]:
    """Documents of the whole corpus with each word of a bounded vocabulary. Counted within tasks, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for b in batches:
            for t in b.column(0):
                if t.is_valid:
                    seen.update(vocabulary.intersection(words(t.as_py())))
        if seen:
            yield pa.RecordBatch.from_pydict({"w": list(seen), "n": pa.array(seen.values(), pa.int64())})

    counted = docs.select(F.col(text).cast("string")).mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n"))
    return dict(map(tuple, counted.collect()))


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, size: int = WINDOW) -> DataFrame:
    """``doc_id, item_id, n_windows`` (distinct windows of the item in the document) and ``coverage`` (their share of the item's windows).

    Null and wordless texts leak nothing, repeated rows count once, an item that stands in a document many times gives one row, several texts
    of one item id are windows of one item, other columns are not read.
    """
    known = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where(F.col("i").isNotNull() & F.col("t").isNotNull()).distinct()
    letters = known.agg(F.sum(F.length("t").cast("long") + 1)).first()[0]
    if not letters:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_windows int, coverage double")
    if letters <= SENT_LETTERS:
        out = _block(docs, doc_id, text, [tuple(r) for r in known.collect()], size)
        return out.groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.max("coverage").alias("coverage"))
    return _joined(docs, doc_id, text, known, size)


def _item_windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = list(set(windows(words(t), size)))
                for k in range(0, len(ws), 5000):
                    part = ws[k : k + 5000]
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(part), pa.int64()), pa.array([list(w) for w in part], pa.list_(pa.string()))], names=["i", "x"])

    return run


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each word, counted within a task."""

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["w", "n"])

    seen: Counter[str] = Counter()
    for b in batches:
        for t in b.column(0):
            if t.is_valid:
                seen.update(set(words(t.as_py())))
                if len(seen) > COUNTED:
                    yield out()
                    seen = Counter()
    if seen:
        yield out()


def _bit(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) & (BITS - 1)


def _occurrences(bitmap: bytes, size: int):
    """``doc_id, w, at, a``: each occurrence of what may be a prefix word, with the words around it and its place among them."""
    import numpy as np

    bits = np.frombuffer(bitmap, dtype=np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for b in batches:
            d_out, w_out, at_out, a_out = [], [], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                if d is None or not t.is_valid:
                    continue
                ws = words(t.as_py())
                for p, w in enumerate(ws):
                    if (yes := known.get(w)) is None:
                        k = _bit(w)
                        yes = known[w] = bool(bits[k >> 3] >> (k & 7) & 1)
                    if yes:
                        low = max(0, p - size + 1)
                        d_out.append(d)
                        w_out.append(w)
                        at_out.append(p - low)
                        a_out.append(ws[low : p + size])
                if len(known) > COUNTED:
                    known.clear()
                if len(d_out) > 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(d_out, pa.int64()), pa.array(w_out), pa.array(at_out, pa.int32()), pa.array(a_out, pa.list_(pa.string()))], names=["doc_id", "w", "at", "a"])
                    d_out, w_out, at_out, a_out = [], [], [], []
            if d_out:
                yield pa.RecordBatch.from_arrays([pa.array(d_out, pa.int64()), pa.array(w_out), pa.array(at_out, pa.int32()), pa.array(a_out, pa.list_(pa.string()))], names=["doc_id", "w", "at", "a"])

    return run


def _joined(docs: DataFrame, doc_id: str, text: str, known: DataFrame, size: int) -> DataFrame:
    """The same by joins, for items of any number."""
    win = cut(known.mapInArrow(_item_windows(size), "i long, x array<string>").distinct())
    totals = win.groupBy("i").agg(F.count(F.lit(1)).alias("total"))
    distinct = win.select("x").distinct()
    texts = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string"))
    freq = texts.select(F.col(text)).mapInArrow(_count_words, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    # a window with a word that no document has stands in none
    ranked = distinct.select("x", F.posexplode("x").alias("p", "w")).join(freq, "w", "left").groupBy("x").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w", "p")).alias("r"))
    prefix = cut(ranked.where(F.col("r.n") > 0).select("x", F.col("r.w").alias("w"), F.col("r.p").alias("p")))
    bit_of = F.pandas_udf(lambda w: w.map(_bit), "long")
    bits = prefix.select("w").distinct().select(bit_of("w").alias("b"))
    marks = bits.groupBy((F.col("b") / 32768).cast("long").alias("k")).agg(F.bitmap_construct_agg(F.col("b") % 32768).alias("m")).collect()  # at most BITS / 32768 rows of 4 KB
    bitmap = bytearray(BITS // 8)
    for r in marks:
        bitmap[r["k"] * 4096 : r["k"] * 4096 + 4096] = r["m"]
    hits = texts.mapInArrow(_occurrences(bytes(bitmap), size), "doc_id long, w string, at int, a array<string>")
    start = F.col("at") - F.col("p")
    met = hits.join(prefix, "w").where((start >= 0) & (F.slice("a", start + 1, F.size("x")) == F.col("x"))).select("doc_id", "x").distinct()
    found = met.join(win, "x").groupBy("doc_id", F.col("i").alias("item_id")).agg(F.count(F.lit(1)).cast("int").alias("n_windows"))
    return found.join(totals.withColumnRenamed("i", "item_id"), "item_id").select("doc_id", "item_id", "n_windows", (F.col("n_windows") / F.col("total")).alias("coverage"))


def _block(docs: DataFrame, doc_id: str, text: str, items: list[tuple[int, str]], size: int) -> DataFrame:
    """The same with the items' index sent to the tasks."""
    pieces: dict[int, set[tuple[str, ...]]] = {}
    for i, t in items:
        pieces.setdefault(i, set()).update(windows(words(t), size))
    vocabulary = {w for ws in pieces.values() for x in ws for w in x}
    df = word_frequency(docs, text, vocabulary)
    # prefix word -> windows: (offset of the word, window, items with it)
    index: dict[str, dict[tuple[str, ...], list]] = {}
    n_windows = {i: len(ws) for i, ws in pieces.items()}
    for i, ws in sorted(pieces.items()):
        for x in ws:
            rare = min(range(len(x)), key=lambda p: (df.get(x[p], 0), x[p], p))
            index.setdefault(x[rare], {}).setdefault(x, [rare, []])[1].append(i)
    index = {w: {x: e for x, e in g.items()} for w, g in index.items() if df.get(w, 0)}
    prefix = frozenset(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d_out, i_out, n_out, c_out = [], [], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                if d is None or not t.is_valid:
                    continue
                ws = words(t.as_py())
                if prefix.isdisjoint(ws):
                    continue
                found: dict[int, set] = {}
                for p, w in enumerate(ws):
                    if w not in prefix:
                        continue
                    for x, (off, ids) in index[w].items():
                        s = p - off
                        if s < 0 or s + len(x) > len(ws) or tuple(ws[s : s + len(x)]) != x:
                            continue
                        for i in ids:
                            found.setdefault(i, set()).add(x)
                for i, xs in found.items():
                    d_out.append(d)
                    i_out.append(i)
                    n_out.append(len(xs))
                    c_out.append(len(xs) / n_windows[i])
            if d_out:
                yield pa.RecordBatch.from_arrays([pa.array(d_out, pa.int64()), pa.array(i_out, pa.int64()), pa.array(n_out, pa.int32()), pa.array(c_out, pa.float64())], names=["doc_id", "item_id", "n_windows", "coverage"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, item_id long, n_windows int, coverage double")
