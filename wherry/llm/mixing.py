"""Mixing sources to target shares of tokens by Poisson replication.

Each document gets, per mix, a number ``u`` in (0, 1) from a seeded hash of its id, and ``min(F^-1(u; rate), max_repeats)`` copies, where
``F`` is the Poisson distribution with its source's mean repetition rate. Copies depend on the document and the rate alone, so any task can
compute them again. The rate is calibrated: it is the one at which the copies that this seed draws, not those expected, come closest to the
tokens wanted. That takes the noise of the draw out of the shares; the price is that documents of a source are not drawn independently of
one another, and that the rate differs from the expected one by that noise. The drawn copies are then shuffled globally by a hash.

A source that can't give its tokens even with every document at its cap stops there. What it lacks is reported and not taken from others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wherry.session import cut

#: The vocabulary file of a public byte-level BPE and the pattern that cuts text for it (fixed value).
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Bins of the histogram for each halving of 1 - u: equally fine in relation to what is drawn, whether of a large source little or of a small one all.
BINS = 128
#: Targets are read to the driver; more are refused.
MOST_TARGETS = 20_000

_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a vocabulary file, once per process."""
    if path not in _encoders:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_counts(docs: DataFrame, doc_id: str, source: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, n_tokens``: sources without blanks and in lower case, whole texts, null and blank texts with 0 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t and not t.isspace() else 0 for t in (x.as_py() for x in b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    cols = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.lower(F.trim(source)).alias("source"), F.col(text).cast("string").alias("t"))
    return cols.mapInArrow(run, "doc_id long, source string, n_tokens long")


def thresholds(rate: float, cap: int) -> list[float]:
    """``F(0), F(1), ...`` below 1, at most ``cap`` of them: a document has as many copies as thresholds at or below its ``u``."""
    out: list[float] = []
    p = math.exp(-rate)
    total = p
    for k in range(cap):
        if total >= 1 - 2**-52:
            break
        out.append(total)
        p *= rate / (k + 1)
        total += p
    return out


#: Sorted ``u`` and tokens of the bins.
Bins = tuple[np.ndarray, np.ndarray]


def solve_rate(hist: Bins, want: float, cap: int) -> tuple[float, float]:
    """The Poisson rate at which the tokens drawn from the bins come closest to ``want``, and those tokens."""

    us, tokens = hist
    above = np.r_[np.cumsum(tokens[::-1])[::-1], 0.0]  # tokens at or above each bin

    def drawn(rate: float) -> float:
        return float(above[np.searchsorted(us, thresholds(rate, cap))].sum())

    most = 60.0 + 3.0 * cap

    def edge(reached) -> float:
        """The least rate whose tokens are ``reached``; they grow with the rate."""
        low, high = 0.0, most
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if reached(drawn(mid)) else (mid, high)
        return high

    if drawn(most) <= want:
        return most, drawn(most)
    over = edge(lambda t: t >= want)
    near = min((drawn(over), drawn(over * (1 - 1e-9))), key=lambda t: abs(t - want))
    # the middle of the rates that draw these tokens: no document's u lies at a threshold there
    rate = (edge(lambda t: t >= near) + edge(lambda t: t > near)) / 2
    return rate, drawn(rate)


def histogram(counts: DataFrame, named: list[tuple[str, str]], seed: int) -> dict[tuple[str, str], Bins]:
    """``(u, tokens)`` bins of each mix and source: at most targets x BINS x log2(documents) rows reach the driver."""
    spark = counts.sparkSession
    keys = spark.createDataFrame(named, "mix string, source string")
    x = counts.where(F.col("n_tokens") > 0).join(F.broadcast(keys), "source")
    bins = x.groupBy("mix", "source", F.floor(-F.log2(1 - draw(seed)) * BINS).cast("int").alias("bin")).agg(F.sum("n_tokens").alias("t"))
    got = bins.toArrow().to_pandas()  # columns of numbers, not rows of objects
    got["u"] = 1 - 2.0 ** (-(got["bin"] + 0.5) / BINS)
    return {k: (g["u"].to_numpy(), g["t"].to_numpy(dtype="float64")) for k, g in got.sort_values("u").groupby(["mix", "source"])}


def clean_targets(targets: DataFrame) -> list[tuple[str, str, float, int]]:
    """``(mix, source, weight, max_repeats)``: sources without blanks and in lower case, null, zero and negative weights left out.

    Of several rows of a source in a mix the largest weight and cap count. A null cap is 1.
    """
    t = targets.select("mix", F.lower(F.trim("source")).alias("source"), F.col("weight").cast("double").alias("w"), F.coalesce(F.col("max_repeats").cast("int"), F.lit(1)).alias("m"))
    t = t.where(F.col("mix").isNotNull() & F.col("source").isNotNull() & (F.col("w") > 0) & ~F.isnan("w") & (F.col("m") > 0))
    rows = t.groupBy("mix", "source").agg(F.max("w"), F.max("m")).orderBy("mix", "source").limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    return [tuple(r) for r in rows]


PLAN = "mix string, source string, weight double, max_repeats int, share double, want double, rate double, cdf array<double>"


def plan_mix(counts: DataFrame, targets: DataFrame, seed: int = 0, total: float | None = None, exact_shares: bool = False) -> DataFrame:
    """Per mix and source: ``share`` asked for, ``want`` tokens, ``rate`` and ``cdf``; no rows if there is nothing to draw.

    Weights are scaled to shares of the sources that have tokens; sources without documents get no share. ``total`` is the mix's size in
    tokens; by default it is that of the documents of the mix's sources. With ``exact_shares`` and no ``total`` the mix is instead as large
    as its scarcest source allows, so that no source needs more than its capped repeats.
    """
    spark = counts.sparkSession
    rows = clean_targets(targets)
    if not rows:
        return spark.createDataFrame([], PLAN)
    hist = histogram(counts, [(m, s) for m, s, _, _ in rows], seed)
    size = {k: float(t.sum()) for k, (_, t) in hist.items()}
    plan = []
    for mix in sorted({r[0] for r in rows}):
        mine = [r[1:] for r in rows if r[0] == mix]
        there = [(s, w, c) for s, w, c in mine if size.get((mix, s))]
        weight = sum(w for _, w, _ in there)
        if total is not None:
            goal = total
        elif exact_shares:
            goal = min((c * size[mix, s] * weight / w for s, w, c in there), default=0.0)
        else:
            goal = sum(size[mix, s] for s, _, _ in there)
        for s, w, c in mine:
            if not size.get((mix, s)):
                plan.append((mix, s, w, c, 0.0, 0.0, 0.0, []))
                continue
            want = goal * w / weight
            rate, _ = solve_rate(hist[mix, s], want, c)
            plan.append((mix, s, w, c, w / weight, want, rate, thresholds(rate, c)))
    return spark.createDataFrame(plan, PLAN)


def draw(seed: int) -> Column:
    """A number in (0, 1) from the hash of seed, mix and document."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("mix"), F.col("doc_id")), 11).cast("double")
    return (h + 0.5) / F.lit(float(2**53))


def replicate(counts: DataFrame, plan: DataFrame, seed: int = 0) -> DataFrame:
    """One row per copy: ``mix, source, doc_id, copy_no, n_tokens, order_key``, in the global order of ``order_key`` within each mix.

    The plan has one row per target (at most ``MOST_TARGETS``) and is broadcast. A document is repeated at most its source's cap.
    """
    joined = counts.where(F.col("n_tokens") > 0).join(F.broadcast(plan.where(F.size("cdf") > 0).select("mix", "source", "cdf")), "source")
    copies = joined.withColumn("u", draw(seed)).withColumn("n", F.size(F.filter("cdf", lambda c: c <= F.col("u")))).where(F.col("n") > 0)
    flat = copies.select("mix", "source", "doc_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy_no"), "n_tokens")
    flat = flat.withColumn("order_key", F.xxhash64(F.lit(seed + 1), "mix", "doc_id", "copy_no"))
    return flat.repartitionByRange("mix", "order_key").sortWithinPartitions("mix", "order_key", "doc_id")


def mixed(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 0, total: float | None = None, tokenizer: str = TOKENIZER, exact_shares: bool = False) -> tuple[DataFrame, DataFrame]:
    """The drawn copies and the plan. Every text is tokenized once, whole; the sizes are written to the shared folder and read from there.

    Rows of the same id count once (the largest); null ids and sources, blank texts and sources left out of a mix aren't drawn.
    Repeated texts under new ids are documents of their own. Empty tables give empty results.
    """
    counts = token_counts(docs, doc_id, source, text, tokenizer).where(F.col("doc_id").isNotNull())
    counts = cut(counts.groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source")).alias("x")).select("doc_id", "x.source", "x.n_tokens"))
    plan = plan_mix(counts, targets, seed, total, exact_shares)
    return replicate(counts, plan, seed), plan


def actual_shares(copies: DataFrame, plan: DataFrame) -> DataFrame:
    """Per mix and source the share asked for and the one drawn, with tokens wanted, drawn and lacking, documents, copies and the most copies of a document.

    ``capped`` says that every document of the source stands in the mix as often as allowed and the tokens still don't suffice.
    """
    per_doc = copies.groupBy("mix", "source", "doc_id").agg(F.max("copy_no").alias("c"), F.sum("n_tokens").alias("t"))
    got = per_doc.groupBy("mix", "source").agg(F.sum("t").alias("n_tokens"), F.count(F.lit(1)).alias("n_docs"), F.sum("c").alias("n_copies"), F.max("c").alias("most_copies"), F.min("c").alias("least"))
    all_ = got.groupBy("mix").agg(F.sum("n_tokens").alias("total"))
    j = plan.join(got, ["mix", "source"], "left").join(all_, "mix", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    lacking = F.greatest(F.col("want") - F.coalesce("n_tokens", F.lit(0)), F.lit(0.0))
    capped = F.coalesce((F.col("least") >= F.col("max_repeats")) & (F.col("want") > F.col("n_tokens")), F.lit(False))
    return j.select(
        "mix", "source", "weight", "max_repeats", F.col("share").alias("target_share"), F.coalesce(F.col("n_tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"),
        F.round("want").cast("long").alias("want_tokens"), z("n_tokens"), F.round(lacking).cast("long").alias("lacking_tokens"), capped.alias("capped"), z("n_docs"), z("n_copies"), z("most_copies"), "rate",
    )
