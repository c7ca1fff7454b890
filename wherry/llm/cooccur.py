"""How often items stand together, by stripes, with the log-likelihood ratio of each pair.

Each basket contributes to one associative array (stripe) per item: its later neighbours and their counts. Tasks combine stripes of
many baskets in memory before anything is shuffled; stripes of an item are then merged by key. Items that can't be in any pair wanted
are left out beforehand by exact bounds on their support.

A basket of more than ``BIG`` items is never expanded whole in a task. A pair found in big baskets only must share at least ``min_together``
of them, hence at least one outside the ``min_together - 1`` largest of either item (prefix filter), so the very largest baskets are
not expanded at all and the remaining ones are expanded in square tiles, each its own row. Candidates, from small baskets and from those
tiles, are then counted in all big baskets by joins: the big baskets of the rarer item of a pair are looked up among those of the other. No
row ever holds the baskets of an item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wherry.session import cut, hot_join

BIG, TILE = 2000, 500
#: Pairs combined in a task before its stripes are sent on, and parts into which a stripe's neighbours are divided.
COMBINE, PARTS = 2_000_000, 8
_STRIPES = "a long, part int, na long, bs array<long>, nbs array<long>, cs array<long>"


def _stripe_batches(a: np.ndarray, b: np.ndarray, support: dict[int, int]) -> Iterator[pa.RecordBatch]:
    ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    la, lb = inv[: len(a)], inv[len(a) :]
    keys, counts = np.unique(la * len(ids) + lb, return_counts=True)
    pa_, pb = keys // len(ids), keys % len(ids)
    n = np.array([support[i] for i in ids.tolist()], dtype=np.int64)
    part = ids[pb] % PARTS
    order = np.lexsort((pb, part, pa_))
    pa_, pb, part, counts = pa_[order], pb[order], part[order], counts[order]
    first = np.flatnonzero(np.r_[True, (np.diff(pa_) != 0) | (np.diff(part) != 0)])
    offsets = np.r_[first, len(pa_)].astype(np.int32)

    def lists(values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))

    whole = pa.RecordBatch.from_arrays(
        [pa.array(ids[pa_[first]], pa.int64()), pa.array(part[first].astype(np.int32)), pa.array(n[pa_[first]], pa.int64()), lists(ids[pb]), lists(n[pb]), lists(counts.astype(np.int64))],
        names=["a", "part", "na", "bs", "nbs", "cs"],
    )
    for i in range(0, whole.num_rows, 20_000):
        yield whole.slice(i, 20_000)


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripes of units: ``ids, ns`` of a basket, or the two sides of a tile (``ids2`` not null)."""
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    support: dict[int, int] = {}
    held = 0
    for b in batches:
        for ids, ns, ids2, ns2 in zip(*(b.column(i) for i in range(4))):
            x = np.array(ids.as_py(), dtype=np.int64)
            support.update(zip(x.tolist(), ns.as_py()))
            if ids2.is_valid:
                y = np.array(ids2.as_py(), dtype=np.int64)
                support.update(zip(y.tolist(), ns2.as_py()))
                l, r = np.repeat(x, len(y)), np.tile(y, len(x))
                l, r = np.minimum(l, r), np.maximum(l, r)
            else:
                x.sort()
                i, j = np.triu_indices(len(x), 1)
                l, r = x[i], x[j]
            left.append(l)
            right.append(r)
            held += len(l)
            if held >= COMBINE:
                yield from _stripe_batches(np.concatenate(left), np.concatenate(right), support)
                left, right, support, held = [], [], {}, 0
    if held:
        yield from _stripe_batches(np.concatenate(left), np.concatenate(right), support)


def llr(k11: Column, na: Column, nb: Column, n: Column) -> Column:
    """Dunning's log-likelihood ratio of the two-by-two table of a pair."""

    def h(*ks: Column) -> Column:
        total = sum(ks[1:], ks[0])
        parts = [F.when(k > 0, k * F.log(k / total)).otherwise(F.lit(0.0)) for k in ks]
        return F.when(total > 0, sum(parts[1:], parts[0])).otherwise(F.lit(0.0))

    k11, na, nb, n = (c.cast("double") for c in (k11, na, nb, n))
    k12, k21, k22 = na - k11, nb - k11, n - na - nb + k11
    value = 2 * (h(k11, k12, k21, k22) - h(k11 + k12, k21 + k22) - h(k11 + k21, k12 + k22))
    return F.greatest(value, F.lit(0.0))


def together(rows: DataFrame, basket: str, item: str, min_together: int = 5, min_lift: float = 3.0) -> DataFrame:
    """Pairs ``item_a < item_b`` in at least ``min_together`` baskets and ``min_lift`` times as many as chance: with ``n_ab, n_a, n_b, n_baskets, lift, llr``.

    An item counts once in a basket. Null baskets and items and empty items are left out; rows may repeat. No baskets give no rows. Ties need
    no rule, as every pair above the bounds comes out. Columns beside the two named are not read.
    """
    b = rows.select(F.col(basket).cast("string").alias("basket"), F.col(item).cast("string").alias("item"))
    b = cut(b.where(F.col("basket").isNotNull() & F.col("item").isNotNull() & (F.col("item") != "")).distinct())
    sizes = b.groupBy("basket").count()
    n, largest = sizes.agg(F.count(F.lit(1)), F.coalesce(F.max("count"), F.lit(0))).first()
    # an item in more than N / min_lift baskets is in none of the pairs: n_ab <= n_a, so n_ab * N >= lift * n_a * n_b needs N >= lift * n_b
    items = b.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    items = items.where((F.col("n") >= min_together) & (F.col("n") * F.lit(float(min_lift)) <= F.lit(float(n)) + F.lit(1e-9)))
    items = cut(items.withColumn("id", F.monotonically_increasing_id()))
    coded = hot_join(b, items, "item", "inner").select("basket", "id", "n")
    if largest <= BIG:
        merged = _merge(_units(coded))
    else:
        merged = _with_big(cut(coded), sizes, min_together)
    N = F.lit(int(n))
    lift = F.col("n_ab") * N / (F.col("na") * F.col("nb"))
    kept = merged.where((F.col("n_ab") >= min_together) & (F.col("n_ab") * N >= F.lit(min_lift) * F.col("na") * F.col("nb")))
    names = items.select("id", "item")
    out = kept.join(names.toDF("a", "item_1"), "a").join(names.toDF("b", "item_2"), "b")
    return out.select(
        F.least("item_1", "item_2").alias("item_a"),
        F.greatest("item_1", "item_2").alias("item_b"),
        "n_ab",
        F.when(F.col("item_1") < F.col("item_2"), F.col("na")).otherwise(F.col("nb")).alias("n_a"),
        F.when(F.col("item_1") < F.col("item_2"), F.col("nb")).otherwise(F.col("na")).alias("n_b"),
        N.alias("n_baskets"),
        lift.alias("lift"),
        llr(F.col("n_ab"), F.col("na"), F.col("nb"), N).alias("llr"),
    )


def _units(coded: DataFrame) -> DataFrame:
    """One unit for each basket: its items in one row (at most ``BIG``)."""
    u = coded.groupBy("basket").agg(F.collect_list(F.struct("id", "n")).alias("x")).where(F.size("x") > 1)
    none = F.lit(None).cast("array<long>")
    return u.select(F.col("x.id").alias("ids"), F.col("x.n").alias("ns"), none.alias("ids2"), none.alias("ns2"))


def _merge(units: DataFrame) -> DataFrame:
    """Stripes of all units merged by item: ``a, b, na, nb, n_ab``. The stripes are shuffled once; the sum per neighbour reuses that partitioning."""
    stripes = units.mapInArrow(_emit, _STRIPES).repartition("a", "part")
    flat = stripes.select("a", "part", "na", F.inline(F.arrays_zip("bs", "nbs", "cs")))
    return flat.groupBy("a", "part", F.col("bs").alias("b")).agg(F.max("na").alias("na"), F.max("nbs").alias("nb"), F.sum("cs").alias("n_ab")).drop("part")


def _with_big(coded: DataFrame, sizes: DataFrame, min_together: int) -> DataFrame:
    """The same with baskets above ``BIG`` counted by joins of the candidates."""
    big = sizes.where(F.col("count") > BIG).select(F.col("basket"), F.col("count").alias("size"))
    # hot_join needs one right row per key: the basket's size
    tagged = cut(hot_join(coded, big, "basket", "left"))
    small = _merge(_units(tagged.where(F.col("size").isNull()).select("basket", "id", "n")))
    member = cut(tagged.where(F.col("size").isNotNull()).select("id", "n", "basket", "size"))
    in_big = cut(member.groupBy("id").agg(F.count(F.lit(1)).alias("n_big")))
    # candidates that stand in big baskets only: prefixes without each item's largest min_together - 1 baskets; only those few rows of an item leave a task
    w = Window.partitionBy("id").orderBy(F.desc("size"), F.desc("basket"))
    largest = member.withColumn("r", F.row_number().over(w)).where(F.col("r") < min_together).select("id", "basket")
    often = in_big.where(F.col("n_big") >= min_together).select("id")
    prefix = member.join(often, "id", "left_semi").join(largest, ["id", "basket"], "left_anti") if min_together > 1 else member
    prefix = prefix.select("id", "n", "basket", F.ceil(F.col("size") / TILE).cast("int").alias("tiles"))
    prefix = prefix.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    tiles = prefix.groupBy("basket", "tiles", "tile").agg(F.collect_list(F.struct("id", "n")).alias("x"))
    one = tiles.select("basket", "x", F.col("tile").alias("i"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("j"))
    one = one.select("basket", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), (F.col("i") > F.col("j")).alias("second"), "x")
    pair = one.groupBy("basket", "lo", "hi").agg(F.max(F.when(~F.col("second"), F.col("x"))).alias("x"), F.max(F.when(F.col("second"), F.col("x"))).alias("y"))
    same = F.col("lo") == F.col("hi")
    units = pair.where((same & (F.size("x") > 1)) | (~same & F.col("x").isNotNull() & F.col("y").isNotNull()))
    only_big = _merge(units.select(F.col("x.id").alias("ids"), F.col("x.n").alias("ns"), F.col("y.id").alias("ids2"), F.col("y.n").alias("ns2")))
    cand = small.unionByName(only_big.withColumn("n_ab", F.lit(0).cast("long"))).groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("n_ab").alias("n_small"))
    # counted in all big baskets: those of the rarer item, looked up by (item, basket) among those of the other
    c = cand.join(in_big.toDF("a", "ba"), "a").join(in_big.toDF("b", "bb"), "b")
    first = F.col("ba") <= F.col("bb")
    c = c.select("a", "b", F.when(first, F.col("a")).otherwise(F.col("b")).alias("rare"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("other"))
    m = member.select("id", "basket")
    shared = c.join(m.withColumnRenamed("id", "rare"), "rare").join(m.withColumnRenamed("id", "other"), ["other", "basket"], "left_semi").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_big"))
    return cand.join(shared, ["a", "b"], "left").select("a", "b", "na", "nb", (F.col("n_small") + F.coalesce("n_big", F.lit(0))).alias("n_ab"))


def rank_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """For each item its ``k`` most significant partners by log-likelihood ratio, ties to the smaller name. The ``k`` is the report's size."""
    both = pairs.select(F.col("item_a").alias("item"), F.col("item_b").alias("partner"), "n_ab", "lift", "llr").unionByName(
        pairs.select(F.col("item_b").alias("item"), F.col("item_a").alias("partner"), "n_ab", "lift", "llr")
    )
    w = Window.partitionBy("item").orderBy(F.desc("llr"), "partner")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
