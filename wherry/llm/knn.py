"""The k most similar vectors of every vector: inverted file, product-quantised residuals, asymmetric distances, exact reranking.

An index is fitted on a bounded sample of each group (table and model): coarse centroids by spherical k-means, as many as four times the
root of the group's size, and codebooks for the residuals, one per slice of the dimensions. Every vector is put into the cell of its
nearest centroid with its codes. Every vector asks a fixed number of cells, those of its own nearest centroids, so the share of the group
that it is compared with falls as the group grows. Neighbouring cells form shards of a fixed number of cells; a vector goes once to each
shard that holds one of its cells, which is at most a fixed number of copies whatever the size. In a shard, tables of asymmetric distances
over the codes choose candidates, which are ranked exactly there, and only ids and cosines of the best leave it. A shard's vectors are
held by a task while those that ask stream past in Arrow batches. No side is broadcast but the index, whose size is fixed by the parameters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wherry.session import cut, hot_join


@dataclass(frozen=True)
class Params:
    """``sample``: most vectors of a group that the index is fitted on, of which each centroid needs eight. ``cells``: centroids for each unit
    of the root of the group's size. ``probes``: cells a vector is compared with. ``sub``: dimensions of a slice. ``keep``: vectors of a shard
    ranked exactly. ``shard_cells`` and ``shard``: cells and vectors of a shard that one task holds. ``work``: comparisons by codes in a task,
    as far as that sends a vector to no more tasks than it is asked by."""

    sample: int = 262_144
    cells: float = 4.0
    probes: int = 48
    sub: int = 2
    keep: int = 64
    shard_cells: int = 96
    shard: int = 100_000
    work: int = 15_000_000


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, spherical: bool) -> np.ndarray:
    """k-means; with fewer points than ``k``, the points. Empty clusters keep their centre."""
    if len(x) <= k:
        return x.copy()
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
        if spherical:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Index of the nearest centre of each row, in blocks."""
    half = (c * c).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ c.T - half, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


def _top(sim: np.ndarray, n: int) -> np.ndarray:
    """The columns of the ``n`` greatest numbers of each row, in no order."""
    return np.argpartition(sim, sim.shape[1] - n, axis=1)[:, -n:] if n < sim.shape[1] else np.tile(np.arange(sim.shape[1]), (len(sim), 1))


class Index:
    """Centroids, codebooks and shards of one group."""

    def __init__(self, sample: np.ndarray, total: int, p: Params, asking: np.ndarray | None = None, n_asking: int | None = None, seed: int = 7) -> None:
        """``sample`` of the ``total`` vectors that are searched; ``asking`` is one of the ``n_asking`` that ask (the same if not given)."""
        rng = np.random.default_rng(seed)
        self.dim, self.p = sample.shape[1], p
        k = int(max(1, min(round(p.cells * math.sqrt(total)), len(sample) // 8)))
        self.centroids = _kmeans(sample, k, 8, rng, True)
        k = len(self.centroids)
        cell = _nearest(sample, self.centroids)
        weight = np.bincount(cell, minlength=k) * (total / max(1, len(sample)))
        # the direction of a residual is quantised and its length kept, so that dense cells are as finely resolved as loose ones
        res, _ = self.residuals(sample[:20_000], cell[:20_000])
        self.subs = [slice(i, min(i + p.sub, self.dim)) for i in range(0, self.dim, p.sub)]
        self.books = [_kmeans(res[:, s], 256, 6, rng, False) for s in self.subs]
        # neighbouring centroids together in shards
        want = max(1, math.ceil(k / max(1.0, min(p.shard_cells, p.shard * k / max(1, total)))))
        self.shard_of = _nearest(self.centroids, _kmeans(self.centroids, want, 12, rng, True)).astype(np.int32)
        self.n_shards = int(self.shard_of.max()) + 1
        held = np.bincount(self.shard_of, weights=weight, minlength=self.n_shards)
        self.slices = np.maximum(1, np.ceil(held / (1.5 * p.shard))).astype(np.int64)
        # those that ask a shard are divided among tasks by the work they make
        if asking is None or not len(asking):
            asking, n_asking = sample, total
        asking = asking[:20_000]
        scale = n_asking / len(asking)
        pairs, asks = np.zeros(self.n_shards), np.zeros(self.n_shards)
        for i in range(0, len(asking), 4096):
            cells = self.probed(asking[i : i + 4096])
            of = self.shard_of[cells]
            np.add.at(pairs, of.ravel(), weight[cells].ravel())
            row = np.repeat(np.arange(len(cells)), cells.shape[1])
            asks += np.bincount(np.unique(row * self.n_shards + of.ravel()) % self.n_shards, minlength=self.n_shards)
        by_work = np.ceil(pairs * scale / self.slices / p.work)
        by_copies = np.ceil(asks * scale * self.slices / np.maximum(1, held))
        self.chunks = np.maximum(1, np.minimum(by_work, by_copies)).astype(np.int64)

    def probed(self, x: np.ndarray) -> np.ndarray:
        """The cells that each vector asks."""
        return np.concatenate([_top(x[i : i + 2048] @ self.centroids.T, self.p.probes) for i in range(0, len(x), 2048)])

    def residuals(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit residuals and their lengths."""
        r = x - self.centroids[cell]
        n = np.linalg.norm(r, axis=1)
        return r / np.maximum(n, 1e-9)[:, None], n.astype(np.float32)

    def codes(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """For each vector the codes of its residual's slices, then the four bytes of its length."""
        res, n = self.residuals(x, cell)
        c = np.stack([_nearest(res[:, s], b) for s, b in zip(self.subs, self.books)], axis=1).astype(np.uint8)
        return np.concatenate([c, n.view(np.uint8).reshape(-1, 4)], axis=1)


def usable(table: DataFrame, src: str, key: str, models: dict[str, int]) -> DataFrame:
    """``src, model, key, v``: the newest vector of each key, if it is not null, not zero, finite and as long as its model says.

    Of several newest rows of a key the one with the greatest model and vector counts. Null keys are left out; repeated rows count once.
    """
    size = F.coalesce(*[F.when(F.col("model") == m, F.lit(n)) for m, n in models.items()])
    newest = table.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(F.max(F.struct("updated_at", "model", F.col("embedding").cast("array<float>").alias("v"))).alias("x"))
    v = newest.select(F.lit(src).alias("src"), F.col("x.model").alias("model"), "key", F.col("x.v").alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    return v.where((F.size("v") == size) & good)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of equal length as rows; the numbers are not copied one by one."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _sample(vectors: DataFrame, sizes: dict[int, int], p: Params) -> dict[int, np.ndarray]:
    """Of each group the unit vectors whose ids hash lowest: about sixteen for each centroid, at least 20,000, at most ``sample``."""
    out = {}
    for g, n in sorted(sizes.items()):
        most = min(p.sample, max(20_000, round(16 * p.cells * math.sqrt(n))))
        v = vectors.where(F.col("g") == g)
        if n > most:
            v = v.where(F.xxhash64("id") < F.lit(min(2**63 - 1, int(-(2**63) + 2**64 * min(1.0, 1.05 * most / n)))))
        got = v.select("id", "v").toArrow().combine_chunks().sort_by("id")
        if got.num_rows:
            x = got.column("v").combine_chunks()
            out[g] = _unit(_matrix(x, len(x[0])).astype(np.float32))
    return out


def fit(base: DataFrame, asking: DataFrame, p: Params) -> dict[int, Index]:
    """An index for each group ``g``, on a bounded sample of the vectors searched; the sample of those that ask only sizes the tasks."""
    count = lambda df: {r["g"]: r["n"] for r in df.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_base, n_asking = count(base), count(asking)
    x = _sample(base, n_base, p)
    y = x if n_base == n_asking else _sample(asking, n_asking, p)
    return {g: Index(x[g], n_base[g], p, y[g], n_asking[g]) for g in x}


_PLACED = pa.schema([("g", pa.int32()), ("shard", pa.int32()), ("slice", pa.int32()), ("chunk", pa.int32()), ("asks", pa.bool_()), ("cell", pa.int32()), ("id", pa.int64()), ("v", pa.list_(pa.float32())), ("codes", pa.binary()), ("cells", pa.list_(pa.int32()))])
_PLACED_SQL = "g int, shard int, slice int, chunk int, asks boolean, cell int, id long, v array<float>, codes binary, cells array<int>"


def _mix(ids: np.ndarray) -> np.ndarray:
    """Numbers in no order from ids in order."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) >> np.uint64(8)


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[starts, len(values)].astype(np.int32)), pa.array(values.astype(np.int32)))


def _place(indexes: dict[int, Index], asks: bool):
    """Each vector as a row of its own shard, once per chunk of it, or (``asks``) as an asking row of every shard that holds a cell it asks."""

    def rows(g: int, ix: Index, ids: pa.Array, raw: pa.Array) -> pa.RecordBatch:
        x = _unit(_matrix(raw, ix.dim).astype(np.float32))
        cell = _nearest(x, ix.centroids)
        h = _mix(ids.to_numpy())
        if asks:
            cells = ix.probed(x)
            flat = (np.repeat(np.arange(len(x), dtype=np.int64), cells.shape[1]) * ix.n_shards + ix.shard_of[cells.ravel()]) * len(ix.centroids) + cells.ravel()
            flat.sort()
            pair, asked = flat // len(ix.centroids), flat % len(ix.centroids)
            first = np.flatnonzero(np.r_[True, np.diff(pair) != 0])
            row, shard = pair[first] // ix.n_shards, (pair[first] % ix.n_shards).astype(np.int64)
            lists = _lists(asked, first)
            n = ix.slices[shard]
            at = np.repeat(np.arange(len(first)), n)
            part = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            row, shard = row[at], shard[at]
            chunk = (h[row] % ix.chunks[shard].astype(np.uint64)).astype(np.int32)
            codes, lists = pa.nulls(len(at), pa.binary()), lists.take(pa.array(at))
        else:
            shard = ix.shard_of[cell]
            n = ix.chunks[shard]
            row = np.repeat(np.arange(len(x)), n)
            chunk = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            part = (h % ix.slices[shard].astype(np.uint64)).astype(np.int64)[row]
            shard = shard[row]
            c = ix.codes(x, cell)
            codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(c.shape[1]), len(c), [None, pa.py_buffer(np.ascontiguousarray(c))]).cast(pa.binary()).take(pa.array(row))
            lists = pa.nulls(len(row), pa.list_(pa.int32()))
        at = pa.array(row)
        k = len(row)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(k, g, np.int32)), pa.array(shard.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(chunk), pa.array(np.full(k, asks)), pa.array(cell[row].astype(np.int32)), ids.take(at), raw.take(at), codes, lists], schema=_PLACED
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups = b.column(0).to_numpy()
            for g in np.unique(groups).tolist():
                mine = b.filter(pa.array(groups == g))
                for i in range(0, mine.num_rows, 2000):
                    part = mine.slice(i, 2000)
                    # a slice's buffers hold the whole batch, so the rows are taken out first
                    part = part.take(pa.array(np.arange(part.num_rows)))
                    yield rows(g, indexes[g], part.column(1), part.column(2))

    return run


class _Held:
    """The vectors of one shard slice, by cell and then by id."""

    def __init__(self, ix: Index, parts: list[pa.RecordBatch]) -> None:
        t = pa.Table.from_batches(parts).combine_chunks()
        cell, ids = t.column("cell").to_numpy(), t.column("id").to_numpy()
        order = np.lexsort((ids, cell))
        self.ix, self.ids = ix, ids[order]
        self.raw = _matrix(t.column("v").combine_chunks(), ix.dim)[order]
        self.unit = _unit(self.raw)
        self.codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), dtype=np.uint8).reshape(len(order), -1)[order]
        self.starts = np.searchsorted(cell[order], np.arange(len(ix.centroids) + 1))

    def best(self, k: int, names: np.ndarray, raw: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``id, near, cos`` of the ``k`` best of the given cells for each of a few vectors: asymmetric distances over the codes, then exact cosines of the ``keep`` best."""
        ix = self.ix
        cells = cells[np.diff(self.starts)[cells] > 0]
        none = np.zeros(0, np.int64)
        if not len(cells):
            return none, none, np.zeros(0)
        rows = np.concatenate([np.arange(self.starts[c], self.starts[c + 1]) for c in cells])
        of = np.repeat(np.arange(len(cells)), np.diff(self.starts)[cells])
        q = _unit(raw)
        base = ix.centroids[cells] @ q.T
        tables = [np.ascontiguousarray(b @ q[:, s].T) for s, b in zip(ix.subs, ix.books)]
        adc = np.empty((len(q), len(rows)), dtype=np.float32)
        for j in range(0, len(rows), 1024):  # rows of a table are copied whole, a block of them stays in the cache
            rc = self.codes[rows[j : j + 1024]]
            part = tables[0][rc[:, 0]]
            for m in range(1, len(tables)):
                part += tables[m][rc[:, m]]
            part *= np.ascontiguousarray(rc[:, len(tables) :]).view(np.float32)
            part += base[of[j : j + 1024]]
            adc[:, j : j + 1024] = part.T
        cand = rows[_top(adc, ix.p.keep)]
        rough = np.einsum("qd,qkd->qk", q, self.unit[cand])
        rough[self.ids[cand] == names[:, None]] = -np.inf
        # what may be among the k best after all that single precision loses is ranked in double precision
        least = np.partition(rough, rough.shape[1] - k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(rough), -np.inf)
        i, j = np.nonzero((rough >= least[:, None] - 1e-5) & (rough > -np.inf))
        a, b = raw[i].astype(np.float64), self.raw[cand[i, j]].astype(np.float64)
        cos = np.round(np.einsum("nd,nd->n", a, b) / np.sqrt(np.einsum("nd,nd->n", a, a) * np.einsum("nd,nd->n", b, b)), 12)
        near = self.ids[cand[i, j]]
        order = np.lexsort((near, -cos, i))
        i, near, cos = i[order], near[order], cos[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        got = rank < k
        return names[i[got]], near[got], cos[got]


_FOUND = pa.schema([("id", pa.int64()), ("near", pa.int64()), ("cos", pa.float64())])


def _search(k: int, indexes: dict[int, Index], block: int = 64):
    """Rows come sorted by shard slice and chunk, the vectors it holds before those that ask; the latter stream past."""

    def asked(held: _Held, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names = b.column(6).to_numpy()
        raw = _matrix(b.column(7), held.ix.dim)
        offsets = b.column(9).offsets.to_numpy()
        cells = b.column(9).values.to_numpy()
        home = b.column(5).to_numpy()
        order = np.lexsort((cells[offsets[:-1]], home))
        for i in range(0, len(order), block):
            at = order[i : i + block]
            want = np.unique(np.concatenate([cells[offsets[r] : offsets[r + 1]] for r in at]))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held.best(k, names[at], raw[at], want)], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, held = None, [], None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in range(4)], axis=1)
            asks = b.column(4).to_numpy(zero_copy_only=False)
            change = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for s, e in zip(np.r_[0, change], np.r_[change, len(keys)]):
                key = tuple(keys[s].tolist())
                part = b.slice(s, e - s).take(pa.array(np.arange(e - s)))
                if key != now:
                    now, parts, held = key, [], None
                if not asks[s]:
                    parts.append(part)
                elif parts or held:
                    if held is None:
                        held, parts = _Held(indexes[key[0]], parts), []
                    yield from asked(held, part)

    return run


def ordered(vectors: DataFrame) -> DataFrame:
    """``id, g, src, model, key, v``: ids in the order of source, model and key, so that ties are broken by id; written to the shared folder."""
    by = ["src", "model", "key"]
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    v = cut(vectors.select(*by, "v"))
    groups = [tuple(r) for r in v.select("src", "model").distinct().orderBy("src", "model").collect()]  # one row per table and model
    g = F.coalesce(*[F.when(F.col("src").eqNullSafe(s) & F.col("model").eqNullSafe(m), F.lit(i)) for i, (s, m) in enumerate(groups)], F.lit(-1))
    return cut(v.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("id", F.monotonically_increasing_id()).withColumn("g", g))


def searched(v: DataFrame, k: int) -> DataFrame:
    """The vectors that can be among anybody's ``k`` nearest: of equal ones the ``k + 1`` smallest ids. Only groups of more are sorted."""
    h = F.xxhash64("g", "v")
    many = cut(v.groupBy(h.alias("h")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k + 1).select("h"))
    if many.isEmpty():
        return v
    marked = v.withColumn("h", h)
    w = Window.partitionBy("g", "v").orderBy("id")
    # one row per such vector and every row of it: equal ones are spread by their content, and the window keeps k + 1 per map task before its shuffle
    first = marked.join(many, "h", "left_semi").withColumn("copy", F.row_number().over(w)).where(F.col("copy") <= k + 1).drop("copy")
    return cut(marked.join(many, "h", "left_anti").unionByName(first).drop("h"))


def nearest(vectors: DataFrame, k: int = 5, p: Params = Params()) -> DataFrame:
    """``src, model, key, near, cos, rank``: for every vector its ``k`` nearest others of the same group by cosine, ties to the smaller key.

    ``vectors`` has one row per ``(src, model, key)``; a group of fewer than ``k + 1`` vectors gives all others. Equal vectors are neighbours
    like any others; of any number of equal ones only the ``k + 1`` smallest keys can be among anybody's ``k`` nearest, so only those are
    searched, and a vector that a third of all rows share makes no cell hot. An empty table gives no rows.
    """
    v = ordered(vectors)
    base = searched(v, k)
    indexes = fit(base, v, p)
    if not indexes:
        return v.select("src", "model", "key", F.col("key").alias("near"), F.lit(0.0).alias("cos"), F.lit(0).alias("rank")).limit(0)
    placed = base.select("g", "id", "v").mapInArrow(_place(indexes, False), _PLACED_SQL).unionByName(v.select("g", "id", "v").mapInArrow(_place(indexes, True), _PLACED_SQL))
    groups = sum(int((ix.slices * ix.chunks).sum()) for ix in indexes.values())
    # the work is in the search, not in the bytes: a stated number of partitions keeps small tables from falling into a few tasks
    by = ["g", "shard", "slice", "chunk"]
    placed = placed.repartition(max(8, 2 * groups), *by).sortWithinPartitions(*by, "asks", "cell")
    found = placed.mapInArrow(_search(k, indexes), "id long, near long, cos double")
    w = Window.partitionBy("id").orderBy(F.desc("cos"), "near")
    ranked = cut(found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))
    # a vector that many copies name is a hot key
    named = hot_join(ranked, v.select(F.col("id").alias("near"), F.col("key").alias("near_key")), "near", "inner")
    return named.join(v.select("id", "src", "model", "key"), "id").select("src", "model", "key", F.col("near_key").alias("near"), "cos", "rank")


#: Queries of the brute force that are read to the driver at once; more take further passes over the vectors.
BRUTE_BLOCK = 50_000


def brute_force(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 4000) -> DataFrame:
    """The exact answer for a stated set of queries: every block of vectors against all of them, a running top ``k`` per block. For measuring recall.

    The queries are read in blocks of about ``BRUTE_BLOCK``, each with its own pass; none is left out.
    """
    q = cut(queries.select("src", "model", "key", "v"))
    blocks = max(1, -(-q.count() // BRUTE_BLOCK))
    parts = [_brute_pass(vectors, q.where(F.pmod(F.xxhash64("src", "model", "key"), F.lit(blocks)) == i), k, block) for i in range(blocks)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    w = Window.partitionBy("src", "model", "key").orderBy(F.desc("cos"), "near")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _brute_pass(vectors: DataFrame, queries: DataFrame, k: int, block: int) -> DataFrame:
    """The ``k`` best of each block of vectors for each of the queries, which are read to the driver."""
    qs: dict[tuple, tuple[list, np.ndarray]] = {}
    for r in queries.orderBy("src", "model", "key").collect():
        qs.setdefault((r["src"], r["model"]), ([], []))[0].append(r["key"])
        qs[r["src"], r["model"]][1].append(r["v"])
    ready = {}
    for g, (keys, x) in qs.items():
        x = np.array(x, dtype=np.float64)
        ready[g] = (np.array(keys, dtype=object), x / np.linalg.norm(x, axis=1, keepdims=True))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for g, part in pdf.groupby(["src", "model"]):
            if g not in ready:
                continue
            keys, q = ready[g]
            x = np.array(part["v"].tolist(), dtype=np.float64)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            names = part["key"].to_numpy(dtype=object)
            for i in range(0, len(q), 512):
                cos = np.round(np.einsum("qd,nd->qn", q[i : i + 512], x, optimize=True), 12)
                cos[keys[i : i + 512, None] == names[None, :]] = -np.inf
                least = np.partition(cos, cos.shape[1] - k, axis=1)[:, -k] if cos.shape[1] > k else np.full(len(cos), -np.inf)
                for r in range(len(cos)):
                    near = [(-cos[r, j], names[j]) for j in np.flatnonzero(cos[r] >= least[r]) if cos[r, j] > -np.inf]
                    out += [(g[0], g[1], keys[i + r], name, -c) for c, name in sorted(near)[:k]]
        return pd.DataFrame({c: list(x) for c, x in zip(("src", "model", "key", "near", "cos"), zip(*out))}) if out else pd.DataFrame({c: pd.Series([], dtype="float64" if c == "cos" else object) for c in ("src", "model", "key", "near", "cos")})

    def blocks(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for i in range(0, len(pdf), block):
                yield run(pdf.iloc[i : i + block])

    return vectors.select("src", "model", "key", "v").mapInPandas(blocks, "src string, model string, key string, near string, cos double")
