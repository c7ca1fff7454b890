"""Link-graph analytics over ``edges(src, dst)`` and ``nodes(k)``. Every result has a total order key; hubs are handled by partial aggregates and AQE's skew joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wherry.session import cut, hot_join


def note_edges(resolved_links: DataFrame, notes: DataFrame) -> DataFrame:
    """Distinct note-to-note edges of notes that are there."""
    return resolved_links.where(F.col("to").isNotNull()).join(notes.select(F.col("k").alias("src")), "src", "left_semi").select("src", F.col("to").alias("dst")).distinct()


def degrees(edges: DataFrame, notes: DataFrame) -> DataFrame:
    """``k, n_out, n_in`` for every note, by one aggregate over both directions; self links count on either side."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("k"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("k"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    all_ = ends.unionByName(notes.select("k", F.lit(0).alias("o"), F.lit(0).alias("i")))
    return all_.groupBy("k").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge both ways, without self links."""
    e = edges.where(F.col("src") != F.col("dst"))
    return e.select("src", "dst").union(e.select("dst", "src")).distinct()


def strength(edges: DataFrame, tops: DataFrame, tags: DataFrame) -> DataFrame:
    """Connection strength of each linked pair ``a < b``: 3 if mutual, else 1; one per shared tag; half per common target; 1 for the same folder below the root.

    ``tops(k, folder)``, ``tags(k, tag)``.
    """
    e = cut(edges.where(F.col("src") != F.col("dst")))  # used six times
    pairs = e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "src").groupBy("a", "b").agg(F.when(F.countDistinct("src") == 2, 3.0).otherwise(1.0).alias("link"))
    # of a pair the end with fewer links is spread out and looked up among the other's, so that two hubs cost no more than the smaller one
    n_out = e.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    p = pairs.select("a", "b").join(n_out.toDF("a", "na"), "a", "left").join(n_out.toDF("b", "nb"), "b", "left").where("na is not null and nb is not null")
    first = F.col("na") <= F.col("nb")
    p = p.select("a", "b", F.when(first, F.col("a")).otherwise(F.col("b")).alias("small"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("large"))
    common = p.join(e.toDF("small", "t"), "small").join(e.toDF("large", "t"), ["large", "t"], "left_semi").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    shared = pairs.join(tags.toDF("a", "tag"), "a").join(tags.toDF("b", "tag"), ["b", "tag"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("tags"))
    f = pairs.join(common, ["a", "b"], "left").join(shared, ["a", "b"], "left").join(tops.toDF("a", "fa"), "a", "left").join(tops.toDF("b", "fb"), "b", "left")
    same = F.when((F.col("fa") == F.col("fb")) & (F.col("fa") != ""), 1.0).otherwise(0.0)
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return f.select("a", "b", (F.col("link") + z("tags") + z("common") * 0.5 + same).alias("strength"))


def common_targets(edges: DataFrame, piece: int = 2000) -> DataFrame:
    """``a, b, n_shared``: all pairs ``a < b`` of notes with two common targets or more, hubs counted like any other.

    Every note carries its targets, rarest first. A pair meets at each common target but is kept at the rarest one only, so it comes out
    once, without a shuffle of pairs; a note's last target can't be the rarer of two and is never joined. Targets with more than ``piece``
    notes are spread over tasks: one side in pieces, the other repeated for each.
    """
    e = cut(edges)
    ids = cut(e.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).orderBy("n", "dst").select("dst", F.monotonically_increasing_id().alias("t")))
    lists = e.join(ids, "dst").groupBy("src").agg(F.sort_array(F.collect_list("t")).alias("ts")).where(F.size("ts") > 1)
    heads = cut(lists.select("src", "ts", F.explode(F.slice("ts", F.lit(1), F.size("ts") - 1)).alias("t")))
    pieces = heads.groupBy("t").agg(F.ceil(F.count(F.lit(1)) / piece).cast("int").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1").select("t", "m")
    heads = heads.join(pieces, "t")
    a = heads.select("t", F.pmod(F.hash("src"), "m").alias("p"), F.col("src").alias("a"), F.col("ts").alias("ta"))
    b = heads.select("t", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("p"), F.col("src").alias("b"), F.col("ts").alias("tb"))
    both = F.array_intersect("ta", "tb")
    met = a.join(b, ["t", "p"]).where((F.col("a") < F.col("b")) & (F.size(both) > 1) & (F.get(both, F.lit(0)) == F.col("t")))
    return met.select("a", "b", F.size(both).cast("long").alias("n_shared"))


def hops(edges: DataFrame, start: DataFrame, most: int) -> DataFrame:
    """Breadth-first: ``root, k, hop`` for nodes within ``most`` hops of each root in ``start(root)``. Each round joins the frontier only; lineage is cut every round."""
    seen = start.select("root", F.col("root").alias("k"), F.lit(0).alias("hop"))
    front = seen
    for h in range(1, most + 1):
        nxt = front.join(edges.select(F.col("src").alias("k"), F.col("dst").alias("nxt")), "k").select("root", F.col("nxt").alias("k")).distinct()
        nxt = cut(nxt.join(seen.select("root", "k"), ["root", "k"], "left_anti").withColumn("hop", F.lit(h)))
        if nxt.isEmpty():
            break
        seen = seen.unionByName(nxt)
        front = nxt
    return seen


def cheapest(weighted: DataFrame, start: DataFrame, most: int) -> DataFrame:
    """Least cost over paths of at most ``most`` edges: ``root, k, cost, n_edges`` (the fewest edges among the cheapest). ``weighted(src, dst, w)``."""
    best = start.select("root", F.col("root").alias("k"), F.lit(0.0).alias("cost"), F.lit(0).alias("n_edges"))
    front = best
    for _ in range(most):
        step = front.join(weighted, front["k"] == weighted["src"]).select("root", F.col("dst").alias("k"), F.round(F.col("cost") + F.col("w"), 9).alias("cost"), (F.col("n_edges") + 1).alias("n_edges"))
        merged = best.unionByName(step).groupBy("root", "k").agg(F.min(F.struct("cost", "n_edges")).alias("x")).select("root", "k", "x.cost", "x.n_edges")
        merged = cut(merged)
        old = best.select("root", "k", F.col("cost").alias("c0"))
        front = merged.join(old, ["root", "k"], "left").where(F.col("c0").isNull() | (F.col("cost") < F.col("c0"))).select("root", "k", "cost", "n_edges")
        best = merged
    return best


def components(edges: DataFrame, nodes: DataFrame, most_rounds: int = 50) -> DataFrame:
    """``k, component``: the least key of each connected component, by neighbour minima and pointer jumping to a fixpoint."""
    both = cut(undirected(edges))
    label = nodes.select("k", F.col("k").alias("component"))
    for _ in range(most_rounds):
        low = both.join(label.toDF("dst", "c"), "dst").groupBy(F.col("src").alias("k")).agg(F.min("c").alias("c"))
        step = cut(label.join(low, "k", "left").select("k", F.col("component").alias("old"), F.least("component", F.coalesce("c", "component")).alias("component")))
        # in the end most notes have one label: a hot key
        jump = hot_join(step, step.select(F.col("k").alias("component"), F.col("component").alias("c2")), "component", "left")
        new = cut(jump.select("k", F.least("component", F.coalesce("c2", "component")).alias("component"), "old"))
        label = new.select("k", "component")
        if new.where(F.col("component") != F.col("old")).isEmpty():
            return label
    raise RuntimeError(f"components are not settled after {most_rounds} rounds")


def eigenvector(edges: DataFrame, nodes: DataFrame, rounds: int = 50, every: int = 5) -> DataFrame:
    """``k, score``: eigenvector centrality of the undirected graph by power iteration on ``A + I``, scaled to 0..100. Lineage is cut every few rounds."""
    both = cut(undirected(edges))
    v = nodes.select("k", F.lit(1.0).alias("x"))
    for i in range(rounds):
        s = both.join(v.toDF("dst", "y"), "dst").groupBy(F.col("src").alias("k")).agg(F.sum("y").alias("s"))
        v = v.join(s, "k", "left").select("k", (F.col("x") + F.coalesce("s", F.lit(0.0))).alias("x"))
        if (i + 1) % every == 0:
            v = cut(v)
            top = v.agg(F.max("x")).first()[0] or 1.0
            v = v.select("k", (F.col("x") / F.lit(top)).alias("x"))
    top = v.agg(F.max("x")).first()[0] or 1.0
    return v.select("k", F.round(F.col("x") / F.lit(top) * 100, 4).alias("score"))


def _joined_sums(both: DataFrame, nodes: DataFrame, gather: int = 16) -> DataFrame:
    """``k, dep, reached, far``: Brandes' algorithm over all sources at once, level by level until no level is left, as joins and aggregates on ``(root, node)``. What was seen is gathered every ``gather`` levels."""
    level = nodes.select(F.col("k").alias("root"), "k", F.lit(1.0).alias("paths"))
    seen = level.withColumn("hop", F.lit(0))
    h = 0
    while True:
        h += 1
        nxt = level.join(both, level["k"] == both["src"]).groupBy("root", F.col("dst").alias("k")).agg(F.sum("paths").alias("paths"))
        level = cut(nxt.join(seen.select("root", "k"), ["root", "k"], "left_anti"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level.withColumn("hop", F.lit(h)))
        if h % gather == 0:
            seen = cut(seen)
    seen = cut(seen)
    deepest = seen.agg(F.max("hop")).first()[0] or 0
    done = seen.where(F.col("hop") == deepest).select("root", "k", "paths", "hop", F.lit(0.0).alias("dep"))
    total = done
    for h in range(deepest, 0, -1):
        back = done.join(both, done["k"] == both["src"]).select("root", F.col("dst").alias("k"), ((1 + F.col("dep")) / F.col("paths")).alias("c"))
        add = back.groupBy("root", "k").agg(F.sum("c").alias("c"))
        done = cut(seen.where(F.col("hop") == h - 1).join(add, ["root", "k"], "left").select("root", "k", "paths", "hop", (F.col("paths") * F.coalesce("c", F.lit(0.0))).alias("dep")))
        total = total.unionByName(done)
        if h % gather == 0:
            total = cut(total)
    between = total.where(F.col("root") != F.col("k")).select("k", "dep", F.lit(0).cast("long").alias("reached"), F.lit(0).cast("long").alias("far"))
    close = seen.where("hop > 0").select(F.col("root").alias("k"), F.lit(0.0).alias("dep"), F.lit(1).cast("long").alias("reached"), F.col("hop").cast("long").alias("far"))
    return between.unionByName(close).groupBy("k").agg(F.sum("dep").alias("dep"), F.sum("reached").alias("reached"), F.sum("far").alias("far"))


#: Up to so many linked pairs go whole to the tasks (64 MB of numbers); numbers a task keeps of a block of sources, three times and some.
MOST_PAIRS, BLOCK = 8_000_000, 4_000_000


def _pulled(ptr: np.ndarray, adj: np.ndarray, owner: np.ndarray, into: np.ndarray, rows: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each node marked in ``into`` that has neighbours among ``rows``: the node, and the sum of those neighbours' rows of ``x``."""
    n = len(ptr) - 1
    deg = ptr[rows + 1] - ptr[rows]
    if deg.sum() * 8 < len(adj):
        at = np.repeat(ptr[rows] - np.cumsum(deg) + deg, deg) + np.arange(deg.sum())
        own, idx = adj[at], np.repeat(rows, deg)
        keep = into[own]
        own, idx = own[keep], idx[keep]
        order = np.argsort(own, kind="stable")
        own, idx = own[order], idx[order]
    else:
        among = np.zeros(n, bool)
        among[rows] = True
        keep = np.flatnonzero(among[adj] & into[owner])
        own, idx = owner[keep], adj[keep]
    if not len(own):
        return own, np.zeros((0, x.shape[1]))
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    count = np.diff(np.concatenate([first, [len(own)]]))
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    out = x.take(idx[first], axis=0)
    many = int(np.searchsorted(-count, -64, "left"))  # those with more than 64 are summed one by one, the rest side by side
    for i in range(many):
        out[i] = x.take(idx[first[i] : first[i] + count[i]], axis=0).sum(axis=0)
    for j in range(1, int(count[many]) if many < len(count) else 0):
        k = int(np.searchsorted(-count, -j, "left"))
        out[many:k] += x.take(idx[first[many:k] + j], axis=0)
    return own[first], out


def _dependencies(ptr: np.ndarray, adj: np.ndarray, owner: np.ndarray, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Brandes' algorithm for a block of sources side by side: summed dependencies by node; nodes reached and summed distances by source."""
    n, m = len(ptr) - 1, len(sources)
    paths = np.zeros((n, m))
    paths[sources, np.arange(m)] = 1
    levels = [(sources, paths[sources] > 0)]
    open_ = np.full(n, m)
    open_[sources] -= 1
    reached, far = np.zeros(m, np.int64), np.zeros(m, np.int64)
    while True:
        # a neighbour of an unreached pair that has paths is of the last level
        rows, add = _pulled(ptr, adj, owner, open_ > 0, levels[-1][0], paths)
        had = paths[rows]
        new = (had == 0) & (add > 0)
        some = new.any(axis=1)
        if not some.any():
            break
        rows, new = rows[some], new[some]
        paths[rows] = had[some] + add[some] * new
        open_[rows] -= new.sum(axis=1)
        reached += new.sum(axis=0)
        far += len(levels) * new.sum(axis=0)
        levels.append((rows, new))
    dep, share = np.zeros((n, m)), np.zeros((n, m))
    at, into = np.zeros(n, np.int64), np.zeros(n, bool)
    for h in range(len(levels) - 1, 1, -1):
        (rows, new), (above, there) = levels[h], levels[h - 1]
        share[rows] = np.divide(1 + dep[rows], paths[rows], out=np.zeros(new.shape), where=new)
        at[above] = np.arange(len(above))
        into[above] = True
        back, add = _pulled(ptr, adj, owner, into, rows, share)
        dep[back] += paths[back] * add * there[at[back]]
        share[rows] = 0
        into[above] = False
    return dep.sum(axis=1), reached, far


def _task_sums(both: DataFrame, nodes: DataFrame) -> DataFrame:
    """``k, dep, reached, far`` of linked nodes: the numbered neighbours go whole to the tasks, which share the sources; blocks of sources with the same largest neighbours go together."""
    spark = both.sparkSession
    numbered = cut(nodes.select("k", F.monotonically_increasing_id().alias("id")))
    pairs = both.join(numbered.toDF("src", "a"), "src").join(numbered.toDF("dst", "b"), "dst").where("a < b").select("a", "b").toArrow()
    a, b = (pairs[c].to_numpy() for c in ("a", "b"))
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    ends = at.reshape(2, -1)
    order = np.argsort(-np.bincount(at, minlength=len(ids)), kind="stable")  # the largest degree is node 0
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    ids, ends = ids[order], place[ends]
    key = np.sort(np.concatenate([ends[0] * len(ids) + ends[1], ends[1] * len(ids) + ends[0]]))
    owner, adj = (key // max(1, len(ids))).astype(np.int32), (key % max(1, len(ids))).astype(np.int32)
    ptr = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(ids)))])
    best = [np.where(np.diff(ptr) > i, adj[np.minimum(ptr[:-1] + i, len(adj) - 1)], len(ids)) for i in range(3)] if len(ids) else [np.zeros(0)]
    sources = np.lexsort(best[::-1])
    tasks = max(1, min(64, 4 * spark.sparkContext.defaultParallelism))
    sent = spark.sparkContext.broadcast((ids, ptr, adj, sources))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.column(0).to_pylist():
                ids, ptr, adj, sources = sent.value
                n = len(ids)
                owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(ptr))
                dep, reached, far = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
                size = max(1, min(64, BLOCK // max(1, n), -(-n // tasks)))
                for start in range(task * size, n, tasks * size):
                    own = sources[start : start + size]
                    d, reached[own], far[own] = _dependencies(ptr, adj, owner, own)
                    dep += d
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids.astype(np.int64), dep, reached, far)], names=["id", "dep", "reached", "far"])

    sums = spark.range(0, tasks, 1, tasks).mapInArrow(run, "id long, dep double, reached long, far long")
    sums = sums.groupBy("id").agg(F.sum("dep").alias("dep"), F.sum("reached").alias("reached"), F.sum("far").alias("far"))
    return sums.join(numbered, "id").select("k", "dep", "reached", "far")


def centrality(edges: DataFrame, nodes: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """``k, betweenness, closeness``: Brandes' algorithm over all sources, in the tasks if there are at most ``most_pairs`` linked pairs, else by joins.

    Undirected and without self links; betweenness is divided by (N-1)(N-2), closeness is reached over summed distances.
    """
    both = cut(undirected(edges))
    n = nodes.count()
    sums = _task_sums(both, nodes) if both.count() <= 2 * most_pairs else _joined_sums(both, nodes)
    z = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    near = F.when(F.col("far") > 0, F.col("reached") / F.col("far"))
    return nodes.select("k").join(sums, "k", "left").select("k", z(F.col("dep") / F.lit(float(max(1, (n - 1) * (n - 2))))).alias("betweenness"), z(near).alias("closeness"))


def cycles(edges: DataFrame, longest: int = 3) -> DataFrame:
    """Directed cycles of 2 to ``longest`` nodes, each once, starting at its least node: ``cycle`` as an array. Only paths whose nodes are greater than the first are followed."""
    e = edges.where(F.col("src") != F.col("dst"))
    path = e.where(F.col("src") < F.col("dst")).select(F.array("src", "dst").alias("cycle"))
    out = None
    for n in range(2, longest + 1):
        last, first = F.element_at("cycle", -1), F.element_at("cycle", 1)
        closed = path.join(e, (last == e["src"]) & (first == e["dst"]), "left_semi")
        out = closed if out is None else out.unionByName(closed)
        if n < longest:
            path = path.join(e, last == e["src"]).where((F.col("dst") > first) & ~F.array_contains("cycle", F.col("dst"))).select(F.concat("cycle", F.array("dst")).alias("cycle"))
    return out


def triangles(edges: DataFrame) -> DataFrame:
    """``k, n_triangles`` of the undirected graph, by joining each edge from its end of smaller degree, so that hubs start no wedges."""
    both = undirected(edges)
    deg = both.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    rank = lambda k, d: F.struct(d, k)
    e = both.join(deg.toDF("src", "ds"), "src").join(deg.toDF("dst", "dd"), "dst")
    up = cut(e.where(rank("src", F.col("ds").alias("d")) < rank(F.col("dst").alias("src"), F.col("dd").alias("d"))).select("src", "dst"))
    a, b = up.toDF("x", "y"), up.toDF("x", "z")
    wedges = a.join(b, "x").where(F.col("y") != F.col("z"))
    tri = wedges.join(up.toDF("y", "z"), ["y", "z"])
    return tri.select(F.explode(F.array("x", "y", "z")).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n_triangles"))


#: What stands before and after the lines of an exported graph (a fixed format).
GRAPHML_HEAD = """<?xml version="1.0" encoding="UTF-8"?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns">
<key id="type" for="all" attr.name="type" attr.type="string"/>
<key id="title" for="node" attr.name="title" attr.type="string"/>
<key id="category" for="node" attr.name="category" attr.type="string"/>
<key id="weight" for="edge" attr.name="weight" attr.type="double"/>
<graph id="vault" edgedefault="directed">"""
GRAPHML_TAIL = "</graph>\n</graphml>"


def escaped(c: Column) -> Column:
    """Text for XML."""
    return F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``part, ord, xml``: the lines of a GraphML document, nodes then edges; written with ``df.orderBy('part', 'ord').write.text`` per part."""
    esc = escaped
    n = nodes.select(F.lit(0).alias("part"), F.col("k").alias("ord"), F.concat(F.lit('<node id="'), esc(F.col("k")), F.lit('"/>')).alias("xml"))
    e = edges.select(F.lit(1).alias("part"), F.concat_ws(" ", "src", "dst").alias("ord"), F.concat(F.lit('<edge source="'), esc(F.col("src")), F.lit('" target="'), esc(F.col("dst")), F.lit('"/>')).alias("xml"))
    return n.unionByName(e)
