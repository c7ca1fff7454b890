"""Whole jobs: nothing of the input is left out by a bound."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from datetime import datetime
from itertools import combinations

from pyspark.sql import functions as F

from wherry.operators import association, graph
from wherry.plans import graph as plans
from wherry.plans import learning


def test_common_targets_count_hubs(spark):
    rng = random.Random(2)
    out = {f"n{i:02d}": {"hub", "hub2"} | {f"t{rng.randint(0, 30)}" for _ in range(rng.randint(0, 4))} for i in range(60)}
    out |= {"one": {"hub"}, "two": {"t1", "t2"}, "loop": {"loop", "hub"}, "m": {"loop", "hub"}}
    e = spark.createDataFrame([(k, t) for k, ts in out.items() for t in ts], "src string, dst string")
    want = {(a, b): len(out[a] & out[b]) for a, b in combinations(sorted(out), 2) if len(out[a] & out[b]) > 1}
    for piece in (7, 2000):
        rows = [tuple(r) for r in graph.common_targets(e, piece).collect()]
        assert max(Counter(r[:2] for r in rows).values()) == 1
        assert {r[:2]: r[2] for r in rows} == want


def test_long_sessions_keep_their_pairs(spark):
    at = datetime(2024, 1, 31)
    size = {"long": 60, "longer": 75, "short": 4, "two": 2, "one": 1}
    reads = [(k, i, at) for k, n in size.items() for i in range(n)] + [("long", 3, at), ("long", None, at)]
    want = Counter()
    for n in size.values():
        for p in combinations(range(n), 2):
            want[p] += 1 / math.log(n) if n > 2 else 1.0
    r = spark.createDataFrame(reads, "session string, note long, at timestamp_ntz")
    for most, piece in ((50, 2000), (50, 7), (3, 10), (100, 2000)):
        got = {(x["a"], x["b"]): x["weight"] for x in association.co_retrieval(r, "2024-01-31", most=most, piece=piece).collect()}
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 2e-6 for p in want)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, last = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
    return row[-1]


def merge_rule(x, y):
    a, b = x.lower(), y.lower()
    short, longer = sorted((a, b), key=len)
    fold = [re.sub("[^a-z0-9]", "", n) for n in (a, b)]
    plain = [re.sub("ts$", "", re.sub("js$", "", re.sub("[.\\-_]", "", n))) for n in (a, b)]
    if a == b:
        return 0.95, "exact"
    if fold[0] == fold[1] != "" or (plain[0] == plain[1] and len(plain[0]) >= 3):
        return 0.85, "same"
    if len(short) >= 3 and short in longer and len(short) / len(longer) > 0.5:
        return round(0.6 + 0.2 * len(short) / len(longer), 6), "substring"
    if len(short) >= 4 and edits(a, b) / len(longer) < 0.35:
        return round(0.5 + 0.4 * (1 - edits(a, b) / len(longer)), 6), "near"
    return None


def test_merge_candidates_by_every_rule(spark):
    rng = random.Random(4)
    names = ["React", "react.js", "REACT", "Re act", "abc", "abcd", "abcde", "abcdefg", "", "..", "Vestibule 3", "Vestibule"]
    for _ in range(30):
        w = "".join(rng.choice("abcdef ") for _ in range(rng.randint(3, 24)))
        names.append(w)
        for _ in range(4):
            v = list(w)
            for _ in range(rng.randint(1, 8)):
                k = rng.randrange(len(v) + 1)
                v[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "ab"])
            names.append("".join(v))
    want = {(i, j): r for (i, x), (j, y) in combinations(enumerate(names), 2) if (r := merge_rule(x, y))}
    assert {r for _, r in want.values()} == {"exact", "same", "substring", "near"}
    e = spark.createDataFrame([*enumerate(names), (len(names), None)], "id long, name string")
    got = {(r["a"], r["b"]): (r["score"], r["reason"]) for r in association.merge_candidates(e).collect()}
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert all(abs(got[k][0] - want[k][0]) < 2e-6 for k in want)


def test_strength_and_costs_count_shared_tags(spark):
    front = {"x/a": 'draft log [session, rollout] "[[Some Note]]"', "x/b": "[rollout, session, session] done", "c": 'note "[[rollout, x]]"', "d": None}
    n = spark.createDataFrame(list(front.items()), "k string, frontmatter string")
    e = spark.createDataFrame([("x/a", "x/b"), ("x/b", "x/a"), ("x/a", "c"), ("x/b", "c"), ("c", "d"), ("d", "d")], "src string, dst string")
    tags = {(r["k"], r["tag"]) for r in plans.note_tags(n).collect()}
    assert tags == {("x/a", "session"), ("x/a", "rollout"), ("x/b", "session"), ("x/b", "rollout")}
    strength = {(r["a"], r["b"]): r["strength"] for r in plans.pair_strength(e, n).collect()}
    assert strength == {("x/a", "x/b"): 3 + 2 + 0.5 + 1, ("c", "x/a"): 1, ("c", "x/b"): 1, ("c", "d"): 1}
    links = {"x/a": 3, "x/b": 3, "c": 3, "d": 3}
    want = {p: 1 / (1 + v) * (1 + math.log2(links[p[1]])) for ab, v in strength.items() for p in (ab, ab[::-1])}
    got = {(r["src"], r["dst"]): r["w"] for r in plans.path_costs(e, n).collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-8 for p in want)


def test_centrality_of_a_long_chain(spark):
    n = 68
    nodes = spark.createDataFrame([(f"d{i:02d}",) for i in range(n)], "k string")
    e = spark.createDataFrame([(f"d{i:02d}", f"d{i + 1:02d}") for i in range(n - 1)], "src string, dst string")
    got = {r["k"]: (r["betweenness"], r["closeness"]) for r in graph.centrality(e, nodes).collect()}
    for i in range(n):
        far = sum(abs(i - j) for j in range(n))
        want = 2 * i * (n - 1 - i) / ((n - 1) * (n - 2)), (n - 1) / far
        assert all(abs(g - w) < 2e-6 for g, w in zip(got[f"d{i:02d}"], want, strict=True))


def test_hops_and_paths_reach_ten_links(spark, tmp_path):
    at = datetime(2024, 1, 1)
    names = [f"n{i:02d}" for i in range(13)]
    spark.createDataFrame([(k, k, None, "", at, at) for k in [*names, "x"]], "path string, title string, frontmatter string, content string, modified timestamp_ntz, created timestamp_ntz").write.parquet(f"{tmp_path}/notes_fts.parquet")
    chain = [*zip(names, names[1:], strict=False), ("n00", "x")]
    spark.createDataFrame([(i, a, b, 1.0, at) for i, (a, b) in enumerate(chain)], "link_id long, note_path string, target string, weight double, weight_updated_at timestamp_ntz").write.parquet(f"{tmp_path}/note_links.parquet")
    spark.createDataFrame([], "id long, name string, path string, aliases_json string, category string").write.parquet(f"{tmp_path}/entities.parquet")
    hops = {r["k"]: r["hop"] for r in plans.graph_shortest_hops(spark, str(tmp_path)).collect()}
    assert hops == {"x": 1} | {k: i for i, k in enumerate(names[:11])}
    costs = {r["k"]: r["cost"] for r in plans.graph_weighted_paths(spark, str(tmp_path)).collect()}
    assert costs == {"n00": 0, "x": 0.5} | {k: float(i) for i, k in enumerate(names[:11]) if i}


def test_documents_that_name_an_alias(spark, tmp_path):
    ents = [(1, "Harbour Gate Project", '["HGP", "gate plan"]'), (2, "Lonely Tower", None), (3, "Tower", '["Lonely Tower Old"]')]
    e = spark.createDataFrame(ents, "id long, name string, aliases_json string").withColumn("aliases", F.coalesce(F.from_json("aliases_json", "array<string>"), F.array().cast("array<string>")))
    docs = spark.createDataFrame([(1, "The hgp is late."), (2, "harbour gate plan"), (3, "lonely tower"), (4, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["id"]): (r["points"], round(r["ratio"], 3)) for r in learning.name_hits(docs, e, 0.6).collect()}
    assert got == {(1, 1): (18, 1.0), (2, 1): (28, 1.0), (3, 2): (28, 1.0), (3, 3): (20, 0.667)}


def test_dead_links_with_two_edits(spark):
    rng = random.Random(6)
    names = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 14))) for _ in range(150)} | {"gate", "harbour office"})
    terms = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 14))) for _ in range(150)} | {"gats", "harbor ofice", "hat"})
    want = {}
    for t in terms:
        near = [(edits(t, n), n) for n in names]
        near = [(-round(1 - k / max(len(t), len(n)), 6), n) for k, n in near if k <= (2 if len(t) > 10 else 1) and len(t) >= 4]
        if near:
            want[t] = min(near)[::-1]
    got = {r["term"]: (r["match"], -r["sim"]) for r in association.fuzzy_best(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == want and got["gats"][0] == "gate" and got["harbor ofice"][0] == "harbour office"
