"""Registered queries that SQL can't express against plain loops on the smallest tables."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict, deque

import numpy as np
import pytest

import __spark_entry__ as entry
from wherry.operators import linking, search
from wherry.plans import graph, linking as link_plans, search as search_plans, suggestion
from wherry.session import table

Q = entry.queries()


@pytest.fixture(scope="module")
def vault(spark):
    """Notes and distinct neighbours, both ways, without self links."""
    n, _, e = graph.base(spark, "/root/testdata/sf0.001")
    keys = [r["k"] for r in n.select("k").collect()]
    near = {k: set() for k in keys}
    for r in e.collect():
        if r["src"] != r["dst"]:
            near[r["src"]].add(r["dst"])
            near[r["dst"]].add(r["src"])
    return near


def test_eigenvector(spark, sf, vault):
    keys = sorted(vault)
    at = {k: i for i, k in enumerate(keys)}
    a = np.eye(len(keys))
    for k, ns in vault.items():
        for m in ns:
            a[at[k], at[m]] = 1
    x = np.ones(len(keys))
    for _ in range(50):
        x = a @ x
        x /= x.max()
    got = {r["k"]: r["score"] for r in Q["graph_eigenvector"](spark, sf).collect()}
    assert got.keys() == vault.keys() and all(abs(got[k] - x[at[k]] * 100) < 1e-3 for k in keys)


def test_centrality(spark, sf, vault):
    n, between, close = len(vault), Counter(), {}
    for s in vault:
        dist, paths, order, queue = {s: 0}, Counter({s: 1}), [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in vault[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        dep = Counter()
        for w in reversed(order):
            for v in vault[w]:
                if dist.get(v) == dist[w] - 1:
                    dep[v] += paths[v] / paths[w] * (1 + dep[w])
            if w != s:
                between[w] += dep[w]
        far = sum(dist.values())
        close[s] = (len(dist) - 1) / far if far else 0.0
    got = {r["k"]: r for r in Q["graph_centrality"](spark, sf).collect()}
    assert got.keys() == vault.keys()
    for k in vault:
        assert abs(got[k]["betweenness"] - between[k] / ((n - 1) * (n - 2))) < 2e-6 and abs(got[k]["closeness"] - close[k]) < 2e-6


def test_centrality_in_the_tasks_and_by_joins(spark, monkeypatch):
    monkeypatch.setattr(graph.G, "BLOCK", 60)  # blocks of a few sources
    star = [("hub", f"s{i:02d}") for i in range(12)] + [("s00", "s01"), ("s03", "p00"), ("s04", "p00"), ("x", "x"), ("y", "z"), ("z", "y")]
    links = star + [(f"p{i:02d}", f"p{i + 1:02d}") for i in range(6)]
    nodes = spark.createDataFrame([(k,) for k in sorted({k for e in links for k in e} | {"alone"})], "k string")
    rows = lambda edges, **how: {r["k"]: (r["betweenness"], r["closeness"]) for r in graph.G.centrality(edges, nodes, **how).collect()}
    edges = spark.createDataFrame(links, "src string, dst string")
    got, by_joins = rows(edges), rows(edges, most_pairs=0)
    assert got.keys() == by_joins.keys() and all(abs(a - b) < 2e-6 for k in got for a, b in zip(got[k], by_joins[k]))
    assert got["alone"] == got["x"] == (0.0, 0.0) and got["y"] == (0.0, 1.0) and got["hub"][0] > 0.1 and got["p06"][1] > 0
    assert set(rows(edges.limit(0)).values()) == {(0.0, 0.0)}


@pytest.fixture(scope="module")
def mentions(spark):
    """Whole-word mentions outside closed zones by a search for every pattern, the longest first."""
    d = "/root/testdata/sf0.001"
    owner = {}
    for r in link_plans.patterns(spark, d).collect():
        p = r["pattern"].lower()
        owner[p] = min(owner.get(p, r["id"]), r["id"])
    out = set()
    docs = {r["doc_id"]: r["text"] for r in table(spark, d, "documents").select("doc_id", "text").collect() if r["text"]}
    for i, t in docs.items():
        low, closed = t.lower(), linking.zones(t)
        if len(low) != len(t):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
        found = []
        for p, ident in owner.items():
            for m in re.finditer(f"(?={re.escape(p)})", low):
                a, b = m.start(), m.start() + len(p)
                word = lambda c: c.isalnum() or c == "_"
                if (a and word(low[a - 1])) or (b < len(low) and word(low[b])) or any(x < b and a < y for x, y in closed):
                    continue
                found.append((a, b, ident))
        taken = []
        for a, b, ident in sorted(found, key=lambda x: (x[0] - x[1], x[0], x[2])):
            if all(b <= x or a >= y for x, y, _ in taken):
                taken.append((a, b, ident))
        out |= {(i, *x) for x in taken}
    return docs, out


def test_positions_of_mentions(spark, sf, mentions):
    assert {(r["key"], r["start"], r["stop"], r["entity_id"]) for r in Q["link_positions"](spark, sf).collect()} == mentions[1] != set()


def test_links_written_into_texts(spark, sf, mentions):
    docs, found = mentions
    names = {r["id"]: r["name"] for r in table(spark, sf, "entities").select("id", "name").collect()}
    by_doc = defaultdict(dict)
    for i, a, b, ident in sorted(found):
        by_doc[i].setdefault(ident, (a, b))
    want = {}
    for i, firsts in by_doc.items():
        t = docs[i]
        for ident, (a, b) in sorted(firsts.items(), key=lambda x: -x[1][0]):
            as_is = t[a:b]
            t = t[:a] + (f"[[{as_is}]]" if as_is == names[ident] else f"[[{names[ident]}|{as_is}]]") + t[b:]
        want[i] = t
    assert {r["key"]: r["text"] for r in Q["link_applied"](spark, sf).collect()} == want


def test_scores_are_the_sum_of_layers_known_from_sql(spark, sf):
    layers = {r["id"]: r for r in Q["suggest_layers"](spark, sf).collect()}
    rows = Q["suggest_scored"](spark, sf).collect()
    per = defaultdict(list)
    for r in rows:
        x = layers.get(r["id"])
        assert (r["hub"], r["edge"], r["kind"]) == ((x["hub"], x["edge"], x["kind"]) if x else (0.0, 0.0, 0.0))
        assert abs(r["score"] - (r["lexical"] + r["hub"] + r["edge"] + r["kind"] + r["feedback"])) < 2e-6 and r["score"] >= 10
        per[r["doc_id"]].append((-r["score"], r["id"], r["rank"]))
    assert rows and all([x[2] for x in sorted(v)] == list(range(1, len(v) + 1)) and len(v) <= 5 for v in per.values())


def test_stems_only_add(spark, sf):
    """With stems every candidate keeps its other layers, and words found by stem only add to the score."""
    plain = {(r["k"], r["id"]): r for r in suggestion.note_suggestions(spark, sf, disabled=("stems",)).collect()}
    full = {(r["k"], r["id"]): r for r in suggestion.note_suggestions(spark, sf).collect()}
    assert plain and plain.keys() <= full.keys()
    for k, r in plain.items():
        assert all(abs(r[c] - full[k][c]) < 1e-6 for c in suggestion.LAYERS if c not in ("stems", "lexical")) and full[k]["lexical"] + full[k]["stems"] >= r["lexical"] - 1e-6
    top = Q["suggest_notes_stemmed"](spark, sf).collect()
    assert all(full[r["k"], r["id"]]["total"] == r["total"] for r in top)


def test_similar_notes_by_plain_scores(spark, sf):
    n = {r["k"]: r for r in graph.V.notes(spark, sf, "content").collect()}
    edges = {(r["src"], r["dst"]) for r in graph.base(spark, sf)[2].collect()}
    root = min(Counter(s for s, _ in edges).items(), key=lambda x: (-x[1], x[0]))[0]
    own = spark.createDataFrame([(root, n[root]["content"])], "k string, content string")
    terms = sorted({r["term"] for r in search.key_terms(own, "k", "content").collect()})
    words = {k: re.findall(r"[^\W_]+", (r["content"] or "").lower()) for k, r in n.items()}
    avg = sum(map(len, words.values())) / len(words)
    df = {t: sum(t in w for w in words.values()) for t in terms}
    want = []
    for k, w in words.items():
        tf = {t: w.count(t) for t in terms}
        if sum(tf.values()) and k != root and (root, k) not in edges:
            s = sum(math.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / avg)) for t, f in tf.items())
            want.append((-round(s, 4), k))
    got = Q["search_similar_notes"](spark, sf).collect()
    assert sorted((-round(r["score"], 4), r["k"]) for r in got) == sorted(want)[:20]


def test_sections_stand_in_their_notes(spark, sf):
    n = {r["k"]: r["content"] for r in graph.V.notes(spark, sf, "content").collect()}
    page = {r["k"]: r for r in Q["search_parsed_snippets"](spark, sf).collect()}
    ranks = [r["k"] for r in Q["search_parsed"](spark, sf).collect()]
    rows = Q["search_sections"](spark, sf).collect()
    assert rows and {r["k"] for r in rows} <= set(ranks[:5])
    for r in rows:
        assert page[r["k"]]["section"] == r["section"] and r["content"] in n[r["k"]] and len(r["content"]) <= 2500
        head = re.search(rf"(?m)^(#{{1,6}})[ \t]+{re.escape(r['section'])}[ \t]*$", n[r["k"]])
        body = n[r["k"]][head.end() + 1 :]
        stop = re.search(rf"(?m)^#{{1,{len(head.group(1))}}}\s", body)
        assert r["content"] == (body[: stop.start() - 1] if stop else body)[:2500]
    assert search_plans.TERMS
