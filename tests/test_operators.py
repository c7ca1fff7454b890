"""Operators of the core on hand-made cases and against brute force."""

from __future__ import annotations

import json
import random
from collections import defaultdict
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from wherry.functions import exprs as X
from wherry.operators import association, evaluation, graph, markdown, search, shred
from wherry.operators.orphans import key_runs, match_keys, orphans_by_period, vault_orphans
from wherry.session import hot_join, link_key
from wherry.sources import readers
from wherry.streaming import changes

NOTES = "path string, content string, created timestamp_ntz, modified timestamp_ntz"
T = datetime


# ---- references to what isn't there ------------------------------------------------------------------------------------------


def test_runs_and_as_of_match_against_sets(spark):
    rng = random.Random(1)
    parents = [f"k{rng.randint(0, 400)}" for _ in range(300)]
    refs = [f"k{rng.randint(0, 500)}" for _ in range(500)]
    p = spark.createDataFrame([(x, "clash") for x in [*parents, None]], "key string, found string")
    r = spark.createDataFrame([(x, 1) for x in [*refs, None]], "key string, bucket int")
    got = {x["key"]: x["found"] for x in match_keys(r, p).collect()}
    assert got == {k: k in set(parents) for k in set(refs)}
    assert match_keys(r.limit(0), p).count() == 0
    assert not any(x["found"] for x in match_keys(r, p.limit(0)).collect())
    runs = key_runs(spark.createDataFrame([(f"{i:03d}", i % 10 < 6) for i in range(50)], "key string, is_parent boolean"), 1).orderBy("id").collect()
    assert [(x["run_start"], x["run_end"]) for x in runs[:12]] == [(1, 6)] * 10 + [(11, 16)] * 2


def vault(spark, links):
    notes = spark.createDataFrame([("A/One.md", "x", T(2024, 5, 1), T(2024, 6, 1)), ("a/ONE.md", "old", None, T(2024, 1, 1)), ("b/two", None, None, T(2024, 1, 1))], NOTES)
    events = spark.createDataFrame([("gone.md", "unlink"), ("gone.md", "add"), ("A/one.md", "unlink"), (None, "unlink")], "path string, type string")
    ents = spark.createDataFrame([(1, "Name X", "a/one.md", '["AL", null]'), (2, "Name Y", "nowhere.md", "[cut"), (3, None, None, None), (4, "Z", "GONE", "")], "id long, name string, path string, aliases_json string")
    li = spark.createDataFrame(links, "link_id long, note_path string, target string, weight_updated_at timestamp_ntz")
    return notes, events, ents, li


def test_kinds_of_orphans(spark):
    links = [(1, "A/One.md", "al", T(2024, 1, 1)), (2, "a/one.MD", "ONE", T(2024, 1, 1)), (3, "b/two.md", "one", T(2024, 7, 1)), (4, "x/y", "gone", None), (5, None, None, None), (6, "b/two", "Two", T(2020, 1, 1)), (7, "b/two", "name y.md", None), (7, "b/two", "name y.md", None), (8, " b/two ", "none at all", T(2024, 2, 3))]
    o = vault_orphans(*vault(spark, links))
    got = {(r["src"], r["field"], r["ref_id"], r["kind"]) for r in o.collect()}
    assert got == {
        ("note_links", "note_path", 1, "late"), ("note_links", "note_path", 2, "late"), ("note_links", "target", 2, "late"), ("note_links", "note_path", 4, "missing"), ("note_links", "target", 4, "deleted"), ("note_links", "target", 8, "missing"),
        ("entities", "path", 2, "missing"), ("entities", "path", 4, "deleted"),
    }
    months = {(r["src"], r["month"]): r["n_refs"] for r in orphans_by_period(o).where("kind = 'missing' and field = 'target'").collect()}
    assert months == {("note_links", "2024-02"): 1}


def test_orphans_with_a_hot_key_and_with_nothing(spark):
    links = [(i, "b/two", "hot one" if i % 3 else f"t{i}", None) for i in range(6000)]
    assert vault_orphans(*vault(spark, links)).where("src = 'note_links'").count() == 6000
    empty = [x.limit(0) for x in vault(spark, links[:1])]
    assert vault_orphans(*empty).count() == 0


def test_hot_join_is_a_join(spark):
    left = spark.createDataFrame([("h" if i % 2 else f"k{i % 50}" if i % 7 else None, i) for i in range(5000)], "key string, i int")
    right = spark.createDataFrame([("h", 1), ("k2", 2), ("zz", 3)], "key string, v int")
    for how in ("left", "inner"):
        want = sorted(map(tuple, left.join(right, "key", how).select("key", "i", "v").collect()), key=repr)
        assert sorted(map(tuple, hot_join(left, right, "key", how).select("key", "i", "v").collect()), key=repr) == want
    with pytest.raises(ValueError):
        hot_join(left, right, "key", "full")


# ---- nested records ------------------------------------------------------------------------------------------------------------


def test_children_keys_and_damage(spark, tmp_path):
    msg = {"content": [{"type": "text", "text": "a"}, None, "plain", {"type": "tool_result", "content": [{"type": "text"}, None, {"type": "image"}]}, {"type": "tool_result", "content": "leaf"}, {"type": "tool_result", "content": {"type": "bare"}}]}
    rows = [(1, json.dumps(msg), json.dumps({"name": "s", "tools": "one"})), (2, json.dumps(json.dumps({"content": "text"})), None), (3, json.dumps(msg)[:40], "[]"), (4, None, "null"), (5, "", "12"), (None, json.dumps(msg), None), (6, json.dumps({"content": None}), "[null]")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "line_id long, message string, mcp_servers string, tag string")
    t = shred.shred(df, "w", "line_id", {"message": shred.MESSAGE_LEVELS, "mcp_servers": shred.SERVER_LEVELS})
    got = {(r["rec_id"], r["tag"], r["pos"], r["sub_pos"]) for r in t.collect()}
    assert got == {(1, "content", i, -1) for i in (0, 2, 3, 4, 5)} | {(1, "content.content", 3, 0), (1, "content.content", 3, 2), (1, "content.content", 5, 0), (1, "mcp_servers", 0, -1), (1, "mcp_servers.tools", 0, 0), (2, "content", 0, -1), (5, "mcp_servers", 0, -1)}
    parents = {r["pk"] for r in t.collect()}
    assert all(r["parent_pk"] in parents or r["sub_pos"] == -1 for r in t.collect())
    shred.write_tables(t, str(tmp_path / "t"))
    child = shred.read_child(spark, str(tmp_path / "t"), "w", "content.content", "type string").orderBy("pos", "sub_pos").collect()
    assert [r["data"]["type"] for r in child] == ["text", "image", "bare"]
    assert shred.shred(df.limit(0), "w", "line_id", {"message": shred.MESSAGE_LEVELS}).count() == 0


def test_pairs_of_backlinks(spark):
    data = {"notes": {"path": "bare", "tags": "x", "frontmatter": {"attendees": [{"n": 1}, None]}}, "backlinks": [["k", [{"s": 1}, None, {"s": 2}]], None, ["q", {"s": 3}], ["only key"]]}
    t = shred.shred(spark.createDataFrame([(1, json.dumps(data))], "id long, data string"), "c", "id", {"data": shred.CACHE_LEVELS})
    got = {(r["tag"], r["pos"], r["sub_pos"]) for r in t.collect()}
    assert got == {("notes", 0, -1), ("notes.tags", 0, 0), ("notes.frontmatter.attendees", 0, 0), ("backlinks", 0, 0), ("backlinks", 0, 2), ("backlinks", 2, 0)}


# ---- expressions -----------------------------------------------------------------------------------------------------------------


def test_expressions(spark):
    df = spark.createDataFrame([(" A/B.MD ", -2.5, "2024-01-01")], "p string, x double, d string")
    r = df.select(
        link_key("p").alias("k"), X.half_up(F.col("x")).alias("h"), X.half_life(F.lit("2023-12-02"), "2024-01-01", 30.0).alias("hl"), X.recency_decay(F.lit(None).cast("timestamp"), "2024-01-01").alias("u"),
        X.npmi(F.lit(5), F.lit(5), F.lit(5), F.lit(100)).alias("n"), X.slug(F.lit(" A b--C! ")).alias("s"), X.hub_boost(F.lit(0)).alias("hb"), X.file_stem(F.lit("a/b.c.md")).alias("st"), X.fuzzy_similarity(F.lit("abcd"), F.lit("abce")).alias("f"),
    ).first()
    assert (r["k"], r["h"], r["u"], r["s"], r["hb"], r["st"]) == ("a/b", -2.0, 0.5, "a-b-c", 0.0, "b.c")
    assert abs(r["hl"] - 0.5) < 1e-9 and abs(r["n"] - 1.0) < 1e-9 and r["f"] == 0.75


@pytest.mark.parametrize("word, stem", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("rational", "ration"), ("adjustment", "adjust"), ("adoption", "adopt"), ("controll", "control"), ("sky", "sky"), ("x1", "x1"), (None, None)])
def test_porter(word, stem):
    assert search.porter(word) == stem


def test_markdown_parts(spark):
    text = '---\ntags: ["a", #b]\nstatus:\n---\n# H1\n\n```\n[[code]] #no\n```\n- [x] done [[Link|Al]] `[[span]]` 2024-01-02\n## H2 \n- [ ] open #t/x\n[[P#h]]'
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "k long, text string")
    lines = markdown.prose_lines(df, "k", markdown.body(F.col("text"))).persist()
    assert {(r["target"], r["alias"]) for r in markdown.wikilinks(lines, "k").collect()} == {("Link", "Al"), ("P", None)}
    assert {r["tag"] for r in markdown.inline_tags(lines, "k").collect()} == {"t/x"}
    assert {r["tag"] for r in markdown.front_tags(df, "k", F.col("text")).collect()} == {"a", "b"}
    t = {r["task"]: (r["status"], r["due"], r["context"]) for r in markdown.tasks(lines, "k").collect()}
    assert t == {"done [[Link|Al]] `[[span]]` 2024-01-02": ("completed", "2024-01-02", "H1"), "open #t/x": ("open", None, "H2")}
    s = markdown.sections(lines, "k").orderBy("ord").collect()
    assert [(r["heading"], r["parent_ord"]) for r in s] == [("H1", None), ("H2", 1)]
    assert {r["field"]: r["kind"] for r in markdown.fields(df, "k", F.col("text")).collect()} == {"tags": "array", "status": "null"}


# ---- graphs ----------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def small_graph(spark):
    rng = random.Random(8)
    names = [f"n{i:02d}" for i in range(30)]
    e = {(rng.choice(names), rng.choice(names)) for _ in range(55)}
    return names, e, spark.createDataFrame(sorted(e), "src string, dst string"), spark.createDataFrame([(n,) for n in names], "k string")


def test_components_hops_and_triangles(spark, small_graph):
    names, e, edges, nodes = small_graph
    adj = defaultdict(set)
    for a, b in e:
        if a != b:
            adj[a].add(b)
            adj[b].add(a)

    def reach(s):
        seen, todo = {s: 0}, [s]
        for x in todo:
            for y in sorted(adj[x]):
                if y not in seen:
                    seen[y] = seen[x] + 1
                    todo.append(y)
        return seen

    assert {r["k"]: r["component"] for r in graph.components(edges, nodes).collect()} == {n: min(reach(n)) for n in names}
    h = {r["k"]: r["hop"] for r in graph.hops(graph.undirected(edges), spark.createDataFrame([("n00",)], "root string"), 30).collect()}
    assert h == reach("n00")
    tri = defaultdict(int)
    for a in names:
        for b in adj[a]:
            for c in adj[b]:
                if a < b < c and c in adj[a]:
                    for x in (a, b, c):
                        tri[x] += 1
    assert {r["k"]: r["n_triangles"] for r in graph.triangles(edges).collect()} == dict(tri)


def test_centrality_and_eigenvector(small_graph):
    names, e, edges, nodes = small_graph
    at = {n: i for i, n in enumerate(names)}
    m = np.zeros((30, 30))
    for a, b in e:
        if a != b:
            m[at[a], at[b]] = m[at[b], at[a]] = 1
    v = np.ones(30)
    for _ in range(50):
        v = v + m @ v
        v /= v.max()
    got = {r["k"]: r["score"] for r in graph.eigenvector(edges, nodes).collect()}
    assert max(abs(got[n] - 100 * v[at[n]]) for n in names) < 1e-3
    n = len(names)
    dist = np.full((n, n), np.inf)
    paths = np.zeros((n, n))
    for s in range(n):
        dist[s, s], paths[s, s], todo = 0, 1, [s]
        for x in todo:
            for y in np.flatnonzero(m[x]):
                if dist[s, y] == np.inf:
                    dist[s, y] = dist[s, x] + 1
                    todo.append(y)
                if dist[s, y] == dist[s, x] + 1:
                    paths[s, y] += paths[s, x]
    want = {}
    for k in range(n):
        b = sum(paths[s, k] * paths[k, t] / paths[s, t] for s in range(n) for t in range(n) if len({s, t, k}) == 3 and dist[s, t] < np.inf and dist[s, k] + dist[k, t] == dist[s, t])
        d = dist[k][(dist[k] > 0) & (dist[k] < np.inf)]
        want[names[k]] = (b / ((n - 1) * (n - 2)), len(d) / d.sum() if len(d) else 0)
    got = {r["k"]: (r["betweenness"], r["closeness"]) for r in graph.centrality(edges, nodes).collect()}
    assert all(abs(got[k][0] - want[k][0]) < 1e-5 and abs(got[k][1] - want[k][1]) < 1e-5 for k in names)


def test_cycles_start_at_their_least_node(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d")], "src string, dst string")
    assert sorted(tuple(r["cycle"]) for r in graph.cycles(e, 3).collect()) == [("a", "b"), ("a", "b", "c")]


def test_pairs_of_large_notes_are_whole(spark):
    m = spark.createDataFrame([("n", f"e{i}") for i in range(12)] + [("m", "e1"), ("m", "e2")], "note string, entity string")
    a = {(r["a"], r["b"]): (r["weight"], r["n"]) for r in association.adamic_adar(m, 5).collect()}
    b = {(r["a"], r["b"]): (r["weight"], r["n"]) for r in association.adamic_adar(m, 50).collect()}
    assert a == b and len(a) == 66 and a["e1", "e2"][1] == 2


# ---- sources, metrics, streams -----------------------------------------------------------------------------------------------------


def test_vault_folder_and_snapshots(spark, tmp_path):
    root = tmp_path / "v"
    for p, t in {"a/One.md": "# x", ".git/two.md": "no", "b.txt": "no", "c/nul.md": "a\0b"}.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    assert [tuple(r) for r in readers.read_vault(spark, str(root)).select("path", "content").collect()] == [("a/One.md", "# x")]
    snap = str(tmp_path / "s")
    df = spark.range(10)
    readers.write_snapshot(df, snap, "2024-01-01 00:00:00")
    assert readers.read_snapshot(spark, snap, 10, "2024-01-01 05:00:00").count() == 10
    assert readers.read_snapshot(spark, snap, 20, "2024-01-01 05:00:00") is None
    assert readers.read_snapshot(spark, snap, 10, "2024-01-03 05:00:00") is None
    with pytest.raises(ValueError):
        readers.write_snapshot(df.limit(0), snap, "2024-01-01 00:00:00")
    (tmp_path / "x.csv").write_text("name,n\na,1\nb,\n")
    assert readers.read_csv(spark, str(tmp_path / "x.csv"), "name string, n int").count() == 2
    (tmp_path / "l.jsonl").write_text('{"ts": "2024-01-01T00:00:00", "component": "c", "message": "m"}\n{"ts": "2023-01-01T00:00:00", "component": "d"}\n')
    assert readers.read_log(spark, str(tmp_path / "l.jsonl"), since="2023-06-01", component="c").count() == 1
    t = spark.createDataFrame([(1, "a")], "k int, v string")
    assert readers.salvage(t, spark.createDataFrame([(1, "b", 0), (2, "c", 0)], "k int, v string, w int"), ["k"]).orderBy("k").collect() == t.union(spark.createDataFrame([(2, "c")], "k int, v string")).collect()


def test_metrics(spark):
    got = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "z")], "query_id int, rank int, doc string")
    rel = spark.createDataFrame([(1, "b"), (1, "c"), (2, "q"), (3, "r")], "query_id int, doc string")
    r = evaluation.retrieval_metrics(got, rel, 2).first()
    assert (r["n_queries"], r["recall"], r["precision"], r["mrr"]) == (3, round(0.5 / 3, 6), round(0.5 / 3, 6), round(0.5 / 3, 6))
    assert spark.range(1).select(evaluation.token_f1(F.lit("a b b"), F.lit("b b c")).alias("f")).first()["f"] == pytest.approx(4 / 6)


def event(spark, rows):
    return spark.createDataFrame(rows, changes.SCHEMA)


def test_changes_in_batch(spark):
    rows = [(1, "A.md", "add", T(2024, 1, 1), "h1"), (3, "a", "unlink", T(2024, 1, 1, 0, 5), None), (4, "x/a.md", "add", T(2024, 1, 1, 0, 5, 2), "h1"), (5, "b", "add", T(2024, 1, 2), "h2"), (2, "a", "change", None, "h0"), (5, "b", "add", T(2024, 1, 2), "h2"), (6, None, "add", None, None)]
    e = event(spark, rows)
    assert {(r["k"], r["action"], r["seq"]) for r in changes.coalesce(e).collect()} == {("a", "delete", 3), ("x/a", "upsert", 4), ("b", "upsert", 5)}
    assert [(r["from_k"], r["to_k"]) for r in changes.renames(e).collect()] == [("a", "x/a")]
    known = spark.createDataFrame([("b", "h2")], "k string, content_hash string")
    assert {r["k"] for r in changes.changed(changes.coalesce(e), known).collect()} == {"a", "x/a"}
    assert changes.coalesce(e.limit(0)).count() == 0
    t = changes.upsert(spark.createDataFrame([("a", 1, "x")], "k string, v int, t string"), spark.createDataFrame([("a", 2, "y"), ("b", 1, "z")], "k string, v int, t string"), ["k"], "v")
    assert {tuple(r) for r in t.collect()} == {("a", 2, "y"), ("b", 1, "z")}


def test_stream_gives_what_a_recomputation_gives(spark, sf, tmp_path):
    src = tmp_path / "log"
    spark.read.parquet(f"{sf}/file_events.parquet").orderBy("seq").repartitionByRange(4, "seq").write.parquet(str(src))
    state = {"t": None}

    def each(batch, _):
        c = changes.coalesce(batch)
        t = c if state["t"] is None else changes.upsert(state["t"], c, ["k"], "seq")
        out = str(tmp_path / f"t{len(list(tmp_path.iterdir()))}")
        t.write.parquet(out)
        state["t"] = spark.read.parquet(out)

    changes.run_stream(changes.read_changes(spark, str(src), 1), each, str(tmp_path / "cp")).awaitTermination()
    want = changes.coalesce(spark.read.parquet(f"{sf}/file_events.parquet"))
    assert sorted(map(repr, state["t"].select(*want.columns).collect())) == sorted(map(repr, want.collect()))


def test_fresh_and_cooldown(spark, tmp_path):
    rows = [(1, "a", "change", T(2024, 1, 1, 0), "h"), (2, "a", "change", T(2024, 1, 1, 1), "h"), (3, "a", "change", T(2024, 1, 2, 2), "g"), (4, "b", "add", T(2024, 1, 1, 0), "h")]
    event(spark, rows).coalesce(1).write.parquet(str(tmp_path / "s"))
    got = {}
    for name, f in (("fresh", lambda s: changes.fresh(s, "3 days").select("seq")), ("cool", lambda s: changes.cooldown(s).select("seq"))):
        q = f(changes.read_changes(spark, str(tmp_path / "s"))).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        got[name] = sorted(r["seq"] for r in spark.table(name).collect())
    assert got["cool"] == [1, 3, 4] and len(got["fresh"]) == 3 and {3, 4} <= set(got["fresh"])


# ---- links in prose ----------------------------------------------------------------------------------------------------------------


def test_mentions_and_links(spark):
    from wherry.operators import linking

    text = "---\ntitle: Alpha Beta\n---\n# Alpha Beta\nAlpha beta and [[Alpha Beta]] `Alpha Beta` alphabet Alpha.\n```\nAlpha Beta\n```\nÉté Alpha Beta https://x/Alpha İ Alpha Beta"
    docs = spark.createDataFrame([(1, text, 7), (2, None, 7), (3, "", 7), (4, "nothing", 7), (5, "Alpha " * 3000, 7)], "k long, t string, start int")
    pats = spark.createDataFrame([("Alpha Beta", 1), ("Alpha", 2), ("beta and", 3), (None, 4), ("alpha", 9)], "pattern string, id long")
    whole = sorted(map(tuple, linking.find_mentions(docs, "k", "t", pats).collect()))
    assert whole == sorted(map(tuple, linking.find_mentions(docs, "k", "t", pats, most=1).collect()))
    got = [(text[a:b], i) for k, a, b, i in whole if k == 1]
    assert got == [("Alpha beta", 1), ("Alpha", 2), ("Alpha Beta", 1), ("Alpha Beta", 1)]
    names = spark.createDataFrame([(1, "Alpha Beta"), (2, "Alpha")], "id long, name string")
    first = linking.first_mentions(linking.find_mentions(docs, "k", "t", pats))
    out = {r["key"]: r["text"] for r in linking.apply_links(docs, "k", "t", first, names).collect()}
    assert out[1] == text.replace("Alpha beta and", "[[Alpha Beta|Alpha beta]] and").replace("alphabet Alpha.", "alphabet [[Alpha]].")
    assert set(out) == {1, 5} and out[5].startswith("[[Alpha]] Alpha Alpha")
    assert linking.find_mentions(docs, "k", "t", pats.limit(0)).count() == 0


def test_layers_can_be_left_out(spark, sf):
    from wherry.plans.linking import suggestion_scores

    full = {(r["doc_id"], r["id"]): r for r in suggestion_scores(spark, sf).collect()}
    bare = {(r["doc_id"], r["id"]): r for r in suggestion_scores(spark, sf, disabled=("hub", "edge", "kind", "feedback")).collect()}
    assert full and all(r["score"] == r["lexical"] for r in bare.values())
    assert len(list(suggestion_scores(spark, sf, "conservative").collect())) <= len(full)
