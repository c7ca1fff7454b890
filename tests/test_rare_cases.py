"""Cases the test tables hold few or none of: registered queries against their SQL on tables with such rows added, and operators against plain definitions."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from datetime import datetime
from pathlib import Path

import pandas as pd
import pyarrow.parquet as pq
import pytest
from oracle import compare
from pyspark.sql import functions as F

from wherry.operators import association, entities, memory, retrieval, search
from wherry.session import hot_join, hot_keys
from wherry.streaming import changes

SF = Path("/root/testdata/sf0.001")
AT = datetime(2026, 5, 20, 12)


@pytest.fixture(scope="module")
def rare(tmp_path_factory):
    """The smallest tables with rows added: declared aliases, values and links that are names, periodic notes, bad feedback, resolved terms, vectors of nothing."""
    d = tmp_path_factory.mktemp("rare")
    tables = {p.stem: pd.read_parquet(p) for p in SF.glob("*.parquet")}
    schemas = {p.stem: pq.read_schema(p) for p in SF.glob("*.parquet")}

    def add(name, *rows):
        blank = {c: None for c in tables[name].columns}
        tables[name] = pd.concat([tables[name], pd.DataFrame([{**blank, **r} for r in rows], columns=tables[name].columns)], ignore_index=True)

    at = pd.Timestamp(AT)
    text = '---\naliases: [First Alias, "second"]\nowner: Zeta Works\ntags: [meeting/daily, x]\nparts: [Zeta Works, none]\n---\n\nSee [[ZW]] and [[zeta works]].\n\nOwner: [[Zeta Works]]\nKey fact: none'
    add("documents", {"doc_id": 900001, "text": text, "lang": "en", "source": "rare", "n_chars": len(text), "path": "rare/a.md", "created": at, "modified": at}, {"doc_id": 900002, "text": "", "path": "rare/b.md", "modified": at, "n_chars": 0}, {"doc_id": 900003, "text": None, "path": None})
    add("entities", {"id": 90001, "name": "Zeta Works", "name_lower": "zeta works", "path": "clients/Zeta Works.md", "category": "organizations", "aliases_json": '["ZW", "zeta shop"]', "hub_score": 12}, {"id": 90002, "name": "Lost Bridge", "name_lower": "lost bridge", "path": "places/none.md", "category": "locations", "aliases_json": None, "hub_score": 0})
    notes = ["daily/2026-05-19", "daily/2026-05-20", "journal/2026-w20", "clients/Zeta Works", "archive/2024-01", "rare/readme"]
    add("notes_fts", *[{"path": f"{n}.md", "title": None, "frontmatter": "draft [meeting/daily, x]", "content": "- [ ] open\n\nLost Bridge and zeta works", "modified": at, "created": at} for n in notes])
    old = pd.Timestamp(datetime(2024, 1, 1))
    add("notes_fts", {"path": "clients/Zeta Works.md", "title": "Zeta Works", "frontmatter": "[old]", "content": "x", "modified": old, "created": old})
    add("note_links", *[{"link_id": 800000 + i, "note_path": f"{notes[i % 6]}.md", "target": "bad thing", "weight": 0.2, "weight_updated_at": at} for i in range(40)], *[{"link_id": 810000 + i, "note_path": f"n{i}.md", "target": "ZW", "weight": 0.1, "weight_updated_at": at} for i in range(30)], {"link_id": 820000, "note_path": "rare/readme.md", "target": None, "weight": 1.0})
    add("prospect_summary", {"summary_id": 70001, "term": "Bad Thing", "status": "resolved", "resolved_entity_path": "clients/Zeta Works.md", "updated_at": at})
    add("prospect_ledger", {"sighting_id": 60001, "term": " Bad Thing", "display_name": "Bad Thing", "note_path": "rare/readme.md", "source": "high_score", "confidence": "high", "score": 9.0, "backlink_count": 3, "sighting_count": 1, "first_seen_at": at, "last_seen_at": at})
    add("note_embeddings", {"path": "gone/x.md", "embedding": [1.0] * 64, "content_hash": "h", "model": "vault-mini-v2", "updated_at": at})
    add("entity_embeddings", {"entity_name": "Nobody", "embedding": [1.0] * 64, "source_hash": "h", "model": "vault-mini-v2", "updated_at": at})
    ev = [("unlink", "rare/moved.md", 0), ("add", "other/moved.md", 2), ("unlink", "rare/readme.md", 10), ("add", "other/readme.md", 11)]
    add("file_events", *[{"seq": 10**6 + i, "path": p, "type": t, "ts": at + pd.Timedelta(seconds=s), "content_hash": None if t == "unlink" else "h"} for i, (t, p, s) in enumerate(ev)])
    import pyarrow as pa

    for name, df in tables.items():
        pq.write_table(pa.Table.from_pandas(df, schema=schemas[name], preserve_index=False), d / f"{name}.parquet", coerce_timestamps="us")
    return str(d)


RARE = "scan_aliases schema_link_values schema_from_prose link_aliases_resolved learn_suppressed learn_suppressed_aliases learn_alias_penalties learn_is_suppressed learn_corrections learn_uncorrected embed_orphans embed_entities_due embed_notes_due agg_periodic_folders filter_not_periodic filter_tag_children config_inferred stream_renames mutate_rename_cascade set_tag_diff scan_descriptions agg_unlinked_mentions agg_staleness prospect_scores suggest_notes learn_removals hybrid_channels result_entities agg_feedback_dashboard".split()


@pytest.mark.parametrize("name", RARE)
def test_rare_rows_against_sql(spark, rare, name):
    rows, diff = compare(spark, name, rare)
    assert not diff, diff
    assert rows > 0


@pytest.mark.parametrize("gone", ["notes_fts", "entities", "note_links"])
def test_empty_tables(spark, rare, tmp_path, gone):
    for p in Path(rare).glob("*.parquet"):
        t = pq.read_table(p)
        pq.write_table(t.slice(0, 0) if p.stem == gone else t, tmp_path / p.name)
    import __spark_entry__ as e

    known = e.queries()
    for name in ("memory_get", "suggest_notes", "hybrid_channels", "agg_staleness", "agg_health_checks", "embed_orphans", "search_parsed", "join_common_neighbours", "graph_components", "result_full", "scan_entities"):
        known[name](spark, str(tmp_path)).collect()
    if gone == "notes_fts":
        assert known["embed_orphans"](spark, str(tmp_path)).where("src = 'note_embeddings'").count() == 0  # an empty scan removes nothing


# ---- plain definitions ------------------------------------------------------------------------------------------------------


def test_words_meet_on_the_rarest(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(25)]
    texts = [(i, sorted(set(rng.choices(vocab, k=rng.randint(0, 9))) | ({"w0"} if rng.random() < 0.7 else set()))) for i in range(150)]
    names = [(i, p, sorted(set(rng.choices(vocab, k=rng.randint(1, 4)) + ["w0"] * (i % 2)))) for i in range(40) for p in range(2)]
    names = [(i, p, w, rng.randint(1, len(w))) for i, p, w in names] + [(99, 0, [], 0), (98, 0, ["w1"], 2)]
    want = {(t, i, p): len(set(ws) & set(w)) for t, ws in texts for i, p, w, least in names if w and 0 < least <= len(w) and len(set(ws) & set(w)) >= least}
    for most in (100_000, 0):
        got = association.word_hits(spark.createDataFrame([*texts, (900, None)], "t int, words array<string>"), "t", spark.createDataFrame(names, "id int, p int, w array<string>, least int"), most).collect()
        assert {(r["t"], r["id"], r["p"]): len(r["found"]) for r in got} == want and len(got) == len(want)
        assert all(set(r["found"]) <= set(r["w"]) for r in got)
    none = spark.createDataFrame([], "id int, p int, w array<string>, least int")
    assert association.word_hits(spark.createDataFrame(texts, "t int, words array<string>"), "t", none).count() == 0


def test_large_notes_are_tiled(spark):
    rng = random.Random(2)
    notes = {f"n{i}": set(rng.sample(range(60), rng.choice([1, 2, 3, 30]))) for i in range(12)}
    want = Counter()
    for s in notes.values():
        for a in s:
            for b in s:
                if a < b:
                    want[a, b] += 1 / math.log(len(s)) if len(s) >= 3 else 1.0
    m = spark.createDataFrame([(n, e) for n, s in notes.items() for e in s], "note string, entity int")
    for most, piece in ((200, 2000), (5, 2000), (5, 7)):
        got = {(r["a"], r["b"]): r["weight"] for r in association.adamic_adar(m, most, piece).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_hot_keys_and_joins(spark):
    rows = [("hot", i) for i in range(4000)] + [(None, i) for i in range(4000)] + [(f"k{i}", i) for i in range(3000)]
    left = spark.createDataFrame(rows, "k string, n int")
    assert hot_keys(left, "k") == (["hot"], True)
    right = spark.createDataFrame([("hot", "H"), ("k7", "seven"), ("none", "x"), (None, "null")], "k string, v string")
    for how in ("left", "inner"):
        want = Counter((r["k"], r["n"], r["v"]) for r in left.join(right, "k", how).collect())
        assert Counter((r["k"], r["n"], r["v"]) for r in hot_join(left, right, "k", how).collect()) == want
    assert hot_join(left.limit(0), right, "k", "left").count() == 0


def test_parsed_search_against_a_plain_ranking(spark):
    rng = random.Random(3)
    vocab = "link links linked linking note notes tag set digest indexing index graph graphs the of".split()
    docs = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 4))), " ".join(rng.choices(vocab, k=rng.randint(0, 25)))) for i in range(120)] + [(500, None, None), (501, "", "tag set")]
    query, k = '"tag set" linking graph* index', 10
    stems = ["link", "index"]
    toks = [[re.findall(r"[^\W_]+", (x or "").lower()) for x in (t, c)] for _, t, c in docs]
    weights = (5.0, 1.0)

    def freq(test):
        return [sum(w * sum(map(test, ws)) for w, ws in zip(weights, both)) for both in toks]

    row = [sum(w * sum(ws[i : i + 2] == ["tag", "set"] for i in range(len(ws))) for w, ws in zip(weights, both)) for both in toks]
    parts = [row, *[freq(lambda v, s=s: search.porter(v) == search.porter(s)) for s in ("linking", "index")], freq(lambda v: v.startswith("graph"))]
    dl = [len(a) + len(b) for a, b in toks]
    n, avg = len(docs), sum(dl) / len(docs)
    df = [sum(x > 0 for x in p) for p in parts]
    score = [sum(math.log(1 + (n - d + 0.5) / (d + 0.5)) * p[i] * 2.2 / (p[i] + 1.2 * (0.25 + 0.75 * dl[i] / avg)) for p, d in zip(parts, df)) for i in range(n)]
    ok = [i for i in range(n) if (parts[0][i] > 0 and parts[1][i] > 0) or parts[2][i] > 0 or parts[3][i] > 0]
    want = sorted(((-round(score[i], 6), docs[i][0]) for i in ok))[:k]
    got = retrieval.search(spark.createDataFrame(docs, "id int, title string, body string"), "id", {"path": 0.0, "title": 5.0, "body": 1.0}, query, k).collect()
    assert [(r["id"], round(r["score"], 5)) for r in got] == [(i, round(-s, 5)) for s, i in want] and stems
    assert retrieval.search(spark.createDataFrame(docs, "id int, title string, body string"), "id", {"body": 1.0}, " ", 5).count() == 0


def test_paragraphs_and_windows():
    long = "x" * 60
    text = f"# Head\n\nshort\n\n{long}\n\n## Next\n\n{'y' * 900}\n\ntail"
    ps = retrieval.paragraphs(text)
    assert ps[0] == ("# Head\n\nshort\n\n" + long, "Head") and ps[1][1] == "Next" and ps[1][0].startswith("## Next\n\nyyy") and len(ps[1][0]) == 800 and ps[2] == ("tail", "Next")
    assert retrieval.paragraphs("") == []
    assert retrieval.widen(["a", "b", "c", "d", "e", "f"], 2, 100) == "a\n\nb\n\nc\n\nd\n\ne"
    assert retrieval.widen(["a" * 90, "b", "c" * 90], 1, 100) == "a" * 90 + "\n\nb"


def test_snippets_of_a_page(spark):
    rows = [(1, "Intro without any of it, long enough to stand by itself here.\n\nThe linked digest of the vault stands in this paragraph.\n\nEnd."), (2, "nothing"), (3, None)]
    got = {r["id"]: r for r in retrieval.snippets(spark.createDataFrame(rows, "id int, t string"), "t", "digest linking").collect()}
    assert "linked digest" in got[1]["snippet"] and got[1]["confidence"] == 0.75 and got[2]["snippet"] is None and got[3]["confidence"] == 0.0


def test_dates_in_four_forms(spark):
    t = "On Jan 5, 2024 and 12 March 2023; also May 2022 and 2021-02-03. Sept 7 2020, 3 JUNE 2019; 2021-02-03 again; Mayhem 3, 2020"
    got = spark.createDataFrame([(t,), ("",)], "t string").select(retrieval.dates(F.col("t")).alias("d")).collect()
    assert got[0]["d"] == ["2019-06-01", "2019-06-03", "2020-09-07", "2021-02-03", "2022-05-01", "2023-03-01", "2023-03-12", "2024-01-05"] and got[1]["d"] == []


def test_categories_in_their_order(spark):
    cases = [("Anything", "People/x.md", "people"), ("SQL Basics", None, "technologies"), ("ABC", None, "acronyms"), ("Acme Group", None, "organizations"), ("Lake District", None, "locations"), ("emea", None, "locations"), ("Ada Byron", None, "people"), ("deep thought", None, "concepts"), ("The Long Road", None, "projects"), ("Solo", "misc/Solo.md", "other")]
    got = spark.createDataFrame([(n, p) for n, p, _ in cases], "name string, path string").select("name", entities.category(F.col("name"), F.col("path")).alias("c")).collect()
    assert [r["c"] for r in got] == [c for _, _, c in cases]
    bad = ["2025-01-01", "2025-W17 Sprint", "123", "@handle", "x", "readme.md", "file.txt", "OK", "{{x}}"]
    names = spark.createDataFrame([(f"a/{n}.md",) for n in [*bad, "Good Name", "good name"]], "path string")
    assert [(r["name"], r["path"]) for r in entities.scan(names).collect()] == [("Good Name", "a/Good Name.md")]


def test_memories(spark):
    rows = [(1, "k", "a", "fact", None, 0.9, AT, datetime(2024, 1, 1), "t"), (2, "k", "b", "fact", "me", 0.9, AT, datetime(2023, 1, 1), "t"), (3, "k", "c", "fact", "you", 0.9, AT, datetime(2025, 1, 1), None), (4, "k", "d", "fact", None, 0.1, AT, datetime(2024, 5, 1), "t"), (5, "q", None, "fact", "you", 0.5, AT, None, "u")]
    m = spark.createDataFrame(rows, "id int, key string, value string, kind string, owner string, confidence double, created timestamp, updated timestamp, thread string")
    assert {(r["key"], r["id"]) for r in memory.get(m, "me").collect()} == {("k", 2)}
    assert {(r["key"], r["id"]) for r in memory.get(m, None).collect()} == {("k", 4)}
    links = memory.supersede(m, "key")
    assert {tuple(r) for r in links.collect()} == {(1, 4)}
    assert memory.unsupersede(links, spark.createDataFrame([(4,)], "id int")).count() == 0
    assert memory.get(m.limit(0), "me").count() == 0 and memory.search(m, "me", ["b", "k"], 0.5, 5).select("id").first()[0] == 2


def test_merging_upsert(spark):
    a = spark.createDataFrame([("x", 3.0, 1, "low"), ("y", 1.0, 1, None)], "k string, score double, n int, conf string")
    b = spark.createDataFrame([("x", 2.0, 4, "high"), ("z", None, 1, "odd"), ("y", 5.0, 1, "medium")], a.schema)
    got = {r["k"]: (r["score"], r["n"], r["conf"]) for r in changes.merge_upsert(a, b, ["k"], ["score"], ["n"], {"conf": ["high", "medium", "low"]}).collect()}
    assert got == {"x": (3.0, 5, "high"), "y": (5.0, 2, "medium"), "z": (None, 1, "odd")}


def test_close_vectors_and_bounds(spark):
    rng = random.Random(5)
    vs = [(i, [rng.random() for _ in range(8)]) for i in range(80)]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    want = {(q, i) for q, a in vs[:20] for i, b in vs if q != i and round(cos(a, b), 6) >= 0.9}
    v = spark.createDataFrame(vs, "id long, v array<double>")
    for block in (2000, 6):
        assert {(r["qid"], r["id"]) for r in search.close_vectors(v, v.where("id < 20"), 0.9, block).collect()} == want
    assert search.close_vectors(v, v.limit(0), 0.9).count() == 0
    with pytest.raises(ValueError):
        search.few(v, 10)


def test_diverse_picks_against_a_plain_loop(spark):
    rng = random.Random(7)
    cand = [(1, i, rng.random(), [rng.gauss(0, 1) for _ in range(6)]) for i in range(15)] + [(1, 50, 0.9, None)]
    unit = {i: None if v is None else [x / math.sqrt(sum(y * y for y in v)) for x in v] for _, i, _, v in cand}
    score = {i: s for _, i, s, _ in cand}
    left, picked, top = sorted(score, key=lambda i: (-score[i], i)), [], max(score.values())
    while len(picked) < 6:
        near = lambda i: max((sum(a * b for a, b in zip(unit[i], unit[j])) for j in picked if unit[i] and unit[j]), default=0.0)
        best = max(left, key=lambda i: round(0.7 * score[i] / top - 0.3 * near(i), 9))
        picked.append(best)
        left.remove(best)
    got = search.mmr(spark.createDataFrame(cand, "query_id int, key int, score double, v array<double>"), 6).orderBy("pick").collect()
    assert [r["key"] for r in got] == picked


def test_stemmed_counts_against_a_plain_loop(spark):
    import __spark_entry__ as e
    from wherry.plans.search import TERMS

    docs = pd.read_parquet(SF / "documents.parquet")
    stems = {search.porter(t) for t in TERMS}
    want = {}
    for i, t in zip(docs.doc_id, docs.text):
        hit = [search.porter(w) for w in re.findall(r"[^\W_]+", (t or "").lower())]
        hit = [h for h in hit if h in stems]
        if hit:
            want[i] = (len(hit), len(set(hit)))
    got = {r["doc_id"]: (r["tf"], r["n_terms"]) for r in e.queries()["search_stemmed"](spark, str(SF)).collect()}
    assert got == want and got


def test_stems_are_taken_of_distinct_words_only(spark):
    docs = spark.createDataFrame([(1, "Digests digested, indexing index"), (1, "digest"), (2, "none"), (3, None), (4, "digest digest")], "doc_id int, text string")
    p = search.postings(docs, "doc_id", "text")
    v = search.stem_words(p.select(F.col("term").alias("word")).distinct()).where(F.col("stem").isin("digest"))
    plan = p.join(v, p["term"] == v["word"])._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("MapInArrow") == 1
    got = {tuple(r) for r in search.stemmed_counts(docs, "doc_id", "text", ["digest", "index", "nowhere"]).collect()}
    assert got == {(1, 5, 2), (4, 2, 1)}
    assert search.stemmed_counts(docs, "doc_id", "text", ["nowhere"]).collect() == []


def test_many_queries_are_ranked_as_a_few(spark, sf):
    import __spark_entry__ as e

    rng = random.Random(5)
    word = lambda: f"w{min(int(rng.expovariate(0.08)), 150)}"
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 30)))) for i in range(700)]
    asks = [(i, word()) for i in range(300) for _ in range(rng.randint(1, 5))] + [(300, "w0"), (301, "nowhere"), (302, "w0"), (302, "only"), (303, "only")]
    docs += [(700, "only"), (701, ""), (702, "w0 w0"), (703, "w0 w0"), (704, None)]
    texts = spark.createDataFrame(docs, "id long, text string")
    queries = spark.createDataFrame(asks, "query_id long, term string")
    want = {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 5)) for r in search.bm25_batch(texts, "id", "text", queries, 4).collect()}
    x = texts.select("id", F.size(search.words(F.col("text"))).alias("dl"), search.keep_known(queries)(search.words(F.col("text"))).alias("kept"))
    for shard, block in ((10_000, 10_000), (150, 70)):
        got = {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 5)) for r in search.bm25_many(x, queries, 4, shard=shard, block=block).collect()}
        assert got == want and len(want) > 1000
    # before, contents and all pairs of titles and notes with a word in common were shuffled
    plan = e.queries()["eval_retrieval"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan and "MapInArrow" in plan


def test_only_candidates_meet_pairs(spark, sf, monkeypatch):
    from wherry.plans import suggestion

    pairs = spark.createDataFrame([(1, 2, 0.4), (1, 3, 0.2), (2, 3, 0.9), (4, 5, 1.0)], "a long, b long, npmi double")
    own = spark.createDataFrame([(10, 1), (10, 2), (11, 4)], "k long, id long")
    ask = spark.createDataFrame([(10, 3), (10, 5), (11, 5), (12, 3)], "k long, id long")
    assert {tuple(r) for r in suggestion.cooc(ask, own, pairs).collect()} == {(10, 3, 0.9, 2), (11, 5, 1.0, 1)}
    asked = []
    real = suggestion.cooc
    monkeypatch.setattr(suggestion, "cooc", lambda c, m, p: asked.append((c.count(), c.distinct().count(), c.dtypes[0][1])) or real(c, m, p), raising=False)
    suggestion.note_suggestions(spark, sf, disabled=("stems",))
    # once each and by number; before, every mention met every pair of its entity under the note's path
    assert len(asked) == 1 and asked[0][0] == asked[0][1] > 0 and asked[0][2] == "bigint"


def test_weak_pairs_meet_no_note(spark, sf):
    import __spark_entry__ as e

    pairs = spark.createDataFrame([(1, 2, 0.31), (1, 3, 0.30), (2, 3, 0.95), (3, 4, 0.0), (4, 5, 1.0)], "a int, b int, npmi double")
    up = spark.createDataFrame([(1, True), (2, False), (3, None), (5, True)], "entity int, up boolean")
    want = set()
    for a, b, v in [tuple(r) for r in pairs.collect()]:
        for seed, entity in ((a, b), (b, a)):
            boost = min(math.floor(v * 12 * (1.5 if entity in (1, 5) else 0.5) + 0.5), 12)
            want |= {(seed, entity, boost)} if boost >= 6 else set()
    assert {tuple(r) for r in association.strong_pairs(pairs, up, 6).collect()} == want == {(2, 1, 6), (2, 3, 6), (3, 2, 6), (4, 5, 12), (5, 4, 6)}
    plan = e.queries()["assoc_note_boosts"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "max(boost" in plan and "max(npmi" not in plan


def test_the_entry_survives_a_missing_package(monkeypatch):
    import importlib

    import __spark_entry__ as e

    real = importlib.import_module

    def without(name, *a):
        if name == "wherry.llm.queries":
            raise ModuleNotFoundError("No module named 'zstandard'", name="zstandard")
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", without)
    with pytest.warns(UserWarning, match="zstandard"):
        known = e.queries()
    assert "search_bm25" in known and not any(k.startswith("p2_") for k in known)
