"""The operators for training data against brute force, exact round trips and hand-made cases."""

from __future__ import annotations

import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wherry.llm import canonical, conversations, cooccur, encoding, knn, leakage, mixing, queries, splitting

SF = "/root/testdata/sf0.001"


# ---- splitting -------------------------------------------------------------------------------------------------------------


def check_pieces(text, limit, overlap):
    got = splitting.split(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for (s, e, _), (s2, e2, _) in zip(got, got[1:]):
        assert s2 == max(0, e - overlap) and e2 > e
    assert all(0 < e - s <= limit for s, e, _ in got)
    return got


def test_split_covers_texts_of_all_kinds():
    rng = random.Random(3)
    for _ in range(200):
        words = ["".join(rng.choices("abcdefgäßж界🧵", k=rng.randint(1, 40))) for _ in range(rng.randint(1, 120))]
        text = "".join(w + rng.choice([" ", ". ", "\n", "\n\n", "\n# ", "\n```\n"]) for w in words)
        limit = rng.randint(60, 300)
        check_pieces(text, limit, rng.randint(0, limit // 3))


def test_split_prefers_strong_boundaries_and_keeps_graphemes():
    text = "# A\n\n" + "word " * 60 + "\n\n# B\n\n" + "other " * 40
    got = check_pieces(text, 400, 20)
    assert text[got[0][1] :].startswith("# B")
    long = "é" * 500
    for s, e, at in check_pieces(long, 101, 0):
        assert at in (splitting.HARD, splitting.HEADING)
        assert e == len(long) or long[e] != "́"


def test_split_small_and_empty():
    assert splitting.split("") == []
    assert splitting.split("short") == [(0, 5, splitting.HEADING)]
    with pytest.raises(ValueError):
        splitting.split("x" * 50, 10, 10)


def test_newest_version_decides(spark):
    rows = [("A/x.md", "y" * 7000, "2024-01-01"), ("a/X.md", "short", "2024-02-01"), ("b.md", "z " * 4000, "2024-01-01"), ("b.md", "z " * 4000, "2024-01-01"), (None, "q" * 9000, "2024-01-01"), ("c.md", None, "2024-01-01")]
    df = spark.createDataFrame(rows, "path string, content string, modified string")
    got = splitting.newest_oversized(df).collect()
    assert [r["path"] for r in got] == ["b.md"]
    p = splitting.pieces(splitting.newest_oversized(df), "path", "content").collect()
    assert {r["kind"] for r in p} == {"soft"} and max(len(r["text"]) for r in p) <= 6000
    assert splitting.pieces(df.limit(0), "path", "content").count() == 0


# ---- co-occurrence -----------------------------------------------------------------------------------------------------------


def brute_pairs(rows, least, lift):
    baskets = defaultdict(set)
    for b, i in rows:
        if b is not None and i:
            baskets[b].add(i)
    n = Counter(i for s in baskets.values() for i in s)
    pair = Counter((a, b) for s in baskets.values() for a in s for b in s if a < b)
    N = len(baskets)
    return {(a, b, c) for (a, b), c in pair.items() if c >= least and c * N >= lift * n[a] * n[b]}


@pytest.mark.parametrize("big", [2000, 12])
def test_pairs_against_brute_force_with_and_without_big_baskets(spark, monkeypatch, big):
    monkeypatch.setattr(cooccur, "BIG", big)
    monkeypatch.setattr(cooccur, "TILE", 5)
    rng = random.Random(11)
    rows = []
    for b in range(220):
        size = rng.choice([1, 2, 3, 5, 8]) if b % 20 else 40
        base = rng.randint(0, 9) * 5
        rows += [(f"b{b}", f"i{(base + rng.randint(0, 6)) % 60 if rng.random() < 0.8 else rng.randint(0, 59)}") for _ in range(size)]
    rows += [("b1", None), (None, "i1"), ("b2", ""), ("b3", "i3"), ("b3", "i3")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "basket string, item string, n_ab int")
    got = {(r["item_a"], r["item_b"], r["n_ab"]) for r in cooccur.together(df, "basket", "item", 4, 1.5).collect()}
    assert got == brute_pairs(rows, 4, 1.5) and got


def test_pairs_of_baskets_above_the_real_bound(spark):
    """Baskets of more than ``cooccur.BIG`` items, an item in all of them, pairs in big baskets only and in both kinds."""
    rng = random.Random(8)
    rows = []
    for b in range(9):
        items = {f"x{rng.randint(0, 9000)}" for _ in range(2300)} | {"hub"} | ({"p", "q"} if b < 6 else set()) | ({"r"} if b < 5 else set()) | ({"s"} if b < 4 else set())
        rows += [(f"big{b}", i) for i in items]
    for b in range(600):
        rows += [(f"s{b}", f"x{i}") for i in {rng.randint(0, 9000) for _ in range(3)}] + ([(f"s{b}", "r"), (f"s{b}", "s")] if b < 3 else [])
    assert all(n > cooccur.BIG for b, n in Counter(b for b, _ in rows).items() if b.startswith("big"))
    got = {(r["item_a"], r["item_b"], r["n_ab"]) for r in cooccur.together(spark.createDataFrame(rows, "basket string, item string"), "basket", "item", 5, 3.0).collect()}
    assert got == brute_pairs(rows, 5, 3.0) and {("p", "q", 6), ("r", "s", 7)} <= got


def test_pairs_of_nothing(spark):
    assert cooccur.together(spark.createDataFrame([], "basket string, item string"), "basket", "item").count() == 0


def test_partners_are_ranked_by_significance(spark):
    p = spark.createDataFrame([("a", "b", 5, 2.0, 9.0), ("a", "c", 5, 2.0, 9.0), ("a", "d", 9, 4.0, 20.0)], "item_a string, item_b string, n_ab int, lift double, llr double")
    assert [r["partner"] for r in cooccur.rank_pairs(p, 2).where("item = 'a'").orderBy("rank").collect()] == ["d", "b"]


# ---- leakage -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("sent", [2_000_000, 0])
def test_leaks_against_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(leakage, "SENT_LETTERS", sent)
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(40)] + ["Ünï", "日本", "x1"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([3, 8, 13, 14, 30])))) for i in range(12)] + [(90, None), (91, " ...!? "), (3, "w1 w2 w3")]
    docs = []
    for d in range(120):
        ws = rng.choices(vocab, k=rng.randint(0, 60))
        if rng.random() < 0.6:
            src = leakage.words(items[rng.randint(0, 11)][1])
            a = rng.randint(0, max(0, len(src) - 1))
            ws[len(ws) // 2 : len(ws) // 2] = [w.upper() for w in src[a : a + rng.choice([5, 12, 13, 20])]]
        docs.append((d, rng.choice([" ", "--", "\n* "]).join(ws), d))
    docs += [(500, None, 1), (501, "", 1), docs[3]]

    def contains(doc, item):
        d, w = leakage.words(doc or ""), leakage.words(item or "")
        if not w:
            return False
        n = min(13, len(w))
        wins = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        return any(tuple(d[i : i + n]) in wins for i in range(len(d) - n + 1))

    want = {(d, i) for d, t, _ in docs for i, x in items if contains(t, x)}
    df, it = spark.createDataFrame(docs, "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(df, "doc_id", "text", it, "item_id", "text").collect()}
    assert got == want and want
    assert leakage.leaks(df, "doc_id", "text", it.limit(0), "item_id", "text").count() == 0


def test_items_joined_give_the_same_as_items_sent(spark, monkeypatch):
    docs, items = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/eval_items.parquet")
    items = items.select("item_id", "text").unionByName(spark.createDataFrame([(1, "another text of the first item"), (1, None)], "item_id long, text string"))
    got = []
    for sent in (2_000_000, 0):
        monkeypatch.setattr(leakage, "SENT_LETTERS", sent)
        got.append({(r["doc_id"], r["item_id"], r["n_windows"], round(r["coverage"], 9)) for r in leakage.leaks(docs, "doc_id", "text", items, "item_id", "text").collect()})
    assert got[0] == got[1] and got[0]


# ---- mixing ------------------------------------------------------------------------------------------------------------------


def mix_data(spark):
    rng = random.Random(2)
    docs = [(i, rng.choice(["Big", "big ", "mid", "small"] if i % 30 else ["small"]), "word " * rng.randint(5, 40), 7) for i in range(4000)]
    docs = [(i, s if s != "small" or i % 12 == 0 else "big", t, n) for i, s, t, n in docs]
    docs += [(9001, "mid", None, 0), (9002, None, "some text", 0), (9003, "mid", "  \n ", 0), docs[0]]
    targets = [("m", "big", 1.0, 1), ("m", "MID", 1.0, 2), ("m", "small", 1.0, 4), ("m", "none", 3.0, 4), ("m", "other", None, 4), ("z", "big", 0.0, 2), ("m", "big", 1.0, 1)]
    return spark.createDataFrame(docs, "doc_id long, source string, text string, mix int"), spark.createDataFrame(targets, "mix string, source string, weight double, max_repeats int")


def test_shares_and_caps(spark):
    docs, targets = mix_data(spark)
    copies, plan = mixing.mixed(docs, targets, exact_shares=True)
    copies = copies.persist()
    s = {r["source"]: r for r in mixing.actual_shares(copies, plan).collect()}
    for name, cap in (("big", 1), ("mid", 2), ("small", 4)):
        assert abs(s[name]["actual_share"] - 1 / 3) < 0.005, s[name]
        assert s[name]["most_copies"] <= cap
    assert s["none"]["actual_share"] == 0 and "other" not in s
    assert copies.groupBy("mix", "doc_id", "copy_no").count().where("count > 1").count() == 0
    again = {tuple(r) for r in mixing.mixed(docs, targets, exact_shares=True)[0].select("doc_id", "copy_no").collect()}
    assert again == {tuple(r) for r in copies.select("doc_id", "copy_no").collect()}


def test_small_sources_stop_at_their_cap_and_what_they_lack_is_reported(spark):
    docs, targets = mix_data(spark)
    copies, plan = mixing.mixed(docs, targets)
    copies = copies.persist()
    s = {r["source"]: r for r in mixing.actual_shares(copies, plan).collect()}
    tokens = {r["source"]: r["n"] for r in mixing.token_counts(docs.distinct(), "doc_id", "source", "text").groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    whole = sum(tokens[x] for x in ("big", "mid", "small"))
    assert s["small"]["capped"] and s["small"]["n_tokens"] == 4 * tokens["small"] and not s["mid"]["capped"]
    assert abs(s["small"]["lacking_tokens"] - (whole / 3 - 4 * tokens["small"])) <= 1
    assert abs(s["mid"]["n_tokens"] - whole / 3) < 0.01 * whole / 3 and abs(s["big"]["n_tokens"] - whole / 3) < 0.01 * whole / 3
    assert s["none"]["target_share"] == 0 and s["none"]["lacking_tokens"] == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_shares_of_the_data_against_sql(spark, sf):
    """Shares, caps and documents of the mixes drawn, worked out by SQL from the copies and the texts' own token counts."""
    import duckdb

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    copies = queries.p9_mix(spark, sf).toPandas()
    counts = mixing.token_counts(docs, "doc_id", "source", "text").toPandas()
    shares = queries.p9_shares(spark, sf).toPandas()
    con = duckdb.connect()
    con.register("copies", copies)
    con.register("counts", counts)
    con.register("shares", shares)
    con.execute(f"CREATE VIEW mix_targets AS SELECT * FROM read_parquet('{sf}/mix_targets.parquet')")
    assert con.execute("SELECT count(*) FROM copies c LEFT JOIN counts n USING (doc_id) WHERE n.n_tokens IS DISTINCT FROM c.n_tokens OR n.source <> c.source").fetchone()[0] == 0
    assert con.execute("SELECT count(*) FROM (SELECT mix, doc_id, copy_no FROM copies GROUP BY ALL HAVING count(*) > 1)").fetchone()[0] == 0
    assert con.execute("SELECT count(*) FROM (SELECT mix, source, doc_id, count(*) AS n FROM copies GROUP BY ALL) c JOIN (SELECT mix, lower(trim(source)) AS source, max(max_repeats) AS m FROM mix_targets GROUP BY ALL) t USING (mix, source) WHERE c.n > t.m").fetchone()[0] == 0
    bad = con.execute("""
        WITH t AS (SELECT mix, lower(trim(source)) AS source, max(weight) AS w FROM mix_targets WHERE weight > 0 AND source IS NOT NULL AND mix IS NOT NULL GROUP BY ALL),
        s AS (SELECT source, sum(n_tokens) AS n FROM counts WHERE n_tokens > 0 AND source IS NOT NULL GROUP BY ALL),
        j AS (SELECT t.mix, source, w / sum(w) OVER (PARTITION BY mix) AS share, sum(n) OVER (PARTITION BY mix) AS whole FROM t JOIN s USING (source)),
        g AS (SELECT mix, source, sum(n_tokens) AS n FROM copies GROUP BY ALL), a AS (SELECT *, n / sum(n) OVER (PARTITION BY mix) AS actual FROM g)
        SELECT * FROM shares r LEFT JOIN j USING (mix, source) LEFT JOIN a USING (mix, source)
        WHERE abs(r.target_share - coalesce(j.share, 0)) > 1e-9 OR abs(r.actual_share - coalesce(a.actual, 0)) > 1e-9 OR abs(r.want_tokens - coalesce(j.share * j.whole, 0)) > 1""").fetchall()
    assert bad == []


def test_poisson_inversion_and_empty_tables(spark):
    cdf = mixing.thresholds(0.7, 4)
    u = (np.arange(100_000) + 0.5) / 100_000
    n = sum((u >= c).astype(int) for c in cdf)
    want = sum(min(k, 4) * np.exp(-0.7) * 0.7**k / float(np.prod(np.arange(1, k + 1))) for k in range(30))
    assert abs(n.mean() - want) < 1e-3 and n.max() == 4
    docs, targets = mix_data(spark)
    c, p = mixing.mixed(docs, targets.limit(0))
    assert c.count() == 0 and mixing.actual_shares(c, p).count() == 0
    c, p = mixing.mixed(docs.limit(0), targets)
    assert c.count() == 0


# ---- encodings ---------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return encoding.train(encoding.sample(docs, "doc_id", "text", "lang"))


CLEAN = {
    "fr": "Après la réunion, la requête a été déplacée près du château d’eau. Les résultats sont présentés à l’équipe.",
    "de": "Während der Prüfung fielen 13 tote Verweise auf. Für die Übersicht fehlt weiterhin eine gültige Übersetzung.",
    "pl": "Następna część będzie dłuższa i trudniejsza. Zespół chciałby wkrótce zamknąć indeks.",
    "ru": "Заметка требует новой сводки. Поиск вернул старые страницы без объяснений. Граф ссылок стал заметно плотнее.",
    "es": "¿Quién mantendrá la página el próximo año? También se revisó según el índice.",
}


@pytest.mark.parametrize("enc", ["cp1252", "latin-1", "cp1250", "mac_roman", "cp437", "cp850"])
def test_utf8_misread_is_restored(model, enc):
    for lang, text in CLEAN.items():
        high = encoding._high(enc)
        bad = "".join(chr(b) if b < 128 else high[b - 128] for b in text.encode())
        out, chain, n, lost = encoding.restore("Plain line.\n" + bad + "\nok", model)
        assert out == "Plain line.\n" + text + "\nok", (lang, enc, chain)
        twice = "".join(chr(b) if b < 128 else high[b - 128] for b in bad.encode())
        assert encoding.restore(twice, model)[0] == text, (lang, enc)


def test_single_byte_misreadings(model):
    assert encoding.restore(CLEAN["ru"].encode("koi8_r").decode("cp1251"), model)[0] == CLEAN["ru"]
    assert encoding.restore(CLEAN["ru"].encode("cp1251").decode("latin-1"), model)[0] == CLEAN["ru"]
    assert encoding.restore(CLEAN["pl"].encode("cp1250").decode("cp1252"), model)[0] == CLEAN["pl"]


def test_passages_of_one_letter_and_long_chains(model):
    assert encoding.restore("Die Pr¸fung war gut.", model)[:2] == ("Die Prüfung war gut.", ["cp1252/mac_roman"])
    bad = CLEAN["fr"]
    for _ in range(6):
        bad = bad.encode().decode("latin-1")
    assert encoding.restore(bad, model)[0] == CLEAN["fr"]


def test_right_texts_are_left_alone(model):
    for text in [*CLEAN.values(), "Budget: £14 + €1 ≤ ¥18, √2 ≈ 1.4 ± 0.1 σ", "“CAFÉ Ångström” at 21° ×4 → √3", "ATENÇÃO: NÃO APAGAR A DESCRIÇÃO", "├── a.md\n│   └── b.md", "plain ascii", "", "🧵 ✅ ⚠️ 📅"]:
        assert encoding.restore(text, model)[:2] == (text, []), text


def test_lost_characters_are_reported(spark, model):
    rows = [(1, "W�hrend der Pr�fung", "de"), (2, None, None), (3, "", "de"), (4, "plain", "en"), (5, "RÃ©sumÃ© of the note", "en"), (5, "RÃ©sumÃ© of the note", "en")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, chain int")
    got = {r["doc_id"]: r for r in encoding.garbled(df, model=model).collect()}
    assert set(got) == {1, 5} and not got[1]["restorable"] and got[5]["restored"] == "Résumé of the note"
    assert encoding.garbled(df.limit(0)).count() == 0


# ---- canonical list ----------------------------------------------------------------------------------------------------------

PATTERNS = [("Kroupaestho Field Crawler", 1, False), ("KROCR", 1, True), ("Grástound Junction", 2, False), ("Theitrurgon Pipeline", 3, False), ("Theitrurgon Pipeline 2", 4, False), ("M. Routemtral", 5, False), ("Miatrugro Routemtral", 5, False)]


@pytest.mark.parametrize(
    "term, want",
    [
        ("kroupaestho field crawler", 1), ("  Crawler, Kroupaestho Field ", 1), ("kroupaesthofieldcrawler", 1), ("kruopaestho field carwler", 1), ("theitrurgnpipeline", 3), ("kroupaetso field crawler", -1), ("notes on kroupaestho field crawler", 1), ("krocr", 1), ("krocx", -1), ("crawler", -1), ("kroupaestho pipeline", -1),
        ("[[grastound junction]]", 2), ("grástound junct.", 2), ("theitrurgon pipeline", 3), ("theitrurgon pipelin 2", 4), ("theitrurgon pipeline 3", -1), ("theitrurgon pipeline’s", 3), ("m. routemtral", 5), ("2024-01-01", -1), ("...", -1), ("theitrurgon-pipeline.md", 3),
    ],
)
def test_spellings(term, want):
    assert canonical.Matcher(PATTERNS).best(term)[1] == want


def test_edits_against_plain_definition():
    assert canonical.edits("abcd", "acbd", 2) == 1 and canonical.edits("abcd", "abxcd", 2) == 1 and canonical.edits("kitten", "sitting", 3) == 3 and canonical.edits("a", "abcdef", 2) == 3


def test_values_in_blocks_and_chunks(spark):
    ent = spark.createDataFrame([(i, p, None) for i, p in ((1, "Kroupaestho Crawler"), (2, "Grastound Junction"), (3, None))] + [(4, "Zet Yard", '["ZETYA", "Zet Hub"]'), (5, "Bad Alias", "[not json")], "id long, name string, aliases_json string")
    led = spark.createDataFrame([(1, "zet hub"), (2, "zetya"), (3, None), (4, " "), (5, "grastond junction"), (5, "grastond junction"), (6, "nothing here")], "sighting_id long, term string")
    got = {(r["sighting_id"], r["entity_id"]) for r in canonical.resolve_sightings(led, ent).collect()}
    assert got == {(1, 4), (2, 4), (5, 2), (6, -1)}
    small = canonical.resolve_values(led.select(F.col("term").alias("value")), canonical.patterns_of(ent), block_patterns=2, chunk_values=1)
    assert {(r["value"], r["entity_id"]) for r in small.collect()} == {("zet hub", 4), ("zetya", 4), ("grastond junction", 2), ("nothing here", -1)}
    assert {r["entity_id"] for r in canonical.resolve_sightings(led, ent.limit(0)).collect()} == {-1}
    assert canonical.resolve_sightings(led.limit(0), ent).count() == 0


def test_both_ways_to_match_a_list_give_the_same(spark):
    d = "/root/testdata/sf0.01"
    pats = canonical.patterns_of(spark.read.parquet(f"{d}/entities.parquet"))
    vals = spark.read.parquet(f"{d}/prospect_ledger.parquet").select(F.col("term").alias("value"))
    extra = [("discussed with everybody present the future planning of grastound junction",), ("word " * 5000 + "end",), ("x" * 50_000,)]
    names = [r["pattern"] for r in pats.where("not is_code").orderBy("pattern").limit(3).collect()]
    extra += [(f"a long report about what the team said on {n} in the second meeting of 2024 at noon",) for n in names]
    vals = vals.unionByName(spark.createDataFrame(extra, "value string"))
    whole = {tuple(r) for r in canonical.resolve_values(vals, pats).collect()}
    keyed = {tuple(r) for r in canonical.resolve_values(vals, pats, block_patterns=20, chunk_values=100).collect()}
    assert whole == keyed
    found = {v: e for v, e, _ in whole}
    ids = {r["pattern"]: r["id"] for r in pats.collect()}
    assert all(found[x[0]] == ids[n] for x, n in zip(extra[3:], names))


# ---- vectors -----------------------------------------------------------------------------------------------------------------


def test_nearest_against_brute_force(spark):
    v = queries.vectors(spark, SF).persist()
    exact = {(r["src"], r["model"], r["key"], r["near"]) for r in knn.brute_force(v, v).collect()}
    got = {(r["src"], r["model"], r["key"], r["near"]) for r in knn.nearest(v).collect()}
    assert len(exact & got) >= 0.99 * len(exact) and len(got) == len(exact)


def test_recall_of_a_divided_index(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 32))
    x = np.concatenate([centres[i % 12] + rng.normal(size=32) * 0.3 for i in range(3000)]).reshape(3000, 32)
    v = spark.createDataFrame([("s", "m", f"k{i:05d}", [float(a) for a in x[i]]) for i in range(3000)], "src string, model string, key string, v array<float>")
    p = knn.Params(sample=1500, cells=1.2, probes=20, shard_cells=10, shard=500, work=100_000)
    q = v.where("key like '%00'")
    exact = {(r["key"], r["near"]) for r in knn.brute_force(v, q).collect()}
    got = {(r["key"], r["near"]) for r in knn.nearest(v, 5, p).where("key like '%00'").collect()}
    assert len(exact & got) >= 0.9 * len(exact)


def test_a_vector_that_most_rows_share(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 16))
    x[:250] = x[0]
    v = spark.createDataFrame([("s", "m", f"k{i:05d}", [float(a) for a in x[i]]) for i in range(400)], "src string, model string, key string, v array<float>")
    p = knn.Params(sample=300, cells=1.3, probes=16, shard_cells=4, shard=60, work=5_000)
    got = {(r["key"], r["near"]) for r in knn.nearest(v, 5, p).collect()}
    assert got == {(r["key"], r["near"]) for r in knn.brute_force(v, v).collect()}
    assert {b for a, b in got if a == "k00200"} == {f"k{i:05d}" for i in range(5)} and {b for a, b in got if a == "k00002"} == {f"k{i:05d}" for i in (0, 1, 3, 4, 5)}


def test_unusable_vectors_and_ties(spark):
    good = [1.0, 0.0]
    rows = [("a", good, 1), ("b", [2.0, 0.0], 1), ("c", [3.0, 0.0], 1), ("d", [0.0, 1.0], 1), ("e", [0.0, 0.0], 1), ("f", None, 1), ("g", [float("nan"), 1.0], 1), ("h", [1.0], 1), ("i", good, 1), ("i", None, 2), (None, good, 1), ("a", good, 1)]
    t = spark.createDataFrame([(k, v, "m", u) for k, v, u in rows], "path string, embedding array<float>, model string, updated_at int")
    v = knn.usable(t, "s", "path", {"m": 2})
    assert {r["key"] for r in v.collect()} == {"a", "b", "c", "d"}
    got = defaultdict(list)
    for r in knn.nearest(v, 2).orderBy("key", "rank").collect():
        got[r["key"]].append(r["near"])
    assert got == {"a": ["b", "c"], "b": ["a", "c"], "c": ["a", "b"], "d": ["a", "b"]}
    assert knn.nearest(v.limit(0), 2).count() == 0


# ---- conversations -----------------------------------------------------------------------------------------------------------


def test_pointers_paths_orphans_and_cycles(spark):
    rows = [(0, None)] + [(i, i - 1) for i in range(1, 40)] + [(50, 99), (51, 50), (60, 61), (61, 62), (62, 60), (63, 60), (70, None), (71, 70), (72, 70)]
    got = {r["id"]: (r["root"], r["depth"], r["state"]) for r in conversations.resolve_pointers(spark.createDataFrame(rows, "id long, parent long")).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == (0, i, "rooted") for i in range(40))
    assert got[51] == (99, 2, "orphan") and got[72] == (70, 1, "rooted")
    assert all(got[i][2] == "cycle" and got[i][0] is None for i in (60, 61, 62, 63))
    assert conversations.resolve_pointers(spark.createDataFrame([], "id long, parent long")).count() == 0


def test_a_root_that_a_third_of_all_rows_point_to(spark):
    rows = [(0, None), (1, 0)] + [(i, 1) for i in range(2, 1500)] + [(i, i - 1) for i in range(1500, 3000)] + [(i, -5) for i in range(4000, 5500)]
    rows = [(i, None if i == 1500 else p) for i, p in rows]
    got = {r["id"]: (r["root"], r["depth"], r["state"]) for r in conversations.resolve_pointers(spark.createDataFrame(rows, "id long, parent long")).collect()}
    assert all(got[i] == (0, 2, "rooted") for i in range(2, 1500)) and all(got[i] == (1500, i - 1500, "rooted") for i in range(1500, 3000))
    assert all(got[i] == (-5, 1, "orphan") for i in range(4000, 5500)) and len(got) == len(rows)


def brute_conversations(rows):
    """Whole sessions by a plain loop over each session's rows."""
    from wherry.operators.shred import parse

    sessions = defaultdict(list)
    for r in rows:
        if r["type"] in ("user", "assistant") and r["session_id"] is not None:
            sessions[r["session_id"]].append(r)
    out = set()
    for sid, rs in sessions.items():
        seen, msgs, ok = set(), {}, True
        for r in sorted(rs, key=lambda r: (r["run"], r["line_no"])):
            if r["uuid"] in seen:
                continue
            seen.add(r["uuid"])
            m = parse(r["message"])
            if not isinstance(m, dict):
                ok = False
                break
            c = m.get("content")
            blocks = [b for b in (c if isinstance(c, list) else [c]) if b is not None]
            key = m.get("id") or r["uuid"]
            msgs.setdefault(key, {"role": (m.get("role") or r["type"]).strip().lower(), "blocks": []})["blocks"] += blocks
        if not ok:
            continue
        order = list(msgs.items())
        uses, results = defaultdict(list), defaultdict(list)
        for t, (_, m) in enumerate(order):
            bs = m["blocks"]
            m["text"] = any((b if isinstance(b, str) else b.get("text") if b.get("type") == "text" else "") and (b if isinstance(b, str) else b["text"]).strip() for b in bs)
            m["use"] = any(isinstance(b, dict) and b.get("type") == "tool_use" for b in bs)
            if m["role"] == "user" and bs and all(isinstance(b, dict) and b.get("type") == "tool_result" for b in bs):
                m["role"] = "tool"
            for b in bs:
                if isinstance(b, dict) and b.get("type") == "tool_use":
                    uses[b.get("id")].append(t)
                if isinstance(b, dict) and b.get("type") == "tool_result":
                    results[b.get("tool_use_id")].append(t)
        whole = order and order[0][1]["role"] == "user" and order[-1][1]["role"] == "assistant" and order[-1][1]["text"]
        for t, (_, m) in enumerate(order):
            if m["role"] == "user" and not (m["text"] and t + 1 < len(order) and order[t + 1][1]["role"] == "assistant"):
                whole = False
            if m["role"] == "assistant" and not (m["text"] or m["use"]):
                whole = False
        if any(k not in uses for k in results) or any(sum(x > t for x in results[k]) != 1 for k, ts in uses.items() for t in ts):
            whole = False
        if whole:
            out |= {(sid, t, k) for t, (k, _) in enumerate(order)}
    return out


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_conversations_against_a_plain_loop(spark, sf):
    w = spark.read.parquet(f"{sf}/warmup.parquet")
    got = {tuple(r) for r in queries.p4_found(spark, sf).collect()}
    assert got == brute_conversations(w.collect()) and got


def test_conversations_of_a_hot_session_and_of_nothing(spark):
    rows = []
    for i in range(300):
        role = "user" if i % 2 == 0 else "assistant"
        rows.append((i, "r1", i, role, None, "hot", f"u{i}", None, json.dumps({"role": role, "content": f"text {i}"}), None))
    rows.append((900, "r1", 900, "user", None, None, "n", None, None, None))
    schema = "line_id long, run string, line_no int, type string, subtype string, session_id string, uuid string, ts timestamp, message string, mcp_servers string"
    m = conversations.build(spark.createDataFrame(rows, schema)).where("whole").orderBy("turn_no").collect()
    assert [r["msg_key"] for r in m] == [f"u{i}" for i in range(300)] and [r["turn_no"] for r in m] == list(range(300))
    assert conversations.build(spark.createDataFrame([], schema)).count() == 0


# ---- very long texts and clashing names ---------------------------------------------------------------------------------------------


def test_very_long_texts(spark, model):
    long = "Für die Übersicht fehlt. " * 40_000
    out = encoding.restore(long + "WÃ¤hrend der PrÃ¼fung.", model)
    assert out[0] == long + "Während der Prüfung." and out[1] == ["utf8/cp1252"]
    check_pieces("wort " * 200_000, 6000, 200)
    check_pieces("x" * 100_000, 6000, 200)
    docs = spark.createDataFrame([(1, "lorem " * 300_000 + "one two three four", "s")], "doc_id long, text string, source string")
    items = spark.createDataFrame([(7, "Two, three FOUR")], "item_id long, text string")
    assert [tuple(r)[:2] for r in leakage.leaks(docs, "doc_id", "text", items, "item_id", "text").collect()] == [(1, 7)]
    assert mixing.token_counts(docs, "doc_id", "source", "text").first()["n_tokens"] > 300_000


def test_extra_columns_with_clashing_names(spark):
    led = spark.createDataFrame([(1, "zet yard", 9, 9.0, "v", "b")], "sighting_id long, term string, entity_id int, score double, value string, block string")
    ent = spark.createDataFrame([(4, "Zet Yard", None, "p", "c")], "id long, name string, aliases_json string, pattern string, is_code string")
    assert [tuple(r) for r in canonical.resolve_sightings(led, ent).select("sighting_id", "entity_id").collect()] == [(1, 4)]
    emb = spark.createDataFrame([(k, [1.0, float(i)], "m", 1, 0.5, "s") for i, k in enumerate("abc")], "path string, embedding array<float>, model string, updated_at int, cos double, src string")
    assert knn.nearest(knn.usable(emb, "s", "path", {"m": 2}), 1).count() == 3
    notes = spark.createDataFrame([("a.md", "w " * 4000, 1, "k", 0)], "path string, content string, modified int, k string, start int")
    assert splitting.pieces(splitting.newest_oversized(notes), "path", "content").count() >= 2
    w = spark.createDataFrame([(1, "r", 1, "user", "s1", "u1", json.dumps({"content": "hi"}), 5, "x"), (2, "r", 2, "assistant", "s1", "u2", json.dumps({"id": "m", "content": [{"type": "text", "text": "yo"}]}), 6, "y")], "line_id long, run string, line_no int, type string, session_id string, uuid string, message string, node int, root string")
    assert [r["msg_key"] for r in conversations.build(w).where("whole").orderBy("turn_no").collect()] == ["u1", "m"]


# ---- training on every labelled text ----------------------------------------------------------------------------------------------------


def test_every_labelled_text_is_trained_on(spark):
    rows = [(i, f"Zdanie numer {i} bez niczego.", "PL ") for i in range(600)]
    order = [r["i"] for r in spark.createDataFrame([(r[0],) for r in rows], "i long").orderBy(F.xxhash64("i")).collect()]
    rows += [(1000 + i, "Die lange Straße\n" * 2000, "de") for i in range(2)] + [(2000, "Ни слова", "xx"), (2001, None, "de")]
    late = set(order[300:])
    rows = [(i, t + " Dłużej." if i in late else t, k) for i, t, k in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = encoding.train(encoding.sample(df, "doc_id", "text", "lang"))
    assert {c for c in m.alphabet if c > "\xa0"} == set("łżß") and set(m.dicts) == {"pl", "de"}


def test_long_languages_are_condensed_and_garbled_ids_are_those_of_garbled(spark, monkeypatch):
    monkeypatch.setattr(encoding, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(encoding, "CONDENSED_BYTES", 4_096)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = encoding.train(encoding.sample(docs, "doc_id", "text", "lang"))
    assert set(m.dicts) == set(encoding.LANGUAGES) and encoding.restore("WÃ¤hrend der PrÃ¼fung", m)[0] == "Während der Prüfung"
    ids = sorted(r["doc_id"] for r in encoding.garbled_ids(docs, model=m).collect())
    assert ids == sorted(r["doc_id"] for r in encoding.garbled(docs, model=m).collect()) != []
