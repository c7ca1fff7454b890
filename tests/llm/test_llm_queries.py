"""Every query of the folder against its SQL on the smallest tables; those without SQL must have rows here and a plain oracle in test_llm_operators.py or below."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle import compare  # noqa: E402

from wherry.llm import queries, splitting  # noqa: E402
from wherry.session import table  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, name):
    rows, diff = compare(spark, name, sf)
    assert not diff, diff
    # the recall is measured on the keys whose hash is divisible by 100, of which the smallest tables may have none
    assert rows > 0 or name in queries.SQL or name == "p3_recall"


def test_recall_of_the_index(spark):
    rows = queries.p3_recall(spark, "/root/testdata/sf0.1").collect()
    assert rows and all(r["recall_at_5"] >= 0.95 for r in rows)


def test_pieces_join_to_the_texts(spark, sf):
    """Every oversized note comes back from its pieces, each at most the limit and overlapping by the stated number."""
    big = {r["path"]: r["content"] for r in splitting.newest_oversized(table(spark, sf, "notes_fts").select("path", "content", "modified")).collect()}
    got = {}
    for r in queries.p5_pieces(spark, sf).orderBy("path", "start").collect():
        got.setdefault(r["path"], []).append((r["start"], r["text"]))
    assert got.keys() == big.keys() and got
    for path, pieces in got.items():
        text = ""
        for start, t in pieces:
            assert len(t) <= 6000 and start <= len(text) and (start == 0 or len(text) - start == 200)
            text = text[:start] + t
        assert text == big[path]


def test_dropped_sessions_are_all_but_the_whole_ones(spark, sf):
    w = table(spark, sf, "warmup").where("type in ('user', 'assistant') and session_id is not null")
    whole = queries.p4_found(spark, sf).select("session_id").distinct().count()
    dropped = queries.p4_dropped(spark, sf)
    assert dropped.agg({"n_sessions": "sum"}).first()[0] == w.select("session_id").distinct().count() - whole
    assert dropped.where("not (unparsed or bad_turn or bad_start or bad_end or bad_call)").count() == 0


def test_unmatched_terms_are_those_found_as_none(spark, sf):
    found = queries.p2_found(spark, sf).where("entity_id = -1").count()
    assert queries.p2_unmatched(spark, sf).agg({"n_sightings": "sum"}).first()[0] == found > 0


def test_restored_documents_are_those_found(spark, sf):
    restored = queries.p10_restored(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    assert {r["doc_id"] for r in restored} == {r["doc_id"] for r in queries.p10_found(spark, sf).collect()}
    for r in restored:
        assert (r["restored"] != texts[r["doc_id"]]) == bool(r["chain"]) and (r["chain"] or r["n_lost"])
