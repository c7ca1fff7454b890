"""Every query of the core against its SQL on the smallest tables; those without SQL must have rows here and a plain oracle elsewhere."""

import importlib
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import compare  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

CORE = sorted(k for m in entry.PLANS for k in importlib.import_module(f"wherry.plans.{m}").QUERIES)


@pytest.mark.parametrize("name", CORE)
def test_query(spark, sf, name):
    rows, diff = compare(spark, name, sf)
    assert not diff, diff
    assert rows > 0 or name in entry.oracle_sql()


#: Where the queries without SQL are held against a plain definition.
PLAIN = {
    "p7_tool_results": "test_operators.py::test_children_keys_and_damage",
    "graph_eigenvector": "test_plain_oracles.py", "graph_centrality": "test_plain_oracles.py", "eval_retrieval": "test_operators.py::test_metrics", "link_positions": "test_plain_oracles.py", "link_applied": "test_plain_oracles.py",
    "suggest_scored": "test_plain_oracles.py", "search_similar_notes": "test_plain_oracles.py", "suggest_notes_stemmed": "test_plain_oracles.py",
    "search_stemmed": "test_rare_cases.py", "vector_mmr": "test_rare_cases.py", "search_parsed": "test_rare_cases.py", "search_parsed_snippets": "test_rare_cases.py", "search_sections": "test_plain_oracles.py",
}


def test_no_query_is_without_an_oracle():
    assert {n for n in CORE if n not in entry.oracle_sql()} == set(PLAIN)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
