"""Queries of the memory store. Prospect sightings stand for memories: the folded term is the key, the display name the value, the pattern that found it the owner (none: shared), the note the thread."""

from __future__ import annotations

from pyspark.sql import functions as F

from wherry.operators import memory as M
from wherry.plans.book import Book
from wherry.plans.search import _BM, _W
from wherry.session import table

AGENT, TERMS = "quoted", ["crawler", "pipeline", "workshop"]
book = Book(
    """
WITH mem AS (SELECT DISTINCT sighting_id AS id, lower(trim(term)) AS key, coalesce(display_name, term) AS value, source AS kind, pattern AS owner, CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.6 ELSE 0.3 END AS confidence, first_seen_at AS created, last_seen_at AS updated, note_path AS thread FROM prospect_ledger WHERE trim(term) <> ''),
cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, owner ORDER BY updated DESC, id DESC) AS rn FROM mem) WHERE rn = 1)
"""
)
add = book.add


def memories(spark, d):
    """The ledger as memories."""
    p = table(spark, d, "prospect_ledger").where(F.trim("term") != "")
    return p.select(
        F.col("sighting_id").alias("id"), F.lower(F.trim("term")).alias("key"), F.coalesce("display_name", "term").alias("value"), F.col("source").alias("kind"), F.col("pattern").alias("owner"),
        M.confidence_of(F.col("confidence")).alias("confidence"), F.col("first_seen_at").alias("created"), F.col("last_seen_at").alias("updated"), F.col("note_path").alias("thread"),
    ).distinct()


@add(f"SELECT key, id, value, owner FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY owner IS NOT NULL DESC, updated DESC, id DESC) AS rn FROM mem WHERE owner IS NULL OR owner = '{AGENT}') WHERE rn = 1")
def memory_get(spark, d):
    """What one agent reads for each key: its own memory before a shared one."""
    return M.get(memories(spark, d), AGENT).select("key", "id", "value", "owner")


@add("SELECT id, key, value, confidence FROM cur WHERE kind = 'dead_link' AND confidence >= 0.6 AND updated >= TIMESTAMP '2024-06-01' ORDER BY updated DESC, id LIMIT 50")
def memory_list(spark, d):
    """The 50 latest current memories of a kind, of some confidence and age."""
    m = M.current(memories(spark, d)).where((F.col("kind") == "dead_link") & (F.col("confidence") >= 0.6) & (F.col("updated") >= F.lit("2024-06-01").cast("timestamp_ntz")))
    return m.orderBy(F.desc("updated"), "id").limit(50).select("id", "key", "value", "confidence")


_TF = ", ".join(f"len(list_filter(wk, lambda v: v = '{t}')) * 1.0 + len(list_filter(wv, lambda v: v = '{t}')) * 1.0 AS t{i}" for i, t in enumerate(TERMS))


@add(
    f"""WITH live AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, owner ORDER BY updated DESC, id DESC) AS r2 FROM mem WHERE owner IS NULL OR owner = '{AGENT}') WHERE r2 = 1 AND confidence >= 0.3),
w AS (SELECT id, key, {_W.format('key')} AS wk, {_W.format('value')} AS wv FROM live), t AS (SELECT id, key, len(wk) + len(wv) AS dl, {_TF} FROM w),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {', '.join(f'count(*) FILTER (WHERE t{i} > 0) AS d{i}' for i in range(len(TERMS)))} FROM t)
SELECT id, key, round({' + '.join(_BM.format(i=i) for i in range(len(TERMS)))}, 6) AS score FROM t, st WHERE {' + '.join(f't{i}' for i in range(len(TERMS)))} > 0 ORDER BY score DESC, id LIMIT 20"""
)
def memory_search(spark, d):
    """The 20 best memories for a query, of those an agent may see and that no later version replaces."""
    return M.search(memories(spark, d), AGENT, TERMS, 0.3, 20)


@add("SELECT id, superseded_by FROM (SELECT id, lead(id) OVER (PARTITION BY key, owner ORDER BY updated, id) AS superseded_by FROM mem) WHERE superseded_by IS NOT NULL")
def memory_superseded(spark, d):
    """Memories that a later one of the same key replaces."""
    return M.supersede(memories(spark, d), "key")


@add("SELECT id, superseded_by FROM (SELECT id, lead(id) OVER (PARTITION BY thread, owner ORDER BY updated, id) AS superseded_by FROM mem WHERE thread IS NOT NULL) WHERE superseded_by IS NOT NULL")
def memory_superseded_by_thread(spark, d):
    """Memories that a later one of the same thread replaces."""
    return M.supersede(memories(spark, d), "thread")


@add("WITH s AS (SELECT id, lead(id) OVER (PARTITION BY key, owner ORDER BY updated, id) AS superseded_by FROM mem), back AS (SELECT id FROM mem WHERE kind = 'implicit') SELECT id, superseded_by FROM s WHERE superseded_by IS NOT NULL AND id NOT IN (SELECT id FROM back) AND superseded_by NOT IN (SELECT id FROM back)")
def memory_unsuperseded(spark, d):
    """The replacements that are left when those from and to implicit memories are taken back."""
    m = memories(spark, d)
    return M.unsupersede(M.supersede(m, "key"), m.where("kind = 'implicit'").select("id"))


@add(
    """WITH r AS (SELECT DISTINCT line_id, session_id, type, subtype, ts FROM warmup WHERE session_id IS NOT NULL)
SELECT session_id, min(ts) AS started, max(ts) AS ended, count(*) FILTER (WHERE type = 'user') AS n_user, count(*) FILTER (WHERE type = 'assistant') AS n_assistant, count(*) FILTER (WHERE type = 'result' AND subtype = 'success') AS n_results FROM r GROUP BY 1 HAVING max(ts) IS NOT NULL ORDER BY max(ts) DESC, session_id LIMIT 30""",
    common=False,
)
def memory_sessions(spark, d):
    """Summaries of the 30 sessions that ended last."""
    r = table(spark, d, "warmup").where("session_id is not null").select("line_id", "session_id", "type", "subtype", "ts").distinct()
    g = r.groupBy("session_id").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count_if(F.col("type") == "user").alias("n_user"), F.count_if(F.col("type") == "assistant").alias("n_assistant"), F.count_if((F.col("type") == "result") & (F.col("subtype") == "success")).alias("n_results"))
    return g.where("ended is not null").orderBy(F.desc("ended"), "session_id").limit(30)


QUERIES, SQL = book.queries, book.sql
