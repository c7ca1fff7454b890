"""Conversations out of message rows: pointers to the message before, pointer jumping, and checks that decide which sessions are whole.

Rows become messages by aggregation. A global range sort by session, run and line numbers the messages; each points to the one before
it in its session. Pointer jumping then doubles every pointer's reach per round until it stands at a root, which gives each message its
root and its place on the path from there; pointers to nothing are orphans, pointers that never reach a root are cycles. No session is ever gathered
into one task, so a session with a third of all rows is as good as any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wherry.operators.shred import parse
from wherry.session import cut, hot_join

_ROWS = "session_id string, run string, line_no int, uuid string, mid string, role string, ok boolean, has_text boolean, others boolean, n_results int, uses array<string>, results array<string>"
_ARROW = pa.schema(
    [("session_id", pa.string()), ("run", pa.string()), ("line_no", pa.int32()), ("uuid", pa.string()), ("mid", pa.string()), ("role", pa.string()), ("ok", pa.bool_()), ("has_text", pa.bool_()), ("others", pa.bool_()), ("n_results", pa.int32()), ("uses", pa.list_(pa.string())), ("results", pa.list_(pa.string()))]
)


def resolve_pointers(nodes: DataFrame, most_rounds: int = 64) -> DataFrame:
    """``id, root, depth, state`` for ``nodes(id, parent)``, one row per id; ``parent`` null is a root.

    ``state`` is ``rooted``, ``orphan`` (the path ends at a parent that is no node; ``root`` is then that missing id, ``depth`` the steps to
    it) or ``cycle`` (``root`` null). Each round joins the pointers still under way with all pointers, so a path of length n takes about
    log2 n rounds, and every round is cut by a checkpoint. Pointers that have arrived leave the join; a node that very many point to is
    joined where they stand (``hot_join``). Paths still under way after ``most_rounds`` raise.
    """
    n = nodes.select(F.col("id"), F.col("parent"))
    known = n.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
    s = hot_join(n, known, "parent", "left").select(
        "id",
        F.coalesce("parent", "id").alias("at"),
        F.when(F.col("parent").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("dist"),
        F.when(F.col("parent").isNull(), F.lit("rooted")).when(F.col("there").isNull(), F.lit("orphan")).otherwise(F.lit("going")).alias("state"),
    )
    s = cut(s)
    before = -1
    for _ in range(most_rounds):
        going = s.where("state = 'going'").count()
        if going == 0:
            break
        # in a cycle nobody arrives: when a whole round brings none in, what is left are cycles and paths into them
        if going == before:
            break
        before = going
        t = s.select(F.col("id").alias("at"), F.col("at").alias("at2"), F.col("dist").alias("d2"), F.col("state").alias("s2"))
        moved = hot_join(s.where("state = 'going'").select("id", "at", "dist"), t, "at", "inner").select("id", F.col("at2").alias("at"), (F.col("dist") + F.col("d2")).alias("dist"), F.col("s2").alias("state"))
        s = cut(s.where("state <> 'going'").unionByName(moved))
    else:
        raise RuntimeError(f"pointers are not resolved after {most_rounds} rounds")
    return s.select("id", F.when(F.col("state") != "going", F.col("at")).alias("root"), F.when(F.col("state") != "going", F.col("dist")).alias("depth"), F.when(F.col("state") == "going", F.lit("cycle")).otherwise(F.col("state")).alias("state"))


def read_messages(warmup: DataFrame) -> DataFrame:
    """What matters of each user and assistant row, by one pass over its JSON: role, text, tool calls and results."""

    def text_of(blocks: list) -> bool:
        return any((isinstance(b, str) and b.strip()) or (isinstance(b, dict) and b.get("type") == "text" and isinstance(b.get("text"), str) and b["text"].strip()) for b in blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for kind, session, run_, line, uuid, m in zip(*(c.to_pylist() for c in b.columns)):
                v = parse(m)
                ok = isinstance(v, dict)
                v = v if ok else {}
                content = v.get("content")
                blocks = [x for x in (content if isinstance(content, list) else [content]) if x is not None]
                role = v.get("role")
                role = role.strip().lower() if isinstance(role, str) and role.strip() else kind
                types = [x.get("type") if isinstance(x, dict) else "text" for x in blocks]
                ident = lambda x, k: x[k] if isinstance(x.get(k), str) else ""
                uses = [ident(x, "id") for x in blocks if isinstance(x, dict) and x.get("type") == "tool_use"]
                results = [ident(x, "tool_use_id") for x in blocks if isinstance(x, dict) and x.get("type") == "tool_result"]
                mid = v.get("id") if isinstance(v.get("id"), str) and v.get("id") else None
                rows.append((session, run_, line, uuid, mid, role, ok, bool(text_of(blocks)), any(t != "tool_result" for t in types), len(results), uses, results))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    w = warmup.where(F.col("type").isin("user", "assistant") & F.col("session_id").isNotNull())
    return w.select("type", "session_id", "run", F.col("line_no").cast("int"), "uuid", "message").mapInArrow(run, _ROWS)


def numbered(messages: DataFrame) -> DataFrame:
    """Messages with ``node``, their place in the global order of session, run, line and key, and ``parent``, the node before in the same session.

    One range sort, written to the shared folder; of each partition only its size and its last session go to the driver.
    """
    order = ["session_id", "run", "line_no", "msg_key"]
    s = messages.repartitionByRange(*order).sortWithinPartitions(*order)
    s = cut(s.withColumn("pid", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()))
    ends = s.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), F.max_by("session_id", "seq").alias("last"), F.min("seq").alias("low")).orderBy("pid").collect()
    rows, at, prev = [], 0, None
    for r in ends:  # one row per partition
        rows.append((r["pid"], at, r["low"], prev))
        at, prev = at + r["n"], r["last"]
    if not rows:
        return s.select("*", F.lit(0).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"))
    base = s.sparkSession.createDataFrame(rows, "pid int, base long, low long, prev_session string")
    s = s.join(F.broadcast(base), "pid").withColumn("node", F.col("base") + F.col("seq") - F.col("low"))
    first = s.groupBy("session_id").agg(F.min("node").alias("first"))
    # the first node of a session comes by a partial aggregate; sessions are joined on their nodes' side only through node numbers
    roots = first.select(F.col("first").alias("node"), F.lit(True).alias("is_root"))
    return s.join(roots, "node", "left").withColumn("parent", F.when(F.col("is_root").isNull(), F.col("node") - 1)).drop("is_root", "pid", "seq", "base", "low", "prev_session")


def build(warmup: DataFrame) -> DataFrame:
    """All messages in order: ``session_id, turn_no, msg_key, speaker, has_text, node, root, whole`` and the session's damage.

    ``uuid`` that comes again in a session is ignored; rows with the same message id are one message at its first row. Null sessions are
    no conversation; null runs and lines sort first; repeated rows count once; no rows give no messages. ``whole`` is as TESTDATA.md says.
    """
    rows = read_messages(warmup)
    place = F.struct("run", "line_no")
    rest = [c for c in rows.columns if c not in ("session_id", "uuid")]
    ident = F.coalesce("uuid", F.concat(F.lit("row:"), F.coalesce("run", F.lit("")), F.lit(":"), F.coalesce(F.col("line_no").cast("string"), F.lit(""))))
    once = rows.groupBy("session_id", ident.alias("uuid")).agg(F.min(F.struct(*rest)).alias("x")).select("session_id", "uuid", "x.*")
    once = cut(once.withColumn("msg_key", F.coalesce("mid", "uuid")))
    msgs = once.groupBy("session_id", "msg_key").agg(
        F.min(place).alias("place"),
        F.min(F.struct("run", "line_no", "role")).alias("head"),
        F.min("ok").alias("ok"),
        F.max("has_text").alias("has_text"),
        F.max("others").alias("others"),
        F.sum("n_results").alias("n_results"),
        F.sum(F.size("uses")).alias("n_uses"),
    )
    speaker = F.when((F.col("head.role") == "user") & (F.col("n_results") > 0) & ~F.col("others"), F.lit("tool")).otherwise(F.col("head.role"))
    msgs = msgs.select("session_id", F.col("place.run").alias("run"), F.col("place.line_no").alias("line_no"), "msg_key", speaker.alias("speaker"), "ok", "has_text", "n_uses")
    nodes = cut(numbered(msgs))
    paths = resolve_pointers(nodes.select(F.col("node").alias("id"), "parent"))
    m = cut(nodes.join(paths.where("state = 'rooted'"), nodes["node"] == paths["id"]).withColumn("turn_no", F.col("depth").cast("int")).drop("id", "state", "depth"))
    before = m.select((F.col("node") + 1).alias("node"), F.col("session_id").alias("s0"), F.col("speaker").alias("before"))
    m2 = m.join(before, "node", "left").withColumn("before", F.when(F.col("s0") == F.col("session_id"), F.col("before")))
    bad_step = (F.col("before") == "user") & (F.col("speaker") != "assistant")
    bad_user = (F.col("speaker") == "user") & ~F.col("has_text")
    bad_assistant = (F.col("speaker") == "assistant") & ~F.col("has_text") & (F.col("n_uses") == 0)
    sessions = m2.groupBy("session_id", "root").agg(
        F.max(~F.col("ok")).alias("unparsed"),
        F.max(F.coalesce(bad_step, F.lit(False)) | bad_user | bad_assistant).alias("bad_turn"),
        F.min_by("speaker", "turn_no").alias("first"),
        F.max_by(F.struct("speaker", "has_text"), "turn_no").alias("last"),
    )
    # tool calls and results, each at its message's turn
    turns = m.select("session_id", "msg_key", "turn_no")
    uses = once.select("session_id", "msg_key", F.explode("uses").alias("call"))
    results = once.select("session_id", "msg_key", F.explode("results").alias("call"))
    calls = uses.withColumn("use", F.lit(1)).unionByName(results.withColumn("use", F.lit(0))).join(turns, ["session_id", "msg_key"])
    by_call = calls.groupBy("session_id", "call").agg(F.sum("use").alias("n_use"), F.min(F.when(F.col("use") == 1, F.col("turn_no"))).alias("use_turn"), F.max(F.when(F.col("use") == 1, F.col("turn_no"))).alias("last_use"))
    later = calls.where("use = 0").join(by_call.select("session_id", "call", "use_turn", "last_use"), ["session_id", "call"]).groupBy("session_id", "call").agg(
        F.sum(F.when(F.col("turn_no") > F.col("use_turn"), 1).otherwise(0)).alias("n_first"), F.sum(F.when(F.col("turn_no") > F.col("last_use"), 1).otherwise(0)).alias("n_last")
    )
    verdict = by_call.join(later, ["session_id", "call"], "left")
    bad_call = (F.col("call") == "") | (F.col("n_use") == 0) | (F.coalesce("n_first", F.lit(0)) != 1) | (F.coalesce("n_last", F.lit(0)) != 1)
    tools = verdict.groupBy("session_id").agg(F.max(bad_call).alias("bad_call"))
    s = sessions.join(tools, "session_id", "left").select(
        "session_id",
        "unparsed",
        "bad_turn",
        (F.col("first") != "user").alias("bad_start"),
        ((F.col("last.speaker") != "assistant") | ~F.col("last.has_text")).alias("bad_end"),
        F.coalesce("bad_call", F.lit(False)).alias("bad_call"),
        "root",
    )
    whole = ~(F.col("unparsed") | F.col("bad_turn") | F.col("bad_start") | F.col("bad_end") | F.col("bad_call"))
    s = s.withColumn("whole", whole).drop("session_id")
    return by_root(m, s)


def by_root(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Verdicts of sessions brought to their messages; the largest sessions' verdicts are broadcast so that no session fills a task."""
    return hot_join(messages.select("session_id", "turn_no", "msg_key", "speaker", "has_text", "node", "root"), sessions, "root", "inner")
