"""Usage, time-series and health reports over the event log, order metrics and note activity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wherry.operators import vault as V
from wherry.plans.book import Book
from wherry.session import table

AS_OF, DAYS = "2024-01-31", 30
EV_SQL = """
WITH ev AS (SELECT event_id, ts, user_id AS session, event_type AS tool, value AS duration, event_type <> 'error' AS ok, CAST(json_extract_string(props, '$.k') AS BIGINT) AS note, CAST(floor(value * 10) AS BIGINT) AS tokens FROM events),
metric AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderpriority AS metric, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2)
"""
book = Book(EV_SQL)
add = book.add


def events(spark, d, *cols):
    """The event log as tool calls: session, tool, duration, outcome, note and tokens. Only the columns asked for are read."""
    e = table(spark, d, "events").select(
        "event_id", "ts", F.col("user_id").alias("session"), F.col("event_type").alias("tool"), F.col("value").alias("duration"), (F.col("event_type") != "error").alias("ok"), F.get_json_object("props", "$.k").cast("long").alias("note"), F.floor(F.col("value") * 10).cast("long").alias("tokens")
    )
    return e.select(*cols) if cols else e


def metrics(spark, d):
    """A metric series in long form: a day, a metric and its value."""
    return table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("metric")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))


@add("SELECT tool, count(*) AS n_calls, round(avg(duration), 6) AS mean_duration, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS success_rate, max(ts) AS last_used FROM ev GROUP BY 1")
def agg_tool_usage(spark, d):
    """Calls, mean duration, success and last use by tool."""
    return events(spark, d, "tool", "duration", "ok", "ts").groupBy("tool").agg(F.count(F.lit(1)).alias("n_calls"), F.round(F.avg("duration"), 6).alias("mean_duration"), F.round(F.avg(F.when(F.col("ok"), 1.0).otherwise(0.0)), 6).alias("success_rate"), F.max("ts").alias("last_used"))


@add("SELECT note, count(*) AS n_reads, max(ts) AS last_read, count(DISTINCT tool) AS n_tools FROM ev WHERE note IS NOT NULL GROUP BY 1")
def agg_note_access(spark, d):
    """Reads, last read and tools by note."""
    return events(spark, d, "note", "ts", "tool").where("note is not null").groupBy("note").agg(F.count(F.lit(1)).alias("n_reads"), F.max("ts").alias("last_read"), F.countDistinct("tool").alias("n_tools"))


@add("SELECT session, min(ts) AS started, max(ts) AS ended, count(*) AS n_calls FROM ev GROUP BY 1 ORDER BY max(ts) DESC, session LIMIT 20")
def agg_sessions_recent(spark, d):
    """The 20 sessions that ended last."""
    return events(spark, d, "session", "ts").groupBy("session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("n_calls")).orderBy(F.desc("ended"), "session").limit(20)


@add("SELECT session, tool, count(*) AS n_calls, round(sum(duration), 4) AS spent, count(*) FILTER (WHERE NOT ok) AS n_failed FROM ev GROUP BY 1, 2")
def agg_session_detail(spark, d):
    """Calls, time and failures by session and tool."""
    return events(spark, d, "session", "tool", "duration", "ok").groupBy("session", "tool").agg(F.count(F.lit(1)).alias("n_calls"), F.round(F.sum("duration"), 4).alias("spent"), F.count_if(~F.col("ok")).alias("n_failed"))


@add("SELECT event_id, ts, tool FROM ev ORDER BY ts DESC, event_id LIMIT 50")
def top_recent_calls(spark, d):
    """The 50 latest calls."""
    return events(spark, d, "event_id", "ts", "tool").orderBy(F.desc("ts"), "event_id").limit(50)


@add("SELECT tool, CAST(sum(tokens) AS BIGINT) AS response, CAST(sum(tokens * 4) AS BIGINT) AS baseline, CAST(sum(tokens * 3) AS BIGINT) AS saved, round(sum(tokens) / nullif(sum(tokens * 4.0), 0), 6) AS ratio FROM ev GROUP BY ROLLUP (tool)")
def agg_token_economics(spark, d):
    """Tokens answered against a baseline, by tool and in all (null tool)."""
    return events(spark, d, "tool", "tokens").rollup("tool").agg(F.sum("tokens").alias("response"), F.sum(F.col("tokens") * 4).alias("baseline"), F.sum(F.col("tokens") * 3).alias("saved"), F.round(F.sum("tokens") / F.nullif(F.sum(F.col("tokens") * F.lit(4.0)), F.lit(0.0)), 6).alias("ratio"))


@add("SELECT CAST(ts AS DATE) AS day, count(*) AS n_calls, count(DISTINCT session) AS n_sessions FROM ev GROUP BY 1")
def agg_activity_daily(spark, d):
    """Calls and sessions by day."""
    return events(spark, d, "ts", "session").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n_calls"), F.countDistinct("session").alias("n_sessions"))


@add("WITH p AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM ev GROUP BY 1) SELECT arg_max(day, (n, -epoch(day))) AS busiest_day, max(n) AS n_calls, count(*) AS n_days, round(avg(n), 6) AS mean_calls FROM p")
def agg_activity_summary(spark, d):
    """The busiest day and the mean."""
    p = events(spark, d, "ts").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return p.agg(F.max_by("day", F.struct("n", -F.datediff("day", F.lit("1970-01-01").cast("date")))).alias("busiest_day"), F.max("n").alias("n_calls"), F.count(F.lit(1)).alias("n_days"), F.round(F.avg("n"), 6).alias("mean_calls"))


@add("SELECT metric, day, value FROM metric WHERE day >= DATE '1995-01-01' AND day < DATE '1995-02-01'")
def series_history(spark, d):
    """A metric's values in a month."""
    return metrics(spark, d).where((F.col("day") >= F.lit("1995-01-01").cast("date")) & (F.col("day") < F.lit("1995-02-01").cast("date"))).select("metric", "day", "value")


@add("SELECT metric, arg_max(value, day) AS latest, arg_min(value, day) AS earliest, round(arg_max(value, day) - arg_min(value, day), 2) AS delta, round((arg_max(value, day) - arg_min(value, day)) / nullif(arg_min(value, day), 0) * 100, 4) AS percent, CASE WHEN arg_max(value, day) > arg_min(value, day) THEN 'up' WHEN arg_max(value, day) < arg_min(value, day) THEN 'down' ELSE 'stable' END AS direction FROM metric GROUP BY 1")
def series_trends(spark, d):
    """Latest against earliest value of each metric."""
    m = metrics(spark, d).groupBy("metric").agg(F.max_by("value", "day").alias("latest"), F.min_by("value", "day").alias("earliest"))
    return m.select("metric", "latest", "earliest", F.round(F.col("latest") - F.col("earliest"), 2).alias("delta"), F.round((F.col("latest") - F.col("earliest")) / F.nullif(F.col("earliest"), F.lit(0.0)) * 100, 4).alias("percent"), F.when(F.col("latest") > F.col("earliest"), "up").when(F.col("latest") < F.col("earliest"), "down").otherwise("stable").alias("direction"))


@add("WITH a AS (SELECT metric, arg_max(value, day) AS v FROM metric WHERE day <= DATE '1995-06-30' GROUP BY 1), b AS (SELECT metric, arg_max(value, day) AS v FROM metric WHERE day <= DATE '1997-06-30' GROUP BY 1) SELECT coalesce(a.metric, b.metric) AS metric, a.v AS before, b.v AS after, round(coalesce(b.v, 0) - coalesce(a.v, 0), 2) AS delta FROM a FULL JOIN b ON a.metric = b.metric")
def series_snapshot_diff(spark, d):
    """Values as of two days, and their difference."""
    m = metrics(spark, d)
    at = lambda day, name: m.where(F.col("day") <= F.lit(day).cast("date")).groupBy("metric").agg(F.max_by("value", "day").alias(name))
    j = at("1995-06-30", "before").join(at("1997-06-30", "after"), "metric", "full_outer")
    return j.select("metric", "before", "after", F.round(F.coalesce("after", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)), 2).alias("delta"))


@add("WITH w AS (SELECT o_custkey AS hub, CASE WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN 0 ELSE 1 END AS late, count(*) AS n FROM orders GROUP BY 1, 2), t AS (SELECT hub, late, n, row_number() OVER (PARTITION BY late ORDER BY n DESC, hub) AS r FROM w) SELECT b.hub, b.n AS now_n, coalesce(a.n, 0) AS then_n, b.n - coalesce(a.n, 0) AS growth FROM t b LEFT JOIN t a ON a.hub = b.hub AND a.late = 0 AND a.r <= 10 WHERE b.late = 1 AND b.r <= 10")
def series_emerging_hubs(spark, d):
    """The ten largest hubs of the later half with their growth over the ten of the earlier."""
    w = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("hub"), F.when(F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp_ntz"), 0).otherwise(1).alias("late")).agg(F.count(F.lit(1)).alias("n"))
    t = w.withColumn("r", F.row_number().over(Window.partitionBy("late").orderBy(F.desc("n"), "hub"))).where("r <= 10")
    a, b = t.where("late = 0").select("hub", F.col("n").alias("a")), t.where("late = 1").select("hub", F.col("n").alias("now_n"))
    return b.join(a, "hub", "left").select("hub", "now_n", F.coalesce("a", F.lit(0)).alias("then_n"), (F.col("now_n") - F.coalesce("a", F.lit(0))).alias("growth"))


@add("SELECT count(*) FILTER (WHERE CAST(ts AS DATE) = DATE '2024-01-30') AS n_today, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-30') AS n_24h, round(avg(duration), 6) AS mean_duration, count(*) FILTER (WHERE NOT ok) AS n_failed, arg_max(tool, (ts, event_id)) AS last_tool FROM ev")
def agg_index_activity(spark, d):
    """Runs today and in 24 hours, mean duration, failures and the last run, in one pass."""
    e = events(spark, d, "event_id", "ts", "tool", "duration", "ok")
    return e.agg(F.count_if(F.to_date("ts") == F.lit("2024-01-30").cast("date")).alias("n_today"), F.count_if(F.col("ts") > F.lit("2024-01-30").cast("timestamp_ntz")).alias("n_24h"), F.round(F.avg("duration"), 6).alias("mean_duration"), F.count_if(~F.col("ok")).alias("n_failed"), F.max_by("tool", F.struct("ts", "event_id")).alias("last_tool"))


@add("SELECT tool, count(*) AS n, count(*) FILTER (WHERE ok) AS n_right, round((count(*) FILTER (WHERE ok) + 4.0) / (count(*) + 5.0), 6) AS posterior FROM ev GROUP BY 1 HAVING count(*) >= 15")
def agg_tool_effectiveness(spark, d):
    """Posterior mean of each tool's success with at least 15 calls."""
    g = events(spark, d, "tool", "ok").groupBy("tool").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_right")).where("n >= 15")
    return g.withColumn("posterior", F.round((F.col("n_right") + 4.0) / (F.col("n") + 5.0), 6))


@add("SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2000-01-01') AS start, tool, count(*) AS n, round(sum(duration), 4) AS spent FROM ev GROUP BY 1, 2")
def window_tumbling(spark, d):
    """Calls by tool in windows of six hours."""
    return events(spark, d, "ts", "tool", "duration").groupBy(F.window("ts", "6 hours").alias("w"), "tool").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("duration"), 4).alias("spent")).select(F.col("w.start").alias("start"), "tool", "n", "spent")


@add("WITH s AS (SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '2000-01-01') - INTERVAL 1 HOUR * i AS start, tool FROM ev, (SELECT unnest([0, 1, 2]) AS i)) SELECT start, tool, count(*) AS n FROM s GROUP BY 1, 2")
def window_sliding(spark, d):
    """Calls by tool in windows of three hours that start every hour."""
    return events(spark, d, "ts", "tool").groupBy(F.window("ts", "3 hours", "1 hour").alias("w"), "tool").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "tool", "n")


@add("WITH g AS (SELECT session, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS opens, event_id FROM ev WINDOW w AS (PARTITION BY session ORDER BY ts, event_id)), s AS (SELECT session, ts, sum(opens) OVER (PARTITION BY session ORDER BY ts, event_id) AS no FROM g) SELECT session, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY session, no")
def window_sessions(spark, d):
    """Sessions by gaps of two hours."""
    g = events(spark, d, "session", "ts").groupBy("session", F.session_window("ts", "2 hours").alias("w")).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("n"))
    return g.select("session", "started", "ended", "n")


@add("SELECT tool, n_calls, rank, round(share, 6) AS share, round(running, 6) AS running FROM (SELECT tool, count(*) AS n_calls, rank() OVER (ORDER BY count(*) DESC) AS rank, count(*) / sum(count(*)) OVER () AS share, sum(count(*)) OVER (ORDER BY count(*) DESC, tool ROWS UNBOUNDED PRECEDING) / sum(count(*)) OVER () AS running FROM ev GROUP BY 1)")
def window_shares(spark, d):
    """Rank, share and running share of the tools; windows run over one row per tool."""
    g = events(spark, d, "tool").groupBy("tool").agg(F.count(F.lit(1)).alias("n_calls"))
    all_ = Window.partitionBy()
    run = Window.orderBy(F.desc("n_calls"), "tool").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return g.select("tool", "n_calls", F.rank().over(Window.orderBy(F.desc("n_calls"))).alias("rank"), F.round(F.col("n_calls") / F.sum("n_calls").over(all_), 6).alias("share"), F.round(F.sum("n_calls").over(run) / F.sum("n_calls").over(all_), 6).alias("running"))


@add("SELECT event_id FROM ev WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY")
def filter_retention(spark, d):
    """Events kept by a retention of seven days."""
    return events(spark, d, "event_id", "ts").where(F.col("ts") >= F.lit("2024-01-23").cast("timestamp_ntz")).select("event_id")


@add("WITH a AS (SELECT user_id AS session, ts, event_id FROM events WHERE event_type = 'purchase'), b AS (SELECT user_id AS session, ts, event_id FROM events WHERE event_type = 'error') SELECT a.event_id, arg_max(b.event_id, (b.ts, b.event_id)) AS last_error FROM a JOIN b ON a.session = b.session AND b.ts <= a.ts GROUP BY 1")
def join_asof(spark, d):
    """The last error of the same session at or before each purchase: one sort per session over both sides together, no range join."""
    e = table(spark, d, "events").where(F.col("event_type").isin("purchase", "error")).select("event_id", "ts", "user_id", "event_type")
    err = F.when(F.col("event_type") == "error", F.col("event_id"))
    w = Window.partitionBy("user_id").orderBy("ts", (F.col("event_type") == "purchase").cast("int"), "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return e.withColumn("last_error", F.last(err, ignorenulls=True).over(w)).where("event_type = 'purchase' and last_error is not null").select("event_id", "last_error")


@add("SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.event_type = 'error' AND b.event_type = 'purchase' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 60000000")
def join_near_in_time(spark, d):
    """Errors and purchases within a minute of each other, of any session: a bucketed range join."""
    e = table(spark, d, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    a = e.where("event_type = 'error'").select(F.col("event_id").alias("a"), F.col("us").alias("ua"), F.explode(F.array(*[F.floor(F.col("us") / 60_000_000) + i for i in (-1, 0, 1)])).alias("m"))
    b = e.where("event_type = 'purchase'").select(F.col("event_id").alias("b"), F.col("us").alias("ub"), F.floor(F.col("us") / 60_000_000).alias("m"))
    return a.join(b, "m").where(F.abs(F.col("ua") - F.col("ub")) <= 60_000_000).select("a", "b")


@add("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2", common=False)
def agg_pricing_summary(spark, d):
    """Line items by flag and status."""
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@add("SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE' GROUP BY 1", common=False)
def join_hierarchy(spark, d):
    """Orders by nation of a region, over a hierarchy of keys."""
    o = table(spark, d, "orders").select("o_custkey", "o_totalprice")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey", "n_name")
    r = table(spark, d, "region").where("r_name = 'EUROPE'").select("r_regionkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@add(V.VAULT_SQL + "SELECT (SELECT count(*) FROM notes) AS n_notes, (SELECT count(*) FROM ents) AS n_entities, (SELECT count(*) FROM res) AS n_links, (SELECT count(*) FROM res WHERE target_k IS NULL) AS n_dead, (SELECT count(DISTINCT top) FROM notes) AS n_folders, (SELECT count(*) FROM notes WHERE modified >= (SELECT max(modified) FROM notes) - INTERVAL 7 DAY) AS n_week", common=False)
def agg_vault_stats(spark, d):
    """Totals of the vault."""
    from wherry.plans.graph import base

    n, r, _ = base(spark, d)
    latest = n.agg(F.max("modified").alias("m"))
    a = n.crossJoin(F.broadcast(latest)).agg(F.count(F.lit(1)).alias("n_notes"), F.countDistinct("top").alias("n_folders"), F.count_if(F.col("modified") >= F.col("m") - F.expr("interval 7 days")).alias("n_week"))
    b = r.agg(F.count(F.lit(1)).alias("n_links"), F.count_if(F.col("to").isNull()).alias("n_dead"))
    return a.crossJoin(b).crossJoin(V.entities(spark, d).agg(F.count(F.lit(1)).alias("n_entities")))


@add("WITH m AS (SELECT (SELECT count(*) FROM ev) AS calls, (SELECT count(DISTINCT session) FROM ev) AS sessions, (SELECT count(DISTINCT note) FROM ev) AS notes) SELECT metric, CAST(value AS BIGINT) AS value FROM (UNPIVOT m ON calls, sessions, notes INTO NAME metric VALUE value)")
def agg_metrics_long(spark, d):
    """One-row metrics in long form, as they are appended to a metric table."""
    a = events(spark, d, "session", "note").agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("session").alias("sessions"), F.countDistinct("note").alias("notes"))
    return a.unpivot([], ["calls", "sessions", "notes"], "metric", "value")


@add("SELECT l_linestatus, count(*) FILTER (WHERE l_returnflag = 'A') AS flag_a, count(*) FILTER (WHERE l_returnflag = 'N') AS flag_n, count(*) FILTER (WHERE l_returnflag = 'R') AS flag_r FROM lineitem GROUP BY 1", common=False)
def agg_pivot(spark, d):
    """Counts by mode with a column per flag."""
    p = table(spark, d, "lineitem").groupBy("l_linestatus").pivot("l_returnflag", ["A", "N", "R"]).agg(F.count(F.lit(1)))
    return p.select("l_linestatus", *[F.coalesce(F.col(x), F.lit(0)).alias(f"flag_{x.lower()}") for x in ("A", "N", "R")])


QUERIES, SQL = book.queries, book.sql
