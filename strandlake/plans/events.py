"""Event-time and grouping queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import new_folder
from ..sources import sinks
from ..streaming import events as ev
from .base import query, r6, read


def _events(spark, d):
    return ev.as_events(read(spark, d, "events"))


def _naive(c):
    return F.col(c).cast("timestamp_ntz")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ext01_tumbling_windows(spark, d):
    return ev.windowed(_events(spark, d), ["event_type"], "1 hour").withColumns({"total": F.round("total", 4), "start": _naive("start")})


@query("WITH w AS (SELECT time_bucket(INTERVAL '15 minutes', ts) - k * INTERVAL '15 minutes' AS start, value FROM events, range(0, 4) t(k)) SELECT start, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY start")
def ext01_sliding_windows(spark, d):
    return ev.windowed(_events(spark, d), [], "1 hour", "15 minutes").withColumns({"total": F.round("total", 4), "start": _naive("start")})


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS nw FROM events), s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS \"end\", count(*) AS n FROM s GROUP BY user_id, s")
def ext02_sessions(spark, d):
    return ev.sessions(_events(spark, d), "user_id", "30 minutes").withColumns({"start": _naive("start"), "end": _naive("end")})


@query("SELECT DISTINCT user_id, event_type FROM events")
def ext04_deduplicated(spark, d):
    return ev.deduplicated(_events(spark, d).select("user_id", "event_type"), ["user_id", "event_type"])


@query("WITH r AS (SELECT user_id, event_id, floor((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 8)::BIGINT AS shard FROM events) SELECT user_id, shard, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM r GROUP BY ALL")
def st03_count_shards(spark, d):
    return ev.count_shards(_events(spark, d), "user_id", "ts", "event_id", 8)


@query("SELECT event_type, user_id % 4 AS g, count(*) AS n, grouping(event_type, user_id % 4)::BIGINT AS level FROM events GROUP BY GROUPING SETS ((event_type, user_id % 4), (event_type), ())")
def ext06_grouping_sets(spark, d):
    e = read(spark, d, "events").select("event_type", (F.col("user_id") % 4).alias("g"))
    return e.groupingSets([["event_type", "g"], ["event_type"], []], "event_type", "g").agg(F.count("*").alias("n"), F.grouping_id("event_type", "g").alias("level"))


@query("SELECT event_type, user_id % 4 AS g, count(*) AS n FROM events GROUP BY CUBE (event_type, user_id % 4)")
def ext06_cube(spark, d):
    return read(spark, d, "events").select("event_type", (F.col("user_id") % 4).alias("g")).cube("event_type", "g").agg(F.count("*").alias("n"))


@query("SELECT event_type, user_id % 4 AS g, round(sum(value), 4) AS total FROM events GROUP BY ROLLUP (event_type, user_id % 4)")
def ext06_rollup(spark, d):
    return read(spark, d, "events").select("event_type", (F.col("user_id") % 4).alias("g"), "value").rollup("event_type", "g").agg(F.round(F.sum("value"), 4).alias("total"))


@query("SELECT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'")
def ext06_intersect(spark, d):
    e = read(spark, d, "events")
    return e.where("event_type = 'error'").select("user_id").intersect(e.where("event_type = 'purchase'").select("user_id"))


@query("SELECT user_id FROM events WHERE event_type = 'view' EXCEPT ALL SELECT user_id FROM events WHERE event_type = 'click'")
def ext06_except_all(spark, d):
    e = read(spark, d, "events")
    return e.where("event_type = 'view'").select("user_id").exceptAll(e.where("event_type = 'click'").select("user_id"))


@query("WITH p AS (SELECT user_id, ts AS at FROM events WHERE event_type = 'purchase') SELECT p.user_id, p.at, count(e.event_id) AS n FROM p LEFT JOIN events e ON e.user_id = p.user_id AND e.ts BETWEEN p.at - INTERVAL '6 hours' AND p.at GROUP BY ALL")
def ext06_interval_join(spark, d):
    e = read(spark, d, "events")
    p = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"))
    near = (F.col("e.user_id") == F.col("p.user_id")) & (F.col("e.ts") >= F.col("p.at") - F.expr("INTERVAL 6 HOURS")) & (F.col("e.ts") <= F.col("p.at"))
    return p.alias("p").join(e.alias("e"), near, "left").groupBy("p.user_id", "p.at").agg(F.count("e.event_id").alias("n"))


@query("WITH e AS (SELECT user_id, ts, event_id, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_signup FROM events) SELECT event_id, last_signup FROM e")
def ext07_running_last(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return read(spark, d, "events").select("event_id", F.max(F.when(F.col("event_type") == "signup", F.col("event_id"))).over(w).alias("last_signup"))


@query("SELECT user_id % 10 AS g, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM events GROUP BY 1")
def ext08_moments(spark, d):
    return read(spark, d, "events").groupBy((F.col("user_id") % 10).alias("g")).agg(r6(F.avg("value")).alias("mean"), r6(F.stddev_pop("value")).alias("sd"))


_ARRIVALS = "a AS (SELECT *, floor((day(ts) - 1) / 10)::INTEGER + (event_id % 10 = 0)::INTEGER AS arrival FROM events)"


def _arrived(spark, d, delayed: bool):
    """Events by ten-day stretches, each with the first ten days after the one before; of the delayed, one in ten comes one later."""
    e = _events(spark, d)
    stretch = F.floor((F.dayofmonth("ts") - 1) / 10).cast("int")
    return e.withColumn("arrival", stretch + (F.col("event_id") % 10 == 0).cast("int") if delayed else stretch)


@query(f"WITH {_ARRIVALS}, wm AS (SELECT b, max(ts) FILTER (WHERE arrival < b) - INTERVAL 10 MINUTE AS w FROM a, range(0, 5) t(b) GROUP BY b), k AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS start, value, w FROM a JOIN wm ON b = arrival) SELECT start, count(*) AS n, round(sum(value), 4) AS total FROM k WHERE w IS NULL OR start + INTERVAL '1 hour' > w GROUP BY start HAVING start + INTERVAL '1 hour' <= (SELECT w FROM wm WHERE b = 4)")
def ext03_late_rows(spark, d):
    """Hourly sums of a stream whose rows come late in part: what comes after its window was closed is dropped."""
    rows = _arrived(spark, d, True).select("ts", "value", "arrival")
    with ev.streaming_state(spark):
        out = ev.replay(rows, "arrival", 4, lambda s: ev.windowed(s, [], "1 hour"), new_folder(spark, "late"))
    return out.withColumns({"total": F.round("total", 4), "start": _naive("start")})


@query("WITH r AS (SELECT user_id, event_id, floor((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 8)::BIGINT AS shard FROM events) SELECT user_id, shard, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM r GROUP BY ALL HAVING count(*) = 8")
def ext05_stateful_shards(spark, d):
    """Shards of eight events a user from a stream that is stopped and started twice: full ones leave, the rest waits in state."""
    rows = _arrived(spark, d, False).select("user_id", "ts", "event_id", "arrival")
    with ev.streaming_state(spark):
        return ev.replay(rows, "arrival", 3, lambda s: ev.stateful_shards(s, "user_id", "ts", "event_id", 8), new_folder(spark, "shards"))


@query(f"WITH {_ARRIVALS} SELECT arrival % 3 AS arrival, event_id, event_type, value FROM a")
def snk05_trajectory(spark, d):
    """Records written round by round as JSON lines and appended to a trajectory once each, by a stream started anew each time."""
    rows = _arrived(spark, d, True).select((F.col("arrival") % 3).alias("arrival"), "event_id", "event_type", "value")
    root = new_folder(spark, "trajectory")
    out = None
    for i in range(3):
        rows.where(F.col("arrival") == i).write.mode("append").json(f"{root}/rounds")
        out = sinks.trajectory(spark, f"{root}/rounds", root, "arrival int, event_id long, event_type string, value double")
    return out
