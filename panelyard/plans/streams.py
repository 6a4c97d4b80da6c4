"""Streaming queries over the events; each runs as a bounded stream and is compared with a batch of the same meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import jobs as J
from .catalog import query
from .records import _CLOCK, w31


def local(df, *names):
    """Times as they are stored, without a zone."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in names})


@query("st1_stream_bars", "SELECT * FROM (SELECT event_type AS key, time_bucket(INTERVAL 6 HOUR, ts) AS start, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS volume FROM events GROUP BY ALL) WHERE start + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR", "open high low close", prelude=False)
def st1(spark, d):
    t = J.stream_table(spark, d, "events").select(F.col("event_type").alias("key"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1).cast("long").alias("size"))
    return local(J.finished(J.stream_bars(t, "6 hours", "1 hour"), "st1"), "start")


@query("st2_latest_quote", "SELECT *, bid_at IS NULL OR ask_at IS NULL OR least(bid_at, ask_at) < TIMESTAMP '2024-01-20' AS stale FROM (SELECT user_id AS symbol, arg_max(value, (ts, event_id)) FILTER (event_id % 2 = 0) AS bid, max(ts) FILTER (event_id % 2 = 0) AS bid_at, arg_max(value, (ts, event_id)) FILTER (event_id % 2 = 1) AS ask, max(ts) FILTER (event_id % 2 = 1) AS ask_at FROM events GROUP BY user_id)", "bid ask", prelude=False)
def st2(spark, d):
    side = F.when(F.col("event_id") % 2 == 0, "bid").otherwise("ask")
    q = J.stream_table(spark, d, "events").select(F.col("user_id").alias("symbol"), side.alias("side"), F.col("value").alias("price"), "ts", F.col("event_id").alias("seq"))
    last = J.finished(J.latest_quote(q), "st2", "complete")
    return local(J.stale(last, "2024-01-21", 86_400), "bid_at", "ask_at")


# A row's state is stale (o) or not; it expires before the next row, or before the watermark's end.
_STALENESS = """WITH q AS (SELECT CAST(user_id AS VARCHAR) AS symbol, event_id % 2 AS side, value, CAST(floor(epoch_us(ts) / 1000.0) AS BIGINT) AS ms, event_id AS seq FROM events),
 x AS (SELECT symbol, ms, seq, last_value(CASE WHEN side = 0 THEN ms END IGNORE NULLS) OVER w AS b, last_value(CASE WHEN side = 1 THEN ms END IGNORE NULLS) OVER w AS a, last_value(CASE WHEN side = 0 THEN value END IGNORE NULLS) OVER w AS bid, last_value(CASE WHEN side = 1 THEN value END IGNORE NULLS) OVER w AS ask, lead(ms) OVER (PARTITION BY symbol ORDER BY ms, seq) AS nx FROM q WINDOW w AS (PARTITION BY symbol ORDER BY ms, seq ROWS UNBOUNDED PRECEDING)),
 y AS (SELECT *, b IS NULL OR a IS NULL OR ms - least(a, b) > 86400000 AS o, least(a, b) + 86400000 AS e, coalesce(nx, (SELECT max(ms) - 3600000 FROM q)) AS until FROM x),
 z AS (SELECT *, lag(o OR e < until) OVER (PARTITION BY symbol ORDER BY ms, seq) AS before FROM y)
 SELECT symbol, ms AS at_ms, o AS stale, bid, ask FROM z WHERE before IS NULL OR o <> before UNION ALL SELECT symbol, e, true, bid, ask FROM y WHERE NOT o AND e < until"""


@query("st2_staleness", _STALENESS, "bid ask", prelude=False)
def st2_staleness(spark, d):
    side = F.when(F.col("event_id") % 2 == 0, "bid").otherwise("ask")
    q = J.stream_table(spark, d, "events").select(F.col("user_id").cast("string").alias("symbol"), side.alias("side"), F.col("value").alias("price"), "ts", F.col("event_id").alias("seq"))
    return J.finished(J.quote_staleness(q, 86_400_000, "1 hour"), "st2-staleness")


@query("st3_accepted_forecasts", f"SELECT event_id AS forecast_id, ts + to_hours(12 * (event_id % 3)) AS issued_at FROM events JOIN ({_CLOCK}) c ON c.date = CAST(ts AS DATE) WHERE ts + to_hours(12 * (event_id % 3)) >= known_at AND coalesce(ts + to_hours(12 * (event_id % 3)) < earliest_execution_at, true)", prelude=False)
def st3(spark, d):
    f = J.stream_table(spark, d, "events").select(F.col("event_id").alias("forecast_id"), F.to_date("ts").alias("decision_date"), F.expr("ts + make_dt_interval(0, cast(12 * (event_id % 3) as int))").alias("issued_at"))
    return local(J.finished(J.accepted_forecasts(f, w31(spark, d)), "st3"), "issued_at").select("forecast_id", "issued_at")


@query("st4_freeze_once", "SELECT DISTINCT user_id AS version, CAST(ts AS DATE) AS decision_date FROM events", prelude=False)
def st4(spark, d):
    r = J.stream_table(spark, d, "events").select(F.col("user_id").alias("version"), F.to_date("ts").alias("decision_date"), "ts")
    return J.finished(J.freeze_once(r, ("version", "decision_date"), "ts", "30 days"), "st4").select("version", "decision_date")


@query("st5_forecast_outcomes", "SELECT f.event_id AS forecast_id, o.event_id AS outcome_id FROM events f JOIN events o ON f.user_id = o.user_id AND f.event_id % 2 = 0 AND o.event_id % 2 = 1 AND o.ts > f.ts AND o.ts <= f.ts + INTERVAL 2 DAY", prelude=False)
def st5(spark, d):
    def side(k, at, name):
        return J.stream_table(spark, d, "events").filter(F.col("event_id") % 2 == k).select(F.col("user_id").alias("key"), F.col("ts").alias(at), F.col("event_id").alias(name))

    j = J.forecast_outcomes(side(0, "issued_at", "forecast_id"), side(1, "observed_at", "outcome_id"), "1 day", "2 days")
    return J.finished(j, "st5").select("forecast_id", "outcome_id")
