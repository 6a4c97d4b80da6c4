"""Queries of rosters, clocks, ledgers, gates, quotes, orders and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cross as X
from ..functions import series as S
from ..operators import evaluation as E
from ..operators import governance as G
from ..operators import joins as J
from ..operators import orders as O
from ..sources import bars as B
from .catalog import _BRANDS, WSQL, _full, query

_NEXT = "SELECT date, lead(date, 1) OVER (ORDER BY date) AS entry_date, lead(date, 2) OVER (ORDER BY date) AS exit_date FROM cal"


# sources and sinks
@query("s5_s6_result_tables", "SELECT symbol, date, close, year(date) AS year FROM bars", "close")
def s5(spark, d):
    path = B.fresh_path(spark, "results")
    B.write_results(B.panel(spark, d).select("symbol", "date", "close", F.year("date").cast("long").alias("year")), path, ("year",))
    return B.read_results(spark, path, "symbol string, date date, close double, year bigint")


@query("s7_explode_groups", "SELECT n_name AS symbol, r_name AS grp, count(*) OVER (PARTITION BY n_name) AS n FROM nation JOIN region ON n_regionkey = r_regionkey", prelude=False)
def s7(spark, d):
    n = B.table(spark, d, "nation").join(B.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lists = n.groupBy("r_name").agg(F.collect_list("n_name").alias("names"))
    return B.explode_groups(lists.select(F.to_json(F.create_map("r_name", "names")).alias("groups")))


@query("s8_event_counts", "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1", prelude=False)
def s8(spark, d):
    e = B.table(spark, d, "events")
    return B.event_counts(e.select(F.to_json(F.create_map("event_type", F.create_map(F.col("event_id").cast("string"), "props"))).alias("events")))


@query("p14_fingerprint", "SELECT c_custkey, sha256(CAST(to_json({'c_custkey': c_custkey, 'c_mktsegment': c_mktsegment, 'c_name': c_name}) AS VARCHAR)) AS sha FROM customer", prelude=False)
def p14(spark, d):
    return B.table(spark, d, "customer").select("c_custkey", G.canonical_fingerprint(["c_name", "c_custkey", "c_mktsegment"]).alias("sha"))


# rosters and clocks
@query("v7_universe_audit", f"WITH {_BRANDS}, n AS (SELECT count(DISTINCT date) AS n FROM brands), c AS (SELECT symbol, count(*) AS k FROM brands GROUP BY symbol) SELECT p_brand AS symbol, e IS NULL AS included, e AS exclusion, n_bars FROM (SELECT p_brand, coalesce(k, 0) AS n_bars, CASE WHEN p_brand LIKE '%5' THEN 'ineligible' WHEN coalesce(k, 0) <> n THEN 'coverage' END AS e FROM (SELECT DISTINCT p_brand FROM part), n LEFT JOIN c ON p_brand = symbol)", prelude=False)
def v7(spark, d):
    from .catalog import brand_bars

    b = brand_bars(spark, d).withColumn("close", F.lit(1.0))
    roster = B.table(spark, d, "part").select(F.col("p_brand").alias("symbol"), (~F.col("p_brand").endswith("5")).alias("eligible")).distinct()
    return G.universe_audit(roster, b, b.select("date").distinct().count())


_REC = "SELECT o_orderkey AS record, o_orderdate + INTERVAL 3 DAY AS decision_at, o_orderdate AS source_timestamp, o_orderdate + INTERVAL 1 HOUR AS observed_at, o_orderdate + to_days(CAST(o_orderkey % 5 AS INTEGER)) AS known_at, o_orderdate + to_days(CAST(o_orderkey % 4 AS INTEGER)) + INTERVAL 1 HOUR AS calculated_at, o_orderdate + to_days(CAST(2 + o_orderkey % 3 AS INTEGER)) AS earliest_execution_at FROM orders"


@query("v11_availability_check", f"WITH r AS ({_REC}) SELECT record, 'known_at' AS field FROM r WHERE known_at > decision_at UNION ALL SELECT record, 'calculated_at' FROM r WHERE calculated_at > decision_at UNION ALL SELECT record, 'observed_at' FROM r WHERE observed_at > decision_at UNION ALL SELECT record, 'earliest_execution_at' FROM r WHERE earliest_execution_at <= decision_at", prelude=False)
def v11(spark, d):
    o, t, k = B.table(spark, d, "orders"), "o_orderdate", "cast(o_orderkey % {} as int)"
    after = lambda e: F.expr(f"{t} + make_dt_interval({e})")
    return G.availability_check(o.select(F.col("o_orderkey").alias("record"), after("3").alias("decision_at"), F.col(t).alias("source_timestamp"), after("0, 1").alias("observed_at"), after(k.format(5)).alias("known_at"), after(k.format(4) + ", 1").alias("calculated_at"), after("2 + " + k.format(3)).alias("earliest_execution_at")))


@query("v12_availability_registry", f"SELECT feature, min(date) AS first_date, max(date) AS last_date, count(*) AS n, 'close' AS timing, feature <> 'r1' AS uncertified FROM (SELECT date, 'r1' AS feature, close / lag(close, 1) {WSQL} - 1 AS value FROM bars UNION ALL SELECT date, 'r5', close / lag(close, 5) {WSQL} - 1 FROM bars) WHERE value IS NOT NULL GROUP BY feature")
def v12(spark, d):
    p = B.panel(spark, d).select("date", S.change("close", 1).alias("r1"), S.change("close", 5).alias("r5"))
    return G.availability_registry(p.select("date", F.expr("stack(2, 'r1', r1, 'r5', r5) as (feature, value)")), ("r1",))


_SESSIONS = "SELECT date, date + INTERVAL 570 MINUTE AS opens, date + INTERVAL 16 HOUR AS closes FROM (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events) WHERE isodow(date) < 6"
_CLOCK = f"SELECT date, closes AS source_timestamp, closes + INTERVAL 1 HOUR AS known_at, closes + INTERVAL 3601 SECOND AS decision_at, lead(opens) OVER (ORDER BY date) AS earliest_execution_at FROM ({_SESSIONS})"


def event_sessions(spark, d):
    """Weekdays with events, open from 9:30 to 16:00."""
    s = B.table(spark, d, "events").select(F.to_date("ts").alias("date")).distinct().filter(F.weekday("date") < 5)
    at = lambda m: (F.col("date").cast("timestamp_ntz") + F.expr(f"interval {m} minute"))
    return s.select("date", at(570).alias("opens"), at(960).alias("closes"))


@query("w31_decision_clock", _CLOCK, prelude=False)
def w31(spark, d):
    return G.decision_clock(event_sessions(spark, d))


@query("w30_latest_completed", f"SELECT ts AS now, s.date AS session FROM events ASOF LEFT JOIN ({_SESSIONS}) s ON ts >= s.closes + INTERVAL 1 HOUR", prelude=False)
def w30(spark, d):
    return G.latest_completed(event_sessions(spark, d), B.table(spark, d, "events").select(F.col("ts").alias("now")))


# ledgers and gates
@query("l2_registration_check", "SELECT user_id AS id, 'missing seed' AS issue FROM events UNION ALL SELECT user_id, 'missing k' FROM events WHERE NOT json_exists(props, '$.k') UNION ALL SELECT user_id, 'duplicate' FROM events GROUP BY user_id HAVING count(*) > 1", prelude=False)
def l2(spark, d):
    return G.registration_check(B.table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("props").alias("payload")), ("k", "seed"))


@query("l3_forecast_freeze", f"WITH c AS ({_CLOCK}), f AS (SELECT event_id AS forecast_id, event_type AS version, CAST(ts AS DATE) AS decision_date, ts + to_hours(12 * (event_id % 3)) AS issued_at FROM events), j AS (SELECT f.*, CASE WHEN known_at IS NULL THEN 'unknown' WHEN issued_at < known_at THEN 'early' WHEN issued_at >= earliest_execution_at THEN 'late' END AS o FROM f LEFT JOIN c ON date = decision_date) SELECT forecast_id, version, decision_date, issued_at, coalesce(o, CASE WHEN row_number() OVER (PARTITION BY version, decision_date, o IS NULL ORDER BY issued_at, forecast_id) = 1 THEN 'accepted' ELSE 'duplicate' END) AS status FROM j", prelude=False)
def l3(spark, d):
    e = B.table(spark, d, "events")
    f = e.select(F.col("event_id").alias("forecast_id"), F.col("event_type").alias("version"), F.to_date("ts").alias("decision_date"), F.expr("ts + make_dt_interval(0, cast(12 * (event_id % 3) as int))").alias("issued_at"))
    return G.forecast_freeze(f, w31(spark, d)).select("forecast_id", "version", "decision_date", "issued_at", "status")


@query("l6_outcome_order", "WITH x AS (SELECT l_orderkey AS k, o_orderdate AS entry, l_shipdate AS fill, CASE WHEN l_linenumber < 6 THEN l_shipdate + to_days(CAST(3 - l_linenumber AS INTEGER)) END AS mark FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT k AS order_key, 'missing mark' AS issue FROM x WHERE mark IS NULL UNION ALL SELECT k, 'entry > fill' FROM x WHERE entry > fill UNION ALL SELECT k, 'fill > mark' FROM x WHERE fill > mark", prelude=False)
def l6(spark, d):
    j = B.table(spark, d, "lineitem").join(B.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    mark = F.when(F.col("l_linenumber") < 6, F.expr("l_shipdate + make_dt_interval(3 - l_linenumber)"))
    return G.outcome_order_checks(j.select(F.col("l_orderkey").alias("order_key"), F.col("o_orderdate").alias("entry"), F.col("l_shipdate").alias("fill"), mark.alias("mark")), ("entry", "fill", "mark"), "order_key")


@query("l7_p15_effective_fills", "SELECT CAST(l_orderkey AS VARCHAR) AS base, max(l_linenumber) AS revision FROM lineitem GROUP BY 1", prelude=False)
def l7(spark, d):
    ids = B.table(spark, d, "lineitem").select(F.concat(F.col("l_orderkey").cast("string"), F.lit("."), F.format_string("%02d", "l_linenumber")).alias("execution_id"))
    return J.effective_fills(ids).select("base", "revision")


_LEDGER = "SELECT o_orderpriority AS study, CASE WHEN o_orderstatus = 'F' THEN 'trial_started' WHEN o_orderstatus = 'P' THEN 'holdout_opened' ELSE 'note' END AS kind FROM orders"


def ledger(spark, d):
    return B.table(spark, d, "orders").select(F.col("o_orderpriority").alias("study"), F.when(F.col("o_orderstatus") == "F", "trial_started").when(F.col("o_orderstatus") == "P", "holdout_opened").otherwise("note").alias("kind"))


@query("a15_trial_budget", f"SELECT study, n AS started, greatest(0, 1000 - n) AS remaining, n > 1000 AS exceeded FROM (SELECT study, count(*) FILTER (kind = 'trial_started') AS n FROM ({_LEDGER}) GROUP BY study)", prelude=False)
def a15(spark, d):
    return G.trial_budget(ledger(spark, d), 1000)


@query("a16_status_counts", f"SELECT kind, count(*) AS n, kind LIKE 'holdout%' AS opens_holdout FROM ({_LEDGER}) GROUP BY kind", prelude=False)
def a16(spark, d):
    return ledger(spark, d).groupBy("kind").agg(F.count("*").alias("n")).withColumn("opens_holdout", F.col("kind").rlike("^holdout"))


_A1 = "SELECT symbol, exp(sum(ln(1 + r))) - 1 AS total_return, avg(r) / nullif(stddev_samp(r), 0) * sqrt(52) AS sharpe, count(*) AS n FROM r WHERE r IS NOT NULL GROUP BY symbol"


def metrics(spark, d):
    return E.return_metrics(B.panel(spark, d).withColumn("r", S.change("close")), per_year=52)


@query("i5_i6_gates", f"SELECT symbol, total_return > 0 AS gains, sharpe > 0.3 AS steady, n > 300 AS long_enough, total_return > 0 AND sharpe > 0.3 AND n > 300 AS passed, total_return > 0 AND n > 300 AS promoted FROM ({_A1})")
def i5(spark, d):
    g = G.gates(metrics(spark, d), {"total_return": 0.0, "sharpe": 0.3, "n": 300})
    c = F.col("checks")
    return g.select("symbol", c["total_return"].alias("gains"), c["sharpe"].alias("steady"), c["n"].alias("long_enough"), "passed", G.promotion_gate(c, ("total_return", "n")).alias("promoted"))


# quotes and orders
@query("p7_impact_cost", f"SELECT symbol, date, (8.0 * 1.5 + 2 + 10 * sqrt(0.02 * volume * close / adv / 0.01)) / 10000 AS rate FROM (SELECT *, {_full('avg(volume * close)', 'volume', 20)} AS adv FROM bars)", "rate")
def p7(spark, d):
    b = B.panel(spark, d).withColumn("v", F.col("volume") * F.col("close")).withColumn("adv", S.mean("v", 20))
    return b.select("symbol", "date", O.impact_cost_rate(0.02 * F.col("v"), F.col("adv"), 8.0, 1.5, 2.0).alias("rate"))


@query("p8_intended_orders", "SELECT date, symbol, greatest(-cap, least(cap, weight * nav / close - units)) AS delta, nav FROM (SELECT *, volume * close * 0.001 / close AS cap, 10000 + sum(units * close) OVER (PARTITION BY date) AS nav FROM (SELECT *, 1.0 / count(*) OVER (PARTITION BY date) AS weight, floor(volume / 100) AS units FROM bars))", "delta nav")
def p8(spark, d):
    b = B.panel(spark, d).select("date", "symbol", (1 / F.count("*").over(X.wd())).alias("weight"), F.floor(F.col("volume") / 100).cast("double").alias("units"), F.col("close").alias("price"), (F.col("volume") * F.col("close")).alias("adv"), F.lit(10_000.0).alias("cash"))
    return O.intended_orders(b, 0.001, ("date",)).select("date", "symbol", "delta", "nav")


@query("p11_quote_checks", "SELECT event_id, reason, CASE WHEN reason IS NULL THEN (bid + ask) / 2 END AS mid FROM (SELECT *, CASE WHEN bid IS NULL OR bid <= 0 THEN 'bid' WHEN ask IS NULL OR ask <= 0 THEN 'ask' WHEN age > 3000 THEN 'age' WHEN ask < bid THEN 'crossed' WHEN (ask - bid) / ((bid + ask) / 2) * 10000 > 250 THEN 'spread' END AS reason FROM (SELECT event_id, value - 1 AS bid, (value - 1) * (1 + (event_id % 7 - 1) / 100.0) AS ask, epoch(date_trunc('hour', ts)) + 3600 - floor(epoch(ts)) AS age FROM events))", "mid", prelude=False)
def p11(spark, d):
    bid = F.col("value") - 1
    q = B.table(spark, d, "events").select("event_id", bid.alias("bid"), (bid * (1 + (F.col("event_id") % 7 - 1) / 100)).alias("ask"), F.col("ts").alias("at"))
    return O.quote_checks(q, F.date_trunc("hour", "at") + F.expr("interval 1 hour"), 250, 3000).select("event_id", "reason", "mid")


@query("p12_fx_normalise", "WITH x AS (SELECT c_mktsegment AS base, 0.4 + 0.3 * (row_number() OVER (ORDER BY c_mktsegment)) AS bid FROM (SELECT DISTINCT c_mktsegment FROM customer)) SELECT c_custkey, CASE WHEN bid BETWEEN 0.5 AND 3 AND bid * 2 BETWEEN 0.5 AND 3 THEN c_acctbal / (bid * 2) END AS amount FROM customer JOIN x ON base = c_mktsegment", "amount", prelude=False)
def p12(spark, d):
    from pyspark.sql.window import Window as W

    c = B.table(spark, d, "customer")
    bases = c.select(F.col("c_mktsegment").alias("base")).distinct()  # a handful of segments
    fx = bases.withColumn("bid", 0.4 + 0.3 * F.row_number().over(W.partitionBy(F.lit(1)).orderBy("base"))).withColumn("ask", 2 * F.col("bid"))
    return O.fx_normalise(c.select("c_custkey", F.col("c_mktsegment").alias("base"), F.col("c_acctbal").alias("amount")), fx, ("amount",)).select("c_custkey", "amount")


_FEE = "CASE WHEN {q} > 0 THEN greatest(1.0, 0.005 * {q}, 0.0005 * {q} * p) ELSE 0 END"
_PLAN = f"""SELECT date, symbol, side, q2 AS quantity, p AS limit_price, q2 * p AS notional, {_FEE.format(q='q2')} AS fee, (held + CASE WHEN side = 'BUY' THEN q2 ELSE -q2 END) * close / nav AS resulting_weight, nav, cash FROM (
 SELECT *, CASE WHEN side = 'BUY' THEN floor(q * coalesce(least(1, greatest(0, cash - nav * 0.02) / nullif(sum(CASE WHEN side = 'BUY' THEN q * p + {_FEE.format(q='q')} END) OVER (PARTITION BY date), 0)), 1)) ELSE q END AS q2 FROM (
  SELECT *, least(abs(dl), floor(volume * close * 0.02 / p)) AS q FROM (SELECT *, CASE WHEN dl > 0 THEN 'BUY' ELSE 'SELL' END AS side, CASE WHEN dl > 0 THEN buy ELSE sell END AS p FROM (
   SELECT *, floor(nav * 0.98 * weight / buy) - held AS dl FROM (SELECT date, symbol, close, volume, 1.0 / count(*) OVER (PARTITION BY date) AS weight, floor(volume / 200) AS held, ceil(close * 1.001 * 1.01 * 100) / 100 AS buy, floor(close * 0.999 * 0.99 * 100) / 100 AS sell,
     CAST(20000 AS DOUBLE) AS cash, 20000 + sum(floor(volume / 200) * close) OVER (PARTITION BY date) AS nav FROM bars)) WHERE dl <> 0))) WHERE q2 > 0"""


def plan(spark, d):
    held = F.floor(F.col("volume") / 200)
    t = B.panel(spark, d).select("date", "symbol", (1 / F.count("*").over(X.wd())).alias("weight"), held.cast("double").alias("held"), (F.col("close") * 0.999).alias("bid"), (F.col("close") * 1.001).alias("ask"), (F.col("volume") * F.col("close")).alias("adv"), F.lit(20_000.0).alias("cash"), (20_000 + F.sum(held * F.col("close")).over(X.wd())).alias("nav"))
    return O.order_plan(t, 0.02, 100, 0.02, ("date",)).withColumn("quantity", F.col("quantity").cast("double"))


@query("f13_order_plan", _PLAN, "quantity limit_price notional fee resulting_weight nav cash")
def f13(spark, d):
    return plan(spark, d)


@query("f14_plan_checks", f"WITH p AS ({_PLAN}) SELECT date, issue, count(*) AS n FROM (SELECT date, 'cap' AS issue FROM p WHERE resulting_weight > 0.15 UNION ALL SELECT date, 'short' FROM p WHERE resulting_weight < 0 UNION ALL SELECT date, 'cash' FROM p GROUP BY date HAVING sum(CASE WHEN side = 'BUY' THEN notional + fee ELSE 0 END) > greatest(0, max(cash - 0.03 * nav)) + 1e-9) GROUP BY ALL")
def f14(spark, d):
    return O.plan_checks(plan(spark, d), 0.03, 0.15, ("date",))


@query("f12_round_trip", f"WITH n AS ({_NEXT}), x AS (SELECT b.date, 0.95 / count(*) OVER (PARTITION BY b.date) AS w, e.open / a.open - 1 AS r FROM bars b JOIN n ON n.date = b.date JOIN bars a ON a.symbol = b.symbol AND a.date = entry_date JOIN bars e ON e.symbol = b.symbol AND e.date = exit_date), g AS (SELECT date, sum(w) AS w, sum(w * r) AS gross, 0.001 * sum(w) / (1 + 0.001 * sum(w)) AS entry_fee FROM x GROUP BY date) SELECT date, gross, entry_fee, (1 - entry_fee) * (w + gross) * 0.001 AS exit_fee, (1 - entry_fee) * (1 + gross) - (1 - entry_fee) * (w + gross) * 0.001 - 1 AS net FROM g", "gross entry_fee exit_fee net")
def f12(spark, d):
    o = outcomes(spark, d).filter("status = 'final'")
    return O.round_trip(o.select("date", (0.95 / F.count("*").over(X.wd())).alias("weight"), F.col("outcome").alias("r")), 10.0)


# joins
@query("j1_benchmark_join", "SELECT b.symbol, b.date, b.close / m.close AS relative FROM bars b JOIN mkt m ON b.date = m.date", "relative")
def j1(spark, d):
    m = B.benchmark(spark, d).select("date", F.col("close").alias("m"))
    return S.with_benchmark(B.panel(spark, d), m).select("symbol", "date", (F.col("close") / F.col("m")).alias("relative"))


@query("j2_price_weight_join", "SELECT coalesce(w.date, b.date) AS date, coalesce(w.symbol, b.symbol) AS symbol, w.weight, b.close, w.date IS NOT NULL AND b.date IS NOT NULL AS matched FROM (SELECT date + 7 AS date, symbol, volume / sum(volume) OVER (PARTITION BY date) AS weight FROM bars) w FULL JOIN bars b ON w.date = b.date AND w.symbol = b.symbol", "weight close")
def j2(spark, d):
    b = B.panel(spark, d)
    w = b.select(F.date_add("date", 7).alias("date"), "symbol", (F.col("volume") / F.sum("volume").over(X.wd())).alias("weight"))
    return J.price_weight_join(w, b.select("date", "symbol", "close"))


@query("j3_keep_accepted", "SELECT symbol, date, close FROM bars WHERE symbol IN (SELECT DISTINCT 'S' || CAST(p_partkey % 9 AS VARCHAR) FROM part WHERE p_partkey % 9 < 7) AND symbol NOT IN (SELECT DISTINCT 'S' || CAST(p_partkey % 9 AS VARCHAR) FROM part WHERE p_partkey % 9 IN (2, 3))", "close")
def j3(spark, d):
    k = B.table(spark, d, "part").select((F.col("p_partkey") % 9).alias("k")).distinct().withColumn("symbol", F.concat(F.lit("S"), F.col("k").cast("string")))
    return J.keep_accepted(B.panel(spark, d).select("symbol", "date", "close"), k.filter("k < 7"), k.filter("k in (2, 3)"))


def outcomes(spark, d):
    from pyspark.sql.window import Window as W

    b = B.panel(spark, d)
    w = W.orderBy("date")
    timing = B.sessions(b).select("date", F.lead("date", 1).over(w).alias("entry_date"), F.lead("date", 2).over(w).alias("exit_date"))
    return J.forward_outcome(b.select("symbol", "date"), timing, b).select("symbol", "date", "outcome", "status")


@query("j5_j6_forward_outcome", f"SELECT b.symbol, b.date, e.open / a.open - 1 AS outcome, CASE WHEN exit_date IS NULL OR e.open IS NULL THEN 'pending' WHEN a.open IS NULL THEN 'missing' ELSE 'final' END AS status FROM bars b JOIN ({_NEXT}) n ON n.date = b.date LEFT JOIN bars a ON a.symbol = b.symbol AND a.date = entry_date LEFT JOIN bars e ON e.symbol = b.symbol AND e.date = exit_date", "outcome")
def j5(spark, d):
    return outcomes(spark, d)


@query("j9_history", "SELECT o_orderkey AS run, l_partkey AS part, CASE WHEN l_orderkey IS NOT NULL THEN row_number() OVER (PARTITION BY o_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) END AS trial_no FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey", prelude=False)
def j9(spark, d):
    runs = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("run"))
    trials = B.table(spark, d, "lineitem").withColumnsRenamed({"l_orderkey": "run", "l_partkey": "part"})
    return J.history(runs, trials, "run", ("l_shipdate", "l_linenumber", "part", "l_suppkey", "l_extendedprice")).select("run", "part", F.col("trial_no").cast("long").alias("trial_no"))
