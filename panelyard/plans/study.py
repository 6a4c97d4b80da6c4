"""Queries of concentration, folds, scenarios, risk, and the accounting of fills, orders and intents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import series as S
from ..operators import study as Y
from ..sources import bars as B
from .catalog import WSQL, query, returns

_LOTS = "SELECT 'S' || CAST(l_partkey % 9 AS VARCHAR) AS symbol, l_shipdate AS date, l_linestatus AS regime, l_returnflag AS sector, l_extendedprice * (l_discount - l_tax) + l_linenumber AS pnl FROM lineitem"
_SHARES = (("top_1", "1"), ("top_3", "3"), ("top_1pct", "ceil(0.01 * n)"), ("top_5pct", "ceil(0.05 * n)"), ("top_10pct", "ceil(0.1 * n)"))


def lots(spark, d):
    pnl = F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax")) + F.col("l_linenumber")
    return B.table(spark, d, "lineitem").select(F.concat(F.lit("S"), (F.col("l_partkey") % 9).cast("string")).alias("symbol"), F.col("l_shipdate").alias("date"), F.col("l_linestatus").alias("regime"), F.col("l_returnflag").alias("sector"), pnl.alias("pnl"))


_TOP = " UNION ALL ".join(f"SELECT '{k}' AS label, CAST({n} AS BIGINT) AS n FROM t" for k, n in _SHARES)


_SHARE = f"""WITH l AS (SELECT greatest(pnl, 0) AS win, pnl, row_number() OVER (ORDER BY pnl DESC) AS k FROM ({_LOTS})), t AS (SELECT count(*) AS n, sum(pnl) AS net, sum(win) AS positive FROM l), a AS ({_TOP})
 SELECT label, n, pnl, CASE WHEN net > 0 THEN pnl / net END AS fraction_net, CASE WHEN positive > 0 THEN pnl / positive END AS fraction_positive FROM (SELECT label, a.n, sum(win) AS pnl FROM a JOIN l ON k <= a.n GROUP BY ALL), (SELECT net, positive FROM t)"""


@query("t5_top_lot_share", _SHARE, "pnl fraction_net fraction_positive", prelude=False)
def t5(spark, d):
    return Y.top_lot_share(lots(spark, d), {"top_1": 1, "top_3": 3}, {"top_1pct": 0.01, "top_5pct": 0.05, "top_10pct": 0.1})


@query("a5_concentration", f"WITH l AS ({_LOTS}) " + " UNION ALL ".join(f"SELECT '{k}' AS kind, {e} AS label, sum(pnl) AS pnl, count(*) AS n FROM l GROUP BY ALL" for k, e in (("ticker", "symbol"), ("year", "CAST(year(date) AS VARCHAR)"), ("month", "strftime(date, '%Y-%m')"), ("regime", "regime"), ("sector", "sector"))), "pnl", prelude=False)
def a5(spark, d):
    return Y.concentration(lots(spark, d))


@query("u4_stitch_folds", """WITH f AS (SELECT symbol, year(date) AS fold, date, exp(sum(ln(1 + r)) OVER (PARTITION BY symbol, year(date) ORDER BY date)) AS nav, r AS pnl FROM r WHERE r IS NOT NULL),
 e AS (SELECT symbol, fold, max_by(nav, date) AS e FROM f GROUP BY ALL), c AS (SELECT symbol, fold, coalesce(product(e) OVER (PARTITION BY symbol ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS capital FROM e)
 SELECT symbol, CAST(fold AS INTEGER) AS fold, date, nav * capital AS nav, pnl * capital AS pnl, CAST(capital AS DOUBLE) AS capital FROM f JOIN c USING (symbol, fold)""", "nav pnl capital")
def u4(spark, d):
    r = returns(spark, d).filter("r is not null").withColumn("fold", F.year("date"))
    nav = F.product(1 + F.col("r")).over(W.partitionBy("symbol", "fold").orderBy("date").rowsBetween(W.unboundedPreceding, 0))
    return Y.stitch_folds(r.select("symbol", "fold", "date", nav.alias("nav"), F.col("r").alias("pnl")))


@query("j12_scenario_grid", "SELECT symbol, scenario, CAST(year(date) AS INTEGER) AS year, product(1 + r - bps / 10000.0) - 1 AS total_return FROM r, (VALUES ('base', 0, 0), ('costly', 10, 0), ('late', 5, 1996)) AS g(scenario, bps, start) WHERE r IS NOT NULL AND year(date) >= start GROUP BY ALL", "total_return")
def j12(spark, d):
    return Y.scenario_grid(returns(spark, d), [("base", 0, 0), ("costly", 10, 0), ("late", 5, 1996)])


@query("a17_portfolio_risk", """WITH k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k, (1 + CAST(substr(symbol, 2) AS INTEGER)) / 45.0 AS w FROM r), x AS (SELECT * FROM k WHERE k <= 60 AND r IS NOT NULL),
 p AS (SELECT a.symbol AS a, b.symbol AS b, any_value(a.w * b.w) AS w, covar_samp(a.r, b.r) AS c, corr(a.r, b.r) AS rho FROM x a JOIN x b USING (date) GROUP BY ALL), v AS (SELECT any_value(w) AS w, avg(close * volume) AS dv FROM k WHERE k <= 20 GROUP BY symbol)
 SELECT (SELECT sqrt(sum(w * c) * 52) FROM p) AS volatility, (SELECT avg(rho) FROM p WHERE a < b) AS mean_correlation, max(w) AS max_weight, max(1000000 * w / nullif(dv, 0)) AS max_notional_to_volume, min(dv) AS min_dollar_volume FROM v""", "volatility mean_correlation max_weight max_notional_to_volume min_dollar_volume")
def a17(spark, d):
    b = returns(spark, d)
    w = b.select("symbol").distinct().withColumn("weight", (1 + F.substring("symbol", 2, 9).cast("int")) / 45.0)
    return Y.portfolio_risk(b, w, 1_000_000, 52)


_FILLS = "SELECT concat_ws('.', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS execution_id, 'S' || CAST(l_partkey % 9 AS VARCHAR) AS symbol, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, l_quantity AS quantity, l_extendedprice / l_quantity AS price, l_linestatus AS status, l_extendedprice * l_tax / 100 AS amount FROM lineitem"


def fills(spark, d):
    t = B.table(spark, d, "lineitem")
    return t.select(F.concat_ws(".", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")]).alias("execution_id"), F.concat(F.lit("S"), (F.col("l_partkey") % 9).cast("string")).alias("symbol"), F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"), F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_linestatus").alias("status"), (F.col("l_extendedprice") * F.col("l_tax") / 100).alias("amount"))


_ACCOUNTED = f"""WITH f AS ({_FILLS}), m AS (SELECT symbol, max_by(close, date) AS mark FROM bars GROUP BY symbol)
 SELECT symbol, sum(quantity * price) AS notional, coalesce(sum(amount) FILTER (status = 'F'), 0) AS commissions, count(*) FILTER (status <> 'F') AS pending, sum(s * quantity) AS position, sum(s * quantity) * any_value(mark) AS exposure,
 sum(s * quantity) * any_value(mark) - sum(s * quantity * price) - coalesce(sum(amount) FILTER (status = 'F'), 0) AS pnl FROM (SELECT *, CASE WHEN side = 'BUY' THEN 1.0 ELSE -1.0 END AS s FROM f) JOIN m USING (symbol) GROUP BY symbol"""


@query("a18_fill_accounting", _ACCOUNTED, "notional commissions position exposure pnl")
def a18(spark, d):
    f = fills(spark, d)
    marks = B.panel(spark, d).groupBy("symbol").agg(F.max_by("close", "date").alias("mark"))
    return Y.fill_accounting(f.drop("status", "amount"), f.filter("status = 'F'").select("execution_id", "amount"), marks)


@query("l7_conflicts", "SELECT CAST(l_orderkey AS VARCHAR) AS execution_id, count(DISTINCT l_returnflag) AS payloads FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1", prelude=False)
def l7(spark, d):
    return Y.conflicting_executions(B.table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("execution_id"), F.col("l_returnflag").alias("payload")))


@query("l8_reconciled_orders", """WITH f AS (SELECT l_orderkey AS k, sum(l_quantity) AS filled, sum(l_quantity * l_extendedprice) AS paid FROM lineitem WHERE l_linenumber <= 2 AND l_orderkey % 4 <> 1 GROUP BY 1),
 e AS (SELECT l_orderkey AS k, bool_or(l_linenumber = 3) AS sent, max_by(CASE WHEN l_returnflag = 'A' THEN 'Cancelled' ELSE 'Inactive' END, 2 * l_linenumber + CAST(l_returnflag = 'R' AS INTEGER)) FILTER (l_linenumber > 3 AND l_returnflag IN ('A', 'R')) AS ended FROM lineitem GROUP BY 1)
 SELECT 'a' AS account, o_orderkey AS order_ref, 60.0 AS quantity, coalesce(filled, 0) AS filled, 60 - coalesce(filled, 0) AS remaining, paid / filled AS average_price,
 CASE WHEN coalesce(completed, ended) IS NOT NULL AND coalesce(filled, 0) < 60 THEN CASE WHEN coalesce(completed, ended) = 'Inactive' THEN 'REJECTED' ELSE 'CANCELLED' END WHEN filled = 60 THEN 'FILLED' WHEN filled > 60 THEN 'OVERFILLED' WHEN filled > 0 THEN 'PARTIALLY_FILLED' WHEN o_orderstatus = 'O' THEN 'ACKNOWLEDGED' WHEN coalesce(sent, false) THEN 'UNKNOWN_RECONCILE' ELSE 'NOT_SUBMITTED' END AS state
 FROM (SELECT *, CASE WHEN o_orderkey % 10 = 3 THEN 'ApiCancelled' END AS completed FROM orders) LEFT JOIN f ON k = o_orderkey LEFT JOIN e ON e.k = o_orderkey""", "quantity filled remaining average_price", prelude=False)
def l8(spark, d):
    o, t = B.table(spark, d, "orders"), B.table(spark, d, "lineitem")
    f = t.filter("l_linenumber <= 2 and l_orderkey % 4 <> 1").select(F.lit("a").alias("account"), F.col("l_orderkey").alias("order_ref"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    status = F.when(F.col("l_returnflag") == "A", "Cancelled").when(F.col("l_returnflag") == "R", "Inactive").otherwise("Submitted")
    e = t.select(F.col("l_orderkey").alias("order_ref"), (2 * F.col("l_linenumber") + (F.col("l_returnflag") == "R").cast("int")).alias("seq"), F.when(F.col("l_linenumber") == 3, "SUBMITTING").when(F.col("l_linenumber") > 3, "STATUS").otherwise("NOTE").alias("kind"), status.alias("status"))
    orders = o.select(F.lit("a").alias("account"), F.col("o_orderkey").alias("order_ref"), F.lit(60.0).alias("quantity"))
    completed = o.filter("o_orderkey % 10 = 3").select(F.col("o_orderkey").alias("order_ref"), F.lit("ApiCancelled").alias("status"))
    return Y.reconciled_orders(orders, f, o.filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("order_ref")), completed, e)


@query("l9_position_reconciliation", """WITH x AS (SELECT l_suppkey AS symbol, sum(CASE WHEN l_linenumber = 1 THEN l_quantity WHEN l_linenumber < 5 THEN CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END ELSE 0 END) AS expected, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS actual FROM lineitem GROUP BY 1)
 SELECT symbol, CAST(expected AS DOUBLE) AS expected, CAST(actual AS DOUBLE) AS actual FROM x WHERE expected <> actual""", "expected actual", prelude=False)
def l9(spark, d):
    t = B.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.col("l_quantity").cast("double").alias("quantity"), "l_linenumber", "l_linestatus", F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"))
    return Y.position_reconciliation(t.filter("l_linenumber = 1"), t.filter("l_linenumber between 2 and 4"), t.filter("l_linestatus = 'F'"))


@query("l10_intent_vs_ledger", "SELECT o_orderkey AS id, o_orderpriority AS kind, 'file' AS side FROM orders WHERE o_orderkey % 97 = 0 AND o_orderpriority <> '1-URGENT' UNION ALL SELECT o_orderkey, '1-URGENT', 'ledger' FROM orders WHERE o_orderkey % 97 = 0 AND o_orderpriority <> '1-URGENT'", prelude=False)
def l10(spark, d):
    o = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"))
    return Y.intent_vs_ledger(o, o.withColumn("kind", F.when(F.col("id") % 97 == 0, "1-URGENT").otherwise(F.col("kind"))))


@query("u2_date_intersection", f"SELECT DISTINCT date FROM (SELECT date, {'close'} / lag(close, 20) {WSQL} AS m FROM bars) WHERE m IS NOT NULL AND date IN (SELECT date FROM cal WHERE session_no % 2 = 0)")
def u2(spark, d):
    b = B.panel(spark, d)
    ready = b.withColumn("m", F.col("close") / F.lag("close", 20).over(S.ws())).filter("m is not null")
    return Y.date_intersection(B.sessions(b).filter("session_no % 2 = 0"), ready)


_GAP = "CASE WHEN year(date) % 2 = 0 AND dayofyear(date) BETWEEN 100 AND 107 THEN NULL ELSE close END"


def _step(c: str, d: str) -> str:
    return f"CASE WHEN dx IS NULL THEN 0 WHEN rs.k < 14 THEN {c} + greatest({d}, 0) / 14 ELSE ({c} * 13 + greatest({d}, 0)) / 14 END"


@query("w12_rsi_after_gaps", f"""WITH RECURSIVE rc AS (SELECT symbol, date, row_number() {WSQL} - 1 AS i, c - lag(c) {WSQL} AS dx FROM (SELECT symbol, date, {_GAP} AS c FROM bars)),
 rs AS (SELECT symbol, date, i, 0 AS k, CAST(0 AS DOUBLE) AS up, CAST(0 AS DOUBLE) AS down FROM rc WHERE i = 0
  UNION ALL SELECT rc.symbol, rc.date, rc.i, CASE WHEN dx IS NULL THEN 0 ELSE rs.k + 1 END, {_step('up', 'dx')}, {_step('down', '-dx')} FROM rs JOIN rc ON rc.symbol = rs.symbol AND rc.i = rs.i + 1)
 SELECT symbol, date, CASE WHEN k < 14 THEN NULL WHEN up = 0 AND down = 0 THEN 50 WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END AS rsi FROM rs""", "rsi")
def w12(spark, d):
    gap = (F.year("date") % 2 == 0) & F.dayofyear("date").between(100, 107)
    return S.wilder_rsi(B.panel(spark, d).withColumn("close", F.when(~gap, F.col("close"))))


@query("a5_moonshot", f"SELECT label, coalesce(fraction_net > 0.5, false) AS moonshot FROM ({_SHARE}) WHERE label = 'top_3'", prelude=False)
def a5_moonshot(spark, d):
    return Y.moonshot(t5(spark, d))


@query("a18_residual", f"SELECT sum(notional) AS notional, sum(notional) / 2000000 AS turnover, sum(pnl) AS marked_contribution, CAST(50000 AS DOUBLE) AS equity_change, 50000 - sum(pnl) AS unattributed FROM ({_ACCOUNTED})", "notional turnover marked_contribution unattributed")
def a18_residual(spark, d):
    return Y.equity_residual(a18(spark, d), 2_000_000.0, 2_050_000.0)
