"""Queries of accounts and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import cross as X
from ..functions import series as S
from ..functions import signals as G
from ..operators import account as A
from ..operators import evaluation as E
from ..operators import joins as J
from ..operators import ledger as L
from ..sources import bars as B
from .catalog import _ORDER, WSQL, _full, query, returns, x5, _TOP


def with_market(spark, d):
    m = B.benchmark(spark, d).select("date", (F.col("close") / F.lag("close").over(W.orderBy("date")) - 1).alias("r_mkt"))
    return S.with_benchmark(returns(spark, d), m)


_RM = "SELECT symbol, date, r, r_mkt FROM r JOIN (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS r_mkt FROM mkt) USING (date) WHERE r IS NOT NULL"


def _share(unit: str, name: str) -> str:
    return f"(SELECT symbol, avg(CASE WHEN g > 0 THEN 1.0 ELSE 0.0 END) AS {name} FROM (SELECT symbol, date_trunc('{unit}', date) AS u, sum(ln(1 + r)) AS g FROM x GROUP BY ALL) GROUP BY symbol)"


@query("a3_rigor_metrics", f"""WITH x AS ({_RM}), q AS (SELECT symbol, quantile_cont(r, 0.05) AS p05 FROM x GROUP BY symbol),
 nv AS (SELECT symbol, date, product(1 + r) OVER w AS nav FROM x WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)), dd AS (SELECT symbol, min(nav / greatest(1, m) - 1) AS dd FROM (SELECT *, max(nav) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS m FROM nv) GROUP BY symbol)
 SELECT symbol, sortino, beta, calmar, tail_loss, monthly_consistency, annual_consistency FROM (SELECT symbol, avg(r) * 52 / nullif(sqrt(avg(least(r, 0) ** 2) * 52), 0) AS sortino, covar_samp(r, r_mkt) / nullif(var_samp(r_mkt), 0) AS beta, (pow(exp(sum(ln(1 + r))), 52.0 / count(*)) - 1) / nullif(-any_value(dd), 0) AS calmar, avg(r) FILTER (r <= p05) AS tail_loss FROM x JOIN q USING (symbol) JOIN dd USING (symbol) GROUP BY symbol)
 JOIN {_share('month', 'monthly_consistency')} USING (symbol) JOIN {_share('year', 'annual_consistency')} USING (symbol)""", "sortino beta calmar tail_loss monthly_consistency annual_consistency")
def a3(spark, d):
    return E.rigor_metrics(with_market(spark, d), per_year=52)


_FILLS = f"SELECT symbol, l_returnflag = 'R' AS sell, price, l_quantity AS q, sum(l_quantity) OVER (PARTITION BY symbol, l_returnflag = 'R' ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) AS z FROM ticks"


@query("a3_lot_metrics", f"WITH f AS ({_FILLS}), t AS (SELECT b.symbol, s.price / b.price - 1 AS ret, (least(b.z, s.z) - greatest(b.z - b.q, s.z - s.q)) * (s.price - b.price) AS pnl FROM f b JOIN f s ON b.symbol = s.symbol AND NOT b.sell AND s.sell AND least(b.z, s.z) > greatest(b.z - b.q, s.z - s.q)) SELECT symbol, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, avg(ret) FILTER (pnl > 0) AS average_winner, avg(ret) FILTER (pnl < 0) AS average_loser, sum(pnl) FILTER (pnl > 0) / nullif(-sum(pnl) FILTER (pnl < 0), 0) AS profit_factor FROM t GROUP BY symbol", "hit_rate average_winner average_loser profit_factor")
def a3l(spark, d):
    return E.lot_metrics(J.fifo_lots(B.ticks(spark, d), F.date_trunc("month", "ts")))


@query("a6_attribution", f"SELECT symbol, coalesce(gross, 0) AS gross, coalesce(fees, 0) AS fees, coalesce(gross, 0) - coalesce(fees, 0) AS net FROM (SELECT t.symbol, sum(weight * nx) AS gross FROM ({_TOP}) t JOIN (SELECT symbol, date, lead(close) {WSQL} / close - 1 AS nx FROM bars) n ON t.symbol = n.symbol AND t.date = n.date WHERE weight > 0 GROUP BY 1) FULL JOIN (SELECT symbol, sum(weight * 0.0005) AS fees FROM ({_TOP}) GROUP BY 1) USING (symbol)", "gross fees net")
def a6(spark, d):
    w = x5(spark, d)
    nxt = B.panel(spark, d).select("symbol", "date", (F.lead("close").over(S.ws()) / F.col("close") - 1).alias("nx"))
    pnl = w.filter("weight > 0").join(nxt.hint("merge"), ["symbol", "date"]).select("symbol", (F.col("weight") * F.col("nx")).alias("pnl"))
    return E.attribution(pnl, w.select("symbol", (F.col("weight") * 0.0005).alias("fee")))


_GRP = "SELECT DISTINCT 'S' || CAST(p_partkey % 9 AS VARCHAR) AS symbol, 'G' || CAST(p_partkey % 9 % 3 AS VARCHAR) AS grp FROM part"


def groups(spark, d):
    k = B.table(spark, d, "part").select((F.col("p_partkey") % 9).alias("k")).distinct()
    return k.select(F.concat(F.lit("S"), F.col("k").cast("string")).alias("symbol"), F.concat(F.lit("G"), (F.col("k") % 3).cast("string")).alias("grp"))


@query("a11_group_exposure", f"SELECT date, max(weight) AS weight, arg_max(grp, (weight, grp)) AS grp FROM (SELECT date, grp, round(sum(weight), 10) AS weight FROM ({_TOP}) JOIN ({_GRP}) USING (symbol) GROUP BY ALL) GROUP BY date", "weight")
def a11(spark, d):
    return E.group_exposure(x5(spark, d), groups(spark, d))


@query("a14_leave_one_out", "SELECT symbol, avg(y) AS mean, arg_max(year, (y, -year)) AS best_year, (sum(y) - max(y)) / (count(*) - 1) AS without_best, (sum(y) - min(y)) / (count(*) - 1) AS without_worst, count(*) FILTER (y > 0) AS positive_years FROM (SELECT symbol, CAST(year(date) AS INTEGER) AS year, avg(x) * 52 AS y FROM (SELECT symbol, date, r - avg(r) OVER (PARTITION BY date) AS x FROM r) WHERE x IS NOT NULL GROUP BY ALL) GROUP BY symbol", "mean without_best without_worst")
def a14(spark, d):
    return E.leave_one_out(returns(spark, d).select("symbol", "date", X.demeaned("r").alias("r")), per_year=52)


@query("f15_without_group", f"WITH g AS (SELECT date, grp, sum(r) AS s, count(*) AS n FROM r JOIN ({_GRP}) USING (symbol) WHERE r IS NOT NULL GROUP BY ALL) SELECT a.grp, a.date, sum(b.s) / sum(b.n) AS r FROM g a LEFT JOIN g b ON a.date = b.date AND a.grp <> b.grp GROUP BY ALL", "r")
def f15(spark, d):
    return E.without_each_group(returns(spark, d), groups(spark, d))


_WITHOUT = f"""SELECT grp, date, symbol, place, 0.995 * w / sum(w) OVER (PARTITION BY grp, date) AS weight FROM (SELECT *, 1.5 - (place - 1) / 2.0 AS w FROM (
 SELECT g.grp, b.date, b.symbol, CAST(row_number() OVER (PARTITION BY g.grp, b.date ORDER BY b.volume DESC, b.symbol) AS INTEGER) AS place FROM bars b, (SELECT DISTINCT grp FROM ({_GRP})) g
 WHERE b.symbol NOT IN (SELECT symbol FROM ({_GRP}) m WHERE m.grp = g.grp) AND EXISTS (SELECT 1 FROM bars x JOIN ({_GRP}) m USING (symbol) WHERE x.date = b.date AND m.grp = g.grp)) WHERE place <= 3)"""


@query("f15_weights_without_group", _WITHOUT, "weight")
def f15_weights(spark, d):
    return X.weights_without_each_group(B.panel(spark, d), groups(spark, d), "volume", 3)


@query("x6_capped_signal", f"""WITH t AS (SELECT symbol, date, 0.995 * w / sum(w) OVER (PARTITION BY date) AS raw FROM (SELECT *, 1.5 - (place - 1) / 3.0 AS w FROM (SELECT symbol, date, row_number() OVER (PARTITION BY date ORDER BY volume DESC, symbol) AS place FROM bars) WHERE place <= 4)),
 a AS (SELECT *, raw > 0.3 AS c0, count(*) FILTER (raw > 0.3) OVER (PARTITION BY date) AS n0, sum(CASE WHEN raw > 0.3 THEN 0 ELSE raw END) OVER (PARTITION BY date) AS s0, sum(raw) OVER (PARTITION BY date) AS al FROM t),
 b AS (SELECT *, CASE WHEN c0 THEN 0.3 ELSE (al - 0.3 * n0) * raw / s0 END AS w1 FROM a), c AS (SELECT *, c0 OR w1 > 0.3 AS c1, count(*) FILTER (c0 OR w1 > 0.3) OVER (PARTITION BY date) AS n1, sum(CASE WHEN c0 OR w1 > 0.3 THEN 0 ELSE raw END) OVER (PARTITION BY date) AS s1 FROM b),
 e AS (SELECT *, CASE WHEN c1 THEN 0.3 ELSE (al - 0.3 * n1) * raw / s1 END AS w2 FROM c), h AS (SELECT *, c1 OR w2 > 0.3 AS c2, count(*) FILTER (c1 OR w2 > 0.3) OVER (PARTITION BY date) AS n2, sum(CASE WHEN c1 OR w2 > 0.3 THEN 0 ELSE raw END) OVER (PARTITION BY date) AS s2 FROM e),
 i AS (SELECT *, CASE WHEN c2 THEN 0.3 ELSE (al - 0.3 * n2) * raw / s2 END AS w3 FROM h) SELECT symbol, date, CASE WHEN c2 OR w3 > 0.3 THEN 0.3 ELSE w3 END AS weight FROM i""", "weight")
def x6_capped(spark, d):
    return X.capped(X.target_weights(B.panel(spark, d), "volume", 4).withColumnRenamed("weight", "raw"), "raw", 0.995, 0.3).select("symbol", "date", "weight")


@query("x6_equal", "SELECT symbol, date, place, 0.995 / count(*) OVER (PARTITION BY date) AS weight FROM (SELECT symbol, date, CAST(row_number() OVER (PARTITION BY date ORDER BY volume DESC, symbol) AS INTEGER) AS place FROM bars) WHERE place <= 4", "weight")
def x6_equal(spark, d):
    return X.target_weights(B.panel(spark, d), "volume", 4, weighting="equal").select("symbol", "date", "place", "weight")


_YEARLY = "SELECT symbol, CAST(year(date) AS INTEGER) AS year, exp(sum(ln(1 + r))) - 1 AS total_return FROM r WHERE r IS NOT NULL GROUP BY ALL"


def yearly(spark, d):
    return returns(spark, d).filter("r is not null").groupBy("symbol", F.year("date").alias("year")).agg((F.exp(F.sum(F.log1p("r"))) - 1).alias("total_return"))


@query("t2_winner", f"SELECT symbol, year, total_return FROM ({_YEARLY}) QUALIFY row_number() OVER (PARTITION BY year ORDER BY total_return DESC, symbol) = 1", "total_return")
def t2(spark, d):
    return E.select_winner(yearly(spark, d), "total_return", "symbol", ("year",))


@query("t3_ranked_summary", f"SELECT symbol, year, total_return, CAST(row_number() OVER (PARTITION BY year ORDER BY total_return DESC, symbol) AS INTEGER) AS place FROM ({_YEARLY})", "total_return")
def t3(spark, d):
    return E.ranked_summary(yearly(spark, d), "total_return", "symbol", ("year",))


def _account_sql(result: str, targets: str = f"SELECT symbol, date, weight * 0.95 AS weight FROM ({_TOP})", open_to_open: bool = False, intraday: bool = False, buy_hold: bool = False, cadence: int = 5, rate: float = 0.001) -> str:
    """One book session by session: lists by symbol of values at the open before (g) and after trading (h) and at the close (e), cash and the fee rate's fixed point c."""
    legs = f"SELECT symbol, date, open, lead(open) {WSQL} AS close, open AS prev FROM bars QUALIFY close IS NOT NULL" if open_to_open else f"SELECT symbol, date, open, close, lag(close) {WSQL} AS prev FROM bars"
    each = lambda x: f"list_transform(range(1, len(z.t) + 1), lambda i: {x})"
    trade, sell = "(n = 0)" if buy_hold else f"(n % {cadence} = 0)", "true" if intraday else "n = last"
    cost = f"list_reduce(list_transform(range(41), lambda i: CAST(0 AS DOUBLE)), lambda c, y: {rate} * list_sum({each('abs((1 - c) * z.t[i] - z.g[i] / z.m)')}))"
    return f"""WITH RECURSIVE p AS ({legs}), sy AS (SELECT DISTINCT symbol FROM bars), k AS (SELECT n, date, decision, max(n) OVER () AS last, date_trunc('week', date) AS w FROM (SELECT date, session_no - 1 AS n, lag(date) OVER (ORDER BY date) AS decision FROM cal) WHERE n >= 0{" AND date < (SELECT max(date) FROM cal)" if open_to_open else ""}),
 pl AS (SELECT k.n, d.decision FROM k JOIN k AS d ON d.n = {"0" if buy_hold else f"k.n - k.n % {cadence}"}),
 x AS (SELECT k.n, k.date, k.last, list(sy.symbol ORDER BY sy.symbol) AS names, list({"1.0" if open_to_open else "coalesce(p.open / p.prev, 1)"} ORDER BY sy.symbol) AS gap, list(coalesce(p.close / p.open, 1) ORDER BY sy.symbol) AS day, list(coalesce(t.weight, 0) ORDER BY sy.symbol) AS t, list(CASE WHEN p.open IS NULL OR p.close IS NULL THEN 1 ELSE 0 END ORDER BY sy.symbol) AS gone
   FROM k JOIN pl ON pl.n = k.n CROSS JOIN sy LEFT JOIN p ON p.symbol = sy.symbol AND p.date = k.date LEFT JOIN ({targets}) t ON t.symbol = sy.symbol AND t.date = pl.decision GROUP BY k.n, k.date, k.last),
 a AS (SELECT CAST(-1 AS BIGINT) AS n, DATE '1900-01-01' AS date, CAST(0 AS BIGINT) AS last, CAST([] AS VARCHAR[]) AS names, CAST([] AS DOUBLE[]) AS e0, CAST([] AS DOUBLE[]) AS g, CAST([] AS DOUBLE[]) AS h, CAST([] AS DOUBLE[]) AS e, CAST(1 AS DOUBLE) AS m, CAST(0 AS DOUBLE) AS c, CAST(1 AS DOUBLE) AS cash, CAST(1 AS DOUBLE) AS before, CAST(1 AS DOUBLE) AS nav, CAST(0 AS DOUBLE) AS held, 0 AS n_missing
  UNION ALL
  SELECT n, date, last, names, e0, g, h, e, m, c, cash, before, cash + list_sum(e) * (CASE WHEN {sell} THEN 1 - {rate} ELSE 1 END), held, CAST(list_sum({each("CASE WHEN z.h[i] > 0 THEN z.gone[i] ELSE 0 END")}) AS INTEGER)
  FROM (SELECT *, {each("z.h[i] * z.day[i]")} AS e FROM (SELECT *, CASE WHEN {"true" if intraday else trade} THEN {each("z.m * (1 - z.c) * z.t[i]")} ELSE g END AS h, CASE WHEN {"true" if intraday else trade} THEN z.m * (1 - z.c) * (1 - list_sum(z.t)) ELSE cash0 END AS cash
   FROM (SELECT *, CASE WHEN {"true" if intraday else trade} THEN {cost} ELSE 0 END AS c FROM (SELECT *, cash0 + list_sum(g) AS m FROM (
    SELECT x.n, x.date, x.last, x.names, x.gone, x.t, x.day, a.nav AS before, {"a.nav" if intraday else "a.cash"} AS cash0, a.h IS NOT NULL AS go, list_sum(x.t) AS held,
     CASE WHEN a.n < 0 OR {str(intraday).lower()} THEN list_transform(x.t, lambda y: CAST(0 AS DOUBLE)) ELSE a.e END AS e0, CASE WHEN a.n < 0 OR {str(intraday).lower()} THEN list_transform(x.t, lambda y: CAST(0 AS DOUBLE)) ELSE list_transform(range(1, len(x.t) + 1), lambda i: a.e[i] * x.gap[i]) END AS g
    FROM a JOIN x ON x.n = a.n + 1) AS z) AS z) AS z) AS z) AS z),
 u AS (SELECT n, date, before, nav, m, c, cash, last, held, n_missing, {trade if not intraday else "true"} AS trades, {sell} AS sells, unnest(names) AS symbol, unnest(e0) AS e0, unnest(g) AS g, unnest(h) AS h, unnest(e) AS e FROM a WHERE n >= 0),
 tr AS (SELECT date, symbol, 'open' AS kind, h - g AS dollars, abs(h - g) * {rate} AS fee FROM u WHERE trades AND abs(h - g) > 1e-12 * m UNION ALL SELECT date, symbol, 'close', -e, e * {rate} FROM u WHERE sells AND e > 1e-12),
 co AS (SELECT date, symbol, g - e0 AS overnight, e - h AS intraday FROM u WHERE e0 > 0 OR h > 0),
 da AS (SELECT date, any_value(before) AS nav_before, any_value(nav) AS nav, any_value(nav) / any_value(before) - 1 AS net, sum(g - e0) / any_value(before) AS overnight, sum(e - h) / any_value(before) AS intraday, (CASE WHEN any_value(trades) THEN any_value(m) * any_value(c) ELSE 0 END + CASE WHEN any_value(sells) THEN sum(e) * {rate} ELSE 0 END) / any_value(before) AS cost, (CASE WHEN any_value(trades) THEN sum(abs(h - g)) ELSE 0 END + CASE WHEN any_value(sells) THEN sum(e) ELSE 0 END) / any_value(before) AS turnover,
   sum(g) / any_value(m) AS preopen_exposure, CASE WHEN any_value(trades) THEN any_value(held) ELSE sum(h) / any_value(m) END AS open_exposure, CASE WHEN any_value(sells) THEN 0 ELSE sum(e) / (any_value(cash) + sum(e)) END AS closing_exposure, greatest(CASE WHEN any_value(trades) THEN max(g) / any_value(m) ELSE 0 END, max(h) / (any_value(cash) + sum(h)), max(e) / (any_value(cash) + sum(e))) AS largest, CAST(any_value(n_missing) AS BIGINT) AS n_missing FROM u GROUP BY date)
 {result}"""


def _on_log_scale(df, columns):
    """sign(x) * ln(1 + |x|): the accounts of these invented prices end at up to 1e64 times their start."""
    return df.withColumns({c: F.signum(c) * F.log1p(F.abs(c)) for c in columns})


def _log_sql(table: str, columns: tuple[str, ...], without: str = "") -> str:
    return f"SELECT * {f'EXCLUDE ({without}) ' if without else ''}REPLACE ({', '.join(f'sign({c}) * ln(1 + abs({c})) AS {c}' for c in columns)}) FROM {table}"


_NAV, _TRADE, _PNL = ("nav", "nav_before"), ("dollars", "fee"), ("overnight", "intraday")
_MARKS = "nav_before nav net overnight intraday cost turnover preopen_exposure open_exposure closing_exposure largest"
_OPEN_MARKS = "nav_before nav net intraday cost turnover open_exposure closing_exposure largest"


def _book(spark, d, last: bool = True):
    """Bars read once, the targets of a book and the sessions after the first."""
    b = B.kept_panel(spark, d)
    cal = B.sessions(b).withColumn("decision_date", F.lag("date").over(W.orderBy("date"))).filter("session_no > 0").withColumn("session_no", F.col("session_no") - 1)
    cal = cal if last else cal.withColumn("_after", F.lead("date").over(W.orderBy("date"))).filter("_after is not null")
    return b, X.top_weights(b, "volume", 3).select("date", "symbol", (F.col("weight") * 0.95).alias("weight")), cal


@query("f4_f11_close_marked", _account_sql(_log_sql("da", _NAV, "turnover")), _MARKS.replace(" turnover", ""))
def f4(spark, d):
    return _on_log_scale(A.close_marked_account(*_book(spark, d), 10.0, 5), _NAV)


@query("a3_account_metrics", _account_sql("SELECT CAST(year(date) AS BIGINT) AS year, avg(open_exposure) AS exposure, avg(turnover) * 52 AS annual_turnover FROM da GROUP BY ALL"), "exposure annual_turnover")
def a3_account(spark, d):
    daily = L.account_ledger(*_book(spark, d), 10.0, 5).daily
    return E.account_metrics(daily.withColumn("year", F.year("date").cast("long")), ("year",), 52)


@query("f4_trades", _account_sql(_log_sql("tr", _TRADE)), "dollars fee")
def f4_trades(spark, d):
    return _on_log_scale(L.account_ledger(*_book(spark, d), 10.0, 5).trades, _TRADE)


@query("f4_contributions", _account_sql(_log_sql("co", _PNL)), "overnight intraday")
def f4_contributions(spark, d):
    return _on_log_scale(L.account_ledger(*_book(spark, d), 10.0, 5).contributions, _PNL)


@query("f4_intraday", _account_sql(_log_sql("da", _NAV), intraday=True), _MARKS)
def f4_intraday(spark, d):
    return _on_log_scale(L.account_ledger(*_book(spark, d), 10.0, 5, intraday=True).daily, _NAV)


@query("f3_open_ledger", _account_sql(_log_sql("da", _NAV, "overnight, preopen_exposure"), open_to_open=True), _OPEN_MARKS)
def f3_ledger(spark, d):
    return _on_log_scale(L.open_to_open_ledger(*_book(spark, d, False), 10.0, 5).daily, _NAV)


@query("f3_open_trades", _account_sql(_log_sql("tr", _TRADE), open_to_open=True), "dollars fee")
def f3_trades(spark, d):
    return _on_log_scale(L.open_to_open_ledger(*_book(spark, d, False), 10.0, 5).trades, _TRADE)


@query("f3_open_buy_hold", _account_sql(_log_sql("da", _NAV, "overnight, preopen_exposure"), open_to_open=True, buy_hold=True), _OPEN_MARKS)
def f3_buy_hold(spark, d):
    return _on_log_scale(L.open_to_open_ledger(*_book(spark, d, False), 10.0, buy_hold=True).daily, _NAV)


@query("f15_accounts_without_group", " UNION ALL ".join(f"SELECT 'G{i}' AS grp, * FROM (" + _account_sql(_log_sql("(SELECT date, nav FROM da)", ("nav",)), f"SELECT symbol, date, weight FROM ({_WITHOUT}) WHERE grp = 'G{i}'", open_to_open=True) + ")" for i in range(3)), "nav")
def f15_accounts(spark, d):
    b, _, cal = _book(spark, d, False)
    w = X.weights_without_each_group(b, groups(spark, d), "volume", 3)
    return _on_log_scale(L.open_to_open_ledger(b, w, cal, 10.0, 5, ("grp",)).daily.select("grp", "date", "nav"), ("nav",))


_LEGS = f"SELECT b.symbol, b.date, open / lag(close) OVER w - 1 AS overnight, close / open - 1 AS intraday, CAST(lag(up, 2) OVER w AS DOUBLE) AS condition FROM (SELECT *, close > ({_full('avg(close)', 'close', 20)}) AS up FROM bars) b WINDOW w AS (PARTITION BY symbol ORDER BY date)"


@query("f8_overnight_study", f"""WITH l AS ({_LEGS}), k AS (SELECT symbol, avg(condition) AS k FROM l WHERE date < DATE '1997-01-01' GROUP BY symbol),
 x AS (SELECT symbol, rule, r, w, CAST(bps AS DOUBLE) AS bps, bps / 10000.0 AS f FROM l JOIN k USING (symbol), LATERAL (VALUES ('overnight', overnight, 1.0), ('intraday', intraday, 1.0), ('conditional', overnight, condition), ('control', overnight, k)) AS v(rule, r, w), (VALUES (0), (5), (20)) AS g(bps) WHERE date >= DATE '1997-01-01' AND overnight IS NOT NULL AND condition IS NOT NULL),
 y AS (SELECT symbol, rule, bps, (1 + w * r) / (1 + f * w) - w * (1 + r) * f / (1 + f * w) - 1 AS net FROM x) SELECT symbol, rule, bps, count(*) AS n, exp(sum(ln(1 + net))) - 1 AS total_return, avg(net) AS mean FROM y GROUP BY ALL""", "bps total_return mean")
def f8(spark, d):
    b = B.panel(spark, d)
    return A.overnight_study(S.session_legs(b), G.lagged_condition(b, 20).select("symbol", "date", F.col("risk_on").alias("condition")), "1997-01-01", (0, 5, 20))


_PARTS = (("discovery", "1996-01-01", "1998-06-30"), ("validation", "1998-07-01", "2001-06-30"))


@query("f8_partitions", f"""WITH l AS (SELECT b.symbol, b.date, open / lag(close) OVER w - 1 AS overnight, close / open - 1 AS intraday, close / lag(close) OVER w - 1 AS cc, lag(up, 2) OVER w AS risk_on, lag(down, 2) OVER w AS pullback FROM (SELECT *, close > ({_full('avg(close)', 'close', 20)}) AS up, close / lag(close, 3) {WSQL} - 1 < 0 AS down FROM bars) b WINDOW w AS (PARTITION BY symbol ORDER BY date)),
 pt AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{n}', DATE '{a}', DATE '{z}')" for i, (n, a, z) in enumerate(_PARTS))}) AS v(i, partition, a, z)),
 c AS (SELECT symbol, date, 'risk_on' AS rule, CAST(risk_on AS DOUBLE) AS k FROM l WHERE risk_on IS NOT NULL UNION ALL SELECT symbol, date, 'pullback', CAST(pullback AS DOUBLE) FROM l WHERE pullback IS NOT NULL),
 k AS (SELECT pt.partition, symbol, rule, avg(k) AS control FROM pt JOIN c ON CASE WHEN i = 0 THEN date < pt.a ELSE date BETWEEN (SELECT q.a FROM pt q WHERE q.i = pt.i - 1) AND (SELECT q.z FROM pt q WHERE q.i = pt.i - 1) END GROUP BY ALL),
 d AS (SELECT pt.partition, l.*, date = min(date) OVER p AS fst, date = max(date) OVER p AS lst FROM l JOIN pt ON date BETWEEN a AND z WHERE cc IS NOT NULL WINDOW p AS (PARTITION BY pt.partition, symbol)),
 e AS (SELECT partition, symbol, 'overnight' AS rule, overnight AS r, 1.0 AS w, false AS fst, false AS lst, false AS hold FROM d UNION ALL SELECT partition, symbol, 'intraday', intraday, 1.0, false, false, false FROM d UNION ALL SELECT partition, symbol, 'buy_hold', cc, 1.0, fst, lst, true FROM d
  UNION ALL SELECT d.partition, d.symbol, c.rule, overnight, c.k, false, false, false FROM d JOIN c USING (symbol, date) JOIN k ON k.partition = d.partition AND k.symbol = d.symbol AND k.rule = c.rule
  UNION ALL SELECT d.partition, d.symbol, c.rule || '_control', overnight, control, false, false, false FROM d JOIN c USING (symbol, date) JOIN k ON k.partition = d.partition AND k.symbol = d.symbol AND k.rule = c.rule),
 y AS (SELECT partition, symbol, rule, w, CAST(bps AS DOUBLE) AS bps, CASE WHEN hold THEN (1 + r) * (CASE WHEN fst THEN 1 / (1 + f) ELSE 1 END) * (CASE WHEN lst THEN 1 - f ELSE 1 END) - 1 ELSE (1 + w * r) / (1 + f * w) - w * (1 + r) * f / (1 + f * w) - 1 END AS net FROM e, (SELECT bps, bps / 10000.0 AS f FROM (VALUES (0), (5), (20)) AS v(bps)))
 SELECT partition, symbol, rule, bps, count(*) AS n, avg(w) AS mean_exposure, exp(sum(ln(1 + net))) - 1 AS total_return, avg(net) AS mean FROM y GROUP BY ALL""", "bps mean_exposure total_return mean")
def f8_partitions(spark, d):
    b = B.kept_panel(spark, d)
    c = G.lagged_condition(b, 20)
    c = c.select("symbol", "date", F.explode(F.create_map(F.lit("risk_on"), F.col("risk_on"), F.lit("pullback"), F.col("pullback"))).alias("rule", "condition"))
    return A.overnight_partitions(S.session_legs(b), c, _PARTS, (0, 5, 20))


@query("f7_exposure_control", f"SELECT symbol, avg(condition) AS exposure FROM ({_LEGS}) WHERE date < DATE '1997-01-01' GROUP BY symbol", "exposure")
def f7(spark, d):
    return A.exposure_control(G.lagged_condition(B.panel(spark, d), 20).withColumnRenamed("risk_on", "condition"), "1997-01-01")


@query("f10_time_share", f"SELECT a.date, (1 + a.overnight) * (1 + b.intraday) - 1 AS r FROM ({_LEGS}) a JOIN ({_LEGS}) b ON a.date = b.date AND a.symbol = 'S1' AND b.symbol = 'S2'", "r")
def f10(spark, d):
    s = S.session_legs(B.panel(spark, d))
    leg = lambda n, c: s.filter(F.col("symbol") == n).select("date", F.col(c).alias("r"))
    return A.time_share(leg("S1", "overnight"), leg("S2", "intraday"))


@query("l5_shadow_curves", f"""WITH x AS (SELECT v.version, b.symbol, b.date, CASE v.version WHEN 'equal' THEN 1.0 / count(*) OVER (PARTITION BY v.version, b.date) ELSE coalesce(t.weight, 0) END AS w, lead(b.close) OVER (PARTITION BY v.version, b.symbol ORDER BY b.date) / b.close - 1 AS r FROM bars b JOIN ({_TOP}) t ON t.symbol = b.symbol AND t.date = b.date, (VALUES ('equal'), ('top')) AS v(version)),
 g AS (SELECT version, date, sum(w * r) AS gross, list(w ORDER BY symbol) AS t, list(w * (1 + r) ORDER BY symbol) AS v FROM x GROUP BY ALL HAVING count(*) = count(r)),
 p AS (SELECT *, lag(list_transform(v, lambda q: q / (1 + gross))) OVER (PARTITION BY version ORDER BY date) AS pv FROM g),
 c AS (SELECT version, date, gross, list_reduce(list_transform(range(21), lambda i: CAST(0 AS DOUBLE)), lambda c, z: 0.001 * list_sum(list_transform(range(1, 10), lambda i: abs((1 - c) * t[i] - coalesce(pv[i], 0))))) AS cost FROM p)
 SELECT version, date, gross, cost, (1 - cost) * (1 + gross) - 1 AS net, product((1 - cost) * (1 + gross)) OVER (PARTITION BY version ORDER BY date ROWS UNBOUNDED PRECEDING) AS nav FROM c""", "gross cost net nav")
def l5(spark, d):
    w = x5(spark, d).withColumn("_e", 1 / F.count("*").over(X.wd()))
    nxt = B.panel(spark, d).select("symbol", "date", (F.lead("close").over(S.ws()) / F.col("close") - 1).alias("r"))
    books = F.explode(F.create_map(F.lit("equal"), F.col("_e"), F.lit("top"), F.col("weight"))).alias("version", "weight")
    return A.shadow_curves(w.select("symbol", "date", books).join(nxt.hint("merge"), ["symbol", "date"]), 10.0)
