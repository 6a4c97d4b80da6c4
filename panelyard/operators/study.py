"""Concentration of results, chained folds, scenario grids, portfolio risk, and accounting of fills, orders and intents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# The states in which an order ends without being filled.
TERMINAL = ("Cancelled", "ApiCancelled", "Inactive")


def top_lot_share(lots: DataFrame, counts: dict[str, int], shares: dict[str, float], pnl: str = "pnl") -> DataFrame:
    """T5: (label, n, pnl, fraction_net, fraction_positive) of the n largest winners, n fixed or ceil(share * lots).

    Winners are counted by steps of their logarithm; only the distinct wins of the step in which the n-th one lies are
    ordered, so that no task orders all lots or many equal ones. Fractions are null where their denominator isn't positive.
    """
    won = F.greatest(F.col(pnl), F.lit(0.0))
    n_lots, net, positive = lots.agg(F.count("*"), F.coalesce(F.sum(pnl), F.lit(0.0)), F.coalesce(F.sum(won), F.lit(0.0))).first()
    wanted = {**counts, **{k: -int(-n_lots * p // 1) for k, p in shares.items()}}
    wins = lots.select(won.alias("win")).filter("win > 0").withColumn("step", F.floor(F.log2("win") * 64))
    steps = wins.groupBy("step").agg(F.count("*").alias("c"), F.sum("win").alias("s"))  # a few thousand at most
    steps = steps.withColumn("upto", F.sum("c").over(W.orderBy(F.desc("step"))))
    asked = steps.withColumn("a", F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.lit(v).cast("long").alias("n")) for k, v in wanted.items()]))).select("*", "a.label", "a.n")
    edges = asked.filter("upto > n and upto - c < n").select("label", "step", (F.col("n") - F.col("upto") + F.col("c")).alias("need"))
    equal = wins.join(F.broadcast(edges), "step").groupBy("label", "need", "win").agg(F.count("*").alias("c"))  # one row a label is broadcast
    before = F.sum("c").over(W.partitionBy("label").orderBy(F.desc("win"))) - F.col("c")
    inside = equal.withColumn("k", F.least(F.col("c"), F.col("need") - before)).filter("k > 0")  # of equal wins only their number counts
    parts = asked.filter("upto <= n").select("label", "s").unionByName(inside.select("label", (F.col("k") * F.col("win")).alias("s")))
    sums = parts.groupBy("label").agg(F.sum("s").alias("pnl"))
    all_ = lots.sparkSession.createDataFrame(list(wanted.items()), "label string, n long").join(sums.hint("merge"), "label", "left").fillna(0.0, ["pnl"])
    ratio = lambda d: F.col("pnl") / F.lit(float(d)) if d > 0 else F.lit(None).cast("double")
    return all_.select("label", "n", "pnl", ratio(net).alias("fraction_net"), ratio(positive).alias("fraction_positive"))


def concentration(lots: DataFrame) -> DataFrame:
    """A5: lots(symbol, date, regime, sector, pnl) as (kind, label, pnl, n): sums by ticker, year, month, regime and sector in one aggregate."""
    kinds = {"ticker": F.col("symbol"), "year": F.year("date").cast("string"), "month": F.date_format("date", "yyyy-MM"), "regime": F.col("regime"), "sector": F.col("sector")}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("string").alias("label")) for k, v in kinds.items()]))
    return lots.select("pnl", each.alias("g")).groupBy("g.kind", "g.label").agg(F.sum("pnl").alias("pnl"), F.count("*").alias("n"))


def stitch_folds(folds: DataFrame, model: str = "symbol") -> DataFrame:
    """U4: folds(model, fold, date, nav, ...) chained: nav and pnl, if there, scaled by the product of the earlier folds' last nav."""
    ends = folds.groupBy(model, "fold").agg(F.max_by("nav", "date").alias("end"))
    before = W.partitionBy(model).orderBy("fold").rowsBetween(W.unboundedPreceding, -1)
    capital = ends.select(model, "fold", F.coalesce(F.product("end").over(before), F.lit(1.0)).alias("capital"))
    j = folds.hint("merge").join(capital.hint("merge"), [model, "fold"])
    return j.withColumns({c: F.col(c) * F.col("capital") for c in ("nav", "pnl") if c in folds.columns})


def scenario_grid(daily: DataFrame, scenarios: list[tuple[str, float, int]], r: str = "r") -> DataFrame:
    """(symbol, scenario, year, total_return) of every strategy under every scenario (name, cost in bps a session, first year).

    Sessions compound as a product, which also holds where return and cost lose all or more in one session.
    """
    grid = F.explode(F.array(*[F.struct(F.lit(a).alias("scenario"), F.lit(float(b)).alias("bps"), F.lit(c).alias("start")) for a, b, c in scenarios]))
    d = daily.filter(F.col(r).isNotNull()).select("symbol", F.year("date").alias("year"), F.col(r).alias("r"), grid.alias("g")).filter(F.col("year") >= F.col("g.start"))
    return d.groupBy("symbol", F.col("g.scenario").alias("scenario"), "year").agg((F.product(1 + F.col("r") - F.col("g.bps") / 10_000) - 1).alias("total_return"))


def portfolio_risk(bars: DataFrame, weights: DataFrame, capital: float, per_year: int = 252, sessions: int = 60, volume_sessions: int = 20) -> DataFrame:
    """(volatility, max_weight, max_notional_to_volume, min_dollar_volume, mean_correlation) of weights(symbol, weight).

    bars: symbol, date, close, volume, r. Covariances are taken pair by pair over the last sessions of each symbol; the pairs
    are those of symbols on a date, an equi-join.
    """
    last = bars.withColumn("k", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("date"))))
    w = last.join(weights.hint("merge"), "symbol")
    r = w.filter((F.col("k") <= sessions) & F.col("r").isNotNull())
    a, b = r.select("date", F.col("symbol").alias("a"), F.col("r").alias("x"), F.col("weight").alias("wa")), r.select("date", F.col("symbol").alias("b"), F.col("r").alias("y"), F.col("weight").alias("wb"))
    pairs = a.hint("merge").join(b.hint("merge"), "date").filter("a <= b").groupBy("a", "b", "wa", "wb").agg(F.covar_samp("x", "y").alias("c"), F.corr("x", "y").alias("rho"))
    risk = pairs.agg(F.sqrt(F.sum(F.when(F.col("a") < F.col("b"), 2.0).otherwise(1.0) * F.col("wa") * F.col("wb") * F.col("c")) * per_year).alias("volatility"), F.avg(F.when(F.col("a") < F.col("b"), F.col("rho"))).alias("mean_correlation"))
    dv = w.filter(F.col("k") <= volume_sessions).groupBy("symbol", "weight").agg(F.avg(F.col("close") * F.col("volume")).alias("dv"))
    liquid = dv.agg(F.max("weight").alias("max_weight"), F.max(F.lit(float(capital)) * F.col("weight") / F.nullif("dv", F.lit(0.0))).alias("max_notional_to_volume"), F.min("dv").alias("min_dollar_volume"))
    both = risk.unionByName(liquid, allowMissingColumns=True)  # a row each
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def fill_accounting(fills: DataFrame, commissions: DataFrame, marks: DataFrame) -> DataFrame:
    """Per symbol the traded notional, commissions received and pending, position, exposure and marked P&L.

    fills: execution_id, symbol, side, quantity, price; commissions: execution_id, amount; marks: symbol, mark.
    """
    sign = F.when(F.col("side") == "BUY", 1.0).otherwise(-1.0)
    j = fills.hint("merge").join(commissions.hint("merge"), "execution_id", "left")
    g = j.groupBy("symbol").agg(
        F.sum(F.col("quantity") * F.col("price")).alias("notional"),
        F.coalesce(F.sum("amount"), F.lit(0.0)).alias("commissions"),
        F.count_if(F.col("amount").isNull()).alias("pending"),
        F.sum(sign * F.col("quantity")).alias("position"),
        F.sum(-sign * F.col("quantity") * F.col("price")).alias("_cash"),
    )
    m = g.join(marks.hint("merge"), "symbol", "left").withColumn("exposure", F.col("position") * F.col("mark"))
    return m.withColumn("pnl", F.col("exposure") + F.col("_cash") - F.col("commissions")).drop("_cash", "mark")


def conflicting_executions(executions: DataFrame, payload: str = "payload") -> DataFrame:
    """Execution ids with more than one payload."""
    return executions.groupBy("execution_id").agg(F.countDistinct(payload).alias("payloads")).filter("payloads > 1")


def reconciled_orders(orders: DataFrame, fills: DataFrame, open_orders: DataFrame, completed: DataFrame, events: DataFrame) -> DataFrame:
    """Orders with filled and remaining quantity, average price and state.

    orders: account, order_ref, quantity; fills: account, order_ref, quantity, price; open_orders: order_ref; completed:
    order_ref, status; events: order_ref, seq, kind, status. The last terminal status ends an order that isn't filled;
    a completed order's own status goes before those of events.
    """
    f = fills.groupBy("account", "order_ref").agg(F.sum("quantity").alias("filled"), F.sum(F.col("quantity") * F.col("price")).alias("_paid"))
    ends = F.col("status").isin(*TERMINAL)
    e = events.groupBy("order_ref").agg(F.max(F.col("kind") == "SUBMITTING").alias("_sent"), F.max_by(F.when(ends & (F.col("kind") == "STATUS"), F.col("status")), F.when(ends & (F.col("kind") == "STATUS"), F.col("seq"))).alias("_ended"))
    c = completed.filter(ends).groupBy("order_ref").agg(F.min("status").alias("_completed"))
    o = open_orders.select("order_ref").distinct().withColumn("_open", F.lit(True))
    j = orders.hint("merge").join(f.hint("merge"), ["account", "order_ref"], "left")
    for t in (o, c, e):
        j = j.hint("merge").join(t.hint("merge"), "order_ref", "left")
    j = j.withColumns({"filled": F.coalesce("filled", F.lit(0.0)), "_end": F.coalesce("_completed", "_ended")})
    state = (
        F.when(F.col("_end").isNotNull() & (F.col("filled") < F.col("quantity")), F.when(F.col("_end") == "Inactive", "REJECTED").otherwise("CANCELLED"))
        .when(F.col("filled") == F.col("quantity"), "FILLED")
        .when(F.col("filled") > F.col("quantity"), "OVERFILLED")
        .when(F.col("filled") > 0, "PARTIALLY_FILLED")
        .when(F.col("_open"), "ACKNOWLEDGED")
        .when(F.coalesce("_sent", F.lit(False)), "UNKNOWN_RECONCILE")
        .otherwise("NOT_SUBMITTED")
    )
    return j.select(*orders.columns, "filled", (F.col("quantity") - F.col("filled")).alias("remaining"), (F.col("_paid") / F.nullif("filled", F.lit(0.0))).alias("average_price"), state.alias("state"))


def position_reconciliation(baseline: DataFrame, fills: DataFrame, observed: DataFrame) -> DataFrame:
    """(symbol, expected, actual) where the baseline plus signed fills differs from the observed quantity (all: symbol, quantity; fills: side)."""
    signed = fills.select("symbol", F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity")).alias("q"))
    expected = baseline.select("symbol", F.col("quantity").alias("q")).unionByName(signed).groupBy("symbol").agg(F.sum("q").alias("expected"))
    actual = observed.groupBy("symbol").agg(F.sum("quantity").alias("actual"))
    j = expected.hint("merge").join(actual.hint("merge"), "symbol", "full").fillna(0.0, ["expected", "actual"])
    return j.filter("expected <> actual")


def intent_vs_ledger(file_rows: DataFrame, ledger_rows: DataFrame) -> DataFrame:
    """Rows that only one of both has, with side file or ledger; repeated rows count."""
    a = file_rows.exceptAll(ledger_rows).withColumn("side", F.lit("file"))
    return a.unionByName(ledger_rows.exceptAll(file_rows).withColumn("side", F.lit("ledger")))


def date_intersection(dates: DataFrame, ready: DataFrame) -> DataFrame:
    """Dates of a partition on which signals are ready."""
    return dates.select("date").intersect(ready.select("date"))


def moonshot(shares: DataFrame, label: str = "top_3", most: float = 0.5) -> DataFrame:
    """A5: whether the winners of that label in top_lot_share's result make more than so much of the net; false where it has no share."""
    return shares.filter(F.col("label") == label).select("label", F.coalesce(F.col("fraction_net") > most, F.lit(False)).alias("moonshot"))


def equity_residual(per_symbol: DataFrame, nav_before: float, nav: float) -> DataFrame:
    """Of fill_accounting's rows, all notional over the first net asset value, the marked contribution and what of the equity change it leaves."""
    g = per_symbol.agg(F.coalesce(F.sum("notional"), F.lit(0.0)).alias("notional"), F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("marked"))
    change = F.lit(float(nav - nav_before))
    return g.select("notional", (F.col("notional") / nav_before).alias("turnover"), F.col("marked").alias("marked_contribution"), change.alias("equity_change"), (change - F.col("marked")).alias("unattributed"))
