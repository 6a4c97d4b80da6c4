"""self-financing accounts as a ledger of trades, contributions and daily marks.

A book's targets hold from one trade to the next. What such a block holds grows from 1 without regard to the net asset
value, so all blocks of all books run side by side; one product over a book's blocks then chains their values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.bars import kept


@dataclass(frozen=True)
class Ledger:
    """daily: a row a book and session; trades: dollars and fee by symbol and kind (open, close); contributions: by date and symbol."""

    daily: DataFrame
    trades: DataFrame
    contributions: DataFrame


def with_cost(moves: DataFrame, keys: tuple[str, ...], rate: float, previous: str = "previous", target: str = "target") -> DataFrame:
    """moves with cost, the exact c with c = rate * sum |(1 - c) * target - previous| by key.

    With x = 1 - c the sum is piecewise linear, with a corner at previous / target of each row. Prefix sums in the order of
    the corners give the slope beyond each; the root lies beyond the last corner at which the balance is not yet positive.
    One shuffle on the keys. Targets must not be negative and rate * their sum must be below 1.
    """
    t, p = F.col(target), F.col(previous)
    corner = F.when(t > 0, p / t)
    beyond, whole = W.partitionBy(*keys).orderBy(F.col("_corner").asc_nulls_last()), W.partitionBy(*keys)
    m = moves.withColumn("_corner", corner)
    m = m.withColumns({"_tk": F.sum(t).over(beyond), "_pk": F.sum(p).over(beyond), "_t_": F.sum(t).over(whole), "_p_": F.sum(p).over(whole)})
    slope, base = 2 * F.col("_tk") - F.col("_t_"), F.col("_p_") - 2 * F.col("_pk")
    reached = rate * (F.col("_corner") * slope + base) <= 1 - F.col("_corner")
    root = F.max(F.when(reached, F.struct("_corner", ((1 - rate * base) / (1 + rate * slope)).alias("x")))).over(whole)["x"]
    first = (1 - rate * F.col("_p_")) / (1 - rate * F.col("_t_"))  # before all corners
    return m.withColumn("cost", 1 - F.coalesce(root, first)).drop("_corner", "_tk", "_pk", "_t_", "_p_")


def _blocks(calendar: DataFrame, cadence: int, intraday: bool, buy_hold: bool) -> DataFrame:
    """calendar with _plan (whose targets hold), _block (from one trade to the next), _planned and is_rebalance."""
    if cadence < 1:
        raise ValueError("cadence must be at least 1")
    n = F.col("session_no")
    c = calendar.select("date", "decision_date", "session_no", (F.lit(0) if buy_hold else F.floor(n / cadence)).cast("int").alias("_plan"))
    c = c.withColumn("_block", n.cast("int") if intraday else F.col("_plan"))
    start = n == (F.lit(0) if buy_hold else F.col("_plan") * cadence)
    return c.withColumns({"_planned": start, "is_rebalance": F.lit(True) if intraday else start})


def account_ledger(prices: DataFrame, targets: DataFrame, calendar: DataFrame, bps: float, cadence: int = 1, keys: tuple[str, ...] = (), intraday: bool = False, buy_hold: bool = False, liquidate: bool = True) -> Ledger:
    """targets decided at one close are traded at the next open every cadence sessions and marked at each close.

    prices(date, symbol, open, close); targets(*keys, date, symbol, weight), weights of 0 to 1 in all, the rest is cash;
    calendar(date, decision_date, session_no) of the sessions to hold, from 0. buy_hold trades at the first session only;
    intraday sells at every close and buys the same plan again at every open; liquidate sells all at the last close.
    n_missing counts holdings without a price that session, which keep their value. Dollars are per initial dollar. By
    book, contributions less fees add up to the last net asset value less 1.
    """
    rate, k = bps / 10_000, list(keys)
    cal = kept(_blocks(calendar, cadence, intraday, buy_hold), "ledger-sessions")
    last, blocks = cal.agg(F.max("session_no"), F.max("_block")).first()
    p = prices.withColumn("_prev", F.lag("close").over(W.partitionBy("symbol").orderBy("date"))).select("date", "symbol", "open", "close", "_prev")
    plan = cal.filter("_planned").select("_plan", F.col("decision_date").alias("date"))
    held = targets.filter("weight > 0").select(*k, "date", "symbol", F.col("weight").alias("_t")).join(plan.hint("merge"), "date").drop("date")
    trading = cal.filter("is_rebalance")
    marks = cal.select("_plan", "_block", "date", "session_no", F.lit(False).alias("_end"))
    if not intraday:  # a block ends at the open at which the next one trades
        marks = marks.unionByName(trading.filter("_block > 0").select((F.col("_plan") - 1).alias("_plan"), (F.col("_block") - 1).alias("_block"), "date", "session_no", F.lit(True).alias("_end")))
    book = held.join(marks.hint("merge"), "_plan").join(p.hint("merge"), ["date", "symbol"], "left")
    lot = W.partitionBy(*k, "_block", "symbol").orderBy("session_no")
    start = F.min("session_no").over(W.partitionBy(*k, "_block", "symbol"))
    gap = F.coalesce(F.when(F.col("session_no") > start, F.col("open") / F.col("_prev")), F.lit(1.0))
    day = F.when(F.col("_end"), 1.0).otherwise(F.coalesce(F.col("close") / F.col("open"), F.lit(1.0)))
    book = book.withColumns({"_gap": gap, "_day": day}).withColumn("_close", F.col("_t") * F.product(F.col("_gap") * F.col("_day")).over(lot)).withColumn("_open", F.col("_close") / F.col("_day"))
    missing = F.col("open").isNull() | F.col("close").isNull()
    book = kept(book.select(*k, "_block", "date", "session_no", "_end", "symbol", "_t", "_open", "_close", (F.col("_open") - F.col("_open") / F.col("_gap")).alias("_night"), missing.alias("_missing")), "ledger-book")

    sums = book.groupBy(*k, "_block", "session_no", "_end").agg(F.sum("_t").alias("_in"), F.sum("_open").alias("_o"), F.sum("_close").alias("_c"), F.max("_open").alias("_mo"), F.max("_close").alias("_mc"), F.count_if("_missing").alias("n_missing"))
    sums = kept(sums.withColumns({"_po": F.col("_o") + 1 - F.col("_in"), "_pc": F.col("_c") + 1 - F.col("_in")}), "ledger-sums")
    # What comes into a block: the value of the one before per unit of its start, and the weights of its holdings.
    if intraday:
        before = sums.select(*k, (F.col("_block") + 1).alias("_block"), (F.col("_pc") - rate * F.col("_c")).alias("_u"), F.lit(0.0).alias("_uo"), F.lit(0.0).alias("_um"))
        owned = book.limit(0).select(*k, "_block", "symbol", F.lit(0.0).alias("_v"))
    else:
        before = sums.filter("_end").select(*k, (F.col("_block") + 1).alias("_block"), F.col("_po").alias("_u"), F.col("_o").alias("_uo"), F.col("_mo").alias("_um"))
        owned = book.filter("_end").select(*k, (F.col("_block") + 1).alias("_block"), "symbol", F.col("_open").alias("_v"))
    aims = held.join(trading.select("_plan", "_block").hint("merge"), "_plan").select(*k, "_block", "symbol", "_t")
    moves = aims.join(owned.hint("merge"), [*k, "_block", "symbol"], "full").join(before.select(*k, "_block", "_u").hint("merge"), [*k, "_block"], "left")
    moves = moves.select(*k, "_block", "symbol", F.coalesce("_t", F.lit(0.0)).alias("target"), F.coalesce(F.col("_v") / F.col("_u"), F.lit(0.0)).alias("previous"))
    moves = kept(with_cost(moves, (*keys, "_block"), rate), "ledger-moves")
    fees = moves.groupBy(*k, "_block").agg(F.first("cost").alias("_fee"))
    steps = trading.select("_block", "date")
    if k:  # every book has every block, also where it holds only cash
        books = targets.select(*k).distinct().withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks or 0))))
        steps = books.join(steps.hint("merge"), "_block")
    chain = W.partitionBy(*(k or [F.lit(1)])).orderBy("_block").rowsBetween(W.unboundedPreceding, 0)  # a row a block of a book
    steps = steps.join(fees.hint("merge"), [*k, "_block"], "left").join(before.hint("merge"), [*k, "_block"], "left")
    steps = steps.withColumns({"_fee": F.coalesce("_fee", F.lit(0.0)), "_u": F.coalesce("_u", F.lit(1.0)), "_uo": F.coalesce("_uo", F.lit(0.0)), "_um": F.coalesce("_um", F.lit(0.0))})
    steps = kept(steps.withColumn("_n", F.product(F.col("_u") * (1 - F.col("_fee"))).over(chain)), "ledger-steps")

    scale = steps.select(*k, "_block", "_n", "_fee")
    at_open = moves.join(steps.select(*k, "_block", "_n", "date").hint("merge"), [*k, "_block"])
    traded = (1 - F.col("cost")) * F.col("target") - F.col("previous")
    opened = at_open.filter(F.abs(traded) > 1e-12).select(*k, "date", "symbol", F.lit("open").alias("kind"), (F.col("_n") / (1 - F.col("cost")) * traded).alias("dollars"))
    at_last = F.lit(liquidate) & (F.col("session_no") == F.lit(last))
    sold = book.filter(~F.col("_end") & (F.lit(intraday) | at_last))
    closed = sold.filter("_close > 1e-12").join(scale.hint("merge"), [*k, "_block"]).select(*k, "date", "symbol", F.lit("close").alias("kind"), (-F.col("_n") * F.col("_close")).alias("dollars"))
    trades = opened.unionByName(closed).withColumn("fee", F.abs("dollars") * rate)

    parts = book.join(scale.hint("merge"), [*k, "_block"])
    contributions = parts.groupBy(*k, "date", "symbol").agg(F.sum(F.col("_n") * F.col("_night")).alias("overnight"), F.sum(F.col("_n") * (F.col("_close") - F.col("_open"))).alias("intraday"))

    pnl = contributions.groupBy(*k, "date").agg(F.sum("overnight").alias("_on"), F.sum("intraday").alias("_id"))
    paid = trades.groupBy(*k, "date").agg(F.sum("fee").alias("_paid"), F.sum(F.abs("dollars")).alias("_turned"))
    days = cal.select("_block", "date", "session_no", "is_rebalance").join(steps.drop("date").hint("merge"), "_block")
    days = days.join(sums.filter("not _end").drop("_end").hint("merge"), [*k, "_block", "session_no"], "left").join(pnl.hint("merge"), [*k, "date"], "left").join(paid.hint("merge"), [*k, "date"], "left")
    zero = ("_in", "_o", "_c", "_mo", "_mc", "_on", "_id", "_paid", "_turned")
    days = days.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in zero} | {c: F.coalesce(c, F.lit(1.0)) for c in ("_po", "_pc")} | {"n_missing": F.coalesce("n_missing", F.lit(0))})
    sells = F.lit(intraday) | at_last
    days = days.withColumn("nav", F.col("_n") * (F.col("_pc") - F.when(sells, rate * F.col("_c")).otherwise(0.0)))
    along = W.partitionBy(*(k or [F.lit(1)])).orderBy("session_no")  # a row a session of a book
    days = days.withColumn("nav_before", F.coalesce(F.lag("nav").over(along), F.lit(1.0)))
    share = lambda c: F.col(c) / F.col("nav_before")
    trade = F.col("is_rebalance")
    pre = F.when(trade, F.col("_uo") / F.col("_u")).otherwise(F.col("_o") / F.col("_po"))
    largest = F.greatest(F.when(trade, F.col("_um") / F.col("_u")).otherwise(F.lit(0.0)), F.col("_mo") / F.col("_po"), F.col("_mc") / F.col("_pc"))
    daily = days.select(
        *k, "date", "nav_before", "nav", (F.col("nav") / F.col("nav_before") - 1).alias("net"), share("_on").alias("overnight"), share("_id").alias("intraday"), share("_paid").alias("cost"), share("_turned").alias("turnover"),
        pre.alias("preopen_exposure"), F.when(trade, F.col("_in")).otherwise(F.col("_o") / F.col("_po")).alias("open_exposure"), F.when(sells, 0.0).otherwise(F.col("_c") / F.col("_pc")).alias("closing_exposure"), largest.alias("largest"), "n_missing",
    )
    return Ledger(daily, trades, contributions)


def open_to_open_ledger(prices: DataFrame, targets: DataFrame, calendar: DataFrame, bps: float, cadence: int = 1, keys: tuple[str, ...] = (), buy_hold: bool = False, liquidate: bool = True) -> Ledger:
    """as account_ledger, with holdings marked from each open to the symbol's next one; no leg lies between them.

    A session's contribution is its open-to-open profit, under intraday; terminal liquidation is at the last exit's open.
    """
    after = F.lead("open").over(W.partitionBy("symbol").orderBy("date"))
    legs = prices.select("date", "symbol", "open", after.alias("close")).filter("open is not null and close is not null")
    out = account_ledger(legs, targets, calendar, bps, cadence, keys, False, buy_hold, liquidate)
    return Ledger(out.daily.drop("preopen_exposure", "overnight"), out.trades, out.contributions.drop("overnight"))
