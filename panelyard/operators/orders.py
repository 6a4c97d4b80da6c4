"""Costs, quotes and order plans as relational steps: any number of accounts, symbols and times at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def impact_cost_rate(notional: Column, adv: Column, base_bps: float, multiple: float = 1.0, added_bps: float = 0.0, impact_bps: float = 10.0) -> Column:
    """The cost rate of a trade; impact grows with the square root of its share of volume over 1 %."""
    return (base_bps * multiple + added_bps + impact_bps * F.sqrt(notional / F.nullif(adv, F.lit(0.0)) / 0.01)) / 10_000


def intended_orders(book: DataFrame, max_adv: float, keys: tuple[str, ...] = ("account", "date")) -> DataFrame:
    """Target less held units at the prior close, within a share of volume; book(weight, units, price, adv, cash)."""
    nav = F.max("cash").over(W.partitionBy(*keys)) + F.sum(F.col("units") * F.col("price")).over(W.partitionBy(*keys))
    b = book.withColumn("nav", nav).withColumn("_cap", F.col("adv") * max_adv / F.col("price"))
    delta = F.col("weight") * F.col("nav") / F.col("price") - F.col("units")
    return b.withColumn("delta", F.greatest(-F.col("_cap"), F.least(F.col("_cap"), delta))).drop("_cap")


def quote_checks(quotes: DataFrame, now: Column, max_spread_bps: float, max_age: int) -> DataFrame:
    """quotes(bid, ask, at) with the mid, or the first reason why there is none; max_age in seconds."""
    mid = (F.col("bid") + F.col("ask")) / 2
    age = F.unix_timestamp(now) - F.unix_timestamp("at")
    reason = F.when(F.col("bid").isNull() | (F.col("bid") <= 0), "bid").when(F.col("ask").isNull() | (F.col("ask") <= 0), "ask").when(F.col("at").isNull() | (age < 0) | (age > max_age), "age").when(F.col("ask") < F.col("bid"), "crossed").when((F.col("ask") - F.col("bid")) / mid * 10_000 > max_spread_bps, "spread")
    q = quotes.withColumn("reason", reason)
    return q.withColumn("mid", F.when(F.col("reason").isNull(), mid))


def fx_normalise(amounts: DataFrame, fx: DataFrame, fields: tuple[str, ...], base: str = "base", low: float = 0.5, high: float = 3.0) -> DataFrame:
    """Amounts over the ask of their base currency's rate; null where the rate is missing, crossed or out of range."""
    ok = (F.col("_ask") >= F.col("_bid")) & F.col("_bid").between(low, high) & F.col("_ask").between(low, high)
    j = amounts.join(fx.select(base, F.col("bid").alias("_bid"), F.col("ask").alias("_ask")), base, "left")
    return j.withColumns({c: F.when(ok, F.col(c) / F.col("_ask")) for c in fields}).drop("_bid", "_ask")


def fee_bound(quantity: Column, price: Column, per_share: float = 0.005, floor: float = 1.0, share: float = 0.0005) -> Column:
    """P10"""
    return F.when(quantity > 0, F.greatest(F.lit(floor), per_share * quantity, share * quantity * price)).otherwise(0.0)


def order_plan(targets: DataFrame, reserve: float, collar_bps: float, max_adv: float, keys: tuple[str, ...] = ("account",)) -> DataFrame:
    """whole-share orders of targets(account, symbol, weight, held, bid, ask, adv, nav, cash).

    The wanted quantity is floored at the collared ask, trades keep within max_adv of volume, and if the buys of an
    account exceed its cash less the reserve, all are scaled by one factor; sales bring no cash yet.
    """
    buy, sell = F.ceil(F.col("ask") * (1 + collar_bps / 10_000) * 100) / 100, F.floor(F.col("bid") * (1 - collar_bps / 10_000) * 100) / 100
    want = F.floor(F.col("nav") * (1 - reserve) * F.col("weight") / buy)
    o = targets.withColumns({"_d": want - F.col("held"), "_buy": buy, "_sell": sell})
    o = o.filter("_d <> 0").withColumns({"side": F.when(F.col("_d") > 0, "BUY").otherwise("SELL"), "limit_price": F.when(F.col("_d") > 0, F.col("_buy")).otherwise(F.col("_sell"))})
    o = o.withColumn("quantity", F.least(F.abs("_d"), F.floor(F.col("adv") * max_adv / F.col("limit_price"))))
    q, p = F.col("quantity"), F.col("limit_price")
    is_buy = F.col("side") == "BUY"
    spent = F.sum(F.when(is_buy, q * p + fee_bound(q, p))).over(W.partitionBy(*keys))
    scale = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("cash") - F.col("nav") * reserve) / F.nullif(spent, F.lit(0.0)))
    o = o.withColumn("_scale", F.coalesce(scale, F.lit(1.0))).withColumn("quantity", F.when(is_buy, F.floor(q * F.col("_scale"))).otherwise(q)).filter("quantity > 0")
    mid = (F.col("bid") + F.col("ask")) / 2
    after = F.col("held") + F.when(is_buy, q).otherwise(-q)
    o = o.withColumns({"fee": fee_bound(q, p), "notional": q * p, "resulting_weight": after * mid / F.col("nav")})
    return o.select(*keys, "symbol", "side", "quantity", "limit_price", "notional", "fee", "resulting_weight", "nav", "cash")


def plan_checks(plan: DataFrame, reserve: float, cap: float, keys: tuple[str, ...] = ("account",), gross: float | None = None) -> DataFrame:
    """(account, issue, n) of a plan: too large a weight, too much cash spent, both directions of a symbol, short, two
    orders of one symbol (overlap) and, with a limit, resulting weights that add up to more than gross."""
    per = plan.groupBy(*keys, "symbol").agg(F.max("resulting_weight").alias("w"), F.min("resulting_weight").alias("lo"), F.count_distinct("side").alias("sides"), F.count("*").alias("orders"))
    by_symbol = per.select(*keys, F.explode(F.array_compact(F.array(F.when(F.col("w") > cap, "cap"), F.when(F.col("lo") < 0, "short"), F.when(F.col("sides") > 1, "direction"), F.when(F.col("orders") > 1, "overlap")))).alias("issue"))
    buys = plan.groupBy(*keys).agg(F.sum(F.when(F.col("side") == "BUY", F.col("notional") + F.col("fee")).otherwise(0.0)).alias("spent"), F.max(F.col("cash") - reserve * F.col("nav")).alias("budget"))
    by_account = buys.filter(F.col("spent") > F.greatest(F.lit(0.0), F.col("budget")) + 1e-9).select(*keys, F.lit("cash").alias("issue"))
    if gross is not None:
        by_account = by_account.unionByName(per.groupBy(*keys).agg(F.sum("w").alias("_g")).filter(F.col("_g") > gross + 1e-6).select(*keys, F.lit("gross").alias("issue")))
    return by_symbol.unionByName(by_account).groupBy(*keys, "issue").agg(F.count("*").alias("n"))


def round_trip(book: DataFrame, bps: float, keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """a book(weight, r) entered from cash and left in full: entry fee f W / (1 + f W), gross, exit fee and net.

    The fixed point of the trading cost from empty holdings has this closed form in W, the sum of weights.
    """
    f = bps / 10_000
    g = book.groupBy(*keys).agg(F.sum("weight").alias("_w"), F.sum(F.col("weight") * F.col("r")).alias("gross"))
    g = g.withColumn("entry_fee", f * F.col("_w") / (1 + f * F.col("_w")))
    g = g.withColumn("exit_fee", (1 - F.col("entry_fee")) * (F.col("_w") + F.col("gross")) * f)
    return g.withColumn("net", (1 - F.col("entry_fee")) * (1 + F.col("gross")) - F.col("exit_fee") - 1).drop("_w")
