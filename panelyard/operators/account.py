"""Costs, drifting weights and net asset values as relational steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.bars import kept
from .ledger import account_ledger

PASSES = 20


def trading_cost(previous: Column, target: Column, rate: float) -> Column:
    """the c with c = rate * sum |(1 - c) * target - previous|, by repeated substitution.

    previous, target: arrays of the book's weights. Each pass shrinks the error by rate * sum(target) at least.
    """
    pairs = F.arrays_zip(previous.alias("p"), target.alias("t"))

    def moved(c: Column) -> Column:
        return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + F.abs((1 - c) * x["t"] - x["p"]))

    return F.aggregate(F.sequence(F.lit(1), F.lit(PASSES)), F.lit(0.0), lambda c, _: F.lit(float(rate)) * moved(c))


def rebalance_blocks(calendar: DataFrame, cadence: int, offset: int = 0) -> DataFrame:
    """(date, session_no, block, is_rebalance)."""
    n = F.col("session_no") - offset
    return calendar.withColumns({"block": F.floor(n / cadence), "is_rebalance": n % cadence == 0})


def drifted_weights(book: DataFrame) -> DataFrame:
    """book(block, date, symbol, target, r): weights before each date's return, from the block's target and its growth.

    Cash is what the target leaves; weights need no net asset value, so all blocks run side by side.
    """
    w = W.partitionBy("block", "symbol").orderBy("date")
    before = F.coalesce(F.product(1 + F.col("r")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(1.0))
    g = book.withColumn("_v", F.col("target") * before)
    d = W.partitionBy("block", "date")
    return g.withColumn("weight", F.col("_v") / (F.sum("_v").over(d) + 1 - F.sum("target").over(d))).drop("_v")


def single_asset_account(legs: DataFrame, bps: float, r: str = "r", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """full exposure entered and left on every row, a fee on both legs: growth (1 + r)(1 - f) / (1 + f)."""
    f = bps / 10_000
    out = legs.withColumn("net", (1 + F.col(r)) * F.lit((1 - f) / (1 + f)) - 1)
    nav = F.product(1 + F.col("net")).over(W.partitionBy(*keys).orderBy("date").rowsBetween(W.unboundedPreceding, 0))
    return out.withColumn("nav", nav)


def break_even_bps(legs: DataFrame, r: str = "r", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """the fee per leg at which total log growth is 0: n * ln((1 + f) / (1 - f)) = sum ln(1 + r)."""
    g = legs.groupBy(*keys).agg(F.avg(F.log1p(r)).alias("_g"))
    return g.select(*keys, F.least(F.lit(999.0), F.greatest(F.lit(0.0), 10_000 * (F.exp("_g") - 1) / (F.exp("_g") + 1))).alias("bps"))


def break_even_exposed(legs: DataFrame, r: str = "r", exposure: str = "exposure", keys: tuple[str, ...] = ("symbol",), most: float = 999.0, cells: int = 64, rounds: int = 7) -> DataFrame:
    """F6 for any exposure in [0, 1]: (keys, bps, capped), the fee at which an exposed_account's log growth is 0.

    Growth falls as the fee rises. Each round evaluates a grid of fees between a key's bounds in one aggregation, and the
    cell where the sign changes is the next round's; 0 where growth is not positive free of fees, and most, capped, where
    it still is at the largest fee.
    """
    rows = kept(legs.filter(F.col(r).isNotNull() & F.col(exposure).isNotNull()).select(*keys, F.col(r).alias("_r"), F.col(exposure).alias("_w")), "fee-legs")
    at = rows.select(*keys).distinct().withColumns({"lo": F.lit(0.0), "hi": F.lit(float(most))})
    for _ in range(rounds):
        grid = at.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(cells)))).withColumn("_bps", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("_i") / cells)
        f, w = F.col("_bps") / 10_000, F.col("_w")
        growth = F.sum(F.log((1 + w * F.col("_r") - w * (1 + F.col("_r")) * f) / (1 + f * w)))
        g = rows.join(grid.hint("merge"), list(keys)).groupBy(*keys, "_bps").agg(growth.alias("_g"))
        up = F.max(F.when(F.col("_g") > 0, F.col("_bps")))
        down = F.min(F.when(F.col("_g") <= 0, F.col("_bps")))
        at = kept(g.groupBy(*keys).agg(F.coalesce(up, F.lit(0.0)).alias("lo"), F.coalesce(down, F.lit(float(most))).alias("hi")), "fee-bounds")
    return at.select(*keys, ((F.col("lo") + F.col("hi")) / 2).alias("bps"), (F.col("lo") >= most).alias("capped"))


def cost_grid(legs: DataFrame, grid: tuple[float, ...], r: str = "r", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Total net return at each fee of a grid, one aggregation for all."""
    each = legs.select(*keys, r, F.explode(F.array(*[F.lit(float(b)) for b in grid])).alias("bps"))
    f = F.col("bps") / 10_000
    return each.groupBy(*keys, "bps").agg((F.exp(F.sum(F.log1p(r) + F.log((1 - f) / (1 + f)))) - 1).alias("total_return"))


def combine_sleeves(a: DataFrame, b: DataFrame, capital_a: float, capital_b: float) -> DataFrame:
    """two books with capital of their own and no resets: nav, each book's share, the joint return."""
    j = a.select("date", F.col("nav").alias("_a")).join(b.select("date", F.col("nav").alias("_b")), "date")
    j = j.withColumns({"value_a": F.col("_a") * capital_a, "value_b": F.col("_b") * capital_b})
    return j.withColumns({"nav": (F.col("value_a") + F.col("value_b")) / (capital_a + capital_b), "share_a": F.col("value_a") / (F.col("value_a") + F.col("value_b"))}).drop("_a", "_b")


def equal_weight_account(panel: DataFrame, bps: float, cadence: int, calendar: DataFrame, r: str = "r") -> DataFrame:
    """equal weights of all symbols, rebalanced every cadence sessions, cost at each rebalance, daily gross and net.

    panel(date, symbol, r) holds the returns from each date to the next; dates without a return are not held.
    """
    blocks = rebalance_blocks(calendar, cadence)
    held = panel.filter(F.col(r).isNotNull()).select("date", "symbol", F.col(r).alias("r")).join(blocks, "date")
    first = held.filter("is_rebalance").select("block", "symbol").distinct()
    sized = first.withColumn("target", 1 / F.count("*").over(W.partitionBy("block")))
    book = drifted_weights(held.join(sized, ["block", "symbol"]))
    by_date = W.partitionBy("date")
    gross = book.withColumn("_g", F.sum(F.col("weight") * F.col("r")).over(by_date))
    end = gross.withColumn("_end", F.col("weight") * (1 + F.col("r")) / (1 + F.col("_g")))
    daily = end.groupBy("date", "session_no", "is_rebalance").agg(F.first("_g").alias("gross"), F.map_from_entries(F.collect_list(F.struct("symbol", "_end"))).alias("_ends"), F.map_from_entries(F.collect_list(F.struct("symbol", "target"))).alias("_targets"))
    one = W.partitionBy(F.lit(1)).orderBy("date")  # one row a date of one book
    d = daily.withColumn("_prev", F.coalesce(F.lag("_ends").over(one), F.expr("cast(map() as map<string, double>)")))
    names = F.array_sort(F.array_union(F.map_keys("_prev"), F.map_keys("_targets")))
    at = lambda m: F.transform(names, lambda s: F.coalesce(F.element_at(F.col(m), s), F.lit(0.0)))
    cost = F.when(F.col("is_rebalance"), trading_cost(at("_prev"), at("_targets"), bps / 10_000)).otherwise(0.0)
    d = d.withColumn("cost", cost).withColumn("net", (1 - F.col("cost")) * (1 + F.col("gross")) - 1)
    return d.withColumn("nav", F.product(1 + F.col("net")).over(one.rowsBetween(W.unboundedPreceding, 0))).select("date", "gross", "cost", "net", "nav")


def close_marked_account(prices: DataFrame, targets: DataFrame, calendar: DataFrame, bps: float, cadence: int) -> DataFrame:
    """the daily marks of one book's account_ledger, all sold at the last close.

    Exposures are at the open before and after trading and at the close; overnight, intraday and cost are fractions of the
    value before.
    """
    return account_ledger(prices, targets, calendar, bps, cadence).daily.drop("turnover")


def exposed_account(legs: DataFrame, r: str = "r", exposure: str = "exposure", bps: str = "bps") -> DataFrame:
    """F5 for any exposure in [0, 1], entered and left on every row; the fee from cash is f w / (1 + f w)."""
    f, w = F.col(bps) / 10_000, F.col(exposure)
    kept = 1 / (1 + f * w)
    return legs.withColumn("net", kept * (1 + w * F.col(r)) - kept * w * (1 + F.col(r)) * f - 1)


def exposure_control(conditions: DataFrame, until: str, c: str = "condition", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """by key, the mean of a condition before a date: the constant exposure that matches it."""
    return conditions.filter((F.col("date") < F.lit(until).cast("date")) & F.col(c).isNotNull()).groupBy(*keys).agg(F.avg(F.col(c).cast("double")).alias("exposure"))


def overnight_study(legs: DataFrame, conditions: DataFrame, start: str, grid: tuple[float, ...]) -> DataFrame:
    """F8: (symbol, rule, bps) with days, total return and mean of the overnight and intraday legs, of the overnight leg
    while a condition holds, and of its constant control from before start; every fee of the grid in one job."""
    control = exposure_control(conditions, start)
    x = legs.filter(F.col("date") >= F.lit(start).cast("date")).join(conditions, ["symbol", "date"]).join(control.withColumnRenamed("exposure", "_k").hint("merge"), "symbol").filter("overnight is not null and condition is not null")
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), r.alias("r"), e.alias("exposure")) for n, r, e in (("overnight", F.col("overnight"), F.lit(1.0)), ("intraday", F.col("intraday"), F.lit(1.0)), ("conditional", F.col("overnight"), F.col("condition").cast("double")), ("control", F.col("overnight"), F.col("_k")))])
    each = x.select("symbol", F.explode(rules).alias("_x")).select("symbol", "_x.*", F.explode(F.array(*[F.lit(float(b)) for b in grid])).alias("bps"))
    return exposed_account(each).groupBy("symbol", "rule", "bps").agg(F.count("*").alias("n"), (F.exp(F.sum(F.log1p("net"))) - 1).alias("total_return"), F.avg("net").alias("mean"))


def overnight_partitions(legs: DataFrame, conditions: DataFrame, partitions: tuple[tuple[str, str, str], ...], grid: tuple[float, ...], close_close: str = "close_close") -> DataFrame:
    """F8: (partition, symbol, rule, bps) with days, mean exposure, total return and mean of each leg, of holding throughout, of
    the overnight leg under each condition and of its constant control, for every fee of the grid, in one job.

    legs(symbol, date, overnight, intraday, close_close); conditions(symbol, date, rule, condition). partitions (name, start,
    end) are independent and in order: the first one's controls are the condition's mean before it, later ones' that of the
    partition before. Buy and hold pays on its first and last day only; dates without a leg or a condition are left out.
    """
    names = F.array(*[F.struct(F.lit(n).alias("partition"), F.lit(a).cast("date").alias("_a"), F.lit(z).cast("date").alias("_z")) for n, a, z in partitions])
    inside = lambda df: df.withColumn("_p", F.explode(names)).filter(F.col("date").between(F.col("_p._a"), F.col("_p._z"))).withColumn("partition", F.col("_p.partition")).drop("_p")
    c = conditions.filter("condition is not null").withColumn("condition", F.col("condition").cast("double"))
    follows = {partitions[i][0]: partitions[i + 1][0] for i in range(len(partitions) - 1)}
    earlier = c.filter(F.col("date") < F.lit(partitions[0][1]).cast("date")).withColumn("partition", F.lit(partitions[0][0]))
    if follows:
        after = F.element_at(F.create_map(*[F.lit(x) for kv in follows.items() for x in kv]), F.col("partition"))
        before = inside(c).filter(F.col("partition").isin(*follows)).withColumn("partition", after)
        earlier = earlier.unionByName(before)
    controls = earlier.groupBy("partition", "symbol", "rule").agg(F.avg("condition").alias("_k"))
    days = inside(legs.filter(F.col("overnight").isNotNull() & F.col("intraday").isNotNull() & F.col(close_close).isNotNull()))
    w = W.partitionBy("partition", "symbol")
    days = days.withColumns({"_first": F.col("date") == F.min("date").over(w), "_final": F.col("date") == F.max("date").over(w)})
    plain = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(x).alias("r"), F.lit(1.0).alias("exposure"), (F.lit(n == "buy_hold")).alias("_hold")) for n, x in (("overnight", "overnight"), ("intraday", "intraday"), ("buy_hold", close_close))]))
    base = days.select("partition", "symbol", "_first", "_final", plain.alias("_x")).select("partition", "symbol", "_first", "_final", "_x.*")
    held = days.join(c.select("symbol", "date", "rule", "condition").hint("merge"), ["symbol", "date"]).join(controls.hint("merge"), ["partition", "symbol", "rule"])
    both = F.explode(F.array(F.struct(F.col("rule"), F.col("condition").alias("exposure")), F.struct(F.concat("rule", F.lit("_control")).alias("rule"), F.col("_k").alias("exposure"))))
    held = held.select("partition", "symbol", "_first", "_final", F.col("overnight").alias("r"), both.alias("_x")).select("partition", "symbol", "_first", "_final", "_x.rule", "r", "_x.exposure", F.lit(False).alias("_hold"))
    each = base.unionByName(held).withColumn("bps", F.explode(F.array(*[F.lit(float(b)) for b in grid])))
    f = F.col("bps") / 10_000
    each = exposed_account(each)
    kept_ = (1 + F.col("r")) * F.when(F.col("_first"), 1 / (1 + f)).otherwise(1.0) * F.when(F.col("_final"), 1 - f).otherwise(1.0) - 1
    each = each.withColumn("net", F.when(F.col("_hold"), kept_).otherwise(F.col("net")))
    return each.groupBy("partition", "symbol", "rule", "bps").agg(F.count("*").alias("n"), F.avg("exposure").alias("mean_exposure"), (F.exp(F.sum(F.log1p("net"))) - 1).alias("total_return"), F.avg("net").alias("mean"))


def time_share(a: DataFrame, b: DataFrame) -> DataFrame:
    """two books one after the other each day: (1 + a)(1 + b) - 1."""
    return a.select("date", F.col("r").alias("_a")).join(b.select("date", F.col("r").alias("_b")), "date").select("date", ((1 + F.col("_a")) * (1 + F.col("_b")) - 1).alias("r"))


def shadow_curves(outcomes: DataFrame, bps: float, keys: tuple[str, ...] = ("version",)) -> DataFrame:
    """By version, the value of its matured batches one after the other, rebalanced at a cost and never liquidated.

    outcomes(version, date, symbol, weight, r): r is null while a batch's outcome is pending. A version's curve stops
    before its first batch with such a gap. Weights drift with r to the next batch.
    """
    b = outcomes.groupBy(*keys, "date").agg(F.sum(F.col("weight") * F.col("r")).alias("gross"), F.count_if(F.col("r").isNull()).alias("_gaps"), F.map_from_entries(F.collect_list(F.struct("symbol", "weight"))).alias("_t"), F.map_from_entries(F.collect_list(F.struct("symbol", F.expr("weight * (1 + r)").alias("v")))).alias("_v"))
    w = W.partitionBy(*keys).orderBy("date")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    b = b.withColumn("_bad", F.sum("_gaps").over(run)).filter("_bad = 0").withColumn("_ends", F.transform_values("_v", lambda _, v: v / (1 + F.col("gross"))))
    b = b.withColumn("_prev", F.coalesce(F.lag("_ends").over(w), F.expr("cast(map() as map<string, double>)")))
    names = F.array_sort(F.array_union(F.map_keys("_prev"), F.map_keys("_t")))
    at = lambda m: F.transform(names, lambda s: F.coalesce(F.element_at(F.col(m), s), F.lit(0.0)))
    b = b.withColumn("cost", trading_cost(at("_prev"), at("_t"), bps / 10_000)).withColumn("net", (1 - F.col("cost")) * (1 + F.col("gross")) - 1)
    return b.withColumn("nav", F.product(1 + F.col("net")).over(run)).select(*keys, "date", "gross", "cost", "net", "nav")
