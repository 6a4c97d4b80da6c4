"""Per-symbol windows over (symbol, date). A window of n rows is null until it holds n values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def finite(c: Column) -> Column:
    """The value, null where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def ws():
    return W.partitionBy("symbol").orderBy("date")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def over(n: int):
    return ws().rowsBetween(-(n - 1), 0)


def full(value: Column, c: str | Column, n: int) -> Column:
    """value where the last n rows all have c."""
    return F.when(F.count(col(c)).over(over(n)) == n, value)


def change(c: str | Column, k: int = 1) -> Column:
    """Simple return over k rows."""
    return col(c) / F.lag(col(c), k).over(ws()) - 1


def mean(c: str | Column, n: int) -> Column:
    """W3"""
    return full(F.avg(col(c)).over(over(n)), c, n)


def std(c: str | Column, n: int, ddof: int = 1) -> Column:
    """W4"""
    return full((F.stddev_samp if ddof else F.stddev_pop)(col(c)).over(over(n)), c, n)


def high(c: str | Column, n: int) -> Column:
    return full(F.max(col(c)).over(over(n)), c, n)


def low(c: str | Column, n: int) -> Column:
    return full(F.min(col(c)).over(over(n)), c, n)


def gap(bars: DataFrame) -> DataFrame:
    """Opening gap and its 20-row mean."""
    g = bars.withColumn("gap", F.col("open") / F.lag("close").over(ws()) - 1)
    return g.withColumn("gap_20", mean("gap", 20))


def with_benchmark(panel: DataFrame, bench: DataFrame) -> DataFrame:
    """Equi-join by date; the benchmark has one row a date."""
    return panel.join(bench, "date")


def beta(panel: DataFrame, n: int = 60) -> DataFrame:
    """Rolling beta of r on r_mkt, the residual return and its sum over 63 rows."""
    both = F.when(F.col("r").isNotNull() & F.col("r_mkt").isNotNull(), F.lit(1))
    ok = F.count(both).over(over(n)) == n
    b = F.covar_samp("r", "r_mkt").over(over(n)) / F.nullif(F.var_samp("r_mkt").over(over(n)), F.lit(0.0))
    out = panel.withColumn("beta", F.when(ok, b)).withColumn("residual", F.col("r") - F.col("beta") * F.col("r_mkt"))
    return out.withColumn("residual_63", full(F.sum("residual").over(over(63)), "residual", 63))


def percentile_rank(c: str, n: int = 126) -> Column:
    """Share of the window below the current value, ties counted by their average rank."""
    w = F.collect_list(c).over(over(n))
    below = F.size(F.filter(w, lambda x: x < F.col(c)))
    same = F.size(F.filter(w, lambda x: x == F.col(c)))
    return full((below + (same + 1) / 2) / n, c, n)


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    """Centre, deviation, bands, place in the band and its width."""
    b = bars.withColumns({"centre": mean("close", n), "sigma": std("close", n, 0)})
    b = b.withColumns({"upper": F.col("centre") + k * F.col("sigma"), "lower": F.col("centre") - k * F.col("sigma")})
    return b.withColumns({"pct_b": (F.col("close") - F.col("lower")) / F.nullif(F.col("upper") - F.col("lower"), F.lit(0.0)), "bandwidth": (F.col("upper") - F.col("lower")) / F.col("centre")})


def band_distances(bands: DataFrame, n: int = 126) -> DataFrame:
    """Of bollinger's columns, the width's percentile and change both ways, and the close's distances in deviations."""
    s = F.nullif("sigma", F.lit(0.0))
    b = bands.withColumns({"bandwidth_percentile": percentile_rank("bandwidth", n), "expansion": F.col("bandwidth") - F.lag("bandwidth").over(ws())}).withColumn("contraction", -F.col("expansion"))
    return b.withColumns({f"distance_{c}": (F.col("close") - F.col(c)) / s for c in ("centre", "upper", "lower")})


def ichimoku(bars: DataFrame, a: int = 9, b: int = 26, c: int = 52) -> DataFrame:
    """Conversion, base and both spans at their own date, and the cloud."""
    mid = lambda n: (high("high", n) + low("low", n)) / 2
    o = bars.withColumns({"tenkan": mid(a), "kijun": mid(b), "span_b": mid(c)}).withColumn("span_a", (F.col("tenkan") + F.col("kijun")) / 2)
    ready = F.col("span_a").isNotNull() & F.col("span_b").isNotNull()
    return o.withColumns({"cloud_top": F.when(ready, F.greatest("span_a", "span_b")), "cloud_bottom": F.when(ready, F.least("span_a", "span_b"))})


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """Mean true range; the first row has no previous close and no true range."""
    prev = F.lag("close").over(ws())
    tr = F.when(prev.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)))
    t = bars.withColumn("true_range", tr)
    return t.withColumn("atr", mean("true_range", n))


def cloud_state(bars: DataFrame, cloud: tuple[int, int, int] = (9, 26, 52), n: int = 126) -> DataFrame:
    """ichimoku's columns and atr, and from them distances, thickness and slope in true ranges, the thickness's percentile,
    how long the close has been above the cloud, and its change over the base's span. All at their own date."""
    c = atr(ichimoku(bars, *cloud))
    a, middle = F.nullif("atr", F.lit(0.0)), (F.col("span_a") + F.col("span_b")) / 2
    c = c.withColumns({"_above": F.when(F.col("cloud_top").isNotNull(), F.col("close") > F.col("cloud_top")), "cloud_thickness": (F.col("cloud_top") - F.col("cloud_bottom")) / a, "tenkan_kijun": F.col("tenkan") - F.col("kijun")})
    return c.withColumns(
        {
            "cloud_distance": (F.col("close") - F.col("cloud_top")) / a, "cloud_thickness_percentile": percentile_rank("cloud_thickness", n), "cloud_slope": (middle - F.lag(middle, 5).over(ws())) / a,
            "tenkan_kijun_atr": F.col("tenkan_kijun") / a, "trend_persistence": persistence("_above", 20), "breakout_persistence": persistence("_above", 5), "chikou_comparison": change("close", cloud[1]),
        }
    ).drop("_above")


def persistence(flag: str, n: int) -> Column:
    """Share of the last n rows where flag holds."""
    return full(F.avg(F.col(flag).cast("double")).over(over(n)), flag, n)


def session_legs(bars: DataFrame) -> DataFrame:
    """Overnight, intraday and close-to-close returns, and how far the two legs are from the third."""
    prev = F.lag("close").over(ws())
    s = bars.withColumns({"overnight": F.col("open") / prev - 1, "intraday": F.col("close") / F.col("open") - 1, "close_close": F.col("close") / prev - 1})
    return s.withColumn("leg_error", (1 + F.col("overnight")) * (1 + F.col("intraday")) - 1 - F.col("close_close"))


def adjusted_legs(bars: DataFrame) -> DataFrame:
    """Raw and adjusted legs, how far each pair is from its whole, and what the adjustment factor leaves unexplained.

    The first bar of a symbol has no leg from a close before.
    """
    last = lambda c: F.lag(c).over(ws())
    s = bars.withColumn("factor", F.col("adj_close") / F.col("close"))
    s = s.withColumns({"_ratio": F.col("factor") / last("factor"), "_raw": last("close"), "_adj": last("adj_close")})
    for side, o, c, before in (("raw", "open", "close", "_raw"), ("adjusted", "adj_open", "adj_close", "_adj")):
        s = s.withColumns({f"{side}_overnight": F.col(o) / F.col(before) - 1, f"{side}_intraday": F.col(c) / F.col(o) - 1, f"{side}_close_close": F.col(c) / F.col(before) - 1})
        s = s.withColumn(f"{side}_residual", (1 + F.col(f"{side}_overnight")) * (1 + F.col(f"{side}_intraday")) - 1 - F.col(f"{side}_close_close"))
    s = s.withColumns({f"factor_{leg}_residual": 1 + F.col(f"adjusted_{leg}") - (1 + F.col(f"raw_{leg}")) * F.col("_ratio") for leg in ("overnight", "close_close")})
    return s.withColumns({"factor_intraday_residual": F.col("adjusted_intraday") - F.col("raw_intraday"), "adjustment_log_effect": F.log("_ratio")}).drop("_ratio", "_raw", "_adj")


def forward_label(h: int = 5, price: str = "open") -> Column:
    """Return from the next row's price to the one h rows later."""
    return F.lead(price, h + 1).over(ws()) / F.lead(price, 1).over(ws()) - 1


def wealth(r: str = "r", keys: tuple[str, ...] = ("symbol",), order: str = "date") -> Column:
    """Running product of 1 + r."""
    return F.product(1 + F.col(r)).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0))


def drawdown(nav: str = "nav", keys: tuple[str, ...] = ("symbol",), order: str = "date") -> Column:
    """Wealth over its highest so far, the initial 1 included, less 1."""
    top = F.max(nav).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return F.col(nav) / F.greatest(F.lit(1.0), top) - 1


def smoothed_by_blocks(rows: DataFrame, values: tuple[str, ...], keys: tuple[str, ...], position: str, decay: float) -> DataFrame:
    """rows with each value v as y, where y = decay * y of the position before + v, positions counted from 0 by keys.

    A segmented affine scan in windows: blocks are so long that a value fades to 1e-12 of itself over one. Inside a block y
    is a running sum of values scaled by powers of the decay, so that no sum has terms of different signs for values of one
    sign; what comes into a block is composed from the three blocks before it, past which nothing is left in a double.
    """
    size = max(2, math.ceil(-12 * math.log(10) / math.log(decay)))
    block, off = F.floor(F.col(position) / size).cast("int"), (F.col(position) % size).cast("int")
    run = W.partitionBy(*keys, "_block").orderBy(position)
    r = rows.withColumns({"_block": block, "_off": off})
    r = r.withColumns({f"_s_{v}": F.sum(F.col(v) * F.pow(F.lit(decay), -F.col("_off"))).over(run) for v in values})
    ends = r.groupBy(*keys, "_block").agg(*[(F.max_by(f"_s_{v}", "_off") * decay ** (size - 1)).alias(f"_e_{v}") for v in values])
    along = W.partitionBy(*keys).orderBy("_block")  # a row a block
    carried = lambda v: sum((F.coalesce(F.lag(f"_e_{v}", k).over(along), F.lit(0.0)) * decay ** (size * (k - 1)) for k in (2, 3)), F.coalesce(F.lag(f"_e_{v}", 1).over(along), F.lit(0.0)))
    ends = ends.select(*keys, "_block", *[carried(v).alias(f"_c_{v}") for v in values])
    r = r.join(ends.hint("merge"), [*keys, "_block"])
    y = {v: F.col(f"_s_{v}") * F.pow(F.lit(decay), F.col("_off")) + F.col(f"_c_{v}") * F.pow(F.lit(decay), F.col("_off") + 1) for v in values}
    return r.withColumns(y).drop("_block", "_off", *[f"_{x}_{v}" for x in "sc" for v in values])


def wilder_rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """(symbol, date, rsi). The first n changes give means, later ones are smoothed by 1 / n; 100 without losses, 50 without changes.

    A missing or infinite close ends the run: its own change and the next are null, have no RSI, and the means start again
    after them. All steps are windows and one join by symbol and run.
    """
    change = finite(F.col("close") - F.lag("close").over(ws()))
    d = bars.select("symbol", "date", "close").withColumn("_d", change)
    d = d.withColumn("_run", F.sum(F.col("_d").isNull().cast("int")).over(ws().rowsBetween(W.unboundedPreceding, 0)))
    w = W.partitionBy("symbol", "_run").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("_k", F.count("_d").over(w) - n)  # 0 where the first n changes are complete
    sides = {"_up": F.when(F.col("_d") > 0, F.col("_d")).when(F.col("_d") <= 0, 0.0), "_down": F.when(F.col("_d") < 0, -F.col("_d")).when(F.col("_d") >= 0, 0.0)}
    first = {c: F.when(F.col("_k") == 0, F.avg(x).over(w)).otherwise(x / n) for c, x in sides.items()}
    ready = d.withColumns(first).filter(F.col("_d").isNotNull() & (F.col("_k") >= 0)).select("symbol", "date", "_run", "_k", "_up", "_down")
    y = smoothed_by_blocks(ready, ("_up", "_down"), ("symbol", "_run"), "_k", 1 - 1 / n) if n > 1 else ready
    rsi = F.when((F.col("_up") == 0) & (F.col("_down") == 0), 50.0).when(F.col("_down") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("_up") / F.nullif("_down", F.lit(0.0))))
    y = y.select("symbol", "date", rsi.alias("rsi"))
    return bars.select("symbol", "date").join(y.hint("merge"), ["symbol", "date"], "left")
