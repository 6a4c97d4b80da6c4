"""Return metrics, attribution, resampling and small linear models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.bars import kept

YEAR = 252


def return_metrics(daily: DataFrame, r: str = "r", keys: tuple[str, ...] = ("symbol",), per_year: int = YEAR) -> DataFrame:
    """A1: n, total return, CAGR, volatility, Sharpe ratio and largest drawdown by key; undefined ratios are null."""
    w = W.partitionBy(*keys).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    d = daily.filter(F.col(r).isNotNull()).withColumn("_nav", F.product(1 + F.col(r)).over(w))
    d = d.withColumn("_dd", F.col("_nav") / F.greatest(F.lit(1.0), F.max("_nav").over(w)) - 1)
    g = d.groupBy(*keys).agg(F.count("*").alias("n"), F.exp(F.sum(F.log1p(r))).alias("_t"), F.avg(r).alias("_m"), F.stddev_samp(r).alias("_s"), F.min("_dd").alias("max_drawdown"))
    return g.select(*keys, "n", (F.col("_t") - 1).alias("total_return"), (F.pow("_t", per_year / F.col("n")) - 1).alias("cagr"), (F.col("_s") * per_year**0.5).alias("volatility"), (F.col("_m") / F.nullif("_s", F.lit(0.0)) * per_year**0.5).alias("sharpe"), "max_drawdown")


def tail_stats(daily: DataFrame, r: str = "r", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """A2: bias-corrected skew, first percentile, mean of the worst 5 % and the worst value."""
    d = daily.filter(F.col(r).isNotNull()).withColumn("_p05", F.percentile(r, 0.05).over(W.partitionBy(*keys)))
    n = F.count("*")
    return d.groupBy(*keys).agg(F.when(n > 2, F.skewness(r) * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"), F.percentile(r, 0.01).alias("p01"), F.min(r).alias("worst"), F.avg(F.when(F.col(r) <= F.col("_p05"), F.col(r))).alias("shortfall"))


def window_outcomes(daily: DataFrame, h: int = 20, r: str = "r", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Of every full window of h rows the compounded return and the largest drawdown inside, from its start on."""
    w = W.partitionBy(*keys).orderBy("date").rowsBetween(-(h - 1), 0)

    def step(a: Column, x: Column) -> Column:
        value = a["value"] * (1 + x)
        peak = F.greatest(a["peak"], value)
        return F.struct(value.alias("value"), peak.alias("peak"), F.least(a["worst"], value / peak - 1).alias("worst"))

    start = F.struct(F.lit(1.0).alias("value"), F.lit(1.0).alias("peak"), F.lit(0.0).alias("worst"))
    d = daily.withColumn("_w", F.collect_list(r).over(w)).withColumn("_a", F.when(F.size("_w") == h, F.aggregate("_w", start, step)))
    return d.withColumns({"outcome": F.col("_a.value") - 1, "drawdown": F.col("_a.worst")}).drop("_w", "_a")


def outcome_stats(outcomes: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """A4: mean, quantiles, bias-corrected skew, worst cases and shares of windows beyond fixed levels."""
    o, n = outcomes.filter("outcome is not null"), F.count("*")
    p = F.percentile("outcome", F.array(F.lit(0.5), F.lit(0.75), F.lit(0.9), F.lit(0.95)))
    share = lambda c: F.avg(c.cast("double"))
    beyond = [share(F.col("outcome") > x / 100).alias(f"share_above_{x}") for x in (5, 10, 20)] + [share(F.col("outcome") < -x / 100).alias(f"share_below_{x}") for x in (5, 10)]
    return o.groupBy(*keys).agg(
        n.alias("n"), F.avg("outcome").alias("mean"), p[0].alias("median"), p[1].alias("p75"), p[2].alias("p90"), p[3].alias("p95"), F.when(n > 2, F.skewness("outcome") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
        F.min("outcome").alias("worst"), F.min("drawdown").alias("worst_drawdown"), share(F.col("outcome") > 0).alias("share_positive"), *beyond, share(F.col("drawdown") < -0.1).alias("share_drawdown_10"),
    )


def breakdown(daily: DataFrame, r: str = "r") -> DataFrame:
    """Compounded return by symbol, by year and by symbol and year, in one pass of grouping sets."""
    d = daily.filter(F.col(r).isNotNull()).withColumn("year", F.year("date"))
    return d.groupingSets([["symbol"], ["year"], ["symbol", "year"]], "symbol", "year").agg(F.count("*").alias("n"), (F.exp(F.sum(F.log1p(r))) - 1).alias("total_return"))


def effective_n(weights: DataFrame, keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """1 / sum of squared weights, the largest weight and the gross exposure."""
    return weights.groupBy(*keys).agg((1 / F.nullif(F.sum(F.col("weight") * F.col("weight")), F.lit(0.0))).alias("effective_n"), F.max("weight").alias("largest"), F.sum(F.abs("weight")).alias("gross"))


def turnover(weights: DataFrame) -> DataFrame:
    """(date, turnover), the sum of |weight - weight of the date before| over the symbols of both dates; no row is no weight."""
    one = W.partitionBy(F.lit(1)).orderBy("date")  # one row a date
    dates = weights.select("date").distinct().select("date", F.lag("date").over(one).alias("_prev"), F.lead("date").over(one).alias("_next"))
    w = W.partitionBy("symbol").orderBy("date")
    x = weights.join(dates.hint("merge"), "date").withColumns({"_before": F.when(F.lag("date").over(w) == F.col("_prev"), F.lag("weight").over(w)), "_stays": F.coalesce(F.lead("date").over(w) == F.col("_next"), F.lit(False))})
    moved = x.select("date", F.abs(F.col("weight") - F.coalesce("_before", F.lit(0.0))).alias("_m"))
    left = x.filter("not _stays and _next is not null").select(F.col("_next").alias("date"), F.abs("weight").alias("_m"))
    return moved.unionByName(left).groupBy("date").agg(F.sum("_m").alias("turnover"))


def log_decomposition(legs: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Sums of log returns overnight and intraday, and the overnight share of the whole."""
    g = legs.filter("close_close is not null").groupBy(*keys).agg(F.sum(F.log1p("overnight")).alias("overnight"), F.sum(F.log1p("intraday")).alias("intraday"), F.sum(F.log1p("close_close")).alias("whole"))
    return g.withColumn("overnight_share", F.when(F.abs("whole") > 1e-12, F.col("overnight") / F.col("whole")))


def leg_summary(legs: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """A13 of adjusted_legs: sums of log returns by side and leg, the overnight shares, the adjustment's effect and the largest residual."""
    sides, names = ("raw", "adjusted"), ("overnight", "intraday", "close_close")
    residuals = [F.abs(F.coalesce(c, F.lit(0.0))) for c in ("raw_residual", "adjusted_residual", "factor_overnight_residual", "factor_close_close_residual", "factor_intraday_residual")]
    g = legs.filter("raw_close_close is not null").groupBy(*keys).agg(*[F.sum(F.log1p(f"{s}_{n}")).alias(f"{s}_{n}") for s in sides for n in names], F.sum("adjustment_log_effect").alias("adjustment_log_effect"), F.max(F.greatest(*residuals)).alias("max_residual"))
    return g.withColumns({f"{s}_overnight_share": F.when(F.abs(f"{s}_close_close") > 1e-12, F.col(f"{s}_overnight") / F.col(f"{s}_close_close")) for s in sides})


def against_comparator(daily: DataFrame, comparator: DataFrame, regimes: DataFrame, r: str = "r", per_year: int = YEAR) -> DataFrame:
    """By symbol and year and by symbol and regime: days, compounded and mean returns, and the comparator's on the same dates.

    comparator(date, r_cmp), regimes(date, regime); dates without either or without r are left out.
    """
    d = daily.filter(F.col(r).isNotNull()).select("symbol", "date", F.col(r).alias("_r")).join(comparator.filter("r_cmp is not null"), "date").join(regimes.filter("regime is not null"), "date").withColumn("year", F.year("date"))
    g = d.groupingSets([["symbol", "year"], ["symbol", "regime"]], "symbol", "year", "regime").agg(F.count("*").alias("n"), (F.exp(F.sum(F.log1p("_r"))) - 1).alias("total_return"), (F.exp(F.sum(F.log1p("r_cmp"))) - 1).alias("comparator_return"), (F.avg("_r") * per_year).alias("annual_mean"), (F.avg(F.col("_r") - F.col("r_cmp")) * per_year).alias("annual_excess"))
    return g.withColumn("difference", F.col("total_return") - F.col("comparator_return"))


def account_metrics(daily: DataFrame, keys: tuple[str, ...] = (), per_year: int = YEAR) -> DataFrame:
    """A3: mean exposure and annual turnover of an account's days."""
    return daily.groupBy(*keys).agg(F.avg("open_exposure").alias("exposure"), (F.avg("turnover") * per_year).alias("annual_turnover"))


def holding_period(lots: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """A3: mean holding sessions of lots, weighted by units, and the net lot returns' mean."""
    return lots.groupBy(*keys).agg((F.sum(F.col("holding_sessions") * F.col("units")) / F.nullif(F.sum("units"), F.lit(0.0))).alias("average_holding_period"), F.avg("net_return").alias("mean_return"), F.sum("net_pnl").alias("net_pnl"))


def ic_summary(ic: DataFrame, keys: tuple[str, ...] = ("year",)) -> DataFrame:
    """A10"""
    p = F.percentile("ic", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return ic.filter("ic is not null").groupBy(*keys).agg(F.count("*").alias("n"), F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("std"), p[0].alias("q05"), p[1].alias("median"), p[2].alias("q95"), F.avg((F.col("ic") > 1e-12).cast("double")).alias("share_positive"))


def pair_correlation(returns: DataFrame) -> DataFrame:
    """Correlation of every pair of symbols over their common dates (an equi-join by date)."""
    a, b = returns.select("date", F.col("symbol").alias("a"), F.col("r").alias("x")), returns.select("date", F.col("symbol").alias("b"), F.col("r").alias("y"))
    j = a.join(b, "date").filter("a < b and x is not null and y is not null")
    return j.groupBy("a", "b").agg((F.covar_samp("x", "y") / F.nullif(F.stddev_samp("x") * F.stddev_samp("y"), F.lit(0.0))).alias("correlation"), F.count("*").alias("n"))


def worst_days(daily: DataFrame, n: int = 10, r: str = "r", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """T1"""
    w = W.partitionBy(*keys).orderBy(r, "date")
    return daily.filter(F.col(r).isNotNull()).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def gram(rows: DataFrame, features: tuple[str, ...], label: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """M5: (i, j, value) of X'X / n and, as j = 'y', X'y / n: one aggregation over all rows, p (p + 3) / 2 means."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]] + [(a, label) for a in features]
    full = rows.dropna(subset=[*features, label])
    g = full.groupBy(*keys).agg(*[F.avg(F.col(a) * F.col(b)).alias(f"{a}__{b}") for a, b in pairs], F.count("*").alias("n"))
    parts = ", ".join(f"'{a}', '{'y' if b == label else b}', `{a}__{b}`" for a, b in pairs)
    return g.select(*keys, "n", F.expr(f"stack({len(pairs)}, {parts}) as (i, j, value)"))


def ridge(rows: DataFrame, features: tuple[str, ...], label: str, penalty: float) -> list[float]:
    """M2: ridge coefficients without intercept; Spark forms the Gram matrix, the driver solves the p by p system."""
    import numpy as np

    p, at = len(features), {f: i for i, f in enumerate(features)}
    m, v = np.zeros((p, p)), np.zeros(p)
    for i, j, value in gram(rows, features, label).select("i", "j", "value").collect():  # p (p + 3) / 2 rows
        if j == "y":
            v[at[i]] = value
        else:
            m[at[i], at[j]] = m[at[j], at[i]] = value
    return np.linalg.solve(m + penalty * np.eye(p), v).tolist()


def ridge_fits(rows: DataFrame, features: tuple[str, ...], label: str, penalty: float, fits: dict[str, Column], least_rows: int = 500) -> DataFrame:
    """M2: (fit, feature, coefficient) of ridge models without intercept on the rows of each condition, such as the whole and its halves.

    One aggregation forms all Gram matrices. Raises ValueError where a fit has fewer than least_rows rows.
    """
    import numpy as np

    each = rows.withColumn("fit", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in fits.items()]))))
    at, p = {f: i for i, f in enumerate(features)}, len(features)
    grams: dict = {n: (np.zeros((p, p)), np.zeros(p), 0) for n in fits}
    for r in gram(each, features, label, ("fit",)).collect():  # p (p + 3) / 2 rows a fit
        m, v, _ = grams[r["fit"]]
        if r["j"] == "y":
            v[at[r["i"]]] = r["value"]
        else:
            m[at[r["i"]], at[r["j"]]] = m[at[r["j"]], at[r["i"]]] = r["value"]
        grams[r["fit"]] = (m, v, r["n"])
    out = []
    for n, (m, v, rows_) in grams.items():
        if rows_ < least_rows:
            raise ValueError(f"fit {n} has fewer than {least_rows} training rows")
        out += [(n, f, float(c)) for f, c in zip(features, np.linalg.solve(m + penalty * np.eye(p), v))]
    return rows.sparkSession.createDataFrame(out, "fit string, feature string, coefficient double")


def linear_score(features: tuple[str, ...], coefficients: list[float]) -> Column:
    """M6: dot product of feature columns and frozen coefficients; null if a feature is."""
    total = F.lit(0.0)
    for f, c in zip(features, coefficients):
        total = total + F.col(f) * F.lit(float(c))
    return total


def block_bootstrap(daily: DataFrame, samples: int = 1000, block: int = 20, seed: int = 5, r: str = "r", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Mean and a 95 % interval of it by a circular block bootstrap.

    Every row is a date of its series, also where r is null or NaN: blocks span dates, and a sample's mean is over the values
    present in it. A block's sums are differences of prefix sums of values and of presence on the series wrapped once; starts
    are drawn by a hash of (seed, sample, block), so matched series share them and reruns agree. The last block is cut to keep
    n dates a sample. An infinite value is an error.
    """
    v = F.when(F.abs(r) == float("inf"), F.raise_error(F.lit("infinite return"))).when(~F.isnan(r), F.col(r))
    w = W.partitionBy(*keys).orderBy("date")
    d = kept(daily.select(*keys, "date", v.cast("double").alias("_v")).withColumns({"i": F.row_number().over(w) - 1, "n": F.count("*").over(W.partitionBy(*keys))}), "bootstrap-series")
    twice = d.select(*keys, "n", "_v", F.explode(F.array(F.col("i"), F.col("i") + F.col("n"))).alias("i"))
    run = W.partitionBy(*keys).orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    prefix = twice.select(*keys, "i", F.struct(F.coalesce(F.sum("_v").over(run), F.lit(0.0)).alias("v"), F.count("_v").over(run).alias("n")).alias("upto"))
    sizes = d.select(*keys, "n").distinct()
    draws = sizes.withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(samples)))).withColumn("b", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / block).cast("int"))))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("s").cast("string"), F.col("b").cast("string"))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    draws = draws.withColumns({"start": F.floor(u * F.col("n")).cast("int"), "len": F.least(F.lit(block), F.col("n") - F.col("b") * block)})
    ends = draws.withColumn("last", F.col("start") + F.col("len") - 1).join(prefix.withColumnsRenamed({"i": "last", "upto": "hi"}).hint("merge"), [*keys, "last"])
    both = ends.withColumn("first", F.col("start") - 1).join(prefix.withColumnsRenamed({"i": "first", "upto": "lo"}).hint("merge"), [*keys, "first"], "left")
    total, present = F.sum(F.col("hi.v") - F.coalesce("lo.v", F.lit(0.0))), F.sum(F.col("hi.n") - F.coalesce("lo.n", F.lit(0)))
    means = both.groupBy(*keys, "s").agg(F.try_divide(total, present).alias("m"))
    q = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))  # of as many values a key as there are samples
    ci = means.groupBy(*keys).agg(q[0].alias("low"), q[1].alias("high"))
    return d.groupBy(*keys).agg(F.avg("_v").alias("mean")).hint("merge").join(ci.hint("merge"), list(keys))


def rigor_metrics(daily: DataFrame, r: str = "r", keys: tuple[str, ...] = ("symbol",), per_year: int = YEAR) -> DataFrame:
    """A3: Sortino and Calmar ratios, beta to r_mkt, mean of the worst 5 %, shares of positive months and years.

    One shuffle on the keys serves all windows and the aggregate: daily is read once.
    """
    whole = W.partitionBy(*keys)
    run = whole.orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    d = daily.filter(F.col(r).isNotNull()).withColumns({"_nav": F.product(1 + F.col(r)).over(run), "_p05": F.percentile(r, 0.05).over(whole)})
    d = d.withColumn("_dd", F.col("_nav") / F.greatest(F.lit(1.0), F.max("_nav").over(run)) - 1)
    for unit in ("month", "year"):  # a unit's growth, on one of its rows
        w = W.partitionBy(*keys, F.date_trunc(unit, "date"))
        d = d.withColumn(f"_{unit}", F.when(F.row_number().over(w.orderBy("date")) == 1, (F.sum(F.log1p(r)).over(w) > 0).cast("double")))
    down = F.sqrt(F.avg(F.pow(F.least(F.col(r), F.lit(0.0)), F.lit(2.0))) * per_year)
    cagr = F.pow(F.exp(F.sum(F.log1p(r))), per_year / F.count("*")) - 1
    return d.groupBy(*keys).agg(
        (F.avg(r) * per_year / F.nullif(down, F.lit(0.0))).alias("sortino"), (F.covar_samp(r, "r_mkt") / F.nullif(F.var_samp("r_mkt"), F.lit(0.0))).alias("beta"), (cagr / F.nullif(-F.min("_dd"), F.lit(0.0))).alias("calmar"),
        F.avg(F.when(F.col(r) <= F.col("_p05"), F.col(r))).alias("tail_loss"), F.avg("_month").alias("monthly_consistency"), F.avg("_year").alias("annual_consistency"),
    )


def lot_metrics(lots: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """A3: hit rate, mean winner and loser as returns, and profit factor of closed lots(pnl, buy_price, sell_price)."""
    ret, win, lose = F.col("sell_price") / F.col("buy_price") - 1, F.col("pnl") > 0, F.col("pnl") < 0
    return lots.groupBy(*keys).agg(F.avg(win.cast("double")).alias("hit_rate"), F.avg(F.when(win, ret)).alias("average_winner"), F.avg(F.when(lose, ret)).alias("average_loser"), (F.sum(F.when(win, F.col("pnl"))) / F.nullif(-F.sum(F.when(lose, F.col("pnl"))), F.lit(0.0))).alias("profit_factor"))


def attribution(contributions: DataFrame, fees: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Gross, fees and net by key; keys of one side only count 0 on the other."""
    a = contributions.groupBy(*keys).agg(F.sum("pnl").alias("gross"))
    b = fees.groupBy(*keys).agg(F.sum("fee").alias("fees"))
    j = a.join(b, list(keys), "full").select(*keys, F.coalesce("gross", F.lit(0.0)).alias("gross"), F.coalesce("fees", F.lit(0.0)).alias("fees"))
    return j.withColumn("net", F.col("gross") - F.col("fees"))


def group_exposure(weights: DataFrame, groups: DataFrame) -> DataFrame:
    """By date, the group with the largest weight (ties to the larger name) and that weight; groups(symbol, grp)."""
    g = weights.join(groups, "symbol").groupBy("date", "grp").agg(F.sum("weight").alias("weight"))
    return g.groupBy("date").agg(F.max("weight").alias("weight"), F.max_by("grp", F.struct("weight", "grp")).alias("grp"))


def leave_one_out(excess: DataFrame, keys: tuple[str, ...] = ("symbol",), r: str = "r", per_year: int = YEAR) -> DataFrame:
    """Mean yearly excess over all years, and without the best and the worst one (ties to the earlier year).

    From sums, extremes and counts of the yearly means: no second pass.
    """
    y = excess.filter(F.col(r).isNotNull()).groupBy(*keys, F.year("date").alias("year")).agg((F.avg(r) * per_year).alias("_y"))
    n = F.count("*")
    rest = lambda x: F.when(n > 1, (F.sum("_y") - x) / (n - 1))
    return y.groupBy(*keys).agg(F.avg("_y").alias("mean"), F.max_by("year", F.struct("_y", -F.col("year"))).alias("best_year"), rest(F.max("_y")).alias("without_best"), rest(F.min("_y")).alias("without_worst"), F.count_if(F.col("_y") > 0).alias("positive_years"))


def without_each_group(panel: DataFrame, groups: DataFrame, r: str = "r") -> DataFrame:
    """by (grp, date), the equal-weight return of all names outside the group.

    From the date's totals less the group's: one aggregate, no copy of the panel for each group.
    """
    p = panel.filter(F.col(r).isNotNull()).join(groups, "symbol")
    g = p.groupBy("date", "grp").agg(F.sum(r).alias("_s"), F.count("*").alias("_n"))
    w = W.partitionBy("date")
    g = g.withColumns({"_ts": F.sum("_s").over(w), "_tn": F.sum("_n").over(w)})
    return g.select("grp", "date", ((F.col("_ts") - F.col("_s")) / F.nullif((F.col("_tn") - F.col("_n")).cast("double"), F.lit(0.0))).alias("r"))


def select_winner(metrics: DataFrame, metric: str, name: str, keys: tuple[str, ...]) -> DataFrame:
    """The best row of each key by metric, ties to the smaller name; null metrics take no part."""
    w = W.partitionBy(*keys).orderBy(F.desc(metric), name)
    return metrics.filter(F.col(metric).isNotNull()).withColumn("_p", F.row_number().over(w)).filter("_p = 1").drop("_p")


def ranked_summary(metrics: DataFrame, metric: str, name: str, keys: tuple[str, ...]) -> DataFrame:
    """Every row with its place by metric within its key."""
    return metrics.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc_nulls_last(metric), name)))
