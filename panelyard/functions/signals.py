"""Feature panels, rule scores and control scores over (symbol, date) bars.

Windows by symbol share one sort and windows by date one shuffle; nothing is pivoted, so symbols may grow without bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import cross as X
from . import series as S

BASE = ("momentum", "acceleration", "reversal", "residual_momentum", "breakout", "volume_momentum", "volatility", "volume_anomaly", "gap_continuation")
RANKED = (*BASE, "gap_20", "vol_ratio")
#: Order of the model's inputs.
INPUTS = (*RANKED, "momentum_reversal", "breakout_volume", "momentum_lowvol", "market_trend", "trend_reversal")


def adjusted_ohlc(bars: DataFrame) -> DataFrame:
    """Open, high and low on the scale of the adjusted close."""
    f = F.col("adj_close") / F.col("close")
    return bars.withColumns({"adj_open": F.col("open") * f, "adj_high": F.col("high") * f, "adj_low": F.col("low") * f})


def market_state(bench: DataFrame, trend_n: int = 200, vol_n: int = 20) -> DataFrame:
    """(date, r_mkt, market_trend, market_vol) of one benchmark; its first return counts as 0 in the wealth.

    The benchmark has one row a date, so its window needs no key.
    """
    w = W.partitionBy(F.lit(1)).orderBy("date")
    last = lambda n: w.rowsBetween(-(n - 1), 0)
    m = bench.select("date", (F.col("adj_close") / F.lag("adj_close").over(w) - 1).alias("r_mkt"))
    m = m.withColumn("_v", F.product(1 + F.coalesce("r_mkt", F.lit(0.0))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    trend = F.when(F.count("_v").over(last(trend_n)) == trend_n, F.col("_v") / F.avg("_v").over(last(trend_n)) - 1)
    vol = F.when(F.count("r_mkt").over(last(vol_n)) == vol_n, F.stddev_samp("r_mkt").over(last(vol_n)))
    return m.select("date", "r_mkt", trend.alias("market_trend"), vol.alias("market_vol"))


def high_volatility(state: DataFrame, n: int = 252) -> DataFrame:
    """yesterday's volatility above the median of its last n values; null until there are n."""
    w = W.partitionBy(F.lit(1)).orderBy("date")
    v = state.withColumn("_v", F.lag("market_vol").over(w))
    last = w.rowsBetween(-(n - 1), 0)
    return v.select("date", F.when(F.count("_v").over(last) == n, F.col("_v") > F.percentile("_v", 0.5).over(last)).alias("high_vol"))


def feature_panel(bars: DataFrame, bench: DataFrame, min_dollar_volume: float, seasoned: int = 200) -> DataFrame:
    """The base features and eligibility in one sort by symbol; the benchmark joins by date before it."""
    s, adj = S.ws(), adjusted_ohlc(bars)
    p = adj.join(market_state(bench), "date")
    p = p.withColumns({"r": S.change("adj_close"), "r21": S.change("adj_close", 21), "r63": S.change("adj_close", 63), "gap": F.col("adj_open") / F.lag("adj_close").over(s) - 1})
    p = S.beta(p).withColumns({"volatility": S.std("r", 60), "_v10": S.std("r", 10), "gap_20": S.mean("gap", 20), "adv": S.mean(F.col("close") * F.col("volume"), 20)})
    p = p.withColumn("volume_anomaly", F.log(F.least(F.lit(10.0), F.greatest(F.lit(0.1), S.mean("volume", 5) / F.nullif(S.mean("volume", 60), F.lit(0.0))))))
    ready = F.col("volume_anomaly").isNotNull() & S.mean("volume", 60).isNotNull()
    place = (F.col("adj_close") - F.col("adj_low")) / F.nullif(F.col("adj_high") - F.col("adj_low"), F.lit(0.0))
    ratio = F.col("_v10") / F.nullif("volatility", F.lit(0.0))
    p = p.withColumn("volume_anomaly", F.when(ready, F.col("volume_anomaly")))
    return p.withColumns(
        {
            "momentum": F.lag("adj_close", 5).over(s) / F.lag("adj_close", 63).over(s) - 1,
            "acceleration": F.col("r21") - F.col("r63") / 3,
            "breakout": F.col("adj_close") / S.high("adj_high", 63) - 1,
            "volume_momentum": F.col("r21") * F.col("volume_anomaly"),
            "reversal": -S.change("adj_close", 5),
            "gap_continuation": F.col("gap") * (2 * place - 1),
            "residual_momentum": F.col("residual_63"),
            "vol_ratio": ratio,
            "vol_contraction": F.when(F.col("r63") > 0, -ratio),
            "eligible": F.coalesce((F.col("adv") >= min_dollar_volume) & F.lag("adj_close", seasoned).over(s).isNotNull(), F.lit(False)),
        }
    ).drop("_v10")


def model_features(features: DataFrame, min_price: float = 5.0) -> DataFrame:
    """Ranks of eligible names mapped to (-1, 1], 0 where missing; products of ranks; the clipped trend.

    All ranks are windows by date, so they share one shuffle.
    """
    p = features.withColumn("eligible", F.col("eligible") & (F.col("close") >= min_price))
    shown = {c: F.when(F.col("eligible"), F.col(c)) for c in RANKED}
    pct = {c: F.coalesce((X.average_rank(v) / F.count(v).over(X.wd()) - 0.5) * 2, F.lit(0.0)) for c, v in shown.items()}
    p = p.withColumns(pct).withColumn("market_trend", F.coalesce(F.least(F.lit(0.5), F.greatest(F.lit(-0.5), F.col("market_trend"))), F.lit(0.0)))
    return p.withColumns(
        {
            "momentum_reversal": F.col("momentum") * F.col("reversal"),
            "breakout_volume": F.col("breakout") * F.col("volume_anomaly"),
            "momentum_lowvol": -F.col("momentum") * F.col("volatility"),
            "trend_reversal": F.col("market_trend") * F.col("reversal"),
        }
    ).select("symbol", "date", "eligible", *INPUTS)


def make_signals(bars: DataFrame, momentum_n: int = 63, reversal_n: int = 5, vol_n: int = 20) -> DataFrame:
    """The simple signals of dates on which every symbol is ready."""
    p = bars.withColumns({"r": S.change("close"), "momentum": S.change("close", momentum_n), "reversal": -S.change("close", reversal_n)})
    p = p.withColumn("_res", X.demeaned("r"))
    p = p.withColumns({"low_vol": -S.std("r", vol_n), "_rv": S.std("_res", vol_n)})
    ready = F.coalesce(F.col("momentum").isNotNull() & F.col("reversal").isNotNull() & (F.col("_rv") > 0), F.lit(False))
    p = p.withColumn("_ready", F.min(ready).over(X.wd())).filter("_ready")
    p = X.centred_rank(X.centred_rank(p, "momentum", "_mom"), "reversal", "_rev")
    top = lambda c: F.greatest(F.col(c), F.lit(0.0))
    return p.select(
        "symbol", "date", F.lit(0.0).alias("equal_weight"), "momentum", "reversal", "low_vol", ((F.col("_mom") + F.col("_rev")) / 2).alias("mom_rev_blend"),
        (top("_mom") * top("_rev")).alias("trend_pullback"), (X.demeaned("reversal") / (F.col("_rv") * reversal_n**0.5)).alias("vol_scaled_reversal"),
    )


def rsi_derivatives(rsi: DataFrame, n: int = 126) -> DataFrame:
    """Percentile, change, slope, acceleration, rank by date and distances of an RSI panel (symbol, date, rsi)."""
    s = S.ws()
    p = rsi.withColumns({"change": F.col("rsi") - F.lag("rsi").over(s), "slope": (F.col("rsi") - F.lag("rsi", 5).over(s)) / 5, "percentile": S.percentile_rank("rsi", n)})
    p = p.withColumn("acceleration", F.col("change") - F.lag("change").over(s))
    p = p.withColumn("rank", X.average_rank("rsi") / F.count("rsi").over(X.wd()))
    return p.withColumns({f"distance_{k}": F.col("rsi") - k for k in (30, 50, 70)})


def technical(bars: DataFrame, rsi_n: int = 14, band_n: int = 20, sigmas: float = 2.0, cloud: tuple[int, int, int] = (9, 26, 52), pct_n: int = 126, trend_n: int = 200) -> DataFrame:
    """RSI, bands, cloud and trend under the same names for any parameters."""
    b = S.atr(S.ichimoku(S.bollinger(bars, band_n, sigmas), *cloud))
    b = b.withColumns({"expansion": F.col("bandwidth") - F.lag("bandwidth").over(S.ws()), "bandwidth_pct": S.percentile_rank("bandwidth", pct_n), "cloud_distance": (F.col("close") - F.col("cloud_top")) / F.nullif("atr", F.lit(0.0)), "trend": F.col("close") / S.mean("close", trend_n) - 1})
    return b.join(S.wilder_rsi(bars, rsi_n).hint("merge"), ["symbol", "date"])


def rule_scores(t: DataFrame) -> DataFrame:
    """P5: rule scores of a technical panel; null means that the rule does not hold."""
    t = t.withColumn("_narrow", F.lag("bandwidth_pct").over(S.ws()) < 0.2)
    up = (F.col("close") > F.col("cloud_top")) & (F.col("tenkan") > F.col("kijun"))
    b, r = F.col("pct_b"), F.col("rsi")
    rules = {
        "rsi_reversal": -r, "rsi_trend": F.when((F.col("trend") > 0) & (r < 50), -r), "rsi_continuation": F.when(r > 70, r),
        "bb_reversal": -b, "bb_trend_reversal": F.when(F.col("trend") > 0, -b), "bb_breakout": F.when(b > 1, b),
        "bb_squeeze": F.when(F.col("_narrow") & (F.col("expansion") > 0) & (b > 1), b), "ichimoku": F.when(up, F.col("cloud_distance")),
        "ichimoku_rsi": F.when(up & (r < 50), -r), "bb_ichimoku": F.when(up & (b > 1), b),
    }
    return t.select("symbol", "date", *[c.alias(n) for n, c in rules.items()])


def feature_scores(features: DataFrame, min_price: float = 5.0) -> DataFrame:
    """P5: the quality rule and the two hypotheses of eligible names, from W10's ranks; the pullback holds only where momentum is positive."""
    x = model_features(features, min_price).filter("eligible")
    raw = features.select("symbol", "date", F.col("momentum").alias("_raw"))
    x = x.join(raw.hint("merge"), ["symbol", "date"])
    quality = F.col("momentum") + F.col("residual_momentum") + F.col("breakout") - 0.5 * F.col("volatility") + 0.25 * F.col("reversal")
    return x.select("symbol", "date", quality.alias("quality_rule"), F.when(F.col("_raw") > 0, F.col("momentum") + F.col("reversal")).alias("momentum_quality_pullback"), (F.col("momentum") - F.col("volatility")).alias("momentum_low_vol"))


def guarded_scores(t: DataFrame, scores: DataFrame, market: DataFrame) -> DataFrame:
    """P5: scores that a state of the symbol or of the market can forbid; null where it does or is unknown.

    t: a technical panel; scores(symbol, date, score): a model's; market(date, market_trend): one row a date.
    """
    up = (F.col("close") > F.col("cloud_top")) & (F.col("tenkan") > F.col("kijun"))
    x = t.hint("merge").join(scores.select("symbol", "date", "score").hint("merge"), ["symbol", "date"], "left").join(market.select("date", "market_trend").hint("merge"), "date", "left")
    allowed = {"ridge_rsi_veto": F.col("rsi") < 70, "ridge_bb_veto": F.col("bandwidth_pct") < 0.8, "ridge_ichimoku_veto": up}
    return x.select("symbol", "date", F.when(up & (F.col("market_trend") > 0), F.col("cloud_distance")).alias("ichimoku_market"), *[F.when(c, F.col("score")).alias(n) for n, c in allowed.items()])


def lagged_condition(bars: DataFrame, trend_n: int = 200, lag: int = 2) -> DataFrame:
    """Close above its mean, and a negative three-row return, as known lag rows later; null until defined."""
    c = bars.withColumns({"_up": F.col("close") > S.mean("close", trend_n), "_down": S.change("close", 3) < 0})
    return c.select("symbol", "date", F.lag("_up", lag).over(S.ws()).alias("risk_on"), F.lag("_down", lag).over(S.ws()).alias("pullback"))


def hashed(seed: int, *keys: str) -> Column:
    """A number of [0, 1) that depends on the seed and the keys alone, so that other rows never change it."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def random_control(panel: DataFrame, seed: int) -> DataFrame:
    """X10"""
    return panel.select("symbol", "date", hashed(seed, "date", "symbol").alias("score"))


def permuted_control(panel: DataFrame, seed: int, c: str) -> DataFrame:
    """X11: each symbol gets the value of another place of its date's hashed order."""
    d = X.wd()
    p = panel.withColumn("_h", hashed(seed, "date", "symbol"))
    by_name = p.select("symbol", "date", F.row_number().over(d.orderBy("symbol")).alias("_i"))
    by_hash = p.select("date", F.col(c).alias("score"), F.row_number().over(d.orderBy("_h", "symbol")).alias("_i"))
    return by_name.join(by_hash.hint("merge"), ["date", "_i"]).drop("_i")


def jitter_control(scores: DataFrame, calendar: DataFrame, seed: int, longest: int = 20, c: str = "score") -> DataFrame:
    """The score of 1 to longest sessions before, one lag a date, not before the first session."""
    lag = 1 + F.floor(hashed(seed, "date") * longest)
    source = calendar.withColumn("_from", F.greatest(F.lit(0), F.col("session_no") - lag))
    moved = source.select("date", F.col("_from").alias("session_no")).join(calendar.select(F.col("date").alias("_date"), "session_no"), "session_no").select("date", "_date")
    past = scores.select("symbol", F.col("date").alias("_date"), F.col(c).alias("jittered"))
    return scores.select("symbol", "date").join(moved.hint("merge"), "date").join(past.hint("merge"), ["symbol", "_date"], "left").drop("_date")


def enough_names(panel: DataFrame, c: str, least: int) -> DataFrame:
    """Dates with at least so many scored names."""
    return panel.withColumn("_n", F.count(c).over(X.wd())).filter(F.col("_n") >= least).drop("_n")


def gate_expectation(book: DataFrame, calendar: DataFrame, threshold: float, every: int = 5) -> DataFrame:
    """(date, predicted, above, due, calm) of a book (date, symbol, weight, score, volatility)."""
    g = book.groupBy("date").agg(F.sum(F.col("weight") * F.coalesce("score", F.lit(0.0))).alias("predicted"), F.percentile("volatility", 0.5).alias("_vol"))
    j = g.join(calendar.hint("merge"), "date")
    above = F.col("predicted") > threshold
    return j.select("date", "predicted", above.alias("above"), (above & (F.col("session_no") % every == 0)).alias("due"), (above & (F.col("_vol") < 0.1)).alias("calm"))
