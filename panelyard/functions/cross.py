"""Per-date windows across symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

def wd():
    return W.partitionBy("date")


def average_rank(c: str | Column, keys: tuple[str, ...] = ("date",)) -> Column:
    """Rank from 1 with the mean rank for ties; null stays null.

    Ties come from the ranks of both directions, so every window shares the keys' partitioning: one shuffle.
    """
    x, w = (F.col(c) if isinstance(c, str) else c), W.partitionBy(*keys)
    up, down = F.rank().over(w.orderBy(x.asc_nulls_last())), F.rank().over(w.orderBy(x.desc_nulls_last()))
    return F.when(x.isNotNull(), (up + F.count(x).over(w) + 1 - down) / 2)


def centred_rank(panel: DataFrame, c: str, out: str = "rank") -> DataFrame:
    """Average rank mapped to [-1, 1]; one name alone gets 0."""
    n = F.count(c).over(wd())
    return panel.withColumn("_r", average_rank(c)).withColumn("_n", n).withColumn(out, F.when(F.col("_n") > 1, (2 * (F.col("_r") - 1) / (F.col("_n") - 1)) - 1).when(F.col("_r").isNotNull(), F.lit(0.0))).drop("_r", "_n")


def ranked_pct(panel: DataFrame, c: str, out: str = "pct") -> DataFrame:
    """(average rank / count - 1/2) * 2."""
    return panel.withColumn("_r", average_rank(c)).withColumn(out, (F.col("_r") / F.count(c).over(wd()) - 0.5) * 2).drop("_r")


def demeaned(c: str) -> Column:
    """X3"""
    return F.col(c) - F.avg(c).over(wd())


def score_weights(panel: DataFrame, c: str, tilt: float = 0.6) -> DataFrame:
    """(1 + tilt * centred rank) / n."""
    p = centred_rank(panel.filter(F.col(c).isNotNull()), c, "_rank")
    return p.withColumn("weight", (1 + tilt * F.col("_rank")) / F.count("*").over(wd())).drop("_rank")


def top_weights(panel: DataFrame, c: str, k: int) -> DataFrame:
    """Equal weights of the k best; names tied at the edge share what is left."""
    p = panel.filter(F.col(c).isNotNull()).withColumns({"_above": F.rank().over(wd().orderBy(F.desc(c))) - 1, "_below": F.rank().over(wd().orderBy(F.asc(c))) - 1, "_names": F.count("*").over(wd())})
    p = p.withColumns({"_ties": F.col("_names") - F.col("_above") - F.col("_below"), "_n": F.least(F.lit(k), F.col("_names"))})
    w = F.when(F.col("_above") + F.col("_ties") <= F.col("_n"), 1 / F.col("_n")).when(F.col("_above") < F.col("_n"), (F.col("_n") - F.col("_above")) / F.col("_n") / F.col("_ties")).otherwise(F.lit(0.0))
    return p.withColumn("weight", w).drop("_above", "_below", "_names", "_ties", "_n")


def _by_place(p: DataFrame, keys: tuple[str, ...], k: int, weighting: str, gross: float) -> DataFrame:
    """p with weight from place: equal, or signal, falling in a line from 1.5 to 0.5; scaled to gross by key."""
    if weighting not in ("signal", "equal"):
        raise ValueError("weighting must be signal or equal")
    raw = 1.5 - (F.col("place") - 1) / F.lit(max(k - 1, 1)) if weighting == "signal" else F.lit(1.0)
    return p.withColumn("_w", raw).withColumn("weight", gross * F.col("_w") / F.sum("_w").over(W.partitionBy(*keys))).drop("_w")


def target_weights(panel: DataFrame, c: str, k: int, gross: float = 0.995, weighting: str = "signal") -> DataFrame:
    """X6 without a cap: the k best by score, ties to the symbol first in order, weighted 1.5 to 0.5 by place or equally."""
    p = panel.filter(F.col(c).isNotNull()).withColumn("place", F.row_number().over(wd().orderBy(F.desc(c), "symbol"))).filter(F.col("place") <= k)
    return _by_place(p, ("date",), k, weighting, gross)


def weights_without_each_group(panel: DataFrame, groups: DataFrame, c: str, k: int, gross: float = 0.995, weighting: str = "signal") -> DataFrame:
    """(grp, date, symbol, place, weight): target_weights of the names outside each group, from one ranking.

    A group whose names hold j of the first k + j places leaves the others of these; j is the number of its names whose
    place, less its names above, is at most k. groups(symbol, grp): a name may be in several groups, or in none. Only names
    within reach meet the groups of their date, so the panel isn't copied once a group.
    """
    ranked = panel.filter(F.col(c).isNotNull()).select("date", "symbol", F.row_number().over(wd().orderBy(F.desc(c), "symbol")).alias("_p"))
    members = ranked.join(groups.select("symbol", "grp").distinct().hint("merge"), "symbol")
    g = W.partitionBy("date", "grp").orderBy("_p")
    lost = members.withColumn("_above", F.row_number().over(g) - 1).groupBy("date", "grp").agg((k + F.count_if(F.col("_p") - F.col("_above") <= k)).alias("_to"))
    reach = ranked.join(lost.groupBy("date").agg(F.max("_to").alias("_most")).hint("merge"), "date").filter("_p <= _most").drop("_most")
    left = reach.join(lost.hint("merge"), "date").filter("_p <= _to")
    own = members.select("date", "grp", "symbol")
    left = left.join(own.hint("merge"), ["date", "grp", "symbol"], "left_anti").withColumn("place", F.row_number().over(g))
    return _by_place(left.select("grp", "date", "symbol", "place"), ("grp", "date"), k, weighting, gross)


def quantile_spread(panel: DataFrame, c: str, label: str, q: float = 0.2) -> DataFrame:
    """Mean label of the best share q less that of the worst, by date."""
    p = panel.filter(F.col(c).isNotNull() & F.col(label).isNotNull()).withColumn("_p", average_rank(c)).withColumn("_p", F.col("_p") / F.count("*").over(wd()))
    return p.groupBy("date").agg((F.avg(F.when(F.col("_p") > 1 - q, F.col(label))) - F.avg(F.when(F.col("_p") <= q, F.col(label)))).alias("spread"))


def rank_ic(panel: DataFrame, score: str, label: str) -> DataFrame:
    """Rank correlation of score and label by date; null where one of them is constant."""
    p = panel.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    p = p.withColumns({"_a": average_rank(score), "_b": average_rank(label)})
    return p.groupBy("date").agg((F.covar_pop("_a", "_b") / F.nullif(F.stddev_pop("_a") * F.stddev_pop("_b"), F.lit(0.0))).alias("ic"), F.count("*").alias("n"))


def capped(panel: DataFrame, raw: str, gross: float, cap: float, keys: tuple[str, ...] = ("date",), name: str = "symbol") -> DataFrame:
    """Weights in proportion to raw, none above cap, summing to gross (to cap times the names, if that is less).

    The names by falling raw: the first one that fits below the cap, once those before it are held at the cap, sets the
    scale of all after it. Two windows by date instead of repeated passes.
    """
    w = W.partitionBy(*keys)
    down = w.orderBy(F.desc(raw), name)
    p = panel.withColumns({"_j": F.row_number().over(down), "_rest": F.sum(raw).over(down.rowsBetween(0, W.unboundedFollowing))})
    scale = (gross - (F.col("_j") - 1) * cap) / F.col("_rest")
    p = p.withColumn("_scale", F.when(F.col(raw) * scale <= cap, scale)).withColumn("_from", F.min(F.when(F.col("_scale").isNotNull(), F.col("_j"))).over(w))
    p = p.withColumn("_s", F.max(F.when(F.col("_j") == F.col("_from"), F.col("_scale"))).over(w))
    return p.withColumn("weight", F.when(F.col("_j") >= F.col("_from"), F.col(raw) * F.col("_s")).otherwise(F.lit(cap))).drop("_j", "_rest", "_scale", "_from", "_s")


def inverse_volatility_weights(panel: DataFrame, c: str, volatility: str, k: int, gross: float = 0.995, cap: float = 0.4) -> DataFrame:
    """The k best by score, ties to the symbol first in order, sized by 1 / max(volatility, 0.005) under a cap."""
    p = panel.filter(F.col(c).isNotNull() & F.col(volatility).isNotNull()).withColumn("place", F.row_number().over(wd().orderBy(F.desc(c), "symbol"))).filter(F.col("place") <= k)
    return capped(p.withColumn("_raw", 1 / F.greatest(F.col(volatility), F.lit(0.005))), "_raw", gross, cap).drop("_raw")
