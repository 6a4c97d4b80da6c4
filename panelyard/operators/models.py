"""Purged training rows, ridge models by fold, boosted trees, and what their inputs are worth.

Spark forms the sufficient statistics of all folds in one grouped job; the driver solves a p by p system a fold.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.bars import kept
from .boosting import fit_trees, score_trees
from .quantiles import exact_quantiles


def training_mask(calendar: DataFrame, start: str, boundaries: dict[str, str], horizon: int, embargo: int) -> DataFrame:
    """M1: (fold, date) whose label's exit comes more than embargo sessions before the fold's boundary.

    calendar: (date, session_no); boundaries: fold -> first evaluation date. Raises ValueError if embargo < horizon.
    """
    if horizon < 1 or embargo < horizon:
        raise ValueError("embargo must cover the horizon")
    folds = F.explode(F.create_map(*[x for k, b in boundaries.items() for x in (F.lit(k), F.lit(b).cast("date"))])).alias("fold", "boundary")
    c = calendar.select("date", "session_no", folds)
    c = c.withColumn("_b", F.count_if(F.col("date") < F.col("boundary")).over(W.partitionBy("fold")))
    return c.filter((F.col("date") >= F.lit(start).cast("date")) & (F.col("session_no") + horizon + 1 < F.col("_b") - embargo)).select("fold", "date")


def ridge_blocks(rows: DataFrame, blocks: dict[str, tuple[str, ...]], label: str, penalty: float, tails: float = 0.01, least_rows: int = 100) -> DataFrame:
    """M4, M9: one row per (fold, block, feature): lower, upper, mean, scale, coefficient; feature null is the intercept.

    rows(fold, features, label) are the training rows of each fold; blocks name sets of features that may overlap. Features
    are cut at each fold's own exact quantiles, scaled by the deviation of the cut values (1 where there is none), and the
    intercept is not penalised. Rows with a null in any block go. One pass forms each fold's matrix of products of all
    features, as partial sums of tasks; a block's model is solved from its part of it. Raises ValueError where a fold has
    fewer than least_rows rows.
    """
    import numpy as np

    features = tuple(dict.fromkeys(f for block in blocks.values() for f in block))
    full = kept(rows.select("fold", *[F.col(c).cast("double").alias(c) for c in (*features, label)]).dropna(), "ridge-rows")
    bounds: dict = {}
    for r in exact_quantiles(full, features, (tails, 1 - tails), ("fold",)).collect():  # one row a fold and feature
        bounds.setdefault(r["fold"], {})[r["column"]] = (r["n"], *r["q"])
    for fold, of in bounds.items():
        if of[features[0]][0] < least_rows:
            raise ValueError(f"fold {fold} has fewer than {least_rows} training rows")
    lower = {fold: np.array([of[f][1] for f in features]) for fold, of in bounds.items()}
    upper = {fold: np.array([of[f][2] for f in features]) for fold, of in bounds.items()}
    width = len(features) + 2  # the features, about the middle of their bounds; the label; one

    def products(parts):
        total = {}
        for pdf in parts:
            for fold, part in pdf.groupby("fold"):
                x = np.clip(part[list(features)].to_numpy(float), lower[fold], upper[fold]) - (lower[fold] + upper[fold]) / 2
                v = np.column_stack([x, part[label], np.ones(len(part))])
                total[fold] = total.get(fold, 0) + v.T @ v
        cells = [(fold, i * width + j, m[i, j]) for fold, m in total.items() for i in range(width) for j in range(i, width)]
        yield pd.DataFrame(cells, columns=["fold", "cell", "s"])

    sums = full.mapInPandas(products, "fold string, cell int, s double").groupBy("fold", "cell").agg(F.sum("s").alias("s"))
    matrices = {fold: np.zeros((width, width)) for fold in bounds}
    for r in sums.collect():  # (p + 2) (p + 3) / 2 rows a fold
        i, j = divmod(r["cell"], width)
        matrices[r["fold"]][i, j] = matrices[r["fold"]][j, i] = r["s"]
    out = []
    for fold, m in matrices.items():
        m = m / m[-1, -1]
        mean, cov = m[:-1, -1], m[:-1, :-1] - np.outer(m[:-1, -1], m[:-1, -1])
        deviation = np.sqrt(np.maximum(np.diag(cov)[:-1], 0))
        scale = np.where(deviation > 1e-12, deviation, 1.0)
        middle = (lower[fold] + upper[fold]) / 2
        for block, members in blocks.items():
            at = [features.index(f) for f in members]
            g = cov[np.ix_(at, at)] / np.outer(scale[at], scale[at])
            w = np.linalg.solve(g + penalty * np.eye(len(at)), cov[at, -1] / scale[at])
            out.append((fold, block, None, None, None, None, None, float(mean[-1])))
            out += [(fold, block, f, float(lower[fold][i]), float(upper[fold][i]), float(mean[i] + middle[i]), float(scale[i]), float(c)) for f, i, c in zip(members, at, w)]
    return rows.sparkSession.createDataFrame(out, "fold string, block string, feature string, lower double, upper double, mean double, scale double, coefficient double")


def ridge_by_fold(rows: DataFrame, features: tuple[str, ...], label: str, penalty: float, tails: float = 0.01, least_rows: int = 100) -> DataFrame:
    """As ridge_blocks, of one block of features, without the column block."""
    return ridge_blocks(rows, {"all": features}, label, penalty, tails, least_rows).drop("block")


def score_folds(rows: DataFrame, models: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """M9: the score of every row under every model (symbol, date, fold and, if the models have it, block, score); null features give null.

    models is a row per fold, block and feature, so the coefficients become literals of one projection.
    """
    by: dict = {}
    names = [c for c in ("fold", "block") if c in models.columns]
    for m in models.collect():
        by.setdefault(tuple(m[c] for c in names), {})[m["feature"]] = m
    scores = []
    for key, m in sorted(by.items()):
        s = F.lit(m[None]["coefficient"])
        for f in features:
            if f in m:
                z = (F.least(F.greatest(F.col(f), F.lit(m[f]["lower"])), F.lit(m[f]["upper"])) - m[f]["mean"]) / m[f]["scale"]
                s = s + F.when(F.col(f).isNotNull(), z * m[f]["coefficient"])
        scores.append(F.struct(*[F.lit(x).alias(c) for c, x in zip(names, key)], s.alias("score")))
    return rows.select("symbol", "date", F.explode(F.array(*scores)).alias("_m")).select("symbol", "date", "_m.*")


def ridge_intercept(rows: DataFrame, features: tuple[str, ...], labels: tuple[str, ...], penalty: float, least_rows: int = 10_000) -> DataFrame:
    """M3: (label, feature, coefficient) of ridge models with an unpenalised intercept (feature null), one per label.

    Raises ValueError with fewer than least_rows rows that have all features and labels.
    """
    import numpy as np

    full = rows.dropna(subset=[*features, *labels])
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    s = full.agg(*[F.avg(c).alias(f"m_{c}") for c in (*features, *labels)], *[F.covar_pop(a, b).alias(f"{a}__{b}") for a, b in [*pairs, *[(f, y) for f in features for y in labels]]], F.count("*").alias("_n")).first()
    if s["_n"] < least_rows:
        raise ValueError(f"fewer than {least_rows} training rows")
    g = np.zeros((len(features), len(features)))
    for a, b in pairs:
        i, j = features.index(a), features.index(b)
        g[i, j] = g[j, i] = s[f"{a}__{b}"]
    out = []
    for y in labels:
        w = np.linalg.solve(g + penalty * np.eye(len(features)), np.array([s[f"{f}__{y}"] for f in features]))
        out.append((y, None, float(s[f"m_{y}"] - sum(w[i] * s[f"m_{f}"] for i, f in enumerate(features)))))
        out += [(y, f, float(w[i])) for i, f in enumerate(features)]
    return rows.sparkSession.createDataFrame(out, "label string, feature string, coefficient double")


def boosted_trees(train: DataFrame, rows: DataFrame, features: tuple[str, ...], label: str, **params) -> DataFrame:
    """M7: rows with the score of gradient-boosted trees fitted on train (see fit_trees); rows with a null feature go."""
    return score_trees(rows, fit_trees(train, features, label, **params), features).filter("score is not null")


def permutation_importance(panel: DataFrame, calendar: DataFrame, features: tuple[str, ...], label: str, score, every: int = 10) -> DataFrame:
    """M8: per feature, how much the mean squared error grows when each symbol takes its date's previous symbol's value.

    score: columns by feature name -> Column. Only every so-many-th session counts; the first symbol takes the last one's.
    """
    d = W.partitionBy("date").orderBy("symbol")
    whole = W.partitionBy("date").orderBy("symbol").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    p = panel.dropna(subset=[*features, label]).join(calendar.filter(F.col("session_no") % every == 0).select("date"), "date")
    p = p.withColumns({f"_{f}": F.coalesce(F.lag(f).over(d), F.last(f).over(whole)) for f in features})
    err = lambda cols: F.pow(score(cols) - F.col(label), F.lit(2.0))
    plain = {f: F.col(f) for f in features}
    each = F.explode(F.create_map(*[x for f in features for x in (F.lit(f), err({**plain, f: F.col(f"_{f}")}) - err(plain))]))
    return p.select(each.alias("feature", "_e")).groupBy("feature").agg(F.avg("_e").alias("increase"))


def max_mean_inference(excess: DataFrame, samples: int, block: int, seed: int, per_year: int = 252, key: str = "symbol", r: str = "r") -> DataFrame:
    """Annual mean, 95 % interval, familywise and global p of many series under the same resampled dates.

    excess(key, date, r) must be aligned: every series has every date. Circular blocks start where a hash of (seed, sample,
    block) points. A block's sum is a difference of prefix sums, so the work is series * samples * blocks, not dates.
    """
    w = W.partitionBy(key).orderBy("date")
    d = kept(excess.select(key, "date", r).withColumns({"i": F.row_number().over(w) - 1, "n": F.count("*").over(W.partitionBy(key))}), "inference-series")
    twice = d.select(key, "n", r, F.explode(F.array(F.col("i"), F.col("i") + F.col("n"))).alias("i"))
    prefix = twice.withColumn("upto", F.sum(r).over(W.partitionBy(key).orderBy("i").rowsBetween(W.unboundedPreceding, 0))).select(key, "i", "upto")
    draws = d.select(key, "n").distinct().withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(samples)))).withColumn("b", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / block).cast("int"))))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("s").cast("string"), F.col("b").cast("string"))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    draws = draws.withColumns({"start": F.floor(u * F.col("n")).cast("int"), "len": F.least(F.lit(block), F.col("n") - F.col("b") * block).cast("int")})
    hi = draws.withColumn("i", F.col("start") + F.col("len") - 1).join(prefix.withColumnRenamed("upto", "hi").hint("merge"), [key, "i"]).drop("i")
    both = hi.withColumn("i", F.col("start") - 1).join(prefix.withColumnRenamed("upto", "lo").hint("merge"), [key, "i"], "left")
    means = kept(both.groupBy(key, "s").agg((F.sum(F.col("hi") - F.coalesce("lo", F.lit(0.0))) / F.first("n")).alias("m")), "inference-means")
    seen = d.groupBy(key).agg(F.avg(r).alias("mean"))
    seen = seen.withColumn("best", F.greatest(F.lit(0.0), F.max("mean").over(W.partitionBy(F.lit(1)))))  # one row a series
    m = means.join(seen.hint("merge"), key)
    null = m.groupBy("s").agg(F.greatest(F.lit(0.0), F.max(F.col("m") - F.col("mean"))).alias("top"))
    q = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    both = m.join(null.hint("merge"), "s")
    g = both.groupBy(key).agg(F.first("mean").alias("mean"), q[0].alias("lo"), q[1].alias("hi"), F.count_if(F.col("top") >= F.col("mean")).alias("a"), F.count_if(F.col("top") >= F.col("best")).alias("b"))
    return g.select(key, (F.col("mean") * per_year).alias("annual_mean"), (F.col("lo") * per_year).alias("lower"), (F.col("hi") * per_year).alias("upper"), ((1 + F.col("a")) / (samples + 1)).alias("familywise_p"), ((1 + F.col("b")) / (samples + 1)).alias("global_p"))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function by its power series z + z^3 / 3 + z^5 / 15 + ..., to some 15 decimals.

    Spark has no error function. Beyond 9 deviations the value is that of 9.
    """
    x = F.least(F.greatest(z, F.lit(-9.0)), F.lit(9.0))

    def add(a: Column, k: Column) -> Column:
        term = a["term"] * x * x / (2 * k + 1)
        return F.struct(term.alias("term"), (a["total"] + term).alias("total"))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(200)), F.struct(x.alias("term"), x.alias("total")), add)["total"]
    return F.least(F.greatest(0.5 + total * F.exp(-x * x / 2) / F.sqrt(2 * F.pi()), F.lit(0.0)), F.lit(1.0))


def sharpe_evidence(daily: DataFrame, dispersion: float, trials: int, r: str = "r", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Probabilities that the Sharpe ratio is above 0 and above the best of so many trials of a given dispersion.

    Null for under 20 returns or no variance. Moments are population ones of returns scaled by the sample deviation.
    """
    from math import e
    from statistics import NormalDist

    n, inv = max(2, trials), NormalDist().inv_cdf
    gamma = 0.5772156649  # fixed value: Euler's constant
    hurdle = dispersion * ((1 - gamma) * inv(1 - 1 / n) + gamma * inv(1 - 1 / (n * e)))
    g = daily.filter(F.col(r).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(r).alias("m"), F.stddev_samp(r).alias("s"), F.skewness(r).alias("g1"), F.kurtosis(r).alias("g2"))
    shrink = (F.col("n") - 1) / F.col("n")
    g = g.withColumns({"sr": F.col("m") / F.nullif("s", F.lit(0.0)), "skew": F.col("g1") * F.pow(shrink, 1.5), "kurt": (F.col("g2") + 3) * F.pow(shrink, 2.0)})
    spread = F.sqrt(F.greatest(F.lit(1e-12), 1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) * F.col("sr") * F.col("sr") / 4))
    ok = (F.col("n") >= 20) & F.col("sr").isNotNull()
    p = lambda h: F.when(ok, normal_cdf((F.col("sr") - h) * F.sqrt(F.col("n") - 1) / spread))
    return g.select(*keys, p(0.0).alias("psr"), p(hurdle).alias("dsr"), F.lit(hurdle).alias("hurdle"))
