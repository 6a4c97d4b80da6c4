"""Queries of models, their inputs and inference."""

from __future__ import annotations

from math import e
from statistics import NormalDist

from pyspark.sql import functions as F

from ..functions import cross as X
from ..functions import series as S
from ..functions import signals as G
from ..operators import evaluation as E
from ..operators import models as M
from ..sources import bars as B
from .catalog import WSQL, query
from .signals import _MODEL, FLOOR

FEATURES = ("r1", "r5")
FOLDS = {"a": "1997-06-01", "b": "1998-09-01", "c": "2000-06-01"}
_ROWS = f"SELECT symbol, date, close / lag(close, 1) {WSQL} - 1 AS r1, close / lag(close, 5) {WSQL} - 1 AS r5, lead(open, 6) {WSQL} / lead(open, 1) {WSQL} - 1 AS label, lead(open, 1) {WSQL} / close - 1 AS night FROM bars"


def _mask_sql(folds: dict[str, str]) -> str:
    return "SELECT fold, date FROM (SELECT *, count(*) FILTER (date < boundary) OVER (PARTITION BY fold) AS b FROM cal, (VALUES " + ", ".join(f"('{k}', DATE '{v}')" for k, v in folds.items()) + ") AS f(fold, boundary)) WHERE date >= DATE '1995-03-01' AND session_no + 6 < b - 5"


_MASK = _mask_sql(FOLDS)


def rows(spark, d):
    b = B.panel(spark, d)
    return b.select("symbol", "date", S.change("close", 1).alias("r1"), S.change("close", 5).alias("r5"), S.forward_label(5).alias("label"), (F.lead("open").over(S.ws()) / F.col("close") - 1).alias("night"))


def mask(spark, d):
    return M.training_mask(B.sessions(B.panel(spark, d)), "1995-03-01", FOLDS, 5, 5)


@query("m1_training_mask", _MASK)
def m1(spark, d):
    return mask(spark, d)


_FIT = f"""WITH k AS ({_MASK}), x AS (SELECT fold, r1, r5, label FROM ({_ROWS}) JOIN k USING (date) WHERE r1 IS NOT NULL AND r5 IS NOT NULL AND label IS NOT NULL),
 q AS (SELECT fold, quantile_cont(r1, 0.01) AS a1, quantile_cont(r1, 0.99) AS z1, quantile_cont(r5, 0.01) AS a5, quantile_cont(r5, 0.99) AS z5 FROM x GROUP BY fold),
 c AS (SELECT fold, a1, z1, a5, z5, least(greatest(r1, a1), z1) AS u, least(greatest(r5, a5), z5) AS v, label FROM x JOIN q USING (fold)),
 s AS (SELECT fold, any_value(a1) AS a1, any_value(z1) AS z1, any_value(a5) AS a5, any_value(z5) AS z5, avg(label) AS y, avg(u) AS mu, avg(v) AS mv, stddev_pop(u) AS su, stddev_pop(v) AS sv, corr(u, v) AS c, covar_pop(u, label) / stddev_pop(u) AS p, covar_pop(v, label) / stddev_pop(v) AS w FROM c GROUP BY fold),
 z AS (SELECT *, (p * 1.03 - c * w) / (1.03 * 1.03 - c * c) AS b1, (w * 1.03 - c * p) / (1.03 * 1.03 - c * c) AS b5 FROM s)"""


@query("m4_m10_fold_models", f"{_FIT} SELECT fold, NULL AS feature, CAST(NULL AS DOUBLE) AS lower, CAST(NULL AS DOUBLE) AS upper, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS scale, y AS coefficient FROM z UNION ALL SELECT fold, 'r1', a1, z1, mu, su, b1 FROM z UNION ALL SELECT fold, 'r5', a5, z5, mv, sv, b5 FROM z", "lower upper mean scale coefficient")
def m4(spark, d):
    return M.ridge_by_fold(rows(spark, d).hint("merge").join(mask(spark, d).hint("merge"), "date"), FEATURES, "label", 0.03)


@query("m9_walk_forward", f"{_FIT} SELECT symbol, date, fold, y + b1 * (least(greatest(r1, a1), z1) - mu) / su + b5 * (least(greatest(r5, a5), z5) - mv) / sv AS score FROM ({_ROWS}), z WHERE r1 IS NOT NULL AND r5 IS NOT NULL", "score")
def m9(spark, d):
    return M.score_folds(rows(spark, d), m4(spark, d), FEATURES).filter("score is not null")


BLOCKS = {"base": G.BASE, "ranked": G.RANKED, "all": G.INPUTS}
LATER = {"a": "1999-09-01", "b": "2000-06-01", "c": "2001-03-01"}
_LATER = _mask_sql(LATER)
_IN_BLOCK = "(VALUES " + ", ".join(f"('{k}', '{f}', {i})" for k, fs in BLOCKS.items() for i, f in enumerate(fs, 1)) + ") AS b(block, feature, i)"
# The normal equations of a fold and block are solved by elimination, a row of the list of lists a step.
_SOLVED = f"""WITH RECURSIVE w AS ({_MODEL}), k AS ({_LATER}), lb AS (SELECT symbol, date, lead(open, 6) {WSQL} / lead(open, 1) {WSQL} - 1 AS label FROM bars),
 x AS (SELECT fold, symbol, date, label, {', '.join(G.INPUTS)} FROM w JOIN lb USING (symbol, date) JOIN k USING (date) WHERE eligible AND label IS NOT NULL),
 l AS (UNPIVOT x ON {', '.join(G.INPUTS)} INTO NAME feature VALUE v),
 q AS (SELECT fold, feature, quantile_cont(v, 0.01) AS lower, quantile_cont(v, 0.99) AS upper FROM l GROUP BY ALL),
 c AS (SELECT fold, symbol, date, label, feature, least(greatest(v, lower), upper) AS v FROM l JOIN q USING (fold, feature)),
 m AS (SELECT fold, feature, avg(v) AS mean, CASE WHEN stddev_pop(v) > 1e-12 THEN stddev_pop(v) ELSE 1 END AS scale FROM c GROUP BY ALL),
 y AS (SELECT fold, avg(label) AS y FROM x GROUP BY fold),
 z AS (SELECT fold, symbol, date, label - y AS label, feature, (v - mean) / scale AS z FROM c JOIN m USING (fold, feature) JOIN y USING (fold)),
 gm AS (SELECT s.fold, s.feature AS f, t.feature AS g, avg(s.z * t.z) + CASE WHEN s.feature = t.feature THEN 0.03 ELSE 0 END AS v FROM z AS s JOIN z AS t USING (fold, symbol, date) GROUP BY s.fold, s.feature, t.feature),
 gv AS (SELECT fold, feature AS f, avg(z * label) AS v FROM z GROUP BY ALL),
 r0 AS (SELECT fold, bi.block, bi.i, list_append(list(gm.v ORDER BY bj.i), any_value(gv.v)) AS r FROM gm JOIN {_IN_BLOCK.replace("AS b(", "AS bi(")} ON bi.feature = gm.f JOIN {_IN_BLOCK.replace("AS b(", "AS bj(")} ON bj.feature = gm.g AND bj.block = bi.block JOIN gv USING (fold, f) GROUP BY ALL),
 e AS (SELECT fold, block, 1 AS step, count(*) AS p, list(r ORDER BY i) AS a FROM r0 GROUP BY fold, block
  UNION ALL SELECT fold, block, step + 1, p, list_transform(range(1, p + 1), lambda i: list_transform(range(1, p + 2), lambda j: CASE WHEN i = step THEN a[step][j] / a[step][step] ELSE a[i][j] - a[i][step] * a[step][j] / a[step][step] END)) FROM e WHERE step <= p),
 co AS (SELECT fold, block, b.feature, a[b.i][p + 1] AS coefficient FROM e JOIN {_IN_BLOCK} USING (block) WHERE step = p + 1),
 fit AS (SELECT fold, block, feature, lower, upper, mean, scale, coefficient FROM co JOIN q USING (fold, feature) JOIN m USING (fold, feature) UNION ALL SELECT fold, block, NULL, NULL, NULL, NULL, NULL, y FROM y, (SELECT DISTINCT block FROM co))"""


def _inputs(spark, d):
    """W10's inputs and the label of eligible rows, and the sessions."""
    b = B.kept_panel(spark, d)
    x = G.model_features(G.feature_panel(b, B.benchmark(spark, d), FLOOR)).filter("eligible")
    return x.join(b.select("symbol", "date", S.forward_label(5).alias("label")).hint("merge"), ["symbol", "date"]), B.sessions(b)


def _block_models(x, cal):
    return M.ridge_blocks(x.join(M.training_mask(cal, "1995-03-01", LATER, 5, 5).hint("merge"), "date"), BLOCKS, "label", 0.03)


@query("m9_block_models", f"{_SOLVED} SELECT * FROM fit", "lower upper mean scale coefficient")
def m9_models(spark, d):
    return _block_models(*_inputs(spark, d))


@query("m9_block_scores", f"""{_SOLVED}, u AS (UNPIVOT (SELECT symbol, date, {', '.join(G.INPUTS)} FROM w WHERE eligible) ON {', '.join(G.INPUTS)} INTO NAME feature VALUE v)
 SELECT symbol, date, fold, block, sum((least(greatest(v, lower), upper) - mean) / scale * coefficient) + any_value(y) AS score FROM u JOIN fit USING (feature) JOIN y USING (fold) GROUP BY ALL""", "score")
def m9_scores(spark, d):
    x, cal = _inputs(spark, d)
    x = B.kept(x, "model-inputs")
    return M.score_folds(x, _block_models(x, cal), G.INPUTS)


@query("m3_ridge_intercept", f"""WITH g AS (SELECT avg(r1) AS m1, avg(r5) AS m5, avg(label) AS ml, avg(night) AS mn, var_pop(r1) + 0.03 AS a, covar_pop(r1, r5) AS b, var_pop(r5) + 0.03 AS c, covar_pop(r1, label) AS p, covar_pop(r5, label) AS q, covar_pop(r1, night) AS s, covar_pop(r5, night) AS t FROM ({_ROWS}) WHERE r1 IS NOT NULL AND r5 IS NOT NULL AND label IS NOT NULL AND night IS NOT NULL),
 h AS (SELECT *, (p * c - b * q) / (a * c - b * b) AS x1, (q * a - b * p) / (a * c - b * b) AS x5, (s * c - b * t) / (a * c - b * b) AS y1, (t * a - b * s) / (a * c - b * b) AS y5 FROM g)
 SELECT label, feature, coefficient FROM h, LATERAL (VALUES ('label', NULL, ml - x1 * m1 - x5 * m5), ('label', 'r1', x1), ('label', 'r5', x5), ('night', NULL, mn - y1 * m1 - y5 * m5), ('night', 'r1', y1), ('night', 'r5', y5)) AS v(label, feature, coefficient)""", "coefficient")
def m3(spark, d):
    return M.ridge_intercept(rows(spark, d), FEATURES, ("label", "night"), 0.03, 500)


@query("m2_stability_fits", f"""WITH x AS (SELECT *, unnest(CASE WHEN date < DATE '1998-04-01' THEN ['all', 'early'] ELSE ['all', 'late'] END) AS fit FROM ({_ROWS}) WHERE r1 IS NOT NULL AND r5 IS NOT NULL AND label IS NOT NULL),
 g AS (SELECT fit, avg(r1 * r1) + 0.01 AS a, avg(r1 * r5) AS b, avg(r5 * r5) + 0.01 AS c, avg(r1 * label) AS p, avg(r5 * label) AS q FROM x GROUP BY fit)
 SELECT fit, 'r1' AS feature, (p * c - b * q) / (a * c - b * b) AS coefficient FROM g UNION ALL SELECT fit, 'r5', (q * a - b * p) / (a * c - b * b) FROM g""", "coefficient")
def m2_fits(spark, d):
    middle = F.lit("1998-04-01").cast("date")
    return E.ridge_fits(rows(spark, d), FEATURES, "label", 0.01, {"all": F.lit(True), "early": F.col("date") < middle, "late": F.col("date") >= middle})


@query("m7_boosted_trees")
def m7(spark, d):
    x = B.kept(_inputs(spark, d)[0], "model-inputs")
    return M.boosted_trees(x.filter(F.col("date") < "2000-06-01"), x, G.INPUTS, "label").select("symbol", "date", "score")


@query("m8_permutation_importance", f"""WITH x AS (SELECT * FROM ({_ROWS}) JOIN cal USING (date) WHERE r1 IS NOT NULL AND r5 IS NOT NULL AND label IS NOT NULL AND session_no % 10 = 0),
 y AS (SELECT *, coalesce(lag(r1) OVER w, last_value(r1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS p1, coalesce(lag(r5) OVER w, last_value(r5) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS p5 FROM x WINDOW w AS (PARTITION BY date ORDER BY symbol))
 SELECT 'r1' AS feature, avg((0.2 * p1 - 0.3 * r5 - label) ** 2 - (0.2 * r1 - 0.3 * r5 - label) ** 2) AS increase FROM y UNION ALL SELECT 'r5', avg((0.2 * r1 - 0.3 * p5 - label) ** 2 - (0.2 * r1 - 0.3 * r5 - label) ** 2) FROM y""".replace("(w ROWS BETWEEN", "(PARTITION BY date ORDER BY symbol ROWS BETWEEN"), "increase")
def m8(spark, d):
    r = rows(spark, d)
    return M.permutation_importance(r, B.sessions(r), FEATURES, "label", lambda c: 0.2 * c["r1"] - 0.3 * c["r5"])


_EXCESS = "SELECT symbol, date, r - avg(r) OVER (PARTITION BY date) AS r FROM r WHERE r IS NOT NULL QUALIFY count(*) OVER (PARTITION BY date) = 9"


def excess(spark, d):
    p = B.panel(spark, d).withColumn("r", S.change("close")).filter("r is not null")
    return p.withColumn("_n", F.count("*").over(X.wd())).withColumn("r", X.demeaned("r")).filter("_n = 9").select("symbol", "date", "r")


def _inference(source: str, samples: int = 1000, block: int = 20) -> str:
    u = "CAST('0x' || substr(md5('5|' || s || '|' || b), 1, 8) AS BIGINT) / 4294967296.0"
    return f"""WITH z AS (SELECT symbol, r, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM ({source})), n AS (SELECT max(n) AS n FROM z),
 dr AS (SELECT s, b, n, CAST(floor({u} * n) AS BIGINT) AS start FROM n, (SELECT unnest(range(1, {samples + 1})) AS s), LATERAL (SELECT unnest(range(0, (n - 1) // {block} + 1)) AS b)),
 ix AS (SELECT s, (start + k) % n AS i FROM dr, (SELECT unnest(range(0, {block})) AS k) WHERE b * {block} + k < n),
 m AS (SELECT symbol, s, avg(r) AS m FROM ix JOIN z USING (i) GROUP BY ALL), o AS (SELECT symbol, avg(r) AS mean FROM z GROUP BY symbol), t AS (SELECT s, greatest(0, max(m - mean)) AS top FROM m JOIN o USING (symbol) GROUP BY s),
 best AS (SELECT greatest(0, max(mean)) AS best FROM o)
 SELECT symbol, mean * 52 AS annual_mean, lower * 52 AS lower, upper * 52 AS upper, (1 + (SELECT count(*) FROM t WHERE top >= mean)) / {samples + 1}.0 AS familywise_p, (1 + (SELECT count(*) FROM t, best WHERE top >= best)) / {samples + 1}.0 AS global_p
 FROM o JOIN (SELECT symbol, quantile_cont(m, 0.025) AS lower, quantile_cont(m, 0.975) AS upper FROM m GROUP BY symbol) USING (symbol)"""


_P = "annual_mean lower upper familywise_p global_p"


@query("i2_max_mean", _inference(_EXCESS), _P)
def i2(spark, d):
    return M.max_mean_inference(excess(spark, d), 1000, 20, 5, 52)


@query("i4_paired_difference", _inference("SELECT 'S1-S2' AS symbol, a.date, a.r - b.r AS r FROM r a JOIN r b ON a.date = b.date AND a.symbol = 'S1' AND b.symbol = 'S2' WHERE a.r - b.r IS NOT NULL"), _P)
def i4(spark, d):
    r = B.panel(spark, d).withColumn("r", S.change("close")).select("symbol", "date", "r")
    side = lambda s, c: r.filter(F.col("symbol") == s).select("date", F.col("r").alias(c))
    diff = side("S1", "_a").join(side("S2", "_b").hint("merge"), "date").select(F.lit("S1-S2").alias("symbol"), "date", (F.col("_a") - F.col("_b")).alias("r")).filter("r is not null")
    return M.max_mean_inference(diff, 1000, 20, 5, 52)


# The hurdle: 0.02 times the expected best of 20 trials. The normal distribution is summed by Simpson's rule in 2,000 steps.
_HURDLE = 0.02 * ((1 - 0.5772156649) * NormalDist().inv_cdf(1 - 1 / 20) + 0.5772156649 * NormalDist().inv_cdf(1 - 1 / (20 * e)))
_CDF = "(SELECT 0.5 + z / 6000 * sum((CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-((z * k / 2000) ** 2) / 2)) / sqrt(2 * pi()) FROM unnest(range(0, 2001)) AS t(k))"


@query("i3_sharpe_evidence", f"""WITH m AS (SELECT symbol, avg(r) AS m, stddev_samp(r) AS s, count(*) AS n FROM r WHERE r IS NOT NULL GROUP BY symbol),
 g AS (SELECT symbol, any_value(n) AS n, any_value(m / s) AS sr, avg(((r - m) / s) ** 3) AS g1, avg(((r - m) / s) ** 4) AS g2 FROM r JOIN m USING (symbol) WHERE r IS NOT NULL GROUP BY symbol HAVING count(*) >= 20),
 z AS (SELECT symbol, h, (sr - h) * sqrt(n - 1) / sqrt(greatest(1e-12, 1 - g1 * sr + (g2 - 1) * sr * sr / 4)) AS z FROM g, (VALUES (CAST(0 AS DOUBLE)), (CAST({_HURDLE!r} AS DOUBLE))) AS v(h)),
 p AS (SELECT symbol, h, {_CDF} AS p FROM z)
 SELECT symbol, max(p) FILTER (h = 0) AS psr, max(p) FILTER (h > 0) AS dsr, max(h) AS hurdle FROM p GROUP BY symbol""", "psr dsr hurdle")
def i3(spark, d):
    return M.sharpe_evidence(B.panel(spark, d).withColumn("r", S.change("close")), 0.02, 20)
