"""Queries of features, signals and controls."""

from __future__ import annotations

from ..functions import cross as X
from ..functions import series as S
from ..functions import signals as G
from ..operators import evaluation as E
from ..sources import bars as B
from .catalog import WSQL, _frame, _full, query

SEED = 11
FLOOR = 200_000.0


@query("p1_adjusted_ohlc", "SELECT symbol, date, open * adj_close / close AS adj_open, high * adj_close / close AS adj_high, low * adj_close / close AS adj_low FROM bars", "adj_open adj_high adj_low")
def p1(spark, d):
    return G.adjusted_ohlc(B.panel(spark, d)).select("symbol", "date", "adj_open", "adj_high", "adj_low")


def _last(value: str, c: str, n: int) -> str:
    f = f"OVER (ORDER BY date ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({c}) {f} = {n} THEN {value} {f} END"


_STATE = f"""SELECT date, r_mkt, v / ({_last('avg(v)', 'v', 200)}) - 1 AS market_trend, {_last('stddev_samp(r_mkt)', 'r_mkt', 20)} AS market_vol
  FROM (SELECT date, r_mkt, product(1 + coalesce(r_mkt, 0)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS v FROM (SELECT date, adj_close / lag(adj_close) OVER (ORDER BY date) - 1 AS r_mkt FROM mkt))"""


@query("w19_market_trend", _STATE, "r_mkt market_trend market_vol")
def w19(spark, d):
    return G.market_state(B.benchmark(spark, d))


@query("w29_high_volatility", f"SELECT date, CASE WHEN count(v) OVER w = 100 THEN v > quantile_cont(v, 0.5) OVER w END AS high_vol FROM (SELECT date, lag(market_vol) OVER (ORDER BY date) AS v FROM ({_STATE})) WINDOW w AS (ORDER BY date ROWS 99 PRECEDING)")
def w29(spark, d):
    return G.high_volatility(w19(spark, d), 100)


_FEATURES = f"""WITH m AS ({_STATE}),
 f0 AS (SELECT symbol, date, close AS raw, volume, adj_close AS c, adj_open AS o, high * adj_close / close AS h, low * adj_close / close AS l, r_mkt, market_trend FROM bars JOIN m USING (date)),
 f1 AS (SELECT *, c / lag(c) {WSQL} - 1 AS r, c / lag(c, 21) {WSQL} - 1 AS r21, c / lag(c, 63) {WSQL} - 1 AS r63, o / lag(c) {WSQL} - 1 AS gap FROM f0),
 f2 AS (SELECT *, {_full('stddev_samp(r)', 'r', 60)} AS volatility, {_full('stddev_samp(r)', 'r', 10)} AS v10, {_full('avg(gap)', 'gap', 20)} AS gap_20, {_full('avg(raw * volume)', 'volume', 20)} AS adv,
   CASE WHEN count(volume) {_frame(60)} = 60 THEN ln(least(10, greatest(0.1, avg(volume) {_frame(5)} / avg(volume) {_frame(60)}))) END AS volume_anomaly,
   r - r_mkt * CASE WHEN count(r + r_mkt) {_frame(60)} = 60 THEN covar_samp(r, r_mkt) {_frame(60)} / nullif(var_samp(r_mkt) {_frame(60)}, 0) END AS residual FROM f1),
 f AS (SELECT symbol, date, raw, market_trend, lag(c, 5) {WSQL} / lag(c, 63) {WSQL} - 1 AS momentum, r21 - r63 / 3 AS acceleration, c / ({_full('max(h)', 'h', 63)}) - 1 AS breakout,
   r21 * volume_anomaly AS volume_momentum, 1 - c / lag(c, 5) {WSQL} AS reversal, gap * (2 * (c - l) / nullif(h - l, 0) - 1) AS gap_continuation, {_full('sum(residual)', 'residual', 63)} AS residual_momentum,
   v10 / nullif(volatility, 0) AS vol_ratio, CASE WHEN r63 > 0 THEN -v10 / nullif(volatility, 0) END AS vol_contraction, volatility, volume_anomaly, gap_20,
   coalesce(adv >= {FLOOR} AND lag(c, 200) {WSQL} IS NOT NULL, false) AS eligible FROM f2)"""
_BASE = [*G.RANKED, "vol_contraction"]


def features(spark, d):
    return G.feature_panel(B.panel(spark, d), B.benchmark(spark, d), FLOOR)


@query("w9_feature_panel", f"{_FEATURES} SELECT symbol, date, eligible, market_trend, {', '.join(_BASE)} FROM f", " ".join(["market_trend", *_BASE]))
def w9(spark, d):
    return features(spark, d).select("symbol", "date", "eligible", "market_trend", *_BASE)


def _pct(c: str) -> str:
    v = f"CASE WHEN ok THEN {c} END"
    return f"CASE WHEN ok AND {c} IS NOT NULL THEN ((rank() OVER (PARTITION BY date ORDER BY {v} NULLS LAST) + (count(*) OVER (PARTITION BY date, {v}) - 1) / 2.0) / count({v}) OVER (PARTITION BY date) - 0.5) * 2 ELSE 0 END AS {c}"


_MODEL = f"""{_FEATURES}, k AS (SELECT symbol, date, ok AS eligible, {', '.join(_pct(c) for c in G.RANKED)}, coalesce(least(0.5, greatest(-0.5, market_trend)), 0) AS market_trend FROM (SELECT *, eligible AND raw >= 5 AS ok FROM f))
 SELECT *, momentum * reversal AS momentum_reversal, breakout * volume_anomaly AS breakout_volume, -momentum * volatility AS momentum_lowvol, market_trend * reversal AS trend_reversal FROM k"""


@query("w10_p4_model_features", _MODEL, " ".join(G.INPUTS))
def w10(spark, d):
    return G.model_features(features(spark, d))


_CR = "CASE WHEN count(*) OVER (PARTITION BY date) > 1 THEN 2 * (rank() OVER (PARTITION BY date ORDER BY {0}) + (count(*) OVER (PARTITION BY date, {0}) - 1) / 2.0 - 1) / (count(*) OVER (PARTITION BY date) - 1) - 1 ELSE 0 END"


@query("w11_signals", f"""WITH a AS (SELECT symbol, date, r, close / lag(close, 63) {WSQL} - 1 AS momentum, 1 - close / lag(close, 5) {WSQL} AS reversal, r - avg(r) OVER (PARTITION BY date) AS res FROM r),
 b AS (SELECT *, -({_full('stddev_samp(r)', 'r', 20)}) AS low_vol, {_full('stddev_samp(res)', 'res', 20)} AS rv FROM a),
 e AS (SELECT * FROM b QUALIFY min(CASE WHEN momentum IS NOT NULL AND reversal IS NOT NULL AND rv > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY date) = 1),
 g AS (SELECT *, {_CR.format('momentum')} AS m, {_CR.format('reversal')} AS v FROM e)
 SELECT symbol, date, CAST(0 AS DOUBLE) AS equal_weight, momentum, reversal, low_vol, (m + v) / 2 AS mom_rev_blend, greatest(m, 0) * greatest(v, 0) AS trend_pullback, (reversal - avg(reversal) OVER (PARTITION BY date)) / (rv * sqrt(5)) AS vol_scaled_reversal FROM g""", "momentum reversal low_vol mom_rev_blend trend_pullback vol_scaled_reversal")
def w11(spark, d):
    return G.make_signals(B.panel(spark, d))


_RSI = f"""WITH RECURSIVE rc AS (SELECT symbol, date, row_number() {WSQL} - 1 AS k, close - lag(close) {WSQL} AS dx FROM bars),
 rs AS (SELECT symbol, date, k, CAST(0 AS DOUBLE) AS up, CAST(0 AS DOUBLE) AS down FROM rc WHERE k = 0
  UNION ALL SELECT rc.symbol, rc.date, rc.k, CASE WHEN rc.k <= 14 THEN up + greatest(dx, 0) / 14 ELSE (up * 13 + greatest(dx, 0)) / 14 END, CASE WHEN rc.k <= 14 THEN down + greatest(-dx, 0) / 14 ELSE (down * 13 + greatest(-dx, 0)) / 14 END
  FROM rs JOIN rc ON rc.symbol = rs.symbol AND rc.k = rs.k + 1),
 q AS (SELECT symbol, date, CASE WHEN k < 14 THEN NULL WHEN up = 0 AND down = 0 THEN 50 WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END AS rsi FROM rs)"""


@query("w12_wilder_rsi", f"{_RSI} SELECT symbol, date, rsi FROM q", "rsi")
def w12(spark, d):
    return S.wilder_rsi(B.panel(spark, d))


def _trailing(c: str, n: int) -> str:
    return f"CASE WHEN count({c}) {_frame(n)} = {n} THEN (len(list_filter(list({c}) {_frame(n)}, lambda x: x < {c})) + (len(list_filter(list({c}) {_frame(n)}, lambda x: x = {c})) + 1) / 2.0) / {n} END"


@query("w13_rsi_derivatives", f"""{_RSI} SELECT symbol, date, change, change - lag(change) {WSQL} AS acceleration, slope, percentile,
 CASE WHEN rsi IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY rsi NULLS LAST) + (count(*) OVER (PARTITION BY date, rsi) - 1) / 2.0) / count(rsi) OVER (PARTITION BY date) END AS rank, rsi - 30 AS distance_30, rsi - 50 AS distance_50, rsi - 70 AS distance_70
 FROM (SELECT *, rsi - lag(rsi) {WSQL} AS change, (rsi - lag(rsi, 5) {WSQL}) / 5 AS slope, CASE WHEN n = 60 THEN (len(list_filter(w, lambda x: x < rsi)) + (len(list_filter(w, lambda x: x = rsi)) + 1) / 2.0) / 60 END AS percentile FROM (SELECT *, list(rsi) {_frame(60)} AS w, count(rsi) {_frame(60)} AS n FROM q))""", "change acceleration slope percentile rank distance_30 distance_50 distance_70")
def w13(spark, d):
    return G.rsi_derivatives(w12(spark, d), 60).drop("rsi")


_RULES = f"""{_RSI}, i0 AS (SELECT symbol, date, close, ({_full('max(high)', 'high', 9)} + {_full('min(low)', 'low', 9)}) / 2 AS tenkan, ({_full('max(high)', 'high', 26)} + {_full('min(low)', 'low', 26)}) / 2 AS kijun, ({_full('max(high)', 'high', 52)} + {_full('min(low)', 'low', 52)}) / 2 AS sb,
   {_full('avg(close)', 'close', 20)} AS mid, {_full('stddev_pop(close)', 'close', 20)} AS sg, close / ({_full('avg(close)', 'close', 50)}) - 1 AS trend, CASE WHEN lag(close) {WSQL} IS NOT NULL THEN greatest(high - low, abs(high - lag(close) {WSQL}), abs(low - lag(close) {WSQL})) END AS tr FROM bars),
 i1 AS (SELECT *, CASE WHEN tenkan + kijun + sb IS NOT NULL THEN greatest((tenkan + kijun) / 2, sb) END AS top, {_full('avg(tr)', 'tr', 14)} AS atr, (close - (mid - 2 * sg)) / nullif(4 * sg, 0) AS b, 4 * sg / mid AS bw FROM i0),
 i2 AS (SELECT *, bw - lag(bw) {WSQL} AS expansion, list(bw) {_frame(60)} AS w, count(bw) {_frame(60)} AS n FROM i1),
 i3 AS (SELECT *, CASE WHEN n = 60 THEN (len(list_filter(w, lambda x: x < bw)) + (len(list_filter(w, lambda x: x = bw)) + 1) / 2.0) / 60 END AS bp FROM i2),
 i4 AS (SELECT i3.*, rsi, lag(bp) OVER (PARTITION BY i3.symbol ORDER BY i3.date) < 0.2 AS narrow, close > top AND tenkan > kijun AS up FROM i3 JOIN q ON q.symbol = i3.symbol AND q.date = i3.date)
 SELECT symbol, date, -rsi AS rsi_reversal, CASE WHEN trend > 0 AND rsi < 50 THEN -rsi END AS rsi_trend, CASE WHEN rsi > 70 THEN rsi END AS rsi_continuation, -b AS bb_reversal, CASE WHEN trend > 0 THEN -b END AS bb_trend_reversal, CASE WHEN b > 1 THEN b END AS bb_breakout,
  CASE WHEN narrow AND expansion > 0 AND b > 1 THEN b END AS bb_squeeze, CASE WHEN up THEN (close - top) / nullif(atr, 0) END AS ichimoku, CASE WHEN up AND rsi < 50 THEN -rsi END AS ichimoku_rsi, CASE WHEN up AND b > 1 THEN b END AS bb_ichimoku FROM i4"""


@query("p5_m11_rule_scores", _RULES, "rsi_reversal rsi_trend rsi_continuation bb_reversal bb_trend_reversal bb_breakout bb_squeeze ichimoku ichimoku_rsi bb_ichimoku")
def p5(spark, d):
    return G.rule_scores(G.technical(B.panel(spark, d), pct_n=60, trend_n=50))


_GUARDED = _RULES[: _RULES.rindex(" SELECT symbol, date, -rsi")] + f""", s AS (SELECT symbol, date, 0.2 * (close / lag(close, 1) {WSQL} - 1) - 0.3 * (close / lag(close, 5) {WSQL} - 1) AS score FROM bars), st AS ({_STATE})
 SELECT symbol, date, CASE WHEN up AND market_trend > 0 THEN (close - top) / nullif(atr, 0) END AS ichimoku_market, CASE WHEN rsi < 70 THEN score END AS ridge_rsi_veto, CASE WHEN bp < 0.8 THEN score END AS ridge_bb_veto, CASE WHEN up THEN score END AS ridge_ichimoku_veto
 FROM i4 JOIN s USING (symbol, date) LEFT JOIN st USING (date)"""


@query("p5_guarded_scores", _GUARDED, "ichimoku_market ridge_rsi_veto ridge_bb_veto ridge_ichimoku_veto")
def p5_guarded(spark, d):
    b = B.panel(spark, d)
    score = E.linear_score(("_r1", "_r5"), [0.2, -0.3])
    scores = b.withColumns({"_r1": S.change("close", 1), "_r5": S.change("close", 5)}).select("symbol", "date", score.alias("score"))
    return G.guarded_scores(G.technical(b, pct_n=60, trend_n=50), scores, w19(spark, d))


@query("w24_lagged_condition", f"SELECT symbol, date, lag(up, 2) {WSQL} AS risk_on, lag(down, 2) {WSQL} AS pullback FROM (SELECT symbol, date, close > ({_full('avg(close)', 'close', 40)}) AS up, close / lag(close, 3) {WSQL} - 1 < 0 AS down FROM bars)")
def w24(spark, d):
    return G.lagged_condition(B.panel(spark, d), 40)


def _hash(*keys: str) -> str:
    return f"CAST('0x' || substr(md5('{SEED}|' || {chr(39).join([' || ', '|', ' || ']).join(f'CAST({k} AS VARCHAR)' for k in keys)}), 1, 8) AS BIGINT) / 4294967296.0"


_SCORE = f"SELECT symbol, date, close / lag(close, 5) {WSQL} - 1 AS score FROM bars"


def score(spark, d):
    return B.panel(spark, d).select("symbol", "date", S.change("close", 5).alias("score"))


@query("x10_random_control", f"SELECT symbol, date, {_hash('date', 'symbol')} AS score FROM bars", "score")
def x10(spark, d):
    return G.random_control(B.panel(spark, d), SEED)


@query("x11_permuted_control", f"SELECT a.symbol, a.date, b.score FROM (SELECT symbol, date, row_number() OVER (PARTITION BY date ORDER BY symbol) AS i FROM bars) a JOIN (SELECT date, score, row_number() OVER (PARTITION BY date ORDER BY h, symbol) AS i FROM (SELECT *, {_hash('date', 'symbol')} AS h FROM ({_SCORE}))) b ON a.date = b.date AND a.i = b.i", "score")
def x11(spark, d):
    return G.permuted_control(score(spark, d), SEED, "score")


@query("x12_jitter_control", f"WITH s AS ({_SCORE}), g AS (SELECT date, greatest(0, session_no - 1 - CAST(floor({_hash('date')} * 20) AS BIGINT)) AS n FROM cal) SELECT s.symbol, s.date, p.score AS jittered FROM s JOIN g ON g.date = s.date JOIN cal c ON c.session_no = g.n LEFT JOIN s p ON p.symbol = s.symbol AND p.date = c.date", "jittered")
def x12(spark, d):
    s = score(spark, d)
    return G.jitter_control(s, B.sessions(s), SEED)


@query("x7_enough_names", f"SELECT symbol, date, score FROM ({_SCORE}) QUALIFY count(score) OVER (PARTITION BY date) >= 5", "score")
def x7(spark, d):
    return G.enough_names(score(spark, d), "score", 5)


@query("x9_gate_expectation", f"""WITH s AS (SELECT *, {_full('stddev_samp(r)', 'r', 20)} AS vol, close / lag(close, 5) {WSQL} - 1 AS score FROM r),
 t AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS place FROM s WHERE score IS NOT NULL),
 u AS (SELECT *, 0.995 * (1.5 - (place - 1) / 3.0) / sum(1.5 - (place - 1) / 3.0) OVER (PARTITION BY date) AS weight FROM t WHERE place <= 4),
 g AS (SELECT date, sum(weight * score) AS predicted, quantile_cont(vol, 0.5) AS vol FROM u GROUP BY date)
 SELECT date, predicted, predicted > 0.02 AS above, predicted > 0.02 AND session_no % 5 = 0 AS due, predicted > 0.02 AND vol < 0.1 AS calm FROM g JOIN cal USING (date)""", "predicted")
def x9(spark, d):
    b = B.panel(spark, d)
    p = b.withColumn("r", S.change("close")).select("symbol", "date", S.change("close", 5).alias("score"), S.std("r", 20).alias("volatility"))
    return G.gate_expectation(X.target_weights(p, "score", 4), B.sessions(b), 0.02)


# of three names at most two reach a cap of 0.4, so two rounds of holding names at the cap are enough
@query("x6_inverse_volatility", f"""WITH t AS (SELECT symbol, date, 1 / greatest(vol, 0.005) AS raw, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS place FROM (SELECT symbol, date, close / lag(close, 5) {WSQL} - 1 AS score, {_full('stddev_samp(r)', 'r', 20)} AS vol FROM r) WHERE score IS NOT NULL AND vol IS NOT NULL),
 u AS (SELECT *, 0.995 * raw / sum(raw) OVER (PARTITION BY date) AS w0 FROM t WHERE place <= 3),
 a AS (SELECT *, w0 > 0.4 AS c0, count(*) FILTER (w0 > 0.4) OVER (PARTITION BY date) AS n0, sum(CASE WHEN w0 > 0.4 THEN 0 ELSE raw END) OVER (PARTITION BY date) AS s0 FROM u),
 b AS (SELECT *, CASE WHEN c0 THEN 0.4 ELSE (0.995 - 0.4 * n0) * raw / s0 END AS w1 FROM a),
 c AS (SELECT *, w1 > 0.4 OR c0 AS c1, count(*) FILTER (w1 > 0.4 OR c0) OVER (PARTITION BY date) AS n1, sum(CASE WHEN w1 > 0.4 OR c0 THEN 0 ELSE raw END) OVER (PARTITION BY date) AS s1 FROM b)
 SELECT symbol, date, CAST(place AS INTEGER) AS place, CASE WHEN c1 THEN 0.4 ELSE (0.995 - 0.4 * n1) * raw / s1 END AS weight FROM c""", "weight")
def x6(spark, d):
    p = B.panel(spark, d).withColumn("r", S.change("close")).select("symbol", "date", S.change("close", 5).alias("score"), S.std("r", 20).alias("volatility"))
    return X.inverse_volatility_weights(p, "score", "volatility", 3).select("symbol", "date", "place", "weight")


@query("p5_feature_scores", f"""WITH m AS ({_MODEL}), w AS (SELECT symbol, date, momentum AS rm FROM ({_FEATURES} SELECT * FROM f))
 SELECT symbol, date, momentum + residual_momentum + breakout - 0.5 * volatility + 0.25 * reversal AS quality_rule, CASE WHEN rm > 0 THEN momentum + reversal END AS momentum_quality_pullback, momentum - volatility AS momentum_low_vol FROM m JOIN w USING (symbol, date) WHERE eligible""", "quality_rule momentum_quality_pullback momentum_low_vol")
def p5_features(spark, d):
    return G.feature_scores(B.kept(features(spark, d), "features"))
