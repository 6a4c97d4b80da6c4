"""The queries over the given tables, each with DuckDB SQL of its own where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import cross as X
from ..functions import series as S
from ..operators import account as A
from ..operators import evaluation as E
from ..operators import joins as J
from ..operators import validation as V
from ..sources import bars as B

DIGITS = 8
QUERIES: dict = {}
SQL: dict[str, str] = {}

_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def _bars_sql(name: str, keys: str, symbol: str) -> str:
    return f"""{name} AS (
  SELECT *, open * adj_close / close AS adj_open FROM (
    SELECT {symbol} date, first(price ORDER BY {_ORDER}) AS open, max(price) AS high, min(price) AS low,
           last(price ORDER BY {_ORDER}) AS close, sum(l_quantity) AS volume,
           last(price ORDER BY {_ORDER}) * (1 - avg(l_discount)) AS adj_close
    FROM ticks GROUP BY {keys}))"""


PRELUDE = (
    """WITH ticks AS (
  SELECT *, 'S' || CAST(l_partkey % 9 AS VARCHAR) AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
         l_extendedprice / l_quantity AS price FROM lineitem), """
    + _bars_sql("bars", "symbol, date", "symbol,")
    + ", "
    + _bars_sql("mkt", "date", "")
    + """, r AS (SELECT *, close / lag(close) OVER w - 1 AS r FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
  cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS session_no FROM (SELECT DISTINCT date FROM bars)) """
)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles at a fixed number of digits, so that the order of a sum's terms doesn't show."""
    return df.select(*[F.round(F.col(f"`{c}`"), DIGITS).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def query(name: str, sql: str | None = None, doubles: str = "", prelude: bool = True):
    """Registers a query; doubles: the SQL's columns to round."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            fields = doubles.split()
            replace = f" REPLACE ({', '.join(f'round({c}, {DIGITS}) AS {c}' for c in fields)})" if fields else ""
            SQL[name] = f"{PRELUDE if prelude else ''}SELECT *{replace} FROM ({sql})"
        return f

    return add


def returns(spark, sf_dir: str) -> DataFrame:
    return B.panel(spark, sf_dir).withColumn("r", S.change("close"))


WSQL = "OVER (PARTITION BY symbol ORDER BY date)"


def _frame(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING)"


def _full(value: str, c: str, n: int) -> str:
    return f"CASE WHEN count({c}) {_frame(n)} = {n} THEN {value} {_frame(n)} END"


# 2.1 sources
@query("s9_ohlcv_weekly", "SELECT symbol, date, open, high, low, close, volume, adj_close, adj_open FROM bars", "open high low close volume adj_close adj_open")
def s9(spark, d):
    return B.panel(spark, d)


@query("s9_ohlcv_daily", f"""SELECT symbol, CAST(date_trunc('day', l_shipdate) AS DATE) AS date, first(price ORDER BY {_ORDER}) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY {_ORDER}) AS close, sum(l_quantity) AS volume FROM ticks GROUP BY ALL""", "open high low close volume")
def s9d(spark, d):
    return B.panel(spark, d, "day").drop("adj_close", "adj_open")


_ROW = " || '|' || ".join(f"coalesce(CAST({f'CAST(round({c} * 10000.0::DOUBLE) AS HUGEINT)' if c not in ('symbol', 'date') else c} AS VARCHAR), 'null')" for c in "symbol date open high low close volume adj_close adj_open".split())
_ROW_HASH = f"CAST('0x' || substr(md5({_ROW}), 1, 15) AS BIGINT)"


@query("s2_manifest", f"SELECT count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, string_agg(DISTINCT symbol, ',' ORDER BY symbol) AS symbols, bit_xor({_ROW_HASH}) AS fingerprint, CAST(sum({_ROW_HASH}) AS VARCHAR) AS fingerprint_sum FROM bars")
def s2(spark, d):
    return B.manifest(B.panel(spark, d).select("symbol", "date", "open", "high", "low", "close", "volume", "adj_close", "adj_open"))


def charts(spark, d):
    """The bars written as one JSON payload a symbol; those of S1 to S4 are truncated, of another symbol, currency and type."""
    b = B.panel(spark, d).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("date", "open", "high", "low", "close", "volume", "adj_close"))).alias("x"))
    noon = F.transform("x", lambda e: F.unix_date(e["date"]) * 86_400 + 17 * 3600)  # noon or 13 h in New York
    name = F.when(F.col("symbol") == "S2", "X2").otherwise(F.col("symbol"))
    meta = F.struct(name.alias("symbol"), F.when(F.col("symbol") == "S3", "EUR").otherwise("USD").alias("currency"), F.when(F.col("symbol") == "S4", "INDEX").otherwise("EQUITY").alias("instrumentType"))
    quote = F.struct(*[F.col(f"x.{c}").alias(c) for c in ("open", "high", "low", "close", "volume")])
    result = F.struct(meta.alias("meta"), noon.alias("timestamp"), F.struct(F.array(quote).alias("quote"), F.array(F.struct(F.col("x.adj_close").alias("adjclose"))).alias("adjclose")).alias("indicators"))
    text = F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart")))
    path = B.fresh_path(spark, "charts")
    b.select(F.when(F.col("symbol") == "S1", F.substr(text, F.lit(1), F.length(text) - 9)).otherwise(text).alias("value"), F.col("symbol").alias("requested")).write.partitionBy("requested").text(path)
    return B.read_charts(spark, path)


@query("s1_chart_bars", "SELECT symbol, date, open, high, low, close, volume, adj_close, open * adj_close / close AS adj_open FROM bars WHERE symbol NOT IN ('S1', 'S2', 'S3', 'S4') AND date BETWEEN DATE '1995-03-01' AND DATE '2001-05-31'", "open high low close volume adj_close adj_open")
def s1(spark, d):
    return B.chart_bars(charts(spark, d)[0], "1995-03-01", "2001-05-31")


@query("s1_rejected_charts", "SELECT requested, reason FROM (VALUES ('S1', 'corrupt'), ('S2', 'symbol'), ('S3', 'currency'), ('S4', 'type')) AS v(requested, reason) WHERE requested IN (SELECT symbol FROM bars)")
def s1_rejected(spark, d):
    return charts(spark, d)[1]


@query("s3_verify_files", "SELECT name, issue FROM (VALUES ('S0.txt', 'differs'), ('S1.txt', 'not listed'), ('gone.txt', 'no file')) AS v(name, issue)")
def s3(spark, d):
    """Files of the bars' symbols against their digests, with one changed, one not listed and one listed without a file."""
    files = B.kept(B.panel(spark, d).groupBy("symbol").agg(F.concat_ws("|", F.array_sort(F.collect_list(F.concat_ws(",", F.col("date").cast("string"), F.round("close", 4).cast("string"))))).alias("value")), "files")
    path = B.fresh_path(spark, "digests")
    files.select(F.concat(F.col("value"), F.when(F.col("symbol") == "S0", " ").otherwise("")).alias("value"), "symbol").write.partitionBy("symbol").text(path)
    listed = files.filter("symbol <> 'S1'").select(F.concat("symbol", F.lit(".txt")).alias("name"), F.sha2(F.concat("value", F.lit("\n")), 256).alias("sha256"))
    listed = listed.unionByName(spark.range(1).select(F.lit("gone.txt").alias("name"), F.sha2(F.lit(""), 256).alias("sha256")))
    return B.verify_files(spark, path, listed, F.concat(F.regexp_extract("path", "symbol=([^/]*)/", 1), F.lit(".txt")))


@query("p17_finite_or_null", "SELECT l_orderkey, l_linenumber, log10(CASE WHEN isfinite(x) THEN x END) AS magnitude FROM (SELECT l_orderkey, l_linenumber, pow(CAST(10 AS DOUBLE), l_quantity * 10) AS x FROM lineitem)", "magnitude")
def p17(spark, d):
    return B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.log10(S.finite(F.pow(F.lit(10.0), F.col("l_quantity").cast("double") * 10))).alias("magnitude"))


@query("s4_stored_bars", "SELECT symbol, date, open, high, low, close, volume, adj_close, adj_open FROM bars", "open high low close volume adj_close adj_open")
def s4(spark, d):
    path = B.fresh_path(spark, "bars")
    B.panel(spark, d).write.parquet(path)
    return B.read_bars(spark, path)


@query("s4_bars_by_symbol", f"SELECT symbol, date, close / lag(close, 1) {WSQL} - 1 AS r1, lead(open, 6) {WSQL} / lead(open, 1) {WSQL} - 1 AS label, sum(volume) {WSQL} AS traded, avg(close) OVER (PARTITION BY symbol, year(date)) AS year_mean FROM bars", "r1 label traded year_mean")
def s4_by_symbol(spark, d):
    """Windows by symbol, and by symbol and year, of one stored table: one scan of the trades, no shuffle after it."""
    w = W.partitionBy("symbol").orderBy("date")
    year = F.avg("close").over(W.partitionBy("symbol", F.year("date")))
    return B.kept_panel(spark, d).select("symbol", "date", S.change("close", 1).alias("r1"), S.forward_label(5).alias("label"), F.sum("volume").over(w).alias("traded"), year.alias("year_mean"))


# 2.2 checks
@query("v1_invalid_values", "SELECT event_id, 'value' AS field FROM events WHERE value IS NULL OR NOT isfinite(value) OR value <= 10", prelude=False)
def v1(spark, d):
    e = B.table(spark, d, "events")
    shifted = e.select(F.col("event_id").alias("symbol"), F.col("ts").alias("date"), (F.col("value") - 10).alias("value"))
    return V.invalid_values(shifted, ("value",)).select(F.col("symbol").alias("event_id"), "field")


@query("v2_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1", prelude=False)
def v2(spark, d):
    return V.duplicate_keys(B.table(spark, d, "lineitem"), ("l_orderkey", "l_linenumber"))


@query("v3_ohlc_geometry", "SELECT symbol, date FROM bars WHERE high * 0.9 + 0.00001 * close < greatest(open, close, low) OR low - 0.00001 * close > least(open, close, high * 0.9)")
def v3(spark, d):
    return V.ohlc_geometry(B.panel(spark, d).withColumn("high", F.col("high") * 0.9))


_BRANDS = "brands AS (SELECT p_brand AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS date FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"


def brand_bars(spark, d):
    t = B.table(spark, d, "lineitem").join(B.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return t.select(F.col("p_brand").alias("symbol"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("date")).distinct()


@query("v4_session_gaps", f"WITH {_BRANDS}, a AS (SELECT symbol, min(date) a, max(date) z FROM brands GROUP BY symbol) SELECT symbol, date FROM a, (SELECT DISTINCT date FROM brands) c WHERE date BETWEEN a AND z EXCEPT SELECT symbol, date FROM brands", prelude=False)
def v4(spark, d):
    b = B.kept(brand_bars(spark, d), "brands")
    return V.session_gaps(b, b.select("date").distinct(), own_range=True)


@query("v5_panel_completeness", f"WITH {_BRANDS} SELECT s.symbol, c.date FROM (SELECT symbol FROM brands UNION SELECT 'Brand#' || CAST(n_nationkey AS VARCHAR) FROM nation) s, (SELECT DISTINCT date FROM brands) c EXCEPT SELECT symbol, date FROM brands", prelude=False)
def v5(spark, d):
    b = B.kept(brand_bars(spark, d), "brands")
    asked = b.select("symbol").unionByName(B.table(spark, d, "nation").select(F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string")).alias("symbol")))
    return V.session_gaps(b, b.select("date").distinct(), symbols=asked)


@query("v6_adjustment_identity", "SELECT max(abs(adj_open - open * adj_close / close)) AS max_error, min(adj_close / close) AS min_factor, max(adj_close / close) AS max_factor FROM bars", "max_error min_factor max_factor")
def v6(spark, d):
    return V.adjustment_identity(B.panel(spark, d))


@query("v8_holdout_cutoff", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate < DATE '1996-01-01'", "o_totalprice", prelude=False)
def v8(spark, d):
    return V.before(B.table(spark, d, "orders"), "1996-01-01", "o_orderdate").select("o_orderkey", "o_totalprice")


@query("v9_matched_dates", "WITH a AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem WHERE l_partkey % 9 = 1), b AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem WHERE l_partkey % 9 = 2) SELECT coalesce(a.date, b.date) AS date, CASE WHEN a.date IS NULL THEN 'b' ELSE 'a' END AS only_in FROM a FULL JOIN b ON a.date = b.date WHERE a.date IS NULL OR b.date IS NULL", prelude=False)
def v9(spark, d):
    b = B.panel(spark, d, "day")
    return V.matched_dates(b.filter("symbol = 'S1'"), b.filter("symbol = 'S2'"))


@query("v10_weight_invariants", "SELECT date, sum(w) AS total, min(w) AS least, max(w) AS most, count(*) FILTER (w IS NULL) AS missing FROM (SELECT date, r * 4 AS w FROM r) GROUP BY date HAVING sum(w) > 1 + 1e-9 OR min(w) < 0 OR max(w) > 0.4 + 1e-9 OR count(*) FILTER (w IS NULL) > 0", "total least most")
def v10(spark, d):
    return V.weight_invariants(returns(spark, d).select("date", (F.col("r") * 4).alias("weight")), 0.4)


@query("v13_difference", "SELECT symbol, date, side FROM ((SELECT symbol, date, 'a' AS side FROM (SELECT symbol, date FROM bars EXCEPT ALL SELECT symbol, date FROM bars WHERE volume > 100)) UNION ALL (SELECT symbol, date, 'b' AS side FROM (SELECT symbol, date FROM bars WHERE volume > 100 EXCEPT ALL SELECT symbol, date FROM bars)))")
def v13(spark, d):
    b = B.panel(spark, d)
    return V.difference(b.select("symbol", "date"), b.filter("volume > 100").select("symbol", "date"))


@query("v13_within_tolerance", """WITH a AS (SELECT symbol, date, close, volume FROM bars WHERE volume % 11 <> 0), b AS (SELECT symbol, date, close + CASE WHEN volume % 3 = 0 THEN 0.01 WHEN volume % 2 = 0 THEN 1e-9 ELSE 0 END AS close, CASE WHEN volume % 13 <> 0 THEN volume END AS volume FROM bars),
 x AS (SELECT symbol, date, unnest(['close', 'volume']) AS "column", unnest([a.close, a.volume]) AS a, unnest([b.close, b.volume]) AS b FROM a FULL JOIN b USING (symbol, date)) SELECT * FROM x WHERE coalesce(abs(a - b) > 1e-6, a IS DISTINCT FROM b)""", "a b")
def v13_within(spark, d):
    x = B.panel(spark, d).select("symbol", "date", "close", "volume")
    v = F.col("volume")
    y = x.select("symbol", "date", (F.col("close") + F.when(v % 3 == 0, 0.01).when(v % 2 == 0, 1e-9).otherwise(0.0)).alias("close"), F.when(v % 13 != 0, v).alias("volume"))
    return V.difference_within(x.filter(v % 11 != 0), y, ("symbol", "date"), ("close", "volume"), 1e-6)


@query("v14_liquidity_breach", f"WITH x AS (SELECT symbol, date, volume * close / nullif({_full('avg(volume * close)', 'volume * close', 5)}, 0) AS ratio FROM bars) SELECT date, max(ratio) AS ratio, arg_max(symbol, (ratio, symbol)) AS symbol FROM x WHERE ratio IS NOT NULL GROUP BY date HAVING max(ratio) > 1.5", "ratio")
def v14(spark, d):
    b = B.panel(spark, d).withColumn("notional", F.col("volume") * F.col("close"))
    return V.liquidity_breach(b.withColumn("adv", S.mean("notional", 5)).filter("adv is not null"), 1.5)


# 2.3 projections
@query("p2_day_location", "SELECT symbol, date, (close - low) / nullif(high - low, 0) AS location FROM bars", "location")
def p2(spark, d):
    return B.panel(spark, d).select("symbol", "date", ((F.col("close") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))).alias("location"))


@query("p3_clipped_log_ratio", f"SELECT symbol, date, CASE WHEN m IS NOT NULL THEN ln(greatest(0.9, least(1.1, volume / m))) END AS x FROM (SELECT *, {_full('avg(volume)', 'volume', 20)} AS m FROM bars)", "x")
def p3(spark, d):
    b = B.panel(spark, d).withColumn("m", S.mean("volume", 20))
    return b.select("symbol", "date", F.when(F.col("m").isNotNull(), F.log(F.greatest(F.lit(0.9), F.least(F.lit(1.1), F.col("volume") / F.col("m"))))).alias("x"))


@query("p6_regime", f"SELECT symbol, date, CASE WHEN lag(trend) {WSQL} > 0 THEN 'bull' ELSE 'bear' END AS regime FROM (SELECT *, close / {_full('avg(close)', 'close', 20)} - 1 AS trend FROM bars)")
def p6(spark, d):
    t = B.panel(spark, d).withColumn("trend", F.col("close") / S.mean("close", 20) - 1)
    return t.select("symbol", "date", F.when(F.lag("trend").over(S.ws()) > 0, "bull").otherwise("bear").alias("regime"))


@query("p9_tick_round", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN (micro + 49999) // 50000 ELSE micro // 50000 END AS ticks FROM (SELECT *, CAST(CAST(l_extendedprice AS DECIMAL(18,6)) * 1000000 AS BIGINT) AS micro FROM lineitem)", prelude=False)
def p9(spark, d):
    n = F.col("l_extendedprice").cast("decimal(18,6)") / F.lit("0.05").cast("decimal(18,6)")
    return B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_returnflag") == "R", F.ceil(n)).otherwise(F.floor(n)).cast("long").alias("ticks"))


@query("p10_fee_bound", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(1.0, 0.005 * l_quantity, l_extendedprice * 0.0005) AS fee FROM lineitem", "fee", prelude=False)
def p10(spark, d):
    fee = F.greatest(F.lit(1.0), 0.005 * F.col("l_quantity"), F.col("l_extendedprice") * 0.0005)
    return B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", fee.alias("fee"))


@query("p13_redact", r"SELECT event_id, regexp_replace(props, '([0-9])[0-9]', '\1*', 'g') AS props FROM events", prelude=False)
def p13(spark, d):
    return B.table(spark, d, "events").select("event_id", F.regexp_replace("props", "([0-9])[0-9]", "$1*").alias("props"))


# 2.4 windows by symbol
@query("w1_simple_return", f"SELECT symbol, date, close / lag(close, 1) {WSQL} - 1 AS r1, close / lag(close, 5) {WSQL} - 1 AS r5, close / lag(close, 21) {WSQL} - 1 AS r21 FROM bars", "r1 r5 r21")
def w1(spark, d):
    return B.panel(spark, d).select("symbol", "date", S.change("close", 1).alias("r1"), S.change("close", 5).alias("r5"), S.change("close", 21).alias("r21"))


@query("w2_gap", f"SELECT symbol, date, gap, {_full('avg(gap)', 'gap', 20)} AS gap_20 FROM (SELECT *, open / lag(close) {WSQL} - 1 AS gap FROM bars)", "gap gap_20")
def w2(spark, d):
    return S.gap(B.panel(spark, d)).select("symbol", "date", "gap", "gap_20")


@query("w3_w4_rolling", f"SELECT symbol, date, {_full('avg(close)', 'close', 20)} AS sma_20, {_full('stddev_samp(r)', 'r', 20)} AS std_20, {_full('stddev_pop(close)', 'close', 20)} AS pop_20 FROM r", "sma_20 std_20 pop_20")
def w3(spark, d):
    return returns(spark, d).select("symbol", "date", S.mean("close", 20).alias("sma_20"), S.std("r", 20).alias("std_20"), S.std("close", 20, 0).alias("pop_20"))


_BETA = f"""SELECT symbol, date, beta, r - beta * r_mkt AS residual FROM (
  SELECT *, CASE WHEN count(r + r_mkt) {_frame(60)} = 60 THEN covar_samp(r, r_mkt) {_frame(60)} / nullif(var_samp(r_mkt) {_frame(60)}, 0) END AS beta
  FROM r JOIN (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS r_mkt FROM mkt) USING (date))"""


@query("w5_w6_beta_residual", _BETA, "beta residual")
def w5(spark, d):
    m = B.benchmark(spark, d).select("date", (F.col("close") / F.lag("close").over(W.orderBy("date")) - 1).alias("r_mkt"))
    return S.beta(S.with_benchmark(returns(spark, d), m)).select("symbol", "date", "beta", "residual")


@query("w7_channel", f"SELECT symbol, date, close / {_full('max(high)', 'high', 26)} - 1 AS breakout, {_full('min(low)', 'low', 26)} AS low_26 FROM bars", "breakout low_26")
def w7(spark, d):
    return B.panel(spark, d).select("symbol", "date", (F.col("close") / S.high("high", 26) - 1).alias("breakout"), S.low("low", 26).alias("low_26"))


@query("w8_momentum_skip", f"SELECT symbol, date, lag(close, 5) {WSQL} / lag(close, 63) {WSQL} - 1 AS momentum, (close / lag(close, 21) {WSQL} - 1) - (close / lag(close, 63) {WSQL} - 1) / 3 AS acceleration FROM bars", "momentum acceleration")
def w8(spark, d):
    return B.panel(spark, d).select("symbol", "date", (F.lag("close", 5).over(S.ws()) / F.lag("close", 63).over(S.ws()) - 1).alias("momentum"), (S.change("close", 21) - S.change("close", 63) / 3).alias("acceleration"))


@query("w14_percentile_rank", f"SELECT symbol, date, CASE WHEN n = 60 THEN (len(list_filter(w, lambda x: x < close)) + (len(list_filter(w, lambda x: x = close)) + 1) / 2.0) / 60 END AS pct FROM (SELECT symbol, date, close, list(close) {_frame(60)} AS w, count(close) {_frame(60)} AS n FROM bars)", "pct")
def w14(spark, d):
    return B.panel(spark, d).select("symbol", "date", S.percentile_rank("close", 60).alias("pct"))


@query("w15_bollinger", f"SELECT symbol, date, centre, centre + 2 * sigma AS upper, centre - 2 * sigma AS lower, (close - (centre - 2 * sigma)) / nullif(4 * sigma, 0) AS pct_b, 4 * sigma / centre AS bandwidth FROM (SELECT *, {_full('avg(close)', 'close', 20)} AS centre, {_full('stddev_pop(close)', 'close', 20)} AS sigma FROM bars)", "centre upper lower pct_b bandwidth")
def w15(spark, d):
    return S.bollinger(B.panel(spark, d)).select("symbol", "date", "centre", "upper", "lower", "pct_b", "bandwidth")


def _mid(n: int) -> str:
    return f"({_full('max(high)', 'high', n)} + {_full('min(low)', 'low', n)}) / 2"


@query("w16_ichimoku", f"SELECT symbol, date, tenkan, kijun, span_a, span_b, CASE WHEN span_a + span_b IS NOT NULL THEN greatest(span_a, span_b) END AS cloud_top, CASE WHEN span_a + span_b IS NOT NULL THEN least(span_a, span_b) END AS cloud_bottom FROM (SELECT *, (tenkan + kijun) / 2 AS span_a FROM (SELECT symbol, date, {_mid(9)} AS tenkan, {_mid(26)} AS kijun, {_mid(52)} AS span_b FROM bars))", "tenkan kijun span_a span_b cloud_top cloud_bottom")
def w16(spark, d):
    return S.ichimoku(B.panel(spark, d)).select("symbol", "date", "tenkan", "kijun", "span_a", "span_b", "cloud_top", "cloud_bottom")


def _pct_rank(c: str, n: int = 126) -> str:
    """The rank of c among the last n values as a share, over a row with the list w_c of these."""
    return f"CASE WHEN len(w_{c}) = {n} AND len(list_filter(w_{c}, lambda x: x IS NOT NULL)) = {n} THEN (len(list_filter(w_{c}, lambda x: x < {c})) + (len(list_filter(w_{c}, lambda x: x = {c})) + 1) / 2.0) / {n} END"


@query("w15_band_distances", f"""SELECT symbol, date, {_pct_rank('bandwidth')} AS bandwidth_percentile, expansion, -expansion AS contraction, (close - centre) / nullif(sigma, 0) AS distance_centre, (close - centre - 2 * sigma) / nullif(sigma, 0) AS distance_upper, (close - centre + 2 * sigma) / nullif(sigma, 0) AS distance_lower FROM
 (SELECT *, bandwidth - lag(bandwidth) {WSQL} AS expansion, list(bandwidth) {_frame(126)} AS w_bandwidth FROM (SELECT *, 4 * sigma / centre AS bandwidth FROM (SELECT *, {_full('avg(close)', 'close', 20)} AS centre, {_full('stddev_pop(close)', 'close', 20)} AS sigma FROM bars)))""", "bandwidth_percentile expansion contraction distance_centre distance_upper distance_lower")
def w15_distances(spark, d):
    return S.band_distances(S.bollinger(B.panel(spark, d))).select("symbol", "date", "bandwidth_percentile", "expansion", "contraction", "distance_centre", "distance_upper", "distance_lower")


_CLOUD = "cloud_distance cloud_thickness cloud_thickness_percentile cloud_slope tenkan_kijun tenkan_kijun_atr trend_persistence breakout_persistence chikou_comparison"


@query("w16_cloud_state", f"""WITH a AS (SELECT symbol, date, close, {_mid(9)} AS tenkan, {_mid(26)} AS kijun, {_mid(52)} AS span_b, CASE WHEN prev IS NOT NULL THEN greatest(high - low, abs(high - prev), abs(low - prev)) END AS tr, close / lag(close, 26) {WSQL} - 1 AS chikou_comparison FROM (SELECT *, lag(close) {WSQL} AS prev FROM bars)),
 b AS (SELECT *, (tenkan + kijun) / 2 AS span_a, nullif({_full('avg(tr)', 'tr', 14)}, 0) AS atr FROM a),
 c AS (SELECT *, CASE WHEN span_a + span_b IS NOT NULL THEN greatest(span_a, span_b) END AS top, CASE WHEN span_a + span_b IS NOT NULL THEN least(span_a, span_b) END AS bottom, ((span_a + span_b) / 2 - lag((span_a + span_b) / 2, 5) {WSQL}) / atr AS cloud_slope FROM b),
 e AS (SELECT *, (top - bottom) / atr AS cloud_thickness, CASE WHEN top IS NOT NULL THEN CASE WHEN close > top THEN 1.0 ELSE 0.0 END END AS above FROM c),
 f AS (SELECT *, list(cloud_thickness) {_frame(126)} AS w_cloud_thickness, {_full('avg(above)', 'above', 20)} AS trend_persistence, {_full('avg(above)', 'above', 5)} AS breakout_persistence FROM e)
 SELECT symbol, date, (close - top) / atr AS cloud_distance, cloud_thickness, {_pct_rank('cloud_thickness')} AS cloud_thickness_percentile, cloud_slope, tenkan - kijun AS tenkan_kijun, (tenkan - kijun) / atr AS tenkan_kijun_atr, trend_persistence, breakout_persistence, chikou_comparison FROM f""", _CLOUD)
def w16_state(spark, d):
    return S.cloud_state(B.panel(spark, d)).select("symbol", "date", *_CLOUD.split())


@query("w17_atr", f"SELECT symbol, date, {_full('avg(tr)', 'tr', 14)} AS atr FROM (SELECT *, CASE WHEN prev IS NOT NULL THEN greatest(high - low, abs(high - prev), abs(low - prev)) END AS tr FROM (SELECT *, lag(close) {WSQL} AS prev FROM bars))", "atr")
def w17(spark, d):
    return S.atr(B.panel(spark, d)).select("symbol", "date", "atr")


@query("w18_persistence", f"SELECT symbol, date, {_full('avg(CAST(up AS INTEGER))', 'up', 20)} AS share FROM (SELECT *, r > 0 AS up FROM r)", "share")
def w18(spark, d):
    return returns(spark, d).withColumn("up", F.col("r") > 0).select("symbol", "date", S.persistence("up", 20).alias("share"))


@query("w20_session_legs", f"SELECT symbol, date, open / prev - 1 AS overnight, close / open - 1 AS intraday, close / prev - 1 AS close_close FROM (SELECT *, lag(close) {WSQL} AS prev FROM bars)", "overnight intraday close_close")
def w20(spark, d):
    return S.session_legs(B.panel(spark, d)).select("symbol", "date", "overnight", "intraday", "close_close")


_ADJUSTED = f"""SELECT *, adjusted_overnight + 1 - (raw_overnight + 1) * ratio AS factor_overnight_residual, adjusted_close_close + 1 - (raw_close_close + 1) * ratio AS factor_close_close_residual, adjusted_intraday - raw_intraday AS factor_intraday_residual, ln(ratio) AS adjustment_log_effect FROM
 (SELECT symbol, date, open / prev - 1 AS raw_overnight, close / open - 1 AS raw_intraday, close / prev - 1 AS raw_close_close, adj_open / adj_prev - 1 AS adjusted_overnight, adj_close / adj_open - 1 AS adjusted_intraday, adj_close / adj_prev - 1 AS adjusted_close_close, (adj_close / close) / (adj_prev / prev) AS ratio FROM (SELECT *, lag(close) {WSQL} AS prev, lag(adj_close) {WSQL} AS adj_prev FROM bars))"""
_LEG_NAMES = [f"{s}_{x}" for s in ("raw", "adjusted") for x in ("overnight", "intraday", "close_close")]
_ADJUSTED_NAMES = [*_LEG_NAMES, "factor_overnight_residual", "factor_close_close_residual", "factor_intraday_residual", "adjustment_log_effect"]


@query("w20_adjusted_legs", f"SELECT symbol, date, {', '.join(_ADJUSTED_NAMES)} FROM ({_ADJUSTED})", " ".join(_ADJUSTED_NAMES))
def w20_adjusted(spark, d):
    return S.adjusted_legs(B.panel(spark, d)).select("symbol", "date", *_ADJUSTED_NAMES)


@query("a13_adjusted_legs", f"SELECT symbol, {', '.join(f'sum(ln(1 + {x})) AS {x}' for x in _LEG_NAMES)}, sum(adjustment_log_effect) AS adjustment_log_effect, 0.0 AS max_residual, sum(ln(1 + raw_overnight)) / nullif(sum(ln(1 + raw_close_close)), 0) AS raw_overnight_share, sum(ln(1 + adjusted_overnight)) / nullif(sum(ln(1 + adjusted_close_close)), 0) AS adjusted_overnight_share FROM ({_ADJUSTED}) WHERE raw_close_close IS NOT NULL GROUP BY symbol", " ".join([*_LEG_NAMES, "adjustment_log_effect", "max_residual", "raw_overnight_share", "adjusted_overnight_share"]))
def a13_adjusted(spark, d):
    return E.leg_summary(S.adjusted_legs(B.panel(spark, d)))


_LABEL = f"SELECT symbol, date, lead(open, 6) {WSQL} / lead(open, 1) {WSQL} - 1 AS label FROM bars"


@query("w21_forward_label", _LABEL, "label")
def w21(spark, d):
    return B.panel(spark, d).select("symbol", "date", S.forward_label(5).alias("label"))


@query("w22_demeaned_label", f"SELECT symbol, date, greatest(-0.5, least(0.5, label - avg(label) OVER (PARTITION BY date))) AS label FROM ({_LABEL}) WHERE label IS NOT NULL", "label")
def w22(spark, d):
    p = w21(spark, d).filter("label is not null")
    return p.select("symbol", "date", F.greatest(F.lit(-0.5), F.least(F.lit(0.5), X.demeaned("label"))).alias("label"))


@query("w23_timing", "SELECT date, lead(date, 1) OVER (ORDER BY date) AS entry_date, lead(date, 2) OVER (ORDER BY date) AS exit_date FROM cal")
def w23(spark, d):
    w = W.orderBy("date")
    return B.sessions(B.panel(spark, d)).select("date", F.lead("date", 1).over(w).alias("entry_date"), F.lead("date", 2).over(w).alias("exit_date"))


_NAV = "SELECT symbol, date, r, product(1 + r) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS nav FROM r WHERE r IS NOT NULL"


@query("w25_w26_wealth_drawdown", f"SELECT symbol, date, nav, nav / greatest(1, max(nav) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)) - 1 AS drawdown FROM ({_NAV})", "nav drawdown")
def w25(spark, d):
    n = returns(spark, d).filter("r is not null").withColumn("nav", S.wealth())
    return n.select("symbol", "date", "nav", S.drawdown().alias("drawdown"))


_OUT = f"SELECT symbol, date, CASE WHEN count(r) {_frame(20)} = 20 THEN product(1 + r) {_frame(20)} - 1 END AS outcome FROM r"


# The largest fall inside a window is the least ratio of a later to an earlier value in it.
_FALL = f"""WITH v AS (SELECT symbol, date, row_number() {WSQL} - 1 AS n, close FROM bars), q AS (SELECT a.symbol, a.n AS k, b.n AS j, b.close / a.close - 1 AS fall FROM v a JOIN v b ON a.symbol = b.symbol AND b.n BETWEEN a.n AND a.n + 20)
 SELECT v.symbol, v.date, min(fall) AS drawdown FROM v JOIN q ON q.symbol = v.symbol AND k >= v.n - 20 AND j <= v.n WHERE v.n >= 20 GROUP BY ALL"""


@query("w27_window_outcomes", f"SELECT symbol, date, outcome, drawdown FROM ({_OUT}) LEFT JOIN ({_FALL}) USING (symbol, date)", "outcome drawdown")
def w27(spark, d):
    return E.window_outcomes(returns(spark, d)).select("symbol", "date", "outcome", "drawdown")


@query("w28_rebalance_blocks", "SELECT date, session_no, CAST(floor((session_no - 2) / 5.0) AS BIGINT) AS block, (session_no - 2) % 5 = 0 AS is_rebalance FROM cal")
def w28(spark, d):
    return A.rebalance_blocks(B.sessions(B.panel(spark, d)), 5, 2).withColumn("session_no", F.col("session_no").cast("long"))


# 2.5 windows by date
_RANK = "rank() OVER (PARTITION BY date ORDER BY volume) + (count(*) OVER (PARTITION BY date, volume) - 1) / 2.0"


@query("x1_centred_rank", f"SELECT symbol, date, CASE WHEN n > 1 THEN 2 * (k - 1) / (n - 1) - 1 ELSE 0 END AS rank FROM (SELECT symbol, date, {_RANK} AS k, count(*) OVER (PARTITION BY date) AS n FROM bars)", "rank")
def x1(spark, d):
    return X.centred_rank(B.panel(spark, d), "volume").select("symbol", "date", "rank")


@query("x2_ranked_pct", f"SELECT symbol, date, (({_RANK}) / count(*) OVER (PARTITION BY date) - 0.5) * 2 AS pct FROM bars", "pct")
def x2(spark, d):
    return X.ranked_pct(B.panel(spark, d), "volume").select("symbol", "date", "pct")


@query("x3_demeaned", "SELECT symbol, date, r - avg(r) OVER (PARTITION BY date) AS x FROM r", "x")
def x3(spark, d):
    return returns(spark, d).select("symbol", "date", X.demeaned("r").alias("x"))


@query("x4_score_weights", f"SELECT symbol, date, (1 + 0.6 * CASE WHEN n > 1 THEN 2 * (k - 1) / (n - 1) - 1 ELSE 0 END) / n AS weight FROM (SELECT symbol, date, {_RANK} AS k, count(*) OVER (PARTITION BY date) AS n FROM bars)", "weight")
def x4(spark, d):
    return X.score_weights(B.panel(spark, d), "volume").select("symbol", "date", "weight")


_TOP = "SELECT symbol, date, CASE WHEN above + ties <= n THEN 1.0 / n WHEN above < n THEN (n - above) * 1.0 / n / ties ELSE 0 END AS weight FROM (SELECT symbol, date, rank() OVER (PARTITION BY date ORDER BY volume DESC) - 1 AS above, count(*) OVER (PARTITION BY date, volume) AS ties, least(3, count(*) OVER (PARTITION BY date)) AS n FROM bars)"


@query("x5_top_weights", _TOP, "weight")
def x5(spark, d):
    return X.top_weights(B.panel(spark, d), "volume", 3).select("symbol", "date", "weight")


@query("x6_target_weights", "SELECT symbol, date, place, 0.995 * w / sum(w) OVER (PARTITION BY date) AS weight FROM (SELECT *, 1.5 - (place - 1) / 3.0 AS w FROM (SELECT symbol, date, CAST(row_number() OVER (PARTITION BY date ORDER BY volume DESC, symbol) AS INTEGER) AS place FROM bars) WHERE place <= 4)", "weight")
def x6(spark, d):
    return X.target_weights(B.panel(spark, d), "volume", 4).select("symbol", "date", "place", "weight")


_SCORED = f"SELECT s.symbol, s.date, score, label FROM (SELECT symbol, date, close / lag(close, 5) {WSQL} - 1 AS score FROM bars) s JOIN ({_LABEL}) l ON s.symbol = l.symbol AND s.date = l.date WHERE score IS NOT NULL AND label IS NOT NULL"


def scored(spark, d):
    return B.panel(spark, d).select("symbol", "date", S.change("close", 5).alias("score"), S.forward_label(5).alias("label"))


@query("x8_quantile_spread", f"SELECT date, avg(label) FILTER (p > 0.8) - avg(label) FILTER (p <= 0.2) AS spread FROM (SELECT *, (rank() OVER (PARTITION BY date ORDER BY score) + (count(*) OVER (PARTITION BY date, score) - 1) / 2.0) / count(*) OVER (PARTITION BY date) AS p FROM ({_SCORED})) GROUP BY date", "spread")
def x8(spark, d):
    return X.quantile_spread(scored(spark, d), "score", "label")


_IC = f"SELECT date, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS ic, count(*) AS n FROM (SELECT date, rank() OVER (PARTITION BY date ORDER BY score) + (count(*) OVER (PARTITION BY date, score) - 1) / 2.0 AS a, rank() OVER (PARTITION BY date ORDER BY label) + (count(*) OVER (PARTITION BY date, label) - 1) / 2.0 AS b FROM ({_SCORED})) GROUP BY date"


@query("a9_rank_ic", _IC, "ic")
def a9(spark, d):
    return X.rank_ic(scored(spark, d), "score", "label")


@query("a10_ic_summary", f"SELECT year(date) AS year, count(*) AS n, avg(ic) AS mean, stddev_samp(ic) AS std, quantile_cont(ic, 0.05) AS q05, quantile_cont(ic, 0.5) AS median, quantile_cont(ic, 0.95) AS q95, avg(CASE WHEN ic > 1e-12 THEN 1.0 ELSE 0.0 END) AS share_positive FROM ({_IC}) WHERE ic IS NOT NULL GROUP BY year(date)", "mean std q05 median q95 share_positive")
def a10(spark, d):
    return E.ic_summary(a9(spark, d).withColumn("year", F.year("date").cast("long")))


# 2.6 joins
@query("j4_bitemporal_asof", "WITH f AS (SELECT o_custkey AS symbol, o_orderdate AS effective_at, o_orderdate + to_days(CAST(o_orderkey % 30 AS INTEGER)) AS known_at, o_totalprice AS value FROM orders), d AS (SELECT DISTINCT o_custkey AS symbol, TIMESTAMP '1996-01-01' AS decision_at FROM orders UNION SELECT DISTINCT o_custkey, TIMESTAMP '1997-06-01' FROM orders) SELECT d.symbol, d.decision_at, arg_max(value, (effective_at, known_at, value)) AS value FROM d LEFT JOIN f ON f.symbol = d.symbol AND effective_at <= decision_at AND known_at <= decision_at GROUP BY ALL", "value", prelude=False)
def j4(spark, d):
    o = B.table(spark, d, "orders")
    known = F.expr("o_orderdate + make_dt_interval(cast(o_orderkey % 30 as int))")
    facts = o.select(F.col("o_custkey").alias("symbol"), F.col("o_orderdate").alias("effective_at"), known.alias("known_at"), F.col("o_totalprice").alias("value"))
    at = F.explode(F.array(*[F.lit(t).cast("timestamp_ntz") for t in ("1996-01-01", "1997-06-01")]))
    return J.bitemporal_asof(facts, o.select(F.col("o_custkey").alias("symbol")).distinct().select("symbol", at.alias("decision_at")))


@query("j8_position_diff", "WITH e AS (SELECT l_suppkey AS symbol, sum(l_quantity) AS q FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), a AS (SELECT l_suppkey AS symbol, sum(l_quantity) AS q FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) SELECT coalesce(e.symbol, a.symbol) AS symbol, coalesce(e.q, 0) AS expected, coalesce(a.q, 0) AS actual FROM e FULL JOIN a ON e.symbol = a.symbol WHERE coalesce(e.q, 0) <> coalesce(a.q, 0)", "expected actual", prelude=False)
def j8(spark, d):
    side = lambda s: B.table(spark, d, "lineitem").filter(F.col("l_linestatus") == s).groupBy(F.col("l_suppkey").alias("symbol")).agg(F.sum("l_quantity").alias("quantity"))
    return J.position_diff(side("O"), side("F"))


@query("j10_fifo_lots", f"WITH f AS (SELECT symbol, l_returnflag = 'R' AS sell, price, l_quantity AS q, sum(l_quantity) OVER (PARTITION BY symbol, l_returnflag = 'R' ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) AS z FROM ticks) SELECT b.symbol, count(*) AS lots, sum(least(b.z, s.z) - greatest(b.z - b.q, s.z - s.q)) AS units, sum((least(b.z, s.z) - greatest(b.z - b.q, s.z - s.q)) * (s.price - b.price)) AS pnl FROM f b JOIN f s ON b.symbol = s.symbol AND NOT b.sell AND s.sell AND least(b.z, s.z) > greatest(b.z - b.q, s.z - s.q) GROUP BY b.symbol", "units pnl")
def j10(spark, d):
    return J.fifo_lots(B.ticks(spark, d), F.date_trunc("month", "ts")).groupBy("symbol").agg(F.count("*").alias("lots"), F.sum("units").alias("units"), F.sum("pnl").alias("pnl"))


_RUNS = f"SELECT symbol, l_returnflag = 'R' AS sell, price, date, l_quantity AS q, sum(l_quantity) OVER (PARTITION BY symbol, l_returnflag = 'R' ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) AS z FROM ticks"
_OUTCOMES = f"""SELECT b.symbol, b.date AS entry_date, s.date AS exit_date, least(b.z, s.z) - greatest(b.z - b.q, s.z - s.q) AS units, b.price * 1.001 AS basis, s.price * 0.999 AS proceeds, y.session_no - x.session_no AS held FROM ({_RUNS}) b JOIN ({_RUNS}) s ON b.symbol = s.symbol AND NOT b.sell AND s.sell AND least(b.z, s.z) > greatest(b.z - b.q, s.z - s.q) JOIN cal x ON x.date = b.date JOIN cal y ON y.date = s.date"""


def _outcomes(spark, d):
    t, week = B.ticks(spark, d), lambda c: F.to_date(F.date_trunc("week", f"{c}.l_shipdate"))
    return J.lot_outcomes(J.fifo_lots(t, F.date_trunc("month", "ts")), B.sessions(t.select(F.to_date(F.date_trunc("week", "ts")).alias("date"))), week("bought"), week("sold"), 0.001)


@query("j10_lot_outcomes", f"SELECT symbol, entry_date, exit_date, count(*) AS lots, sum(units) AS units, CAST(any_value(held) AS BIGINT) AS holding_sessions, sum(units * basis) AS cost_basis, sum(units * (proceeds - basis)) AS net_pnl, max(proceeds / basis - 1) AS best_return FROM ({_OUTCOMES}) GROUP BY ALL", "units cost_basis net_pnl best_return")
def j10_outcomes(spark, d):
    g = _outcomes(spark, d).groupBy("symbol", "entry_date", "exit_date")
    return g.agg(F.count("*").alias("lots"), F.sum("units").alias("units"), F.first("holding_sessions").cast("long").alias("holding_sessions"), F.sum("cost_basis").alias("cost_basis"), F.sum("net_pnl").alias("net_pnl"), F.max("net_return").alias("best_return"))


@query("a3_holding_period", f"SELECT symbol, sum(held * units) / nullif(sum(units), 0) AS average_holding_period, avg(proceeds / basis - 1) AS mean_return, sum(units * (proceeds - basis)) AS net_pnl FROM ({_OUTCOMES}) GROUP BY symbol", "average_holding_period mean_return net_pnl")
def a3_holding(spark, d):
    return E.holding_period(_outcomes(spark, d))


_CHAIN = """SELECT study, seq, CASE WHEN seq = 2 AND volume % 7 = 0 THEN repeat('0', 64) ELSE previous END AS previous, CASE WHEN seq = 1 AND volume % 5 = 0 THEN payload || '!' ELSE payload END AS payload, hash AS sha256 FROM (
 SELECT study, volume, unnest([0, 1, 2]) AS seq, unnest([repeat('0', 64), h0, h1]) AS previous, unnest([p0, p1, p2]) AS payload, unnest([h0, h1, h2]) AS hash FROM (SELECT *, sha256(h1 || '|' || p2) AS h2 FROM (SELECT *, sha256(h0 || '|' || p1) AS h1 FROM (SELECT *, sha256(repeat('0', 64) || '|' || p0) AS h0 FROM (
  SELECT symbol || CAST(date AS VARCHAR) AS study, CAST(volume AS BIGINT) AS volume, CAST(CAST(round(open * 100) AS BIGINT) AS VARCHAR) AS p0, CAST(CAST(round(high * 100) AS BIGINT) AS VARCHAR) AS p1, CAST(CAST(round(low * 100) AS BIGINT) AS VARCHAR) AS p2 FROM bars)))))"""


@query("l1_chain_breaks", f"SELECT study, seq, linked, intact FROM (SELECT *, previous = coalesce(lag(sha256) OVER (PARTITION BY study ORDER BY seq), repeat('0', 64)) AS linked, sha256 = sha256(previous || '|' || payload) AS intact FROM ({_CHAIN})) WHERE NOT linked OR NOT intact")
def l1(spark, d):
    """Ledgers of three entries a bar; some have a previous hash or a payload changed afterwards."""
    b = B.panel(spark, d).select(F.concat("symbol", F.col("date").cast("string")).alias("study"), F.col("volume").cast("long").alias("volume"), *[F.round(F.col(c) * 100).cast("long").cast("string").alias(f"p{i}") for i, c in enumerate(("open", "high", "low"))])
    h = lambda prev, p: F.sha2(F.concat(prev, F.lit("|"), F.col(p)), 256)
    zero = F.lit("0" * 64)
    b = b.withColumn("h0", h(zero, "p0")).withColumn("h1", h(F.col("h0"), "p1")).withColumn("h2", h(F.col("h1"), "p2"))
    entry = lambda i, prev: F.struct(F.lit(i).alias("seq"), prev.alias("previous"), F.col(f"p{i}").alias("payload"), F.col(f"h{i}").alias("sha256"))
    e = b.select("study", "volume", F.explode(F.array(entry(0, zero), entry(1, F.col("h0")), entry(2, F.col("h1")))).alias("e")).select("study", "volume", "e.*")
    e = e.withColumns({"previous": F.when((F.col("seq") == 2) & (F.col("volume") % 7 == 0), zero).otherwise(F.col("previous")), "payload": F.when((F.col("seq") == 1) & (F.col("volume") % 5 == 0), F.concat("payload", F.lit("!"))).otherwise(F.col("payload"))})
    return J.chain_breaks(e.drop("volume")).select("study", "seq", "linked", "intact")


@query("l8_order_state", "WITH f AS (SELECT l_orderkey AS k, sum(l_quantity) AS filled, sum(l_quantity * l_extendedprice) / nullif(sum(l_quantity), 0) AS average_price FROM lineitem GROUP BY 1) SELECT o_orderkey AS order_ref, coalesce(filled, 0) AS filled, average_price, CASE WHEN coalesce(filled, 0) >= 100 THEN 'FILLED' WHEN coalesce(filled, 0) > 0 THEN 'PARTIALLY_FILLED' WHEN o_orderstatus = 'O' THEN 'ACKNOWLEDGED' ELSE 'NOT_SUBMITTED' END AS state FROM orders LEFT JOIN f ON k = o_orderkey", "filled average_price", prelude=False)
def l8(spark, d):
    o = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("order_ref"), F.lit(100.0).alias("quantity"), (F.col("o_orderstatus") == "O").alias("open"))
    f = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_ref"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    return J.order_state(o, f).select("order_ref", "filled", "average_price", "state")


@query("l4_first_observed", "SELECT user_id, first(event_id ORDER BY ts, event_id) AS event_id, first(value ORDER BY ts, event_id) AS value FROM events GROUP BY user_id", "value", prelude=False)
def l4(spark, d):
    return J.first_observed(B.table(spark, d, "events").select("user_id", "ts", "event_id", "value"), "user_id", "ts").select("user_id", "event_id", "value")


@query("t4_latest_per_key", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1", "value", prelude=False)
def t4(spark, d):
    return J.latest_per_key(B.table(spark, d, "events"), ("user_id", "event_type"), ("ts", "event_id")).select("user_id", "event_type", "event_id", "value")


# 2.7 aggregations
@query("a1_return_metrics", "SELECT symbol, count(*) AS n, exp(sum(ln(1 + r))) - 1 AS total_return, pow(exp(sum(ln(1 + r))), 52.0 / count(*)) - 1 AS cagr, stddev_samp(r) * sqrt(52) AS volatility, avg(r) / nullif(stddev_samp(r), 0) * sqrt(52) AS sharpe, min(dd) AS max_drawdown FROM (SELECT *, nav / greatest(1, max(nav) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM (" + _NAV + ")) GROUP BY symbol", "total_return cagr volatility sharpe max_drawdown")
def a1(spark, d):
    return E.return_metrics(returns(spark, d), per_year=52)


@query("a2_tail_stats", "WITH q AS (SELECT symbol, skewness(r) AS skew, quantile_cont(r, 0.01) AS p01, quantile_cont(r, 0.05) AS p05, min(r) AS worst FROM r WHERE r IS NOT NULL GROUP BY symbol) SELECT q.symbol, any_value(skew) AS skew, any_value(p01) AS p01, any_value(worst) AS worst, avg(r.r) AS shortfall FROM q JOIN r ON q.symbol = r.symbol AND r.r <= p05 GROUP BY q.symbol", "skew p01 worst shortfall")
def a2(spark, d):
    return E.tail_stats(returns(spark, d))


@query("a4_outcome_stats", f"""SELECT symbol, count(*) AS n, avg(outcome) AS mean, quantile_cont(outcome, 0.5) AS median, quantile_cont(outcome, 0.75) AS p75, quantile_cont(outcome, 0.9) AS p90, quantile_cont(outcome, 0.95) AS p95, skewness(outcome) AS skew, min(outcome) AS worst, min(drawdown) AS worst_drawdown,
 avg(CASE WHEN outcome > 0 THEN 1.0 ELSE 0.0 END) AS share_positive, {", ".join(f"avg(CASE WHEN outcome > {x / 100} THEN 1.0 ELSE 0.0 END) AS share_above_{x}" for x in (5, 10, 20))}, {", ".join(f"avg(CASE WHEN outcome < -{x / 100} THEN 1.0 ELSE 0.0 END) AS share_below_{x}" for x in (5, 10))}, avg(CASE WHEN drawdown < -0.1 THEN 1.0 ELSE 0.0 END) AS share_drawdown_10
 FROM ({_OUT}) JOIN ({_FALL}) USING (symbol, date) WHERE outcome IS NOT NULL GROUP BY symbol""", "mean median p75 p90 p95 skew worst worst_drawdown share_positive share_above_5 share_above_10 share_above_20 share_below_5 share_below_10 share_drawdown_10")
def a4(spark, d):
    return E.outcome_stats(E.window_outcomes(returns(spark, d)))


@query("a5_a7_breakdown", "SELECT symbol, year(date) AS year, count(*) AS n, exp(sum(ln(1 + r))) - 1 AS total_return FROM r WHERE r IS NOT NULL GROUP BY GROUPING SETS ((symbol), (year(date)), (symbol, year(date)))", "total_return")
def a5(spark, d):
    return E.breakdown(returns(spark, d)).withColumn("year", F.col("year").cast("long"))


@query("a12_effective_n", f"SELECT date, 1 / nullif(sum(weight * weight), 0) AS effective_n, max(weight) AS largest, sum(abs(weight)) AS gross, any_value(turnover) AS turnover FROM ({_TOP}) JOIN (SELECT date, sum(abs(w - p)) AS turnover FROM (SELECT date, w, lag(w, 1, 0) {WSQL} AS p FROM (SELECT date, symbol, coalesce(weight, 0) AS w FROM (SELECT DISTINCT date FROM ({_TOP})) CROSS JOIN (SELECT DISTINCT symbol FROM ({_TOP})) LEFT JOIN ({_TOP}) USING (date, symbol))) GROUP BY date) USING (date) GROUP BY date", "effective_n largest gross turnover")
def a12(spark, d):
    w = x5(spark, d).filter("weight > 0")
    return E.effective_n(w).join(E.turnover(w).hint("merge"), "date")


@query("a13_log_decomposition", f"SELECT symbol, sum(ln(open / prev)) AS overnight, sum(ln(close / open)) AS intraday, sum(ln(close / prev)) AS whole, sum(ln(open / prev)) / nullif(sum(ln(close / prev)), 0) AS overnight_share FROM (SELECT *, lag(close) {WSQL} AS prev FROM bars) WHERE prev IS NOT NULL GROUP BY symbol", "overnight intraday whole overnight_share")
def a13(spark, d):
    return E.log_decomposition(S.session_legs(B.panel(spark, d)))


@query("a17_pair_correlation", "SELECT x.symbol AS a, y.symbol AS b, covar_samp(x.r, y.r) / nullif(stddev_samp(x.r) * stddev_samp(y.r), 0) AS correlation, count(*) AS n FROM r x JOIN r y ON x.date = y.date AND x.symbol < y.symbol WHERE x.r IS NOT NULL AND y.r IS NOT NULL GROUP BY ALL", "correlation")
def a17(spark, d):
    return E.pair_correlation(returns(spark, d))


@query("t1_worst_days", "SELECT symbol, date, r, place FROM (SELECT symbol, date, r, CAST(row_number() OVER (PARTITION BY symbol ORDER BY r, date) AS INTEGER) AS place FROM r WHERE r IS NOT NULL) WHERE place <= 10", "r")
def t1(spark, d):
    return E.worst_days(returns(spark, d)).select("symbol", "date", "r", "place")


# 2.10 learning
@query("m5_gram", f"SELECT n, i, j, value FROM (SELECT count(*) AS n, avg(a*a) AS aa, avg(a*b) AS ab, avg(b*b) AS bb, avg(a*label) AS ay, avg(b*label) AS by_ FROM (SELECT close / lag(close, 1) {WSQL} - 1 AS a, close / lag(close, 5) {WSQL} - 1 AS b, lead(open, 6) {WSQL} / lead(open, 1) {WSQL} - 1 AS label FROM bars) WHERE a IS NOT NULL AND b IS NOT NULL AND label IS NOT NULL) g, LATERAL (VALUES ('r1','r1',aa),('r1','r5',ab),('r5','r5',bb),('r1','y',ay),('r5','y',by_)) AS t(i, j, value)", "value")
def m5(spark, d):
    p = B.panel(spark, d).select(S.change("close", 1).alias("r1"), S.change("close", 5).alias("r5"), S.forward_label(5).alias("label"))
    return E.gram(p, ("r1", "r5"), "label")


@query("m2_m6_ridge_scores", f"""WITH x AS (SELECT symbol, date, close / lag(close, 1) {WSQL} - 1 AS a, close / lag(close, 5) {WSQL} - 1 AS b, lead(open, 6) {WSQL} / lead(open, 1) {WSQL} - 1 AS label FROM bars),
 g AS (SELECT avg(a*a) + 0.01 AS aa, avg(a*b) AS ab, avg(b*b) + 0.01 AS bb, avg(a*label) AS ay, avg(b*label) AS by_ FROM x WHERE a IS NOT NULL AND b IS NOT NULL AND label IS NOT NULL)
 SELECT symbol, date, (a * (ay * bb - ab * by_) + b * (by_ * aa - ab * ay)) / (aa * bb - ab * ab) AS score FROM x, g""", "score")
def m2(spark, d):
    p = B.panel(spark, d).select("symbol", "date", S.change("close", 1).alias("r1"), S.change("close", 5).alias("r5"), S.forward_label(5).alias("label"))
    return p.select("symbol", "date", E.linear_score(("r1", "r5"), E.ridge(p, ("r1", "r5"), "label", 0.01)).alias("score"))


# 2.11 accounts
def _by_symbol(value: str) -> str:
    return "[" + ", ".join(f"coalesce(sum({value}) FILTER (symbol = 'S{i}'), 0)" for i in range(9)) + "]"


_DRIFT = f"""WITH x AS (SELECT symbol, date, r, session_no // 5 AS block, session_no % 5 = 0 AS trades FROM (SELECT symbol, date, lead(close) {WSQL} / close - 1 AS r FROM bars) JOIN cal USING (date) WHERE r IS NOT NULL),
 t AS (SELECT block, symbol, 1.0 / count(*) OVER (PARTITION BY block) AS target FROM x WHERE trades),
 k AS (SELECT x.*, target, target * coalesce(product(1 + r) OVER (PARTITION BY block, symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS v FROM x JOIN t USING (block, symbol)),
 g AS (SELECT *, sum(v * r) OVER d / (sum(v) OVER d + 1 - sum(target) OVER d) AS gross, v / (sum(v) OVER d + 1 - sum(target) OVER d) AS w FROM k WINDOW d AS (PARTITION BY date))"""


@query("f2_drifted_weights", f"{_DRIFT} SELECT symbol, date, block, target, w AS weight FROM g", "target weight")
def f2(spark, d):
    b = B.panel(spark, d)
    held = b.withColumn("r", F.lead("close").over(S.ws()) / F.col("close") - 1).filter("r is not null").select("symbol", "date", "r")
    held = held.join(A.rebalance_blocks(B.sessions(b), 5).hint("merge"), "date")
    first = held.filter("is_rebalance").select("block", "symbol").withColumn("target", 1 / F.count("*").over(W.partitionBy("block")))
    return A.drifted_weights(held.join(first.hint("merge"), ["block", "symbol"])).select("symbol", "date", "block", "target", "weight")


@query("f3_equal_weight_account", f"""{_DRIFT},
 d AS (SELECT date, any_value(trades) AS trades, any_value(gross) AS gross, {_by_symbol("target")} AS t, {_by_symbol("w * (1 + r) / (1 + gross)")} AS z FROM g GROUP BY date),
 p AS (SELECT *, lag(z) OVER (ORDER BY date) AS pv FROM d),
 c AS (SELECT date, gross, CASE WHEN trades THEN list_reduce(list_transform(range(21), lambda i: CAST(0 AS DOUBLE)), lambda c, q: 0.001 * list_sum(list_transform(range(1, 10), lambda i: abs((1 - c) * t[i] - coalesce(pv[i], 0))))) ELSE 0 END AS cost FROM p)
 SELECT date, gross, cost, (1 - cost) * (1 + gross) - 1 AS net, product((1 - cost) * (1 + gross)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS nav FROM c""", "gross cost net nav")
def f3(spark, d):
    b = B.panel(spark, d)
    fwd = b.select("date", "symbol", (F.lead("close").over(S.ws()) / F.col("close") - 1).alias("r"))
    return A.equal_weight_account(fwd, 10.0, 5, B.sessions(b))


@query("f5_single_asset_account", "SELECT symbol, date, (1 + r) * (1 - 0.0005) / (1 + 0.0005) - 1 AS net, product((1 + r) * (1 - 0.0005) / (1 + 0.0005)) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS nav FROM r WHERE r IS NOT NULL", "net nav")
def f5(spark, d):
    return A.single_asset_account(returns(spark, d).filter("r is not null"), 5.0).select("symbol", "date", "net", "nav")


@query("f9_combined_sleeves", "WITH n AS (SELECT symbol, date, product((1 + r) * (1 - 0.0005) / (1 + 0.0005)) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS nav FROM r WHERE r IS NOT NULL) SELECT date, a.nav * 3 AS value_a, b.nav * 2 AS value_b, (a.nav * 3 + b.nav * 2) / 5 AS nav, a.nav * 3 / (a.nav * 3 + b.nav * 2) AS share_a FROM n a JOIN n b USING (date) WHERE a.symbol = 'S1' AND b.symbol = 'S2'", "value_a value_b nav share_a")
def f9(spark, d):
    n = A.single_asset_account(returns(spark, d).filter("r is not null"), 5.0)
    return A.combine_sleeves(n.filter("symbol = 'S1'"), n.filter("symbol = 'S2'"), 3.0, 2.0).select("date", "value_a", "value_b", "nav", "share_a")


@query("f6_break_even", "SELECT symbol, least(999, greatest(0, 10000 * (exp(avg(ln(1 + r))) - 1) / (exp(avg(ln(1 + r))) + 1))) AS bps FROM r WHERE r IS NOT NULL GROUP BY symbol", "bps")
def f6(spark, d):
    return A.break_even_bps(returns(spark, d).filter("r is not null"))


_EXPOSED = f"SELECT symbol, list(r ORDER BY date) AS rs, list(w ORDER BY date) AS ws FROM (SELECT symbol, date, r / 20 + 0.003 AS r, CASE WHEN r > 0 THEN 1.0 ELSE 0.4 END AS w FROM r WHERE r IS NOT NULL) GROUP BY symbol"
_GROWTH = "list_sum(list_transform(range(1, len(rs) + 1), lambda i: ln((1 + ws[i] * rs[i] - ws[i] * (1 + rs[i]) * f / 10000) / (1 + f / 10000 * ws[i]))))"


@query("f6_break_even_exposed", f"""WITH RECURSIVE e AS ({_EXPOSED}), b AS (SELECT symbol, rs, ws, 0 AS k, CAST(0 AS DOUBLE) AS lo, CAST(999 AS DOUBLE) AS hi, CAST(0 AS DOUBLE) AS f, {_GROWTH.replace('f / 10000', '0.0')} AS g0, {_GROWTH.replace('f / 10000', '0.0999')} AS g1 FROM e
 UNION ALL SELECT symbol, rs, ws, k + 1, CASE WHEN {_GROWTH} > 0 THEN f ELSE lo END, CASE WHEN {_GROWTH} > 0 THEN hi ELSE f END, f, g0, g1 FROM (SELECT * REPLACE ((lo + hi) / 2 AS f) FROM b WHERE k < 48))
 SELECT symbol, CASE WHEN g0 <= 0 THEN 0 WHEN g1 > 0 THEN 999 ELSE (lo + hi) / 2 END AS bps, g1 > 0 AS capped FROM b WHERE k = 48""", "bps")
def f6_exposed(spark, d):
    r = returns(spark, d).filter("r is not null").select("symbol", (F.col("r") / 20 + 0.003).alias("r"), F.when(F.col("r") > 0, 1.0).otherwise(0.4).alias("exposure"))
    return A.break_even_exposed(r)


@query("a7_against_comparator", """WITH m AS (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS c FROM mkt), g AS (SELECT date, c, CASE WHEN lag(c) OVER (ORDER BY date) > 0 THEN 'up' WHEN lag(c) OVER (ORDER BY date) <= 0 THEN 'down' END AS regime FROM m)
 SELECT symbol, CAST(year(date) AS BIGINT) AS year, regime, count(*) AS n, exp(sum(ln(1 + r))) - 1 AS total_return, exp(sum(ln(1 + c))) - 1 AS comparator_return, avg(r) * 52 AS annual_mean, avg(r - c) * 52 AS annual_excess, exp(sum(ln(1 + r))) - exp(sum(ln(1 + c))) AS difference
 FROM r JOIN g USING (date) WHERE r IS NOT NULL AND c IS NOT NULL AND regime IS NOT NULL GROUP BY GROUPING SETS ((symbol, year(date)), (symbol, regime))""", "total_return comparator_return annual_mean annual_excess difference")
def a7(spark, d):
    w = W.orderBy("date")  # a row a date
    m = B.benchmark(spark, d).select("date", (F.col("close") / F.lag("close").over(w) - 1).alias("r_cmp"))
    m = m.withColumn("_before", F.lag("r_cmp").over(w)).withColumn("regime", F.when(F.col("_before") > 0, "up").when(F.col("_before") <= 0, "down"))
    m = B.kept(m, "market")
    return E.against_comparator(returns(spark, d), m.select("date", "r_cmp"), m.select("date", "regime"), per_year=52).withColumn("year", F.col("year").cast("long"))


@query("a8_cost_grid", "SELECT symbol, CAST(bps AS DOUBLE) AS bps, exp(sum(ln(1 + r) + ln((1 - bps / 10000.0) / (1 + bps / 10000.0)))) - 1 AS total_return FROM r, (VALUES (0), (5), (10), (20)) AS g(bps) WHERE r IS NOT NULL GROUP BY ALL", "bps total_return")
def a8(spark, d):
    return A.cost_grid(returns(spark, d).filter("r is not null"), (0, 5, 10, 20))


# 2.12 inference
@query("i1_block_bootstrap", """WITH z AS (SELECT symbol, r, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM r), y AS (SELECT symbol, any_value(n) AS n FROM z GROUP BY symbol),
 dr AS (SELECT symbol, s, b, n, CAST(floor(CAST('0x' || substr(md5('5|' || s || '|' || b), 1, 8) AS BIGINT) / 4294967296.0 * n) AS BIGINT) AS start FROM y, (SELECT unnest(range(1, 1001)) AS s), LATERAL (SELECT unnest(range(0, (n - 1) // 20 + 1)) AS b)),
 ix AS (SELECT symbol, s, (start + k) % n AS i FROM dr, (SELECT unnest(range(0, 20)) AS k) WHERE b * 20 + k < n), m AS (SELECT symbol, s, avg(r) AS m FROM ix JOIN z USING (symbol, i) GROUP BY ALL)
 SELECT symbol, mean, low, high FROM (SELECT symbol, avg(r) AS mean FROM z GROUP BY symbol) JOIN (SELECT symbol, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY symbol) USING (symbol)""", "mean low high")
def i1(spark, d):
    return E.block_bootstrap(returns(spark, d))
