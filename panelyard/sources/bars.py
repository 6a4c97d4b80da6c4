"""Ticks to bars, the benchmark, the session calendar, and typed reads and writes of bars."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BARS = "symbol string, date date, open double, high double, low double, close double, volume double, adj_close double, adj_open double"
TICK_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_key() -> Column:
    """The order of trades as one number: second (11 digits), order (15), line (1) and part (11).

    Aggregates keep a decimal in fixed space, so the first and last trade of a bar need no sort, as they do by a struct.
    """
    second = F.unix_date(F.to_date("l_shipdate")).cast("long") * 86_400 + F.hour("l_shipdate") * 3600 + F.minute("l_shipdate") * 60 + F.second("l_shipdate")
    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return (second.cast("decimal(11,0)") * F.expr(f"{10**27}BD") + line.cast("decimal(16,0)") * F.expr(f"{10**11}BD") + F.col("l_partkey").cast("decimal(11,0)")).cast("decimal(38,0)")


def ticks(spark: SparkSession, sf_dir: str, symbols: int = 9) -> DataFrame:
    """Trades (symbol, ts, seq, place, price, size, discount, sell) from lineitem; seq and place order the trades."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(
        F.concat(F.lit("S"), (F.col("l_partkey") % symbols).cast("string")).alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        F.struct(*TICK_ORDER).alias("seq"),
        order_key().alias("place"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("size"),
        F.col("l_discount").alias("discount"),
        (F.col("l_returnflag") == "R").alias("sell"),
    )


def ohlcv(trades: DataFrame, bucket: str = "week", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Bars by key and calendar bucket of trades in order of place; partial aggregates run before the only shuffle."""
    factor = 1 - F.avg("discount")
    b = trades.groupBy(*keys, F.to_date(F.date_trunc(bucket, "ts")).alias("date")).agg(
        F.min_by("price", "place").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "place").alias("close"), F.sum("size").alias("volume"), factor.alias("_f")
    )
    return adjusted(b.withColumn("adj_close", F.col("close") * F.col("_f")).drop("_f"))


def adjusted(bars: DataFrame) -> DataFrame:
    """adj_open from the close's adjustment factor."""
    return bars.withColumn("adj_open", F.col("open") * F.col("adj_close") / F.col("close"))


def panel(spark: SparkSession, sf_dir: str, bucket: str = "week") -> DataFrame:
    return ohlcv(ticks(spark, sf_dir), bucket)


def benchmark(spark: SparkSession, sf_dir: str, bucket: str = "week") -> DataFrame:
    """One bar a date over all trades."""
    return ohlcv(ticks(spark, sf_dir), bucket, ())


def sessions(bars: DataFrame) -> DataFrame:
    """(date, session_no): the calendar's few thousand dates, numbered from 0."""
    return bars.select("date").distinct().withColumn("session_no", F.row_number().over(W.orderBy("date")) - 1)


def chart_bars(payloads: DataFrame, start: str, end: str, zone: str = "America/New_York") -> DataFrame:
    """A vendor's nested arrays to bars; epoch seconds become local dates, kept inside [start, end]."""
    r = payloads.select(F.explode("chart.result").alias("r"))
    q = F.col("r.indicators.quote")[0]
    z = F.arrays_zip(F.col("r.timestamp").alias("t"), q["open"].alias("open"), q["high"].alias("high"), q["low"].alias("low"), q["close"].alias("close"), q["volume"].alias("volume"), F.col("r.indicators.adjclose")[0]["adjclose"].alias("adj_close"))
    rows = r.select(F.col("r.meta.symbol").alias("symbol"), F.explode(z).alias("x"))
    date = F.to_date(F.from_utc_timestamp(F.timestamp_seconds("x.t"), zone)).alias("date")
    out = rows.select("symbol", date, "x.open", "x.high", "x.low", "x.close", F.col("x.volume").cast("double").alias("volume"), "x.adj_close")
    return adjusted(out.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))))


CHART = """chart struct<result: array<struct<meta: struct<symbol: string, currency: string, instrumentType: string>, timestamp: array<long>, indicators:
struct<quote: array<struct<open: array<double>, high: array<double>, low: array<double>, close: array<double>, volume: array<double>>>, adjclose: array<struct<adjclose: array<double>>>>>>>"""


def read_charts(spark: SparkSession, path: str, currency: str = "USD", kinds: tuple[str, ...] = ("EQUITY", "ETF")) -> tuple[DataFrame, DataFrame]:
    """A folder of JSON payloads by requested symbol (requested=...) as good payloads and rejected ones (requested, reason).

    Rejected are payloads that do not parse, have no result, or are of another symbol, currency or instrument type.
    """
    p = spark.read.schema(f"{CHART}, requested string, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    meta = F.get("chart.result", F.lit(0))["meta"]
    other = lambda c, ok: F.coalesce(~ok(meta[c]), F.lit(True))
    reason = (
        F.when(F.col("_corrupt").isNotNull(), "corrupt").when(F.coalesce(F.size("chart.result"), F.lit(0)) < 1, "empty")
        .when(other("symbol", lambda x: x == F.col("requested")), "symbol").when(other("currency", lambda x: x == currency), "currency").when(other("instrumentType", lambda x: x.isin(*kinds)), "type")
    )
    p = kept(p.withColumn("reason", reason), "charts")
    return p.filter("reason is null").select("requested", "chart"), p.filter("reason is not null").select("requested", "reason")


def fingerprint(rows: DataFrame, digits: int = 4) -> tuple[Column, Column]:
    """Two columns to aggregate rows by: exclusive or and sum of a 60-bit hash of each row, doubles at so many digits.

    The sum tells repeated rows apart, which cancel in pairs in the exclusive or; neither depends on the order of rows.
    """
    texts = [F.coalesce((F.round(F.col(c) * F.lit(10.0**digits)).cast("decimal(38,0)") if t == "double" else F.col(c)).cast("string"), F.lit("null")) for c, t in rows.dtypes]
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *texts).cast("binary")), 1, 15), 16, 10).cast("long")
    return F.bit_xor(h), F.sum(h.cast("decimal(20,0)")).cast("string")


def manifest(bars: DataFrame) -> DataFrame:
    """Row count, date range, symbols and an order-free fingerprint of the content (exclusive or and sum of row hashes)."""
    xor, total = fingerprint(bars)
    return bars.agg(F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.array_join(F.sort_array(F.collect_set("symbol")), ",").alias("symbols"), xor.alias("fingerprint"), total.alias("fingerprint_sum"))


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """S4"""
    return spark.read.schema(BARS).parquet(path)


def write_results(df: DataFrame, path: str, by: tuple[str, ...] = ("partition", "strategy")) -> None:
    """One table, partitioned by the columns that later reads select on."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def verify_files(spark: SparkSession, path: str, manifest: DataFrame, name: Column | None = None) -> DataFrame:
    """S3: files whose SHA-256 differs from manifest(name, sha256), is missing there, or has no file; executors hash them.

    name: a file's name from its path, its last part if left out.
    """
    name = F.element_at(F.split("path", "/"), -1) if name is None else name
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(name.alias("name"), F.sha2("content", 256).alias("found"))
    j = files.join(manifest, "name", "full")
    return j.filter(~F.col("found").eqNullSafe(F.col("sha256"))).select("name", F.when(F.col("found").isNull(), "no file").when(F.col("sha256").isNull(), "not listed").otherwise("differs").alias("issue"))


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result tables with their partition columns; an empty folder gives an empty table of the schema."""
    return spark.read.schema(schema).parquet(path)


def explode_groups(groups: DataFrame, c: str = "groups") -> DataFrame:
    """JSON group -> [symbols] to (symbol, grp, n); n is the number of groups that name the symbol."""
    m = groups.select(F.explode(F.from_json(c, "map<string, array<string>>")).alias("grp", "_s")).select(F.explode("_s").alias("symbol"), "grp")
    return m.withColumn("n", F.count("*").over(W.partitionBy("symbol")))


def event_counts(payloads: DataFrame, c: str = "events") -> DataFrame:
    """Number of events of each kind over payloads whose events map a kind to its entries."""
    e = payloads.select(F.explode(F.from_json(c, "map<string, map<string, string>>")).alias("kind", "_e"))
    return e.groupBy("kind").agg(F.sum(F.size("_e")).cast("long").alias("n"))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder in the one that driver and executors share; a temporary one is made only where none is set (tests)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="panelyard-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, so that what several steps need is computed once."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_bars(bars: DataFrame, name: str, path: str, buckets: int | None = None) -> DataFrame:
    """Bars as a table of the catalog whose files lie in path, one a bucket of symbols, sorted by symbol and date.

    Windows and aggregates by symbol, or by symbol and more, read it without a shuffle, and reads of given symbols open those
    symbols' buckets only. So do joins by symbol of two tables with as many buckets; those by symbol and date as well where
    the session sets spark.sql.requireAllClusterKeysForCoPartition to false. A symbol's bars are one bucket's, as a window by
    symbol has them in one task anyway. buckets: as many as spark.sql.shuffle.partitions if left out. A null symbol has a
    bucket as any other; an empty table gives an empty result. Raises an error if the table is there already or path holds files.
    """
    n = buckets or int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bars.repartition(n, "symbol").write.option("path", path).bucketBy(n, "symbol").sortBy("symbol", "date").saveAsTable(name)
    return bars.sparkSession.table(name)


def kept_panel(spark: SparkSession, sf_dir: str, bucket: str = "week") -> DataFrame:
    """The bars of a query that needs them more than once: one scan of the trades, stored by symbol.

    The table's name leaves the catalog at once; its files stay in the shared folder.
    """
    name = f"bars_{uuid.uuid4().hex}"
    out = store_bars(panel(spark, sf_dir, bucket), name, fresh_path(spark, "bars"))
    spark.sql(f"DROP TABLE {name}")
    return out
