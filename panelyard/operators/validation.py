"""Checks that return an issues table instead of stopping at the first bad value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

FIELDS = ("open", "high", "low", "close", "adj_close", "volume")


def invalid_values(bars: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """V1: (symbol, date, field) of values that are null, not finite or not above 0."""
    pairs = ", ".join(f"'{f}', {f}" for f in fields)
    long = bars.select("symbol", "date", F.expr(f"stack({len(fields)}, {pairs}) as (field, value)"))
    v = F.col("value")
    return long.filter(v.isNull() | F.isnan(v) | (v <= 0) | (v == float("inf"))).select("symbol", "date", "field")


def duplicate_keys(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """V2: keys that occur more than once, and how often."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def ohlc_geometry(bars: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """V3: bars whose high or low does not enclose the other prices, within tolerance * close."""
    eps = F.lit(tolerance) * F.col("close")
    bad = (F.col("high") + eps < F.greatest("open", "close", "low")) | (F.col("low") - eps > F.least("open", "close", "high"))
    return bars.filter(bad).select("symbol", "date")


def session_gaps(bars: DataFrame, calendar: DataFrame, own_range: bool = False, symbols: DataFrame | None = None) -> DataFrame:
    """V4, V5: (symbol, date) of the calendar without a bar, over the whole calendar or each symbol's own range.

    Sessions are numbered; a gap is a step of more than one between a symbol's neighbouring bars, so only missing rows are
    made, never symbols by dates. Bars outside the calendar are passed over, repeated bars count once. U3: a requested symbol
    of symbols(symbol) without any bar of the calendar misses all of it; without symbols such a one has no rows.
    """
    numbered = calendar.select("date").distinct().withColumns({"_no": F.row_number().over(W.orderBy("date")), "_all": F.count("*").over(W.partitionBy(F.lit(1)))})
    w = W.partitionBy("symbol").orderBy("_no")
    own = bars.select("symbol", "date").join(numbered, "date")
    first, past = (F.col("_no") - 1, F.col("_no") + 1) if own_range else (F.lit(0), F.col("_all") + 1)
    pair = lambda a, z: F.struct(a.cast("int").alias("a"), z.cast("int").alias("z"))
    steps = F.array_compact(F.array(pair(F.coalesce(F.lag("_no").over(w), first), F.col("_no")), F.when(F.lead("_no").over(w).isNull(), pair(F.col("_no"), past))))
    gaps = own.select("symbol", steps.alias("_s")).select("symbol", F.explode("_s").alias("_s")).filter("_s.z - _s.a > 1").select("symbol", F.explode(F.expr("sequence(_s.a + 1, _s.z - 1)")).alias("_no"))
    if symbols is not None:
        absent = symbols.select("symbol").distinct().join(own.select("symbol").distinct().hint("merge"), "symbol", "left_anti")
        gaps = gaps.unionByName(absent.select("symbol", F.explode(F.sequence(F.lit(1), F.lit(calendar.select("date").distinct().count()).cast("int"))).alias("_no")))
    return gaps.hint("merge").join(numbered.select("_no", "date").hint("merge"), "_no").select("symbol", "date")


def adjustment_identity(bars: DataFrame) -> DataFrame:
    """V6: largest error of adj_open = open * adj_close / close, and the range of the factor."""
    f = F.col("adj_close") / F.col("close")
    return bars.agg(F.max(F.abs(F.col("adj_open") - F.col("open") * f)).alias("max_error"), F.min(f).alias("min_factor"), F.max(f).alias("max_factor"))


def before(rows: DataFrame, cutoff: str, column: str = "date") -> DataFrame:
    """V8: rows before a sealed date; the filter reaches the scan."""
    return rows.filter(F.col(column) < F.lit(cutoff).cast("date"))


def matched_dates(a: DataFrame, b: DataFrame) -> DataFrame:
    """V9: dates that only one of two series has."""
    j = a.select("date", F.lit(True).alias("_a")).distinct().join(b.select("date", F.lit(True).alias("_b")).distinct(), "date", "full")
    return j.filter(F.col("_a").isNull() | F.col("_b").isNull()).select("date", F.when(F.col("_a").isNull(), "b").otherwise("a").alias("only_in"))


def weight_invariants(weights: DataFrame, cap: float = 1.0, keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """Books with a negative or missing weight, one above cap, or a sum above 1."""
    w = weights.groupBy(*keys).agg(F.sum("weight").alias("total"), F.min("weight").alias("least"), F.max("weight").alias("most"), F.count_if(F.col("weight").isNull()).alias("missing"))
    return w.filter((F.col("total") > 1 + 1e-9) | (F.col("least") < 0) | (F.col("most") > cap + 1e-9) | (F.col("missing") > 0))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two results has, with repeats, marked by side."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def liquidity_breach(trades: DataFrame, limit: float) -> DataFrame:
    """By date, the symbol of the highest traded notional over its prior average volume, where above limit."""
    r = trades.withColumn("ratio", F.col("notional") / F.nullif(F.col("adv"), F.lit(0.0)))
    return r.groupBy("date").agg(F.max("ratio").alias("ratio"), F.max_by("symbol", F.struct("ratio", "symbol")).alias("symbol")).filter(F.col("ratio") > limit)


def difference_within(a: DataFrame, b: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...], tolerance: float) -> DataFrame:
    """V13 with a tolerance: (keys, column, a, b) of the values that differ by more, or that one side lacks.

    Null and a missing row are alike; keys must be unique and not null on each side.
    """
    side = lambda df, n: df.select(*keys, *[F.col(c).cast("double").alias(f"{n}_{c}") for c in columns])
    j = side(a, "a").join(side(b, "b").hint("merge"), list(keys), "full")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").alias("a"), F.col(f"b_{c}").alias("b")) for c in columns]))
    x = j.select(*keys, each.alias("_x")).select(*keys, "_x.*")
    return x.filter(F.coalesce(F.abs(F.col("a") - F.col("b")) > tolerance, ~F.col("a").eqNullSafe(F.col("b"))))
