"""Exact quantiles by key without holding, sorting or sending a key's values.

A histogram of each key's range is summed map-side; only the bucket that holds a wanted rank is cut again, between its own
least and largest value, until both are equal. No task sees more than a key's buckets, whatever the number of its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.bars import kept

BUCKETS = 1024
BROADCAST_KEYS = 10_000


def exact_quantiles(rows: DataFrame, columns: tuple[str, ...], probs: tuple[float, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, column, n, q): by key and column, the number of values and the quantiles at probs, interpolated linearly.

    Nulls and NaN are left out; a column without values in a key has no row. Every round splits each open bucket at least
    in two, and into 1,024 where its values are spread evenly.
    """
    if not all(0 <= p <= 1 for p in probs):
        raise ValueError("probabilities must be from 0 to 1")
    by = [*keys, "column"]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]))
    values = kept(rows.select(*keys, each.alias("_x")).select(*keys, "_x.*").filter(F.col("v").isNotNull() & ~F.isnan("v")), "quantile-values")
    ends = kept(values.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "quantile-ends")
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(h), F.ceil(h)) for h in ((F.col("n") - 1) * F.lit(float(p)) for p in probs)])))
    found = kept(ends.select(*by, F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("below"), "lo", "hi"), "quantile-ranks")
    few = ends.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    done = found.filter("lo = hi")
    while not (left := found.filter("lo < hi")).isEmpty():
        spans = left.groupBy(*by).agg(F.collect_set(F.struct("lo", "hi")).alias("_spans"))  # two a probability at most
        near = values.join(F.broadcast(spans) if few else spans.hint("merge"), by)
        near = near.withColumn("_s", F.filter("_spans", lambda s: F.col("v").between(s["lo"], s["hi"]))).filter(F.size("_s") > 0).select(*by, "v", F.get("_s", F.lit(0))["lo"].alias("lo"), F.get("_s", F.lit(0))["hi"].alias("hi"))
        part = F.nanvl((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.5))
        inner = F.least(F.greatest(F.floor(F.least(part, F.lit(1.0)) * BUCKETS), F.lit(0)), F.lit(BUCKETS - 1))
        bucket = F.when(F.col("v") == F.col("lo"), -1).when(F.col("v") == F.col("hi"), BUCKETS).otherwise(inner)
        cells = near.groupBy(*by, "lo", bucket.alias("_b")).agg(F.count("*").alias("_n"), F.min("v").alias("_lo"), F.max("v").alias("_hi"))
        cells = cells.withColumn("_upto", F.sum("_n").over(W.partitionBy(*by, "lo").orderBy("_b")))
        at = F.col("rank") - F.col("below")
        nearer = left.join(cells.hint("merge"), [*by, "lo"]).filter((at < F.col("_upto")) & (at >= F.col("_upto") - F.col("_n")))
        found = kept(nearer.select(*by, "rank", (F.col("below") + F.col("_upto") - F.col("_n")).alias("below"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi")), "quantile-ranks")
        done = done.unionByName(found.filter("lo = hi"))
    known = done.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "lo"))).alias("_at"))  # two a probability at most

    def quantile(p: float):
        h = (F.col("n") - 1) * F.lit(float(p))
        low, high = F.element_at("_at", F.floor(h)), F.element_at("_at", F.ceil(h))
        return F.when(F.floor(h) == F.ceil(h), low).otherwise((F.ceil(h) - h) * low + (h - F.floor(h)) * high)

    return ends.join(known.hint("merge"), by).select(*by, "n", F.array(*[quantile(p) for p in probs]).alias("q"))
