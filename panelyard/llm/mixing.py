"""Operator 1: mixing sources to target weights by hash-threshold histograms.

Each document has a hash of its id. A source that must give a share of its
tokens gives the documents whose hash lies under a threshold. The threshold is
found from sums of tokens by (source, hash bucket): the first bucket at which
the running sum passes the budget is refined with the next bits of the hash,
and only that bucket. No documents are sorted, and a smaller budget always
takes a subset of what a larger one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import is_small, saved, table, unused, word_count

LEVEL_BITS = 10
LEVELS = 3
#: Source tables of at most so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 10_000


def ranked_weights(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """sources(source, source_size) with a weight each: by code point, null last, the weights repeat.

    One row per source, so the ordering runs over source totals and not over documents.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))


def water_fill(sources: DataFrame, budget: float, cap: float) -> DataFrame:
    """Adds target: budget * all sizes, shared by weight, no source above cap * its size.

    Resharing the excess until none is above ends where target = min(cap * size, level * weight);
    the level comes from prefix sums over the sources ordered by cap * size / weight.
    A source of weight 0 or size 0 gets target 0. Where all caps together are below the budget, all get their cap.
    """
    s = sources.withColumns({"_cap": F.col("source_size") * F.lit(float(cap)), "_all": F.sum("source_size").over(W.partitionBy()) * F.lit(float(budget))})
    s = s.withColumn("_full", F.when(F.col("weight") > 0, F.col("_cap") / F.col("weight")).otherwise(F.lit(float("inf"))))
    before = W.orderBy("_full", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    left = F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    w_left = F.sum("weight").over(W.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("_level", F.when(w_left > 0, left / w_left))
    s = s.withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_full"), F.col("_level"))).over(W.partitionBy()))
    target = F.least(F.col("_cap"), F.coalesce(F.col("_level"), F.lit(float("inf"))) * F.col("weight"))
    return s.withColumn("target", F.when(F.col("weight") > 0, target).otherwise(F.lit(0.0))).drop("_cap", "_all", "_full", "_level")


def _digit(level: int):
    """The level's bits of the hash, from the top."""
    return F.shiftrightunsigned(F.col("_h"), 64 - LEVEL_BITS * (level + 1)).bitwiseAND(F.lit((1 << LEVEL_BITS) - 1))


def hash_thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(_key, _limit): documents of a source with their first LEVELS * LEVEL_BITS hash bits below _limit fill its budget.

    sized: (_key, _h, size); budgets: (_key, _rest). Each level sums by bucket, 2 ** LEVEL_BITS rows a source at most.
    """
    at = budgets.select("_key", F.col("_rest").alias("_need"), F.lit(0).cast("long").alias("_prefix"))
    rows = sized.select("_key", "_h", "size")
    for level in range(LEVELS):
        inside = rows.withColumn("_p", F.shiftrightunsigned(F.col("_h"), 64 - LEVEL_BITS * level) if level else F.lit(0).cast("long"))
        small = at.select("_key", F.col("_prefix").alias("_p"), "_need")
        cells = inside.groupBy("_key", "_p", _digit(level).alias("_b")).agg(F.sum("size").alias("_n")) if level == 0 else inside.join(small.select("_key", "_p").hint("shuffle_hash"), ["_key", "_p"]).groupBy("_key", "_p", _digit(level).alias("_b")).agg(F.sum("size").alias("_n"))
        run = W.partitionBy("_key").orderBy("_b")
        cells = cells.join(small.hint("shuffle_hash"), ["_key", "_p"]).withColumn("_upto", F.sum("_n").over(run))
        last = level == LEVELS - 1
        under = F.when(F.col("_upto") <= F.col("_need"), F.col("_n"))
        over = F.when(F.col("_upto") > F.col("_need"), F.struct("_b", "_n"))
        found = cells.groupBy("_key").agg(F.first("_p").alias("_p"), F.first("_need").alias("_need"), F.coalesce(F.sum(under), F.lit(0)).alias("_got"), F.min(over).alias("_edge"))
        digit = F.coalesce(F.col("_edge._b"), F.lit(1 << LEVEL_BITS))
        if last:  # the edge bucket is taken whole if that comes nearer
            nearer = F.coalesce(F.col("_got") + F.col("_edge._n") - F.col("_need") < F.col("_need") - F.col("_got"), F.lit(False))
            return found.select("_key", ((F.shiftleft("_p", LEVEL_BITS) + digit) + nearer.cast("int")).alias("_limit"))
        # without an edge the budget takes all; the prefix then points past the last bucket and later levels find no rows
        nxt = found.select("_key", (F.col("_need") - F.col("_got")).alias("_need"), (F.shiftleft("_p", LEVEL_BITS) + digit).alias("_prefix"))
        at = saved(nxt.filter("_prefix is not null"), f"mix-level{level}")
    raise AssertionError("unreachable")


def _key(source: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))


def _hash(doc_id: str, seed: int) -> Column:
    """64 bits of the id and the seed, the last four zero; from MD5, which SQL engines share (null id: as empty)."""
    digits = F.substring(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(f"|{int(seed)}")).cast("binary")), 1, 15)
    return F.shiftleft(F.conv(digits, 16, 10).cast("long"), 4)


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, size, _h, _key) of every document, saved."""
    return saved(docs.select("doc_id", "source", word_count("text").alias("size"), _hash("doc_id", seed).alias("_h"), _key().alias("_key")), "mix-sizes")


def source_limits(sized: DataFrame, weights: DataFrame | tuple[int, ...], budget: float, cap: float) -> DataFrame:
    """One row a source: _key, source_size, weight, target, _passes and _limit; a document is taken _passes times, and once more if its hash lies under _limit."""
    sources = sized.groupBy("_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    if isinstance(weights, DataFrame):
        sources = sources.join(weights.select(_key().alias("_key"), F.col("weight").cast("double")), "_key", "left").fillna(0.0, ["weight"])
    else:
        sources = ranked_weights(sources, weights)
    sources = water_fill(sources, budget, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = saved(sources.withColumn("_passes", whole).withColumn("_rest", F.col("target") - F.col("_passes") * F.col("source_size")), "mix-sources")
    limits = saved(hash_thresholds(sized, sources.select("_key", "_rest")), "mix-limits")
    chosen = sources.join(limits, "_key", "left").select("_key", "source_size", "weight", "target", "_passes", F.coalesce("_limit", F.lit(0)).cast("long").alias("_limit"))
    return F.broadcast(chosen) if is_small(chosen, BROADCAST_ROWS) else chosen.hint("merge")


def _copies(h: str, cap: float, passes: str = "_passes", limit: str = "_limit") -> Column:
    extra = (F.shiftrightunsigned(h, 64 - LEVEL_BITS * LEVELS) < F.col(limit)).cast("long")
    return F.least((F.col(passes) + extra).cast("long"), F.lit(int(cap)).cast("long"))


def mix_sources(docs: DataFrame, weights: DataFrame | tuple[int, ...] = (5, 2, 1), budget: float = 1.5, cap: float = 2.0, seed: int = 1) -> DataFrame:
    """Per document: the copies that a mix of budget * all words takes, sources near their weighted targets.

    docs: doc_id, text, source; other columns are ignored. weights: a table (source, weight), or weights that repeat over
    the sources in code point order. Returns doc_id, source, size, source_size, weight, target, copies and taken.

    Each source gives floor(target / its size) whole passes; hash thresholds choose the documents of the last part.
    Null text has size 0 and takes 0 words. A null source is a source of its own, the last. Null doc_ids share one hash.
    Rows with the same doc_id share their hash, so they are taken together. An empty table gives an empty result.
    """
    sized = _sized(docs, seed)
    out = sized.join(source_limits(sized, weights, budget, cap), "_key").withColumn("copies", _copies("_h", cap))
    return out.select("doc_id", "source", "size", "source_size", "weight", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: DataFrame | tuple[int, ...] = (5, 2, 1), budget: float = 1.5, cap: float = 2.0, seed: int = 1) -> DataFrame:
    """docs with each row as often as mix_sources takes it: not at all, once, and so on up to cap times.

    Whether a row is taken depends on its source and the hash of its doc_id alone, so no row meets another one and the
    texts are not shuffled while sources are few. Columns as in docs, whatever their names; nulls, repeats and empty tables
    as in mix_sources.
    """
    limits = source_limits(_sized(docs, seed), weights, budget, cap)
    h, times = unused("_h", docs.columns), unused("_times", docs.columns)
    names = {c: unused(c, docs.columns) for c in ("_key", "_passes", "_limit")}
    hashed = docs.withColumn(h, _hash("doc_id", seed)).withColumn(names["_key"], _key())
    joined = hashed.join(limits.select(*names).withColumnsRenamed(names), names["_key"])
    out = joined.withColumn(times, _copies(h, cap, names["_passes"], names["_limit"]).cast("int")).filter(F.col(times) > 0)
    return out.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


# The level is found from every source's own cap; documents follow the running sum of their sources by 30 bits of the hash.
OP1_SQL = r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|1'), 1, 8) AS BIGINT) >> 2 AS h FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight FROM d GROUP BY source),
 f AS (SELECT *, CAST(2 * source_size AS DOUBLE) AS most, 2 * source_size / weight AS fills, CAST(1.5 * sum(source_size) OVER () AS DOUBLE) AS whole FROM s),
 c AS (SELECT a.x, sum(least(f.most, a.x * f.weight)) AS got, sum(f.weight) FILTER (f.fills > a.x) AS left_, any_value(f.whole) AS whole FROM (SELECT CAST(0 AS DOUBLE) AS x UNION SELECT fills FROM f) AS a, f GROUP BY a.x),
 l AS (SELECT arg_max(x + (whole - got) / left_, x) AS level FROM c WHERE got <= whole AND left_ > 0),
 t AS (SELECT source, source_size, least(most, level * weight) AS target FROM f, l),
 p AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS passes FROM t),
 b AS (SELECT source, h, sum(size) AS n FROM d GROUP BY ALL),
 u AS (SELECT b.source, h, n, sum(n) OVER (PARTITION BY b.source ORDER BY h) AS upto, target - passes * source_size AS rest FROM b JOIN p ON b.source IS NOT DISTINCT FROM p.source WHERE source_size > 0),
 e AS (SELECT source, h FROM u WHERE upto <= rest OR (upto - n <= rest AND upto - rest < rest - (upto - n))),
 o AS (SELECT d.*, source_size, target, least(2, passes + CASE WHEN e.h IS NULL THEN 0 ELSE 1 END) AS copies FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN e ON e.source IS NOT DISTINCT FROM d.source AND e.h = d.h)
 SELECT doc_id, size, source_size, target, size * copies AS taken, source, copies FROM o"""
