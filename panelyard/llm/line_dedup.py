"""Operator 5: line dedup by site-relative frequency, with DataFrame functions only.

A line is boilerplate of a host if the pages that contain it, divided by the
host's pages, exceed a ratio. Lines are counted by (host, 128-bit hash of the
line), once a page, with map-side sums, so that one line on every page of the
largest host still gives one row a task. The texts are never shuffled while the
boilerplate table is small; beyond that the hosts' lists are joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, saved, table, unused

#: The hosts' lists are broadcast while they hold at most so many lines (16 bytes each).
BROADCAST_LINES = 200_000


def _line(x: Column) -> Column:
    return F.trim(x, F.lit(BLANKS))


def _key(x: Column) -> Column:
    """128 bits of the line without outer white space."""
    return F.struct(F.xxhash64(_line(x)).alias("a"), F.xxhash64(F.lit("line"), _line(x)).alias("b"))


def boilerplate(docs: DataFrame, host: str, text: str, ratio: float, min_pages: int, once: bool = False) -> DataFrame:
    """(_host, _lines): each host's boilerplate, as an array of line keys; a host has fewer than its mean lines a page / ratio."""
    lines = F.array_distinct(F.filter(F.split(F.col(text), "\n"), lambda x: F.length(_line(x)) > 0))
    keys = F.array_distinct(F.transform(lines, _key)).alias("_keys")
    name = F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("null")).alias("_host")
    if once:  # 128 bits stand for a text, so that only its line keys are shuffled, after equal texts met in each task
        pages = docs.select(name, F.xxhash64(text).alias("_a"), F.xxhash64(F.lit("text"), F.col(text)).alias("_b"), keys)
        named = saved(pages.groupBy("_host", "_a", "_b").agg(F.first("_keys").alias("_keys")).select("_host", "_keys"), "line-pages")
    else:
        named = docs.select(name, keys)
    each = named.select("_host", F.explode("_keys").alias("_k")).groupBy("_host", "_k.a", "_k.b").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_pages)
    pages = named.groupBy("_host").agg(F.count("*").alias("_pages"))
    common = each.hint("merge").join(pages.hint("merge"), "_host").filter(F.col("_n") > F.lit(float(ratio)) * F.col("_pages"))
    return common.groupBy("_host").agg(F.collect_list(F.struct("a", "b")).alias("_lines"))


def line_dedup(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.05, min_pages: int = 5, once: bool = False) -> DataFrame:
    """docs with boilerplate lines taken out of the text, and n_lines, n_dropped.

    A line counts once a page, compared without outer white space; blank lines are never counted or dropped. A line goes
    if it is on at least min_pages pages of its host and on more than ratio of them. Pages without such lines keep their
    text as it is; a page of only such lines keeps an empty text. Null text stays null (0 lines). Pages of a null host
    form a host of their own. Repeated rows count as pages each, unless once is set: then all rows of a host with the
    same text count as one page, so that copies alone make no line boilerplate. An empty table gives an empty result.
    Other columns stay, whatever their names; columns named n_lines or n_dropped are replaced.
    """
    bad = saved(boilerplate(docs, host, text, ratio, min_pages, once), "line-boilerplate")
    n_listed = bad.agg(F.coalesce(F.sum(F.size("_lines")), F.lit(0))).first()[0]
    bad = F.broadcast(bad) if n_listed <= BROADCAST_LINES else bad.hint("merge")
    at, listed, left = (unused(c, docs.columns) for c in ("_host", "_lines", "_kept"))
    named = docs.withColumn(at, F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("null")))
    joined = named.join(bad.withColumnsRenamed({"_host": at, "_lines": listed}), at, "left")
    lines = F.split(F.col(text), "\n")
    kept = F.when(F.col(listed).isNull(), lines).otherwise(F.filter(lines, lambda x: (F.length(_line(x)) == 0) | ~F.array_contains(F.col(listed), _key(x))))
    out = joined.withColumn(left, kept).withColumn("n_lines", F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long"))
    out = out.withColumn("n_dropped", F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(F.col("n_lines") - F.size(left)))
    out = out.withColumn(text, F.when(F.col("n_dropped") > 0, F.array_join(left, "\n")).otherwise(F.col(text)))
    return out.drop(at, listed, left)


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "text", "n_lines", "n_dropped")


OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, source, i, string_split(text, chr(10))[i] AS line
  FROM documents, range(1, len(string_split(text, chr(10))) + 1) AS t(i)
), k AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM l),
c AS (SELECT source, bare, count(DISTINCT doc_id) AS n FROM k WHERE bare <> '' GROUP BY ALL),
p AS (SELECT source, count(*) AS pages FROM documents GROUP BY ALL),
b AS (SELECT c.source, c.bare FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source WHERE n >= 5 AND n > 0.05 * pages),
m AS (
  SELECT k.*, b.bare IS NOT NULL AS bad
  FROM k LEFT JOIN b ON k.bare = b.bare AND k.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, source, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT bad), '') AS text,
       count(*) AS n_lines, count(*) FILTER (bad) AS n_dropped
FROM m GROUP BY doc_id, source
"""
