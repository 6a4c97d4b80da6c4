"""Operator 9: SimHash near-dedup by a segment-popcount embedding.

A 64-bit fingerprint is cut into 16 segments of 4 bits; the segments' bit
counts form a point of a small grid. A differing bit moves one coordinate by
one at most, so the Manhattan distance of two points never exceeds the Hamming
distance of their fingerprints. Points within distance 2 meet in a cell that is
within distance 1 of both: every fingerprint is listed in its own cell and the
neighbouring ones, and fingerprints that share a cell are compared exactly. In
cells with many members, all fingerprints are linked through the 65 strings
within one bit of each instead, which finds the same links without all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import saved, table
from .components import components

#: Members of a cell that are compared with each other; fuller cells take the exact way without pairs.
CELL = 16

BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of width words, space-joined, repeats included; fewer words: of the whole sequence."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist())), np.uint64, len(words) - width + 1)


def majority(h: np.ndarray) -> int:
    """The 64 bits that over half of the hashes have set."""
    if not len(h):
        return 0
    if len(h) <= 64:
        votes = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    else:
        at = h.astype(">u8").view(np.uint8).reshape(-1, 8) + (np.arange(8) * 256)
        votes = (np.bincount(at.ravel(), minlength=2048).reshape(8, 256) @ BITS).ravel()
    return int.from_bytes(np.packbits(2 * votes > len(h)).tobytes(), "big", signed=True)


def fingerprinted(docs: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """The columns of docs but the text, and fp: the SimHash of the whole text, A-Z lower-cased, as a signed long."""
    others = [c for c in docs.columns if c != text]
    schema = docs.select(*others).withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.column(b.schema.get_field_index("_body"))
            fps = [majority(shingle_hashes((x.as_py() or b"").lower().split(), width)) for x in t]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(others))] + [pa.array(fps, pa.int64())], names=[*others, "fp"])

    return docs.select(*others, F.col(text).cast("binary").alias("_body")).mapInArrow(run, schema)


def _segment_counts(fp: Column) -> Column:
    """The bit counts of the 16 segments, each in 4 bits of a long."""
    even, odd = fp.bitwiseAND(F.lit(0x5555555555555555)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(0x5555555555555555))
    pairs = even.bitwiseXOR(odd).bitwiseOR(F.shiftleft(even.bitwiseAND(odd), 1))
    return pairs.bitwiseAND(F.lit(0x3333333333333333)) + F.shiftrightunsigned(pairs, 2).bitwiseAND(F.lit(0x3333333333333333))


def _cells(point: Column) -> Column:
    """The cell of a point and its neighbours at Manhattan distance 1 inside the grid."""

    def moved(i: Column) -> Column:
        here = F.call_function("shiftrightunsigned", point, (i * 4).cast("int")).bitwiseAND(F.lit(15).cast("long"))
        one = F.call_function("shiftleft", F.lit(1).cast("long"), (i * 4).cast("int"))
        return F.array(F.when(here < 4, point + one), F.when(here > 0, point - one))

    near = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(15)), moved))
    return F.concat(F.array(point), F.filter(near, lambda c: c.isNotNull()))


def near_links(fps: DataFrame, cell: int = CELL) -> DataFrame:
    """Links (u, v) that join all distinct fingerprints fp with 2 or fewer differing bits (enough for the components).

    Cells of up to cell + 1 members compare each member with all before it. Members of fuller cells are linked through
    the strings that differ from them by at most one bit: two fingerprints differ by 2 bits or fewer exactly if they share
    such a string, and at most 65 fingerprints share one.
    """
    points = fps.select("fp").withColumn("_point", _segment_counts(F.col("fp")))
    cells = points.select("fp", F.explode(_cells(F.col("_point"))).alias("_cell"))
    order = W.partitionBy("_cell").orderBy("fp")
    before = F.collect_list("fp").over(order.rowsBetween(-cell, -1))
    placed = saved(cells.withColumns({"_before": before, "_place": F.row_number().over(order)}).filter("_place > 1").select("fp", "_cell", "_place", F.filter("_before", lambda p: F.bit_count(p.bitwiseXOR(F.col("fp"))) <= 2).alias("_near")).filter((F.size("_near") > 0) | (F.col("_place") > cell + 1)), "simhash-cells")
    pairs = placed.select(F.col("fp").alias("u"), F.explode("_near").alias("v")).distinct()
    full = placed.filter(F.col("_place") > cell + 1).select("_cell").distinct()
    crowded = cells.hint("merge").join(full.hint("merge"), "_cell", "left_semi").select("fp").distinct()
    one_bit = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    strings = crowded.select("fp", F.explode(F.concat(F.array("fp"), one_bit)).alias("_s"))
    stars = strings.groupBy("_s").agg(F.collect_list("fp").alias("_all")).filter(F.size("_all") > 1)
    stars = stars.select(F.explode("_all").alias("u"), F.array_min("_all").alias("v")).filter("u <> v").distinct()
    return pairs.unionByName(stars)


def fingerprint_classes(fps: DataFrame) -> DataFrame:
    """(fp, lowest) for distinct fps(fp, first): lowest is the smallest first reachable over links of 2 or fewer differing bits."""
    roots = components(near_links(fps)).select(F.col("node").alias("fp"), "root")
    rooted = fps.hint("merge").join(roots.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = saved(rooted, "simhash-roots")
    lowest = rooted.groupBy("root").agg(F.min("first").alias("lowest"))
    return rooted.hint("merge").join(lowest.hint("merge"), "root").select("fp", "lowest")


def simhash_components(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links of 2 or fewer differing bits.

    Null text is an empty text; texts without words have fingerprint zero and are linked like any other. Texts of any
    length are hashed whole. Equal fingerprints are one node, so copies make no pairs. Rows with a null doc_id take part;
    their component is the smallest id that is not null, or null if there is none. Other columns are ignored.
    """
    marked = saved(fingerprinted(docs.select("doc_id", "text"), width=width), "simhash-fingerprints")
    fps = saved(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    classes = fingerprint_classes(fps).withColumnRenamed("lowest", "component_id")
    return marked.hint("merge").join(classes.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
