"""Near-dedup of a corpus: one document of each group of near copies stays.

Operator 9 comes first: two texts are linked if their SimHash fingerprints
differ in 2 or fewer bits, found by its grid of segment counts. Edits that
change more bits are left to a second rule: two texts are also linked if the
Jaccard similarity of their sets of five-word shingles reaches a threshold t;
pairs that fingerprints join already are not looked at again. The search is
complete: with all shingles in one
global order, the sets of two such texts meet in their first n - ceil(t n) + 1
shingles, n being the size of the set. Those shingles are the cells of the
search. Any order finds every pair; here shingles that a sample of the texts
has often come last, so that common passages make no cells. A pair that shares
a cell goes on unless a bound on its overlap excludes it, and is then decided
by the shingles of the two texts themselves. In crowded cells that bound is also
the Manhattan distance of segment counts: of a text's shingles by range of hash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import is_small, saved, scratch, unused
from .components import components
from .simhash import fingerprint_classes, majority, shingle_hashes

#: Words of a shingle of the sets; of one that a fingerprint is made of, as in operator 9.
WIDTH, FINGERPRINT_WIDTH = 5, 3
#: Ranges of the shingles' hashes, by their upper 8 of 63 bits, in which a text's shingles are counted.
SEGMENTS = 256
#: Common shingles, which only the order of the search depends on: those of at least so many texts of one in SAMPLE.
SAMPLE, COMMON_TEXTS, COMMON_ROWS = 8, 5, 200_000
#: Members of a cell that are compared in SQL; fuller cells take a few leaders first and then compare what they left apart.
CELL, LEADERS, BLOCK = 32, 8, 1024
BROADCAST_ROWS = 1_000_000
FLUSH = 300_000


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def shingles(text: bytes | None) -> set[bytes]:
    """The runs of WIDTH words; of fewer words the whole sequence."""
    ws = _words(text)
    return {b" ".join(ws[i : i + WIDTH]) for i in range(max(1, len(ws) - WIDTH + 1))} if ws else set()


def similar(a: set[bytes], b: set[bytes], similarity: float) -> bool:
    """Whether the Jaccard similarity of the sets is at least that."""
    both = len(a & b)
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def prefix_size(n: int, similarity: float) -> int:
    """How many of the first of n shingles must hold one that a text of that similarity has among its first, too."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def _hashes(words: list[bytes]) -> np.ndarray:
    """The distinct shingles' hashes in 63 bits."""
    return np.unique(shingle_hashes(words, WIDTH) >> np.uint64(1)).astype(np.int64)


def common_shingles(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Sorted hashes of at most COMMON_ROWS shingles that many distinct texts of a sample have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter[int] = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(c.keys()), pa.int64()), pa.array(list(c.values()), pa.int64())], names=["s", "n"])
            c.clear()
            return b

        for b in batches:
            for t in b.column(0):
                c.update(_hashes(_words(t.as_py())).tolist())
                if len(c) > FLUSH:
                    yield out()
        if c:
            yield out()

    part = docs.select(F.col(text).cast("binary").alias("t")).filter(F.pmod(F.xxhash64("t"), F.lit(SAMPLE)) == 0)
    # equal texts share a hash, so a group of exact copies is all in the sample or not at all
    found = part.distinct().mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON_TEXTS)
    return np.sort(np.array([r["s"] for r in found.orderBy(F.desc("n"), "s").limit(COMMON_ROWS).select("s").collect()], np.int64))


def marked(docs: DataFrame, similarity: float, common: np.ndarray, text: str = "text") -> DataFrame:
    """(row, doc_id, same, fp, size, cells, counts): same is a 128-bit hash of the words, A-Z lower-cased; cells the set's first shingles in order.

    fp: operator 9's fingerprint. counts: how many of the set's hashes lie in each of SEGMENTS equal ranges. The Manhattan distance of two texts' counts
    never exceeds the number of shingles that only one of them has.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value
        for b in batches:
            same, fps, sizes, cells, counts = [], [], [], [], []
            for t in b.column(2):
                ws = _words(t.as_py())
                same.append(xxhash.xxh3_128_digest(b" ".join(ws)))
                fps.append(majority(shingle_hashes(ws, FINGERPRINT_WIDTH)))
                h = _hashes(ws)
                sizes.append(len(h))
                counts.append(np.minimum(np.bincount(h >> 55, minlength=SEGMENTS), 65_535).astype("<u2").tobytes())
                if len(last):
                    often = last[np.minimum(np.searchsorted(last, h), len(last) - 1)] == h
                else:
                    often = np.zeros(len(h), bool)
                # below zero all others, in the order of their hashes; from zero on the common ones
                cells.append(np.concatenate([h[~often] + np.iinfo(np.int64).min, h[often]])[: prefix_size(len(h), similarity)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same, pa.binary()), pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), pa.array(cells, pa.list_(pa.int64())), pa.array(counts, pa.binary())], names=["row", "doc_id", "same", "fp", "size", "cells", "counts"])

    return docs.select("row", "doc_id", F.col(text).cast("binary").alias("t")).mapInArrow(run, "row long, doc_id long, same binary, fp long, size int, cells array<long>, counts binary")


def _possible(similarity: float) -> Column:
    """Whether a pair (u, v) with c common cells in small cells can reach the similarity; per side s: size, p: cells, end: the last, f: full cells.

    Full cells can add as many as the lesser number of both. Up to the lesser end the common shingles are all known, and
    the side with that end has all its cells there; beyond it the sets share at most what that side's rest holds.
    """
    rest = F.when(F.col("u_end") < F.col("v_end"), F.col("u_s") - F.col("u_p")).when(F.col("u_end") > F.col("v_end"), F.col("v_s") - F.col("v_p")).otherwise(F.least(F.col("u_s") - F.col("u_p"), F.col("v_s") - F.col("v_p")))
    least = F.lit(similarity / (1 + similarity)) * (F.col("u_s") + F.col("v_s")) - 1e-9
    return (F.least("u_s", "v_s") >= F.lit(similarity) * F.greatest("u_s", "v_s") - 1e-9) & (F.col("c") + F.least("u_f", "v_f") + rest >= least)


def _verified(pairs: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of rows of docs(row, text) whose texts have the similarity."""
    ends = pairs.select(F.col("u").alias("row")).unionByName(pairs.select(F.col("v").alias("row"))).distinct()
    ends = F.broadcast(ends) if is_small(ends, BROADCAST_ROWS) else ends.hint("merge")
    texts = saved(docs.select("row", F.col("text").cast("binary").alias("t")).join(ends, "row", "left_semi"), "near-ends")
    left, right = texts.withColumnsRenamed({"row": "u", "t": "a"}), texts.withColumnsRenamed({"row": "v", "t": "b"})
    both = pairs.hint("merge").join(right.hint("merge"), "v").hint("merge").join(left.hint("merge"), "u").select("u", "v", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, one = None, set()
        for b in batches:
            keep = []
            for i, (u, x, y) in enumerate(zip(b.column(0).to_pylist(), b.column(2), b.column(3))):
                if u != at:
                    at, one = u, shingles(x.as_py())
                if similar(one, shingles(y.as_py()), similarity):
                    keep.append(i)
            if keep:
                yield pa.RecordBatch.from_arrays([b.column(k).take(pa.array(keep)) for k in (0, 1)], names=["u", "v"])

    return saved(both.mapInArrow(run, "u long, v long"), "near-links")


def _links(texts: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) that join all rows of texts(row, class, size, cells, counts) that classes or links of that similarity join.

    class: the smallest row of those that operator 9 joins. The links are enough for the components.
    """
    joined = texts.filter("row <> class").select(F.col("row").alias("u"), F.col("class").alias("v"))
    cell = W.partitionBy("cell")
    order = cell.orderBy("row")
    spread = texts.select("row", F.explode("cells").alias("cell"))
    counted = spread.withColumns({"n": F.count("*").over(cell), "place": F.row_number().over(order), "before": F.collect_list("row").over(order.rowsBetween(-CELL, -1))})
    leaders = F.collect_list(F.when(F.col("place") <= LEADERS, F.col("row"))).over(cell)
    counted = counted.filter("n > 1").withColumn("before", F.when(F.col("n") <= CELL + 1, F.col("before")).otherwise(leaders))
    counted = saved(counted, "near-cells")
    pairs = counted.select(F.col("row").alias("u"), F.explode("before").alias("v"), (F.col("n") <= CELL + 1).cast("int").alias("c")).filter("u > v")
    pairs = pairs.groupBy("u", "v").agg(F.sum("c").alias("c"))
    fulls = counted.filter(F.col("n") > CELL + 1).groupBy("row").agg(F.count("*").alias("f"))
    sides = texts.select("row", "class", F.col("size").alias("s"), F.size("cells").alias("p"), F.get("cells", F.size("cells") - 1).alias("end")).hint("merge").join(fulls.hint("merge"), "row", "left").fillna(0, ["f"])
    sides = saved(sides, "near-sides")
    for side in ("u", "v"):
        pairs = pairs.hint("merge").join(sides.select(F.col("row").alias(side), *[F.col(x).alias(f"{side}_{x}") for x in ("class", "s", "p", "end", "f")]).hint("merge"), side)
    links = _verified(saved(pairs.filter("u_class <> v_class").filter(_possible(similarity)).select("u", "v"), "near-pairs"), docs, similarity)
    links = links.unionByName(joined)
    full = counted.filter(F.col("n") > CELL + 1).select("row", "cell")
    if full.isEmpty():
        return links
    # Fuller cells: the pairs that the links so far leave apart, every pair of blocks being one group of at most 2 * BLOCK rows.
    roots = components(links).select(F.col("node").alias("row"), "root")
    full = full.hint("merge").join(roots.hint("merge"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    mixed = full.withColumns({"lo": F.min("root").over(cell), "hi": F.max("root").over(cell), "n": F.count("*").over(cell), "place": F.row_number().over(order)}).filter("lo < hi")
    mixed = mixed.select("row", "cell", "root", F.floor((F.col("place") - 1) / BLOCK).cast("int").alias("i"), F.floor((F.col("n") - 1) / BLOCK).cast("int").alias("last"))
    mixed = mixed.select("row", "cell", "root", F.col("i").alias("own"), F.explode(F.sequence(F.lit(0), F.col("last"))).alias("j"))
    mixed = mixed.select("row", "cell", "root", "own", F.least("own", "j").alias("i"), F.greatest("own", "j").alias("j"))
    mixed = mixed.hint("merge").join(texts.select("row", "size", "cells", "counts").hint("merge"), "row")

    def apart(pdf: pd.DataFrame) -> pd.DataFrame:
        """Pairs of different roots, each from its first common cell only, whose sizes, common first shingles and counts allow the similarity."""
        pdf = pdf.sort_values("row")
        rows, root, size, own, here = pdf["row"].to_numpy(), pdf["root"].to_numpy(), pdf["size"].to_numpy(), pdf["own"].to_numpy(), pdf["cell"].iloc[0]
        within = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        counts = np.frombuffer(b"".join(pdf["counts"]), "<u2").reshape(len(rows), SEGMENTS).astype(np.int32)
        lens = pdf["cells"].map(len).to_numpy()
        flat = np.concatenate(pdf["cells"].to_list())
        starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
        ids = np.unique(flat, return_inverse=True)[1]
        mark, out = np.zeros(ids.max() + 1, bool), []
        ends = flat[starts + lens - 1]
        for k in range(len(rows) - 1):
            mine = ids[starts[k] : starts[k] + lens[k]]
            mark[mine] = True
            hit = mark[ids]
            mark[mine] = False
            both = np.add.reduceat(hit.astype(np.int64), starts)
            earlier = np.add.reduceat((hit & (flat < here)).astype(np.int64), starts)
            end = np.minimum(ends, ends[k])
            known = np.add.reduceat((flat <= np.repeat(end, lens)).astype(np.int64), starts)
            known_k = np.searchsorted(flat[starts[k] : starts[k] + lens[k]], end, side="right")
            rest = np.minimum(size - known, size[k] - known_k)
            ok = (root != root[k]) & (earlier == 0) & (np.minimum(size, size[k]) >= similarity * np.maximum(size, size[k]) - 1e-9) & (both + rest >= similarity / (1 + similarity) * (size + size[k]) - 1e-9)
            ok[: k + 1] = False
            if not within:
                ok &= own != own[k]
            at = np.flatnonzero(ok)
            apart_by = np.abs(counts[at] - counts[k]).sum(axis=1)  # at most the number of shingles that one of both lacks
            at = at[apart_by <= (1 - similarity) / (1 + similarity) * (size[at] + size[k]) + 1e-9]
            out += [(int(rows[j]), int(rows[k])) for j in at]
        return pd.DataFrame(out, columns=["u", "v"])

    more = saved(mixed.groupBy("cell", "i", "j").applyInPandas(apart, "u long, v long"), "near-apart")
    return links.unionByName(_verified(more.distinct(), docs, similarity)) if not more.isEmpty() else links


def near_copy_groups(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(row, doc_id, keeper) for docs(row, doc_id, text): keeper is true for one row of each group of near copies.

    A group is what operator 9's links of fingerprints and links of at least that Jaccard similarity of five-word shingles
    join; every such link counts and no other. Equal word sequences are one class before any pair is formed. The row with the smallest doc_id stays, and of
    rows that repeat it the first; null ids come last. Null and blank texts are one group.
    """
    marks = saved(marked(docs, similarity, common_shingles(docs)), "near-marks")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc"), F.col("row").alias("row"))
    firsts = saved(marks.groupBy("same").agg(F.min("row").alias("row"), F.min(order).alias("best")), "near-texts")
    texts = marks.select("row", "fp", "size", "cells", "counts").hint("merge").join(firsts.select("row").hint("merge"), "row", "left_semi")
    fps = saved(marks.groupBy("fp").agg(F.min("row").alias("first")), "near-fingerprints")  # its first row is also the first of a text
    classes = fingerprint_classes(fps).select("fp", F.col("lowest").alias("class"))
    texts = saved(texts.hint("merge").join(classes.hint("merge"), "fp").drop("fp"), "near-firsts")
    found = components(_links(texts, docs, similarity))
    rooted = firsts.select("row", "same", "best").hint("merge").join(found.select(F.col("node").alias("row"), "root").hint("merge"), "row", "left")
    rooted = saved(rooted.select("same", "best", F.coalesce("root", "row").alias("root")), "near-roots")
    best = rooted.groupBy("root").agg(F.min("best").alias("best"))
    keepers = best.select(F.col("best.row").alias("row"), F.lit(True).alias("keeper"))
    return marks.select("row", "doc_id").hint("merge").join(keepers.hint("merge"), "row", "left").withColumn("keeper", F.coalesce("keeper", F.lit(False)))


def drop_near_copies(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """docs without the near copies of a document that stays; columns as in docs, whatever their names.

    The rows are numbered once, in a saved table, so that all steps mean the same row whatever the files' splits.
    An empty table gives an empty result.
    """
    at = unused("_row", docs.columns)
    numbered = saved(docs.withColumn(at, F.monotonically_increasing_id()), "near-numbered")
    with scratch(docs.sparkSession, "near-copies"):
        groups = near_copy_groups(numbered.select(F.col(at).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), similarity)
        gone = saved(groups.filter("not keeper").select(F.col("row").alias(at)), "near-gone", keep=True)
    gone = F.broadcast(gone) if is_small(gone, BROADCAST_ROWS) else gone.hint("merge")
    return numbered.join(gone, at, "left_anti").drop(at)
