"""Operator 12: ranked lexical search by range-maximum tables over posting lists.

Documents are indexed in shards of bounded size, without a shuffle. In a shard
similar documents lie side by side, and every query term has a posting list:
the places of the documents that hold it and its impact there. A sparse table
over a list gives the largest impact in any interval of places by two lookups,
so the sum over an item's terms bounds every score in the interval. Search
takes the intervals of the highest bounds first, scores the document of the
largest impact in each, and splits the interval there; intervals whose bound
falls short of the k-th score are dropped whole. A task carries its best scores
from shard to shard; a window merges the tasks' lists.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import saved, scratch, table

#: Documents and postings of a shard, at most (a shard has one document at least).
SHARD_DOCS = 8192
SHARD_POSTINGS = 1_000_000
#: Items and their terms that one pass over the index takes to its tasks, at most.
PASS_TERMS = 200_000
#: Intervals that are split at once.
WIDE = 256
#: Bits of a document's place in its shard.
POST_BITS = 20
# Bytes that end a term become a space.
BREAKS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


def terms(text: bytes) -> list[bytes]:
    """Runs of letters and digits of ASCII and of all bytes beyond it; only A-Z are lower-cased."""
    return text.translate(BREAKS).split()


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): each item's distinct terms; rows that share an item_id are one item. Items without terms have no row."""
    cut = F.split(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    return items.select("item_id", F.explode(cut).alias("term")).filter("term <> ''").distinct()


def _shard(ids: list, counts: list[Counter], lengths: list[int]) -> dict:
    """One row of the index: documents in the order of their commonest term, then length; postings by term."""
    order = sorted(range(len(ids)), key=lambda i: (max(counts[i].items(), key=lambda x: (x[1], x[0]))[0] if counts[i] else b"", lengths[i], ids[i] is None, ids[i] or 0))
    lists: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
    for place, i in enumerate(order):
        for t, n in counts[i].items():
            lists[t].append((place, n))
    found = sorted(lists)
    post = np.array([p for t in found for p in lists[t]], "<i4").reshape(-1, 2)
    return {
        "ids": np.array([ids[i] or 0 for i in order], "<i8").tobytes(),
        "nulls": np.array([ids[i] is None for i in order], "u1").tobytes(),
        "lengths": np.array([lengths[i] for i in order], "<i8").tobytes(),
        "terms": [t.decode("utf-8", "replace") for t in found],
        "df": [len(lists[t]) for t in found],
        "places": post[:, 0].tobytes(),
        "tfs": post[:, 1].tobytes(),
        "n_docs": sum(n > 0 for n in lengths),
        "n_terms": sum(lengths),
    }


INDEX = pa.schema([("ids", pa.binary()), ("nulls", pa.binary()), ("lengths", pa.binary()), ("terms", pa.list_(pa.string())), ("df", pa.list_(pa.int64())), ("places", pa.binary()), ("tfs", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64())])
INDEX_DDL = "ids binary, nulls binary, lengths binary, terms array<string>, df array<long>, places binary, tfs binary, n_docs long, n_terms long"


def index(docs: DataFrame, wanted: set[bytes], shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """Shards of docs, one row each, with the postings of the wanted terms; every document counts in the numbers of documents and terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, lengths, posts = [], [], [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ts = terms(text.as_py())
                c = Counter(t for t in ts if t in wanted)
                if ids and (len(ids) == shard_docs or posts + len(c) > shard_postings):
                    yield pa.RecordBatch.from_pylist([_shard(ids, counts, lengths)], INDEX)
                    ids, counts, lengths, posts = [], [], [], 0
                ids.append(doc_id)
                counts.append(c)
                lengths.append(len(ts))
                posts += len(c)
        if ids:
            yield pa.RecordBatch.from_pylist([_shard(ids, counts, lengths)], INDEX)

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary")).mapInArrow(run, INDEX_DDL)


#: Floor of the logarithm to base 2 of lengths (0: 0).
LOG = np.frexp(np.arange((1 << POST_BITS) + 1, dtype=np.float64))[1].astype(np.int64) - 1
LOG[0] = 0


def sparse_table(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Level j holds, at each place, the maximum of the 2 ** j values that begin there: all levels in one array, and where each begins."""
    levels = [x]
    while 2 * (half := 1 << (len(levels) - 1)) <= len(x):
        below = levels[-1]
        levels.append(np.maximum(below[:-half], below[half:]))
    return np.concatenate(levels), np.cumsum([0, *map(len, levels[:-1])])


class Lists:
    """A shard's posting lists with impacts for one set of weights; sparse tables are built when a term is first asked for."""

    def __init__(self, row, weights: dict[str, int], n_docs: int, n_terms: int):
        self.ids = np.frombuffer(row.ids, "<i8")
        # null ids come after all others
        self.nulls = np.frombuffer(row.nulls, "u1").astype(bool)
        self.by_rank = np.lexsort((self.ids, self.nulls))
        rank = np.empty(len(self.ids), np.int64)
        rank[self.by_rank] = np.arange(len(rank))
        self.m = 10 + 90 * np.frombuffer(row.lengths, "<i8") * n_docs // max(n_terms, 1)
        self.places, self.tfs = np.frombuffer(row.places, "<i4"), np.frombuffer(row.tfs, "<i4").astype(np.int64)
        ends = np.cumsum(row.df) if len(row.df) else np.empty(0, np.int64)
        self.at = {t: (int(e) - int(n), int(e)) for t, n, e in zip(row.terms, row.df, ends)}
        self.weights, self.built = weights, {}
        self.least, self.least_at = sparse_table(-rank)

    def get(self, term: str):
        """(places, impacts, sparse table of impact and place, its levels) of a term; None where no document of the shard holds it."""
        if term not in self.built:
            found = None
            if term in self.at and self.weights.get(term):
                a, b = self.at[term]
                p, tf = self.places[a:b].astype(np.int64), self.tfs[a:b]
                x = self.weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * self.m[p]))
                found = (p, x, *sparse_table(x << POST_BITS | p))
            self.built[term] = found
        return self.built[term]

    def first_ids(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is null, id) of the document that ranks first among equal scores in each interval."""
        d = LOG[hi - lo]
        rank = -np.maximum(self.least[self.least_at[d] + lo], self.least[self.least_at[d] + hi - (1 << d)])
        return self.nulls[self.by_rank[rank]], self.ids[self.by_rank[rank]]


def search(shard: Lists, query: list[str], best: list[tuple[int, bool, int]], k: int, wide: int = WIDE) -> tuple[list[tuple[int, bool, int]], int]:
    """best (-score, id is null, id), the k least, after the shard's documents have been offered; and the documents scored.

    Intervals [lo, hi) of places are taken by falling bound, wide at a time; from and to are their ranges in each list.
    """
    lists = [x for x in map(shard.get, query) if x]
    if not lists:
        return best, 0
    column = np.arange(len(lists))[:, None]
    size = np.array([len(x[0]) for x in lists])[:, None]
    begin = size.cumsum(0) - size
    posts = np.append(np.concatenate([p + (i << POST_BITS) for i, (p, *_) in enumerate(lists)]), -1)
    impacts = np.append(np.concatenate([x[1] for x in lists]), 0)
    flat = np.append(np.concatenate([x[2] for x in lists]), 0)
    starts = np.cumsum([0, *(len(x[2]) for x in lists[:-1])])
    level = np.zeros((len(lists), max(len(x[3]) for x in lists)), np.int64)
    for i, x in enumerate(lists):
        level[i, : len(x[3])] = starts[i] + x[3]
    scored, low = 0, (1 << POST_BITS) - 1

    def bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bounds of intervals whose ranges in the lists are a to b, and the place of the largest impact in each."""
        span = b - a
        d = LOG[span]
        at = level[column, d]
        most = np.where(span > 0, np.maximum(flat[at + a], flat[at + b - (1 << d)]), 0)
        return (most >> POST_BITS).sum(0), most.max(0) & low

    lo, hi = np.zeros(1, np.int64), np.array([len(shard.ids)], np.int64)
    a, b = np.zeros_like(size), size.copy()
    bound, top = bounds(a, b)
    while True:
        if len(best) == k:  # an interval of equal bound counts only if it holds an id before the k-th
            live = bound > -best[-1][0]
            even = np.flatnonzero(bound == -best[-1][0])
            if len(even):
                null, i = shard.first_ids(lo[even], hi[even])
                live[even] = (null < best[-1][1]) | (null == best[-1][1]) & (i < best[-1][2])
        else:
            live = bound > 0
        if not live.all():
            lo, hi, a, b, bound, top = lo[live], hi[live], a[:, live], b[:, live], bound[live], top[live]
        if not len(lo):
            return best, scored
        pick = np.argpartition(-bound, wide - 1)[:wide] if len(bound) > wide else np.arange(len(bound))
        doc = top[pick]
        here = np.searchsorted(posts[:-1], (column << POST_BITS) + doc)
        hit = posts[here] == (column << POST_BITS) + doc
        score = np.where(hit, impacts[here], 0).sum(0)
        scored += len(doc)
        keep = score >= (-best[-1][0] if len(best) == k else 1)
        if keep.any():
            best = sorted(best + [(-int(v), bool(shard.nulls[d]), int(shard.ids[d])) for v, d in zip(score[keep], doc[keep])])[:k]
        here = here - begin
        new_lo, new_hi = np.concatenate([lo[pick], doc + 1]), np.concatenate([doc, hi[pick]])
        new_a, new_b = np.concatenate([a[:, pick], here + hit], 1), np.concatenate([here, b[:, pick]], 1)
        full = new_hi > new_lo
        new_lo, new_hi, new_a, new_b = new_lo[full], new_hi[full], new_a[:, full], new_b[:, full]
        new_bound, new_top = bounds(new_a, new_b)
        rest = np.ones(len(lo), bool)
        rest[pick] = False
        lo, hi, a, b = np.concatenate([lo[rest], new_lo]), np.concatenate([hi[rest], new_hi]), np.concatenate([a[:, rest], new_a], 1), np.concatenate([b[:, rest], new_b], 1)
        bound, top = np.concatenate([bound[rest], new_bound]), np.concatenate([top[rest], new_top])


def _weight(n: Column, df: Column) -> Column:
    return F.floor(F.lit(1000.0) * F.log((2.0 * n + 2.0) / (2.0 * df + 1.0))).cast("long")


def _passes(wanted: DataFrame, pass_terms: int) -> Iterator[dict]:
    """Blocks of whole items, each of up to pass_terms terms (one item at least): {item: terms}."""
    block, size = {}, 0
    for r in wanted.groupBy("item_id").agg(F.collect_set("term").alias("terms")).toLocalIterator():
        if block and size + len(r["terms"]) > pass_terms:
            yield block
            block, size = {}, 0
        block[r["item_id"]] = sorted(r["terms"])
        size += len(r["terms"])
    if block:
        yield block


def top_documents(docs: DataFrame, items: DataFrame, k: int = 10, shard_docs: int = SHARD_DOCS, pass_terms: int = PASS_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents of score above 0, equal scores by rising doc_id.

    docs: doc_id, text; items: item_id, text; other columns are ignored. A document scores the sum, over an item's distinct
    terms, of w * ((1000000000 * tf) div (1000 * tf + 8 * m)), with w and m as in the module's weights. Null text has no
    term. Rows that repeat a doc_id are documents each; a null doc_id ranks after all others. Rows that share an item_id are
    one item; a null item_id is an item. An item without a matching document has no row; empty tables give an empty result.

    An index of one pass holds the terms of a bounded block of items, so tasks and driver hold at most pass_terms terms and
    their document counts; with more items the documents are read once a block.
    """
    if not 0 < shard_docs <= 1 << POST_BITS:
        raise ValueError(f"a shard has 1 to {1 << POST_BITS} documents")
    spark = docs.sparkSession
    ddl = f"item_id {items.select('item_id').dtypes[0][1]}, doc_id long, score long"
    found = [spark.createDataFrame([], ddl)]
    with scratch(spark, "lexical"):
        for block in _passes(saved(item_terms(items), "lexical-items"), pass_terms):
            found.append(_one_pass(docs, block, k, shard_docs, ddl))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    place = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return every.withColumn("rank", place).filter(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _one_pass(docs: DataFrame, block: dict, k: int, shard_docs: int, ddl: str) -> DataFrame:
    """(item_id, doc_id, score): every task's k best for each item of the block, saved."""
    sc = docs.sparkSession.sparkContext
    wanted = {t.encode() for ts in block.values() for t in ts}
    shards = saved(index(docs, wanted, shard_docs), "lexical-index")
    n_docs, n_terms = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    counts = shards.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy("t.terms").agg(F.sum("t.df").alias("df"))
    weights = dict(counts.select("terms", _weight(F.lit(n_docs), F.col("df"))).collect())  # one row a wanted term at most
    shared = sc.broadcast((block, weights))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries, w = shared.value
        best: dict = {item: [] for item in queries}
        for pdf in parts:
            for row in pdf.itertuples(index=False):
                shard = Lists(row, w, n_docs, n_terms)
                for item, query in queries.items():
                    best[item] = search(shard, query, best[item], k)[0]
        rows = [(item, None if null else i, -s) for item, top in best.items() for s, null, i in top]
        yield pd.DataFrame(rows, columns=["item_id", "doc_id", "score"], dtype=object)

    return saved(shards.select("ids", "nulls", "lengths", "terms", "df", "places", "tfs").mapInPandas(run, ddl), "lexical-found", keep=True)


def op12_lexical(spark, sf_dir: str) -> DataFrame:
    return top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
 c AS (SELECT CAST(count(*) FILTER (len(ts) > 0) AS BIGINT) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM t),
 q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
 p AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, CAST(len(ts) AS BIGINT) AS n, unnest(ts) AS term FROM t) GROUP BY r, term),
 w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(n_docs) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term),
 s AS (SELECT q.item_id, p.r, any_value(p.doc_id) AS doc_id, CAST(sum(w.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term), c GROUP BY q.item_id, p.r)
 SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""
