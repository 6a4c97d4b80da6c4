"""Operator 2: exact top-k search by MaxScore over shards of integer vectors.

The vectors are dealt to shards of bounded size. In a shard, every dimension has
a list of postings, the vectors' values there, cut into blocks of vectors in the
order of falling length. A query's terms are the dimensions; a term's score
bound in a shard is the largest product it can give there. Terms are ordered by
bound. While the bounds of the smallest terms add up to less than the query's
k-th score, a vector cannot enter the result by those terms alone: they are
non-essential, and their lists are passed over. Only the essential lists are
traversed; the other terms are probed, largest bound first, for vectors that can
still reach the k-th score. Every (shard, block of queries) is one row of a
table, and the shards' lists are merged by a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import saved, table

SHARD_ROWS = 8192
#: Queries of a block: with this many, copies of shards and of query blocks weigh within a factor of two of each other in the grid.
QUERY_ROWS = 4096
BLOCK = 1024
PROBES = 4
LONG = np.iinfo(np.int64)


def _packed(df: DataFrame, group: str, dims: int) -> DataFrame:
    """(group, ids, kind, values): the group's vectors as one row of int64 ids and a matrix of the least kind of integers that holds it."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((len(pdf), dims), np.int64)
        for i, v in enumerate(pdf["v"]):
            m[i, : len(v)] = v
        o = np.argsort(pdf["vec_id"].to_numpy(), kind="stable")
        m = m[o]
        ids = pdf["vec_id"].to_numpy().astype("<i8")[o]
        kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if not len(m) or (np.iinfo(k).min <= m.min() and m.max() <= np.iinfo(k).max))
        return pd.DataFrame({group: [pdf[group].iloc[0]], "ids": [ids.tobytes()], "kind": [kind], "values": [m.astype(kind).tobytes()]})

    return df.groupBy(group).applyInPandas(pack, f"{group} int, ids binary, kind string, values binary")


def _exact_kind(q: np.ndarray, x: np.ndarray):
    """Numbers in which no sum of products of the two matrices is rounded; Python's own where a long could overflow."""
    top = max((abs(int(m)) for m in (q.min(initial=0), q.max(initial=0))), default=0) * max(abs(int(m)) for m in (x.min(initial=0), x.max(initial=0))) * x.shape[1]
    return np.float32 if top < 2**24 else np.float64 if top < 2**53 else np.int64 if top < 2**62 else object


def search_shard(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int) -> tuple[list[tuple[int, int, int]], int]:
    """(query, vector, score) of each query's k best in the shard, ties to smaller ids, a query's own id left out; and the postings read."""
    kind = _exact_kind(q, x)
    length = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    falling = np.argsort(-length, kind="stable")
    ids, x, length = ids[falling], x[falling].astype(kind), length[falling]
    qx = q.astype(kind)
    lists = [np.ascontiguousarray(x[at : at + BLOCK].T) for at in range(0, len(ids), BLOCK)]  # postings by term
    zero = np.zeros(x.shape[1], kind)
    bound = np.maximum(np.maximum(qx * x.max(axis=0), qx * x.min(axis=0)), zero) if len(x) else np.zeros(q.shape, kind)
    order = np.argsort(-bound, axis=1, kind="stable")
    rest = np.take_along_axis(bound, order, 1)[:, ::-1].cumsum(1)[:, ::-1]  # bounds of this term and all smaller ones
    norms = np.sqrt((np.take_along_axis(q, order, 1).astype(np.float64) ** 2)[:, ::-1].cumsum(1)[:, ::-1])
    found, read = [], 0
    for i, qid in enumerate(qids):
        o, best, got, floor = order[i], np.empty(0, np.int64), np.empty(0, kind), None
        for b, xb in enumerate(lists):
            at = b * BLOCK
            # essential: without them the bounds could still reach the k-th score
            n = len(o) if floor is None else int((rest[i] >= floor).sum())
            part = qx[i, o[:n]] @ xb[o[:n]] if n else np.zeros(xb.shape[1], kind)
            read += n * xb.shape[1]
            live, score = np.arange(xb.shape[1]), part
            step = max(1, -(-(len(o) - n) // PROBES))
            for a in range(n, len(o) + step, step):  # probe the other terms, largest bound first, while they are competitive
                if floor is not None:
                    left = 0
                    if a < len(o):  # the smaller of the summed bounds and the product of lengths, rounded up
                        left = np.minimum(rest[i, a], np.ceil(norms[i, a] * length[at + live] * (1 + 1e-9)))
                    keep = np.asarray(score + left >= floor, bool)
                    live, score = live[keep], score[keep]
                if a >= len(o) or not len(live):
                    break
                dims = o[a : a + step]
                score = score + qx[i, dims] @ xb[np.ix_(dims, live)]
                read += len(dims) * len(live)
            if kind is object:
                score = np.clip(score, LONG.min, LONG.max)
            own = ids[at + live] != qid
            cand, scores = np.concatenate([best, ids[at + live][own]]), np.concatenate([got, score[own]])
            top = np.lexsort((cand, -scores))[:k]
            best, got = cand[top], scores[top]
            if len(top) == k:
                floor = got[-1]
        found += [(int(qid), int(v), int(s)) for v, s in zip(best, got)]
    return found, read


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best inner products among vectors of another id.

    vectors, queries: (vec_id, v array of long or int). Shorter vectors count as filled up with zeros. Rows with a null id or
    a null vector take no part. Rows that repeat an id are candidates each, and their least vector is the query; a query
    never meets a row of its own id. With fewer than k candidates all are returned; without queries or vectors the result
    is empty. Scores are exact at any size of component; one beyond a long counts as the nearest long. Other columns are
    ignored. Shards and query blocks have a bounded number of rows, whatever the input's size.
    """
    vectors = vectors.select("vec_id", F.col("v").cast("array<long>").alias("v")).dropna()
    queries = queries.select("vec_id", F.col("v").cast("array<long>").alias("v")).dropna().groupBy("vec_id").agg(F.min("v").alias("v"))
    n, dims = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    nq, qdims = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    dims, shards, blocks = max(dims or 1, qdims or 1, 1), max(1, -(-n // shard_rows)), max(1, -(-nq // query_rows))

    def deal(df: DataFrame, group: str, count: int) -> DataFrame:
        return df.withColumn(group, F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int"))

    left = saved(_packed(deal(vectors, "shard", shards), "shard", dims), "maxscore-shards")
    right = saved(_packed(deal(queries, "block", blocks), "block", dims), "maxscore-queries")
    # The grid of shards and query blocks: a join on both numbers, one bounded pair of matrices a row.
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = right.select("block", F.col("ids").alias("qids"), F.col("kind").alias("qkind"), F.col("values").alias("qvalues")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    grid = left.join(right.hint("shuffle_hash"), ["shard", "block"])

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for r in pdf.itertuples(index=False):
                x = np.frombuffer(r.values, r.kind).reshape(-1, dims)
                q = np.frombuffer(r.qvalues, r.qkind).reshape(-1, dims)
                rows, _ = search_shard(np.frombuffer(r.ids, "<i8"), x, np.frombuffer(r.qids, "<i8"), q, k)
                yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    found = grid.mapInPandas(search, "query_id long, vec_id long, score long")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def quantised(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, as a long; vectors null or with null or non-finite components are left out.

    A product beyond a long is taken as the nearest long.
    """
    x = F.transform("embedding", lambda e: e.cast("double"))
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    kept = embeddings.filter(F.col("embedding").isNotNull() & fine)
    return kept.select("vec_id", F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e).cast("long")).alias("v"))


def op2_maxscore(spark, sf_dir: str) -> DataFrame:
    v = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(v, v.filter(F.col("vec_id") % 20 == 0))


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(c.v) + 1), lambda i: c.v[i] * q.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
