"""Operator 13: document fingerprints, bottom-k sketches of shingle hashes.

A sketch holds the k smallest distinct hashes of a text's word shingles, in
order, 16 hex digits each. The sketch of a union of texts is the k smallest of
their sketches' hashes, so parts of a corpus are sketched apart and merged. Two
sketches give the resemblance of their texts' shingle sets (the share of the
union's k smallest that both have), the containment of one in the other and,
alone, the number of distinct shingles.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from heapq import nsmallest

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import table

K = 128
WIDTH = 5
DIGITS = 16


def sketch(text: str, k: int = K, width: int = WIDTH) -> list[str]:
    """The k smallest distinct hashes (first 64 bits of MD5, in hex) of a text's shingles, rising.

    Words are lower-cased in A-Z; a text of 1 to width words has one shingle, the whole; one without words has none.
    """
    words = text.encode("utf-8", "replace").lower().split()
    if len(words) <= width:
        return [hashlib.md5(b" ".join(words)).hexdigest()[:DIGITS]] if words else []
    md5 = hashlib.md5
    found = {md5(s).hexdigest()[:DIGITS] for s in {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}}
    return sorted(found) if len(found) <= k else nsmallest(k, found)


def likeness(a: list[str], b: list[str], k: int = K) -> float:
    """Estimated resemblance of two sketches: of the k smallest hashes of both together, the share that both hold; two empty ones: 1."""
    if a == b:
        return 1.0
    first = sorted({*a, *b})[:k]
    both = {*a} & {*b}
    return sum(h in both for h in first) / len(first)


def hashes(fingerprint: str | Column) -> Column:
    """The hashes of a fingerprint string as an array, rising."""
    c = F.col(fingerprint) if isinstance(fingerprint, str) else fingerprint
    n = (F.length(c) / DIGITS).cast("int")
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(c, (i - 1) * DIGITS + 1, F.lit(DIGITS)))
    return F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))


def _first_of_both(a: Column, b: Column, k: int) -> Column:
    return F.slice(F.array_sort(F.array_union(hashes(a), hashes(b))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The fingerprint of the union of two texts' shingles, from their fingerprints."""
    return F.concat_ws("", _first_of_both(a, b, k))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of two fingerprints' shingle sets; both empty: 1."""
    first = _first_of_both(a, b, k)
    both = F.array_intersect(first, F.array_intersect(hashes(a), hashes(b)))
    return F.when(a == b, F.lit(1.0)).otherwise(F.size(both) / F.size(first))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: among the union's k smallest, of those in a; an empty a: 1."""
    first = _first_of_both(a, b, k)
    own = F.array_intersect(first, hashes(a))
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, hashes(b))) / F.size(own)).when(F.length(a) == 0, F.lit(1.0)).otherwise(F.lit(0.0))


def distinct_shingles(fingerprint: Column, k: int = K) -> Column:
    """Number of distinct shingles: exact under k, else k - 1 by the share of the hash range that the k smallest fill."""
    n = (F.length(fingerprint) / DIGITS).cast("double")
    last = F.conv(F.substr(fingerprint, F.lit((k - 1) * DIGITS + 1), F.lit(DIGITS)), 16, 10).cast("double")
    return F.when(n < k, n).otherwise(F.lit(float(k - 1)) / ((last + 1) / F.lit(2.0**64)))


def merged_by(sketches: DataFrame, by: str, fingerprint: str = "fingerprint", k: int = K) -> DataFrame:
    """(by, fingerprint): one fingerprint a group, as if all its texts' shingles were one set.

    Every row gives at most k hashes, equal ones meet before the shuffle and a task sends on only a group's k smallest.
    Null fingerprints count as empty; a null group is a group; groups without any hash have an empty fingerprint.
    """
    rows = sketches.select(F.col(by).alias("_by"), F.explode_outer(hashes(F.coalesce(F.col(fingerprint), F.lit("")))).alias("_h")).distinct()
    least = rows.withColumn("_r", F.row_number().over(W.partitionBy("_by").orderBy(F.col("_h").asc_nulls_last()))).filter(F.col("_r") <= k)
    return least.groupBy("_by").agg(F.concat_ws("", F.array_sort(F.collect_list("_h"))).alias("fingerprint")).select(F.col("_by").alias(by), "fingerprint")


def fingerprinted(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """(doc_id, fingerprint) of every row; null text is empty, an empty text has an empty fingerprint. Other columns are ignored."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("_text"))
    schema = docs.select("doc_id").withColumn("fingerprint", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = ["".join(sketch(t.as_py().decode("utf-8", "replace"), k, width)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    return rows.mapInArrow(run, schema)


def _place(docs: DataFrame) -> DataFrame:
    """(_key, doc_id, _text): the key sorts rows by falling doc_id, null ids last, equal ids by the MD5 of the text."""
    text = F.coalesce("text", F.lit(""))
    down = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(2**63 - 1))), 16, "0")  # rises as doc_id falls, within each sign
    side = F.when(F.col("doc_id").isNull(), "2").when(F.col("doc_id") >= 0, "0").otherwise("1")
    return docs.select(F.concat(side, F.coalesce(down, F.lit("")), F.md5(text.cast("binary"))).alias("_key"), F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("_text"))


def with_next(docs: DataFrame) -> DataFrame:
    """(_part, _guest, doc_id, _text) sorted in partitions so that every row's next document follows it.

    Rows are cut into parts by ranges of the key. The first keys of the parts, one a partition, are all that the driver sees;
    a part's first document also ends the part before it, as a guest, and the very first ends the last part.
    """
    rows = _place(docs)
    spread = rows.select("_key").repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_key")
    firsts = sorted(r[0] for r in spread.groupBy(F.spark_partition_id()).agg(F.min("_key").alias("k")).select("k").distinct().collect())
    at, last = {key: i for i, key in enumerate(firsts)}, len(firsts) - 1

    @F.pandas_udf("array<int>")
    def parts(keys: pd.Series) -> pd.Series:
        """The row's part, and the part that it ends as a guest."""
        return keys.map(lambda x: [bisect_right(firsts, x) - 1] + ([at[x] - 1 if at[x] else last] if x in at else []))

    dealt = rows.select("*", F.posexplode(parts("_key")).alias("_guest", "_part"))
    dealt = dealt.repartitionById(max(len(firsts), 1), F.col("_part")).sortWithinPartitions("_part", "_guest", "_key")
    return dealt.select("_part", "_guest", "doc_id", "_text")


def edited_fingerprints(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """Each text's fingerprint beside those of its edited text and of the next document.

    The edited text has the last half of its code points (rounded down) replaced by the first as many of the next document,
    or all of that if it is shorter. Next is by falling doc_id; after the last comes the first, so a single document is its
    own next. Null ids come last, equal ids in the order of the MD5 of their texts. Null text is empty. Returns doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next; other columns are ignored and an
    empty table gives an empty result. Texts cross one shuffle. Rows equal in id and text stream through one task and are
    hashed once. Bytes that are not UTF-8 are read as U+FFFD.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def compared(doc_id: int | None, text: str, own: list[str], follower: str, after: list[str]) -> tuple:
        n = len(text)
        edited = text[: n - n // 2] + follower[: n // 2]
        changed = sketch(edited, k, width)
        digest = hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest()
        return (doc_id, n, digest, "".join(own), "".join(changed), likeness(own, changed, k), likeness(own, after, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, guests, held = None, 0, None
        for b in batches:
            out = []
            for p, guest, doc_id, raw in zip(*(b.column(i).to_pylist() for i in range(4))):
                if p != part:
                    part, guests, held = p, 0, None
                guests += guest
                if guests > 1:  # equal rows are guests together; one is enough
                    continue
                text = raw.decode("utf-8", "replace")
                own = held[2] if held and held[1] == text else sketch(text, k, width)
                if held:
                    out.append(compared(*held, text, own))
                held = (doc_id, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return with_next(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op13_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


OP13_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
 o AS (SELECT *, row_number() OVER w AS place, lead(text) OVER w AS following, first_value(text) OVER w AS first_text FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, md5(text))),
 e AS (SELECT place, doc_id, text, coalesce(following, first_text) AS following, left(text, length(text) - length(text) // 2) || left(coalesce(following, first_text), length(text) // 2) AS edited FROM o),
 t AS (SELECT place, 0 AS which, text AS body FROM e UNION ALL SELECT place, 1, edited FROM e UNION ALL SELECT place, 2, following FROM e),
 w AS (SELECT place, which, regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM t),
 h AS (SELECT place, which, list_sort(list_distinct(list_transform(CASE WHEN len(ws) = 0 THEN [] ELSE range(1, greatest(len(ws) - 4, 1) + 1) END, lambda i: substr(md5(array_to_string(ws[i:i + 4], ' ')), 1, 16))))[:128] AS hs FROM w),
 s AS (SELECT e.*, a.hs AS own, b.hs AS changed, c.hs AS after FROM e JOIN h a ON a.place = e.place AND a.which = 0 JOIN h b ON b.place = e.place AND b.which = 1 JOIN h c ON c.place = e.place AND c.which = 2),
 u AS (SELECT *, list_sort(list_distinct(list_concat(own, changed)))[:128] AS x, list_sort(list_distinct(list_concat(own, after)))[:128] AS y FROM s)
 SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(own, '') AS fingerprint, array_to_string(changed, '') AS edited_fingerprint,
  CASE WHEN own = changed THEN 1.0::DOUBLE ELSE len(list_intersect(x, list_intersect(own, changed)))::DOUBLE / len(x) END AS near_edited,
  CASE WHEN own = after THEN 1.0::DOUBLE ELSE len(list_intersect(y, list_intersect(own, after)))::DOUBLE / len(y) END AS near_next FROM u"""
