"""Operator 8: WARC archives and a normaliser for monolithic gzip files.

Writers often compress a whole archive as one gzip stream, which can only be
read from its start. The normaliser inflates such a stream once, in pieces of
bounded size, writes every record as a gzip member of its own, and lists the
members' offsets in a sidecar index. Records are then read one by one by
(file, offset, length).

Files go through pyarrow's file systems, so that a path is any URI that the
executors share. A file is written under an attempt's own name and then moved:
a repeated task gives the same file again.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, remove, saved, saved_at, table

#: Rows to a written archive, about; and the bytes that the normaliser reads at once.
ARCHIVE_ROWS = 2_000
CHUNK = 1 << 20
INDEX_ROWS = 1_000
LEVEL = 3
INDEX = "file string, offset long, length long, warc_type string, record_id string, refers_to string, uri string, payload_digest string"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI; Hadoop's s3a is the file systems' s3."""
    path = path.replace("s3a://", "s3://", 1) if path.startswith("s3a://") else path
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def digest(payload: Column) -> Column:
    """SHA-1 of a binary column in base 32, upper case: ten hexadecimal digits are eight of base 32."""
    parts = [F.lpad(F.conv(F.substring(F.sha1(payload), 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record(kind: str, record_id: str, uri: str | None, payload: bytes, payload_digest: str, refers_to: str | None = None) -> bytes:
    """One WARC/1.1 record. A revisit has the headers of its answer only; its digest is that of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if kind == "response" else b"")
    clean = (uri or "urn:none").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{payload_digest}"]
    if refers_to:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    """The named fields of a record's head, names in lower case."""
    out = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        out[k.decode("utf-8", "replace").strip().lower()] = v.decode("utf-8", "replace").strip()
    return out


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(fields, head with its blank line, block) of each record of an inflated stream; holds one record at a time."""
    buf, more = bytearray(), True

    def need(n: int) -> bool:
        nonlocal more
        while len(buf) < n and more:
            c = next(chunks, None)
            if c is None:
                more = False
            else:
                buf.extend(c)
        return len(buf) >= n

    while True:
        while need(2) and buf[:2] == b"\r\n":  # the two line ends after a record
            del buf[:2]
        if not need(1):
            return
        seen = 0
        while (end := buf.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(buf)
            if not need(seen + 1):
                raise ValueError("the archive ends inside a record's head")
        head = bytes(buf[: end + 4])
        fields = parse_head(head[:-4])
        if not fields.get("content-length", "").isdigit():
            raise ValueError(f"a record's head has no content-length: {head[:200]!r}")
        n = int(fields["content-length"])
        if not need(end + 4 + n):
            raise ValueError("the archive ends inside a record")
        yield fields, head, bytes(buf[end + 4 : end + 4 + n])
        del buf[: end + 4 + n]


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip file of one or many members, in bounded pieces."""
    z = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            out = z.decompress(data, 4 * CHUNK)
            if out:
                yield out
            if z.eof:
                data, z = z.unused_data, zlib.decompressobj(31)
            else:
                data = z.unconsumed_tail
    if out := z.flush():
        yield out


def _identify(record_id: str) -> str:
    return record_id.strip("<>")


def write_monolithic(rows: DataFrame, folder: str) -> DataFrame:
    """Writes (record_id, uri, payload, kind, refers_to, payload_digest), one whole-file gzip archive a partition; returns (file, bytes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, total, moved = None, None, 0, None
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        for b in batches:
            for rid, uri, payload, kind, refers, dig in zip(*[b.column(i) for i in range(6)]):
                if out is None:
                    name = f"{folder}/{hashlib.sha1(str(rid).encode()).hexdigest()}.warc.gz"
                    system, path = _open(name)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    moved = f"{path}.{uuid.uuid4().hex}"
                    out = system.open_output_stream(moved, compression=None)
                data = z.compress(record(kind.as_py(), rid.as_py(), uri.as_py(), payload.as_py() or b"", dig.as_py(), refers.as_py()))
                total += len(data)
                out.write(data)
        if out is not None:
            data = z.flush()
            out.write(data)
            out.close()
            system.move(moved, path)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([total + len(data)], pa.int64())], names=["file", "bytes"])

    dealt = rows.select("record_id", "uri", "payload", "kind", "refers_to", "payload_digest")
    return dealt.mapInArrow(run, "file string, bytes long")


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Rewrites every archive of files (file) with a gzip member a record, into folder; returns the index of all members.

    Each archive is inflated once as a stream; memory holds one record and INDEX_ROWS lines of the index. Beside each new
    archive lies its index as <name>.index.csv (offset, length, type, record id).
    """
    names = [c.split()[0] for c in INDEX.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for name in pdf["file"]:
                source, path = _open(name)
                target = f"{folder}/{name.rpartition('/')[2]}"
                system, to = _open(target)
                system.create_dir(to.rpartition("/")[0], recursive=True)
                part, rows, at = f"{to}.{uuid.uuid4().hex}", [], 0
                with source.open_input_stream(path, compression=None) as i, system.open_output_stream(part, compression=None) as o, system.open_output_stream(f"{part}.csv", compression=None) as side:
                    for f, head, block in records(inflated(i)):
                        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = z.compress(head + block + b"\r\n\r\n") + z.flush()
                        o.write(member)
                        rows.append((target, at, len(member), f.get("warc-type"), _identify(f.get("warc-record-id", "")), _identify(f["warc-refers-to"]) if "warc-refers-to" in f else None, f.get("warc-target-uri"), f.get("warc-payload-digest", "").removeprefix("sha1:")))
                        at += len(member)
                        side.write(f"{rows[-1][1]},{rows[-1][2]},{rows[-1][3]},{rows[-1][4]}\n".encode())
                        if len(rows) == INDEX_ROWS:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                system.move(part, to)
                system.move(f"{part}.csv", f"{to}.index.csv")
                yield pd.DataFrame(rows, columns=names)

    return files.select("file").mapInPandas(run, INDEX)


def read_records(index: DataFrame) -> DataFrame:
    """The index's records with payload (the bytes after the HTTP head; null for a revisit), each read at its offset."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened: dict[str, object] = {}
        for pdf in parts:
            pdf = pdf.sort_values(["file", "offset"])
            for a in range(0, len(pdf), 64):
                few, payloads = pdf.iloc[a : a + 64].copy(), []
                for name, at, n, kind in zip(few["file"], few["offset"], few["length"], few["warc_type"]):
                    if name not in opened:
                        for f in opened.values():
                            f.close()
                        system, path = _open(name)
                        opened = {name: system.open_input_file(path)}
                    data = zlib.decompress(opened[name].read_at(n, at), 31)
                    _, _, block = next(records(iter([data])))
                    payloads.append(block.partition(b"\r\n\r\n")[2] if kind == "response" else None)
                few["payload"] = payloads
                yield few
        for f in opened.values():
            f.close()

    return index.mapInPandas(run, INDEX + ", payload binary")


def archive_pages(pages: DataFrame, folder: str, min_bytes: int = 0, archive_rows: int = ARCHIVE_ROWS) -> DataFrame:
    """Writes (page_id, url, html) as monolithic archives, normalises them and returns the index.

    Of records with equal payloads of at least min_bytes bytes the one with the largest page_id is the response; the
    others revisit it. Equality is that of length and SHA-1, summed up by an aggregate, so a payload that thousands of
    pages share is no group of pairs. Null html is an empty payload; a null page_id is smaller than any other. Of rows that
    repeat the largest page_id with an equal payload, one is the response and the others revisit it. Other columns are
    ignored. An empty table gives an empty index.

    The rows are numbered once, in a saved table, so that all steps mean the same row whatever the files' splits. That table
    and the whole archives are removed once the next step has written what it takes from them.
    """
    spark = pages.sparkSession
    rows = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows, numbered_at = saved_at(rows.withColumn("payload_digest", digest(F.col("payload"))).withColumn("bytes", F.length("payload").cast("long")), "warc-numbered")
    keyed = rows.select("row", "page_id", "payload_digest", "bytes")
    best = keyed.filter(F.col("bytes") >= min_bytes).groupBy("payload_digest", "bytes").agg(F.max(F.struct("page_id", "row")).alias("best"))
    firsts = keyed.hint("merge").join(best.hint("merge"), ["payload_digest", "bytes"], "left").select("row", F.col("best.row").alias("first_row"), F.col("best.page_id").alias("first_page"))
    files = max(1, -(-keyed.count() // archive_rows))
    numbered = rows.repartition(files, "row").hint("merge").join(firsts.repartition(files, "row").hint("merge"), "row")  # the payloads' only shuffle
    revisit = F.col("first_row").isNotNull() & (F.col("first_row") != F.col("row"))

    def name(page, row):
        return F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), row.cast("string"))

    records_ = numbered.select(name(F.col("page_id"), F.col("row")).alias("record_id"), F.col("url").alias("uri"), F.when(~revisit, F.col("payload")).alias("payload"), F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, name(F.col("first_page"), F.col("first_row"))).alias("refers_to"), "payload_digest")
    written = saved(write_monolithic(records_, f"{folder}/whole"), "warc-written")
    remove(spark, numbered_at)
    index = saved(normalise(written.repartition(max(1, min(written.count(), 10_000)), "file"), f"{folder}/members"), "warc-index")
    remove(spark, f"{folder}/whole")
    return index


def read_back(index: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to; revisits take the bytes of their response."""
    got = read_records(index).select("record_id", "warc_type", F.col("refers_to").alias("refers"), F.length("payload").cast("long").alias("n"), digest(F.col("payload")).alias("found"))
    got = saved(got, "warc-read")
    page = lambda c: F.when(F.split(c, ":")[2] != "none", F.split(c, ":")[2].cast("long"))
    own = got.filter("warc_type = 'response'").select(page(F.col("record_id")).alias("page_id"), F.col("n").alias("payload_bytes"), F.col("found").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    full = got.filter("warc_type = 'response'").select(F.col("record_id").alias("refers"), F.col("n").alias("full_n"), F.col("found").alias("full_found"))
    again = got.filter("warc_type = 'revisit'").hint("merge").join(full.hint("merge"), "refers", "left")
    again = again.select(page(F.col("record_id")).alias("page_id"), F.col("full_n").alias("payload_bytes"), F.col("full_found").alias("payload_digest"), F.lit("revisit").alias("record_type"), page(F.col("refers")).alias("refers_to"))
    return own.unionByName(again)


def archive_folder(spark: SparkSession) -> str:
    return fresh_path(spark, "warc")


def op8_warc(spark, sf_dir: str) -> DataFrame:
    return read_back(archive_pages(table(spark, sf_dir, "pages"), archive_folder(spark)))


# Base 32 takes five bits a letter: four letters from every five hexadecimal digits of the SHA-1.
OP8_SQL = """WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
 m AS (SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS best FROM p)
 SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to FROM m"""
