"""Operator 7: best-fit packing with certified bin counts.

Documents are tokenised and cut; pieces of full length are sequences of their
own. The rest is packed group by group with best-fit decreasing. Dual-feasible
functions give each group a lower bound of its sequence count; a group that
reaches the bound is certified. The others keep their full sequences and give
the pieces of the rest to common groups, where best-fit decreasing runs again,
until all groups are certified or no round saves a sequence.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, table

CAPACITY = 1024
GROUP_PIECES = 20_000
#: Distinct chunks whose ids a worker keeps; beyond it the store is emptied and filled again.
KEPT_CHUNKS = 800_000
KEPT_CHARS = 64
#: A space that the vocabulary's pattern may join with white space after it.
LOOSE_SPACE = re.compile(r" (?=\s|\Z)")

_encoders: dict[str, Encoder] = {}  # one per Python worker


class _Store(dict):
    """Ids of chunks by the chunk; a chunk that is not there is encoded."""

    def __init__(self, encode, before: str):
        self.encode, self.before = encode, before

    def __missing__(self, chunk: str) -> bytes:
        found = array("I", self.encode(self.before + chunk)).tobytes()
        if len(chunk) <= KEPT_CHARS:
            if len(self) >= KEPT_CHUNKS:
                self.clear()
            self[chunk] = found
        return found


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    A byte-level BPE pattern never joins characters across a space that stands before a character that is not white
    space, so a text can be cut there, and chunks that come again take their ids from a store. New chunks are encoded by
    tiktoken with the file's own vocabulary, where its merges are in the order of their ids; else by tokenizers. A text
    that holds the string of a special token goes to tokenizers whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallel work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        self.cut = made["normalizer"] is None and made["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.special = [t["content"] for t in made["added_tokens"]]
        self.plain = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        encode = (self._ranked(made) if self.cut else None) or self.plain
        self.first, self.later = _Store(encode, ""), _Store(encode, " ")

    @staticmethod
    def _ranked(made: dict):
        """tiktoken's encoder of the same vocabulary, or None if the merges don't follow the ids."""
        import tiktoken
        from public_tokenizers import PATTERN

        vocab, merges = made["model"]["vocab"], made["model"]["merges"]
        ids = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in merges]
        if ids != sorted(ids):
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        special = {t["content"] for t in made["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in special}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The text cut at spaces before characters that are not white space; the spaces are left out."""
        parts = text.split(" ")
        if not LOOSE_SPACE.search(text):
            return parts
        out = [parts[0]]
        for p in parts[1:]:
            if p and not p[0].isspace():
                out.append(p)
            else:
                out[-1] += " " + p
        return out

    def encode(self, text: str) -> bytes:
        if not self.cut or any(s in text for s in self.special):
            return array("I", self.plain(text)).tobytes()
        cs = self.chunks(text)
        return self.first[cs[0]] + b"".join(map(self.later.__getitem__, cs[1:]))


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 2, keep_ids: bool = True) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32, ids): the documents' pieces.

    A document is its text's ids (null: none) and then end_id. One longer than capacity is cut so that all pieces but the
    first have capacity tokens. row tells apart rows that repeat a doc_id.
    """
    fields = "row long, doc_id long, piece int, start long, length int, ids_crc32 long" + (", ids binary" if keep_ids else "")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _encoders:
            _encoders[tokenizer_path] = Encoder(tokenizer_path)
        encoder = _encoders[tokenizer_path]
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                rows, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
                out: list[list] = [[] for _ in range(7)]
                for row, doc, text in zip(rows, ids, b.column(2)):
                    enc = encoder.encode(text.as_py() or "") + end
                    n = len(enc) // 4
                    first = n % capacity or min(n, capacity)
                    a, piece = 0, 0
                    while a < n:
                        z = first if not piece else a + capacity
                        part = enc[4 * a : 4 * z]
                        for o, v in zip(out, (row, doc, piece, a, z - a, zlib.crc32(part), part)):
                            o.append(v)
                        a, piece = z, piece + 1
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                names = ["row", "doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                n_cols = 7 if keep_ids else 6
                yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)][:n_cols], names=names[:n_cols])

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, fields)


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """Fewest bins that any packing of counts[s] items of size s needs, by dual-feasible functions.

    A dual-feasible function keeps the sum of any sizes that fit into a bin within the capacity, so its sum over all items,
    divided by the capacity, bounds the bins from below. Taken here: the identity, the functions that set sizes above
    capacity - e to the capacity and drop those below e, and the rounding functions of k = 1..20.
    """
    counts = np.asarray(counts, np.int64)
    s = np.arange(len(counts), dtype=np.int64)
    best = -(-int((counts * s).sum()) // capacity)
    suffix, weight = np.concatenate([counts[::-1].cumsum()[::-1], [0]]), np.concatenate([(counts * s)[::-1].cumsum()[::-1], [0]])
    for e in range(1, capacity // 2 + 1):
        high = min(capacity - e + 1, len(counts))
        low = min(e, len(counts))
        best = max(best, -(-int(suffix[high] * capacity + weight[low] - weight[high]) // capacity))
    for k in range(1, 21):
        grown = s * (k + 1)
        value = np.where(grown % capacity == 0, s * k, (grown // capacity) * capacity)  # k times the function
        best = max(best, -(-int((counts * value).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every item, and the bins' fill: largest first, each into the fullest bin that has room."""
    bins, offsets, fill = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has exactly r left
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        can = rooms >> s
        if can:
            r = s + (can & -can).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                rooms &= ~(1 << r)
        else:
            b, r = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += s
        r -= s
        if r:
            by_room[r].append(b)
            rooms |= 1 << r
    return bins, offsets, np.array(fill, np.int64)


def _pack_round(items: DataFrame, number: int, capacity: int) -> DataFrame:
    """Items (g, row, piece, length) with sequence, offset, open: best-fit decreasing in each group g; open if the group
    is above its bound and the sequence is not full."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "piece"])
        sizes = pdf["length"].to_numpy()
        bins, offsets, fill = best_fit_decreasing(sizes, capacity)
        gap = len(fill) - lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        g = int(pdf["g"].iloc[0])
        return pd.DataFrame({"row": pdf["row"], "piece": pdf["piece"], "length": sizes, "sequence": (number << 54) + (g << 22) + bins, "offset": offsets, "open": (gap > 0) & (fill[bins] < capacity)})

    return items.groupBy("g").applyInPandas(run, "row long, piece int, length int, sequence long, offset long, open boolean")


def packed(cut: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """(row, piece, sequence_id, offset) for pieces (row, piece, length) of 1..capacity tokens.

    Full pieces are sequences of their own. Groups have about group_pieces pieces, whatever the input's size. Each round
    takes the pieces of not full sequences of groups above their bound, deals them to fewer groups and packs again; it is
    kept if it needs fewer sequences, else the packing before it stays. The rounds end when all groups are certified, when
    the open pieces are one group, or when a round saves nothing. An empty table gives an empty result.
    """
    place = ["row", "piece", F.col("sequence").alias("sequence_id"), "offset"]
    done = [cut.filter(F.col("length") == capacity).select("row", "piece", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest, before, used, number = cut.filter(F.col("length") < capacity).select("row", "piece", "length"), None, None, 0
    while n := rest.count():
        groups = max(1, -(-n // group_pieces))
        dealt = rest.withColumn("g", F.pmod(F.xxhash64("row", "piece", F.lit(number)), F.lit(groups)).cast("long"))
        now = saved(_pack_round(dealt, number, capacity), "packed")
        sequences = now.groupBy("sequence").agg(F.first("open").alias("open"), F.sum("length").alias("length"))
        total, opened, tokens = sequences.agg(F.count("*"), F.count(F.when(F.col("open"), 1)), F.coalesce(F.sum(F.when(F.col("open"), F.col("length"))), F.lit(0))).first()
        if used is not None and total >= used:  # nothing saved
            done.append(before.select(*place))
            break
        done.append(now.filter("not open").select(*place))
        # a single group has nobody to exchange with; nor is there a sequence to save where the open ones' sum needs as many
        if groups == 1 or opened <= -(-tokens // capacity):
            done.append(now.filter("open").select(*place))
            break
        before, used, number = now.filter("open"), opened, number + 1
        rest = before.select("row", "piece", "length")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 2, keep_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset) of every piece of every document.

    Null and empty texts are the end token alone. Rows that repeat a doc_id are packed each. Other columns are ignored.
    The ids leave with the pieces (keep_ids), so that a sequence is its pieces' ids in the order of their offsets.
    """
    cut = saved(pieces(docs, tokenizer_path, capacity, end_id, keep_ids), "pieces")
    where = packed(cut.select("row", "piece", "length"), capacity)
    return cut.hint("merge").join(where.hint("merge"), ["row", "piece"]).drop("row")


def op7_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
