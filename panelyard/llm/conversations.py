"""Operator 11: conversation structure repair by prefix-doubling path ranking.

A repair walks a conversation's rows and keeps, reroles or deletes each, and
inserts empty turns, so that the roles' initials read (s?(ua)+)?. A node of the
graph is a number of consumed rows and one of four states: nothing yet, after
the system row, after a user, after an assistant. Costs to the end come from a
dynamic program; the arcs that keep to them are the optimal arcs. Among these,
the least audit (the string of the arcs' initials) is found by ranking nodes by
the first 1, 2, 4, ... initials of their audits: a node's rank at twice the
length is the rank of the pair of its own and that of the node its pointer leads
to, and pointers double along. Each initial leaves a node by one arc at most, so
a rank fixes the pointer it needs.

Long conversations are cut into blocks. A block's costs are a 4 by 4 matrix, and
matrices combine by sums and minima, again in doubling steps, as do the states
in which blocks begin; no task holds a conversation's rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import BLANKS, saved, scratch, table

#: Rows of a block, at most; a power of two.
BLOCK = 1024
#: Nodes that one numpy batch of blocks has, at most (one block at least).
BATCH_NODES = 1 << 18
# The costs of the edits and of an undeleted truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
FAR = 1 << 40
START, SYSTEM, USER, ASSISTANT = range(4)
# Cost and details of closing after the last row, by state: u and a insert a user or an assistant.
CLOSING = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
CLOSING_EDITS = ["", "ua", "a", ""]
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def _key(conv_id: str = "conv_id") -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit("null"))


def _turns(rows: DataFrame) -> DataFrame:
    """(_c, conv_id, turn, role, text, _n): equal rows of a conversation and turn as one with their number; null role and text are one space."""
    blank = {c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")}
    return rows.select(_key().alias("_c"), "conv_id", "turn", "role", "text").withColumns(blank).groupBy("_c", "conv_id", "turn", "role", "text").agg(F.count("*").alias("_n"))


def _faults(turns: DataFrame) -> DataFrame:
    """turns with _fault: blank, duplicate, truncated or null, the first that holds; copies beyond the first are duplicates anyway."""
    body = F.rtrim("text", F.lit(BLANKS))
    marked = turns.withColumns({"_same": F.sha2("text", 256), "_blank": F.length(body) == 0, "_cut": ~F.substr(body, F.length(body), F.lit(1)).isin(*".!?"), "_when": F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))})
    first = marked.groupBy("_c", "role", "_same").agg(F.min("_when").alias("_first"))
    joined = marked.join(first.hint("merge"), ["_c", "role", "_same"])
    fault = F.when(F.col("_blank"), "blank").when(~F.col("_when").eqNullSafe(F.col("_first")), "duplicate").when(F.col("_cut"), "truncated")
    return joined.withColumn("_fault", fault).drop("_same", "_blank", "_cut", "_when", "_first")


def ordered(rows: DataFrame) -> DataFrame:
    """(_c, conv_id, turn, role, text, _n, _fault, _place), saved: _place rises along each conversation, by turn (nulls first), role and text.

    Rows are dealt by ranges of conversation, turn, role and the text's beginning, so a long conversation lies in many partitions.
    """
    turns = _faults(_turns(rows))
    by = ["_c", F.col("turn").isNotNull(), "turn", "role"]
    dealt = turns.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, F.substr("text", F.lit(1), F.lit(32)))
    return saved(dealt.sortWithinPartitions(*by, "text").withColumn("_place", F.monotonically_increasing_id()), "repair-rows")


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """(_c, _b, _i, _last, places, codes, roles, ns): bounded runs of a conversation's rows in order, numbered by _i from 0."""
    initial = F.substr("role", F.lit(1), F.lit(1))
    gone = F.col("_fault").isin("blank", "duplicate")
    code = F.when(F.coalesce(gone, F.lit(False)), -1).otherwise(F.when(initial == "s", 0).when(initial == "u", 2).when(initial == "a", 4).otherwise(6) + F.when(F.col("_fault") == "truncated", 1).otherwise(0))
    row = F.struct("_place", code.cast("int").alias("code"), initial.alias("initial"), "_n")
    cut = rows.groupBy("_c", F.shiftright("_place", block.bit_length() - 1).alias("_b")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    along = W.partitionBy("_c").orderBy("_b")  # a row a block
    cut = cut.withColumns({"_i": F.row_number().over(along) - 1, "_last": F.lead("_b").over(along).isNull(), "_before": F.lag(F.element_at("r", -1)["initial"]).over(along)})
    return cut.select("_c", "_b", "_i", "_last", "_before", F.col("r._place").alias("places"), F.col("r.code").alias("codes"), F.col("r.initial").alias("initials"), F.col("r._n").alias("ns"))


def _row_costs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs [row, state] of keeping the row, and of its reroling; FAR where the state forbids it or the row must go."""
    kind, cut = np.where(codes < 0, 9, codes >> 1), np.where(codes < 0, 0, codes & 1) * TRUNCATED
    keep, rerole = np.full((*codes.shape, 4), FAR, np.int64), np.full((*codes.shape, 4), FAR, np.int64)
    for state, kinds in ((START, (0, 1)), (SYSTEM, (1,)), (USER, (2,)), (ASSISTANT, (1,))):
        keep[..., state] = np.where(np.isin(kind, kinds), cut, FAR)
        rerole[..., state] = np.where(codes < 0, FAR, REROLE + cut)
    return keep, rerole


def _kept_state(codes: np.ndarray) -> np.ndarray:
    """The state [row, state] after keeping the row."""
    system = (codes >> 1 == 0)[..., None]
    return np.where(system & (np.arange(4) == START), SYSTEM, np.array(NEXT))


# The state after the next user or assistant, by state.
NEXT = [USER, USER, ASSISTANT, USER]


def node_costs(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Cost to the end of every node [block, row, state]; codes [block, row], ends [block, state] the costs after the last row.

    Blocks are padded in front with code -2, a row that costs nothing and changes nothing.
    """
    b, m = codes.shape
    out = np.empty((b, m + 1, 4), np.int64)
    out[:, m] = ends
    keep, rerole = _row_costs(codes)
    kept = _kept_state(codes)
    for i in range(m - 1, -1, -1):
        after = out[:, i + 1]
        pad = (codes[:, i] == -2)[:, None]
        here = np.where(pad, after, np.minimum(DELETE + after, np.minimum(keep[:, i] + np.take_along_axis(after, kept[:, i], 1), rerole[:, i] + after[:, NEXT])))
        # Inserted users and assistants: one or two lead from any state to any that can follow.
        u, a = np.minimum(here[:, USER], INSERT + here[:, ASSISTANT]), np.minimum(here[:, ASSISTANT], INSERT + here[:, USER])
        start, system = np.minimum(here[:, START], INSERT + u), np.minimum(here[:, SYSTEM], INSERT + u)
        out[:, i] = np.where(pad, here, np.stack([start, system, u, a], 1))
    return out


def least_arcs(codes: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Targets [block, row, state, initial] of the optimal arcs, initials in the order D I K R, as indices of all nodes; -1: no such arc.

    Nodes after the last row are the block's exits and have no arcs.
    """
    b, m = codes.shape
    node = np.arange(b * (m + 1) * 4).reshape(b, m + 1, 4)
    keep, rerole = _row_costs(codes)
    kept = _kept_state(codes)
    here, after, ahead = cost[:, :-1], cost[:, 1:], node[:, 1:]
    pad = (codes == -2)[..., None]
    arcs = np.full((b, m + 1, 4, 4), -1, np.int64)
    arcs[:, :-1, :, 0] = np.where(pad | (here == DELETE + after), ahead, -1)
    arcs[:, :-1, :, 1] = np.where(~pad & (here == INSERT + here[..., NEXT]), node[:, :-1][..., NEXT], -1)
    arcs[:, :-1, :, 2] = np.where(~pad & (here == keep + np.take_along_axis(after, kept, 2)), np.take_along_axis(ahead, kept, 2), -1)
    arcs[:, :-1, :, 3] = np.where(~pad & (here == rerole + after[..., NEXT]), ahead[..., NEXT], -1)
    return arcs


def rank_paths(arcs: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ranks of the nodes by their least audits, and pointers to the nodes 1, 2, 4, ... arcs further along them.

    arcs [node, initial]: targets, -1 where there is none. A node without arcs points to itself and has the empty audit,
    the least. Ranks by audits of twice the length are ranks of pairs, as long as any pointer still moves.
    """
    own = np.arange(len(arcs))
    there = arcs >= 0
    least = np.where(there.any(1), there.argmax(1), -1)
    pointer = np.where(least >= 0, arcs[own, least], own)
    rank, pointers = least + 1, [pointer]
    while True:
        rank = np.unique(rank * np.int64(len(arcs) + 5) + rank[pointers[-1]], return_inverse=True)[1]
        longer = pointers[-1][pointers[-1]]
        if (longer == pointers[-1]).all():
            break
        pointers.append(longer)
    # The arc of least initial and least rank beyond it: what the ranks select.
    best = np.where(there, np.arange(4) * np.int64(len(arcs) + 5) + rank[arcs], np.iinfo(np.int64).max)
    pointers[0] = np.where(least >= 0, arcs[own, best.argmin(1)], own)
    return rank, pointers


def walks(start: np.ndarray, pointers: list[np.ndarray]) -> np.ndarray:
    """The nodes [walk, step] from each start, all steps at once by doubling: steps 2 ** j to 2 ** (j + 1) are pointers j of those before."""
    seen = start[:, None]
    for p in pointers:
        seen = np.concatenate([seen, p[seen]], 1)
    return seen


def _edits(codes: np.ndarray, ns: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """Per block: costs of its entry states, their exit states, and for each entry the details of the rows' edits, joined by blanks.

    Details: D, K, U and A (reroled to user or assistant), each after the inserts u and a that precede it; equal copies of a
    row follow as D.
    """
    b, m = codes.shape
    cost = node_costs(codes, ends)
    rank, pointers = rank_paths(least_arcs(codes, cost).reshape(-1, 4))
    start = (np.arange(b)[:, None] * ((m + 1) * 4) + np.arange(4)).ravel()
    path = walks(start, pointers)
    row, state = path // 4 % (m + 1), path % 4
    exits = state[:, -1].reshape(b, 4)
    texts = []
    for j in range(b):
        pads = int((codes[j] == -2).sum())
        own = []
        for e in range(4):
            r, s = row[4 * j + e], state[4 * j + e]
            moved = (r[1:] != r[:-1]) | (s[1:] != s[:-1])
            r, s = r[: int(moved.sum()) + 1].tolist(), s[: int(moved.sum()) + 1].tolist()
            parts, lead, c, n = [], "", codes[j].tolist(), ns[j].tolist()
            for at, was, to, now in zip(r, s, r[1:], s[1:]):
                if to == at:
                    lead += "u" if now == USER else "a"
                    continue
                if at < pads:
                    continue
                if was == now:
                    letter = "D"
                elif _keeps(c[at], was, now):
                    letter = "K"
                else:
                    letter = "U" if now == USER else "A"
                parts.append(lead + letter + "D" * (n[at] - 1))
                lead = ""
            own.append(" ".join(parts))
        texts.append(own)
    return cost[:, 0], exits, texts


def _keeps(code: int, was: int, now: int) -> bool:
    """Whether keeping the row leads from one state to the other; where it does, no optimal path reroles it."""
    return (code >> 1, was, now) in ((0, START, SYSTEM), (1, START, USER), (1, SYSTEM, USER), (2, USER, ASSISTANT), (1, ASSISTANT, USER))


def _padded(codes: list, ns: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of blocks of like length: their numbers, codes and copies, padded in front."""
    sizes = np.array([len(c) for c in codes])
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and 4 * (to + 1 - at) * (sizes[order[to]] + 1) <= BATCH_NODES and sizes[order[to]] <= 2 * sizes[order[at]] + 8:
            to += 1
        pick, m = order[at:to], int(sizes[order[to - 1]])
        c, n = np.full((len(pick), m), -2, np.int64), np.ones((len(pick), m), np.int64)
        for j, i in enumerate(pick):
            c[j, m - sizes[i] :], n[j, m - sizes[i] :] = codes[i], ns[i]
        yield pick, c, n
        at = to


def _matrices(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Costs from each entry state to each exit state of the blocks, 16 a block by rows."""
    for pdf in parts:
        out = [None] * len(pdf)
        for pick, codes, _ in _padded(pdf["codes"].tolist(), pdf["ns"].tolist()):
            columns = [node_costs(codes, np.broadcast_to(np.where(np.arange(4) == e, 0, FAR), (len(pick), 4)))[:, 0] for e in range(4)]
            for j, i in enumerate(pick):
                out[i] = np.minimum(np.stack([c[j] for c in columns], 1), FAR).ravel().tolist()
        yield pd.DataFrame({"_c": pdf["_c"], "_i": pdf["_i"], "_m": out})


def _paths(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Costs, exit states and edits of the blocks, by entry state."""
    for pdf in parts:
        cost, exits, edits = [None] * len(pdf), [None] * len(pdf), [None] * len(pdf)
        ends = np.array(pdf["_ends"].tolist(), np.int64).reshape(-1, 4)
        for pick, codes, ns in _padded(pdf["codes"].tolist(), pdf["ns"].tolist()):
            for (i, c, x, e) in zip(pick, *_edits(codes, ns, ends[pick])):
                cost[i], exits[i], edits[i] = c.tolist(), x.tolist(), e
        extra = [sum(DELETE * (int(n) - 1) for n in ns) for ns in pdf["ns"]]
        yield pd.DataFrame({"_c": pdf["_c"], "_i": pdf["_i"], "_last": pdf["_last"], "places": pdf["places"], "_cost": cost, "_exits": exits, "_edits": edits, "_copies": extra})


def _ends(blocks: DataFrame, longest: int) -> DataFrame:
    """blocks with _ends: the costs to the conversation's end after the block, by state; matrices of several blocks combine by doubling."""
    closing = F.array(*[F.lit(int(x)) for x in CLOSING])
    if longest <= 1:
        return blocks.withColumn("_ends", closing.cast("array<long>"))
    many = blocks.join(blocks.filter("_i = 1").select("_c").hint("shuffle_hash"), "_c", "left_semi")
    m = saved(many.select("_c", "_i", "codes", "ns").mapInPandas(_matrices, "_c string, _i int, _m array<long>"), "repair-matrices")
    both = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda x: F.array_min(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.element_at("_m", (F.floor(x / 4) * 4 + k + 1).cast("int")) + F.element_at("_t", (k * 4 + x % 4 + 1).cast("int")))))
    step = 1
    while step < longest:  # _m: costs of the blocks _i to _i + step - 1
        then = m.select("_c", (F.col("_i") - step).alias("_i"), F.col("_m").alias("_t"))
        m = saved(m.join(then.hint("merge"), ["_c", "_i"], "left").select("_c", "_i", F.when(F.col("_t").isNull(), F.col("_m")).otherwise(both).alias("_m")), "repair-matrices")
        step *= 2
    ends = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda s: F.array_min(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.element_at("_m", (s * 4 + k + 1).cast("int")) + F.element_at(closing, (k + 1).cast("int")))))
    after = m.select("_c", (F.col("_i") - 1).alias("_i"), ends.cast("array<long>").alias("_ends"))
    return blocks.join(after.hint("merge"), ["_c", "_i"], "left").withColumn("_ends", F.coalesce("_ends", closing.cast("array<long>")))


def _entries(paths: DataFrame, longest: int) -> DataFrame:
    """paths with _entry: the state in which the conversation's least path enters the block; the blocks' maps combine by doubling."""
    if longest <= 1:
        return paths.withColumn("_entry", F.lit(START))
    m = saved(paths.join(paths.filter("_i = 1").select("_c").hint("shuffle_hash"), "_c", "left_semi").select("_c", "_i", F.col("_exits").alias("_f")), "repair-maps")
    step = 1
    while step < longest:  # _f: the state after block _i by the state before block _i - step + 1
        before = m.select("_c", (F.col("_i") + step).alias("_i"), F.col("_f").alias("_g"))
        chained = F.transform("_g", lambda s: F.element_at("_f", (s + 1).cast("int")))
        m = saved(m.join(before.hint("merge"), ["_c", "_i"], "left").select("_c", "_i", F.when(F.col("_g").isNull(), F.col("_f")).otherwise(chained).alias("_f")), "repair-maps")
        step *= 2
    entry = m.select("_c", (F.col("_i") + 1).alias("_i"), F.element_at("_f", START + 1).alias("_entry"))
    return paths.join(entry.hint("merge"), ["_c", "_i"], "left").withColumn("_entry", F.coalesce("_entry", F.lit(START)))


def _repair(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows in order, blocks of them, and (_c, _i, _last, places, details, _end, _cost, _copies) of the least path through each block."""
    if block < 2 or block & (block - 1):
        raise ValueError("a block has a power of two of rows")
    placed = ordered(rows)
    blocks = saved(_blocks(placed, block), "repair-blocks")
    longest = (blocks.agg(F.max("_i")).first()[0] or 0) + 1
    ddl = "_c string, _i int, _last boolean, places array<long>, _cost array<long>, _exits array<int>, _edits array<string>, _copies long"
    paths = saved(_ends(blocks, longest).select("_c", "_i", "_last", "places", "codes", "ns", "_ends").mapInPandas(_paths, ddl), "repair-paths")
    at = F.col("_entry") + 1
    chosen = _entries(paths, longest).select("_c", "_i", "_last", "places", F.split(F.element_at("_edits", at), " ").alias("details"), F.element_at("_exits", at).cast("int").alias("_end"), F.element_at("_cost", at).alias("_cost"), "_copies")
    return placed, blocks, saved(chosen, "repair-chosen")


def _lines(placed: DataFrame, chosen: DataFrame) -> DataFrame:
    """(_c, _place, _sub, edit, role, text) of every kept, reroled and inserted turn; _place and _sub order a conversation's."""
    closing = F.element_at(F.array(*[F.lit(x) for x in CLOSING_EDITS]), F.col("_end") + 1)
    edits = chosen.select("_c", F.explode(F.arrays_zip("places", "details")).alias("e")).select("_c", F.col("e.places").alias("_place"), F.col("e.details").alias("_detail"))
    tail = chosen.filter("_last").select("_c", F.lit(2**63 - 1).alias("_place"), closing.alias("_detail")).filter("_detail <> ''")
    role = lambda x: F.when(F.lower(x) == "u", "user").otherwise("assistant")
    inserts = edits.unionByName(tail).select("_c", "_place", F.posexplode(F.split(F.regexp_extract("_detail", "^[ua]*", 0), "")).alias("_sub", "_x")).filter("_x <> ''")
    inserts = inserts.select("_c", "_place", "_sub", F.lit("insert").alias("edit"), role(F.col("_x")).alias("role"), F.lit("").alias("text"))
    word = F.substr(F.regexp_extract("_detail", "[KUA]", 0), F.lit(1), F.lit(1))
    stay = edits.withColumn("_x", word).filter("_x <> ''").select("_place", "_x")
    own = placed.select("_c", "_place", "role", "text").join(stay.hint("merge"), "_place")
    own = own.select("_c", "_place", F.lit(2).alias("_sub"), F.when(F.col("_x") == "K", "keep").otherwise("rerole").alias("edit"), F.when(F.col("_x") == "K", F.col("role")).otherwise(role(F.col("_x"))).alias("role"), "text")
    return own.unionByName(inserts)


def _digests(lines: DataFrame) -> DataFrame:
    """(_c, repaired_sha256): SHA-256 of a conversation's lines role:text, joined by newlines.

    SHA-256 is sequential, so a conversation's lines pass through one task; they stream in order, and none is held.
    """
    body = lines.select("_c", F.concat("role", F.lit(":"), "text").cast("binary").alias("_line"), "_place", "_sub")
    body = body.repartition("_c").sortWithinPartitions("_c", "_place", "_sub").select("_c", "_line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        for b in batches:
            done = []
            for c, line in zip(b.column(0).to_pylist(), b.column(1)):
                if c != conv:
                    if state:
                        done.append((conv, state.hexdigest()))
                    conv, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(line.as_py())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*done)], names=["_c", "repaired_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([state.hexdigest()])], names=["_c", "repaired_sha256"])

    return body.mapInArrow(run, "_c string, repaired_sha256 string")


def repaired_turns(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, place, edit, role, text): the repaired conversations, turn by turn; edit is keep, rerole or insert.

    place orders a conversation's turns. Nulls, ties, repeats and empty tables as in repair_report.
    """
    ids = rows.groupBy(_key().alias("_c")).agg(F.first("conv_id").alias("conv_id"))
    with scratch(rows.sparkSession, "repair"):
        placed, _, chosen = _repair(rows, block)
        lines = saved(_lines(placed, chosen), "repaired", keep=True)
    return lines.join(ids.hint("merge"), "_c").select("conv_id", F.struct("_place", "_sub").alias("place"), "edit", "role", "text")


def repair_report(rows: DataFrame, conversations: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    rows: conv_id, turn, role, text; other columns are ignored. conversations: further conv_ids to report; those without
    rows have zeros, an empty audit and the hash of nothing. A conversation's rows go by turn, null turns first, then role
    and text. A null conv_id is a conversation, a null role or text is one space, an empty role has no initial. Rows that
    repeat role and text are duplicates; equal rows of one turn too. An empty table gives an empty result. The audit is
    D (delete), I (insert), K (keep), R (rerole) in order, the least of the cheapest; it is as long as the conversation.
    """
    spark = rows.sparkSession
    known = rows.select("conv_id") if conversations is None else rows.select("conv_id").unionByName(conversations.select("conv_id"))
    ids = known.groupBy(_key().alias("_c")).agg(F.first("conv_id").alias("conv_id"))
    with scratch(spark, "repair"):
        placed, blocks, chosen = _repair(rows, block)
        copies = F.col("_n") - 1
        count = lambda fault, more=0: F.sum(F.when(F.col("_fault") == fault, F.lit(1) if fault != "blank" else F.col("_n")).otherwise(0) + more)
        doubles = F.when(F.col("_fault") == "blank", 0).otherwise(copies)  # copies of a row that is not blank are duplicates
        turns = placed.groupBy("_c", "turn").agg(count("blank").alias("blank"), count("duplicate", doubles).alias("duplicate"), count("truncated").alias("truncated"))
        most, least = F.max("turn"), F.min("turn")
        turns = turns.groupBy("_c").agg(F.coalesce(most - least + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"), *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")])
        legal = lambda a, b: F.concat(a, b).isin("su", "ua", "au")
        inside = F.aggregate(F.sequence(F.lit(1), F.size("initials")), F.lit(0).cast("long"), lambda s, i: s + F.when((i > 1) & ~legal(F.element_at("initials", F.greatest(i - 1, F.lit(1))), F.element_at("initials", i)), 1).otherwise(0) + F.element_at("ns", i) - 1)
        joint = F.when(F.col("_before").isNotNull() & ~legal(F.col("_before"), F.element_at("initials", 1)), 1).otherwise(0)
        illegal = blocks.groupBy("_c").agg(F.sum(inside + joint).cast("long").alias("illegal"))
        audit = F.translate(F.concat_ws("", "details"), "uaUA", "IIRR")
        audit = F.concat(audit, F.when(F.col("_last"), F.element_at(F.array(*[F.lit("I" * len(x)) for x in CLOSING_EDITS]), F.col("_end") + 1)).otherwise(""))
        paid = F.when(F.col("_i") == 0, F.col("_cost")).otherwise(0) + F.col("_copies")
        audits = chosen.groupBy("_c").agg(F.sum(paid).alias("cost"), F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("_i", audit.alias("a")))), lambda x: x["a"])).alias("audit"))
        out = ids
        for part in (turns, illegal, audits, _digests(_lines(placed, chosen))):
            out = out.join(part.hint("merge"), "_c", "left")
        out = out.fillna(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).fillna({"audit": "", "repaired_sha256": EMPTY_SHA256})
        return saved(out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"), "repair-report", keep=True)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of rows, damaged by a hash of conversation and turn: a fifth is dropped, emptied, unended, repeated or made a user's, a twentieth each."""
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    out = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("_times"))
    return out.filter("_times > 0").withColumn("_times", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times")


def op11_conversations(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair_report(damaged(rows), rows)


# CRC-32 goes bit by bit; v holds, by state (s nothing yet, y system, u user, a assistant), the least cost, audit and lines of a conversation's rest.
OP11_SQL = r"""WITH RECURSIVE h AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id FROM conversations),
 k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(8 * length(id)), lambda j: CASE WHEN j % 8 = 0 THEN CAST(ascii(id[j // 8 + 1]) AS BIGINT) ELSE 0 END)), lambda c, e: xor(xor(c, e) >> 1, CASE WHEN xor(c, e) & 1 = 1 THEN 3988292384 ELSE 0 END))) % 20 AS kind FROM h),
 d AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, conv_id, turn, kind, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM k),
 o AS (SELECT g, turn, role, text, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS pos FROM (SELECT * FROM d WHERE kind <> 0 UNION ALL SELECT * FROM d WHERE kind = 3)),
 f AS (SELECT *, left(role, 1) AS ini, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY g, role, text ORDER BY pos) > 1 AS again, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS cut, lag(left(role, 1)) OVER (PARTITION BY g ORDER BY pos) AS prev FROM o),
 e AS (SELECT *, blank OR again AS gone, CASE WHEN cut THEN 1 ELSE 0 END AS more, role || ':' || text AS line FROM f),
 v AS (SELECT g, max(pos) + 1 AS i, {'c': 0, 'a': '', 't': CAST([] AS VARCHAR[])} AS s, {'c': 4, 'a': 'II', 't': ['user:', 'assistant:']} AS y, {'c': 2, 'a': 'I', 't': ['assistant:']} AS u, {'c': 0, 'a': '', 't': CAST([] AS VARCHAR[])} AS a FROM e GROUP BY g
  UNION ALL
  SELECT g, pos, least(s, {'c': 2 + u.c, 'a': 'I' || u.a, 't': list_prepend('user:', u.t)}, {'c': 4 + a.c, 'a': 'II' || a.a, 't': list_concat(['user:', 'assistant:'], a.t)}),
   least(y, {'c': 2 + u.c, 'a': 'I' || u.a, 't': list_prepend('user:', u.t)}, {'c': 4 + a.c, 'a': 'II' || a.a, 't': list_concat(['user:', 'assistant:'], a.t)}),
   least(u, {'c': 2 + a.c, 'a': 'I' || a.a, 't': list_prepend('assistant:', a.t)}), least(a, {'c': 2 + u.c, 'a': 'I' || u.a, 't': list_prepend('user:', u.t)})
  FROM (SELECT v.g, pos,
    CASE WHEN gone THEN {'c': 3 + s.c, 'a': 'D' || s.a, 't': s.t} ELSE least({'c': 3 + s.c, 'a': 'D' || s.a, 't': s.t}, {'c': 2 + more + u.c, 'a': 'R' || u.a, 't': list_prepend('user:' || text, u.t)}, CASE ini WHEN 's' THEN {'c': more + y.c, 'a': 'K' || y.a, 't': list_prepend(line, y.t)} WHEN 'u' THEN {'c': more + u.c, 'a': 'K' || u.a, 't': list_prepend(line, u.t)} END) END AS s,
    CASE WHEN gone THEN {'c': 3 + y.c, 'a': 'D' || y.a, 't': y.t} ELSE least({'c': 3 + y.c, 'a': 'D' || y.a, 't': y.t}, {'c': 2 + more + u.c, 'a': 'R' || u.a, 't': list_prepend('user:' || text, u.t)}, CASE ini WHEN 'u' THEN {'c': more + u.c, 'a': 'K' || u.a, 't': list_prepend(line, u.t)} END) END AS y,
    CASE WHEN gone THEN {'c': 3 + u.c, 'a': 'D' || u.a, 't': u.t} ELSE least({'c': 3 + u.c, 'a': 'D' || u.a, 't': u.t}, {'c': 2 + more + a.c, 'a': 'R' || a.a, 't': list_prepend('assistant:' || text, a.t)}, CASE ini WHEN 'a' THEN {'c': more + a.c, 'a': 'K' || a.a, 't': list_prepend(line, a.t)} END) END AS u,
    CASE WHEN gone THEN {'c': 3 + a.c, 'a': 'D' || a.a, 't': a.t} ELSE least({'c': 3 + a.c, 'a': 'D' || a.a, 't': a.t}, {'c': 2 + more + u.c, 'a': 'R' || u.a, 't': list_prepend('user:' || text, u.t)}, CASE ini WHEN 'u' THEN {'c': more + u.c, 'a': 'K' || u.a, 't': list_prepend(line, u.t)} END) END AS a
   FROM v JOIN e ON e.g = v.g AND e.pos = v.i - 1)),
 n AS (SELECT g, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT gone) AS truncated, count(*) FILTER (pos > 1 AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM e GROUP BY g),
 c AS (SELECT DISTINCT g, conv_id FROM d)
 SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(s.c, 0) AS BIGINT) AS cost, coalesce(s.a, '') AS audit, sha256(coalesce(array_to_string(s.t, chr(10)), '')) AS repaired_sha256
 FROM c LEFT JOIN n USING (g) LEFT JOIN v ON v.g = c.g AND v.i = 1"""
