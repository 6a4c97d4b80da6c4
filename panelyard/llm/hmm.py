"""Operator 3: language-model scores of a hidden Markov model.

Every token of the training texts has an emission row of its own. The rows of
the most frequent tokens are a table of bounded size that the driver holds;
those of all rarer ones are a table that Spark keeps partitioned and that grows
with the corpus. Baum-Welch runs as Spark jobs, every round over all training
texts: each partition sums its expected counts, and Spark adds them. In all
rounds but the last, rarer tokens of one form (their last two bytes) share one
emission row; the last round gives every token its own. The scaled forward
recursion then gives each text's exact likelihood: texts meet the rows of their
rarer tokens block by block, one row a token and block of texts.
With one state the model is a smoothed unigram model.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import crc_mod, remove, saved, saved_at, table

#: States; at most 8, since a rarer token's shares of them are the 8 bytes of a long.
STATES = 8
#: Tokens whose emission rows the driver holds and sends to all tasks; every other token's row is in a Spark table.
FREQUENT = 16_000
#: Forms that tie the rarer tokens in the rounds before the last.
FORMS = 256
#: Rounds of Baum-Welch, each over all training texts; the last is the one with a row for every token.
ROUNDS = 5
#: Prior weight of the unigram shares in a state's emissions, in tokens; and the part of its form in a rarer token's row.
PRIOR, FORM_PART = 200.0, 0.3
#: A batch of texts ends at that many tokens and texts, or at MOST_TOKENS: each step of a recursion should have many texts.
BATCH_TOKENS, BATCH_TEXTS, MOST_TOKENS = 300_000, 300, 1_000_000
#: Tokens of a block of texts, about; a longer text is a block of its own.
BLOCK_TOKENS = 6_000_000
FLUSH_TOKENS = 300_000
#: While a text is coded, rarer tokens have numbers above this one.
RARE = 0xFFFF

Model = tuple[np.ndarray, np.ndarray, np.ndarray]  # start (S), moves (S, S), emissions (symbols, S)


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def form(token: bytes, forms: int = FORMS) -> int:
    """The symbol of a rarer token: 1 to forms, by its last two bytes."""
    return 1 + zlib.crc32(token[-2:]) % forms


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, n): the tokens of all texts but the ends, summed in each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(c.keys()), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["token", "n"])
            c.clear()
            return b

        for b in batches:
            for t in b.column(0):
                c.update(tokens(t.as_py()))
                if len(c) > FLUSH_TOKENS:
                    yield out()
        if c:
            yield out()

    return docs.select(F.col(text).cast("binary").alias("t")).mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


class _Codes(dict):
    """Symbols of tokens: those of frequent ones, and for rarer ones numbers above RARE in the order in which they come.

    kinds and hashes hold the rarer tokens' forms and XXH64 by number. A token is looked up once until forget.
    """

    def __init__(self, symbols: dict[bytes, int], forms: int):
        self.symbols, self.forms, self.n = symbols, forms, 0
        self.kinds, self.hashes = np.empty(1 << 16, np.uint16), np.empty(1 << 16, np.uint64)

    def __missing__(self, token: bytes) -> int:
        s = self.symbols.get(token)
        if s is None:
            if self.n == len(self.kinds):
                self.kinds, self.hashes = (np.concatenate([x, np.empty_like(x)]) for x in (self.kinds, self.hashes))
            self.kinds[self.n], self.hashes[self.n] = form(token, self.forms), xxhash.xxh64_intdigest(token)
            self.n += 1
            s = RARE + self.n
        self[token] = s
        return s

    def forget(self) -> None:
        self.clear()
        self.n = 0


def encoded(docs: DataFrame, symbols: dict[bytes, int], forms: int = FORMS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """docs(doc_id, held_out, train, text) as (block, doc_id, held_out, train, n_tokens, ids, rare).

    ids: the tokens' symbols, two bytes each; 0 is the end, 1 to forms a rarer token's form. rare: the rarer tokens' XXH64
    in their order, which stands for the token from here on. Blocks are numbered within one write, so the result must be
    saved before it is used twice.
    """
    shared = docs.sparkSession.sparkContext.broadcast(symbols)
    names = ["block", "doc_id", "held_out", "train", "n_tokens", "ids", "rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(shared.value, forms)
        block, filled = TaskContext.get().partitionId() << 24, 0
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                blocks, n, ids, rare = [], [], [], []
                for t in b.column(3):
                    ws = tokens(t.as_py())
                    a = np.zeros(len(ws) + 1, np.int64)  # the end is 0
                    a[:-1] = np.fromiter(map(codes.__getitem__, ws), np.int64, len(ws))
                    few = a > RARE
                    number = a[few] - (RARE + 1)
                    a[few] = codes.kinds[number]
                    n.append(len(a))
                    ids.append(a.astype("<u2").tobytes())
                    rare.append(codes.hashes[number].astype("<u8").tobytes())
                    if filled and filled + len(a) > block_tokens:
                        block, filled = block + 1, 0
                        codes.forget()
                    filled += len(a)
                    blocks.append(block)
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), *[b.column(i) for i in range(3)], pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(rare, pa.binary())], names=names)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "train", F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(run, "block long, doc_id long, held_out boolean, train boolean, n_tokens long, ids binary, rare binary")


def _packed(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Longest first: their order, the symbols end to end, each one's start, and how many reach each step."""
    size = np.array([len(s) for s in seqs])
    order = np.argsort(-size, kind="stable")
    size = size[order]
    flat = np.concatenate([seqs[i] for i in order]).astype(np.int64)
    starts = np.concatenate([[0], size[:-1].cumsum()])
    active = np.searchsorted(-size, -np.arange(size[0]), side="left")
    return order, flat, starts, active


def forward(seqs: list[np.ndarray], model: Model) -> np.ndarray:
    """log10 likelihood of each sequence of symbols, by the scaled forward recursion over all of them side by side."""
    start, moves, emit = model
    order, flat, starts, active = _packed(seqs)
    out, a, one = np.zeros(len(seqs)), np.tile(start, (len(seqs), 1)), np.ones(len(start), emit.dtype)
    scales: list[np.ndarray] = []
    for t, n in enumerate(active.tolist()):
        a = a[:n] @ moves if t else a
        a *= emit.take(flat[starts[:n] + t], axis=0)
        s = a @ one
        a /= s[:, None]
        scales.append(s)
        if len(scales) == 64 or t == len(active) - 1:
            for k in scales:
                out[: len(k)] += np.log10(k)
            scales.clear()
    result = np.empty(len(seqs))
    result[order] = out
    return result


def posteriors(seqs: list[np.ndarray], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The expected starts (S) and moves (S, S) of the sequences, and of each token its place in their concatenation and its posterior (S)."""
    start, moves, emit = model
    s = len(start)
    order, flat, starts, active = _packed(seqs)
    at, width = [0, *np.cumsum(active).tolist()], active.tolist()
    where = np.concatenate([starts[:n] + t for t, n in enumerate(width)])
    alpha, e, scale = np.empty((at[-1], s), emit.dtype), emit.take(flat[where], axis=0), np.empty(at[-1], emit.dtype)
    a, one = np.tile(start, (len(seqs), 1)), np.ones(s, emit.dtype)
    for t, n in enumerate(width):
        i, j = at[t], at[t + 1]
        a = a[:n] @ moves if t else a
        a *= e[i:j]
        sums = np.matmul(a, one, out=scale[i:j])
        a = np.divide(a, sums[:, None], out=alpha[i:j])
    e /= scale[:, None]
    pairs, beta = np.zeros((s, s)), np.ones((width[-1], s), emit.dtype)
    back = moves.T.copy()
    for t in range(len(width) - 1, 0, -1):
        i, j, n, p = at[t], at[t + 1], width[t], at[t - 1]
        eb = e[i:j]
        eb *= beta
        alpha[i:j] *= beta  # from here on the state's posterior
        pairs += alpha[p : p + n].T @ eb
        beta = np.ones((width[t - 1], s), emit.dtype)
        np.matmul(eb, back, out=beta[:n])
    alpha[: at[1]] *= beta
    size = np.array([len(x) for x in seqs])
    first = np.concatenate([[0], size[:-1].cumsum()])  # places in the order of seqs, not in that of length
    moved = np.repeat(first[order], size[order]) + np.arange(len(flat)) - np.repeat(starts, size[order])
    return alpha[: at[1]].sum(axis=0, dtype=np.float64), pairs * moves, moved[where], alpha


def expected(seqs: list[np.ndarray], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of Baum-Welch over the sequences: starts (S), moves (S, S) and emissions (symbols, S)."""
    start, pairs, where, post = posteriors(seqs, model)
    return start, pairs, _by_symbol(np.concatenate(seqs)[where], post, len(model[2]))


def _by_symbol(symbols: np.ndarray, post: np.ndarray, n: int) -> np.ndarray:
    symbols = symbols.astype(np.intp)
    return np.stack([np.bincount(symbols, weights=w, minlength=n) for w in np.ascontiguousarray(post.T)], axis=1)


def _batches(sizes: list[int]) -> Iterator[list[int]]:
    """The places of all sizes (numbers of tokens) in batches of BATCH_TOKENS to MOST_TOKENS tokens, about, or of one longer text.

    Texts of like length go together: a batch takes as many steps as its longest text has tokens.
    """
    few, n = [], 0
    for i in np.argsort(-np.array(sizes, np.int64), kind="stable").tolist():
        few.append(i)
        n += sizes[i]
        if n >= MOST_TOKENS or n >= BATCH_TOKENS and len(few) >= BATCH_TEXTS:
            yield few
            few, n = [], 0
    if few:
        yield few


def _numbers(x: pa.BinaryScalar, kind: str) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), kind)


def _dense(total: np.ndarray, names: list[str]) -> list[pa.Array]:
    i = np.flatnonzero(total.any(axis=1))
    return [pa.array(i.astype(np.int32)), *[pa.array(total[i, k]) for k in range(total.shape[1])]]


def _summed(rows: DataFrame, n_symbols: int, states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rows (i, c0, c1, ...) added by i: expected starts, moves and emissions; symbols + states + 1 rows come to the driver.

    They are summed as decimals, so that the order of tasks doesn't matter.
    """
    names = [f"c{k}" for k in range(states)]
    got = rows.groupBy("i").agg(*[F.sum(F.col(c).cast("decimal(28,8)")).cast("double").alias(c) for c in names]).toPandas()
    total = np.zeros((n_symbols + states + 1, states))
    total[got["i"].to_numpy(np.int64)] = got[names].to_numpy(np.float64)
    return total[-1], total[n_symbols : n_symbols + states], total[:n_symbols]


def _float32(model: Model) -> Model:
    return tuple(np.maximum(m, 1e-30).astype(np.float32) for m in model)


def estep(coded: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts over all rows of coded(ids, n_tokens). Each task sends one row a symbol."""
    s, n_symbols = len(model[0]), len(model[2])
    shared = coded.sparkSession.sparkContext.broadcast(_float32(model))
    names = ["i", *[f"c{k}" for k in range(s)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_symbols + s + 1, s))
        for b in batches:
            for few in _batches(b.column(1).to_pylist()):
                start, pairs, counts = expected([_numbers(b.column(0)[i], "<u2") for i in few], shared.value)
                total += np.concatenate([counts, pairs, start[None]])
        yield pa.RecordBatch.from_arrays(_dense(total, names), names=names)

    return _summed(coded.select("ids", "n_tokens").mapInArrow(run, ", ".join(["i int", *[f"c{k} double" for k in range(s)]])), n_symbols, s)


def _shares(counts: np.ndarray) -> np.ndarray:
    """Rows of expected counts as their shares in 255 parts, a byte a state, in one long each (no counts: 0)."""
    q = np.zeros((len(counts), 8), np.uint8)
    q[:, : counts.shape[1]] = np.rint(255 * counts / np.maximum(counts.sum(axis=1, keepdims=True), 1e-30))
    return q.view("<i8")[:, 0]


def _byte(c: str, k: int) -> Column:
    return F.shiftrightunsigned(c, 8 * k).bitwiseAND(F.lit(255).cast("long"))


def last_estep(coded: DataFrame, model: Model, name: str, forms: int = FORMS) -> tuple[DataFrame, str]:
    """The last E-step's expected counts, saved: rows (i, c0, ...) as in estep, and rows (block, h, form, n, q) of rarer tokens.

    n counts the token h in the block's training texts, q packs the states' shares of n. Tokens of other texts come with n = 0.
    A task holds the sums of one block.
    """
    s, n_symbols = len(model[0]), len(model[2])
    shared = coded.sparkSession.sparkContext.broadcast(_float32(model))
    names = ["i", *[f"c{k}" for k in range(s)], "block", "h", "form", "n", "q"]
    kinds = [pa.int32(), *[pa.float64()] * s, pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, parts, here = np.zeros((n_symbols + s + 1, s)), [], None

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, first, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
            sums = _by_symbol(inverse, np.concatenate([p[2] for p in parts]), len(h))
            out = h, np.concatenate([p[1] for p in parts])[first], sums
            parts[:] = [out]
            return out

        def block_rows() -> Iterator[pa.RecordBatch]:
            if parts:
                h, kind, sums = merged()
                for a in range(0, len(h), 100_000):
                    z = slice(a, a + 100_000)
                    few = sums[z, :s], sums[z, s]
                    blank = [pa.nulls(len(few[1]), k) for k in kinds[: s + 1]]
                    yield pa.RecordBatch.from_arrays([*blank, pa.array(np.full(len(few[1]), here, np.int64)), pa.array(h[z].view(np.int64)), pa.array(kind[z].astype(np.int32)), pa.array(np.rint(few[1]).astype(np.int64)), pa.array(_shares(few[0]))], names=names)
                parts.clear()

        for b in batches:
            blocks, sizes, train = b.column(0).to_numpy(), b.column(2).to_pylist(), b.column(1).to_pylist()
            edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if here != blocks[lo]:
                    yield from block_rows()
                    here = int(blocks[lo])
                for wanted in (True, False):
                    rows = [r for r in range(lo, hi) if train[r] is wanted]
                    for few in _batches([sizes[r] for r in rows]):
                        few = [rows[i] for i in few]
                        seqs = [_numbers(b.column(3)[r], "<u2") for r in few]
                        ids = np.concatenate(seqs)
                        is_rare = (ids > 0) & (ids <= forms)
                        h, kind = np.concatenate([_numbers(b.column(4)[r], "<u8") for r in few]), ids[is_rare]
                        sums = np.zeros((len(h), s + 1), np.float32)
                        if wanted:
                            start, pairs, where, post = posteriors(seqs, shared.value)
                            total += np.concatenate([_by_symbol(ids[where], post, n_symbols), pairs, start[None]])
                            place = np.cumsum(is_rare) - 1
                            theirs = is_rare[where]
                            sums[place[where[theirs]], :s], sums[:, s] = post[theirs], 1
                        u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
                        parts.append((u, kind[first], _by_symbol(inverse, sums, len(u))))
                        if len(parts) >= 8:
                            merged()
        yield from block_rows()
        dense = _dense(total, names)
        yield pa.RecordBatch.from_arrays([*dense, *[pa.nulls(len(dense[0]), k) for k in kinds[s + 1 :]]], names=names)

    fields = ["i int", *[f"c{k} double" for k in range(s)], "block long", "h long", "form int", "n long", "q long"]
    return saved_at(coded.select("block", "train", "n_tokens", "ids", "rare").mapInArrow(run, ", ".join(fields)), name)


def start_model(unigram: np.ndarray, states: int, seed: int = 7) -> Model:
    """A model around the unigram shares, the states' emissions shaken apart by a seed."""
    rng = np.random.default_rng(seed)
    emit = unigram[:, None] * np.exp(0.5 * rng.standard_normal((len(unigram), states)))
    moves = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(moves, 0.9 if states > 1 else 1.0)
    return np.full(states, 1 / states), moves, emit / emit.sum(axis=0)


def next_model(start: np.ndarray, pairs: np.ndarray, counts: np.ndarray, unigram: np.ndarray) -> Model:
    """The model of expected counts; every state's emissions have the unigram shares as prior."""
    start, pairs, emit = start + 1 / len(start), pairs + 0.5, counts + PRIOR * unigram[:, None]
    return start / start.sum(), pairs / pairs.sum(axis=1, keepdims=True), emit / emit.sum(axis=0)


def baum_welch(coded: DataFrame, unigram: np.ndarray, states: int = STATES, rounds: int = ROUNDS - 1) -> Model:
    """The model after rounds of Baum-Welch over all rows of coded(ids, n_tokens), rarer tokens tied by form."""
    model = start_model(unigram, states)
    for _ in range(rounds):
        model = next_model(*estep(coded, model), unigram)
    return model


def emission_table(rows: DataFrame) -> DataFrame:
    """rows (block, h, form, n, q) of blocks: n and q become those of the token in the whole corpus; weight is one over the token's rows.

    Sums are of integers, so that the order of rows doesn't matter. A token has one row a block, or two where a split of
    a file cuts the block, and never one an occurrence.
    """
    token = W.partitionBy("h")
    n = F.sum("n").over(token)
    parts = [F.sum(F.col("n") * _byte("q", k)).over(token).alias(f"s{k}") for k in range(8)]
    sums = rows.select("block", "h", "form", n.alias("n"), (F.lit(1.0) / F.count("*").over(token)).alias("weight"), *parts)
    total = F.greatest(sum((F.col(f"s{k}") for k in range(1, 8)), F.col("s0")), F.lit(1).cast("long"))
    q = sum((F.shiftleft(F.floor((F.lit(255) * F.col(f"s{k}") + F.floor(total / 2)) / total).cast("long"), 8 * k) for k in range(1, 8)), F.floor((F.lit(255) * F.col("s0") + F.floor(total / 2)) / total).cast("long"))
    return sums.select("block", "h", "form", "n", "weight", q.alias("q"))


def _unpacked(n: np.ndarray, q: np.ndarray, states: int) -> np.ndarray:
    """Expected counts of tokens (rows) by state from their counts and packed shares."""
    shares = np.ascontiguousarray(q, "<i8").view(np.uint8).reshape(-1, 8)[:, :states].astype(np.float64)
    return shares * (n / np.maximum(shares.sum(axis=1), 1))[:, None]


def _state_sums(emissions: DataFrame, states: int) -> np.ndarray:
    """Expected counts of all rarer tokens by state."""
    names = [f"c{k}" for k in range(states)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(states)
        for b in batches:
            n, q, w = (b.column(i).to_numpy() for i in range(3))
            total += (_unpacked(n, q, states) * w[:, None]).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], names=names)

    rows = emissions.filter("n > 0").select("n", "q", "weight").mapInArrow(run, ", ".join(f"{c} double" for c in names))
    got = rows.agg(*[F.coalesce(F.sum(F.col(c).cast("decimal(28,8)")).cast("double"), F.lit(0.0)).alias(c) for c in names]).first()
    return np.array(list(got), np.float64)


def score_texts(docs: DataFrame, training: str = "held_out = false", states: int = STATES, frequent: int = FREQUENT, rounds: int = ROUNDS, forms: int = FORMS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for docs(doc_id, held_out, text).

    Tokens: the text's words, A-Z lower-cased, and one end. base_score: the unigram model with one added to every count
    and one unseen token; score: log10 of the text's probability under the hidden Markov model trained on the rows that
    training selects. The model gives every state a probability of the end, of each training token, and of one unseen
    token a form; they add up to one. Null and blank texts are the end alone. Texts of any length are taken whole. Without
    training rows both models know the unseen token and the end only. Rows that repeat a doc_id are trained on and scored
    each; where training is null for a row, it is scored only. Other columns are ignored. An empty table gives an empty result.
    Raises ValueError for more than 8 states, or for more symbols than two bytes can number.
    """
    if not 1 <= states <= 8:
        raise ValueError("states must be from 1 to 8: a token's shares of them are the bytes of a long")
    if not (forms >= 1 and frequent >= 0 and frequent + forms < RARE):
        raise ValueError(f"forms and frequent tokens together must be fewer than {RARE}: a token's symbol has two bytes")
    if rounds < 1:
        raise ValueError("rounds must be at least 1")
    spark = docs.sparkSession
    docs = docs.select("doc_id", "held_out", F.coalesce(F.expr(training), F.lit(False)).alias("train"), "text")
    known, counted = saved_at(token_counts(docs.filter("train")), "hmm-tokens")
    ends = docs.filter("train").count()
    words, types = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, kinds = words + ends, types + (1 if ends else 0)
    # the most frequent tokens, ties by the token: a table of at most `frequent` rows
    top = [(bytes(r[0]), r[1]) for r in known.orderBy(F.desc("n"), "token").limit(frequent).collect()]
    all_n = total + kinds + 1
    by_form = known.groupBy((F.crc32(F.substring("token", -2, 2)) % forms + 1).alias("form")).agg(F.sum("n").alias("n"), F.count("*").alias("types"))
    rest = np.ones(forms + 1)  # add-one counts of the rarer tokens by form, one unseen token each; place 0 is not used
    for r in by_form.collect():  # forms rows at most
        rest[r["form"]] += r["n"] + r["types"]
    remove(spark, counted)
    for w, n in top:
        rest[form(w, forms)] -= n + 1
    unigram = np.concatenate([[ends + 1 if ends else 1], rest[1:], [n + 1 for _, n in top]]).astype(np.float64)
    unigram /= unigram.sum()
    coded = saved(encoded(docs, {w: i + forms + 1 for i, (w, _) in enumerate(top)}, forms, block_tokens), "hmm-symbols")
    tied = baum_welch(coded.filter("train"), unigram, states, rounds - 1)
    last, path = last_estep(coded, tied, "hmm-last", forms)
    start, pairs, counts = _summed(last.filter("i is not null"), len(unigram), states)
    emissions = saved(emission_table(last.filter("h is not null").select("block", "h", "form", "n", "q")), "hmm-emissions")
    remove(spark, path)
    # a rarer token's row: its own expected counts and, as a part, its add-one count shared out as its form's states are
    by_state = counts[: forms + 1] + PRIOR * unigram[: forms + 1, None]
    by_state /= by_state.sum(axis=1, keepdims=True)
    emit = counts + PRIOR * unigram[:, None]
    emit[1 : forms + 1] = FORM_PART * by_state[1:]  # of one add-one count
    sums = emit[0] + emit[forms + 1 :].sum(axis=0) + (FORM_PART * by_state[1:] * rest[1:, None]).sum(axis=0) + (1 - FORM_PART) * _state_sums(emissions, states)
    start, moves, _ = next_model(start, pairs, counts, unigram)
    logs = np.zeros(len(unigram))
    logs[0], logs[forms + 1 :] = np.log10(ends + 1), np.log10(np.array([n + 1 for _, n in top], np.float64))
    shared = spark.sparkContext.broadcast((start, moves, emit / sums, sums, logs))
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def score(texts: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """The scores of a block of texts; rows are its rarer tokens'."""
        if not len(texts):
            return pd.DataFrame({c: [] for c in columns})
        start, moves, emit, sums, logs = shared.value
        rows = rows.drop_duplicates("h")  # the two parts of a block that a file's split cut say the same
        h, o = np.unique(rows["h"].to_numpy(np.int64).view(np.uint64), return_index=True)
        n = rows["n"].to_numpy(np.int64)[o]
        own = (1 - FORM_PART) * _unpacked(n, rows["q"].to_numpy(np.int64)[o], len(start)) / sums + (n + 1)[:, None] * emit[rows["form"].to_numpy(np.int64)[o]]
        all_emit = np.concatenate([emit, own])
        all_logs = np.concatenate([logs, np.log10(n + 1.0)])
        seen = np.concatenate([np.ones(len(emit), np.int64), (n > 0).astype(np.int64)])
        seen[0] = int(ends > 0)
        ids, rare = texts["ids"].to_list(), texts["rare"].to_list()
        base, known_n, found = np.zeros(len(ids)), np.zeros(len(ids), np.int64), np.zeros(len(ids))
        for few in _batches(texts["n_tokens"].tolist()):
            seqs = []
            for i in few:
                x = np.frombuffer(ids[i], "<u2").astype(np.int64)
                x[(x > 0) & (x <= forms)] = len(emit) + np.searchsorted(h, np.frombuffer(rare[i], "<u8"))
                seqs.append(x)
                base[i] = all_logs[x].sum() - len(x) * np.log10(all_n)
                known_n[i] = seen[x].sum()
            found[few] = forward(seqs, (start, moves, all_emit))
        return texts[["doc_id", "held_out", "n_tokens"]].assign(n_known=known_n, base_score=base, score=found)[columns]

    texts = coded.select("block", "doc_id", "held_out", "n_tokens", "ids", "rare")
    out = texts.groupBy("block").cogroup(emissions.select("block", "h", "form", "n", "q").groupBy("block")).applyInPandas(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(total).cast("long"))


def op3_hmm(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "text"))
