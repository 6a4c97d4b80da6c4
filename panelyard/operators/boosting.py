"""M7: gradient-boosted regression trees by histograms, with a penalty on leaf values and a bound on leaves.

Features are cut into bins once. A split round is one job: each task sums residuals and counts by (node, feature, bin), a
grouped sum adds the tasks' histograms, and the driver, which sees nodes * features * bins sums however many rows there
are, picks the splits. A tree of depth 3 takes three such jobs; its best-first growth is then replayed on their results.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.bars import kept

#: Trees whose scores are added row by row in every pass; then the scores so far are written with the rows.
FRESH_TREES = 20
#: Training rows that a task takes in one pass.
TASK_ROWS = 250_000


def bin_edges(train: DataFrame, features: tuple[str, ...], bins: int = 255, accuracy: int = 10_000) -> list[np.ndarray]:
    """By feature, the rising values that end its bins; a value belongs to the first bin whose edge it does not exceed.

    Edges are approximate quantiles, whose error in rank is at most 1 / accuracy.
    """
    at = ", ".join(f"{i / bins!r}D" for i in range(1, bins))
    row = train.agg(*[F.expr(f"percentile_approx(`{f}`, array({at}), {accuracy})").alias(f) for f in features]).first()
    return [np.unique(np.array(row[f] or [], float)) for f in features]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], 1).astype(np.uint8)


def leaf_of(b: np.ndarray, splits: dict[int, tuple[int, int]]) -> np.ndarray:
    """The node that each row ends in: node n has children 2 n (bin up to the split's) and 2 n + 1."""
    node = np.ones(len(b), np.int64)
    for n, (feature, cut) in sorted(splits.items()):
        here = node == n
        node[here] = 2 * n + (b[here, feature] > cut)
    return node


def tree_score(b: np.ndarray, trees: list) -> np.ndarray:
    """Sum of the trees' leaf values; a tree is (splits, values by node)."""
    total = np.zeros(len(b))
    for splits, values in trees:
        table = np.zeros(max([1, *values]) + 1)
        table[list(values)] = list(values.values())
        total += table[leaf_of(b, splits)]
    return total


def best_split(g: np.ndarray, n: np.ndarray, least: int, penalty: float) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of a node's histograms [feature, bin] of residuals and counts; ties go to the first feature and bin.

    Gains that differ by rounding alone count as ties.
    """
    total, rows = g[0].sum(), n[0].sum()
    gl, nl = g.cumsum(1)[:, :-1], n.cumsum(1)[:, :-1]
    gr, nr = total - gl, rows - nl
    ok = (nl >= least) & (nr >= least)
    gain = np.where(ok, gl**2 / (nl + penalty) + gr**2 / (nr + penalty) - total**2 / (rows + penalty), -np.inf)
    top = gain.max()
    if not np.isfinite(top) or top <= 1e-12:
        return None
    at = int(np.argmax((gain >= top * (1 - 1e-9)).ravel()))
    return float(top), at // gain.shape[1], at % gain.shape[1]


def grow(found: dict[int, tuple[np.ndarray, np.ndarray]], splits: dict[int, tuple[float, int, int]], leaves: int, rate: float, penalty: float) -> tuple[dict, dict]:
    """The tree of at most so many leaves that takes the best splits first: its splits and its leaves' values.

    found: node -> (residuals, counts) by bin of one feature; splits: node -> its best split, where it has one.
    """
    taken, ends, queue = {}, {1: (found[1][0].sum(), found[1][1].sum())}, []
    if 1 in splits:
        heappush(queue, (-splits[1][0], 1))
    while queue and len(ends) < leaves:
        _, node = heappop(queue)
        _, feature, cut = splits[node]
        taken[node] = (feature, cut)
        g, n = found[node][0][feature], found[node][1][feature]
        del ends[node]
        for child, part in ((2 * node, slice(0, cut + 1)), (2 * node + 1, slice(cut + 1, None))):
            ends[child] = (g[part].sum(), n[part].sum())
            if child in splits:
                heappush(queue, (-splits[child][0], child))
    return taken, {node: -rate * g / (n + penalty) for node, (g, n) in ends.items()}


def fit_trees(train: DataFrame, features: tuple[str, ...], label: str, iterations: int = 100, depth: int = 3, leaves: int = 7, rate: float = 0.035, penalty: float = 10.0, least: int = 250, bins: int = 255) -> dict:
    """A model {base, edges, trees}; rows with a null or NaN feature or label take no part. Raises ValueError without any row.

    Bins are at most 256. Sums depend on the order of tasks only in their last digits, and splits that are equal but for
    those go to the first feature and bin, so reruns give the same trees.
    """
    if not 2 <= bins <= 256:
        raise ValueError("bins must be from 2 to 256")
    full = train.select(*[F.col(c).cast("double").alias(c) for c in (*features, label)]).dropna()
    full = kept(full.filter(~F.isnan(label)), "boosting-train")
    base, n_rows = full.agg(F.avg(label), F.count("*")).first()
    if base is None:
        raise ValueError("no training rows")
    edges, width = bin_edges(full, features, bins), bins + 1

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            b = binned(pdf[list(features)].to_numpy(float), edges)
            yield pd.DataFrame({"b": [r.tobytes() for r in b], "y": pdf[label], "p": base})

    tasks = -(-n_rows // TASK_ROWS)
    rows = kept(full.mapInPandas(cut, "b binary, y double, p double"), "boosting-bins")
    trees, fresh = [], []

    def scored(parts: Iterator[pd.DataFrame], recent: list) -> Iterator[tuple[np.ndarray, pd.DataFrame]]:
        for pdf in parts:
            if len(pdf):
                b = np.frombuffer(b"".join(pdf["b"]), np.uint8).reshape(len(pdf), -1)
                yield b, pdf.assign(p=pdf["p"] + tree_score(b, recent))

    def histograms(splits: dict[int, tuple[int, int]], wanted: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """One job: residuals and counts by (feature, bin) of the wanted nodes of the tree that grows."""
        recent, place = list(fresh), {n: i for i, n in enumerate(wanted)}

        def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            size = len(wanted) * len(features) * width
            g, n = np.zeros(size), np.zeros(size)
            for b, pdf in scored(parts, recent):
                slot = pd.Series(leaf_of(b, splits)).map(place)
                at = slot.notna().to_numpy()
                s, r = slot[at].to_numpy(np.int64), (pdf["p"] - pdf["y"]).to_numpy()[at]
                for f in range(len(features)):
                    cell = (s * len(features) + f) * width + b[at, f]
                    g += np.bincount(cell, r, size)
                    n += np.bincount(cell, minlength=size)
            seen = np.flatnonzero(n)
            yield pd.DataFrame({"cell": seen, "g": g[seen], "n": n[seen]})

        found = rows.coalesce(tasks).mapInPandas(sums, "cell long, g double, n double").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).toPandas()
        g, n = np.zeros((2, len(wanted), len(features), width))
        g.ravel()[found["cell"]], n.ravel()[found["cell"]] = found["g"], found["n"]
        return {node: (g[i], n[i]) for node, i in place.items()}

    for _ in range(iterations):
        found, splits, level = {}, {}, [1]
        for _ in range(depth):
            now = histograms({n: s[1:] for n, s in splits.items()}, level)
            best = {n: s for n, h in now.items() if (s := best_split(*h, least, penalty))}
            found |= now
            splits |= best
            level = [c for n in best for c in (2 * n, 2 * n + 1)]
            if not level:
                break
        tree = grow(found, splits, leaves, rate, penalty)
        trees.append(tree)
        fresh.append(tree)
        if len(fresh) == FRESH_TREES:
            recent = list(fresh)

            def add(parts: Iterator[pd.DataFrame], recent: list = recent) -> Iterator[pd.DataFrame]:
                for _, pdf in scored(parts, recent):
                    yield pdf

            rows = kept(rows.coalesce(tasks).mapInPandas(add, "b binary, y double, p double"), "boosting-bins")
            fresh.clear()
    return {"base": base, "edges": edges, "trees": trees}


def score_trees(rows: DataFrame, model: dict, features: tuple[str, ...], name: str = "score") -> DataFrame:
    """rows with the model's score, null where a feature is null or NaN."""

    @F.pandas_udf("double")
    def score(x: pd.DataFrame) -> pd.Series:
        v = x.to_numpy(float)
        s = model["base"] + tree_score(binned(v, model["edges"]), model["trees"])
        return pd.Series(s).where(~np.isnan(v).any(1))

    return rows.withColumn(name, score(F.struct(*[F.col(f).cast("double").alias(f) for f in features])))
