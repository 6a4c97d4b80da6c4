"""Accounts, boosted trees, quantiles, block models and resampling against plain versions."""

from __future__ import annotations

import datetime
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelyard.operators import boosting, ledger, models, quantiles


def test_exact_trading_cost(spark):
    rng = np.random.default_rng(3)
    rows = []
    for day in range(80):
        n = rng.integers(1, 12)
        target = rng.dirichlet(np.ones(n)) * rng.choice([1, 0.7, 0]) * (rng.random(n) > 0.3)
        previous = rng.choice([0, 1]) * rng.dirichlet(np.ones(n)) * rng.choice([1, 0.6])
        if day % 5 == 0:
            previous = target.copy()
        rows += [(day, float(p), float(t)) for p, t in zip(previous, target)]
    df = spark.createDataFrame(rows, "day int, previous double, target double")
    for rate in (0.0, 0.001, 0.05):
        got = {r["day"]: r["cost"] for r in ledger.with_cost(df, ("day",), rate).select("day", "cost").distinct().collect()}
        for day, c in got.items():
            p, t = (np.array([r[i] for r in rows if r[0] == day]) for i in (1, 2))
            assert c == pytest.approx(rate * np.abs((1 - c) * t - p).sum(), abs=1e-13)


def walk(prices, targets, cal, rate, cadence, intraday, buy_hold, liquidate):
    """One book session by session, all in dollars: daily net asset values, trades and contributions."""
    symbols, last = sorted({s for _, s in prices}), {}
    values, cash, plan = dict.fromkeys(symbols, 0.0), 1.0, None
    navs, trades, pnl = [], {}, {}
    for n, (date, decision) in enumerate(cal):
        before = dict(values)
        for s in symbols:
            if (date, s) in prices and s in last:
                values[s] *= prices[date, s][0] / last[s]
        gained = {s: values[s] - before[s] for s in symbols}
        total = cash + sum(values.values())
        if n == 0 or not buy_hold and n % cadence == 0:
            plan = {s: targets.get((decision, s), 0.0) for s in symbols}
        if intraday or n == 0 or not buy_hold and n % cadence == 0:
            c = 0.0
            for _ in range(200):
                c = rate * sum(abs((1 - c) * plan[s] - values[s] / total) for s in symbols)
            for s in symbols:
                new = total * (1 - c) * plan[s]
                if abs(new - values[s]) > 1e-12 * total:
                    trades[date, s, "open"] = new - values[s]
                values[s] = new
            cash = total * (1 - c) * (1 - sum(plan.values()))
        opened = dict(values)
        for s in symbols:
            if (date, s) in prices:
                values[s] *= prices[date, s][1] / prices[date, s][0]
                last[s] = prices[date, s][1]
            if before[s] or opened[s]:
                pnl[date, s] = (gained[s], values[s] - opened[s])
        if intraday or liquidate and n == len(cal) - 1:
            for s in symbols:
                if values[s] > 1e-12:
                    trades[date, s, "close"] = -values[s]
                    cash += values[s] * (1 - rate)
                    values[s] = 0.0
        navs.append((date, cash + sum(values.values())))
    return navs, trades, pnl


@pytest.mark.parametrize("intraday,buy_hold,liquidate,cadence", [(False, False, True, 3), (False, False, False, 1), (False, True, True, 2), (True, False, True, 3), (False, False, True, 50)])
def test_ledger_of_two_books(spark, intraday, buy_hold, liquidate, cadence):
    rng = np.random.default_rng(cadence)
    days = [datetime.date(2020, 1, 1) + datetime.timedelta(i) for i in range(14)]
    prices = {(d, s): tuple(float(x) for x in rng.uniform(5, 20, 2)) for d in days for s in "ABCD" if rng.random() > 0.1}
    books = {}
    for book in ("x", "y"):
        for d in days:
            w = rng.dirichlet(np.ones(4)) * (0.9 if book == "x" else rng.choice([1.0, 0.0]))
            books |= {(book, d, s): float(v) for s, v in zip("ABCD", w) if rng.random() > 0.2}
    cal = list(zip(days[1:], days[:-1]))
    p = spark.createDataFrame([(d, s, o, c) for (d, s), (o, c) in prices.items()], "date date, symbol string, open double, close double")
    t = spark.createDataFrame([(b, d, s, w) for (b, d, s), w in books.items()], "book string, date date, symbol string, weight double")
    c = spark.createDataFrame([(d, e, i) for i, (d, e) in enumerate(cal)], "date date, decision_date date, session_no int")
    out = ledger.account_ledger(p, t, c, 30.0, cadence, ("book",), intraday, buy_hold, liquidate)
    daily, trades, pnl = out.daily.collect(), out.trades.collect(), out.contributions.collect()
    for book in ("x", "y"):
        navs, made, gains = walk(prices, {(d, s): w for (b, d, s), w in books.items() if b == book}, cal, 0.003, cadence, intraday, buy_hold, liquidate)
        assert {r["date"]: r["nav"] for r in daily if r["book"] == book} == pytest.approx(dict(navs), rel=1e-9)
        assert {(r["date"], r["symbol"], r["kind"]): r["dollars"] for r in trades if r["book"] == book} == pytest.approx(made, rel=1e-7, abs=1e-10)
        got = {(r["date"], r["symbol"]): (r["overnight"], r["intraday"]) for r in pnl if r["book"] == book}
        for key in {*got, *gains}:
            assert got.get(key, (0, 0)) == pytest.approx(gains.get(key, (0, 0)), rel=1e-7, abs=1e-10)
        total = sum(a + b for a, b in got.values()) - sum(r["fee"] for r in trades if r["book"] == book)
        assert total == pytest.approx(navs[-1][1] - 1, abs=1e-9)


def plain_trees(b, y, iterations, depth, leaves, rate, penalty, least):
    """The trees by direct search over the rows of each leaf."""
    score, trees = np.full(len(y), y.mean()), []

    def split(rows):
        best, g = None, score[rows] - y[rows]
        for f in range(b.shape[1]):
            for cut in range(b[:, f].max()):
                left = b[rows, f] <= cut
                n = left.sum()
                if n < least or len(rows) - n < least:
                    continue
                gain = g[left].sum() ** 2 / (n + penalty) + g[~left].sum() ** 2 / (len(rows) - n + penalty) - g.sum() ** 2 / (len(rows) + penalty)
                if gain > 1e-12 and (best is None or gain > best[0] * (1 + 1e-9)):
                    best = (gain, f, cut)
        return best

    for _ in range(iterations):
        ends = {1: np.arange(len(y))}
        open_, taken = {1: split(ends[1])}, {}
        while len(ends) < leaves and any(open_.values()):
            node = max((n for n in open_ if open_[n]), key=lambda n: (open_[n][0], -n))
            _, f, cut = open_.pop(node)
            rows, taken[node] = ends.pop(node), (f, cut)
            for child, part in ((2 * node, rows[b[rows, f] <= cut]), (2 * node + 1, rows[b[rows, f] > cut])):
                ends[child] = part
                open_[child] = split(part) if child.bit_length() <= depth else None
        values = {n: -rate * (score[r] - y[r]).sum() / (len(r) + penalty) for n, r in ends.items()}
        for n, r in ends.items():
            score[r] += values[n]
        trees.append((taken, values))
    return trees, score


def test_boosted_trees_are_those_of_a_direct_search(spark):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=700), rng.integers(0, 6, 700), rng.uniform(size=700)])
    y = 2 * x[:, 0] + np.where(x[:, 1] > 3, 3 * x[:, 2], -1) + rng.normal(size=700) * 0.2
    pdf = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y, "k": range(700)})
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([(None, 1.0, 1.0, 1.0, 900), (1.0, 1.0, 1.0, None, 901)], "a double, b double, c double, y double, k long")).repartition(3)
    params = {"iterations": 24, "depth": 3, "leaves": 7, "rate": 0.1, "penalty": 10.0, "least": 20}
    model = boosting.fit_trees(df, ("a", "b", "c"), "y", bins=16, **params)
    trees, score = plain_trees(boosting.binned(x, model["edges"]).astype(int), y, **params)
    assert [t[0] for t in model["trees"]] == [t[0] for t in trees]
    for (_, got), (_, want) in zip(model["trees"], trees):
        assert got == pytest.approx(want, abs=1e-10)
    rows = {r["k"]: r["score"] for r in boosting.score_trees(df, model, ("a", "b", "c")).collect()}
    assert rows[900] is None and [rows[i] for i in range(700)] == pytest.approx(score.tolist(), abs=1e-9)
    assert all(len(v) <= 7 for _, v in model["trees"])
    with pytest.raises(ValueError):
        boosting.fit_trees(df.limit(0), ("a",), "y")


def test_exact_quantiles(spark):
    rng = np.random.default_rng(7)
    values = [("even", float(v)) for v in rng.uniform(-5, 5, 3000)] + [("wide", float(v)) for v in np.exp(rng.normal(size=2000) * 20)] + [("same", 2.5)] * 500 + [("one", 1.0), ("pair", 1.0), ("pair", 2.0)]
    values += [("ties", float(v)) for v in rng.integers(0, 3, 400)] + [("far", v) for v in (-math.inf, -1.0, 0.0, 3.0, math.inf)] + [("even", None), ("even", math.nan), ("none", None)]
    df = spark.createDataFrame(values, "k string, v double").withColumn("w", F.when(F.col("v") < 1e300, -F.col("v"))).repartition(5)
    probs = (0.0, 0.01, 0.25, 0.5, 0.975, 1.0)
    got = {(r["k"], r["column"]): r for r in quantiles.exact_quantiles(df, ("v", "w"), probs, ("k",)).collect()}
    assert ("none", "v") not in got
    for k in {v[0] for v in values} - {"none"}:
        have = np.array([v for n, v in values if n == k and v is not None and not math.isnan(v)])
        assert got[k, "v"]["n"] == len(have)
        if k != "far":
            assert got[k, "v"]["q"] == pytest.approx(np.quantile(have, probs).tolist(), rel=1e-12, abs=1e-12)
            assert got[k, "w"]["q"] == pytest.approx(np.quantile(-have, probs).tolist(), rel=1e-12, abs=1e-12)
    assert got["far", "v"]["q"][3] == 0.0 and got["far", "v"]["q"][0] == -math.inf
    assert quantiles.exact_quantiles(df.limit(0), ("v",), (0.5,)).count() == 0


def test_block_models_equal_numpy(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 4)) * [1, 50, 0.01, 0]
    y = x[:, 0] - 0.02 * x[:, 1] + rng.normal(size=400)
    fold = np.where(np.arange(400) < 150, "p", "q")
    pdf = pd.DataFrame({**{f"f{i}": x[:, i] for i in range(4)}, "y": y, "fold": fold})
    blocks = {"few": ("f0", "f2"), "all": ("f0", "f1", "f2", "f3")}
    got = models.ridge_blocks(spark.createDataFrame(pdf), blocks, "y", 0.03).toPandas()
    for name in "pq":
        part = pdf[pdf.fold == name]
        for block, fs in blocks.items():
            v = part[list(fs)].to_numpy()
            lo, hi = np.quantile(v, [0.01, 0.99], axis=0)
            v = np.clip(v, lo, hi)
            scale = np.where(v.std(axis=0) > 1e-12, v.std(axis=0), 1)
            z = np.column_stack([np.ones(len(v)), (v - v.mean(axis=0)) / scale])
            reg = np.eye(len(fs) + 1) * 0.03
            reg[0, 0] = 0
            want = np.linalg.solve(z.T @ z / len(v) + reg, z.T @ part.y / len(v))
            mine = got[(got.fold == name) & (got.block == block)].set_index("feature")["coefficient"]
            assert mine[mine.index.isna()].tolist() + [mine[f] for f in fs] == pytest.approx(want.tolist(), abs=1e-9)
    with pytest.raises(ValueError):
        models.ridge_blocks(spark.createDataFrame(pdf), blocks, "y", 0.03, least_rows=200)


def test_rsi_of_long_series_with_gaps(spark):
    """The windows' blocks against the recurrence row by row, over several blocks and runs."""
    rng = np.random.default_rng(2)
    series = {"long": rng.normal(size=1500).cumsum() + 500, "flat": np.full(40, 7.0), "rises": np.arange(60.0), "gaps": rng.normal(size=400).cumsum() + 90}
    series["long"][700:760] = 480.0
    series["gaps"][[3, 50, 51, 200]] = [np.nan, np.nan, np.nan, np.inf]
    day = lambda i: datetime.date(2000, 1, 1) + datetime.timedelta(i)
    rows = [(s, day(i), None if math.isnan(v) else float(v)) for s, x in series.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol string, date date, close double").repartition(3)
    from panelyard.functions import series as S

    for n in (1, 5, 14):
        got = {(r["symbol"], r["date"]): r["rsi"] for r in S.wilder_rsi(df, n).collect()}
        assert len(got) == len(rows)
        for s, x in series.items():
            ups, downs, means = [], [], None
            for i in range(len(x)):
                d = x[i] - x[i - 1] if i else math.nan
                if not math.isfinite(d):
                    ups, downs, means, want = [], [], None, None
                else:
                    u, v = max(d, 0.0), max(-d, 0.0)
                    ups.append(u)
                    downs.append(v)
                    if means:
                        means = tuple(m * (n - 1) / n + y / n for m, y in zip(means, (u, v)))
                    elif len(ups) == n:
                        means = (sum(ups) / n, sum(downs) / n)
                    want = None if means is None else (100 - 100 / (1 + means[0] / means[1])) if means[1] > 0 else 100.0 if means[0] > 0 else 50.0
                assert got[s, day(i)] == pytest.approx(want, abs=1e-8) if want is not None else got[s, day(i)] is None, (s, i, n)
