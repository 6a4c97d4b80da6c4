"""Operators without a query of their own, against values worked out by hand."""

from __future__ import annotations

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelyard.operators import account as A
from panelyard.operators import joins as J
from panelyard.operators import study as T
from panelyard.sources import bars as B


def test_trading_cost(spark):
    row = spark.range(1).select(A.trading_cost(F.array(F.lit(0.0)), F.array(F.lit(1.0)), 0.01).alias("c")).first()
    assert row["c"] == pytest.approx(0.01 / 1.01, abs=1e-14)


def test_single_asset_and_break_even(spark):
    legs = spark.createDataFrame([("a", dt.date(2020, 1, 1), 0.02)], "symbol string, date date, r double")
    assert A.single_asset_account(legs, 100.0).first()["nav"] == pytest.approx(1.02 * 0.99 / 1.01)
    assert A.break_even_bps(legs).first()["bps"] == pytest.approx(10_000 * 0.02 / 2.02)


def test_chart_bars(spark):
    text = '{"chart": {"result": [{"meta": {"symbol": "X"}, "timestamp": [1577975400], "indicators": {"quote": [{"open": [100.0], "high": [103.0], "low": [99.0], "close": [102.0], "volume": [7]}], "adjclose": [{"adjclose": [51.0]}]}}]}}'
    schema = "chart struct<result: array<struct<meta: struct<symbol: string>, timestamp: array<bigint>, indicators: struct<quote: array<struct<open: array<double>, high: array<double>, low: array<double>, close: array<double>, volume: array<bigint>>>, adjclose: array<struct<adjclose: array<double>>>>>>>"
    payload = spark.createDataFrame([(text,)], "t string").select(F.from_json("t", schema).alias("p")).select("p.chart")
    row = B.chart_bars(payload, "2020-01-01", "2020-01-31").first()
    assert (row["symbol"], row["date"], row["adj_open"]) == ("X", dt.date(2020, 1, 2), 50.0)


def test_ledgers(spark):
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    zero, a = "0" * 64, h("0" * 64 + "|p")
    rows = [("s", 1, zero, "p", a), ("s", 2, a, "q", h(a + "|q")), ("t", 1, zero, "p", a), ("t", 2, zero, "q", h(zero + "|q"))]
    bad = J.chain_breaks(spark.createDataFrame(rows, "study string, seq int, previous string, payload string, sha256 string")).collect()
    assert [(r["study"], r["seq"]) for r in bad] == [("t", 2)]
    fills = spark.createDataFrame([("e.01", 1.0), ("e.02", 2.0), ("e.10", 3.0), ("f.01", 4.0)], "execution_id string, quantity double")
    assert sorted(r["quantity"] for r in J.effective_fills(fills).collect()) == [3.0, 4.0]


def test_close_marked_account(spark):
    days = [dt.date(2020, 1, n) for n in (1, 2, 3)]
    prices = spark.createDataFrame(list(zip(days, "AAA", (100.0, 100.0, 121.0), (100.0, 110.0, 133.1))), "date date, symbol string, open double, close double")
    targets = prices.select("date", "symbol", F.lit(1.0).alias("weight"))
    cal = spark.createDataFrame([(days[1], days[0], 0), (days[2], days[1], 1)], "date date, decision_date date, session_no int")
    for cadence in (1, 5):
        free = {r["date"]: r for r in A.close_marked_account(prices, targets, cal, 0.0, cadence).collect()}
        last = free[days[2]]
        assert (last["nav"], last["overnight"], last["intraday"]) == pytest.approx((1.331, 0.10, 0.11))
        paid = {r["date"]: r for r in A.close_marked_account(prices, targets, cal, 100.0, cadence).collect()}
        assert paid[days[2]]["nav"] == pytest.approx(1.331 * 0.99 / 1.01)
        assert all(r["overnight"] + r["intraday"] - r["cost"] == pytest.approx(r["net"]) for r in paid.values())


def test_normal_cdf(spark):
    from statistics import NormalDist

    from panelyard.operators import models as M

    zs = [-4.0, -1.3, 0.0, 0.2, 1.96, 5.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", M.normal_cdf(F.col("z")).alias("p")).collect()
    assert all(r["p"] == pytest.approx(NormalDist().cdf(r["z"]), abs=2e-7) for r in got)


def test_verify_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a")
    (tmp_path / "b.txt").write_text("b")
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    listed = spark.createDataFrame([("a.txt", h("a")), ("b.txt", h("x")), ("c.txt", h("c"))], "name string, sha256 string")
    assert {(r["name"], r["issue"]) for r in B.verify_files(spark, str(tmp_path), listed).collect()} == {("b.txt", "differs"), ("c.txt", "no file")}


def test_close_marked_account_step_by_step(spark):
    import random

    rng, names, n, cadence, rate = random.Random(4), "ABC", 14, 3, 0.005
    days = [dt.date(2021, 3, 1) + dt.timedelta(i) for i in range(n)]
    close = {(i, s): 100 * rng.uniform(0.8, 1.2) for i in range(n) for s in names}
    open_ = {k: v * rng.uniform(0.95, 1.05) for k, v in close.items()}
    weight = {(i, s): rng.choice([0.0, 0.1, 0.3]) for i in range(n) for s in names}
    rows = [(days[i], s, open_[i, s], close[i, s], weight[i, s]) for i, s in close]
    df = spark.createDataFrame(rows, "date date, symbol string, open double, close double, weight double")
    cal = spark.createDataFrame([(days[i], days[i - 1], i - 1) for i in range(1, n)], "date date, decision_date date, session_no int")
    got = {r["date"]: r for r in A.close_marked_account(df, df, cal, rate * 10_000, cadence).collect()}
    cash, units = 1.0, dict.fromkeys(names, 0.0)
    for i in range(1, n):
        value = cash + sum(units[s] * open_[i, s] for s in names)
        if (i - 1) % cadence == 0:
            after = value
            for _ in range(200):  # the value that is left once the fees of reaching the weights are paid
                after = value - rate * sum(abs(after * weight[i - 1, s] - units[s] * open_[i, s]) for s in names)
            units = {s: after * weight[i - 1, s] / open_[i, s] for s in names}
            cash = after - sum(units[s] * open_[i, s] for s in names)
        nav = cash + sum(units[s] * close[i, s] for s in names)
        nav -= rate * sum(units[s] * close[i, s] for s in names) if i == n - 1 else 0
        assert got[days[i]]["nav"] == pytest.approx(nav, abs=1e-9)
        assert got[days[i]]["n_missing"] == 0


def test_capped_weights(spark):
    from panelyard.functions import cross as X

    raw = {"a": [9.0, 1.0, 1.0, 1.0], "b": [1.0], "c": [6.0, 5.0, 1.0, 0.5], "d": [1.0] * 5, "e": [2.0, 2.0]}
    rows = [(k, f"s{i}", x) for k, v in raw.items() for i, x in enumerate(v)]
    got = {}
    for r in X.capped(spark.createDataFrame(rows, "date string, symbol string, raw double"), "raw", 0.995, 0.4).orderBy("symbol").collect():
        got.setdefault(r["date"], []).append(r["weight"])
    for k, v in raw.items():
        held = set()
        while True:  # hold what exceeds the cap and share the rest, until nothing exceeds it
            free = sum(x for i, x in enumerate(v) if i not in held)
            w = [0.4 if i in held else x / free * (0.995 - 0.4 * len(held)) for i, x in enumerate(v)]
            over = {i for i, x in enumerate(w) if x > 0.4 and i not in held}
            held |= over
            if not over or len(held) == len(v):
                break
        assert got[k] == pytest.approx([0.4 if i in held else x for i, x in enumerate(w)])


def test_rsi_starts_again_after_a_gap(spark):
    from datetime import date

    from panelyard.functions import series

    closes = [10.0, 11.0, 10.5, None, 12.0, 11.0, 13.0, 12.5]
    bars = spark.createDataFrame([("A", date(2020, 1, i + 1), c) for i, c in enumerate(closes)], "symbol string, date date, close double")
    got = [r["rsi"] for r in series.wilder_rsi(bars, 2).orderBy("date").collect()]
    assert [x and round(x, 1) for x in got] == [None, None, 66.7, None, None, None, 66.7, 50.0]


def test_session_gaps_by_hand(spark):
    from panelyard.operators import validation as V

    day = lambda n: dt.date(2020, 1, n)
    bars = spark.createDataFrame([("a", day(2)), ("a", day(5)), ("a", day(5)), ("b", day(1)), ("b", day(9))], "symbol string, date date")
    cal = spark.createDataFrame([(day(n),) for n in range(1, 7)], "date date")
    got = lambda own: sorted((r["symbol"], r["date"].day) for r in V.session_gaps(bars, cal, own).collect())
    assert got(True) == [("a", 3), ("a", 4)]
    assert got(False) == [("a", n) for n in (1, 3, 4, 6)] + [("b", n) for n in (2, 3, 4, 5, 6)]
    assert V.session_gaps(bars.limit(0), cal).isEmpty()


def test_asof_joins_brute_force(spark):
    import random

    rng = random.Random(3)
    at = lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(hours=n)
    when = lambda: rng.choice([None, *range(20)])
    raw = [(rng.choice("abc"), when(), when(), rng.choice([None, 1.0, 2.0, 3.0])) for _ in range(200)]
    facts = [(s, e if e is None else at(e), k if k is None else at(k), v) for s, e, k, v in raw]
    wanted = [(s, at(n), f"{s}{n}") for s in "abcd" for n in (-1, 0, 5, 5, 19)] + [("a", None, "none")]
    f = spark.createDataFrame(facts, "symbol string, effective_at timestamp_ntz, known_at timestamp_ntz, value double")
    d = spark.createDataFrame(wanted, "symbol string, decision_at timestamp_ntz, note string")
    got = sorted((r["note"], r["value"] or 0.0) for r in J.bitemporal_asof(f, d).collect())

    def best(s, t):
        seen = [(e, k, v or 0.0) for x, e, k, v in facts if x == s and t and e and k and e <= t and k <= t]
        return max(seen)[2] if seen else 0.0

    assert got == sorted((n, best(s, t)) for s, t, n in wanted)


def test_fifo_lots_slots_do_not_matter(spark):
    import random

    rng = random.Random(8)
    fills = [(rng.choice("ab"), i, rng.random() < 0.5, float(rng.randint(1, 9)), float(rng.choice([1, 2, 50, 400]))) for i in range(300)]
    df = spark.createDataFrame(fills, "symbol string, seq int, sell boolean, price double, size double")
    want = []
    for s in "ab":
        open_ = [[i, p, q] for x, i, sell, p, q in fills if x == s and not sell]
        for _, i, _, p, q in [r for r in fills if r[0] == s and r[2]]:
            while q > 0 and open_:
                units = min(q, open_[0][2])
                want.append((s, open_[0][0], i, units, units * (p - open_[0][1])))
                q, open_[0][2] = q - units, open_[0][2] - units
                if open_[0][2] == 0:
                    open_.pop(0)
    for slot in (None, F.floor(F.col("seq") / 20)):
        got = sorted((r["symbol"], r["bought"], r["sold"], r["units"], r["pnl"]) for r in J.fifo_lots(df, slot).collect())
        assert got == sorted(want)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_bars_need_no_shuffle_by_symbol(spark, tmp_path):
    rows = [(s, dt.date(2020, 1, d), *[float(d)] * 7) for s in ("A", "B", None) for d in (1, 2, 2, 3)]
    df = spark.createDataFrame(rows, B.BARS)
    a = B.store_bars(df, "stored_a", f"{tmp_path}/a", 3)
    b = B.store_bars(df, "stored_b", f"{tmp_path}/b", 3)
    assert a.dtypes == df.dtypes and not a.exceptAll(df).count() and a.count() == 12
    by = W.partitionBy("symbol").orderBy("date")
    moved = a.withColumn("before", F.lag("close").over(by))
    for x in (moved, a.groupBy("symbol", "date").agg(F.sum("volume")), a.hint("merge").join(b.hint("merge"), "symbol")):
        assert "Exchange" not in plan(x)
    both = a.hint("merge").join(b.hint("merge"), ["symbol", "date"])
    assert "Exchange" in plan(both)
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    try:
        both = a.hint("merge").join(b.hint("merge"), ["symbol", "date"])
        assert "Exchange" not in plan(both) and both.count() == 2 * (1 + 4 + 1)  # null symbols meet nothing
    finally:
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
    assert "SelectedBucketsCount: 1 out of 3" in plan(moved.filter("symbol = 'A'"))
    assert B.store_bars(df.limit(0), "stored_none", f"{tmp_path}/none", 3).count() == 0
    with pytest.raises(Exception, match="(?i)already exists"):
        B.store_bars(df, "stored_a", f"{tmp_path}/c", 3)
    for name in ("stored_a", "stored_b", "stored_none"):
        spark.sql(f"DROP TABLE {name}")


def test_top_lot_share_counts_equal_wins(spark):
    values = [5.0] * 40 + [5.01] * 3 + [1.0] * 7 + [-2.0] * 5 + [0.0]
    lots = spark.createDataFrame([(v,) for v in values], "pnl double")
    wins, counts = sorted((v for v in values if v > 0), reverse=True), {"two": 2, "ten": 10, "all": 50}
    got = {r["label"]: r for r in T.top_lot_share(lots, counts, {}).collect()}
    for label, n in counts.items():
        assert got[label]["pnl"] == pytest.approx(sum(wins[:n]))
