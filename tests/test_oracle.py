"""Every query of the panel engine against its SQL on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from panelyard.plans import catalog

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    yield con
    con.close()


def key(row):
    return tuple((v is not None, type(v).__name__ if not isinstance(v, (int, float)) else "", round(v, 5) if isinstance(v, float) else v) for v in row)


def same(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-7, abs_tol=2e-7)
    return a == b


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in catalog.SQL:
        assert rows
        return
    cur = duck.execute(catalog.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    want = [tuple(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i] for i in order) for r in cur.fetchall()]
    assert len(rows) == len(want)
    for x, y in zip(sorted(rows, key=key), sorted(want, key=key)):
        assert all(same(float(p) if isinstance(q, float) and p is not None else p, q) for p, q in zip(x, y)), (x, y)


def test_scenarios_that_lose_all_in_a_session_match_sql(spark, tmp_path):
    closes = {"1995-01-02": 100_000.0, "1995-01-09": 50.0, "1995-01-16": 100.0, "1996-01-01": 200.0, "1996-01-08": 0.1, "1996-01-15": 0.3}  # 1 + r: 0.0005 twice
    duck = duckdb.connect()
    values = ", ".join(f"({i}, 9, 1, 1, 1.0, {c}, 0.0, 0.0, 'N', 'O', TIMESTAMP '{d}')" for i, (d, c) in enumerate(closes.items()))
    columns = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
    types = dict(zip(columns.split(", "), "BIGINT BIGINT BIGINT INTEGER DOUBLE DOUBLE DOUBLE DOUBLE VARCHAR VARCHAR TIMESTAMP".split()))
    duck.execute(f"CREATE TABLE lineitem AS SELECT {', '.join(f'CAST({c} AS {t}) AS {c}' for c, t in types.items())} FROM (VALUES {values}) AS t({columns})")
    duck.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet'")
    rows = catalog.QUERIES["j12_scenario_grid"](spark, str(tmp_path)).select("symbol", "scenario", "year", "total_return").collect()
    want = duck.execute(f"SELECT symbol, scenario, year, total_return FROM ({catalog.SQL['j12_scenario_grid']})").fetchall()
    found = {(r[1], r[2]): r[3] for r in rows}
    assert len(rows) == len(want) == 5
    assert all(same(found[scenario, year], value) for _, scenario, year, value in want)
    assert found["costly", 1995] == pytest.approx((0.0005 - 0.001) * (2 - 0.001) - 1, abs=1e-7)
    assert found["costly", 1996] == pytest.approx((2 - 0.001) * (0.0005 - 0.001) * (3 - 0.001) - 1, abs=1e-7)


def test_quote_staleness_over_batches_holds_a_state_row_a_bucket(spark, tmp_path):
    import random
    import time
    from datetime import datetime, timedelta, timezone

    from panelyard.streaming import jobs

    rng, limit, day = random.Random(3), 3_600_000, datetime(2024, 1, 1, tzinfo=timezone.utc)
    ends = sorted(rng.sample(range(1, 200_000), 600))
    rows = [(None if i % 61 == 0 else f"s{rng.randrange(60)}", rng.choice(("bid", "ask")), float(i), 1_000 * t, i) for i, t in enumerate(ends)]
    schema = "symbol string, side string, price double, ts timestamp, seq long"
    for k in range(4):  # files in the order of time, one a batch
        part = [(s, side, p, day + timedelta(milliseconds=ms), i) for s, side, p, ms, i in rows[150 * k : 150 * (k + 1)]]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/quotes")
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/quotes")
    q = jobs.quote_staleness(stream, limit, "1 minute", buckets=5)
    run = q.writeStream.format("memory").queryName("staleness").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    run.awaitTermination()
    zero, want, state = int(day.timestamp() * 1000), [], {}
    for symbol, side, price, ms, _ in [*rows, *[(s, None, None, rows[-1][3] - 60_000, None) for s in {r[0] for r in rows}]]:
        at, stale = state.get(symbol, ({}, None))
        end = min(at["bid"][0], at["ask"][0]) + limit if len(at) == 2 else None
        if stale is False and end < ms:
            stale = True
            want.append((symbol, zero + end, True, at["bid"][1], at["ask"][1]))
        if side:
            at[side] = (ms, price)
            now = len(at) < 2 or ms - min(v[0] for v in at.values()) > limit
            if now is not stale:
                want.append((symbol, zero + ms, now, *[at[s][1] if s in at else None for s in ("bid", "ask")]))
            stale = now
        state[symbol] = (at, stale)
    found = [tuple(r) for r in spark.table("staleness").select("symbol", "at_ms", "stale", "bid", "ask").collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert sum(r[2] for r in want) > 100 and len(run.recentProgress) > 3
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress) <= 5
