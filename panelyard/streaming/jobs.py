"""Structured Streaming jobs. Each takes streaming DataFrames and returns one; `finished` runs a bounded one to its end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import bars as B


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 64) -> DataFrame:
    """A stream over a table's files; the schema is that of the table, its times as timestamps with a zone.

    The path is a pattern, so that a table may be one file or a folder: a stream refuses the plain path of a file.
    """
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/{name}.parque[t]")
    return s.withColumns({c: F.col(c).cast("timestamp") for c, t in s.dtypes if t == "timestamp_ntz"})


def stream_bars(ticks: DataFrame, length: str, delay: str, slide: str | None = None) -> DataFrame:
    """ST1: OHLCV by (key, window) of ticks(key, ts, seq, price, size); rows later than delay are dropped."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    g = ticks.withWatermark("ts", delay).groupBy("key", w.alias("w"))
    b = g.agg(F.min_by("price", F.struct("ts", "seq")).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", F.struct("ts", "seq")).alias("close"), F.sum("size").alias("volume"))
    return b.select("key", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume")


def latest_quote(quotes: DataFrame) -> DataFrame:
    """ST2: the newest bid and ask of each symbol, each with its own time; quotes(symbol, side, price, ts, seq).

    The state is one row a symbol; complete or update mode.
    """
    def newest(side: str, value: str):
        return F.max_by(F.when(F.col("side") == side, F.col(value)), F.when(F.col("side") == side, F.struct("ts", "seq")))

    return quotes.groupBy("symbol").agg(*[newest(s, v).alias(n) for s in ("bid", "ask") for v, n in (("price", s), ("ts", f"{s}_at"))])


def stale(quotes: DataFrame, now: str, seconds: int) -> DataFrame:
    """ST2: the flag of quotes with a side that is missing or older than so many seconds at now."""
    old = lambda c: F.col(c).isNull() | (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(c) > seconds)
    return quotes.withColumn("stale", old("bid_at") | old("ask_at"))


STALENESS = "symbol string, at_ms long, stale boolean, bid double, ask double"
SIDE_STATE = ("bid", "bid_at", "bid_seq", "ask", "ask_at", "ask_seq")
QUOTE_STATE = "symbol array<string>, bid array<double>, bid_at array<long>, bid_seq array<long>, ask array<double>, ask_at array<long>, ask_seq array<long>, stale array<int>"
#: The time of a side without a quote: older than any limit, and far from overflow when subtracted.
NEVER = -(1 << 62)
#: Groups of symbols whose quotes share a state row; a group costs one Python call a batch, whatever its symbols.
QUOTE_BUCKETS = 2048


def quote_staleness(quotes: DataFrame, limit_ms: int, delay: str, buckets: int = QUOTE_BUCKETS) -> DataFrame:
    """ST2: (symbol, at_ms, stale, bid, ask), a row each time that a symbol's quotes become stale or fresh, and at its first.

    quotes(symbol, side, price, ts, seq): stale is a side that is missing or older than the limit. State is one row a bucket
    of symbols (by hash) with an event-time timer at the earliest age limit of its symbols' older sides, so the flag comes
    also where no quote follows, once the watermark (delay after the latest ts) has passed it. Within a batch quotes go by
    (ts, seq); one that comes in a later batch than newer ones changes no row already sent, and a side only if it is its newest.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        values = state.get if state.exists else ([],) * 8
        names, watermark, out = list(values[0]), state.getCurrentWatermarkMs(), []
        rows = None if state.hasTimedOut else pd.concat(list(parts))
        if rows is not None:
            codes, found = pd.factorize(pd.concat([pd.Series(names, dtype=object), rows["symbol"].astype(object)]), use_na_sentinel=False)
            codes, more = codes[len(names) :], len(found) - len(names)
            names += [None if pd.isna(x) else x for x in found[len(names) :]]
        else:
            codes, more = np.empty(0, np.int64), 0
        kinds = [np.float64, np.int64, np.int64] * 2
        new = [np.nan, NEVER, 0] * 2
        held = {n: np.concatenate([np.array(v, k), np.full(more, x, k)]) for n, v, k, x in zip(SIDE_STATE, values[1:7], kinds, new)}
        stale = np.concatenate([np.array(values[7], np.int64), np.full(more, -1)])  # -1: no row yet
        symbols, touched = np.array(names, object), np.zeros(len(names), bool)

        def send(at: np.ndarray, ms: np.ndarray, flag: np.ndarray | bool, bid: np.ndarray, ask: np.ndarray) -> None:
            if len(at):
                out.append(pd.DataFrame({"symbol": symbols[at], "at_ms": ms, "stale": flag, "bid": bid, "ask": ask}))

        if len(codes):
            ms, seq = rows["ms"].to_numpy(np.int64), rows["seq"].to_numpy(np.int64)
            order = np.lexsort((seq, ms, codes))
            c, ms, seq, price, side = codes[order], ms[order], seq[order], rows["price"].to_numpy(np.float64)[order], rows["side"].to_numpy()[order]
            first = np.concatenate([[True], c[1:] != c[:-1]])
            place = np.arange(len(c))
            start = np.maximum.accumulate(np.where(first, place, 0))
            now, before = {}, {}
            for s in ("bid", "ask"):
                at0, seq0 = held[f"{s}_at"][c], held[f"{s}_seq"][c]
                newer = (side == s) & ((ms > at0) | ((ms == at0) & (seq > seq0)))
                last = np.maximum.accumulate(np.where(newer, place, -1))
                here = last >= start
                for n, v in ((s, price), (f"{s}_at", ms), (f"{s}_seq", seq)):
                    now[n] = np.where(here, v[last], held[n][c])
                    before[n] = np.where(first, held[n][c], np.roll(now[n], 1))
            old = (ms - np.minimum(now["bid_at"], now["ask_at"]) > limit_ms).astype(np.int64)
            was = np.where(first, stale[c], np.roll(old, 1))
            due = np.minimum(before["bid_at"], before["ask_at"]) + limit_ms
            expired = (was == 0) & (due < ms)
            send(c[expired], due[expired], True, before["bid"][expired], before["ask"][expired])
            changed = old != np.where(expired, 1, was)
            send(c[changed], ms[changed], old[changed] == 1, now["bid"][changed], now["ask"][changed])
            end = np.concatenate([c[1:] != c[:-1], [True]])
            for n in SIDE_STATE:
                held[n][c[end]] = now[n][end]
            stale[c[end]] = old[end]
            touched[c] = True
        due = np.minimum(held["bid_at"], held["ask_at"]) + limit_ms
        expired = ~touched & (stale == 0) & (due < watermark)
        send(np.flatnonzero(expired), due[expired], True, held["bid"][expired], held["ask"][expired])
        stale[expired] = 1
        state.update((names, *(held[n].tolist() for n in SIDE_STATE), stale.tolist()))
        if (stale == 0).any():
            state.setTimeoutTimestamp(max(int(due[stale == 0].min()), watermark + 1))
        if out:
            yield pd.concat(out)

    q = quotes.withWatermark("ts", delay).withColumns({"ms": F.unix_millis("ts"), "bucket": F.pmod(F.xxhash64("symbol"), F.lit(buckets))})
    return q.groupBy("bucket").applyInPandasWithState(step, STALENESS, QUOTE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def accepted_forecasts(forecasts: DataFrame, clock: DataFrame) -> DataFrame:
    """ST3: forecasts(decision_date, issued_at) issued in their session's time; a stream-static join without state."""
    c = clock.select(F.col("date").alias("decision_date"), F.col("known_at").cast("timestamp").alias("_a"), F.col("earliest_execution_at").cast("timestamp").alias("_b"))
    j = forecasts.join(c.hint("shuffle_hash"), "decision_date")
    return j.filter((F.col("issued_at") >= F.col("_a")) & F.coalesce(F.col("issued_at") < F.col("_b"), F.lit(True))).drop("_a", "_b")


def freeze_once(records: DataFrame, keys: tuple[str, ...], at: str, delay: str) -> DataFrame:
    """ST4: the first arrival of each key; replays within the watermark go, and the state is dropped after it."""
    return records.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))


def forecast_outcomes(forecasts: DataFrame, outcomes: DataFrame, delay: str, horizon: str) -> DataFrame:
    """ST5: forecasts(key, issued_at) with outcomes(key, observed_at) seen after them and within horizon.

    Both sides carry watermarks and the interval bounds the state.
    """
    f, o = forecasts.withWatermark("issued_at", delay).alias("f"), outcomes.withWatermark("observed_at", delay).alias("o")
    on = (F.col("f.key") == F.col("o.key")) & (F.col("o.observed_at") > F.col("f.issued_at")) & (F.col("o.observed_at") <= F.col("f.issued_at") + F.expr(f"interval {horizon}"))
    return f.join(o, on).select("f.*", *[F.col(f"o.{c}") for c in outcomes.columns if c != "key"])


def finished(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a bounded stream yields, from a table in the shared folder; the checkpoint lets a failed run go on.

    Complete mode keeps the last batch's state, each batch replacing the table of the one before.
    """
    spark, path = stream.sparkSession, B.fresh_path(stream.sparkSession, name)
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").option("path", path).start()
    else:
        q = w.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.schema(stream.schema).parquet(path)
