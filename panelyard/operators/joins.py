"""As-of, overlap and reconciliation joins, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Width of the cells in which lots are matched, in average fills of their symbol.
CELL_FILLS = 32.0


def bitemporal_asof(facts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per (decision_at, symbol), the latest fact in effect that was known by then; null if none.

    A fact counts from the later of its two times on. Facts and decisions are laid on one time line of the symbol, and
    each decision takes the running maximum of the facts before it: one shuffle, no facts by decisions. Facts without one
    of the times never count.
    """
    at = dict(decisions.dtypes)["decision_at"]
    f = facts.select("symbol", F.greatest("effective_at", "known_at").cast(at).alias("_at"), F.lit(0).alias("_kind"), F.struct("effective_at", "known_at", "value").alias("_fact")).filter("_fact.effective_at is not null and _fact.known_at is not null")
    d = decisions.select("symbol", F.col("decision_at").alias("_at"), F.lit(1).alias("_kind"), F.struct(*decisions.columns).alias("_row"))
    w = W.partitionBy("symbol").orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0)
    line = f.unionByName(d, allowMissingColumns=True).withColumn("_best", F.max("_fact").over(w))
    return line.filter("_kind = 1").select("_row.*", F.when(F.col("_at").isNotNull(), F.col("_best.value")).alias("value"))


def position_diff(expected: DataFrame, actual: DataFrame, key: str = "symbol") -> DataFrame:
    """Keys whose quantities differ; a missing side counts as 0."""
    j = expected.select(key, F.col("quantity").alias("expected")).join(actual.select(key, F.col("quantity").alias("actual")), key, "full")
    j = j.select(key, F.coalesce("expected", F.lit(0.0)).alias("expected"), F.coalesce("actual", F.lit(0.0)).alias("actual"))
    return j.filter(F.col("expected") != F.col("actual"))


def fifo_lots(fills: DataFrame, slot: Column | None = None) -> DataFrame:
    """Sells against the oldest buys of their symbol, as an overlap join of cumulative quantities.

    fills: symbol, seq, sell, price, size. Sells beyond what is bought stay unmatched. slot: a part of the order that seq
    gives, such as its month. Quantities run inside slots and start from the sum of the slots before, so no task holds a
    symbol's whole history. The running quantities are cut at a grid CELL_FILLS average fills of the symbol wide, so that
    each fill meets only fills of the cells that it spans.
    """
    f = fills.withColumn("_slot", slot if slot is not None else F.lit(0))
    sums = f.groupBy("symbol", "sell", "_slot").agg(F.sum("size").alias("_q"), F.count("*").alias("_c"))
    mean = F.sum("_q").over(W.partitionBy("symbol")) / F.sum("_c").over(W.partitionBy("symbol"))
    earlier = F.coalesce(F.sum("_q").over(W.partitionBy("symbol", "sell").orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    sums = sums.select("symbol", "sell", "_slot", earlier.alias("_from"), F.coalesce(CELL_FILLS * F.nullif(mean, F.lit(0.0)), F.lit(1.0)).alias("width"))
    w = W.partitionBy("symbol", "sell", "_slot").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    runs = f.hint("merge").join(sums.hint("merge"), ["symbol", "sell", "_slot"]).withColumn("z", F.col("_from") + F.sum("size").over(w)).withColumn("a", F.col("z") - F.col("size"))
    cell = F.col("width")
    cells = runs.withColumn("cell", F.explode(F.sequence(F.floor(F.col("a") / cell), F.floor(F.col("z") / cell))))
    buys = cells.filter("not sell").select("symbol", "cell", "width", F.col("a").alias("ba"), F.col("z").alias("bz"), F.col("price").alias("buy_price"), F.col("seq").alias("bought"))
    sells = cells.filter("sell").select("symbol", "cell", F.col("a").alias("sa"), F.col("z").alias("sz"), F.col("price").alias("sell_price"), F.col("seq").alias("sold"))
    j = buys.hint("merge").join(sells.hint("merge"), ["symbol", "cell"])
    start, units = F.greatest("ba", "sa"), F.least("bz", "sz") - F.greatest("ba", "sa")
    j = j.filter((units > 0) & (F.col("cell") == F.floor(start / cell)))  # the overlap is counted in its first cell
    return j.select("symbol", "bought", "sold", "buy_price", "sell_price", units.alias("units"), (units * (F.col("sell_price") - F.col("buy_price"))).alias("pnl"))


def lot_outcomes(lots: DataFrame, calendar: DataFrame, entry: Column, exit: Column, rate: float) -> DataFrame:
    """Lots with their holding sessions and, with a fee rate on both fills, cost basis, net pnl and net return.

    entry, exit: the dates of the two fills, which calendar(date, session_no) numbers; a date that it lacks gives null.
    """
    c = calendar.select(F.col("date").alias("entry_date"), F.col("session_no").alias("_in"))
    z = calendar.select(F.col("date").alias("exit_date"), F.col("session_no").alias("_out"))
    j = lots.withColumns({"entry_date": entry, "exit_date": exit}).join(c.hint("merge"), "entry_date", "left").join(z.hint("merge"), "exit_date", "left")
    basis = F.col("units") * F.col("buy_price") * (1 + rate)
    j = j.withColumns({"holding_sessions": F.col("_out") - F.col("_in"), "cost_basis": basis, "net_pnl": F.col("units") * F.col("sell_price") * (1 - rate) - basis})
    return j.withColumn("net_return", F.col("net_pnl") / F.nullif("cost_basis", F.lit(0.0))).drop("_in", "_out")


def latest_per_key(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """T4: the newest record of each key."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def effective_fills(executions: DataFrame) -> DataFrame:
    """Of the corrections base.NN of an execution, the highest."""
    e = executions.withColumns({"base": F.regexp_extract("execution_id", r"^(.*)\.(\d+)$", 1), "revision": F.regexp_extract("execution_id", r"^(.*)\.(\d+)$", 2).cast("int")})
    return latest_per_key(e, ("base",), ("revision",))


def order_state(orders: DataFrame, fills: DataFrame) -> DataFrame:
    """Orders with their filled quantity, average price and state."""
    f = fills.groupBy("order_ref").agg(F.sum("quantity").alias("filled"), (F.sum(F.col("quantity") * F.col("price")) / F.nullif(F.sum("quantity"), F.lit(0.0))).alias("average_price"))
    j = orders.join(f, "order_ref", "left").withColumn("filled", F.coalesce("filled", F.lit(0.0)))
    state = F.when(F.col("filled") >= F.col("quantity"), "FILLED").when(F.col("filled") > 0, "PARTIALLY_FILLED").when(F.col("open"), "ACKNOWLEDGED").otherwise("NOT_SUBMITTED")
    return j.withColumn("state", state)


def first_observed(outcomes: DataFrame, key: str, at: str) -> DataFrame:
    """L4: the first outcome of each key; later revisions are ignored."""
    rest = [c for c in outcomes.columns if c != key]
    return outcomes.groupBy(key).agg(F.min(F.struct(at, *[c for c in rest if c != at])).alias("_x")).select(key, "_x.*")


def chain_breaks(ledger: DataFrame, key: str = "study", order: str = "seq") -> DataFrame:
    """L1: rows whose previous is not the hash of the row before, or whose own hash is wrong."""
    before = F.coalesce(F.lag("sha256").over(W.partitionBy(key).orderBy(order)), F.lit("0" * 64))
    own = F.sha2(F.concat_ws("|", "previous", "payload"), 256)
    return ledger.withColumns({"linked": F.col("previous") == before, "intact": F.col("sha256") == own}).filter("not linked or not intact")


def price_weight_join(weights: DataFrame, prices: DataFrame) -> DataFrame:
    """Weights with prices on (date, symbol); matched is false for keys that one side lacks, so that none goes unseen."""
    j = weights.withColumn("_w", F.lit(True)).join(prices.withColumn("_p", F.lit(True)), ["date", "symbol"], "full")
    return j.withColumn("matched", F.col("_w").isNotNull() & F.col("_p").isNotNull()).drop("_w", "_p")


def keep_accepted(panel: DataFrame, roster: DataFrame, excluded: DataFrame) -> DataFrame:
    """Rows of the roster's symbols without those of excluded groups (symbol)."""
    return panel.join(roster.select("symbol"), "symbol", "left_semi").join(excluded.select("symbol"), "symbol", "left_anti")


def forward_outcome(targets: DataFrame, timing: DataFrame, prices: DataFrame, entry: str = "open", exit: str = "open") -> DataFrame:
    """targets(date, symbol) with the return from the entry session's price to the exit session's.

    Two equi-joins on (symbol, date). status: pending while the exit has no price, missing where the entry has none.
    """
    t = targets.join(timing, "date", "left")
    a = prices.select("symbol", F.col("date").alias("entry_date"), F.col(entry).alias("_a"))
    b = prices.select("symbol", F.col("date").alias("exit_date"), F.col(exit).alias("_b"))
    j = t.join(a, ["symbol", "entry_date"], "left").join(b, ["symbol", "exit_date"], "left")
    status = F.when(F.col("exit_date").isNull() | F.col("_b").isNull(), "pending").when(F.col("_a").isNull(), "missing").otherwise("final")
    return j.withColumns({"outcome": F.col("_b") / F.col("_a") - 1, "status": status}).drop("_a", "_b")


def history(runs: DataFrame, trials: DataFrame, run: str, order: tuple[str, ...]) -> DataFrame:
    """Every run with its trials numbered by time; runs without trials stay, numbered null."""
    n = F.when(F.col("_t").isNotNull(), F.row_number().over(W.partitionBy(run).orderBy(*order)))
    return runs.join(trials.withColumn("_t", F.lit(1)), run, "left").withColumn("trial_no", n).drop("_t")
