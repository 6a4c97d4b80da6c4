"""Rosters, clocks, ledgers and gates: each check returns rows instead of stopping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

TIMES = ("source_timestamp", "observed_at", "known_at", "calculated_at")


def universe_audit(roster: DataFrame, bars: DataFrame, n_sessions: int, fields: tuple[str, ...] = ("close",)) -> DataFrame:
    """V7: roster(symbol, eligible) with included, the first reason against it, and its bars."""
    bad = F.lit(False)
    for f in fields:
        bad = bad | F.col(f).isNull() | F.isnan(f) | (F.col(f) <= 0)
    c = bars.groupBy("symbol").agg(F.count("*").alias("_n"), F.count_if(bad).alias("_bad"))
    j = roster.join(c, "symbol", "left").withColumn("n_bars", F.coalesce("_n", F.lit(0)))
    why = F.when(~F.coalesce("eligible", F.lit(False)), "ineligible").when(F.col("n_bars") != n_sessions, "coverage").when(F.col("_bad") > 0, "values")
    return j.withColumn("exclusion", why).select("symbol", F.col("exclusion").isNull().alias("included"), "exclusion", "n_bars")


def availability_check(records: DataFrame, decision: str = "decision_at", key: str = "record", times: tuple[str, ...] = TIMES) -> DataFrame:
    """(record, field) of inputs that are not known at the decision, and of executions not after it."""
    pairs = ", ".join(f"'{t}', {t}" for t in times)
    late = records.select(key, decision, F.expr(f"stack({len(times)}, {pairs}) as (field, at)")).filter(F.col("at").isNull() | (F.col("at") > F.col(decision))).select(key, "field")
    early = records.filter(F.col("earliest_execution_at").isNull() | (F.col("earliest_execution_at") <= F.col(decision))).select(key, F.lit("earliest_execution_at").alias("field"))
    return late.unionByName(early)


def availability_registry(features: DataFrame, certified: tuple[str, ...], convention: str = "close") -> DataFrame:
    """One row a feature of a feature panel: its timing convention, first and last date and whether it is certified.

    features: (date, feature, value) in long form.
    """
    f = features.filter("value is not null").groupBy("feature").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n"))
    return f.withColumns({"timing": F.lit(convention), "uncertified": ~F.col("feature").isin(*certified)})


def decision_clock(sessions: DataFrame, key: str = "date", lag: str = "1 hour") -> DataFrame:
    """sessions(date, opens, closes) with known, decision and earliest execution times."""
    known = F.col("closes") + F.expr(f"interval {lag}")
    return sessions.select(key, F.col("closes").alias("source_timestamp"), known.alias("known_at"), (known + F.expr("interval 1 second")).alias("decision_at"), F.lead("opens").over(W.partitionBy(F.lit(1)).orderBy(key)).alias("earliest_execution_at"))


def latest_completed(sessions: DataFrame, moments: DataFrame, lag: str = "1 hour") -> DataFrame:
    """Per moment `now`, the last session whose close plus lag has passed; null if none.

    Each session rules from its own time to the next one's. The join is on the days of that span, so a moment meets the
    one or two sessions of its day; after the last session there is nothing to look up.
    """
    w = W.partitionBy(F.lit(1)).orderBy("t")  # the calendar: one row a session
    s = sessions.select((F.col("closes") + F.expr(f"interval {lag}")).alias("t"), F.col("date").alias("d")).withColumn("u", F.lead("t").over(w))
    days = s.filter("u is not null").withColumn("day", F.explode(F.sequence(F.to_date("t"), F.to_date("u"))))
    first, last, session = s.agg(F.min("t"), F.max("t"), F.max_by("d", "t")).first()  # three values
    j = moments.withColumn("day", F.to_date("now")).join(days.hint("merge"), "day").filter((F.col("now") >= F.col("t")) & (F.col("now") < F.col("u")))
    found = j.select("now", F.col("d").alias("session"))
    at = lambda x: F.lit(x).cast(dict(s.dtypes)["t"])
    rest = moments.filter(F.col("now") >= at(last)).select("now", F.lit(session).cast("date").alias("session"))
    none = moments.filter(F.coalesce(F.col("now") < at(first), F.lit(True))).select("now", F.lit(None).cast("date").alias("session"))
    return found.unionByName(rest).unionByName(none)


def registration_check(ledger: DataFrame, required: tuple[str, ...], key: str = "id", payload: str = "payload") -> DataFrame:
    """L2: (id, issue): keys that a registration's JSON payload lacks, and ids registered more than once."""
    lacks = F.array_except(F.array(*[F.lit(k) for k in required]), F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>")))
    missing = ledger.select(key, F.explode(F.transform(lacks, lambda k: F.concat(F.lit("missing "), k))).alias("issue"))
    return missing.unionByName(ledger.groupBy(key).count().filter("count > 1").select(key, F.lit("duplicate").alias("issue")))


def forecast_freeze(forecasts: DataFrame, clock: DataFrame, key: str = "version") -> DataFrame:
    """L3, ST3: forecasts(version, decision_date, issued_at) marked accepted, unknown, early, late or duplicate.

    In time means known_at <= issued_at < earliest_execution_at of the decision's session; of those in time the first
    of a (version, session) is accepted.
    """
    c = clock.select(F.col("date").alias("decision_date"), "known_at", "earliest_execution_at")
    j = forecasts.join(c, "decision_date", "left")
    off = F.when(F.col("known_at").isNull(), "unknown").when(F.col("issued_at") < F.col("known_at"), "early").when(F.coalesce(F.col("issued_at") >= F.col("earliest_execution_at"), F.lit(False)), "late")
    j = j.withColumn("_off", off)
    first = F.row_number().over(W.partitionBy(key, "decision_date", F.col("_off").isNull()).orderBy("issued_at", "forecast_id"))
    return j.withColumn("status", F.coalesce("_off", F.when(first == 1, "accepted").otherwise("duplicate"))).drop("_off", "known_at", "earliest_execution_at")


def outcome_order_checks(rows: DataFrame, order: tuple[str, ...], key: str) -> DataFrame:
    """(key, issue): required times that are null, and neighbours out of order."""
    gone = [F.when(F.col(c).isNull(), f"missing {c}") for c in order]
    wrong = [F.when(F.col(a) > F.col(b), f"{a} > {b}") for a, b in zip(order, order[1:])]
    return rows.select(key, F.explode(F.array_compact(F.array(*gone, *wrong))).alias("issue"))


def trial_budget(ledger: DataFrame, limit: int, study: str = "study", kind: str = "kind") -> DataFrame:
    """Started trials of each study, failed ones included, against a limit."""
    g = ledger.groupBy(study).agg(F.count_if(F.col(kind) == "trial_started").alias("started"))
    return g.withColumns({"remaining": F.greatest(F.lit(0).cast("long"), limit - F.col("started")), "exceeded": F.col("started") > limit})


def gates(metrics: DataFrame, floors: dict[str, float], keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The map of checks metric > floor, null as false, and whether all hold."""
    checks = F.map_from_arrays(F.array(*[F.lit(k) for k in floors]), F.array(*[F.coalesce(F.col(k) > v, F.lit(False)) for k, v in floors.items()]))
    return metrics.select(*keys, checks.alias("checks")).withColumn("passed", F.forall(F.map_values("checks"), lambda x: x))


def promotion_gate(evidence: Column, names: tuple[str, ...]) -> Column:
    """Every named flag of a map is exactly true; absent and null ones are not."""
    out = F.lit(True)
    for n in names:
        out = out & F.coalesce(F.element_at(evidence, n), F.lit(False))
    return out


def canonical_fingerprint(columns: list[str]) -> Column:
    """SHA-256 of the row's JSON with sorted keys; nulls stay as keys."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)
