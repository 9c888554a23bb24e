"""Histories as sequences: equal runs, recurrence, durations, validity of prefixes and suffixes, repair guardrails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def convergence(history: DataFrame, by: str, signature: str, order: list[str]) -> DataFrame:
    """Add consecutive (length of the run of equal signatures so far) and non_convergent (a run of two, or equal to the one before last)."""
    w = Window.partitionBy(by).orderBy(*order)
    run = F.row_number().over(w) - F.row_number().over(Window.partitionBy(by, signature).orderBy(*order))
    out = history.withColumn("_run", run).withColumn("consecutive", F.row_number().over(Window.partitionBy(by, signature, "_run").orderBy(*order)).cast("bigint"))
    again = F.coalesce(F.col(signature) == F.lag(signature, 2).over(w), F.lit(False))
    return out.withColumn("non_convergent", (F.col("consecutive") >= 2) | again).drop("_run")


def durations(history: DataFrame, by: str, at: str, order: list[str], terminal: Column) -> DataFrame:
    """Terminal rows with duration_ms since the row before."""
    w = Window.partitionBy(by).orderBy(*order)
    ms = F.floor((F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp"))) / 1000)
    return history.withColumn("duration_ms", ms.cast("bigint")).where(terminal & F.col("duration_ms").isNotNull())


def valid_prefix(stages: DataFrame, by: str) -> DataFrame:
    """Stages (ord, done) before a group's first that is not done."""
    gap = Window.partitionBy(by)
    return stages.withColumn("_gap", F.min(F.when(~F.col("done"), F.col("ord"))).over(gap)).where("_gap is null or ord < _gap").drop("_gap")


def invalidated_from(stages: DataFrame, by: str, first: str) -> DataFrame:
    """Stages from the named one on."""
    at = Window.partitionBy(by)
    return stages.withColumn("_at", F.min(F.when(F.col("stage") == first, F.col("ord"))).over(at)).where("ord >= _at").drop("_at")


def latest(df: DataFrame, by: str, key: list[str], value: str) -> DataFrame:
    """The value at the greatest key of each group."""
    return df.groupBy(by).agg(F.max_by(value, F.struct(*key)).alias(value), *[F.max(F.struct(*key))[k].alias(k) for k in key])


def repair_guardrails(history: DataFrame, order: list[str]) -> DataFrame:
    """Add attempt (of this signature so far) and repeated (the same finding and strategy failed before)."""
    same = Window.partitionBy("signature").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    tried = Window.partitionBy("finding", "strategy").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return history.withColumn("attempt", (F.count("*").over(same) + 1).cast("bigint")).withColumn("repeated", F.coalesce(F.bool_or(~F.col("passed")).over(tried), F.lit(False)))


def bracketed(actions: DataFrame, by: str, order: str) -> DataFrame:
    """Add bracketed: whether an action stands between two checkpoints, waits aside."""
    w = Window.partitionBy(by).orderBy(order)
    kind = F.when(F.col("kind") != "wait", F.col("kind"))
    before = F.last(kind, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(kind, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return actions.withColumn("bracketed", F.coalesce((before == "checkpoint") & (after == "checkpoint"), F.lit(False)))
