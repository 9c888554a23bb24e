"""Convergence kept up batch by batch: a small state for each key (its last two signatures and the length of their run) stands for all rows before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.discovery import _done
from corpusloom.sources.replacing import current, replace, version


def carried(batch: DataFrame, state: DataFrame, by: str, signature: str, order: list[str]) -> DataFrame:
    """The rows of a batch that come after what the state has seen of their key, with consecutive and non_convergent as sequences.convergence gives over all rows; _last: the state after each."""
    known = state.select(F.col(by).alias("_key"), "last", "before", "run", "upto")
    rows = batch.join(known, F.col(by).eqNullSafe(F.col("_key")), "left").drop("_key").where(F.col("upto").isNull() | (F.struct(*order) > F.col("upto")))
    w, same, sig = Window.partitionBy(by).orderBy(*order), Window.partitionBy(by, signature).orderBy(*order), F.col(signature)
    rows = rows.withColumn("_nth", F.row_number().over(w)).withColumn("_run", F.col("_nth") - F.row_number().over(same))
    here = F.row_number().over(Window.partitionBy(by, signature, "_run").orderBy(*order))
    rows = rows.withColumn("_here", here).withColumn("_one", F.when(F.col("_nth") == 1, F.col("last")).otherwise(F.lag(signature).over(w)))
    rows = rows.withColumn("_two", F.when(F.col("_nth") == 1, F.col("before")).when(F.col("_nth") == 2, F.col("last")).otherwise(F.lag(signature, 2).over(w)))
    # A run that starts with the batch goes on with the state's.
    goes_on = (F.col("_here") == F.col("_nth")) & F.col("run").isNotNull() & sig.eqNullSafe(F.col("last"))
    rows = rows.withColumn("consecutive", (F.col("_here") + F.when(goes_on, F.col("run")).otherwise(0)).cast("long"))
    rows = rows.withColumn("non_convergent", (F.col("consecutive") >= 2) | F.coalesce(sig == F.col("_two"), F.lit(False)))
    after = F.struct(F.struct(*order).alias("upto"), sig.alias("last"), F.col("_one").alias("before"), F.col("consecutive").alias("run"))
    return rows.select(*batch.columns, "consecutive", "non_convergent", after.alias("_last"))


def carry_on(batch: DataFrame, root: str, name: str, by: str, signature: str, order: list[str]) -> DataFrame:
    """The rows of carried(), and the state at `root` brought up to them.

    A batch that comes twice under its name gives the rows of the first time, one that comes under another name none, and
    neither changes the state; a run that ends between the two tables is made good by the next with that name. Batches
    come in order: rows before what the state has seen of their key are taken for seen.
    """
    spark, root = batch.sparkSession, root.rstrip("/")
    rows, states = f"{root}/rows/{name}", f"{root}/state"
    seen = current(spark, states) if version(spark, states) else None
    if not _done(spark, rows):
        s = batch.schema
        empty = f"`{by}` {s[by].dataType.simpleString()}, last {s[signature].dataType.simpleString()}, before {s[signature].dataType.simpleString()}, run bigint, upto struct<{', '.join(f'`{o}`: {s[o].dataType.simpleString()}' for o in order)}>"
        carried(batch, seen if seen is not None else spark.createDataFrame([], empty), by, signature, order).write.mode("overwrite").parquet(rows)
    found = spark.read.parquet(rows)
    last = found.groupBy(by).agg(F.max_by("_last", "_last.upto").alias("s"))
    if seen is not None:
        last = last.unionByName(seen.select(by, F.struct("upto", "last", "before", "run").alias("s"))).groupBy(by).agg(F.max_by("s", "s.upto").alias("s"))
    replace(last.select(by, "s.last", "s.before", "s.run", "s.upto"), states, least=0)
    return found.drop("_last")
