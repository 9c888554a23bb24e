"""Discovery by rounds: what a round asks for is read out of what the round before has found. Each round is a written table, so plans stay short and a rerun goes on where the last one stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FETCHED, MISSING = "fetched", "missing"


def _done(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def discover(files: DataFrame, starts: DataFrame, names: Callable[[DataFrame], DataFrame], folder: str, rounds: int = 6) -> DataFrame:
    """key, round, outcome (fetched or missing) of all that is asked for, each key in its first round.

    files: key and content, in one row or more for a key; starts: key; names: gives the keys that rows of files name.
    folder: where the rounds are kept; those that stand there whole are taken as they are. It ends after `rounds`
    rounds, or with the first that fetches nothing. Null keys are asked for by nobody.
    """
    spark = files.sparkSession
    there = files.select("key").distinct().withColumn("outcome", F.lit(FETCHED))
    done: list[str] = []
    for i in range(rounds):
        path = f"{folder.rstrip('/')}/round-{i}"
        if not _done(spark, path):
            if i == 0:
                asked = starts.select("key")
            else:
                last = spark.read.parquet(done[-1]).where(F.col("outcome") == FETCHED)
                asked = names(files.join(last.select("key"), "key", "left_semi")).select("key").join(spark.read.parquet(*done).select("key"), "key", "left_anti")
            new = asked.where("key IS NOT NULL").distinct().join(there, "key", "left").select("key", F.lit(i).alias("round"), F.coalesce("outcome", F.lit(MISSING)).alias("outcome"))
            new.write.mode("overwrite").parquet(path)
        done.append(path)
        if not spark.read.parquet(path).where(F.col("outcome") == FETCHED).take(1):
            break
    return spark.read.parquet(*done)
