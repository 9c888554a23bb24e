"""Lookups between reports: with a default, with a fallback key, over checkpoints, over a grid, by known keys only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def targets_of(loaders: DataFrame, scripts: DataFrame) -> DataFrame:
    """path, target, exists, class: each target of a loader (path, targets) looked up among scripts (path, touches_dom, creates_worker, has_canvas)."""
    wanted = loaders.select("path", F.explode("targets").alias("target"))
    facts = scripts.select(F.col("path").alias("target"), (F.col("touches_dom") | F.col("creates_worker") | F.col("has_canvas")).alias("starts"))
    found = wanted.join(facts, "target", "left")
    kind = F.when(F.col("starts").isNull(), F.lit("missing")).when(F.col("starts"), F.lit("application-bootstrap")).otherwise(F.lit("runtime-script"))
    return found.select("path", "target", F.col("starts").isNotNull().alias("exists"), kind.alias("class"))


def checkpoint_results(source: DataFrame, local: DataFrame) -> DataFrame:
    """id, status of checkpoints (id, state) of two runs: missing on a side, different or equal."""
    both = source.select("id", F.lit(True).alias("here"), F.col("state").alias("a")).join(local.select("id", F.lit(True).alias("there"), F.col("state").alias("b")), "id", "full")
    status = F.when(F.col("there").isNull(), F.lit("missing-local")).when(F.col("here").isNull(), F.lit("missing-source")).when(F.col("a").eqNullSafe(F.col("b")), F.lit("equal")).otherwise(F.lit("different"))
    return both.select("id", status.alias("status"))


def grid(environments: DataFrame, scenarios: DataFrame, results: DataFrame) -> DataFrame:
    """environment, scenario, n of every pair that should have run (each side a short list), with the number of its results."""
    pairs = environments.select("environment").distinct().join(F.broadcast(scenarios.select("scenario").distinct()), how="cross")
    ran = results.groupBy("environment", "scenario").agg(F.count("*").alias("n"))
    return pairs.join(ran, ["environment", "scenario"], "left").select("environment", "scenario", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def local_copies(urls: DataFrame, copies: DataFrame, fallback: Column) -> DataFrame:
    """url, kept_as: the copy of the whole URL, else that of its fallback key; null without any. copies: key, kept_as, one for each key."""
    keyed = urls.select("url", fallback.alias("other"))
    one, two = copies.select(F.col("key").alias("url"), F.col("kept_as").alias("first")), copies.select(F.col("key").alias("other"), F.col("kept_as").alias("second"))
    return keyed.join(one, "url", "left").join(two, "other", "left").select("url", F.coalesce("first", "second").alias("kept_as"))


def pages_of_scripts(scripts: DataFrame, pages: DataFrame, reached: DataFrame) -> DataFrame:
    """src, page, reached: the page of each legacy script's route, and whether anything reaches it."""
    found = scripts.select("route", "src").join(pages.select("route", "page"), "route", "left")
    return found.join(reached.select(F.col("node").alias("page"), F.lit(True).alias("r")), "page", "left").select("src", "page", F.coalesce("r", F.lit(False)).alias("reached"))


def joined_known(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """rows joined with known; raises if a row's key is not known."""
    unknown = [r[0] for r in rows.join(known, key, "left_anti").select(key).distinct().limit(5).collect()]
    if unknown:
        raise ValueError(f"unknown {key}: {', '.join(map(str, unknown))}")
    return rows.join(known, key)
