"""Sums and choices of reports: totals by category, unions, the largest count, the best file, unique names, signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import json_strings


def totals(entries: DataFrame, categories: list[str]) -> DataFrame:
    """category, n for each of a short list of categories: how many entries (array<struct<kind, ..>>) all rows hold; 0 where none."""
    counted = entries.select(F.explode("entries").alias("e")).groupBy(F.col("e.kind").alias("category")).agg(F.count("*").alias("n"))
    every = entries.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    return every.join(counted, "category", "left").select("category", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def union_of(df: DataFrame, by: list[str], items: str) -> DataFrame:
    """The distinct members of array column `items`, sorted, for each group: duplicates go before rows meet."""
    each = df.select(*by, F.explode_outer(items).alias("item")).distinct()
    return each.groupBy(*by).agg(F.array_sort(F.collect_list("item")).alias(items))


def most_failures(gates: DataFrame, history: DataFrame, stage: str) -> DataFrame:
    """failures: the larger of what failed gates of a stage say (consecutive, else attempts, else 1) and of how often its history failed."""
    said = gates.where(F.col("stage") == stage).agg(F.coalesce(F.max(F.coalesce(F.nullif("consecutive", F.lit(0)), F.nullif("attempts", F.lit(0)), F.lit(1))), F.lit(0)).alias("said"))
    seen = history.where((F.col("stage") == stage) & F.col("event").isin("failed", "interrupted")).agg(F.count("*").alias("seen"))
    return said.join(F.broadcast(seen), how="cross").select(F.greatest(F.col("said").cast("long"), "seen").alias("failures"))


def per_round(rows: DataFrame, outcome: str) -> DataFrame:
    """round, outcome, n."""
    return rows.groupBy("round", F.col(outcome).alias("outcome")).agg(F.count("*").alias("n"))


def best_index(files: DataFrame, host: str) -> DataFrame:
    """path: of index files (path) the one of the host, the least deep, the shortest, the first."""
    rank = F.when(F.col("path") == f"{host}/index.html", 0).when(F.startswith("path", F.lit(f"{host}/")), 1).when(F.startswith("path", F.lit(f"{host}_")), 2).otherwise(3)
    return files.agg(F.min(F.struct(rank.alias("r"), F.size(F.split("path", "/")).alias("d"), F.length("path").alias("n"), "path"))["path"].alias("path"))


def unique_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Add unique: the name, with 2, 3 .. behind it from the second row of a name on."""
    nth = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return rows.withColumn("unique", F.when(nth == 1, F.col(name)).otherwise(F.concat(F.col(name), nth.cast("string"))))


def failure_signature(stage: Column, findings: Column, drop: tuple[str, ...] = ("stdout", "stderr", "recordedAt", "at", "durationMs")) -> Column:
    """A digest of a stage and its findings (map<string,string>), in order of their keys, without what differs from run to run."""
    kept = F.array_sort(F.map_entries(F.map_filter(findings, lambda k, v: ~k.isin(*drop))))
    return F.sha2(F.concat_ws("\n", stage, F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), "\n")), 256)


def merged(defaults: Column, given: Column) -> Column:
    """A map of defaults and given entries; given ones count."""
    return F.map_concat(F.map_filter(defaults, lambda k, v: ~F.map_contains_key(given, k)), given)


def deep_strings(rows: DataFrame, key: str, json: str) -> DataFrame:
    """key, text: every string in JSON texts, at whatever depth, in one pass without a loop over levels; what is no JSON to Spark has none."""
    return rows.select(key, F.explode(json_strings(F.col(json))).alias("text"))


def site_summary(pages: DataFrame, route: Column, scripts: Column, title: Column) -> DataFrame:
    """routes, pages, scripts, untitled: one row over all pages."""
    return pages.agg(F.countDistinct(route).alias("routes"), F.count("*").alias("pages"), F.coalesce(F.sum(F.size(scripts)), F.lit(0)).cast("long").alias("scripts"), F.count_if(title == "").alias("untitled"))


def lacking(sources: DataFrame, bodies: dict[str, Column]) -> DataFrame:
    """id, missing: the names, in order, of the bodies that are null or empty in each source."""
    return sources.select("id", F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(b, F.lit("")) == "", F.lit(n)) for n, b in bodies.items()])), ",").alias("missing"))
