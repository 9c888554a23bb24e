"""Inventories of files by hash: snapshots, their difference, closures, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inventory(df: DataFrame, path: str, content: str) -> DataFrame:
    """path, bytes, sha256 of each row."""
    return df.select(F.col(path).alias("path"), F.octet_length(content).cast("bigint").alias("bytes"), F.sha2(F.col(content), 256).alias("sha256"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """path and status (added, removed, modified) where two inventories differ; one full join."""
    b, a = before.select("path", F.col("sha256").alias("was")), after.select("path", F.col("sha256").alias("now"))
    status = F.when(F.col("was").isNull(), F.lit("added")).when(F.col("now").isNull(), F.lit("removed")).otherwise(F.lit("modified"))
    return b.join(a, "path", "full").where(~F.col("was").eqNullSafe(F.col("now"))).select("path", status.alias("status"))


def mismatched(delivered: DataFrame, captured: DataFrame) -> DataFrame:
    """Delivered files whose captured namesake has other bytes."""
    c = captured.select("path", F.col("sha256").alias("captured_sha256"))
    return delivered.join(c, "path").where("sha256 <> captured_sha256").select("path", "sha256", "captured_sha256")


def uncaptured(delivered: DataFrame, *sources: DataFrame) -> DataFrame:
    """Delivered files that none of the sources (captures, declarations) has a path for."""
    for s in sources:
        delivered = delivered.join(s.select("path"), "path", "left_anti")
    return delivered


def known_content(candidates: DataFrame, captured: DataFrame, known: bool = True) -> DataFrame:
    """Candidates whose bytes occur among the captured ones, wherever they lie (or, with known false, do not)."""
    return candidates.join(captured.select("sha256"), "sha256", "left_semi" if known else "left_anti")


def first_by_content(df: DataFrame, content: str, order: str) -> DataFrame:
    """sha256, first (least order value), copies of each content that occurs more than once."""
    return df.groupBy(F.sha2(F.col(content), 256).alias("sha256")).agg(F.min(order).alias("first"), F.count("*").alias("copies")).where("copies > 1")


def ordered_fingerprint(df: DataFrame, order: str, digest: Column, fanout: int = 4096, levels: int = 3) -> DataFrame:
    """One row: the digest of the digests in order, through a tree of `fanout` children a node, so that no node is large.

    order must hold distinct numbers from 0 up, less than fanout ** levels; any other is refused. ordering.path_fingerprint takes paths, and any number.
    """
    at = F.col(order).cast("bigint")
    level = df.select(F.when((at >= 0) & (at < fanout**levels), at).otherwise(F.raise_error(F.lit(f"a number outside 0 to {fanout**levels - 1}")).cast("bigint")).alias("at"), digest.alias("d"))
    for _ in range(levels):
        node = F.transform(F.array_sort(F.collect_list(F.struct("at", "d"))), lambda x: x["d"])
        level = level.groupBy(F.floor(F.col("at") / fanout).cast("bigint").alias("up")).agg(F.sha2(F.array_join(node, ""), 256).alias("d")).withColumnRenamed("up", "at")
    return level.select(F.col("d").alias("fingerprint"))


def forbidden_edits(edits: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    return edits.where(~F.col("path").isin(*allowed))
