"""Gates over inventories of files (path, sha256): against a baseline, between snapshots of a run, against captures, against known content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import url as U
from corpusloom.operators.ordering import path_fingerprint

# What the trace of a run follows; reports among it that may be written by hand; files that conversion may change.
TRACKED = ("react/src", "react/public", "react/reports", "react/package.json", "react/package-lock.json", "react/tsconfig.json", "react/vite.config.ts", "proof/proof-contract.json")
BY_HAND = ("react/reports/proof-profile.json", "react/reports/engine-contract.json")
REPORTS = "react/reports/"
PASSED_OVER = ("/node_modules/", "/dist/")
CHANGEABLE = (".cjs", ".css", ".htm", ".html", ".js", ".mjs")


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _sides(by: list[str], **tables: DataFrame) -> DataFrame:
    """by, path and a column for each table with the hash that it has for the path (null: none): one shuffle for all of them, where joins would take one each. Of hashes that repeat for a path the greatest counts."""
    rows = None
    for name, t in tables.items():
        r = t.select(*by, "path", F.lit(name).alias("_side"), F.coalesce("sha256", F.lit("")).alias("sha256"))
        rows = r if rows is None else rows.unionByName(r)
    return rows.groupBy(*by, "path").agg(*[F.max(F.when(F.col("_side") == n, F.col("sha256"))).alias(n) for n in tables])


def _change(was: Column, now: Column) -> Column:
    return F.when(was.isNull() & now.isNotNull(), "added").when(was.isNotNull() & now.isNull(), "removed").when(was != now, "modified")


def baseline_findings(current: DataFrame, baseline: DataFrame, by: list[str] | None = None, suffix: str = ".css") -> DataFrame:
    """by, path, finding (modified, untracked, missing) of files of a kind that differ from the baseline's."""
    by = by or []
    of = lambda t: t.where(F.endswith(F.lower("path"), F.lit(suffix)))
    change = _change(F.col("was"), F.col("now"))
    name = F.when(change == "added", "untracked").when(change == "removed", "missing").otherwise(change)
    return _sides(by, was=of(baseline), now=of(current)).select(*by, "path", name.alias("finding")).where("finding is not null")


def baseline_gate(current: DataFrame, baseline: DataFrame, by: list[str] | None = None, suffix: str = ".css") -> DataFrame:
    """by, checked, modified, untracked, missing, baseline_missing, passed: one row, or one for each group that has a file of the kind in either table. Without any row a baseline is missing, and nothing passes."""
    by = by or []
    of = lambda t: t.where(F.endswith(F.lower("path"), F.lit(suffix)))
    was, now = F.col("was"), F.col("now")
    out = _sides(by, was=of(baseline), now=of(current)).groupBy(*by).agg(
        F.count("now").alias("checked"), F.count_if(was != now).alias("modified"), F.count_if(was.isNull()).alias("untracked"), F.count_if(now.isNull()).alias("missing"), (F.count("was") == 0).alias("baseline_missing")
    )
    return out.withColumn("passed", F.expr("not baseline_missing and modified = 0 and untracked = 0 and missing = 0"))


def tracked(path: Column, own: tuple[str, ...] = ()) -> Column:
    """Whether the trace of a run follows a file: one of the tracked files or of `own` (what a run keeps of itself), or below such a folder, built and installed files apart."""
    return _any([(path == t) | F.startswith(path, F.lit(f"{t}/")) for t in (*TRACKED, *own)]) & ~_any([F.contains(path, F.lit(p)) for p in PASSED_OVER])


def run_changes(before: DataFrame, start: DataFrame, end: DataFrame, by: list[str] | None = None, own: tuple[str, ...] = ()) -> DataFrame:
    """by, path, made_by (outside: between runs, pipeline: within one), status, forbidden of every change of what a trace follows.

    before: the snapshot that the last run left; a group without any row in it has no outside changes to tell of. A
    report that was changed is forbidden unless it may be written by hand. own: files and folders that are followed, too,
    such as a run's manifest of its oracle and its history of repairs.
    """
    by = by or []
    of = lambda t: t.where(tracked(F.col("path"), own))
    both = F.array(F.struct(F.lit("outside").alias("made_by"), _change(F.col("was"), F.col("start")).alias("status")), F.struct(F.lit("pipeline").alias("made_by"), _change(F.col("start"), F.col("end")).alias("status")))
    rows = _sides(by, was=of(before), start=of(start), end=of(end)).select(*by, "path", F.explode(both).alias("c")).select(*by, "path", "c.*").where("status is not null")
    runs = before.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], F.lit(True).alias("_any"))
    runs = runs.distinct() if by else runs.limit(1)
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_{i}"))
    outside = rows.where("made_by = 'outside'").join(runs if by else F.broadcast(runs), same, "left_semi")
    report = (F.col("status") == "modified") & F.startswith("path", F.lit(REPORTS)) & ~F.col("path").isin(*BY_HAND)
    return outside.unionByName(rows.where("made_by = 'pipeline'")).withColumn("forbidden", report)


def public_findings(delivered: DataFrame, site: DataFrame, mirror: DataFrame, declared: DataFrame) -> DataFrame:
    """path, finding: uncaptured (neither declared, nor of the site, nor of the mirror below _external), or mismatched (other bytes than captured, where conversion must not change them).

    delivered, site, mirror: path, sha256; declared: path. Files below legacy are passed over.
    """
    outer = mirror.select(F.concat(F.lit("_external/"), "path").alias("path"), "sha256")
    mine = F.lit(1).cast("string")
    sides = _sides([], now=delivered.where(~F.startswith("path", F.lit("legacy/"))), site=site, outer=outer, said=declared.select("path", mine.alias("sha256")))
    was = F.coalesce("site", "outer")
    other = (F.col("now") != was) & ~U.extension(F.col("path")).isin(*CHANGEABLE)
    finding = F.when(F.col("said").isNotNull(), None).when(was.isNull(), "uncaptured").when(other, "mismatched")
    return sides.where("now is not null").select("path", finding.alias("finding"))


def public_gate(delivered: DataFrame, site: DataFrame, mirror: DataFrame, declared: DataFrame) -> DataFrame:
    """checked, uncaptured, mismatched, passed: one row. public_findings has a row for each file that is checked."""
    out = public_findings(delivered, site, mirror, declared).agg(F.count("*").alias("checked"), F.count_if(F.col("finding") == "uncaptured").alias("uncaptured"), F.count_if(F.col("finding") == "mismatched").alias("mismatched"))
    return out.withColumn("passed", F.expr("uncaptured = 0 and mismatched = 0"))


def oracle_gate(files: DataFrame, captured: DataFrame) -> DataFrame:
    """files, unknown, passed, integrity: whether all files of a source oracle have bytes that were captured, and the digest of their paths and hashes in order. No file at all is no oracle."""
    known = captured.select("sha256", F.lit(True).alias("known")).distinct()
    counts = files.join(known, "sha256", "left").agg(F.count("*").alias("files"), F.count_if(F.col("known").isNull()).alias("unknown"))
    counts = counts.withColumn("passed", F.expr("files > 0 and unknown = 0"))
    return counts.join(F.broadcast(path_fingerprint(files).withColumnRenamed("fingerprint", "integrity")), how="cross")  # one row beside one


def oracle_holds(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """valid: whether the files that are there now are those of a manifest (integrity)."""
    now = path_fingerprint(files).agg(F.max("fingerprint").alias("now"))
    return manifest.agg(F.max("integrity").alias("integrity")).join(F.broadcast(now), how="cross").select(F.coalesce(F.col("now") == F.col("integrity"), F.lit(False)).alias("valid"))
