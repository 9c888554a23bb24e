"""Histories of repairs: which proposals are refused and why, and what the history says of those that are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.classify import finding_class

# Folders of reports; an edit of these alone repairs nothing.
REPORTS = ("react/reports/", "reports/", "proof/")


def report_only(files: Column, own: tuple[str, ...] = ()) -> Column:
    """Whether all of some files are reports, or one of `own`, at the top or in a folder; not so where there are none."""
    changed = F.transform(files, lambda f: F.replace(f, F.lit("\\"), F.lit("/")))

    def report(f: Column) -> Column:
        tests = [F.startswith(f, F.lit(p)) for p in REPORTS] + [(f == o) | F.endswith(f, F.lit(f"/{o}")) for o in own]
        some = tests[0]
        for t in tests[1:]:
            some = some | t
        return F.coalesce(some, F.lit(False))

    return F.coalesce((F.size(changed) > 0) & F.forall(changed, report), F.lit(False))


def judged(proposals: DataFrame, by: str, order: list[str], own: tuple[str, ...] = ()) -> DataFrame:
    """Add classification and refused (null where a proposal is kept) to proposals (code, strategy, result, test, action, files).

    What failed before, and was kept, must not be tried again: a class of findings and a strategy fail once, so all later
    proposals of theirs are refused, whatever their result, and one minimum for each tells which. Then, in this order: a
    passed repair names a test, each has an action, and more than reports change. Nulls are empty; order must be without ties.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    at = F.struct(*order)
    own_reason = F.when((F.col("result") == "passed") & blank("test"), "untested").when(blank("action"), "no-action").when(report_only(F.col("files"), own), "report-only")
    rows = proposals.withColumn("classification", finding_class(F.col("code"))).withColumn("_own", own_reason)
    keys = [by, "classification", "strategy"]
    failed = rows.where("_own is null and result = 'failed'").groupBy(*keys).agg(F.min(at).alias("_failed"))
    failed = failed.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], "_failed")
    same = F.col(by).eqNullSafe(F.col("_0")) & (F.col("classification") == F.col("_1")) & F.col("strategy").eqNullSafe(F.col("_2"))
    rows = rows.join(failed, same, "left")
    return rows.withColumn("refused", F.when(at > F.col("_failed"), "repeated").otherwise(F.col("_own"))).drop("_own", "_0", "_1", "_2", "_failed")


def recorded(proposals: DataFrame, by: str, order: list[str], own: tuple[str, ...] = ()) -> DataFrame:
    """The kept proposals with attempt (of their signature in their history; null is a signature, too), previous_signature (of the one kept before) and converged."""
    kept = judged(proposals, by, order, own).where("refused is null").drop("refused")
    history, same = Window.partitionBy(by).orderBy(*order), Window.partitionBy(by, "signature").orderBy(*order)
    converged = F.coalesce(F.col("result") == "passed", F.lit(False))
    return kept.withColumn("attempt", F.row_number().over(same).cast("long")).withColumn("previous_signature", F.lag("signature").over(history)).withColumn("converged", converged)
