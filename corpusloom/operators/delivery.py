"""Delivery: findings over proofs and reproducibility reports, and the gate over them with repairs and the opened preview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The stage whose failures ask for evidence of repairs, and how many do.
PROOF, REPEATED = "PARITY_PROOF", 2
NEEDED = ("desktop", "mobile")
# Hosts of a preview on the same machine.
LOCAL = ("127.0.0.1", "localhost", "::1")


def _codes(*rules: tuple[Column, Column | str]) -> Column:
    """The codes of the rules that apply; a test that is null applies."""
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(True)), F.lit(code) if isinstance(code, str) else code) for test, code in rules]))


def proof_findings(projects: DataFrame, contracts: DataFrame, summaries: DataFrame, scenarios: DataFrame, screenshots: DataFrame) -> DataFrame:
    """project, code of all that is wrong with the proof of projects (project).

    contracts: project, locked, fingerprint, dynamic, environments (array), scenarios (number); summaries: project,
    passed, fingerprint; scenarios: project, id, passed, findings (number), dimensions_match, mismatch, captures (map of
    source and local to struct of screenshot, evidence); screenshots: path of those that are there. One contract and one
    summary for a project; what is null is not given.
    """
    count = scenarios.groupBy("project").agg(F.count("*").alias("ran"))
    c = contracts.select("project", F.lit(True).alias("contract"), "locked", F.col("fingerprint").alias("fixed"), "dynamic", "environments", F.col("scenarios").alias("named"))
    s = summaries.select("project", F.lit(True).alias("summary"), "passed", "fingerprint")
    rows = projects.select("project").join(c, "project", "left").join(s, "project", "left").join(count, "project", "left")
    covered = F.col("named") * F.size("environments")
    lacks = F.exists(F.array(*map(F.lit, NEEDED)), lambda e: ~F.array_contains(F.coalesce("environments", F.array().cast("array<string>")), e))
    whole = _codes(
        (F.col("summary").isNull(), "summary-missing-or-invalid"),
        (F.col("contract").isNull(), "contract-missing-or-invalid"),
        (~F.col("passed"), "summary-not-passed"),
        (~F.col("locked") | F.col("fixed").isNull(), "thresholds-unlocked"),
        (~F.col("fingerprint").eqNullSafe(F.col("fixed")), "threshold-fingerprint-mismatch"),
        (F.coalesce("dynamic", F.lit(False)) & lacks, "dynamic-environment-coverage-incomplete"),
        (F.col("ran").isNull() | (covered <= 0) | (F.col("ran") != covered), "scenario-coverage-incomplete"),
    )
    each = scenarios.withColumn("id", F.coalesce("id", F.lit("unknown")))
    of = lambda code, *more: F.concat_ws(":", F.lit(code), F.col("id"), *more)
    ran = _codes((~F.col("passed") | (F.coalesce("findings", F.lit(0)) > 0), of("scenario-failed")), (~F.col("dimensions_match") | F.col("mismatch").isNull() | F.isnan("mismatch") | (F.abs("mismatch") == float("inf")), of("image-evidence-incomplete")))
    sides = each.select("project", "id", F.explode(F.array(F.lit("source"), F.lit("local"))).alias("side"), "captures").select("project", "id", "side", F.try_element_at("captures", F.col("side")).alias("c"))
    there = screenshots.select(F.col("path").alias("screenshot"), F.lit(True).alias("there")).distinct()
    sides = sides.select("project", "id", "side", F.nullif("c.screenshot", F.lit("")).alias("screenshot"), F.col("c.evidence").alias("evidence")).join(there, "screenshot", "left")
    shown = _codes((F.col("there").isNull(), of("screenshot-missing", F.col("side"))), (~F.col("evidence"), of("capture-evidence-incomplete", F.col("side"))))
    known = projects.select("project").distinct()
    parts = [rows.select("project", F.explode(whole).alias("code"))] + [t.select("project", F.explode(codes).alias("code")).join(known, "project", "left_semi") for t, codes in ((each, ran), (sides, shown))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def reproducibility_findings(projects: DataFrame, reports: DataFrame) -> DataFrame:
    """project, code of all that is wrong with reports (project, passed, commands: array of exit codes, routes: array of struct of status and content_type, preview) of projects."""
    rows = projects.select("project").join(reports.withColumn("_report", F.lit(True)), "project", "left")
    bad = lambda r: ~F.coalesce((r["status"] == 200) & F.contains(r["content_type"], F.lit("text/html")), F.lit(False))
    host = F.lower(F.regexp_extract(F.coalesce("preview", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:\s]+)", 1))
    codes = F.when(F.col("_report").isNull(), F.array(F.lit("report-missing"))).otherwise(
        _codes(
            (~F.col("passed"), "report-not-passed"),
            ((F.size("commands") < 2) | F.exists("commands", lambda c: ~F.coalesce(c == 0, F.lit(False))), "commands-incomplete"),
            ((F.size("routes") <= 0) | F.exists("routes", bad), "route-probes-incomplete"),
            (host == "", "preview-url-invalid"),
            ((host != "") & ~host.isin(*LOCAL), "preview-not-loopback"),
        )
    )
    return rows.select("project", F.explode(codes).alias("code"))


def repeated_failures(gates: DataFrame, history: DataFrame, stage: str = PROOF) -> DataFrame:
    """project, failures of a stage: the larger of what failed gates (project, stage, consecutive, attempts) say and of how often the history (project, stage, event) has it failed or interrupted."""
    said = gates.where(F.col("stage") == stage).select("project", F.coalesce(F.nullif("consecutive", F.lit(0)), F.nullif("attempts", F.lit(0)), F.lit(1)).cast("long").alias("said"), F.lit(0).cast("long").alias("seen"))
    seen = history.where((F.col("stage") == stage) & F.col("event").isin("failed", "interrupted")).select("project", F.lit(0).cast("long").alias("said"), F.lit(1).cast("long").alias("seen"))
    return said.unionByName(seen).groupBy("project").agg(F.greatest(F.max("said"), F.sum("seen")).alias("failures"))


def delivery_gate(projects: DataFrame, proof: DataFrame, reproducibility: DataFrame, failures: DataFrame, evidence: DataFrame, opened: DataFrame) -> DataFrame:
    """project, proof_passed, reproducible, repairs_shown, browser_opened, delivered of projects (project, each once).

    proof, reproducibility: their findings; failures: of repeated_failures; evidence: projects that have both a trace
    and a history of repairs, which two failures and more ask for; opened: projects whose preview a browser has opened.
    """
    flag = lambda t, name: t.select("project", F.lit(True).alias(name)).distinct()
    rows = projects.select("project").join(flag(proof, "_proof"), "project", "left").join(flag(reproducibility, "_report"), "project", "left")
    rows = rows.join(failures, "project", "left").join(flag(evidence, "_shown"), "project", "left").join(flag(opened, "_opened"), "project", "left")
    shown = (F.coalesce("failures", F.lit(0)) < REPEATED) | F.col("_shown").isNotNull()
    out = rows.select("project", (F.col("_proof").isNull() & shown).alias("proof_passed"), F.col("_report").isNull().alias("reproducible"), shown.alias("repairs_shown"), F.col("_opened").isNotNull().alias("browser_opened"))
    return out.withColumn("delivered", F.expr("proof_passed and reproducible and repairs_shown and browser_opened"))
