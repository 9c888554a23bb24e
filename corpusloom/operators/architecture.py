"""The architecture check of rebuilt projects: rules as a table over named facts, the facts of one pass of aggregates over their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import classify, script

# The router's package, methods of an engine, what tells of each fact in a source text.
ROUTER_PACKAGE = "@tanstack/react-router"
METHODS = ("start", "resize", "dispatch", "snapshot", "destroy")
ROUTER, FILE_ROUTE = r"\bRouterProvider\b", r"\bcreateFileRoute\b"
INJECTED = r"""createElement\(\s*["']script["']|appendChild\(\s*script\b|LegacyScripts|data-legacy-route"""
LEGACY = r"\bLegacyScripts\b|legacyScripts|legacy-script-adapter"
IMPERATIVE = r"document[.]body[.]appendChild|document[.]body[.]innerHTML|insertAdjacentHTML"
CANVAS, DRAWN = r"<canvas\b", r"""<canvas\b|getContext\(\s*["'](?:webgl|webgl2)|WebGLRenderer"""
IMPORTED, STARTED, DESTROYED = r"""from\s*["'][^"']*engines/""", r"[.]start\s*\(", r"[.]destroy\s*\("
SURFACE, TERMINATED = r"getContext\s*\(|WebGLRenderer|renderer", r"[.]terminate\s*\("
RENDERED = r"\b(?:drawImage|fillRect|strokeRect|clearRect|fillText|strokeText|putImageData|drawArrays|drawElements|clear|render)\s*\("
SOURCE_FILE, ENGINE_FILE = r"(?i)^src/.*\.(?:js|jsx|mjs|cjs|ts|tsx)$", r"(?:^|/)src/engines/[^/]+/index[.]tsx?$"
PUBLIC_FILE, MIRROR_FILE = r"(?i)^public/.*[.]m?js(?:[.][a-z0-9_-]+)*$", r"(?i)^mirror/.*\.(?:js|mjs|cjs)$"
PLACEHOLDER = r"/\*[\s\S]*?\*/|(?m://.*$)|\bvoid\s+0\s*;?|\breturn\s*;?|[\s;]+"


def bodies(code: Column, method: str) -> Column:
    """What stands behind the head of a method, or of an arrow function of its name, up to the first brace that closes."""
    head = rf"{method}\s*\([^)]*\)\s*(?::[^={{;\n]+)?\s*\{{([^}}]*)\}}"
    arrow = rf"{method}\s*:\s*(?:async\s*)?\([^)]*\)\s*(?::[^=;\n]+)?=>\s*\{{([^}}]*)\}}"
    return F.concat(*[F.regexp_extract_all(code, F.lit(p), F.lit(1)) for p in (head, arrow)])


def meaningful(body: Column) -> Column:
    """Whether a body does more than return."""
    return F.regexp_replace(body, PLACEHOLDER, "") != ""


def facts(files: DataFrame, by: str) -> DataFrame:
    """One row of counts for each project (`by`) of files (path, text): how many of its files say what the rules ask for.

    Null texts are empty; files outside src, public, mirror and the two JSON files count for nothing.
    """
    path, text = F.col("path"), F.coalesce("text", F.lit(""))
    source, engine = path.rlike(SOURCE_FILE), path.rlike(SOURCE_FILE) & path.rlike(ENGINE_FILE)
    bootstrap = classify.script_class(path, F.when(F.endswith(F.lower(path), F.lit(".mjs")), "module").otherwise("text/javascript")) == "business-bootstrap"
    captured = path.rlike(MIRROR_FILE) & bootstrap
    said = F.from_json(text, "summary struct<canvas: long, workers: long>")["summary"]
    does = F.when(captured, script.behavior(text))
    told = lambda kind: F.coalesce(F.sum(F.size(F.filter(does, lambda e: e["kind"] == kind))), F.lit(0))
    reported = lambda kind: F.coalesce(F.max(F.when(path == "reports/behavior-contracts.json", said[kind])), F.lit(0))
    of = {m: bodies(text, m) for m in METHODS}
    empty = [F.when((F.size(b) > 0) & ~F.exists(b, meaningful), 1).otherwise(0) for m, b in of.items() if m != "snapshot"]
    placeholders = sum(empty[1:], empty[0])
    lacks = F.lit(False)
    for b in of.values():
        lacks = lacks | (F.size(b) == 0)
    named = {
        "package": (path == "package.json") & (F.coalesce(F.from_json(text, "dependencies map<string, string>")["dependencies"][ROUTER_PACKAGE], F.lit("")) != ""),
        "router": source & text.rlike(ROUTER),
        "file_route": source & text.rlike(FILE_ROUTE),
        "injected": source & text.rlike(INJECTED),
        "legacy_marker": source & text.rlike(LEGACY),
        "imperative": source & text.rlike(IMPERATIVE),
        "drawn": source & text.rlike(DRAWN),
        "bundle": path.rlike(PUBLIC_FILE) & bootstrap,
        "captured": captured,
        "engine": engine,
        "incomplete": engine & (lacks | (placeholders > 0)),
        "imported": source & ~engine & text.rlike(IMPORTED),
        "started": source & ~engine & text.rlike(STARTED),
        "destroyed": source & ~engine & text.rlike(DESTROYED),
        "canvas_element": source & ~engine & text.rlike(CANVAS),
        "surface": engine & text.rlike(SURFACE),
        "terminated": engine & text.rlike(TERMINATED),
        "rendered": engine & text.rlike(RENDERED),
    }
    counts = [F.count_if(c).alias(n) for n, c in named.items()]
    placed = F.coalesce(F.sum(F.when(engine, placeholders)), F.lit(0)).alias("placeholders")
    return files.groupBy(by).agg(*counts, placed, *[F.greatest(told(k), reported(k)).alias(k) for k in ("canvas", "workers")])


def rules() -> dict[str, Column]:
    """code: how much of it a project's facts show, 0 where the rule holds; in the order of a report."""
    c = F.col
    needs_engine = (c("canvas") > 0) | (c("workers") > 0) | (c("drawn") > 0)
    mounted = (c("engine") > 0) & (c("imported") > 0) & (c("started") > 0) & (c("destroyed") > 0)
    renders = (c("canvas") == 0) | (c("rendered") > 0)
    one = lambda test: test.cast("long")
    runs = (c("canvas") > 0) | (c("workers") > 0)
    return {
        "tanstack-router-missing": one(~((c("package") > 0) & (c("router") > 0) & (c("file_route") > 0))),
        "dynamic-script-injection": c("injected"),
        "business-bootstrap-bundle": c("bundle"),
        "legacy-adapter-marker": c("legacy_marker"),
        "captured-legacy-script-not-reconstructed": c("legacy"),
        "bootstrap-owned-shell": c("shells"),
        "visible-dom-owned-outside-react": c("imperative") + c("shells"),
        "runtime-engine-present-but-unisolated": one(runs & (c("engine") == 0)),
        "engine-contract-missing": one(needs_engine & ~runs & (c("engine") == 0)),
        "engine-contract-incomplete": c("incomplete"),
        "engine-contract-placeholder": c("placeholders"),
        "engine-contract-unmounted": one(needs_engine & (c("engine") > 0) & ~mounted),
        "runtime-canvas-surface-missing": one((c("canvas") > 0) & ~((c("canvas_element") > 0) & (c("surface") > 0))),
        "runtime-worker-cleanup-missing": one((c("workers") > 0) & (c("terminated") == 0)),
        "engine-runtime-placeholder": one(needs_engine & (c("engine") > 0) & ~renders),
        "captured-bootstrap-replacement-unproven": one((c("captured") > 0) & ~renders),
    }


def known(files: DataFrame, legacy: DataFrame, by: str) -> DataFrame:
    """The facts, with legacy (captured scripts) and shells (those whose route's source shows nothing). legacy: `by`, visible (elements that the source reaches; null: the route has no source)."""
    owed = legacy.groupBy(by).agg(F.count("*").alias("legacy"), F.count_if(F.col("visible") == 0).alias("shells"))
    both = facts(files, by).unionByName(owed, allowMissingColumns=True)
    return both.groupBy(by).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in both.columns if n != by])


def findings(files: DataFrame, legacy: DataFrame, by: str = "project") -> DataFrame:
    """`by`, code, n: the rules that each project breaks and how often. A project with legacy scripts and no file is held to all rules; a null project is one."""
    each = F.array(*[F.struct(F.lit(code).alias("code"), n.cast("long").alias("n")) for code, n in rules().items()])
    return known(files, legacy, by).select(by, F.explode(F.filter(each, lambda f: f["n"] > 0)).alias("f")).select(by, "f.code", "f.n")


def gate(files: DataFrame, legacy: DataFrame, by: str = "project") -> DataFrame:
    """`by`, findings, passed: one row for each project."""
    broken = [F.when(n > 0, 1).otherwise(0) for n in rules().values()]
    return known(files, legacy, by).select(by, sum(broken[1:], broken[0]).cast("long").alias("findings")).withColumn("passed", F.col("findings") == 0)
