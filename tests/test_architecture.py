from pyspark.sql import functions as F

from corpusloom.operators import architecture

ENGINE = "start() { a() }\nresize(w) { b(w) }\ndispatch: (e) => { c(e) }\nsnapshot() { return; }\ndestroy(): void { w.terminate() }\nx.getContext('2d'); x.fillRect(0)"
APP = "import { e } from './engines/e'\n<RouterProvider/> createFileRoute('/') <canvas/> e.start() e.destroy()"
GOOD = [("package.json", '{"dependencies": {"@tanstack/react-router": "^1"}}'), ("src/app.tsx", APP), ("src/engines/e/index.ts", ENGINE), ("reports/behavior-contracts.json", '{"summary": {"canvas": 2, "workers": 1}}')]


def broken(spark, files, legacy=()):
    rows = spark.createDataFrame([("p", *f) for f in files], "project string, path string, text string")
    scripts = spark.createDataFrame([("p", v) for v in legacy], "project string, visible long")
    found = {r.code: r.n for r in architecture.findings(rows, scripts).collect()}
    gates = architecture.gate(rows, scripts).collect()
    assert [(g.findings, g.passed) for g in gates] == ([(len(found), not found)] if files or legacy else [])
    return found


def test_a_project_that_keeps_every_rule(spark):
    assert broken(spark, GOOD) == {}


def test_engines_that_do_nothing(spark):
    lazy = ENGINE.replace("{ a() }", "{ /* soon */ return; }").replace("resize(w) { b(w) }\n", "")
    assert broken(spark, [*GOOD[:2], ("src/engines/e/index.ts", lazy), GOOD[3]]) == {"engine-contract-incomplete": 1, "engine-contract-placeholder": 1}
    still = ENGINE.replace("x.fillRect(0)", "").replace("w.terminate()", "0")
    assert broken(spark, [*GOOD[:2], ("src/engines/e/index.ts", still), GOOD[3]]) == {"runtime-worker-cleanup-missing": 1, "engine-runtime-placeholder": 1}


def test_captured_scripts(spark):
    files = [*GOOD[:2], ("mirror/a/main.js", "new Worker('x'); c.getContext('2d')"), ("public/main.mjs", None)]
    assert broken(spark, files, [0, 5, None]) == {"business-bootstrap-bundle": 1, "captured-legacy-script-not-reconstructed": 3, "bootstrap-owned-shell": 1, "visible-dom-owned-outside-react": 1, "runtime-engine-present-but-unisolated": 1, "runtime-canvas-surface-missing": 1, "runtime-worker-cleanup-missing": 1, "captured-bootstrap-replacement-unproven": 1}


def test_empty_and_null(spark):
    assert broken(spark, []) == {}
    assert broken(spark, [("src/a.ts", None), (None, "<canvas>")]) == {"tanstack-router-missing": 1}
    rows = spark.createDataFrame([(None, "src/a.ts", "legacyScripts"), (None, "src/b.ts", "legacyScripts")], "project string, path string, text string")
    found = architecture.findings(rows, spark.createDataFrame([(None, 0)], "project string, visible long")).where(F.col("project").isNull()).collect()
    assert {r.code: r.n for r in found}["legacy-adapter-marker"] == 2 and len(found) == len({r.code for r in found})
