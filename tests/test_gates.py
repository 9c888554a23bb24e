import json

from pyspark.sql import functions as F

from corpusloom.operators import conversion, delivery, gates, provenance, reports


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def files(spark, *pairs, columns="path string, sha256 string"):
    return spark.createDataFrame(list(pairs), columns)


def walked(v):
    if isinstance(v, str):
        yield v
    elif isinstance(v, dict):
        for x in v.values():
            yield from walked(x)
    elif isinstance(v, list):
        for x in v:
            yield from walked(x)


def test_strings_of_any_depth_in_one_pass(spark):
    deep = "bottom"
    for i in range(400):
        deep = {"k:": [deep, '":']} if i % 2 else [i, deep]
    odd = {'a"': 'x"y', "b\\": "c\\", "": "", "t": "\x01\x02\n\t é😀", "n": None, "s": [['\\"', "\\\\", ":", '"', '":"', "], [", '","']]}
    given = [(1, json.dumps(deep)), (2, json.dumps(odd)), (3, '"top"'), (4, "no json"), (5, "{}"), (6, None), (7, "[1, true, null]"), (8, json.dumps(["q" * 300_000, '"\\' * 50_000]))]
    found = reports.deep_strings(spark.createDataFrame(given, "id int, raw string"), "id", "raw")
    want = [(i, t) for i, raw in given if raw and raw != "no json" for t in walked(json.loads(raw))]
    assert rows(found) == sorted(want, key=repr)


def test_baseline(spark):
    base = files(spark, ("src/a.css", "1"), ("src/b.css", "2"), ("src/c.CSS", "3"), ("src/x.ts", "9"))
    now = files(spark, ("src/a.css", "1"), ("src/b.css", "0"), ("src/d.css", "4"), ("src/x.ts", "8"))
    assert rows(gates.baseline_findings(now, base)) == [("src/b.css", "modified"), ("src/c.CSS", "missing"), ("src/d.css", "untracked")]
    assert rows(gates.baseline_gate(now, base)) == [(3, 1, 1, 1, False, False)]
    assert rows(gates.baseline_gate(base, base)) == [(3, 0, 0, 0, False, True)]
    assert rows(gates.baseline_gate(now, base.limit(0))) == [(3, 0, 3, 0, True, False)]
    assert rows(gates.baseline_gate(base.limit(0), base.limit(0))) == [(0, 0, 0, 0, True, False)]


def test_changes_of_a_run(spark):
    start = files(spark, ("react/src/a.ts", "1"), ("react/reports/proof-profile.json", "1"), ("react/reports/x.json", "1"), ("react/src/node_modules/m", "1"), ("other", "1"), ("react/package.json", "1"))
    end = files(spark, ("react/src/a.ts", "2"), ("react/reports/proof-profile.json", "2"), ("react/reports/x.json", "2"), ("react/src/node_modules/m", "2"), ("other", "2"), ("react/public/new.png", "1"))
    within = [("react/package.json", "pipeline", "removed", False), ("react/public/new.png", "pipeline", "added", False), ("react/reports/proof-profile.json", "pipeline", "modified", False), ("react/reports/x.json", "pipeline", "modified", True), ("react/src/a.ts", "pipeline", "modified", False)]
    assert rows(gates.run_changes(start.limit(0), start, end)) == within
    before = files(spark, ("other", "0"))
    outside = [(p, "outside", "added", False) for p in ("react/package.json", "react/reports/proof-profile.json", "react/reports/x.json", "react/src/a.ts")]
    assert rows(gates.run_changes(before, start, end)) == sorted(within + outside, key=repr)
    assert ("other", "pipeline", "modified", False) in rows(gates.run_changes(before, start, end, own=("other",)))


def test_a_group_without_a_name_is_a_group(spark):
    cols = "run string, path string, sha256 string"
    start, end = files(spark, (None, "react/src/a", "1"), ("r", "react/src/a", "1"), columns=cols), files(spark, (None, "react/src/a", "2"), ("r", "react/src/a", "1"), columns=cols)
    before = files(spark, (None, "react/src/b", "1"), columns=cols)
    assert rows(gates.run_changes(before, start, end, ["run"])) == [(None, "react/src/a", "outside", "added", False), (None, "react/src/a", "pipeline", "modified", False), (None, "react/src/b", "outside", "removed", False)]


def test_delivered_files(spark):
    site = files(spark, ("a.png", "1"), ("b.png", "2"), ("c.js", "3"))
    mirror = files(spark, ("cdn/x.png", "4"), ("cdn/y.png", "5"))
    out = files(spark, ("a.png", "1"), ("b.png", "0"), ("c.js", "0"), ("_external/cdn/x.png", "4"), ("_external/cdn/y.png", "0"), ("cdn/x.png", "4"), ("made.png", "7"), ("new.png", "8"), ("legacy/z.js", "9"))
    said = files(spark, ("made.png",), columns="path string")
    bad = {(p, f) for p, f in rows(gates.public_findings(out, site, mirror, said)) if f}
    assert bad == {("b.png", "mismatched"), ("_external/cdn/y.png", "mismatched"), ("cdn/x.png", "uncaptured"), ("new.png", "uncaptured")}
    assert rows(gates.public_gate(out, site, mirror, said)) == [(8, 2, 2, False)]
    assert rows(gates.public_gate(site, site, mirror.limit(0), said)) == [(3, 0, 0, True)]


def test_oracle(spark):
    captured, own = files(spark, ("x", "1"), ("y", "2"), ("z", "2")), files(spark, ("b", "2"), ("a", "1"))
    gate = gates.oracle_gate(own, captured)
    n, unknown, passed, integrity = gate.first()
    assert (n, unknown, passed, len(integrity)) == (2, 0, True, 64)
    assert rows(gates.oracle_holds(gate, own.orderBy("path"))) == [(True,)]
    assert rows(gates.oracle_holds(gate, files(spark, ("b", "2"), ("a", "3")))) == rows(gates.oracle_holds(gate, own.limit(0))) == [(False,)]
    assert gates.oracle_gate(files(spark, ("a", "9")), captured).first()[:3] == (1, 1, False)
    assert gates.oracle_gate(own.limit(0), captured).first()[:3] == (0, 0, False)


def test_authorization(spark):
    public = files(spark, ("a", "vendor/x.js", "1"), ("a", "p.png", "2"), ("b", "vendors/y", "3"), (None, "third-party/z", "4"), ("c", "brand/logo.svg", "5"), columns="site string, path string, sha256 string")
    site = files(spark, ("a", "LICENSE"), ("b", "licensed.js"), (None, "lib/z.license.txt"), ("d", "x"), columns="site string, path string")
    assert {(r.site, r.path): r.status for r in provenance.authorization_items(public, site, "site").collect()} == {("a", "vendor/x.js"): "covered", ("a", "p.png"): "unverified", ("b", "vendors/y"): "unverified", (None, "third-party/z"): "covered", ("c", "brand/logo.svg"): "restricted"}
    want = [("a", 2, 0, 1, 1, 1, "unverified"), ("b", 1, 0, 1, 0, 0, "unverified"), (None, 1, 0, 0, 1, 1, "covered"), ("c", 1, 1, 0, 0, 0, "restricted"), ("d", 0, 0, 0, 0, 0, "covered")]
    assert rows(provenance.authorization_manifest(public, site, "site")) == sorted(want, key=repr)


def test_conversion(spark):
    page = "<html lang=en><head><title>{}</title>{}</head><body>{}</body></html>"
    given = [
        (1, "about/index.html", page.format("About", "", "<h1> Us </h1>")), (2, "about.html", page.format("Other", "", "")), (3, "a-bout.html", page.format("Third", "", "")), (4, "index.html", page.format("Home", "", "")),
        (5, "gone.html", page.format("Oops", "", "404 Not Found")), (6, "data.html", '{"a": 1}'), (7, "hts-cache/x.html", page.format("x", "", "")), (8, "__embeds/y.html", page.format("y", "", "")), (9, "pic.png", "x"),
        (10, "errors.html", page.format("Error", "<link rel=canonical href=/errors/>", "")), (11, "moved.html", page.format("Error", "<link rel=canonical href=https://far.example/moved2>", "")), (12, "lost.html", page.format("Error", "<link rel=canonical href=https://own.example/error>", "")), (13, "none.html", None), (14, "A/bout.html", page.format("Fourth", "", "")),
    ]
    got = conversion.converted(spark.createDataFrame(given, "id int, path string, html string"), F.lit("own.example"))
    told = {r.id: (r.outcome, r.name or r.selected, r.heading) for r in got.collect()}
    assert told == {
        1: ("page", "AboutPage", "Us"), 2: ("alternative", "about/index.html", None), 3: ("page", "ABoutPage2", "Third"), 4: ("page", "HomePage", "Home"), 5: ("error-page", None, None), 6: ("no-page", None, None),
        10: ("page", "ErrorsPage", "Error"), 11: ("page", "MovedPage", "Error"), 12: ("error-page", None, None), 13: ("no-page", None, None), 14: ("page", "ABoutPage", "Fourth"),
    }
    assert rows(conversion.manifest(got)) == [(6, 1, 2, 2, 1, True)]
    assert rows(conversion.manifest(conversion.converted(spark.createDataFrame([], "id int, path string, html string")))) == [(0, 0, 0, 0, 0, False)]


def test_delivery(spark):
    df = spark.createDataFrame
    projects = df([(i,) for i in range(4)], "project int")
    contracts = df([(0, True, "f", True, ["desktop", "mobile"], 1), (1, None, None, True, ["desktop"], 0)], "project int, locked boolean, fingerprint string, dynamic boolean, environments array<string>, scenarios int")
    summaries = df([(0, True, "f"), (1, True, "g"), (2, None, None)], "project int, passed boolean, fingerprint string")
    shot = {"source": ("a", True), "local": ("b", True)}
    scenarios = df(
        [(0, "s", True, 0, True, 0.0, shot), (0, "t", True, None, True, 0.1, shot), (1, None, False, 0, None, float("nan"), {"source": ("", None)}), (9, "u", False, 1, True, 0.0, None)],
        "project int, id string, passed boolean, findings int, dimensions_match boolean, mismatch double, captures map<string,struct<screenshot:string,evidence:boolean>>",
    )
    proof = delivery.proof_findings(projects, contracts, summaries, scenarios, df([("a",), ("b",)], "path string"))
    of = lambda t, i: sorted(c for p, c in rows(t) if p == i)
    assert of(proof, 0) == of(proof, 9) == []
    assert of(proof, 1) == sorted(
        ["thresholds-unlocked", "threshold-fingerprint-mismatch", "dynamic-environment-coverage-incomplete", "scenario-coverage-incomplete", "scenario-failed:unknown", "image-evidence-incomplete:unknown"]
        + [f"{k}:unknown:{s}" for k in ("screenshot-missing", "capture-evidence-incomplete") for s in ("source", "local")]
    )
    assert of(proof, 2) == ["contract-missing-or-invalid", "scenario-coverage-incomplete", "summary-not-passed", "thresholds-unlocked"]
    assert of(proof, 3) == ["contract-missing-or-invalid", "scenario-coverage-incomplete", "summary-missing-or-invalid", "summary-not-passed", "thresholds-unlocked"]
    schema = "project int, passed boolean, commands array<int>, routes array<struct<status:int,content_type:string>>, preview string"
    ok = [(200, "text/html")]
    again = delivery.reproducibility_findings(projects, df([(0, True, [0, 0], ok, "http://localhost:1/"), (1, None, None, None, None), (2, True, [0, None], [(200, None)], "http://far.example")], schema))
    assert of(again, 0) == [] and of(again, 3) == ["report-missing"]
    assert of(again, 1) == ["commands-incomplete", "preview-url-invalid", "report-not-passed", "route-probes-incomplete"]
    assert of(again, 2) == ["commands-incomplete", "preview-not-loopback", "route-probes-incomplete"]
    said = df([(0, "PARITY_PROOF", 0, 1), (1, "PARITY_PROOF", 3, 1), (2, "BUILD", 9, 9)], "project int, stage string, consecutive int, attempts int")
    past = df([(0, "PARITY_PROOF", "failed"), (0, "PARITY_PROOF", "interrupted"), (1, "PARITY_PROOF", "passed")], "project int, stage string, event string")
    failures = delivery.repeated_failures(said, past)
    assert rows(failures) == [(0, 2), (1, 3)]
    nobody, first = projects.limit(0), projects.where("project = 0")
    assert rows(delivery.delivery_gate(projects, proof, again, failures, first, first))[0] == (0, True, True, True, True, True)
    assert rows(delivery.delivery_gate(first, proof, again, failures, nobody, first)) == [(0, False, True, False, True, False)]
    assert rows(delivery.delivery_gate(first, proof, again, failures, first, nobody)) == [(0, True, True, True, False, False)]
