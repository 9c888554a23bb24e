"""Operators on small inputs: a clean and a defective one each."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import comparison, inventory, links, lookups, provenance, sequences
from corpusloom.sources import tables
from corpusloom.streaming import trace


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_snapshot_diff(spark):
    b = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    a = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, sha256 string")
    assert rows(inventory.snapshot_diff(b, b)) == []
    assert rows(inventory.snapshot_diff(b, a)) == [("b", "modified"), ("c", "removed"), ("d", "added")]
    assert rows(inventory.mismatched(a, b)) == [("b", "9", "2")]
    assert rows(inventory.uncaptured(a, b)) == [("d", "4")]


def test_forbidden_edits(spark):
    e = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    assert rows(inventory.forbidden_edits(e, ("a",))) == [("b",), ("c",)]


def test_three_equal_failures_do_not_converge(spark):
    h = spark.createDataFrame([("s", 1, "x"), ("s", 2, "x"), ("s", 3, "x"), ("t", 1, "x"), ("t", 2, "y"), ("t", 3, "x")], "stage string, n int, sig string")
    got = rows(sequences.convergence(h, "stage", "sig", ["n"]).select("stage", "n", "consecutive", "non_convergent"))
    assert got == [("s", 1, 1, False), ("s", 2, 2, True), ("s", 3, 3, True), ("t", 1, 1, False), ("t", 2, 1, False), ("t", 3, 1, True)]


def test_prefix_suffix_and_latest(spark):
    s = spark.createDataFrame([("r", 0, "a", True), ("r", 1, "b", True), ("r", 2, "c", False), ("r", 3, "d", True)], "run string, ord int, stage string, done boolean")
    assert [r.ord for r in sequences.valid_prefix(s, "run").orderBy("ord").collect()] == [0, 1]
    assert [r.ord for r in sequences.invalidated_from(s, "run", "c").orderBy("ord").collect()] == [2, 3]
    deep = spark.createDataFrame([("r", 3, 1, "failed"), ("r", 1, 9, "passed")], "run string, depth int, at int, status string")
    assert sequences.latest(deep, "run", ["depth", "at"], "status").first().status == "failed"


def test_repair_guardrails(spark):
    h = spark.createDataFrame([("f", "s", "g", False, 1), ("f", "s", "g", True, 2), ("f", "o", "g", True, 3)], "finding string, strategy string, signature string, passed boolean, at int")
    assert rows(sequences.repair_guardrails(h, ["at"]).select("at", "attempt", "repeated")) == [(1, 1, False), (2, 2, True), (3, 3, False)]


def test_bracketed(spark):
    a = spark.createDataFrame([("e", 0, "checkpoint"), ("e", 1, "wheel"), ("e", 2, "wait"), ("e", 3, "checkpoint"), ("e", 4, "click")], "env string, ord int, kind string")
    got = {r.ord: r.bracketed for r in sequences.bracketed(a, "env", "ord").collect()}
    assert got[1] and not got[4]


def test_rules(spark):
    rules = spark.createDataFrame([(0, "/join", None, ["POST"], 200, None), (1, None, "/coll", [], 204, None)], "ord int, match string, prefix string, methods array<string>, status int, json string")
    q = spark.createDataFrame([(1, "/join", "POST"), (2, "/collect", "POST"), (3, "/join", "GET")], "id int, path string, method string")
    assert rows(comparison.first_rule(q, rules).select("id", "status")) == [(1, 200), (2, 204), (3, 503)]


def test_geometry_is_one_way(spark):
    s = spark.createDataFrame([("a", 0.0, 0.0, 5.0, 5.0), ("b", 0.0, 0.0, 1.0, 1.0)], "key string, x double, y double, width double, height double")
    other = spark.createDataFrame([("a", 0.0, 3.0, 5.0, 5.5), ("z", 0.0, 0.0, 1.0, 1.0)], s.schema)
    assert rows(comparison.geometry_failures(s, s, 1.0)) == []
    got = rows(comparison.geometry_failures(s, other, 1.0).select("key", "property"))
    assert got == [("a", "y"), ("b", "height"), ("b", "width"), ("b", "x"), ("b", "y")]


def test_nearest_frames_and_seed(spark):
    left = spark.createDataFrame([(1, [0.0, 0.0]), (2, [4.0, 4.0])], "id int, frame array<double>")
    right = spark.createDataFrame([(7, [4.0, 5.0]), (8, [9.0, 9.0])], "id int, frame array<double>")
    assert rows(comparison.nearest_frames(left, right)) == [(2, 7, 0.5)]
    assert spark.range(1).select(comparison.seed_of(1597463007, F.lit("home"))).first()[0] == 3758895604


def test_reachability(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "source string, target string")
    assert rows(links.reachable(e, spark.createDataFrame([("a",)], "node string"))) == [("a", 0), ("b", 1), ("c", 2)]


def test_provenance(spark):
    p = spark.createDataFrame([(1, "Original  headline"), (2, "one two three four five six"), (3, "Invented cocktail"), (4, None)], "item_id int, text string")
    d = spark.createDataFrame([(9, "the ORIGINAL headline"), (8, "someone two three four five sixty"), (7, None)], "doc_id int, text string")
    assert rows(provenance.supported_pairs(p, d)) == [(1, 9), (2, 8)]
    assert rows(provenance.unsupported(p, d)) == [(3,), (4,)]


def test_precedence(spark):
    s = spark.createDataFrame([("a", "covered"), ("a", "unverified"), ("b", "covered"), ("c", "restricted"), ("c", "unverified")], "source string, status string")
    assert rows(provenance.precedence(s, "source")) == [("a", "unverified"), ("b", "covered"), ("c", "restricted")]


def test_file_tree(spark, tmp_path):
    (tmp_path / "m/a").mkdir(parents=True)
    (tmp_path / "m/index.html").write_text("<!doctype html>")
    (tmp_path / "m/a/x.js").write_text("1")
    assert rows(tables.file_tree(spark, str(tmp_path / "m")).select("path", "bytes")) == [("a/x.js", 1), ("index.html", 15)]
    assert rows(tables.file_tree(spark, str(tmp_path / "m"), (".js",)).select("path")) == [("a/x.js",)]
    (tmp_path / "m/l").symlink_to(tmp_path)
    with pytest.raises(ValueError, match="symbolic"):
        tables.file_tree(spark, str(tmp_path / "m"))


def test_hints_and_reports(spark, tmp_path):
    (tmp_path / "h.txt").write_text("# c\n a/b.png \n\nc.js\n")
    assert rows(tables.hints(spark, str(tmp_path / "h.txt"))) == [("a/b.png",), ("c.js",)]
    (tmp_path / "bad.json").write_text("{nope")
    assert tables.json_report(spark, str(tmp_path / "bad.json"), "passed boolean").first().passed is None
    assert tables.site_root(["fixture.example/index.html", "a/index.html"], "https://fixture.example/") == "fixture.example"


def test_trace_appends_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / f"in/{i}.json").write_text(f'{{"stage":"s{i}"}}\n')
        trace.append(trace.follow(spark, str(tmp_path / "in"), "stage string"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [("s0",), ("s1",)]


def test_reachable_goes_on_until_nothing_is_new(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(5)], "source int, target int")
    start = spark.createDataFrame([(0,)], "node int")
    assert rows(links.reachable(edges, start)) == [(i, i) for i in range(6)]
    assert rows(links.discovered(edges, start, 2)) == [(0, 0), (1, 1), (2, 2)]
    with pytest.raises(RuntimeError):
        links.reachable(edges, start, limit=3)


def test_unknown_keys_are_an_error(spark):
    known = spark.createDataFrame([("a", 1)], "key string, rank int")
    assert rows(lookups.joined_known(spark.createDataFrame([("a",)], "key string"), known, "key")) == [("a", 1)]
    with pytest.raises(ValueError, match="unknown key: b"):
        lookups.joined_known(spark.createDataFrame([("a",), ("b",)], "key string"), known, "key")


def test_rules_and_frames_must_be_few(spark, monkeypatch):
    monkeypatch.setattr(comparison, "SENDABLE", 1)
    frames = spark.createDataFrame([(1, [1.0]), (2, [3.0])], "id int, frame array<double>")
    with pytest.raises(ValueError):
        comparison.nearest_frames(frames, frames)


def test_containment_agrees_with_a_plain_search(spark):
    texts = [(1, "One two  three four five six"), (2, "a b c"), (3, "xa b cy"), (4, "nothing here"), (5, None), (6, "one two")]
    phrases = [(10, "two three four five six"), (11, "a b c"), (12, "One"), (13, ""), (14, "b"), (15, "two three four"), (16, "wo three fou"), (17, None)]
    got = rows(provenance.supported_pairs(spark.createDataFrame(phrases, "item_id int, text string"), spark.createDataFrame(texts, "doc_id int, text string")))
    plain = lambda t: " ".join((t or "").lower().split())
    assert got == sorted((i, d) for i, p in phrases for d, t in texts if plain(p) and t is not None and plain(p) in plain(t))


def test_captures_and_reports(spark, tmp_path):
    files = spark.createDataFrame([("a.html",), ("hts-cache/x",), ("hts-log.txt",), ("b/.DS_Store",)], "path string")
    assert rows(tables.captured(files)) == [("a.html",)]
    tables.write_report(files, str(tmp_path / "report"))
    tables.write_report(files.limit(1), str(tmp_path / "report"))
    assert rows(spark.read.schema("path string").json(str(tmp_path / "report"))) == [("a.html",)]


def test_many_matches_keep_their_places(spark):
    text = "ab-" * 1000
    got = spark.createDataFrame([(text,)], "t string").select(X.placed(F.col("t"), "b").alias("p")).first().p
    assert [r.start for r in got] == list(range(1, 3000, 3))
