import random

from corpusloom.operators import repairs

SHAPE = "h string, at long, code string, strategy string, signature string, result string, test string, action string, files array<string>"


def plain(rows, classes):
    """One history after the other, one proposal after the other."""
    refused, kept = {}, {}
    for h in {r[0] for r in rows}:
        history = []
        for r in sorted((r for r in rows if r[0] == h), key=lambda r: r[1]):
            _, at, code, strategy, signature, result, test, action, files = r
            key = (classes[at], strategy)
            if any(k == key and res == "failed" for k, _, res in history):
                refused[at] = "repeated"
            elif result == "passed" and not (test or "").strip():
                refused[at] = "untested"
            elif not (action or "").strip():
                refused[at] = "no-action"
            elif files and all(f.replace("\\", "/").startswith(repairs.REPORTS) or f == "run.json" or f.endswith("/run.json") for f in files):
                refused[at] = "report-only"
            else:
                kept[at] = (sum(s == signature for _, s, _ in history) + 1, history[-1][1] if history else None, result == "passed")
                history.append((key, signature, result))
    return refused, kept


def test_as_one_after_the_other(spark):
    rng = random.Random(9)
    choice = rng.choice
    rows = [
        (choice(["x", "y", None]), i, choice(["route-a", "layout", "geometry", None]), choice(["s", "t", None]), choice(["1", "2", None]), choice(["passed", "passed", "passed", "failed"]), choice(["t", "t", " ", None]), choice(["a", "a", "a", ""]), choice([["src/a"], [], None, ["reports/a"], ["proof\\b", "c/run.json"], ["run.json", "src/b"]]))
        for i in range(120)
    ]
    df = spark.createDataFrame(rows, SHAPE).repartition(3)
    found = repairs.judged(df, "h", ["at"], ("run.json",)).collect()
    refused, kept = plain(rows, {r.at: r.classification for r in found})
    assert len(found) == len(rows) and {r.at: r.refused for r in found if r.refused} == refused
    assert {r.classification for r in found} == {"route", "layout", "behavior"} and set(refused.values()) == {"repeated", "untested", "no-action", "report-only"}
    assert {r.at: (r.attempt, r.previous_signature, r.converged) for r in repairs.recorded(df, "h", ["at"], ("run.json",)).collect()} == kept


def test_no_proposals(spark):
    assert repairs.recorded(spark.createDataFrame([], SHAPE), "h", ["at"]).count() == 0
