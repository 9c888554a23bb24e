import random

import pytest

from corpusloom.operators import naming


def in_turn(rows):
    used, out = set(), {}
    for at, base in sorted(rows):
        if base is None:
            out[at] = None
            continue
        name, n = base, 2
        while name in used:
            name, n = f"{base}{n}", n + 1
        used.add(name)
        out[at] = name
    return out


def named(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x") for r in rows], "at long, base string, unique_to_us string").repartition(3)
    out = naming.unique_names(df, "base", "at", **more)
    assert out.columns == ["at", "base", "unique_to_us", "unique"]
    return {r.at: r.unique for r in out.collect()}


def test_as_if_named_in_turn(spark, monkeypatch):
    monkeypatch.setattr(naming, "BLOCK", 4)  # names that lie in several blocks
    rng = random.Random(5)
    rows = list(enumerate(rng.choice(["a", "a", "a", "a2", "a22", "a3", "a1", "b", "b07", None]) for _ in range(90)))
    rng.shuffle(rows)
    assert named(spark, rows) == in_turn(rows)


def test_small_cases(spark):
    for rows in ([(1, "a"), (2, "a"), (3, "a2")], [(1, "a2"), (2, "a"), (3, "a"), (4, "a2")], [(1, None), (2, None), (3, "7"), (4, "7")]):
        assert named(spark, rows) == in_turn(rows)
    assert named(spark, []) == {}
    with pytest.raises(RuntimeError):
        named(spark, [(1, "a2"), (2, "a3"), (3, "a4"), (4, "a"), (5, "a")], limit=2)


def test_names_that_take_each_others_numbers_over_and_over(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, rng.choice(["a", "a1", "a1", "a1", "a11", "a12", "a10", "a0", "b", "b2\n", "b\n", "é", "é2"])) for i in range(3000)]
    asked = []
    monkeypatch.setattr(naming, "_kept", lambda df, kept=naming._kept: asked.append(df) or kept(df))
    assert named(spark, rows) == in_turn(rows)
    assert len(asked) <= 3  # by rounds, one for each number passed over, there were hundreds


def test_steps_that_are_kept_do_not_nest_their_folders(spark, tmp_path):
    from corpusloom.operators import ordering

    folder = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(folder or str(tmp_path))
    at = spark.sparkContext.getCheckpointDir()
    for _ in range(3):
        ordering._kept(spark.range(3))
    assert spark.sparkContext.getCheckpointDir() == at
