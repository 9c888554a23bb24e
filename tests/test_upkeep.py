import random

from corpusloom.operators import sequences, upkeep
from corpusloom.sources.replacing import current


def test_batches_give_what_all_rows_at_once_give(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice(["x", "x", "y", None])) for i in range(150)]
    df = spark.createDataFrame(rows, "at long, k string, sig string")
    whole = {r.at: (r.consecutive, r.non_convergent) for r in sequences.convergence(df, "k", "sig", ["at"]).collect()}
    got = {}
    for name, lo, hi in (("0", 0, 1), ("1", 1, 3), ("2", 3, 60), ("3", 60, 60), ("4", 60, 150)):
        batch = df.where(f"at >= {lo} and at < {hi}")
        once = {r.at: (r.consecutive, r.non_convergent) for r in upkeep.carry_on(batch, str(tmp_path), name, "k", "sig", ["at"]).collect()}
        state = sorted(map(str, current(spark, f"{tmp_path}/state").collect()))
        again = upkeep.carry_on(batch, str(tmp_path), name, "k", "sig", ["at"])
        assert {r.at: (r.consecutive, r.non_convergent) for r in again.collect()} == once
        assert upkeep.carry_on(batch, str(tmp_path), f"other-{name}", "k", "sig", ["at"]).count() == 0
        assert sorted(map(str, current(spark, f"{tmp_path}/state").collect())) == state
        got |= once
    assert got == whole
