import pytest
from pyspark.sql import functions as F

from corpusloom.operators import discovery
from corpusloom.sources import replacing

LINKS = {"a": ["b", "c", "gone"], "b": ["a", "d"], "c": [], "d": ["e"], "e": ["f"], "f": ["g"], "z": ["y"]}


def found(spark, folder, rounds=6, files=None, starts=("a",)):
    files = files if files is not None else spark.createDataFrame([(k, v) for k, vs in LINKS.items() for v in (vs or [None])], "key string, content string")
    names = lambda rows: rows.select(F.col("content").alias("key"))
    out = discovery.discover(files, spark.createDataFrame([(s,) for s in starts], "key string"), names, str(folder), rounds)
    return {(r["key"], r["round"], r["outcome"]) for r in out.collect()}


def test_rounds(spark, tmp_path):
    want = {("a", 0, "fetched"), ("b", 1, "fetched"), ("c", 1, "fetched"), ("gone", 1, "missing"), ("d", 2, "fetched"), ("e", 3, "fetched"), ("f", 4, "fetched"), ("g", 5, "missing")}
    assert found(spark, tmp_path / "all") == want
    assert found(spark, tmp_path / "two", rounds=2) == {w for w in want if w[1] < 2}
    # a rerun takes whole rounds as they stand and goes on behind them
    assert found(spark, tmp_path / "two") == want
    assert found(spark, tmp_path / "none", starts=("q",)) == {("q", 0, "missing")}
    assert found(spark, tmp_path / "null", starts=(None, "c", "c")) == {("c", 0, "fetched")}


def test_plans_stay_short(spark, tmp_path):
    chain = spark.range(30).select(F.col("id").cast("string").alias("key"), (F.col("id") + 1).cast("string").alias("content"))
    names = lambda rows: rows.select(F.col("content").alias("key"))
    out = discovery.discover(chain, spark.createDataFrame([("20",)], "key string"), names, str(tmp_path), rounds=50)
    assert out.count() == 11
    assert out._jdf.queryExecution().executedPlan().toString().count("Join") == 0


def test_replacing(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    with pytest.raises(ValueError, match="no table"):
        replacing.current(spark, root)
    first = replacing.replace(spark.range(5), root)
    old = replacing.current(spark, root)
    assert replacing.version(spark, root) == first and old.count() == 5
    # a failing task, or nothing to write, leaves the old rows
    bad = spark.range(100).select(F.when(F.col("id") == 99, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        replacing.replace(bad, root)
    with pytest.raises(ValueError, match="0 rows"):
        replacing.replace(spark.range(0), root)
    assert replacing.version(spark, root) == first and replacing.current(spark, root).count() == 5
    # who reads the old version goes on reading it; a table may be made of itself
    replacing.replace(replacing.current(spark, root).union(spark.range(2)), root)
    assert replacing.current(spark, root).count() == 7 and old.count() == 5
    for n in (1, 2, 3):
        replacing.replace(spark.range(n), root)
    assert replacing.current(spark, root).count() == 3
    kept = [p.name for p in (tmp_path / "t").iterdir()]
    assert len([k for k in kept if k.startswith("v-")]) == 2 and len([k for k in kept if k.startswith("current")]) == 1
    assert replacing.replace(spark.range(0), root, least=0) and replacing.current(spark, root).count() == 0
