"""Comparison within tolerances: vectors, frames, geometry, coverage, ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vector_mean(df: DataFrame, by: str, vector: str, digits: int = 4) -> DataFrame:
    """by, pos, mean of each position, in doubles."""
    parts = df.select(by, F.posexplode(vector).alias("pos", "v"))
    return parts.groupBy(by, "pos").agg((F.round(F.avg(F.col("v").cast("double")), digits) + F.lit(0.0)).alias("mean"))


def variation(vector: str) -> Column:
    """The share of elements that differ from the first."""
    v = F.col(vector)
    return F.size(F.filter(v, lambda x: x != F.get(v, F.lit(0)))) / F.size(v)


#: Frames or rules that may be broadcast.
SENDABLE = 10_000


def _sendable(df: DataFrame) -> DataFrame:
    """df, which meets all rows of another table by no key, checked to be small."""
    if (n := df.count()) > SENDABLE:
        raise ValueError(f"{n} rows, {SENDABLE} at most, may meet a whole table")
    return F.broadcast(df)


def nearest_frames(left: DataFrame, right: DataFrame, digits: int = 6, ascending: bool = False) -> DataFrame:
    """The pair of frames (id, frame) with the least mean absolute difference; SENDABLE frames on the right at most. ascending: only pairs whose left id is less."""
    r = right.select(F.col("id").alias("right_id"), F.col("frame").alias("other"))
    d = F.aggregate(F.zip_with("frame", "other", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda a, x: a + x) / F.size("frame")
    on = (F.col("left_id") < F.col("right_id")) if ascending else F.lit(True)
    pairs = left.select(F.col("id").alias("left_id"), "frame").join(_sendable(r), on).select("left_id", "right_id", F.round(d, digits).alias("distance"))
    return pairs.agg(F.min(F.struct("distance", "left_id", "right_id")).alias("m")).select("m.left_id", "m.right_id", "m.distance")


def geometry_failures(source: DataFrame, local: DataFrame, tolerance: float) -> DataFrame:
    """key, property, delta: of boxes x, y, width, height those that are missing or off by more than the tolerance; one way, from source to local."""
    sides = ("x", "y", "width", "height")
    both = source.join(local.select("key", *[F.col(s).alias(f"l_{s}") for s in sides]), "key", "left")
    each = both.select("key", F.explode(F.array(*[F.struct(F.lit(s).alias("property"), F.abs(F.col(s).cast("double") - F.col(f"l_{s}").cast("double")).alias("delta")) for s in sides])).alias("p"))
    return each.select("key", "p.*").where(F.col("delta").isNull() | (F.col("delta") > tolerance))


def first_rule(requests: DataFrame, rules: DataFrame, default: int = 503) -> DataFrame:
    """requests (id, path[, method]) with the status of the first rule (by ord) that matches exactly or by prefix; SENDABLE rules at most."""
    r = _sendable(rules.select("ord", "match", "prefix", "methods", F.col("status").alias("rule_status")))
    hit = (F.col("path") == F.col("match")) | F.startswith(F.col("path"), F.col("prefix"))
    allowed = F.col("methods").isNull() | (F.size("methods") == 0) | F.array_contains("methods", F.col("method"))
    found = requests.join(r, hit & allowed, "left").groupBy("id", "path").agg(F.min_by("rule_status", "ord").alias("status"))
    return found.withColumn("status", F.coalesce("status", F.lit(default)))


def uncovered(required: list[str], covered: DataFrame, by: str, item: str) -> DataFrame:
    """by, item: required items that a group lacks; covered: rows of (by, item or null)."""
    has = covered.groupBy(by).agg(F.collect_set(item).alias("has"))
    return has.select(by, F.explode(F.array_except(F.array(*[F.lit(x) for x in required]), "has")).alias(item))


def seed_of(base: int, key: Column) -> Column:
    """A 32-bit multiplicative hash of a key."""
    return F.aggregate(F.transform(F.filter(F.split(key, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint")), F.lit(base).cast("bigint"), lambda a, c: (a.bitwiseXOR(c) * 16777619).bitwiseAND(4294967295))
