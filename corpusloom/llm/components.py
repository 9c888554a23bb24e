"""Connected components by alternating large and small stars, with lineage cut each round. Nothing comes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import dropped, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges u, v in both directions for a large star; u > v for a small one."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = out.where("u <> v")
    return out.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u: then v is the smallest of its component."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("root")))))
    return not ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root")).agg(F.max((F.col("up") + F.col("root") > 1) & (F.col("up") > 0))).first()[0]


def forest(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """u, v (the smallest id reachable) for every id u with an edge to another one, but the smallest ids themselves; written.

    Edges may repeat, point either way or to themselves; null ends are dropped. Each round halves paths; it ends when
    all edges are stars, and raises if that takes over `rounds`, which no graph of under 2 to that power needs.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    edges = written(edges, "components")
    for _ in range(rounds):
        if _stars(edges):
            return edges
        before, edges = edges, written(_star(_star(edges, large=True), large=False), "components")
        dropped(before)
    raise RuntimeError("components did not settle")


def with_roots(stars: DataFrame) -> DataFrame:
    """id, component of a forest's stars, the smallest ids among them."""
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """id, component (the smallest id reachable) for every id that has an edge to another one."""
    return with_roots(forest(edges, a, b, rounds))
