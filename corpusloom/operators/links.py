"""Links of captured pages: extraction, resolution, what is missing, routes, reachability, fixpoint discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import url as U

ATTRIBUTE = r"(?:src|href|poster|data)=[\"']([^\"']*)[\"']"
CSS_URL = r"(?i)url\(\s*[\"']?([^\"')\s]+)[\"']?\s*\)"


def references(pages: DataFrame) -> DataFrame:
    """page_id, host, raw: every reference in an attribute of a page."""
    return pages.select("page_id", U.host(F.col("url")).alias("host"), F.explode(F.regexp_extract_all("html", F.lit(ATTRIBUTE), F.lit(1))).alias("raw"))


def missing_links(pages: DataFrame) -> DataFrame:
    """host, path: rooted links for which the same host has no captured page, each once."""
    wanted = references(pages).where("startswith(raw, '/') and not startswith(raw, '//')").select("host", U.without_query(F.col("raw")).alias("path")).distinct()
    there = pages.select(U.host(F.col("url")).alias("host"), U.path(F.col("url")).alias("path")).distinct()
    return wanted.join(there, ["host", "path"], "left_anti")


def route_key(url: Column) -> Column:
    """Host and path without a trailing slash."""
    p = F.regexp_replace(U.path(url), "(.)/+$", "$1")
    return F.concat(U.host(url), p)


def page_of_route(pages: DataFrame) -> DataFrame:
    """route, page_id, candidates: of the pages of a route an index file, else the first."""
    index = U.path(F.col("url")).rlike(r"(?i)(^|/)index\.html?$")
    rank = F.struct((~index).alias("other"), "page_id")
    return pages.groupBy(route_key(F.col("url")).alias("route")).agg(F.min(rank)["page_id"].alias("page_id"), F.count("*").alias("candidates"))


def _searched(edges: DataFrame, starts: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """node, distance of what `most` rounds reach, and whether more may be left. Lineage is cut each round where there is a checkpoint folder."""
    keep = edges.sparkSession.sparkContext.getCheckpointDir() or edges.sparkSession.conf.get("spark.checkpoint.dir", None)
    if keep and not edges.sparkSession.sparkContext.getCheckpointDir():
        edges.sparkSession.sparkContext.setCheckpointDir(keep)
    seen = starts.select("node").distinct().withColumn("distance", F.lit(0))
    front = seen
    for i in range(1, most + 1):
        step = edges.join(front.select(F.col("node").alias("source")), "source", "left_semi").select(F.col("target").alias("node")).distinct()
        front = step.join(seen.select("node"), "node", "left_anti").withColumn("distance", F.lit(i))
        if keep:
            front = front.checkpoint()
        if not front.take(1):
            return seen, False
        seen = seen.unionByName(front)
    return seen, True


def reachable(edges: DataFrame, starts: DataFrame, rounds: int | None = None, limit: int = 10_000) -> DataFrame:
    """node, distance of all nodes that edges (source, target) reach from starts (node), or that `rounds` steps reach; breadth first.

    Without `rounds` it goes on until a step finds nothing new, and raises if `limit` steps are not enough.
    """
    found, more = _searched(edges, starts, limit if rounds is None else rounds)
    if more and rounds is None:
        raise RuntimeError(f"nodes are left after {limit} steps")
    return found


def discovered(edges: DataFrame, starts: DataFrame, rounds: int = 6) -> DataFrame:
    """As reachable, stopping after `rounds` rounds at most: what repeated fetching would find."""
    return reachable(edges, starts, rounds)


def occurrences(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Add occurrence: how many rows of the same key stand before."""
    return df.withColumn("occurrence", (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("bigint"))


def unresolved(named: DataFrame, files: DataFrame) -> DataFrame:
    """kind, path, blocking of named assets (kind, path) without a file (path): what only a script or a hint names is for diagnosis, the rest blocks."""
    return named.join(files.select("path"), "path", "left_anti").select("kind", "path", (~F.col("kind").isin("runtime-sink", "hint")).alias("blocking"))


def asset_gate(missing: DataFrame) -> DataFrame:
    """blocking, diagnostic, passed: one row."""
    return missing.agg(F.count_if("blocking").alias("blocking"), F.count_if(~F.col("blocking")).alias("diagnostic"), F.coalesce(F.bool_and(~F.col("blocking")), F.lit(True)).alias("passed"))


def internal_links(pages: DataFrame) -> DataFrame:
    """page_id, route, search, hash of links that lead to a captured page of the same host."""
    named = references(pages).where("startswith(raw, '/') and not startswith(raw, '//')").withColumn("path", U.without_query(F.col("raw")))
    there = pages.select(U.host(F.col("url")).alias("host"), U.path(F.col("url")).alias("path")).distinct()
    found = named.join(there, ["host", "path"], "left_semi")
    return found.select("page_id", F.col("path").alias("route"), F.regexp_extract(F.split("raw", "#")[0], r"(\?.*)$", 1).alias("search"), F.regexp_extract("raw", "(#.*)$", 1).alias("hash"))


def pages_by_route(pages: DataFrame) -> DataFrame:
    """route, pages (ids in order): all candidates of a route, first part of the path."""
    return pages.groupBy(F.regexp_extract(U.path(F.col("url")), "^/([^/]*)", 1).alias("route")).agg(F.array_sort(F.collect_list("page_id")).alias("pages"))
