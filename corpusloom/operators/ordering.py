"""Global order without one task for all: numbers in sorted order, and digests of everything in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _kept(df: DataFrame) -> DataFrame:
    """Rows that stay in their partitions however often they are read: in the cluster's checkpoint folder, or, where there is none, in memory and on disk."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir() and spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))  # once: Spark adds a folder of its own to it each time
    if spark.sparkContext.getCheckpointDir():
        return df.checkpoint()
    return df.persist()


def numbered(df: DataFrame, *order: str | Column, name: str = "at") -> DataFrame:
    """Add the place of each row in sorted order, from 0: rows are dealt by range and numbered in their partition; only the partitions' counts, one number each, come to the driver.

    Nulls stand first; rows that are equal in the order get different numbers.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")
    dealt = df.repartitionByRange(int(parts) if parts.isdigit() else 200, *keys).sortWithinPartitions(*keys)
    row = F.monotonically_increasing_id()  # the partition in the high bits, the row in the low ones
    dealt = _kept(dealt.withColumn(name, row))
    part = F.shiftright(name, 33)
    before, starts = 0, {}
    for p, n in sorted(map(tuple, dealt.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())):
        starts[p] = before - (p << 33)
        before += n
    if not starts:
        return dealt
    shift = F.element_at(F.create_map(*[x for p, s in starts.items() for x in (F.lit(p).cast("long"), F.lit(s).cast("long"))]), part)
    return dealt.withColumn(name, F.col(name) + shift)


def digest_in_order(df: DataFrame, at: str, digest: Column, rows: int, fanout: int = 4096) -> DataFrame:
    """One row, fingerprint: the digest of the digests of places 0 to rows - 1, through a tree with `fanout` children a node, as many levels as it takes."""
    level = df.select(F.col(at).cast("bigint").alias("at"), digest.alias("d"))
    while True:
        node = F.transform(F.array_sort(F.collect_list(F.struct("at", "d"))), lambda x: x["d"])
        if rows <= fanout:
            return level.agg(F.sha2(F.array_join(node, ""), 256).alias("fingerprint"))
        rows = -(-rows // fanout)
        level = level.groupBy(F.expr(f"at div {fanout}").alias("up")).agg(F.sha2(F.array_join(node, ""), 256).alias("d")).withColumnRenamed("up", "at")


def path_fingerprint(files: DataFrame, path: str = "path", digest: str = "sha256", fanout: int = 4096) -> DataFrame:
    """One row, fingerprint of any number of files in the order of their paths: of each path, a newline and its digest.

    An empty table has the digest of nothing; a null path or digest reads as the empty text; paths that repeat stand in the order of their digests.
    """
    plain = files.select(F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), F.coalesce(F.col(digest).cast("string"), F.lit("")).alias("d"))
    placed = numbered(_kept(plain), "path", "d")  # sampling, sorting and counting read digests, not contents
    return digest_in_order(placed, "at", F.sha2(F.concat("path", F.lit("\n"), "d"), 256), placed.count(), fanout)
