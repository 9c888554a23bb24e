"""Shared helpers: reading tables, cutting lineage in the cluster's shared folder, defined null handling."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of all contracts: maximal runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a folder of our own serves, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='corpusloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def dropped(*tables: DataFrame) -> None:
    """Delete tables of written() once all that was made of them is itself written."""
    for t in tables:
        spark = t.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound what an Arrow batch of whole texts takes in a Python worker, in rows and bytes. The settings stay, as results are computed later."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def blocks(data: bytes, size: int = 1 << 22) -> Iterator[bytes]:
    """Cut a long text at ASCII white space into blocks of about `size` bytes; what has no white space stays whole."""
    start = 0
    while len(data) - start > size:
        end = max(data.rfind(c, start, start + size) for c in (b" ", b"\n", b"\t"))
        if end <= start:
            end = min((x for c in (b" ", b"\n", b"\t") if (x := data.find(c, start + size)) >= 0), default=len(data))
        yield data[start:end]
        start = end
    if start < len(data):
        yield data[start:]


def parts_for(spark: SparkSession, least: int) -> int:
    """How many parts packed keys are dealt to: as many as shuffles have partitions, so they stay small as these grow with the input."""
    found = spark.conf.get("spark.sql.shuffle.partitions", "200")
    return max(least, int(found) if found.isdigit() else 200)


def text_of(column: str = "text") -> Column:
    """A null text is an empty one."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_fold(column: str, parts: int) -> Column:
    """crc32 of the id as text modulo parts; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(parts)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores behind them as it takes for df to have no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
