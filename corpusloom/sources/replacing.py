"""Tables that are replaced in one step: new rows go into a folder of their own, are checked, and a pointer is moved; until then, and for who reads meanwhile, the old rows stay."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "current"


def _path(spark: SparkSession, name: str):  # noqa: ANN202  a Java path
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)


def _files(spark: SparkSession, name: str):  # noqa: ANN202  a Java file system
    return _path(spark, name).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def version(spark: SparkSession, root: str) -> str | None:
    """The folder that the pointer names; null before the first replacement."""
    pointer = f"{root.rstrip('/')}/{POINTER}"
    if not _files(spark, pointer).exists(_path(spark, pointer)):
        return None
    return spark.read.text(pointer, wholetext=True).first()[0]


def current(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the last replacement that came to its end."""
    found = version(spark, root)
    if found is None:
        raise ValueError(f"no table at {root}")
    return spark.read.parquet(f"{root.rstrip('/')}/{found}")


def replace(df: DataFrame, root: str, least: int = 1, keep: int = 2) -> str:
    """Make df the rows of the table at root; the name of its version.

    A failing task, or fewer rows than `least` (an empty input), changes nothing that can be read. The last `keep`
    versions stay for those that still read them. df may read the table that it replaces.
    """
    spark, root = df.sparkSession, root.rstrip("/")
    name = f"v-{uuid.uuid4().hex}"
    files = _files(spark, root)
    try:
        df.write.parquet(f"{root}/{name}")
        rows = spark.read.schema(df.schema).parquet(f"{root}/{name}").count()
        if rows < least:
            raise ValueError(f"{rows} rows, {least} at least")
    except BaseException:
        files.delete(_path(spark, f"{root}/{name}"), True)
        raise
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    old = version(spark, root)
    part = f"{root}/{POINTER}-{name}"
    out = files.create(_path(spark, part))
    out.write(bytearray(name.encode()))
    out.close()
    overwrite = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = gateway.new_array(overwrite, 1)
    options[0] = overwrite.OVERWRITE
    target = files.makeQualified(_path(spark, f"{root}/{POINTER}"))
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(files.makeQualified(_path(spark, part)), target, options)
    stale = sorted((s for s in files.listStatus(_path(spark, root)) if s.getPath().getName().startswith("v-") and s.getPath().getName() not in (name, old)), key=lambda s: s.getModificationTime())
    for s in stale[: max(0, len(stale) - keep + 2)]:
        files.delete(s.getPath(), True)
    return name
