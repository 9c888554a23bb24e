"""Sources and sinks: Parquet tables, captured file trees, tolerant JSON reports, hint lists, filtered copies."""

from __future__ import annotations

import os
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def refuse_links(root: str) -> None:
    """Raise on any symbolic link below a local root."""
    for folder, dirs, files in os.walk(root):
        for name in dirs + files:
            if os.path.islink(os.path.join(folder, name)):
                raise ValueError(f"symbolic link in input: {os.path.join(folder, name)}")


def file_tree(spark: SparkSession, root: str, extensions: tuple[str, ...] = ()) -> DataFrame:
    """path (relative), bytes, content of every file below root; filters on the path come before any content is read."""
    if "://" not in root:
        refuse_links(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root if "://" in root else "file:" + os.path.abspath(root)
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "file:/"), "^" + _quoted(base.rstrip("/")) + "/", "")
    out = files.select(path.alias("path"), F.col("length").alias("bytes"), "content")
    if extensions:
        out = out.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*extensions))
    return out


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+?^$|" else c for c in text)


def json_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A report's rows; what is not valid JSON of the schema comes as nulls instead of an error."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="PERMISSIVE")


def hints(spark: SparkSession, path: str) -> DataFrame:
    """path: one of each line, trimmed; blank lines and comments are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> '' and not startswith(path, '#')")


def site_root(paths: list[str], url: str) -> str:
    """Where a captured site begins: the folder of its host, else the top, else the first folder with an index."""
    host = urlsplit(url).hostname or ""
    tops = sorted({p.split("/", 1)[0] for p in paths if p.count("/") == 1 and p.endswith("/index.html")})
    if f"{host}/index.html" in paths:
        return host
    if "index.html" in paths:
        return ""
    if tops:
        return tops[0]
    raise ValueError("no folder with index.html")


def captured(files: DataFrame) -> DataFrame:
    """Files of a capture without the crawler's own."""
    return files.where("not (startswith(path, 'hts-cache/') or startswith(path, 'hts-log') or endswith(path, '.DS_Store'))")


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows as JSON lines. Overwriting removes the old rows first; replacing.replace() keeps them until the new ones stand."""
    df.write.mode(mode).json(path)


def texts(files: DataFrame) -> DataFrame:
    """path, text of files with their content read as UTF-8; what is none comes with replacement characters."""
    return files.select("path", F.decode(F.col("content"), "UTF-8").alias("text"))


def pictures(spark: SparkSession, path: str) -> DataFrame:
    """path, height, width, channels, pixels of the pictures in a folder, decoded by Spark; what is none is left out."""
    found = spark.read.format("image").option("dropInvalid", "true").load(path)
    return found.select(F.col("image.origin").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), F.col("image.data").alias("pixels"))
