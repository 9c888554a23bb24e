"""Folders of captured files as a data source: a partition for each folder below the root, links refused where they are met, no walk on the driver."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

SCHEMA = "path string, bytes long, content binary"
#: Bytes of files in a batch.
BATCH = 32 << 20


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool) -> None:
        self.path, self.deep = path, deep


class TreeReader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = root.removeprefix("file://").rstrip("/") or "/"
        self.wanted: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on the path are met before a file is opened."""
        kinds = {EqualTo: "is", In: "in", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "holds"}
        for f in filters:
            if type(f) in kinds and f.attribute == ("path",):
                self.wanted.append((kinds[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """The root's own files, and each folder in it."""
        if not os.path.isdir(self.root):
            raise ValueError(f"no folder {self.root}")
        return [Folder(self.root, False), *(Folder(e.path, True) for e in sorted(os.scandir(self.root), key=lambda e: e.name) if e.is_dir())]

    def _takes(self, path: str) -> bool:
        tell = {"is": lambda v: path == v, "in": lambda v: path in v, "starts": path.startswith, "ends": path.endswith, "holds": lambda v: v in path}
        return all(tell[kind](value) for kind, value in self.wanted)

    def read(self, folder: Folder) -> Iterator[pa.RecordBatch]:
        paths, contents, size, todo = [], [], 0, [folder.path]

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([len(c) for c in contents], pa.int64()), pa.array(contents, pa.binary())], names=["path", "bytes", "content"])

        if os.path.islink(folder.path):
            raise ValueError(f"symbolic link in input: {folder.path}")
        while todo:
            for e in sorted(os.scandir(todo.pop()), key=lambda e: e.name):
                if e.is_symlink():
                    raise ValueError(f"symbolic link in input: {e.path}")
                path = os.path.relpath(e.path, self.root).replace(os.sep, "/")
                if e.is_dir():
                    todo += [e.path] if folder.deep else []
                elif self._takes(path):
                    with open(e.path, "rb") as f:
                        contents.append(f.read())
                    paths.append(path)
                    size += len(contents[-1])
                    if size > BATCH:
                        yield batch()
                        paths, contents, size = [], [], 0
        if paths:
            yield batch()


class Tree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return TreeReader(self.options["path"])


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), bytes, content of every file below a folder that all workers see; raises on any symbolic link."""
    spark.dataSource.register(Tree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("tree").load(root)


def write_tree(files: DataFrame, root: str) -> int:
    """Write path, content as files below a folder that all workers see, each under a name of its own until it is whole; how many there are.

    A path that leaves the folder is refused; of paths that repeat any one stays.
    """
    top = root.removeprefix("file://").rstrip("/")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get()
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                whole = os.path.normpath(os.path.join(top, path))
                if not whole.startswith(top + os.sep):
                    raise ValueError(f"outside the folder: {path}")
                os.makedirs(os.path.dirname(whole), exist_ok=True)
                part = f"{whole}.part-{at.partitionId()}-{at.attemptNumber()}"
                with open(part, "wb") as f:
                    f.write(content or b"")
                os.replace(part, whole)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return files.select("path", F.col("content").cast("binary")).mapInArrow(rows, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below spark.checkpoint.dir, which must be one that all workers see as files; where the setting is absent, in local mode only, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared and re.match("[a-z0-9]+:", shared) and not shared.startswith("file:"):
        raise ValueError(f"no folder of files: {shared}")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all workers share")
        shared = tempfile.mkdtemp(prefix="corpusloom-")
    return f"{re.sub('^file:/*', '/', shared).rstrip('/')}/{name}-{uuid.uuid4().hex}"
