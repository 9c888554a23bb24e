"""The append-only trace: new events of a history as they arrive, each batch committed once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def follow(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Trace files of JSON lines below folder, as a stream."""
    return spark.readStream.schema(schema).json(folder)


def append(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append what is there to Parquet and stop; a rerun goes on where this one ended."""
    return stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
