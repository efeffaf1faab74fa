"""Structured Streaming runs: replay of files in batches, windows that close by watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def replay(spark: SparkSession, path: str, schema, apply: Callable[[DataFrame, int], None], checkpoint: str, files: int = 1) -> StreamingQuery:
    """Feeds each new batch of Parquet files to ``apply`` until all are read."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def closing_windows(stream: DataFrame, ts: str, keys: list[str], size: str, allowed: str, *aggregates: Column) -> DataFrame:
    """Tumbling windows that are emitted once, when the watermark passes their end."""
    marked = stream.withWatermark(ts, allowed)
    return marked.groupBy(F.window(ts, size), *keys).agg(*aggregates)


def closing_sessions(stream: DataFrame, ts: str, keys: list[str], gap: str, allowed: str, *aggregates: Column) -> DataFrame:
    marked = stream.withWatermark(ts, allowed)
    return marked.groupBy(F.session_window(ts, gap), *keys).agg(*aggregates)
