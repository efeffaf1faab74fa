"""Batches that a sink refused: kept with the reason, and written again later."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.session import ship

LETTER = "workflow string, sink string, component string, reason string, failed_at_unix_ms long, replays int, rows int, payload binary"
MAX_REASON = 2000


def _sealed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, batch.schema) as stream:
            stream.write_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int32()), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["rows", "payload"])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for payload in batch.column(0):
            yield from pa.ipc.open_stream(payload.as_py())


def letters(batch: DataFrame, workflow: str, sink: str, component: str, reason: str, replays: int = 0) -> DataFrame:
    """One letter for each Arrow batch of the rows; nothing is gathered."""
    ship(batch.sparkSession)
    head = {"workflow": workflow, "sink": sink, "component": component, "reason": reason[:MAX_REASON]}
    sealed = batch.mapInArrow(_sealed, "rows int, payload binary")
    return sealed.select(*[F.lit(v).alias(k) for k, v in head.items()], F.lit(int(time.time() * 1000)).alias("failed_at_unix_ms"), F.lit(replays).alias("replays"), "rows", "payload")


def contents(found: DataFrame, schema: str) -> DataFrame:
    """The rows that letters hold."""
    ship(found.sparkSession)
    return found.select("payload").mapInArrow(_opened, schema)


def guarded(write: Callable[[DataFrame], None], folder: str, workflow: str, sink: str, component: str, replays: int = 0) -> Callable[[DataFrame], bool]:
    """``write`` with refused batches appended to ``folder``; True if the batch was written."""

    def run(batch: DataFrame) -> bool:
        try:
            write(batch)
        except Exception as refused:  # noqa: BLE001 - whatever the sink raises is the reason
            letters(batch, workflow, sink, component, str(refused), replays).write.mode("append").parquet(folder)
            return False
        return True

    return run


def replay_letters(spark: SparkSession, folder: str, refused: str, sink: str, schema: str, write: Callable[[DataFrame], None]) -> bool:
    """Writes the rows of a sink's letters again; those that fail once more go to ``refused``."""
    waiting = spark.read.schema(LETTER).parquet(folder).filter(F.col("sink") == sink)
    first = waiting.agg(F.first("workflow"), F.first("component"), F.max("replays")).first()
    if first[0] is None:
        return True
    return guarded(write, refused, first[0], sink, first[1], first[2] + 1)(contents(waiting, schema))
