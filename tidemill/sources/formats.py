"""Files by format name: declared schemas, strict reading, and writing with the commit protocol."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemill.operators.schemas import cast_to
from tidemill.session import scratch


class ConnectorUnavailable(RuntimeError):
    """A source or sink needs a library that this session lacks."""


#: Formats whose reader is a jar that has to be on the class path.
NEEDS_JAR = frozenset({"avro"})


def available(spark: SparkSession, format: str) -> None:
    """Raises ConnectorUnavailable if Spark knows no reader of ``format``."""
    if format in NEEDS_JAR:
        try:
            spark._jvm.org.apache.spark.sql.execution.datasources.DataSource.lookupDataSource(format, spark._jsparkSession.sessionState().conf())
        except Exception as error:
            raise ConnectorUnavailable(f"{format} needs its jar on the class path") from error


@dataclass(frozen=True)
class Format:
    spark: str
    needs_schema: bool = False
    options: dict[str, str] = field(default_factory=dict)


FORMATS = {
    "csv": Format("csv", True, {"header": "true", "mode": "FAILFAST"}),
    "ndjson": Format("json", False, {"mode": "FAILFAST"}),
    "parquet": Format("parquet"),
    "orc": Format("orc"),
    "avro": Format("avro"),
}
#: Records that a schema is inferred from.
INFER_ROWS = 1024


def read_files(spark: SparkSession, path: str, format: str, schema: T.StructType | None = None, **options: str) -> DataFrame:
    """Reads ``path``. CSV needs a schema; a schema for Parquet is a projection and a strict cast."""
    if format == "arrow-ipc":
        return from_ipc(spark.read.format("binaryFile").load(path).select("content"), schema)
    kind = FORMATS[format]
    available(spark, format)
    if kind.needs_schema and schema is None:
        raise ValueError(f"{format} needs a declared schema")
    reader = spark.read.format(kind.spark).options(**{**kind.options, **options})
    if format == "parquet":
        found = reader.load(path)
        return found if schema is None else cast_to(found, schema, safe=False)
    if format == "ndjson" and schema is None:
        some = scratch(spark, "lines")
        spark.read.text(path).limit(INFER_ROWS).write.text(some)
        schema = spark.read.json(some).schema
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write_files(df: DataFrame, path: str, format: str, truncate: bool = False, max_rows: int = 0, **options: str) -> None:
    """Appends, or replaces with ``truncate``; a file rolls after ``max_rows``."""
    kind = FORMATS[format]
    available(df.sparkSession, format)
    writer = df.write.format(kind.spark).options(**{k: v for k, v in {**kind.options, **options}.items() if k != "mode"})
    writer.option("maxRecordsPerFile", max_rows).mode("overwrite" if truncate else "append").save(path)


def to_ipc(df: DataFrame) -> DataFrame:
    """(content): the rows as Arrow IPC streams, one for each Arrow batch of a partition."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, batch.schema) as stream:
                stream.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], ["content"])

    return df.mapInArrow(written, "content binary")


def _opened(content: bytes):
    """IPC files start with a magic word, streams with their schema."""
    return pa.ipc.open_file(content) if content[:6] == b"ARROW1" else pa.ipc.open_stream(content)


def from_ipc(contents: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """The rows of Arrow IPC streams or files (content); the schema is that of the first if none is declared.

    All have to agree with it by name; columns that it lacks are dropped, types are cast safely.
    """
    if schema is None:
        from pyspark.sql.pandas.types import from_arrow_schema

        first = contents.first()
        schema = from_arrow_schema(_opened(bytes(first.content)).schema) if first else T.StructType()
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                reader = _opened(content.as_py())
                parts = (reader.get_batch(i) for i in range(reader.num_record_batches)) if hasattr(reader, "num_record_batches") else reader
                for part in parts:
                    yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(f.name)).cast(f.type) for f in target], schema=target)

    return contents.mapInArrow(read, schema)
