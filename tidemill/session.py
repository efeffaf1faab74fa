"""What the library needs from a session: shared scratch space and its own code on the executors."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Settings: bytes of an Arrow batch on its way to Python, and the removal of a query's shuffle files.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8_000_000
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Partitions of a written table follow its size, not the number of cores: few files where it is small.
MANY_PARTS = "spark.sql.adaptive.coalescePartitions.parallelismFirst"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, as ``--py-files`` would.

    Batches for Python workers are bounded by bytes as well, BATCH_BYTES unless the session sets
    another bound, so that long texts don't fill a worker.
    """
    context = spark.sparkContext
    if BATCH not in _set_by_user(spark):
        spark.conf.set(BATCH, str(BATCH_BYTES))
    if getattr(context, "_tidemill_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tidemill-code-"), "tidemill_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(here)))
    context.addPyFile(archive)
    context._tidemill_shipped = True


def _set_by_user(spark: SparkSession) -> set[str]:
    return {name for name, _ in spark.sparkContext.getConf().getAll()}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all machines share (``spark.checkpoint.dir``).

    Only in local mode, where one machine is all, may that setting be absent: a local folder then
    stands in for it. What is left there goes when the application ends.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        if not getattr(context, "_tidemill_scratch", None):
            context._tidemill_scratch = tempfile.mkdtemp(prefix="tidemill-scratch-")
        root = context._tidemill_scratch
    folder = f"{root.rstrip('/')}/{context.applicationId}"
    if getattr(context, "_tidemill_folder", None) != folder:
        system, path = _hadoop(spark, folder)
        system.mkdirs(path)
        system.deleteOnExit(path)
        context._tidemill_folder = folder
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


@contextlib.contextmanager
def _writing(spark: SparkSession) -> Iterator[None]:
    """Queries run in here remove their shuffle files when they end, as nothing reads them again,
    and write few files. A setting that this version of Spark lacks is left alone."""
    before = {name: spark.conf.get(name, None) for name in (CLEAN_UP, MANY_PARTS)}
    try:
        for name, value in ((CLEAN_UP, "true"), (MANY_PARTS, "false")):
            if before[name] is not None:
                spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is not None:
                spark.conf.set(name, value)


def table(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes ``df`` to shared scratch space and reads it back: lineage ends here.

    Lost executors then cost a read instead of a recomputation, and Spark knows the
    written size when it chooses between a broadcast and a shuffle. ``by`` names a column whose
    values get folders of their own, which ``forget`` can remove one by one.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    with _writing(spark):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._tidemill_path = path
    return found


def forget(*tables: DataFrame, part: str = "") -> None:
    """Removes what ``table`` wrote, or the folder ``part`` of it, once nothing reads it any more."""
    for df in tables:
        system, path = _hadoop(df.sparkSession, f"{vars(df)['_tidemill_path']}/{part}".rstrip("/"))
        system.delete(path, True)
