"""What a sink's write does to a keyed table, as DataFrame results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: str | list[str]) -> DataFrame:
    """The row of greatest ``order`` of each key; partly aggregated before the shuffle.

    The buffer is a row, so Spark sorts by key to aggregate, once on either side of the shuffle."""
    order = [order] if isinstance(order, str) else order
    row = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("row")
    return df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(row).select("row.*")


def append(base: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of both; a key that is there already is an error.

    It is raised before anything is written, which costs two jobs over the keys when this is called."""
    if base.schema.simpleString() != batch.schema.simpleString():
        raise ValueError(f"schemas differ: {base.schema.simpleString()} and {batch.schema.simpleString()}")
    if not batch.join(base, keys, "left_semi").isEmpty() or not batch.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"a key of {keys} is there already")
    return base.unionByName(batch)


def single(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``, which fails when it is read if a key repeats."""
    names = [F.col(k).alias(f"__{k}") for k in keys]
    once = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit(f"a key of {keys} repeats in the batch"))).otherwise(F.first(F.struct(*df.columns)))
    return df.groupBy(*names).agg(once.cast(df.select(F.struct(*df.columns)).schema[0].dataType).alias("row")).select("row.*")


def earliest(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key in the order in which the rows come."""
    at = F.monotonically_increasing_id()
    row = F.min_by(F.struct(*df.columns), F.col("__at")).alias("row")
    return df.withColumn("__at", at).groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(row).select("row.*")


def upsert(base: DataFrame, batch: DataFrame, keys: list[str], order: str | None, update: list[str] | None = None) -> DataFrame:
    """Rows of ``batch`` replace those of equal key, or only their ``update`` columns; of a key that repeats in the batch
    the greatest ``order`` wins; without an order a repeated key is an error."""
    fresh = (single(batch, keys) if order is None else latest(batch, keys, order)).select(*base.columns)
    if update is None:
        return base.join(fresh, keys, "left_anti").unionByName(fresh)
    new = fresh.select(*keys, F.struct(*base.columns).alias("__new"))
    old = base.withColumn("__old", F.lit(True))
    both = old.join(new, keys, "full")
    return both.select(*[F.col(c) if c in keys else F.when(F.col("__old").isNull() | (F.lit(c in update) & F.col("__new").isNotNull()), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) for c in base.columns])


def ignore_conflicts(base: DataFrame, batch: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Only keys that are not there yet are added; of a key that repeats in the batch the greatest
    ``order`` wins, or the first row without one."""
    fresh = earliest(batch, keys) if order is None else latest(batch, keys, order)
    return base.unionByName(fresh.select(*base.columns).join(base, keys, "left_anti"))


def apply_changes(base: DataFrame, changes: DataFrame, keys: list[str], order: str | list[str], op: str = "__op") -> DataFrame:
    """The table after ordered changes: I, U and R write a row, D deletes it; the last of each key counts."""
    rest = [c for c in base.columns if c not in keys]
    last = latest(changes, keys, order).select(*keys, F.col(op).alias("__op"), F.struct(F.lit(1), *rest).alias("__new"))
    both = base.join(last, keys, "full").filter("__op is null or __op <> 'D'")
    return both.select(*[F.col(c) if c in keys else F.when(F.col("__op").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) for c in base.columns])


def compacted(log: DataFrame, keys: list[str], order: str | list[str], tombstone: Column) -> DataFrame:
    """The latest value of each key of a log; keys whose latest row is a tombstone are gone."""
    return latest(log, keys, order).filter(~tombstone)


def tombstones(df: DataFrame, keys: list[str]) -> DataFrame:
    """(key, value) messages: value is JSON, or null if all columns but the keys are null."""
    rest = [c for c in df.columns if c not in keys]
    empty = F.lit(True)
    for c in rest:
        empty = empty & F.col(c).isNull()
    return df.select(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"), F.when(empty, F.lit(None)).otherwise(F.to_json(F.struct(*df.columns))).alias("value"))


def cursor_page(df: DataFrame, cursor: str, tiebreak: str, after: tuple | None, size: int) -> DataFrame:
    """The next ``size`` rows in the order of (cursor, tiebreak) after a position."""
    if after is not None:
        df = df.filter((F.col(cursor) > F.lit(after[0])) | ((F.col(cursor) == F.lit(after[0])) & (F.col(tiebreak) > F.lit(after[1]))))
    return df.orderBy(cursor, tiebreak).limit(size)


def first_rows(df: DataFrame, keys: list[str], *order: Column, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key; Spark cuts each partition before the shuffle."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")
