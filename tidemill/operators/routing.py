"""Routing of rows and batches over labelled branches; partition by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def route_rows(df: DataFrame, branches: dict[str, Column], default: str) -> dict[str, DataFrame]:
    """Each row goes to the first branch whose condition holds, or to ``default``."""
    label = F.lit(default)
    for name, when in reversed(branches.items()):
        label = F.when(when, F.lit(name)).otherwise(label)
    marked = df.withColumn("branch", label)
    return {name: marked.filter(F.col("branch") == name) for name in [*branches, default]}


def route_batch(decision: list[str] | None, edges: dict[str, str | None]) -> list[str]:
    """The edges (name -> label) that a batch takes: all without a decision, else those whose label is named."""
    return [e for e, label in edges.items() if decision is None or label in decision]


def key_partition(df: DataFrame, keys: list[str], parts: int, ordinal: int) -> DataFrame:
    """The rows whose key hash belongs to one of ``parts`` workers."""
    return df.filter(F.pmod(F.xxhash64(*keys), F.lit(parts)) == ordinal)


def fan_in(*frames: DataFrame) -> DataFrame:
    """All rows of frames of the same schema."""
    first, *rest = frames
    for other in rest:
        if [(f.name, f.dataType) for f in other.schema] != [(f.name, f.dataType) for f in first.schema]:
            raise ValueError("the schemas differ")
        first = first.unionByName(other)
    return first


def lookup(rows: DataFrame, reference: DataFrame, keys: list[str], order: str, defaults: dict[str, object]) -> DataFrame:
    """Left lookup against the last reference row of each key; unknown keys take ``defaults``.

    Spark broadcasts the reference only if its known size allows; otherwise both sides shuffle.
    """
    from tidemill.operators.writes import latest

    last = latest(reference, keys, order).select(*keys, *defaults)
    joined = rows.join(last, keys, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def table_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one table has more often than the other, with ``side``; empty if both are equal as bags."""
    only = lambda a, b, side: a.exceptAll(b.select(a.columns)).withColumn("side", F.lit(side))
    return only(left, right, "left").unionAll(only(right.select(left.columns), left, "right"))
