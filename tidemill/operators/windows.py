"""Event-time windows over DataFrames: tumbling, sliding, session; lateness; reductions.

Times are epoch milliseconds. Window ids are integers: tumbling id = floor((t - offset) / size),
also for negative times. Null times are dropped before anything else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidemill.functions.hashing import key_hash

#: Ranges of key hashes whose sessions are counted apart, and of batches whose greatest times are.
RANGE_BITS = 12
RANGES = 1 << RANGE_BITS


def epoch_ms(ts: str) -> Column:
    """Milliseconds of a timestamp without zone, microseconds cut off toward zero."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts}) div 1000")


def tumbling_id(ms: Column, size: int, offset: int = 0) -> Column:
    x = (ms - F.lit(offset)).cast("long")
    return F.call_function("div", x - F.pmod(x, F.lit(size)), F.lit(size))


#: Steps of a unit in a millisecond; seconds are more than one.
PER_MS = {"ms": 1, "us": 1_000, "ns": 1_000_000}


def to_ms(time: str, unit: str) -> Column:
    """Milliseconds of a long column in s, ms, us or ns, cut off toward zero."""
    if unit == "s":
        return F.col(time) * 1000
    return F.expr(f"`{time}` div {PER_MS[unit]}")


def sliding_ids(ms: Column, size: int, slide: int, offset: int = 0, strict: bool = False) -> Column:
    """An array of the ceil(size / slide) ids whose windows a time belongs to.

    If slide doesn't divide size, the oldest of these windows may end before the time; ``strict``
    leaves such ids out.
    """
    k = -(-size // slide)
    last = tumbling_id(ms, slide, offset)
    ids = F.sequence(last - F.lit(k - 1), last)
    return F.filter(ids, lambda i: i * slide + offset + size > ms) if strict else ids


def sessions(df: DataFrame, keys: list[str], ms: str, gap: int) -> DataFrame:
    """Adds session_id, counted from 0 within its key; a new one starts after a pause of more than ``gap``."""
    order = W.partitionBy(*keys).orderBy(ms)
    fresh = F.coalesce((F.col(ms) - F.lag(ms).over(order) > gap).cast("long"), F.lit(0))
    running = W.partitionBy(*keys).orderBy(ms).rowsBetween(W.unboundedPreceding, 0)
    return df.filter(F.col(ms).isNotNull()).withColumn("__fresh", fresh).withColumn("session_id", F.sum("__fresh").over(running)).drop("__fresh")


def sessions_across(df: DataFrame, keys: list[str], ms: str, gap: int) -> DataFrame:
    """As ``sessions``, with key_hash, and ids that go on from key to key in the order of key_hash.

    The sessions before a key are counted in two levels: within its range of hashes, of RANGES, and
    over the ranges, so that the one task that orders ranges has RANGES rows at most.
    """
    found = sessions(df, keys, ms, gap).withColumn("key_hash", key_hash(*keys))
    counts = found.groupBy("key_hash", *keys).agg((F.max("session_id") + 1).alias("__n"))
    counts = counts.withColumn("__range", F.shiftright("key_hash", 64 - RANGE_BITS))
    within = W.partitionBy("__range").orderBy("key_hash", *keys)
    ranges = counts.groupBy("__range").agg(F.sum("__n").alias("__all"))
    ranges = ranges.select("__range", (F.sum("__all").over(W.orderBy("__range")) - F.col("__all")).alias("__before"))
    running = F.sum("__n").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")
    first = counts.withColumn("__within", running).join(ranges, "__range").select(*[F.col(k).alias(f"__{k}") for k in keys], (F.col("__before") + F.col("__within")).alias("__first"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return found.join(first, same).withColumn("session_id", F.col("session_id") + F.col("__first")).drop("__first", *[f"__{k}" for k in keys])


def hashed_windows(df: DataFrame, ids: Column, keys: list[str], *aggregates: Column) -> DataFrame:
    """As ``windowed``, in the output columns window_id, key_hash and the aggregates; groups are those
    of the real keys."""
    out = windowed(df, ids, keys, *aggregates)
    return out.select("window_id", key_hash(*keys).alias("key_hash"), *[c for c in out.columns if c != "window_id" and c not in keys])


def flush(state: DataFrame, results: DataFrame, component: str, value: str) -> DataFrame:
    """The window accumulator (component, window_id, key_hash, sum_f64, count, min_f64, max_f64) after
    the on-time ``results`` (window_id, key_hash, ``value``) of a run.

    A flush replaces the rows of its groups and doesn't add to them: sum_f64 is the aggregate of
    whatever kind, count is 1, min and max stay null.
    """
    none = F.lit(None).cast("double")
    fresh = results.select(F.lit(component).alias("component"), "window_id", "key_hash", F.col(value).cast("double").alias("sum_f64"), F.lit(1).cast("long").alias("count"), none.alias("min_f64"), none.alias("max_f64"))
    return state.join(fresh, ["component", "window_id", "key_hash"], "left_anti").unionByName(fresh)


ACCUMULATOR = "component string, window_id long, key_hash long, sum_f64 double, count long, min_f64 double, max_f64 double"


def reduction(kind: str, column: str) -> Column:
    """Sum, min, max, count or mean as a double. Over nulls alone: 0, +inf, -inf, the row count, NaN."""
    c = F.col(column)
    forms = {
        "sum": lambda: F.coalesce(F.sum(c), F.lit(0.0)),
        "min": lambda: F.coalesce(F.min(c), F.lit(float("inf"))),
        "max": lambda: F.coalesce(F.max(c), F.lit(float("-inf"))),
        "count": lambda: F.count(F.lit(1)).cast("double"),
        "mean": lambda: F.coalesce(F.avg(c), F.lit(float("nan"))),
    }
    if kind not in forms:
        raise ValueError(f"no reduction {kind!r}; there are {sorted(forms)}")
    return forms[kind]().alias(f"{kind}_{column}")


def windowed(df: DataFrame, ids: Column, keys: list[str], *aggregates: Column) -> DataFrame:
    """Groups by window_id and keys; ``ids`` is a long, or an array for sliding windows."""
    out = df.withColumn("window_id", ids)
    if out.schema["window_id"].dataType.typeName() == "array":
        out = out.withColumn("window_id", F.explode("window_id"))
    return out.filter("window_id is not null").groupBy("window_id", *keys).agg(*aggregates)


def late_split(df: DataFrame, batch: str, ms: str, allowed: int, advance_first: bool = False) -> DataFrame:
    """Adds ``late``: the time lies more than ``allowed`` before the watermark.

    The watermark is the greatest time of all earlier batches (or, with ``advance_first``, also of
    the row's own). It is never late without a watermark, nor when ``allowed`` reaches the watermark.
    ``batch`` is an integer column; rows without one come before all others, and are never late.
    One aggregated row a batch carries the watermark, so rows are joined, not sorted. The greatest
    time before a batch is found in two levels: within its range of batches, of RANGES, and over the
    ranges, so that the one task that orders ranges has RANGES + 2 rows at most.
    """
    if not isinstance(df.schema[batch].dataType, IntegralType):
        raise ValueError(f"{batch} has to be an integer column, to be cut to ranges")
    tops = df.filter(F.col(ms).isNotNull()).groupBy(batch).agg(F.max(ms).alias("__top"))
    number = F.col(batch).cast("double")
    ends = tops.agg(F.min(number).alias("low"), F.max(number).alias("high"))
    low, high = ends.select("low").scalar(), ends.select("high").scalar()
    # Rounding keeps the order; batches that round alike share a range.
    tops = tops.withColumn("__range", F.coalesce(F.floor((number - low) / (high - low + 1) * RANGES), F.lit(-1)))
    frame = W.partitionBy("__range").orderBy(batch).rowsBetween(W.unboundedPreceding, 0 if advance_first else -1)
    earlier = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    ranges = tops.groupBy("__range").agg(F.max("__top").alias("__top")).select("__range", F.max("__top").over(earlier).alias("__before"))
    marks = tops.withColumn("__within", F.max("__top").over(frame)).join(ranges, "__range")
    marks = marks.select(batch, F.greatest("__within", "__before").alias("watermark"))
    late = (F.col("watermark").isNotNull()) & (F.lit(allowed) < F.col("watermark")) & (F.col(ms) < F.col("watermark") - allowed)
    return df.filter(F.col(ms).isNotNull()).join(marks, batch, "left").withColumn("late", F.coalesce(late, F.lit(False)))


def refire(df: DataFrame, batch: str, keys: list[str], *aggregates: Column) -> DataFrame:
    """Each batch emits the aggregates of its own rows; ``again`` marks groups that an earlier batch emitted."""
    emitted = df.groupBy(batch, *keys).agg(*aggregates)
    return emitted.withColumn("again", F.row_number().over(W.partitionBy(*keys).orderBy(batch)) > 1)


def closed(groups: DataFrame, end: str, rows: DataFrame, ms: str) -> DataFrame:
    """The groups whose end the watermark (the greatest time of ``rows``) has reached."""
    return groups.filter(F.col(end) <= rows.agg(F.max(ms)).scalar())


def process_windows(df: DataFrame, ids: Column, keys: list[str], apply, schema: str, size: int | None = None, ms: str | None = None, watermark: int | None = None) -> DataFrame:
    """Calls ``apply`` (Arrow table -> Arrow table of ``schema``) once for each window and key.

    For what aggregates can't express: a group is handed over whole. With a ``size`` each row has
    the window's context: window_start (id * size, whatever the offset) and window_end; with a
    ``watermark`` also watermark and late, whether its time ``ms`` lies before it.
    """
    if size is not None:
        df = df.withColumn("window_start", ids * size).withColumn("window_end", (ids + 1) * size)
    if watermark is not None:
        df = df.withColumn("watermark", F.lit(watermark)).withColumn("late", F.col(ms) < watermark)
    return df.withColumn("window_id", ids).filter("window_id is not null").groupBy("window_id", *keys).applyInArrow(apply, schema)
