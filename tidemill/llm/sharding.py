"""Proportional stratified interleaving, in DataFrame operations only.

Rows of each source are shuffled by a seeded hash and ranked; a row's fractional rank is
(rank - u) / rows of its source, with u in (0, 1] from the source's hash so that tiny sources
do not all meet in the middle. Sorting everything by fractional rank interleaves the sources
in proportion, and equal cuts of that order give shards that all match the mixture.

Neither rank needs a single large partition. Rows fall into buckets by the leading bits of
the shuffling hash (then of the fractional rank), both even for any number of sources and any
share of one; a rank is the row's place in its bucket plus the sizes of the buckets before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.session import table

#: Rows that a bucket holds on average.
BUCKET_ROOM = 20_000
SPAN = 2**62


def interleaved_shards(docs: DataFrame, shards: int = 8, seed: int = 17) -> DataFrame:
    """Deals rows of ``docs`` (doc_id, text, source) to ``shards`` shards of equal row counts.

    Returns doc_id, size (UTF-8 bytes of the text plus 1; null: none), text_crc32, law
    ("rows"), shard, slot, grown_shard (null). Counts differ by one at most; the rows of each
    source are spread over the shards in the same proportion up to rounding. A null source is
    a source of its own. Repeated rows are dealt out one by one. No rows give no rows; other
    columns are ignored.
    """
    raw = F.coalesce(F.encode("text", "utf-8"), F.lit(b""))
    source = F.xxhash64(F.col("source").isNull(), F.coalesce("source", F.lit("")), F.lit(seed))
    narrow = table(
        docs.select("doc_id", "source", raw.alias("raw")).select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            (F.octet_length("raw") + 1).cast("long").alias("size"),
            F.crc32("raw").alias("text_crc32"),
            source.alias("src"),
        ).withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32", F.lit(seed)), 2)),
        "narrow",
    )
    rows = narrow.count()
    buckets = max(1, -(-rows // BUCKET_ROOM))
    place = F.least(F.lit(buckets - 1), F.floor(F.col("h") / F.lit(SPAN / buckets)))
    dealt = narrow.withColumn("bucket", place)
    sizes = dealt.groupBy("src", "bucket").agg(F.count(F.lit(1)).alias("here"))
    along = W.partitionBy("src").orderBy("bucket")
    before = table(
        sizes.select("src", "bucket", (F.sum("here").over(along) - F.col("here")).alias("before"), F.sum("here").over(W.partitionBy("src")).alias("of_source")), "ranks"
    )
    rank = F.row_number().over(W.partitionBy("src", "bucket").orderBy("h", "doc_id", "row"))
    offset = (F.shiftrightunsigned(F.xxhash64("src", F.lit(seed + 1)), 11) + 1) / F.lit(float(2**53))
    ranked = dealt.withColumn("rank", rank).join(before, ["src", "bucket"]).withColumn("fraction", (F.col("before") + F.col("rank") - offset) / F.col("of_source"))
    cut = table(
        ranked.select("row", "doc_id", "size", "text_crc32", "src", "fraction", F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.floor(F.col("fraction") * buckets))).cast("long").alias("cell")), "fractions"
    )
    cells = cut.groupBy("cell").agg(F.count(F.lit(1)).alias("here"))
    cells = table(cells.select("cell", (F.sum("here").over(W.orderBy("cell")) - F.col("here")).alias("before")), "cells")
    order = F.row_number().over(W.partitionBy("cell").orderBy("fraction", "src", "row"))
    at = cut.withColumn("within", order).join(cells, "cell").withColumn("at", F.col("before") + F.col("within") - 1)
    shard = F.floor(F.col("at") * shards / F.lit(max(1, rows)))
    # Floating point never decides a cut: shard k starts at ceil(k * rows / shards).
    start = lambda k: F.floor((k * F.lit(rows) + F.lit(shards - 1)) / F.lit(shards))
    guess = at.withColumn("g", F.least(F.lit(shards - 1), shard).cast("long"))
    fixed = F.when(F.col("at") < start(F.col("g")), F.col("g") - 1).when(F.col("at") >= start(F.col("g") + 1), F.col("g") + 1).otherwise(F.col("g"))
    return guess.withColumn("s", fixed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("s").cast("int").alias("shard"), (F.col("at") - start(F.col("s"))).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
