"""Connected components of a link table, by alternating large and small stars.

Nothing is collected: each round is two joins on node ids, written to shared scratch space.
Hubs are never gathered; a node's least neighbour comes from a partial aggregation that is written,
and the join that spreads it lies between plain shuffles, so adaptive execution can split a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.session import forget, table


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One star operation on (u, v) with u > v: each node's neighbours move to the least of them.
    Returns a table, and forgets ``links``, which was one."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    # Written first: a join right above an aggregation is one whose hot keys Spark can't split.
    least = table(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), "least")
    joined = both.join(least, "u")
    if large:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    found = table(moved.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    forget(least, links)
    return found


def components(links: DataFrame) -> DataFrame:
    """A table (node, root) for each node of ``links`` (u long, v long): root is the least node it reaches.

    Loops and repeated links change nothing; nodes without links to others don't appear.
    """
    now = table(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        now = _stars(_stars(now, True), False)
    roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    found = table(roots.union(roots.select(F.col("root").alias("node"), "root").distinct()), "roots")
    forget(now)
    return found
