"""Queries for set operations, key hashes, accumulators, context, units, formats and replay, with their SQL."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions import rules
from tidemill.operators import routing, windows, writes
from tidemill.plans.catalogue import EVENTS, events, query, read
from tidemill.plans.flows import _bytes, _fnv
from tidemill.session import scratch, ship, table
from tidemill.sources import formats
from tidemill.streaming import runs

_HOUR, _DAY = 3_600_000, 86_400_000
_USER_HASH = _fnv("[2::hugeint] || " + _bytes("user_id::varchar"))


@query("table_diff", """
with a as (select user_id, event_type from events where event_id % 3 > 0), b as (select user_id, event_type from events where event_id % 4 > 0)
select *, 'left' as side from (select * from a except all select * from b) union all
select *, 'right' as side from (select * from b except all select * from a)
""")
def table_diff(spark, sf_dir):
    x = read(spark, sf_dir, "events")
    return routing.table_diff(x.filter("event_id % 3 > 0").select("user_id", "event_type"), x.filter("event_id % 4 > 0").select("user_id", "event_type"))


for _name, _word, _method in (("set_intersect", "intersect", "intersect"), ("set_except", "except", "subtract"), ("set_intersect_all", "intersect all", "intersectAll")):

    def _sets(spark, sf_dir, method=_method):
        x = read(spark, sf_dir, "events")
        side = lambda kind: x.filter(F.col("event_type") == kind).select("user_id")
        return getattr(side("purchase"), method)(side("click"))

    query(_name, f"select user_id from events where event_type = 'purchase' {_word} select user_id from events where event_type = 'click'")(_sets)


@query("cube_counts", "select l_returnflag, l_linestatus, count(*) as n, count(distinct l_suppkey) as suppliers from lineitem group by cube (l_returnflag, l_linestatus)")
def cube_counts(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("approx_distinct_error", "select true as near_enough")
def approx_distinct_error(spark, sf_dir):
    """Whether the approximate number of users is within 15 % of the exact one."""
    found = read(spark, sf_dir, "events").agg(F.approx_count_distinct("user_id", 0.02).alias("a"), F.countDistinct("user_id").alias("n"))
    return found.select((F.abs(F.col("a") - F.col("n")) <= 0.15 * F.col("n")).alias("near_enough"))


@query("join_anti_rows", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)")
def join_anti_rows(spark, sf_dir):
    large = read(spark, sf_dir, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").select("c_custkey").join(large, "c_custkey", "left_anti")


@query("tumbling_key_hash", f"select cast(floor(ms / {_DAY}.0) as bigint) as window_id, {_USER_HASH} as key_hash, coalesce(sum(value), 0) as sum_value, count(*)::double as count_value from {EVENTS} group by 1, 2")
def tumbling_key_hash(spark, sf_dir):
    return windows.hashed_windows(events(spark, sf_dir), windows.tumbling_id(F.col("ms"), _DAY), ["user_id"], windows.reduction("sum", "value"), windows.reduction("count", "value"))


@query("reductions_of_nulls", f"""
select cast(floor(ms / {_DAY}.0) as bigint) as window_id, event_type, coalesce(sum(v), 0) as sum_v, coalesce(min(v), 'inf'::double) as min_v,
       coalesce(max(v), '-inf'::double) as max_v, count(*)::double as count_v, coalesce(avg(v), 'nan'::double) as mean_v
from (select *, case when event_type <> 'click' then value end as v from {EVENTS}) group by 1, 2
""")
def reductions_of_nulls(spark, sf_dir):
    x = events(spark, sf_dir).withColumn("v", F.when(F.col("event_type") != "click", F.col("value")))
    return windows.windowed(x, windows.tumbling_id(F.col("ms"), _DAY), ["event_type"], *[windows.reduction(k, "v") for k in ("sum", "min", "max", "count", "mean")])


@query("session_ids_across", f"""
with e as (select *, {_USER_HASH} as key_hash from {EVENTS}),
m as (select *, coalesce((ms - lag(ms) over (partition by user_id order by ms) > {12 * _HOUR})::bigint, 1) as fresh from e)
select event_id, key_hash, cast(sum(fresh) over (order by key_hash, ms rows unbounded preceding) - 1 as bigint) as session_id from m
""")
def session_ids_across(spark, sf_dir):
    return windows.sessions_across(events(spark, sf_dir), ["user_id"], "ms", 12 * _HOUR).select("event_id", "key_hash", "session_id")


_RUN = f"select cast(floor(ms / {_DAY}.0) as bigint) as window_id, {_fnv('[2::hugeint] || ' + _bytes('event_type'))} as key_hash, sum(value) as s from {EVENTS} where event_id % 2 = "


@query("window_accumulator", f"""
with a as ({_RUN} 0 group by 1, 2), b as ({_RUN} 1 and event_type <> 'view' group by 1, 2),
u as (select *, 1 as run from a union all select *, 2 as run from b)
select 'events' as component, window_id, key_hash, arg_max(s, run) as sum_f64, 1::bigint as count, null::double as min_f64, null::double as max_f64 from u group by window_id, key_hash
""")
def window_accumulator(spark, sf_dir):
    state = spark.createDataFrame([], windows.ACCUMULATOR)
    x = events(spark, sf_dir)
    for part in (x.filter("event_id % 2 = 0"), x.filter("event_id % 2 = 1 and event_type <> 'view'")):
        results = windows.hashed_windows(part, windows.tumbling_id(F.col("ms"), _DAY), ["event_type"], F.sum("value").alias("sum_value"))
        state = table(windows.flush(state, results, "events", "sum_value"), "accumulator")
    return state


@query("window_context", f"""
select window_id, window_id * {_DAY} as window_start, (window_id + 1) * {_DAY} as window_end, count(*) as n, count(*) filter (ms < {20_000 * _DAY}) as late
from (select *, cast(floor((ms - 5000) / {_DAY}.0) as bigint) as window_id from {EVENTS}) group by window_id
""")
def window_context(spark, sf_dir):
    def summed(group: pa.Table) -> pa.Table:
        first = {name: group.column(name)[0].as_py() for name in ("window_id", "window_start", "window_end")}
        return pa.Table.from_pylist([{**first, "n": group.num_rows, "late": pc.sum(group.column("late")).as_py() or 0}])

    x = events(spark, sf_dir).select("ms", "event_type")
    return windows.process_windows(x, windows.tumbling_id(F.col("ms"), _DAY, 5000), [], summed, "window_id long, window_start long, window_end long, n long, late long", size=_DAY, ms="ms", watermark=20_000 * _DAY)


@query("time_units", "select event_id, x * 1000 as s, x as ms, cast(trunc(x / 1000.0) as bigint) as us, cast(trunc(x / 1000000.0) as bigint) as ns from (select event_id, (event_id - 300) * 1234567 as x from events)")
def time_units(spark, sf_dir):
    x = read(spark, sf_dir, "events").select("event_id", ((F.col("event_id") - 300) * 1234567).cast("long").alias("x"))
    return x.select("event_id", *[windows.to_ms("x", unit).alias(unit) for unit in ("s", "ms", "us", "ns")])


@query("fee_signed", "select c_custkey, sign(x) * floor(abs(x) + 0.5) / 100 as fee from (select c_custkey, (c_acctbal * 25 / 10000 + 0.3) * 100 as x from customer)")
def fee_signed(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", rules.fee(F.col("c_acctbal"), 25, 0.3).alias("fee"))


_BASE = "(select c_custkey as k, c_acctbal as value from customer where c_custkey % 2 = 0)"


def _halves(spark, sf_dir):
    return read(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("value"))


@query("upsert_unique", f"select c_custkey as k, c_acctbal + 1 as value from customer where c_custkey % 3 = 0 union all select * from {_BASE} where k % 3 <> 0")
def upsert_unique(spark, sf_dir):
    batch = read(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") + 1).alias("value"))
    return writes.upsert(_halves(spark, sf_dir), batch, ["k"], None)


@query("ignore_first_row", f"select * from {_BASE} union all select user_id, arg_min(value, event_id) from events where user_id not in (select k from {_BASE}) group by user_id")
def ignore_first_row(spark, sf_dir):
    batch = read(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "value")
    return writes.ignore_conflicts(_halves(spark, sf_dir), batch, ["k"])


@query("change_metadata", """
select user_id as k, arg_max(value, event_id) as value, max(event_id) as seq, arg_max(case when event_id % 2 = 0 then 'U' else 'I' end, event_id) as __op, 'events' as __table,
       arg_max(ts, event_id) as __commit_ts from events group by user_id
""")
def change_metadata(spark, sf_dir):
    """The last change of each key with what a logical feed says of it."""
    op = F.when(F.col("event_id") % 2 == 0, "U").otherwise("I")
    feed = read(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "value", F.col("event_id").alias("seq"), op.alias("__op"), F.lit("events").alias("__table"), F.col("ts").alias("__commit_ts"))
    return writes.latest(feed, ["k"], "seq")


@query("kafka_values", "select cast(c_custkey as varchar) as key, c_custkey, c_name, c_nationkey from customer")
def kafka_values(spark, sf_dir):
    """Messages of a keyed topic, read back from their JSON."""
    sent = writes.tombstones(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), ["c_custkey"])
    value = F.from_json("value", "c_custkey long, c_name string, c_nationkey long")
    return sent.select("key", value.alias("v")).select("key", "v.*")


@query("channel_batches", "select event_id % 4 as part, count(*) as n, sum(value) as total from events group by 1")
def channel_batches(spark, sf_dir):
    """Four batches that a channel joins to one table, counted by batch."""
    x = read(spark, sf_dir, "events").select((F.col("event_id") % 4).alias("part"), "value")
    return routing.fan_in(*[x.filter(F.col("part") == k) for k in range(4)]).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("row_transform", "select event_id, upper(event_type) || '-' || user_id as label from events")
def row_transform(spark, sf_dir):
    """A user's function over Arrow batches."""

    def labelled(batches):
        for b in batches:
            label = pc.binary_join_element_wise(pc.utf8_upper(b.column(1)), b.column(2).cast(pa.string()), "-")
            yield pa.RecordBatch.from_arrays([b.column(0), label], ["event_id", "label"])

    return read(spark, sf_dir, "events").select("event_id", "event_type", "user_id").mapInArrow(labelled, "event_id long, label string")


@query("table_function", f"select event_id, unnest(range(w - 2, w + 1)) as window_id from (select event_id, cast(floor(ms / {8 * _HOUR}.0) as bigint) as w from {EVENTS})")
def table_function(spark, sf_dir):
    """A user's table function: the sliding windows of a time, one row each."""

    @F.udtf(returnType="window_id: bigint")
    class SlidingIds:
        def eval(self, ms: int, size: int, slide: int):
            last = ms // slide
            for k in range(last - -(-size // slide) + 1, last + 1):
                yield (k,)

    x = events(spark, sf_dir).select("event_id", "ms")
    return x.lateralJoin(SlidingIds(F.col("ms").outer(), F.lit(24 * _HOUR), F.lit(8 * _HOUR))).select("event_id", "window_id")


for _format in ("csv", "ndjson", "parquet", "orc"):

    def _round_trip(spark, sf_dir, format=_format):
        rows = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
        path = scratch(spark, f"trip-{format}")
        formats.write_files(rows, path, format)
        return formats.read_files(spark, path, format, T.StructType(rows.schema.fields))

    query(f"file_roundtrip_{_format}", "select c_custkey, c_name, c_acctbal, c_mktsegment from customer")(_round_trip)


@query("file_roundtrip_arrow_ipc", "select c_custkey, c_name, c_acctbal, c_mktsegment from customer")
def file_roundtrip_arrow_ipc(spark, sf_dir):
    ship(spark)
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return formats.from_ipc(table(formats.to_ipc(rows), "ipc"), rows.schema)


@query("stream_replay", f"select cast(floor(ms / {_DAY}.0) as bigint) as window_id, count(*) as n, sum(value) as total from {EVENTS} group by 1")
def stream_replay(spark, sf_dir):
    """Events as four files, replayed file by file; each batch appends its partial sums."""
    x = events(spark, sf_dir).select("ms", "value", "event_id").filter("ms is not null")
    source = table(x.repartition(4, "event_id"), "feed")
    partial = scratch(spark, "partial")

    def add(batch, _):
        found = windows.windowed(batch, windows.tumbling_id(F.col("ms"), _DAY), [], F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        found.write.mode("append").parquet(partial)

    runs.replay(spark, vars(source)["_tidemill_path"], source.schema, add, scratch(spark, "replay")).awaitTermination()
    parts = spark.read.schema("window_id long, n long, total double").parquet(partial)
    return parts.groupBy("window_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
