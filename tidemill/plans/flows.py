"""Queries for rules, checksums, change feeds, metrics, dead letters and workflows, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import hashing, rules
from tidemill.operators import dead_letters, windows, writes
from tidemill.operators.windows import epoch_ms
from tidemill.plans.catalogue import EVENTS, events, query, read
from tidemill.plans.workflow import Node, run_workflow
from tidemill.session import table
from tidemill.sources.metrics import flatten_metrics

_DAY = 86_400_000


def _bytes(text: str) -> str:
    return f"list_transform(string_split({text}, ''), lambda c: unicode(c)::hugeint)"


def _fnv(data: str) -> str:
    h = f"list_reduce([14695981039346656037::hugeint] || {data}, lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)"
    return f"(select cast(case when h >= 9223372036854775808 then h - 18446744073709551616 else h end as bigint) from (select {h} as h))"


@query("key_hash", f"select event_id, {_fnv('[2::hugeint] || ' + _bytes('event_type') + ' || [0::hugeint, 2::hugeint] || ' + _bytes('user_id::varchar'))} as key_hash from events")
def key_hash(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", hashing.key_hash("event_type", "user_id").alias("key_hash"))


_CUSTOMER_TEXT = "concat_ws('|', c_custkey, c_name, printf('%.2f', c_acctbal), c_mktsegment)"


@query("row_checksum", f"select c_custkey, {_fnv(_bytes(_CUSTOMER_TEXT))} as checksum from customer")
def row_checksum(spark, sf_dir):
    made = hashing.row_checksum("c_custkey", "c_name", "c_acctbal", "c_mktsegment", decimals={"c_acctbal": 2})
    return read(spark, sf_dir, "customer").select("c_custkey", made.alias("checksum"))


@query("settle_transform", "select o_orderkey, case when o_totalprice <= 20000 then 'REJECTED' when o_orderkey % 3 = 0 then 'SETTLED' when o_orderkey % 3 = 1 then 'REVIEW' else 'HOLD' end as settlement from orders")
def settle_transform(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", rules.settlement(F.col("o_totalprice") > 20000, F.col("o_orderkey") % 3).alias("settlement"))


@query("validate_amount", "select c_custkey, c_acctbal > 0 as valid from customer")
def validate_amount(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") > 0).alias("valid"))


_FRAUD_SQL = "select o_orderkey, least(1.0, case when o_totalprice / 50 > 2000 then 0.35::double else 0 end + case when o_custkey between 800 and 900 then 0.40::double else 0 end + case when o_totalprice / 50 > 4000 then 0.20::double else 0 end) as fraud_score, o_orderstatus from orders"


def _fraud(spark, sf_dir):
    score = rules.fraud_score(F.col("o_totalprice") / 50, F.concat(F.lit("C"), F.col("o_custkey").cast("string")))
    return read(spark, sf_dir, "orders").select("o_orderkey", score.alias("fraud_score"), "o_orderstatus")


@query("fraud_score", f"select o_orderkey, fraud_score from ({_FRAUD_SQL})")
def fraud_score(spark, sf_dir):
    return _fraud(spark, sf_dir).drop("o_orderstatus")


@query("approve_order", f"select o_orderkey, case when o_orderstatus <> 'P' and o_orderkey % 4 < 2 and fraud_score < 0.5 + 0.2 then 'approved' else 'rejected' end as status from ({_FRAUD_SQL})")
def approve_order(spark, sf_dir):
    stock = F.element_at(F.array(*[F.lit(x) for x in ("available", "low_stock", "out", "unknown")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return _fraud(spark, sf_dir).select("o_orderkey", rules.approval(F.col("o_orderstatus") != "P", stock, F.col("fraud_score")).alias("status"))


@query("audit_verdict", "select event_id, event_id % 3 < 2 and event_type in ('click', 'purchase') and event_id % 4 >= 1 as ok from events")
def audit_verdict(spark, sf_dir):
    op = F.element_at(F.array(F.lit("I"), F.lit("U"), F.lit("D")), (F.col("event_id") % 3 + 1).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", rules.well_formed_change(op, F.col("event_type"), F.col("event_id") % 4, ("click", "purchase")).alias("ok"))


@query("scalar_showcase", "select p_partkey, upper(p_name) as name, split_part(p_type, ' ', 1) as kind, round(p_retailprice / 7, 3) as seventh, p_size % 5 as rest, list_sum([p_size, 1, 2]) as total from part")
def scalar_showcase(spark, sf_dir):
    parts = F.array(F.col("p_size"), F.lit(1), F.lit(2))
    return read(spark, sf_dir, "part").select(
        "p_partkey", F.upper("p_name").alias("name"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("kind"), F.round(F.col("p_retailprice") / 7, 3).alias("seventh"),
        (F.col("p_size") % 5).alias("rest"), F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"),
    )


def _feed(spark, sf_dir):
    op = F.when(F.col("event_id") % 7 == 0, "D").otherwise("U")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("k"), "value", op.alias("__op"), F.expr("event_id div 10").alias("__lsn"), F.col("event_id").alias("__xid"), epoch_ms("ts").alias("__commit_ts"), F.lit("events").alias("__table")
    )


@query("cdc_metadata", "select k, value, __lsn, __xid from (select user_id as k, arg_max(value, event_id) as value, max(event_id) // 10 as __lsn, max(event_id) as __xid from events group by 1) where __xid % 7 <> 0")
def cdc_metadata(spark, sf_dir):
    none = _feed(spark, sf_dir).limit(0).drop("__op")
    return writes.apply_changes(none, _feed(spark, sf_dir), ["k"], ["__lsn", "__xid"]).select("k", "value", "__lsn", "__xid")


@query("cdc_trigger", "select user_id as k, arg_max(value, event_id) as value, max(event_id) as seq from events where event_id > 100 group by 1 having max(event_id) % 7 <> 0")
def cdc_trigger(spark, sf_dir):
    change = _feed(spark, sf_dir).filter(F.col("__xid") > 100).withColumnRenamed("__xid", "seq")
    return writes.compacted(change, ["k"], "seq", F.col("__op") == "D").select("k", "value", "seq")


@query(
    "otel_flatten",
    """
    select event_type as name, k.value, cast(event_id as bigint) as timestamp, k.kind, 'ms' as unit, null::varchar as description,
           case when k.kind = 'gauge' then '{"user":"' || user_id || '"}' end as attributes, '{"host":"h' || event_id % 3 || '"}' as resource_attributes,
           case when k.kind = 'histogram' then 4::bigint end as count, case when k.kind = 'histogram' then 1::bigint end as start_timestamp
    from (select *, unnest([{'kind': 'gauge', 'value': value}, {'kind': 'histogram', 'value': value * 2}]) as k from events)
    """,
)
def otel_flatten(spark, sf_dir):
    export = F.format_string(
        '{"resourceMetrics":[{"resource":{"attributes":[{"key":"host","value":{"stringValue":"h%s"}}]},"scopeMetrics":[{"metrics":['
        '{"name":"%s","unit":"ms","gauge":{"dataPoints":[{"timeUnixNano":"%s","asDouble":%s,"attributes":[{"key":"user","value":{"intValue":"%s"}}]}]}},'
        '{"name":"%s","unit":"ms","histogram":{"dataPoints":[{"timeUnixNano":"%s","startTimeUnixNano":"1","sum":%s,"count":"4"}]}}]}]}]}',
        (F.col("event_id") % 3).cast("string"), "event_type", F.col("event_id").cast("string"), F.col("value").cast("string"), F.col("user_id").cast("string"),
        "event_type", F.col("event_id").cast("string"), (F.col("value") * 2).cast("string"),
    )
    return flatten_metrics(read(spark, sf_dir, "events").select(export.alias("export")), "export")


@query("dlq_envelope", "select event_id, user_id, value from events")
def dlq_envelope(spark, sf_dir):
    kept = dead_letters.letters(read(spark, sf_dir, "events").select("event_id", "user_id", "value"), "flow", "table", "events", "the sink refused")
    return dead_letters.contents(table(kept, "letters"), "event_id long, user_id long, value double")


@query("channel_bridge", "select event_type, max(value) as top from events group by event_type")
def channel_bridge(spark, sf_dir):
    read(spark, sf_dir, "events").createOrReplaceTempView("tidemill_channel")
    return spark.sql("select event_type, max(value) as top from tidemill_channel group by event_type")


@query("checkpoint_roundtrip", "select o_custkey, count(*) as n from orders group by 1")
def checkpoint_roundtrip(spark, sf_dir):
    return table(read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")), "orders")


def _workflow(spark, sf_dir):
    size = lambda name, when: lambda x: x.filter(when).select("o_orderkey", F.lit(name).alias("sink"))
    return run_workflow([
        Node("orders", lambda: read(spark, sf_dir, "orders")),
        Node("net", lambda x: x.withColumn("net", F.col("o_totalprice") * 0.9), ("orders",), frozenset({"o_totalprice"})),
        Node("large", size("large", "net > 100000"), ("net",)),
        Node("all", size("all", "true"), ("net",)),
        Node("out", lambda x: x, ("large", "all")),
    ])


@query("workflow_dag", "select o_orderkey, 'large' as sink from orders where o_totalprice * 0.9 > 100000 union all select o_orderkey, 'all' from orders")
def workflow_dag(spark, sf_dir):
    return _workflow(spark, sf_dir)["out"]


@query("fan_out", "select count(*) as everything, count(*) filter (o_totalprice * 0.9 > 100000) as large from orders")
def fan_out(spark, sf_dir):
    sinks = _workflow(spark, sf_dir)["out"].groupBy().pivot("sink", ["all", "large"]).count()
    return sinks.select(F.col("all").alias("everything"), F.coalesce("large", F.lit(0)).alias("large"))


def _spread(group):
    import pyarrow as pa
    import pyarrow.compute as pc

    ends = pc.min_max(group.column("value")).as_py()
    first = [group.column(c)[0].as_py() for c in ("window_id", "event_type")]
    return pa.table({"window_id": [first[0]], "event_type": [first[1]], "spread": pa.array([ends["max"] - ends["min"]], pa.float64())})


@query("process_window", f"select cast(floor(ms / {_DAY}.0) as bigint) as window_id, event_type, max(value) - min(value) as spread from {EVENTS} group by all")
def process_window(spark, sf_dir):
    ids = windows.tumbling_id(F.col("ms"), _DAY)
    return windows.process_windows(events(spark, sf_dir).select("ms", "event_type", "value"), ids, ["event_type"], _spread, "window_id long, event_type string, spread double")


@query("window_close", f"select cast(floor(ms / {_DAY}.0) as bigint) as window_id, count(*) as n from {EVENTS} group by 1 having (window_id + 1) * {_DAY} <= (select max(ms) from {EVENTS})")
def window_close(spark, sf_dir):
    x = events(spark, sf_dir)
    groups = windows.windowed(x, windows.tumbling_id(F.col("ms"), _DAY), [], F.count(F.lit(1)).alias("n"))
    return windows.closed(groups.withColumn("end", (F.col("window_id") + 1) * _DAY), "end", x, "ms").drop("end")


@query("session_close", f"with s as (select *, cast(sum(fresh) over (partition by user_id order by ms rows unbounded preceding) as bigint) as session_id from (select *, case when ms - lag(ms) over (partition by user_id order by ms) > 3600000 then 1 else 0 end as fresh from {EVENTS})) select user_id, min(ms) as session_start_ms, max(ms) + 3600000 as session_end_ms from s group by user_id, session_id having max(ms) + 3600000 <= (select max(ms) from {EVENTS})")
def session_close(spark, sf_dir):
    x = events(spark, sf_dir)
    groups = windows.sessions(x, ["user_id"], "ms", 3600000).groupBy("user_id", "session_id").agg(F.min("ms").alias("session_start_ms"), (F.max("ms") + 3600000).alias("session_end_ms"))
    return windows.closed(groups.drop("session_id"), "session_end_ms", x, "ms")
