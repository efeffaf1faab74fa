"""The registered queries of the library and the SQL that checks each of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators import routing, schemas, windows, writes
from tidemill.operators.windows import epoch_ms

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "tpch_q1",
    """
    select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, sum(l_extendedprice) as sum_base_price,
           sum(l_extendedprice * (1 - l_discount)) as sum_disc_price,
           sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) as sum_charge,
           avg(l_quantity) as avg_qty, avg(l_extendedprice) as avg_price, avg(l_discount) as avg_disc, count(*) as count_order
    from lineitem where l_shipdate <= timestamp '1998-09-02' group by l_returnflag, l_linestatus
    """,
)
def tpch_q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        read(spark, sf_dir, "lineitem")
        .filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum("l_quantity").alias("sum_qty"),
            F.sum("l_extendedprice").alias("sum_base_price"),
            F.sum(price).alias("sum_disc_price"),
            F.sum(price * (1 + F.col("l_tax"))).alias("sum_charge"),
            F.avg("l_quantity").alias("avg_qty"),
            F.avg("l_extendedprice").alias("avg_price"),
            F.avg("l_discount").alias("avg_disc"),
            F.count(F.lit(1)).alias("count_order"),
        )
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("ms", epoch_ms("ts"))


#: The same in SQL.
EVENTS = "(select *, epoch_us(ts) // 1000 as ms from events)"


@query("tpch_q6", "select sum(l_extendedprice * l_discount) as revenue from lineitem where l_shipdate >= timestamp '1996-01-01' and l_shipdate < timestamp '1997-01-01' and l_discount between 0.05 and 0.07 and l_quantity < 24")
def tpch_q6(spark, sf_dir):
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    x = read(spark, sf_dir, "lineitem").filter((F.col("l_shipdate") >= day("1996-01-01")) & (F.col("l_shipdate") < day("1997-01-01")) & F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24))
    return x.agg(F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("revenue"))


@query("scan_parquet", "select o_orderkey, o_totalprice from orders")
def scan_parquet(spark, sf_dir):
    from tidemill.sources.formats import read_files

    return read_files(spark, f"{sf_dir}/orders.parquet", "parquet", T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_totalprice", T.DoubleType())]))


@query("project", "select c_custkey, c_name from customer")
def project(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", "c_name")


@query("derive_columns", "select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) as disc_price, l_extendedprice * (1 - l_discount) * (1 + l_tax) as charge from lineitem")
def derive_columns(spark, sf_dir):
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return read(spark, sf_dir, "lineitem").withColumns({"disc_price": price, "charge": price * (1 + F.col("l_tax"))}).select("l_orderkey", "l_linenumber", "disc_price", "charge")


@query("cast_safe", "select o_orderkey, try_cast(o_orderpriority as bigint) as o_orderpriority, try_cast(o_totalprice as bigint) as whole from orders where false union all select o_orderkey, try_cast(substr(o_orderpriority, 1, 1) as bigint), null from orders")
def cast_safe(spark, sf_dir):
    x = read(spark, sf_dir, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("o_orderpriority"), F.lit("x").alias("whole"))
    fields = [T.StructField(n, T.LongType()) for n in ("o_orderkey", "o_orderpriority", "whole")]
    return schemas.cast_to(x, T.StructType(fields), safe=True)


@query("cast_strict", "select cast(p_size as bigint) as p_size, p_partkey, cast(p_retailprice as varchar) is not null as priced from part")
def cast_strict(spark, sf_dir):
    x = schemas.cast_to(read(spark, sf_dir, "part"), T.StructType([T.StructField("p_size", T.LongType()), T.StructField("p_partkey", T.LongType()), T.StructField("p_retailprice", T.StringType())]), safe=False)
    return x.select("p_size", "p_partkey", F.col("p_retailprice").isNotNull().alias("priced"))


@query("sum_f64", "select coalesce(sum(value), 0) as total from events")
def sum_f64(spark, sf_dir):
    x = read(spark, sf_dir, "events")
    return x.agg(schemas.sum_f64(x, "value").alias("total"))


@query("filter_mask", "select event_id, value from events where value > 50 and event_type <> 'view'")
def filter_mask(spark, sf_dir):
    return read(spark, sf_dir, "events").filter((F.col("value") > 50) & (F.col("event_type") != "view")).select("event_id", "value")


@query("compact_alive", "select c_custkey from customer where c_acctbal >= 0")
def compact_alive(spark, sf_dir):
    return read(spark, sf_dir, "customer").withColumn("__alive", F.col("c_acctbal") >= 0).filter("__alive").select("c_custkey")


@query("fee_tier", "select o_orderkey, floor((o_totalprice * 25 / 10000 + 0.3) * 100 + 0.5) / 100 as fee, case when o_totalprice >= 200000 then 'REVIEW' when o_totalprice > 0 then 'SETTLED' else 'REJECTED' end as settlement from orders")
def fee_tier(spark, sf_dir):
    fee = F.floor((F.col("o_totalprice") * 25 / 10000 + 0.3) * 100 + 0.5) / 100
    tier = F.when(F.col("o_totalprice") >= 200000, "REVIEW").when(F.col("o_totalprice") > 0, "SETTLED").otherwise("REJECTED")
    return read(spark, sf_dir, "orders").select("o_orderkey", fee.alias("fee"), tier.alias("settlement"))


@query("fx_convert", "select o_orderkey, o_totalprice * case o_orderstatus when 'F' then 1.08 when 'O' then 1.27 else 1.0 end as usd from orders")
def fx_convert(spark, sf_dir):
    rates = F.create_map(F.lit("F"), F.lit(1.08), F.lit("O"), F.lit(1.27))
    return read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") * F.coalesce(rates[F.col("o_orderstatus")], F.lit(1.0))).alias("usd"))


@query("json_props", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_props(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


for _how, _sql in {
    "inner": "select c_custkey, o_orderkey from customer join orders on c_custkey = o_custkey",
    "left": "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey",
    "left_semi": "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey)",
    "left_anti": "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)",
}.items():

    def _join(spark, sf_dir, how=_how):
        x = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), how)
        return x.select("c_custkey", *([] if how in ("left_semi", "left_anti") else ["o_orderkey"]))

    query(f"join_{_how.removeprefix('left_')}", _sql)(_join)


@query("lookup_join", "with d as (select p_partkey, arg_max(p_size, p_partkey) as p_size from part where p_partkey % 3 <> 0 group by p_partkey) select l_orderkey, l_linenumber, coalesce(p_size, -1) as p_size from lineitem left join d on p_partkey = l_partkey")
def lookup_join(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    reference = read(spark, sf_dir, "part").filter("p_partkey % 3 <> 0")
    return routing.lookup(rows, reference, ["p_partkey"], "p_partkey", {"p_size": -1}).select("l_orderkey", "l_linenumber", "p_size")


_MINUTE = 60_000
for _kind, _sql in {"sum": "coalesce(sum(value), 0)", "min": "min(value)", "max": "max(value)", "count": "cast(count(*) as double)", "mean": "avg(value)"}.items():

    def _tumbling(spark, sf_dir, kind=_kind):
        return windows.windowed(events(spark, sf_dir), windows.tumbling_id(F.col("ms"), 10 * _MINUTE), ["event_type"], windows.reduction(kind, "value"))

    query(f"tumbling_{_kind}", f"select cast(floor(ms / 600000.0) as bigint) as window_id, event_type, {_sql} as {_kind}_value from {EVENTS} group by all")(_tumbling)


@query("sliding_sum", f"select w - j as window_id, event_type, sum(value) as sum_value from (select *, cast(floor(ms / 600000.0) as bigint) as w from {EVENTS}), (select unnest(range(0, 3)) as j) group by all")
def sliding_sum(spark, sf_dir):
    return windows.windowed(events(spark, sf_dir), windows.sliding_ids(F.col("ms"), 25 * _MINUTE, 10 * _MINUTE), ["event_type"], windows.reduction("sum", "value"))


@query("sliding_strict", f"select w - j as window_id, count(*) as n from (select *, cast(floor(ms / 600000.0) as bigint) as w from {EVENTS}), (select unnest(range(0, 3)) as j) where (w - j) * 600000 + 1500000 > ms group by all")
def sliding_strict(spark, sf_dir):
    return windows.windowed(events(spark, sf_dir), windows.sliding_ids(F.col("ms"), 25 * _MINUTE, 10 * _MINUTE, strict=True), [], F.count(F.lit(1)).alias("n"))


_SESSION_SQL = f"select *, cast(sum(fresh) over (partition by user_id order by ms rows unbounded preceding) as bigint) as session_id from (select *, case when ms - lag(ms) over (partition by user_id order by ms) > 3600000 then 1 else 0 end as fresh from {EVENTS})"


@query("session_windows", f"select user_id, session_id, min(ms) as session_start_ts, max(ms) as session_end_ts, count(*) as n, sum(value) as sum_value from ({_SESSION_SQL}) group by all")
def session_windows(spark, sf_dir):
    x = windows.sessions(events(spark, sf_dir), ["user_id"], "ms", 60 * _MINUTE)
    return x.groupBy("user_id", "session_id").agg(F.min("ms").alias("session_start_ts"), F.max("ms").alias("session_end_ts"), F.count(F.lit(1)).alias("n"), F.sum("value").alias("sum_value"))


@query("session_bounds", f"select user_id, min(ms) as session_start_ms, max(ms) + 3600000 as session_end_ms from ({_SESSION_SQL}) group by user_id, session_id")
def session_bounds(spark, sf_dir):
    x = windows.sessions(events(spark, sf_dir), ["user_id"], "ms", 60 * _MINUTE)
    return x.groupBy("user_id", "session_id").agg(F.min("ms").alias("session_start_ms"), (F.max("ms") + 60 * _MINUTE).alias("session_end_ms")).drop("session_id")


@query("window_bounds", f"select distinct cast(floor((ms - 5000) / 600000.0) as bigint) as window_id, cast(floor((ms - 5000) / 600000.0) as bigint) * 600000 + 5000 as start_ms, cast(floor((ms - 5000) / 600000.0) as bigint) * 600000 + 605000 as end_ms from {EVENTS}")
def window_bounds(spark, sf_dir):
    x = events(spark, sf_dir).select(windows.tumbling_id(F.col("ms"), 10 * _MINUTE, 5000).alias("window_id")).distinct()
    return x.select("window_id", (F.col("window_id") * 600000 + 5000).alias("start_ms"), (F.col("window_id") * 600000 + 605000).alias("end_ms"))


def _late_sql(frame: str) -> str:
    return f"""
    with e as (select *, event_id // 100 as batch, ms - (event_id * 7919 % 13) * 3600000 as late_ms from {EVENTS}),
    t as (select batch, max(late_ms) as top from e group by batch),
    m as (select batch, max(top) over (order by batch rows between unbounded preceding and {frame}) as mark from t)
    select event_id, coalesce(7200000 < mark and late_ms < mark - 7200000, false) as late from e left join m using (batch)
    """


for _name, _frame, _first in (("late_split", "1 preceding", False), ("late_split_advance_first", "current row", True)):

    def _late(spark, sf_dir, first=_first):
        x = events(spark, sf_dir).withColumn("batch", F.expr("event_id div 100")).withColumn("late_ms", F.expr("ms - (event_id * 7919 % 13) * 3600000"))
        return windows.late_split(x, "batch", "late_ms", 120 * _MINUTE, first).select("event_id", "late")

    query(_name, _late_sql(_frame))(_late)


@query("side_output", "select event_id from (" + _late_sql("1 preceding") + ") where late")
def side_output(spark, sf_dir):
    return queries()["late_split"](spark, sf_dir).filter("late").select("event_id")


@query("refire", f"select event_id // 500 as batch, cast(floor(ms / 86400000.0) as bigint) as window_id, event_type, count(*) as n, row_number() over (partition by cast(floor(ms / 86400000.0) as bigint), event_type order by event_id // 500) > 1 as again from {EVENTS} group by 1, 2, 3")
def refire(spark, sf_dir):
    x = events(spark, sf_dir).withColumn("batch", F.expr("event_id div 500")).withColumn("window_id", windows.tumbling_id(F.col("ms"), 1440 * _MINUTE))
    return windows.refire(x, "batch", ["window_id", "event_type"], F.count(F.lit(1)).alias("n"))


@query("cogroup_window", f"select cast(floor(ms / 86400000.0) as bigint) as window_id, user_id % 10 as region, count(*) filter (event_type = 'purchase') as payment_count, count(*) filter (event_type <> 'purchase') as order_count, coalesce(sum(value) filter (event_type = 'purchase'), 0) as payment_amount, coalesce(sum(value) filter (event_type <> 'purchase'), 0) as order_amount from {EVENTS} group by 1, 2")
def cogroup_window(spark, sf_dir):
    x = events(spark, sf_dir).withColumn("window_id", windows.tumbling_id(F.col("ms"), 1440 * _MINUTE)).withColumn("region", F.col("user_id") % 10)
    sides = routing.route_rows(x, {"payments": F.col("event_type") == "purchase"}, "orders")
    both = routing.fan_in(*[sides[s].select("window_id", "region", "value", F.lit(s).alias("side")) for s in ("payments", "orders")])
    side = lambda s: F.col("side") == s
    return both.groupBy("window_id", "region").agg(
        F.count(F.when(side("payments"), 1)).alias("payment_count"), F.count(F.when(side("orders"), 1)).alias("order_count"),
        F.coalesce(F.sum(F.when(side("payments"), F.col("value"))), F.lit(0.0)).alias("payment_amount"), F.coalesce(F.sum(F.when(side("orders"), F.col("value"))), F.lit(0.0)).alias("order_amount"),
    )


def _changes(spark, sf_dir):
    """A change feed made of events: each user's latest values, some of them deletions."""
    op = F.when(F.col("event_id") % 7 == 0, "D").when(F.col("event_id") % 2 == 0, "U").otherwise("I")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "value", F.col("event_id").alias("seq"), op.alias("__op"))


_BASE = "(select c_custkey as k, c_acctbal as value, cast(-1 as bigint) as seq from customer)"
_LAST = "(select user_id as k, arg_max(value, event_id) as value, max(event_id) as seq from events group by user_id)"


def _base(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("value"), F.lit(-1).cast("long").alias("seq"))


@query("sink_append", f"select * from {_BASE} union all select k + 1000000000, value, seq from {_BASE}")
def sink_append(spark, sf_dir):
    base = _base(spark, sf_dir)
    return writes.append(base, base.withColumn("k", F.col("k") + 1000000000), ["k"])


@query("sink_upsert", f"select * from {_LAST} union all select * from {_BASE} b where not exists (select 1 from {_LAST} l where l.k = b.k)")
def sink_upsert(spark, sf_dir):
    return writes.upsert(_base(spark, sf_dir), _changes(spark, sf_dir).drop("__op"), ["k"], "seq")


@query("sink_upsert_columns", f"select coalesce(b.k, l.k) as k, coalesce(l.value, b.value) as value, case when b.k is null then l.seq else b.seq end as seq from {_BASE} b full join {_LAST} l on b.k = l.k")
def sink_upsert_columns(spark, sf_dir):
    return writes.upsert(_base(spark, sf_dir), _changes(spark, sf_dir).drop("__op"), ["k"], "seq", ["value"])


@query("sink_ignore_conflicts", f"select * from {_BASE} union all select * from {_LAST} l where not exists (select 1 from {_BASE} b where l.k = b.k)")
def sink_ignore_conflicts(spark, sf_dir):
    return writes.ignore_conflicts(_base(spark, sf_dir), _changes(spark, sf_dir).drop("__op"), ["k"], "seq")


@query("cdc_apply_changes", f"select * from {_LAST} where seq % 7 <> 0 union all select * from {_BASE} b where not exists (select 1 from {_LAST} l where l.k = b.k)")
def cdc_apply_changes(spark, sf_dir):
    return writes.apply_changes(_base(spark, sf_dir), _changes(spark, sf_dir), ["k"], "seq")


@query("compacted_snapshot", f"select k, value, seq from {_LAST} where seq % 7 <> 0")
def compacted_snapshot(spark, sf_dir):
    return writes.compacted(_changes(spark, sf_dir), ["k"], "seq", F.col("__op") == "D").drop("__op")


@query("last_per_subject", "select event_type, max(event_id) as event_id from events group by event_type")
def last_per_subject(spark, sf_dir):
    return writes.latest(read(spark, sf_dir, "events"), ["event_type"], "event_id").select("event_type", "event_id")


@query("cursor_page", "select o_orderkey, o_orderdate from orders where o_orderdate > timestamp '1996-06-01' or (o_orderdate = timestamp '1996-06-01' and o_orderkey > 100) order by o_orderdate, o_orderkey limit 500")
def cursor_page(spark, sf_dir):
    x = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    import datetime

    return writes.cursor_page(x, "o_orderdate", "o_orderkey", (datetime.datetime(1996, 6, 1), 100), 500)


@query("kafka_tombstones", "select cast(c_custkey as varchar) as key, c_acctbal < 0 as gone from customer")
def kafka_tombstones(spark, sf_dir):
    x = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("name"))
    return writes.tombstones(x, ["c_custkey"]).select("key", F.col("value").isNull().alias("gone"))


@query("fan_in_union", "select c_nationkey as nation, count(*) as n from (select c_nationkey from customer union all select s_nationkey from supplier) group by 1")
def fan_in_union(spark, sf_dir):
    both = routing.fan_in(read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")), read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")))
    return both.groupBy("nation").agg(F.count(F.lit(1)).alias("n"))


@query("branch_routing", "select case when o_orderpriority like '1%' then 'fast' when o_totalprice > 100000 then 'large' else 'rest' end as branch, count(*) as n from orders group by 1")
def branch_routing(spark, sf_dir):
    routes = routing.route_rows(read(spark, sf_dir, "orders"), {"fast": F.col("o_orderpriority").startswith("1"), "large": F.col("o_totalprice") > 100000}, "rest")
    return routing.fan_in(*routes.values()).groupBy("branch").agg(F.count(F.lit(1)).alias("n"))


@query("key_partition", "select count(*) as n, count(distinct o_custkey) as keys from orders")
def key_partition(spark, sf_dir):
    parts = [routing.key_partition(read(spark, sf_dir, "orders"), ["o_custkey"], 4, i) for i in range(4)]
    return routing.fan_in(*parts).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("keys"))


@query("stage_plan", "select o_orderkey, o_totalprice * 0.9 as net, case when o_totalprice * 0.9 > 100000 then 'big' else 'small' end as tier from orders")
def stage_plan(spark, sf_dir):
    from tidemill.plans.stages import Transform, run_stages

    put = lambda c, e: lambda t: {"orders": t["orders"].withColumn(c, e)}
    on = lambda *names: frozenset(("orders", n) for n in names)
    plan = [
        Transform("net", on("o_totalprice"), on("net"), put("net", F.col("o_totalprice") * 0.9)),
        Transform("tier", on("net"), on("tier"), put("tier", F.when(F.col("net") > 100000, "big").otherwise("small"))),
    ]
    return run_stages(plan, {"orders": read(spark, sf_dir, "orders")})["orders"].select("o_orderkey", "net", "tier")


@query("settle_ledger", "select count(*) filter (o_totalprice > 50000) as settled_count, coalesce(sum(o_totalprice) filter (o_totalprice > 50000), 0) as settled_usd from orders")
def settle_ledger(spark, sf_dir):
    paid = F.when(F.col("o_totalprice") > 50000, F.col("o_totalprice"))
    return read(spark, sf_dir, "orders").agg(F.count(paid).alias("settled_count"), F.coalesce(F.sum(paid), F.lit(0.0)).alias("settled_usd"))


@query("top_n_per_group", "select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) <= 2")
def top_n_per_group(spark, sf_dir):
    return writes.first_rows(read(spark, sf_dir, "orders"), ["o_custkey"], F.desc("o_totalprice"), F.col("o_orderkey"), n=2).select("o_custkey", "o_orderkey")


@query("rollup_revenue", "select n_name, c_mktsegment, count(*) as n, sum(c_acctbal) as balance from customer join nation on c_nationkey = n_nationkey group by rollup (n_name, c_mktsegment)")
def rollup_revenue(spark, sf_dir):
    x = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return x.rollup("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("balance"))


@query("sorted_groups", "select event_type, count(*) as n from events group by event_type order by event_type nulls first")
def sorted_groups(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.asc_nulls_first("event_type"))
