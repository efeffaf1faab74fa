"""Policies, settings, gates and write modes that no query shows."""

import pytest

from tidemill.operators import schemas, windows, writes
from tidemill.plans import stages
from tidemill.sources import formats, settings


def test_retry_policy_and_figures():
    assert stages.Retry(times=5, base=1, factor=10, cap=30).pauses() == [1, 10, 30, 30, 30]
    assert stages.Retry("fixed", times=2, base=1).pauses() == [1, 1] and stages.Retry("none").pauses() == []
    with pytest.raises(ValueError):
        stages.Retry("sometimes")
    left = [ValueError("one"), ValueError("two")]

    def call():
        if left:
            raise left.pop()
        return 7

    figures = stages.RunStats()
    assert stages.retrying(call, stages.Retry(base=0.001), figures) == 7 and figures.retries == 2
    with pytest.raises(ZeroDivisionError):
        stages.retrying(lambda: 1 // 0, stages.Retry(times=1, base=0.001))


def test_a_failed_pipeline_feeds_nothing_and_the_others_go_on():
    made = [stages.Pipeline("bad", lambda: 1 // 0), stages.Pipeline("after", lambda: 1, {"bad": "data"}), stages.Pipeline("good", lambda: 3)]
    stats = {}
    assert stages.run_schedule(made, retry=stages.Retry("none"), stats=stats, carry_on=True) == {"bad": None, "after": None, "good": 3}
    assert isinstance(stats["bad"].error, ZeroDivisionError) and stats["good"].rows == 3
    with pytest.raises(ZeroDivisionError):
        stages.run_schedule(made)


def test_settings_with_variables():
    text = '{"path": "${ROOT}/in", "sizes": ["${N:-4}", 5], "price": "$$3"}'
    assert settings.load(text, {"ROOT": "/data"}) == {"path": "/data/in", "sizes": ["4", 5], "price": "$3"}
    with pytest.raises(KeyError):
        settings.load(text, {})


def test_write_modes_without_order(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    twice = spark.createDataFrame([(3, "x"), (3, "y"), (1, "z")], "k long, v string").coalesce(1)
    with pytest.raises(Exception, match="repeats in the batch"):
        writes.upsert(base, twice, ["k"], None).collect()
    assert sorted(map(tuple, writes.upsert(base, twice.filter("v <> 'y'"), ["k"], None).collect())) == [(1, "z"), (2, "b"), (3, "x")]
    assert sorted(map(tuple, writes.ignore_conflicts(base, twice, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "x")]
    feed = spark.createDataFrame([(1, None, 1, "U"), (2, "q", 1, "U"), (2, None, 2, "D"), (9, "n", 1, "I")], "k long, v string, s int, __op string")
    assert sorted(map(tuple, writes.apply_changes(base, feed, ["k"], "s").collect()), key=str) == [(1, None), (9, "n")]


def test_types_are_required_and_overridden(spark):
    df = spark.createDataFrame([(1, 2.0, True)], "a long, b double, c boolean")
    for column, kind in (("a", "long"), ("b", "double"), ("c", "boolean")):
        schemas.require(df, column, kind)
        with pytest.raises(TypeError):
            schemas.require(df, column, "string")
    from pyspark.sql import types as T

    assert schemas.target_schema(df.schema, {"a": T.StringType()}).simpleString() == "struct<a:string,b:double,c:boolean>"
    with pytest.raises(KeyError):
        schemas.target_schema(df.schema, {"z": T.StringType()})


def test_formats_without_their_jar_say_so_and_json_is_inferred(spark, tmp_path):
    with pytest.raises(formats.ConnectorUnavailable):
        formats.read_files(spark, str(tmp_path), "avro")
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    formats.write_files(rows, f"{tmp_path}/json", "ndjson")
    assert sorted(map(tuple, formats.read_files(spark, f"{tmp_path}/json", "ndjson").collect())) == [(1, "a"), (2, None)]


def test_sessions_of_null_keys_go_on_too(spark):
    rows = [(None, 1), (None, 2), (None, 100), ("a", 1), ("a", 200), ("b", 5)]
    got = windows.sessions_across(spark.createDataFrame(rows, "k string, ms long"), ["k"], "ms", 10).collect()
    assert len(got) == 6 and {r.session_id for r in got} == set(range(5))


@pytest.mark.parametrize("first", [False, True])
@pytest.mark.parametrize("batches", [range(-5, 60), [0, 1, 2**40, 2**62, 2**62 + 1, -(2**63)], [None, 3, 4], [7], []])
def test_watermarks_in_ranges_of_batches(spark, batches, first):
    rows = [(b, (i * 37 + k * 911) % 500 if (i + k) % 7 else None) for i, b in enumerate(batches) for k in range(4)]
    order = sorted(batches, key=lambda b: (b is not None, b))
    want = []
    for b, t in rows:
        if t is not None:
            at = order.index(b) + first
            seen = [t for c, t in rows if t is not None and order.index(c) < at]
            mark = max(seen, default=None) if b is not None else None
            want.append((b, t, mark, mark is not None and 50 < mark and t < mark - 50))
    got = windows.late_split(spark.createDataFrame(rows, "b long, t long"), "b", "t", 50, first)
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select("b", "t", "watermark", "late").collect())


def test_batches_that_are_no_integers_are_refused(spark):
    with pytest.raises(ValueError, match="integer"):
        windows.late_split(spark.createDataFrame([("a", 1)], "b string, t long"), "b", "t", 1)


def test_window_ids_of_large_and_negative_times(spark):
    times = [-(2**62) - 1, -1001, -1000, -1, 0, 999, 1000, 2**53 + 1, 2**62 + 1]
    rows = spark.createDataFrame([(t,) for t in [*times, None]], "t long")
    from pyspark.sql import functions as F

    got = [tuple(r) for r in rows.select("t", windows.tumbling_id(F.col("t"), 3, 1)).collect()]
    assert got == [(t, (t - 1) // 3) for t in times] + [(None, None)]
