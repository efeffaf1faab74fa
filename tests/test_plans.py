import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators import routing, schemas, windows, writes
from tidemill.plans.stages import Pipeline, Transform, run_schedule, schedule, stages
from tidemill.sources.formats import read_files, write_files


def transform(name, reads=(), writes=()):
    return Transform(name, frozenset(("t", r) for r in reads), frozenset(("t", w) for w in writes), lambda t: t)


def names(plan):
    return [[t.name for t in stage] for stage in plan]


def test_stages_follow_conflicts():
    a, b, c, d = transform("a", ["x"], ["y"]), transform("b", ["x"], ["z"]), transform("c", ["y"], ["w"]), transform("d", ["*"], [])
    assert names(stages([a, b, c, d])) == [["a", "b"], ["c"], ["d"]]
    with pytest.raises(ValueError, match="no field"):
        stages([a], {"t": ["y"]})


def test_schedule_skips_after_nothing():
    ran = []

    def run(name, rows):
        return lambda: ran.append(name) or rows

    plan = [Pipeline("a", run("a", 0)), Pipeline("b", run("b", 1), {"a": "data"}), Pipeline("c", run("c", 1), {"b": "data"}), Pipeline("d", run("d", 2), {"a": "order"})]
    assert run_schedule(plan) == {"a": 0, "b": None, "c": None, "d": 2}
    assert ran == ["a", "d"]
    with pytest.raises(ValueError, match="cycle"):
        schedule([Pipeline("a", run("a", 1), {"b": "data"}), Pipeline("b", run("b", 1), {"a": "data"})])


def test_retry():
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("again")
        return 5

    assert run_schedule([Pipeline("a", flaky)], retries=2) == {"a": 5}


def test_batch_routing():
    edges = {"e1": "x", "e2": "y", "e3": None}
    assert routing.route_batch(None, edges) == ["e1", "e2", "e3"]
    assert routing.route_batch(["y"], edges) == ["e2"]


def test_tumbling_floors_negative_times(spark):
    rows = spark.createDataFrame([(-1,), (0,), (-1000,), (-1001,), (999,)], "ms long")
    assert [r[0] for r in rows.select(windows.tumbling_id(F.col("ms"), 1000)).collect()] == [-1, 0, -1, -2, 0]


def test_reductions_of_nulls(spark):
    row = spark.createDataFrame([(None,), (None,)], "v double").agg(*[windows.reduction(k, "v") for k in ("sum", "min", "max", "count", "mean")]).first()
    assert row[:4] == (0.0, float("inf"), float("-inf"), 2.0) and row[4] != row[4]


def test_session_keeps_equal_gap(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 10), ("a", 21), ("a", None)], "k string, ms long")
    got = windows.sessions(rows, ["k"], "ms", 10).orderBy("ms").collect()
    assert [r.session_id for r in got] == [0, 0, 1]


def test_append_refuses_known_keys(spark):
    base = spark.createDataFrame([(1, "a")], "k long, v string")
    with pytest.raises(ValueError, match="there already"):
        writes.append(base, base, ["k"])


def test_casts(spark):
    rows = spark.createDataFrame([("1", "x"), ("z", "y")], "a string, b string")
    target = T.StructType([T.StructField("a", T.IntegerType())])
    assert [r.a for r in schemas.cast_to(rows, target).collect()] == [1, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        schemas.cast_to(rows, target, safe=False).collect()
    with pytest.raises(ValueError, match="missing"):
        schemas.cast_to(rows, T.StructType([T.StructField("c", T.IntegerType())]))


def test_fingerprint_ignores_types():
    one = schemas.ComponentSpec("n", T.StructType([T.StructField("a", T.LongType())]))
    two = schemas.ComponentSpec("n", T.StructType([T.StructField("a", T.StringType())]))
    assert schemas.fingerprint([one]) == schemas.fingerprint([two]) != schemas.fingerprint([schemas.ComponentSpec("n", one.schema, 2)])


@pytest.mark.parametrize("format", ["csv", "ndjson", "parquet", "orc"])
def test_file_round_trip(spark, tmp_path, format):
    rows = spark.createDataFrame([(1, 0.5), (2, None), (3, -1.0)], "id long, val double")
    write_files(rows, str(tmp_path / "f"), format)
    write_files(rows, str(tmp_path / "f"), format)
    assert read_files(spark, str(tmp_path / "f"), format, rows.schema).count() == 6
    write_files(rows, str(tmp_path / "f"), format, truncate=True)
    assert sorted(map(tuple, read_files(spark, str(tmp_path / "f"), format, rows.schema).collect())) == sorted(map(tuple, rows.collect()))
