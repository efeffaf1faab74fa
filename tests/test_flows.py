import http.server
import threading

import pytest
from pyspark.sql import functions as F

from tidemill.functions import hashing, rules
from tidemill.operators import dead_letters
from tidemill.plans.workflow import Node, run_workflow
from tidemill.sources import http as http_source
from tidemill.streaming.runs import closing_windows, replay


def fnv(data):
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h - 2**64 if h >= 2**63 else h


def test_hash_of_bytes(spark):
    texts = ["", "a", "foobar", "é\x00ü", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(hashing.fnv1a_64(F.col("t"))).collect()]
    assert got == [None if t is None else fnv(t.encode()) for t in texts]
    rows = spark.createDataFrame([("a", None)], "a string, b int")
    assert rows.select(hashing.key_hash("a", "b")).first()[0] == fnv(b"\x02a\x00\x01")


def test_unknown_tier_is_an_error(spark):
    rows = spark.createDataFrame([(True, 7)], "valid boolean, tier int")
    with pytest.raises(Exception, match="unknown review tier 7"):
        rows.select(rules.settlement(F.col("valid"), F.col("tier"))).collect()


def test_refused_rows_come_back(spark, tmp_path):
    rows, kept, again = spark.range(10), str(tmp_path / "kept"), str(tmp_path / "again")

    def refuse(batch):
        raise OSError("no room")

    assert not dead_letters.guarded(refuse, kept, "w", "s", "c")(rows)
    found = spark.read.parquet(kept)
    assert found.agg(F.sum("rows")).first()[0] == 10 and found.first().reason == "no room"
    assert not dead_letters.replay_letters(spark, kept, again, "s", "id long", refuse)
    assert {r.replays for r in spark.read.parquet(again).collect()} == {1}
    written = []
    assert dead_letters.replay_letters(spark, again, again, "s", "id long", lambda b: written.extend(r.id for r in b.collect()))
    assert sorted(written) == list(range(10))


def test_workflow_refuses_cycles_and_missing_columns(spark):
    with pytest.raises(ValueError, match="cycle"):
        run_workflow([Node("a", lambda x: x, ("b",)), Node("b", lambda x: x, ("a",))])
    with pytest.raises(ValueError, match="unknown"):
        run_workflow([Node("a", lambda x: x, ("z",))])
    with pytest.raises(ValueError, match="brings"):
        run_workflow([Node("a", lambda: spark.range(1)), Node("b", lambda x: x, ("a",), frozenset({"v"}))])


def test_http_pages(spark):
    class Pages(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            if self.path == "/1":
                self.send_header("Link", '</2>; rel="next"')
            self.end_headers()
            self.wfile.write(f"x{self.path}\ny".encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        http_source.register(spark)
        reader = spark.read.format("tidemill_http").option("url", f"http://127.0.0.1:{server.server_port}/1").option("pagination", "link")
        assert sorted(r.value for r in reader.load().collect()) == ["x/1\ny", "x/2\ny"]
        assert sorted(r.value for r in reader.option("mode", "lines").load().collect()) == ["x/1", "x/2", "y", "y"]
    finally:
        server.shutdown()


def test_replay_feeds_every_file_once(spark, tmp_path):
    folder, seen = str(tmp_path / "in"), []
    spark.range(20).repartition(4).write.parquet(folder)
    run = replay(spark, folder, "id long", lambda batch, n: seen.append(sorted(r.id for r in batch.collect())), str(tmp_path / "mark"))
    run.awaitTermination(60)
    assert len(seen) == 4 and sorted(sum(seen, [])) == list(range(20))


def test_windows_close_once(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, second in enumerate((1, 2, 11, 35)):
        spark.sql(f"select timestamp_seconds({second}) as ts").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
    closed = closing_windows(stream, "ts", [], "10 seconds", "0 seconds", F.count(F.lit(1)).alias("n"))
    run = closed.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted(r.n for r in spark.read.parquet(out).collect()) == [1, 2]
