"""Paged sources and keyed streaming state."""

import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.sources import paged
from lodestone.streaming import latest

SF = "/root/testdata/sf0.001"


@pytest.fixture
def server():
    """Rows behind HTTP; each page whose offset is in ``bad`` fails so many times."""
    asked, state = Counter(), {"rows": [{"n": i, "text": f"t{i} é"} for i in range(57)], "bad": {20: 1}, "short": set()}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            offset, length = int(q["offset"]), int(q["length"])
            asked[offset, length] += 1
            if state["bad"].get(offset, 0) > 0 and length > 1:
                state["bad"][offset] -= 1
                self.send_error(503)
                return
            rows = [{"row_idx": offset + i, "row": r} for i, r in enumerate(state["rows"][offset : offset + length])]
            body = json.dumps({"rows": rows[:-1] if offset in state["short"] else rows, "num_rows_total": len(state["rows"])}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/rows", state, asked
    s.shutdown()


def test_pages_come_once_though_one_fails(spark, server):
    url, state, asked = server
    options = {"url": url, "dataset": "d", "page": "10", "pause": "0.01"}
    df = paged.read(spark, **options)
    assert df.rdd.getNumPartitions() == 6
    rows = df.collect()
    assert [r.row_idx for r in sorted(rows)] == list(range(57)) and json.loads(sorted(rows)[20].row) == {"n": 20, "text": "t20 é"}
    assert asked[20, 10] == 2 and asked[30, 10] == 1
    assert sorted(r.row_idx for r in paged.resumed(spark, df.limit(50), **options).collect()) == list(range(50, 57))
    assert paged.read(spark, **options, start="57").collect() == []


@pytest.mark.parametrize("start", [0, 95])
def test_runs_of_pages_read_each_row_group_once(spark, tmp_path, monkeypatch, start):
    monkeypatch.setattr(paged, "RUN", 3)
    for i, (n, group) in enumerate([(95, 40), (7, 7), (310, 100), (0, 1), (3, 3)]):
        pq.write_table(pa.table({"n": pa.array(range(i * 1000, i * 1000 + n), pa.int64())}), f"{tmp_path}/part-{i}.parquet", row_group_size=group)
    options = {"fetcher": "lodestone.sources.paged:file_pages", "path": str(tmp_path), "page": "10", "start": str(start)}
    expected = [i * 1000 + k for i, n in enumerate([95, 7, 310, 0, 3]) for k in range(n)]
    rows = sorted(paged.read(spark, **options).collect())
    assert [(r.row_idx, json.loads(r.row)["n"]) for r in rows] == list(enumerate(expected))[start:]
    runs = paged._Pages(options).runs(start, len(expected))
    assert sum(r.length for r in runs) == len(expected) - start and len(runs) < 10
    groups = Counter((s[2], s[3]) for r in runs for s in r.spans)
    assert max(groups.values()) <= 2 and sum(groups.values()) <= len(groups) + len(runs) - 1
    many = paged._Pages({"page": "10"} | {"fetcher": "lodestone.sources.paged:http_pages"}).runs(0, 100_000)
    assert len(many) < 10_000 and sum(r.length for r in many) == 100_000


def test_a_page_that_fails_twice_or_is_short_fails_the_read(spark, server):
    url, state, _ = server
    options = {"url": url, "page": "10", "pause": "0.01"}
    state["bad"][40] = 1000
    with pytest.raises(Exception, match="503"):
        paged.read(spark, **options).collect()
    state["bad"], state["short"] = {}, {10}
    with pytest.raises(Exception, match="has 9 rows"):
        paged.read(spark, **options).collect()


def test_pages_as_a_stream_go_on_where_they_stopped(spark, server, tmp_path):
    url, state, _ = server
    run = lambda: paged.read_stream(spark, url=url, page="10", pause="0.01").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="1 second").start()

    def until(n):
        q = run()
        try:
            for _ in range(60):
                q.processAllAvailable()
                if spark.read.schema(paged.SCHEMA).parquet(f"{tmp_path}/out").count() >= n:
                    break
        finally:
            q.stop()
        assert sorted(r.row_idx for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(n))

    until(57)
    state["rows"] += [{"n": i} for i in range(57, 80)]
    until(80)


def test_latest_versions_of_shuffled_files_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select(F.col("user_id").cast("string").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("id"))
    events.orderBy(F.xxhash64("id")).repartition(4).write.parquet(f"{tmp_path}/in")
    want = {tuple(r) for r in events.groupBy("key").agg(F.max(F.struct("at", "id")).alias("t")).select("key", "t.at", "t.id").collect()}
    stream = lambda: spark.readStream.schema("key string, at long, id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = lambda: latest.start(latest.latest(stream()), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    run()
    got = lambda: {tuple(r) for r in latest.current(spark, f"{tmp_path}/out").collect()}
    assert got() == want
    before = spark.read.parquet(f"{tmp_path}/out").count()
    run()  # again from the checkpoint: nothing new
    assert got() == want and spark.read.parquet(f"{tmp_path}/out").count() == before
    key = sorted(want)[0][0]
    spark.createDataFrame([(key, 1, 1), ("new", 5, 7), ("new", 5, 8), ("new", 4, 9)], "key string, at long, id long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()  # a late row changes nothing, a new key comes in once
    assert got() == want | {("new", 5, 8)} and spark.read.parquet(f"{tmp_path}/out").count() == before + 1


def test_a_quiet_key_is_forgotten(spark, tmp_path):
    add = lambda *rows: spark.createDataFrame(rows, latest.VERSIONS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    add(("a", 9, 1))
    q = latest.start(latest.latest(spark.readStream.schema(latest.VERSIONS).parquet(f"{tmp_path}/in"), ttl=1), f"{tmp_path}/out", f"{tmp_path}/cp", every="1 second")
    rows = lambda: spark.read.schema(latest.VERSIONS).parquet(f"{tmp_path}/out").count() if (tmp_path / "out").exists() else 0

    def until(n):
        for _ in range(40):
            if rows() >= n:
                return
            time.sleep(1)

    try:
        until(1)
        time.sleep(4)
        add(("a", 2, 5))  # older than what was forgotten, so it is the latest known again
        until(2)
    finally:
        q.stop()
    assert rows() == 2
