import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tidemill.functions import status
from tidemill.operators import progress
from tidemill.streaming import io, state


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, state.ROCKSDB)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set(name, before) if before else spark.conf.unset(name)


def feed(spark, tmp_path, schema, batches):
    """A stream with one micro-batch for each list of rows."""
    folder = tmp_path / "in"
    folder.mkdir()
    names = [c.split()[0] for c in schema.split(", ")]
    for i, rows in enumerate(batches):
        file = folder / f"{i}.json"
        file.write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in rows))
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))  # the order of the batches
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def drain(df, name, tmp_path, mode="append", rows=None):
    """All output rows; with `rows` the run is stopped once there are so many, as processing-time state never idles."""
    run = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    until = time.monotonic() + 60
    while time.monotonic() < until and not run.awaitTermination(1):
        if rows is not None and df.sparkSession.table(name).count() >= rows:
            run.stop()
    return df.sparkSession.table(name).collect()


def test_blocks(spark, tmp_path, rocksdb):
    lines = [["frame=100", "speed=1.5x"], ["progress=continue", "frame=N/A", "junk"], ["progress=end", "frame=9", "progress=continue"]]
    batches, n = [], 0
    for part in lines:
        batches.append([("s", n + i, v) for i, v in enumerate(part)])
        n += len(part)
    got = drain(state.blocks(feed(spark, tmp_path, "source string, line_no long, line string", batches)), "b", tmp_path)
    assert sorted((r.block, r.frame, r.speed, r.progress) for r in got) == [(0, 100, 1.5, "continue"), (1, None, None, "end")]


def test_blocks_as_a_table_gives_them(spark, tmp_path, rocksdb):
    lines = ["frame=1", "out_time_us=7", "out_time_ms=8", "total_size=9", "fps=0.5", "progress=continue", " speed=2x ", "out_time=0:1", "out_time=N/A", "progress=continue", "frame=bad", "progress=end", "frame=4", "progress=end"]
    rows = [(k, i, v) for k in ("a", "b") for i, v in enumerate(lines)]
    schema = "source string, line_no long, line string"
    got = drain(state.blocks(feed(spark, tmp_path, schema, [rows[:5] + rows[14:16], rows[5:9] + rows[16:27], rows[9:14] + rows[27:]]), strict=False), "bt", tmp_path)
    table = progress.block_fields(spark.createDataFrame(rows, schema), "source", ["line_no"], strict=False)
    assert sorted(map(str, got)) == sorted(map(str, table.collect())) and len(got) == 6


def test_pauses(spark, tmp_path, rocksdb):
    s = 1_000_000
    batches = [[("u", 0, 0, True), ("u", 1, 9 * s, True)], [("u", 2, 15 * s, False), ("u", 3, 20 * s, False), ("w", 4, 1, False)]]
    got = drain(state.paused(feed(spark, tmp_path, "url string, seq long, ts_us long, is_pause boolean", batches)), "p", tmp_path, rows=5)
    assert {r.seq: r.paused for r in got} == {0: False, 1: True, 2: True, 3: False, 4: False}


def test_latest_and_distinct(spark, tmp_path):
    batches = [[(0, 1, 10, 1, 1), (1, 5, 10, 1, 2)], [(0, 7, 10, 2, 3), (0, 3, 10, 1, 4)]]
    rows = feed(spark, tmp_path, "url_index int, downloaded long, total long, at long, seq long", batches).withColumn("ts", F.timestamp_seconds("at"))
    got = drain(state.latest(rows), "l", tmp_path, "complete")
    assert sorted(map(tuple, got)) == [(0, 7, 10), (1, 5, 10)]
    (tmp_path / "d").mkdir()
    urls = feed(spark, tmp_path / "d", "url string, seq long", [[("a", 0), ("b", 1)], [("a", 2)]])
    assert sorted(r.url for r in drain(state.distinct_urls(urls), "d", tmp_path / "d")) == ["a", "b"]


def test_distinct_within_a_delay(spark, tmp_path):
    batches = [[("a", 100), ("b", 100), ("a", 101)], [("a", 105), ("c", 200)], [("d", 201)], [("a", 300), ("late", 100)]]
    rows = feed(spark, tmp_path, "url string, at long", batches).withColumn("ts", F.timestamp_seconds("at"))
    got = drain(state.distinct_urls(rows, "10 seconds"), "dd", tmp_path)
    assert sorted((r.url, r["at"]) for r in got) == [("a", 100), ("a", 300), ("b", 100), ("c", 200), ("d", 201)]  # the late row is dropped


def test_pauses_end_by_timers(spark, tmp_path, rocksdb):
    # u is set anew before its end, w once; nothing more comes for either, and x is later than the watermark
    batches = [[("u", 0, 100), ("w", 1, 101)], [("u", 2, 105)], [("z", 3, 200)], [("z", 4, 201)], [("x", 5, 20), ("z", 6, 300)]]
    rows = feed(spark, tmp_path, "url string, seq long, at long", batches).withColumn("ts", F.timestamp_seconds("at"))
    got = drain(state.pause_events(rows, 10, "5 seconds"), "pe", tmp_path)
    events = sorted((r.url, r.at_ms // 1000, r.what) for r in got)
    assert [e for e in events if e[0] in "uwx"] == [("u", 100, "pause"), ("u", 105, "pause"), ("u", 115, "resume"), ("w", 101, "pause"), ("w", 111, "resume")]


def test_log_lines(spark, tmp_path, rocksdb):
    """A log in three pieces, one a micro-batch, with a restart after each."""
    folder = tmp_path / "logs"
    folder.mkdir()
    pieces = [["frame=1", "progress=continue"], ["frame=2", "# none", "video-1_2"], ["progress=end", "frame=3"]]
    for i, lines in enumerate(pieces):
        (folder / f"a.log.{i}").write_text("\n".join(lines) + "\n")
        (folder / f"b.log.{i}").write_text("\n".join(lines[:1]) + "\n")
        out = io.log_lines(spark, str(folder)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        assert out.trigger(availableNow=True).start().awaitTermination(60)
    rows = spark.read.parquet(str(tmp_path / "out"))
    got = {(r.source[-5:], r.line_no): r.line for r in rows.collect()}
    whole = sum(pieces, [])
    assert got == {("a.log", i): v for i, v in enumerate(whole)} | {("b.log", i): p[0] for i, p in enumerate(pieces)}
    assert [(r.pos, r.line, r.valid) for r in io.url_list(rows).where("source LIKE '%a.log'").orderBy("pos").collect() if r.valid] == [(4, "video-1_2", True)]


def test_lines_to_blocks(spark, tmp_path, rocksdb):
    folder = tmp_path / "logs"
    folder.mkdir()
    for i, lines in enumerate([["frame=1", "frame=2"], ["progress=continue", "frame=7"], ["progress=end"]]):
        (folder / f"a.log.{i}").write_text("\n".join(lines) + "\n")
        os.utime(folder / f"a.log.{i}", (1_700_000_000 + i, 1_700_000_000 + i))
    got = drain(state.blocks(io.log_lines(spark, str(folder), files_at_once=1)), "lb", tmp_path)
    assert sorted((r.block, r.frame, r.progress) for r in got) == [(0, 2, "continue"), (1, 7, "end")]


def test_a_replayed_batch_calls_once(spark, tmp_path):
    calls = []
    run = io.once(lambda rows, batch: calls.append((batch, rows.count())), str(tmp_path / "ledger"))
    for batch in (0, 1, 1, 0, 2):
        run(spark.range(batch + 3), batch)
    assert calls == [(0, 3), (1, 4), (2, 5)]


def wait_for(check):
    until = time.monotonic() + 60
    while not check() and time.monotonic() < until:
        time.sleep(0.2)


def test_callbacks_and_display(spark, tmp_path):
    told, calls, shown = [], [], []
    listener = io.Listener(told.append)
    spark.streams.addListener(listener)
    batches = [[("v", 0, 1, 10, 1, 1), ("v", 0, 5, 10, 2, 2), ("w", 1, 3, 9, 1, 3)], [("v", 0, 9, 10, 3, 4)]]
    try:
        rows = feed(spark, tmp_path, "video_id string, url_index int, downloaded long, total long, at long, seq long", batches).withColumn("ts", F.timestamp_seconds("at"))
        queries = [io.call_back(rows, lambda *a: calls.append(a), str(tmp_path / "c"), "0.2 seconds"), io.display(rows, shown.append, str(tmp_path / "d"), 3, "0.2 seconds")]
        wait_for(lambda: len(calls) >= 3 and len(shown) >= 2 and len(told) >= 4)
        for q in queries:
            q.stop()
    finally:
        spark.streams.removeListener(listener)
    assert calls == [("v", 5, 10), ("w", 3, 9), ("v", 9, 10)]
    assert shown[-1] == "video_0: 9/10, video_1: 3/9, video_2: 0/0"
    assert sum(r.rows for r in told) >= 8


def test_log_sink(spark, tmp_path):
    folder, path, checkpoint = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "cp")
    folder.mkdir()
    for i in range(3):  # a restart after each
        (folder / f"{i}.json").write_text(json.dumps({"event": f"e{i}", "kind": "download", "message": "no"}))
        rows = spark.readStream.schema("event string, kind string, message string").json(str(folder))
        records = io.bound(rows, {"context": status.log_context(F.col("kind"), F.col("message"))}, "warning")
        assert io.write_log(records, path, checkpoint).awaitTermination(60)
    got = spark.read.json(path).collect()
    assert sorted((r.event, r.level, r.context.error_code) for r in got) == [(f"e{i}", "warning", "download_error") for i in range(3)]
    assert all(len(r.correlation_id) == 8 and r.day for r in got) and all(p.name.startswith("day=") for p in (tmp_path / "log").iterdir() if not p.name.startswith("_"))
