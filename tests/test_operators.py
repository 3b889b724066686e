import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemill import schemas
from tidemill.operators import fate, progress, resilience, results, segments, select, slices
from tidemill.sources import files, metadata, responses, signatures
from tidemill.functions import text

T0 = datetime(2025, 1, 1)


def streams(spark, *videos):
    rows = [(v, p, f"u{p}", "hls", q, None, None, None, h) for v, list_ in videos for p, (q, h) in enumerate(list_)]
    return spark.createDataFrame(rows, schemas.STREAMS)


def pick(df):
    return {r.video_id: r.quality for r in df.collect()}


def test_best_and_worst(spark):
    df = streams(spark, ("a", [("270", 270), ("1080", 1080)]), ("n", [("720", None), ("1080", 1080)]), ("z", [("u0", None), ("u1", 0)]), ("t", [("x", 480), ("y", 480)]))
    assert pick(select.best_stream(df, "quality")) == {"a": "1080", "n": "1080", "z": "u1", "t": "x"}
    assert pick(select.worst_stream(df, "quality")) == {"a": "270", "n": "1080", "z": "u1", "t": "x"}
    assert pick(select.exact_stream(streams(spark, ("a", [("360", 1), ("720p", 2), ("720", 3)])), "720", "quality")) == {"a": "720p"}


def test_catalog_and_choose(spark):
    df = streams(spark, ("a", [("720", 720), ("1080", 1080), ("720", 720), ("unknown", None)]))
    assert select.catalog(df).first().qualities == ["1080", "720", "unknown"]
    asked = spark.createDataFrame([("a", "best"), ("a", "720p"), ("a", "480"), ("a", "zzz"), ("none", "best")], "video_id string, wanted string")
    got = {(r.video_id, r.wanted): (r.pos, r.error, r.available) for r in select.choose(asked, df).collect()}
    offer = ["720", "1080", "720", "unknown"]
    assert got == {
        ("a", "best"): (1, None, offer),
        ("a", "720p"): (0, None, offer),
        ("a", "480"): (None, "quality_not_available", offer),
        ("a", "zzz"): (None, "quality_parse", offer),
        ("none", "best"): (None, "quality_not_available", []),
    }


def test_choose_keeps_what_a_join_by_the_place_gives(spark):
    rows = [("a", 0, "u0", "720p", 720, "t"), ("a", 1, "u1", "480p", 480, None), ("a", 3, None, "unknown", None, "t"), ("b", 0, "v0", "360p", 360, "x"), ("b", 0, "v1", "1080p", 1080, "y"), ("b", 0, "v1", "1080p", 1080, "y")]
    rows += [("b", 2, "v2", "480", 480, "z"), (None, 0, "n", "720p", 720, "n"), ("c", 0, "w", "unknown", 0, "")]
    df = spark.createDataFrame(rows, "video_id string, pos int, url string, quality string, height int, title string")
    wanted = ["best", "worst", "480", "720p", "", "odd", None]
    asked = spark.createDataFrame([(v, w) for v in ("a", "b", "c", "none", None) for w in wanted] + [("b", "best")], "video_id string, wanted string")
    joined = select.choose(asked, df).join(df.select("video_id", "pos", "title", "url"), ["video_id", "pos"], "left")
    got = select.choose(asked, df, "title", "url")
    assert got.columns == ["video_id", "wanted", "pos", "error", "available", "title", "url"]
    assert sorted(map(str, got.collect())) == sorted(map(str, joined.select(got.columns).collect()))
    assert got.where("video_id = 'b' AND wanted = 'best'").count() == 6
    assert select.choose(asked, df.limit(0), "url").where("url IS NULL").count() == asked.count()


def test_ordered_aggregates_keep_order_over_many_groups(spark):
    rows = [(f"v{g}", i, i % 3 > 0) for g in range(400) for i in range(12)]
    got = segments.tally(spark.createDataFrame(rows, schemas.SEGMENT_RESULTS)).collect()
    assert len(got) == 400 and all(r.failed == [0, 3, 6, 9] and not r.all_ok for r in got)


@pytest.mark.parametrize(("n", "starts"), [(10, [0]), (250, [0, 100, 200]), (150, [0, 100]), (100, [0])])
def test_merge_batches(spark, n, starts):
    rows = spark.createDataFrame([("v", i) for i in reversed(range(n))], "video_id string, idx int")
    got = {r.batch_start: r.listing.split("\n") for r in segments.merge_batches(rows).collect()}
    assert sorted(got) == starts
    assert sum((got[s] for s in starts), []) == [f"file '{i:05d}.ts'" for i in range(n)]


def test_resume(spark):
    playlists = spark.createDataFrame([("v", "https://h/p/l.m3u8", "#EXTM3U\na.ts\nhttps://c/b.ts\n/c.ts\n"), ("w", "https://h/l.m3u8", "x.ts")], schemas.PLAYLISTS)
    expected = segments.segments(playlists)
    assert [(r.idx, r.url) for r in expected.where("video_id = 'v'").orderBy("idx").collect()] == [(0, "https://h/p/a.ts"), (1, "https://c/b.ts"), (2, "https://h/c.ts")]
    present = spark.createDataFrame([("v", 0, 5), ("v", 1, 0), ("w", 0, 9), ("w", 0, 9)], schemas.SEGMENTS_PRESENT)
    assert sorted((r.video_id, r.expected, r.missing, r.ready) for r in segments.session(expected, present).collect()) == [("v", 3, 2, False), ("w", 1, 0, True)]
    assert segments.missing_files(expected, present).first().names == ["00001.ts", "00002.ts"]
    old = playlists.where("video_id = 'w'").select("video_id", text.signature(text.entries(F.col("content"))).alias("signature"))
    assert {r.video_id: r.stale for r in segments.stale(playlists, old).collect()} == {"v": True, "w": False}


def test_blocks(spark):
    lines = ["frame=1", "progress=continue", "frame=2", "frame=3", "progress=end", "frame=9", "progress=continue", "frame=7"]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(lines)], schemas.PROGRESS_LINES)
    got = progress.blocks(df, "source", ["line_no"], F.col("line").startswith("progress="))
    assert [(r.line_no, r.block) for r in got.orderBy("line_no").collect()] == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 1), (5, 2), (6, 2)]
    assert progress.until_end(df, "source", ["line_no"], F.col("line") == "progress=end").count() == 5


def test_progress_text(spark):
    updates = spark.createDataFrame([(0, 5, 9, T0), (0, 7, 9, T0 + timedelta(seconds=1)), (2, 1, 2, T0)], schemas.PROGRESS_UPDATES)
    last = progress.latest(updates, "url_index", ["ts"], "downloaded", "total")
    assert progress.progress_text(last, 3).first().progress == "video_0: 7/9, video_1: 0/0, video_2: 1/2"


def test_pauses_overwrite(spark):
    rows = [("u", 0, T0, True), ("u", 1, T0 + timedelta(seconds=9), False), ("u", 2, T0 + timedelta(seconds=10), False), ("w", 3, T0, False)]
    df = spark.createDataFrame(rows, "url string, seq long, ts timestamp, p boolean")
    got = resilience.paused(df, "url", ["seq"], F.col("p"))
    assert {r.seq: r.paused for r in got.collect()} == {0: False, 1: True, 2: False, 3: False}


@pytest.mark.parametrize("slice_seconds", [1, 3600])
def test_peak_concurrency(spark, slice_seconds):
    spans = [(0, 10), (5, 15), (10, 20), (10, 11), (100, 200), (30, 30)]
    df = spark.createDataFrame([("k", a * 1_000_000, b * 1_000_000) for a, b in spans], "k string, started long, ended long")
    assert resilience.peak_concurrency(df, "k", slice_seconds).first().peak == 3


def test_results(spark):
    rows = spark.createDataFrame([(0, "a", "x", "success"), (1, "b", "", "invalid_url"), (2, "c", "", "failed")], schemas.BATCH_RESULTS)
    assert tuple(results.summary(rows, 1).first()) == (3, 1, 2, 1)
    assert [r.pos for r in results.failures(rows).orderBy("pos").collect()] == [1, 2]
    assert results.exit_code(rows).first().exit_code == 1
    assert results.exit_code(rows.where("pos = 0")).first().exit_code == 0
    assert results.exit_code(rows, F.count_if(F.col("status") == "failed") > 0).first().exit_code == 130
    urls = spark.createDataFrame([(i, "u") for i in range(4)], "pos int, url string")
    assert {r.pos: r.status for r in results.gather(urls, rows).collect()}[3] == "cancelled"


def test_files(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# comment\n\n video-1_2 \nbad\x85video-3_4\n")
    got = files.url_list(files.texts(spark, str(tmp_path / "list.txt"))).orderBy("pos").collect()
    assert [(r.line, r.valid) for r in got] == [("video-1_2", True), ("bad", False), ("video-3_4", True)]
    for name, size in (("00000.ts", 3), ("00001.ts", 0), ("batch_0.ts", 5)):
        (tmp_path / name).write_bytes(b"x" * size)
    assert sorted(map(tuple, files.segment_folder(spark, str(tmp_path)).collect())) == [(0, 3)]
    files.write_log(spark.createDataFrame([("e", 1)], "event string, n long"), str(tmp_path / "log"))
    assert tuple(files.read_log(spark, str(tmp_path / "log"), "event string, n long").first()) == ("e", 1)


def test_log_lines(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 50) for i in range(5000)]
    (tmp_path / "a.log").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.log").write_text("only")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = files.log_lines(spark, str(tmp_path))
        rows = [(r.source[-5:], r.line_no, r.line) for r in got.orderBy("source", "line_no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows == [("a.log", i, v) for i, v in enumerate(lines)] + [("b.log", 0, "only")]


@pytest.mark.parametrize("most", [0, 60, 1_000_000])
@pytest.mark.parametrize("width", [1, 7, 1000])
def test_slices(spark, monkeypatch, width, most):
    monkeypatch.setattr(slices, "MOST_ROWS", most)
    rows = [(k, i * 3 % 101, i % 4 == 0) for i in range(101) for k in ("a", None)] + [("few", t, t % 2 == 0) for t in range(52)]
    df = spark.createDataFrame(rows, "k string, t long, p boolean")
    ones, value = F.col("p").cast("long"), F.when(F.col("p"), F.col("t"))
    got = slices.sum_before(df, ["k"], ["t"], ones, F.floor(F.col("t") / width), "n", total="all")
    got = slices.last_before(got, ["k"], ["t"], value, F.floor(F.col("t") / width), "last").collect()
    for r in got:
        before = sorted(t for k, t, p in rows if k == r.k and t < r.t and p)
        assert (r.n, r["all"], r["last"]) == (len(before), 26, before[-1] if before else None)
    assert len(got) == len(rows)


def test_metadata(spark):
    body = '{"id":"7","title":"","fulltitle":"F","formats":[{"url":"a.m3u8","height":720,"width":1280,"tbr":10.9},{"url":"b","vcodec":"none"},{"url":""},{"url":"c.mp4","height":0,"vcodec":null}]}'
    got = metadata.streams(spark.createDataFrame([(body,)], "json string")).orderBy("pos").collect()
    assert [(r.pos, r.title, r.format, r.quality, r.resolution, r.bitrate) for r in got] == [(0, "F", "hls", "720p", "1280x720", 10), (3, "F", "mp4", "unknown", None, None)]


def test_responses(spark):
    big = '{"u":"' + "x" * 1_000_000 + '.m3u8"}'
    rows = [
        (0, "https://h/a.M3U8?x", "text/plain", None, None),
        (1, "https://h/video/1", "application/json; charset=utf-8", "oops", '{"z":{"url":"//c/z.m3u8"},"a":["bare.m3u8",{"u":"https://h/a.M3U8?x"},[{"v":"/c/y.m3u8"}]]}'),
        (2, "https://h/video/2", "application/json", "1000000", '{"u":"no.m3u8"}'),
        (3, "https://h/video/3", "application/json", None, "{broken"),
        (4, "https://h/video/4", "application/json", None, big),
        (5, "https://h/other", "application/json", None, '{"u":"no.m3u8"}'),
    ]
    got = responses.playlist_urls(spark.createDataFrame(rows, schemas.RESPONSES)).orderBy("seq", "place").collect()
    assert [(r.seq, r.place, r.url) for r in got] == [(0, -1, "https://h/a.M3U8?x"), (1, 0, "https://c/z.m3u8"), (1, 2, "https://c/y.m3u8")]


def gone_through(steps, tries):
    """request, attempt and fate of a key's steps, one after another."""
    out, request, attempt = [], 0, 0
    for step in steps:
        goes_on = step in ("retry", "refresh")
        last = attempt == tries - 1
        out.append((request, attempt, "used_up" if goes_on and last else step))
        request, attempt = (request, attempt + 1) if goes_on and not last else (request + 1, 0)
    return out


@pytest.mark.parametrize(("tries", "most"), [(1, 1_000_000), (3, 1_000_000), (3, 50)])
def test_fates(spark, monkeypatch, tries, most):
    """Against going through the attempts one by one; one key holds over a third of the rows."""
    monkeypatch.setattr(slices, "MOST_ROWS", most)
    rng = random.Random(tries)
    kinds = ["retry", "retry", "retry", "refresh", "ok", "failed", "stop"]
    history = {k: [rng.choice(kinds) for _ in range(n)] for k, n in (("hot", 400), (None, 120), *[(f"k{i}", i % 9) for i in range(60)])}
    rows = [(k, t * 7, step) for k, steps in history.items() for t, step in enumerate(steps)]
    df = spark.createDataFrame(rows, "k string, t long, step string").repartition(5)
    tried = fate.requests(df, ["k"], ["t"], "step", tries, F.floor(F.col("t") / 100))
    got = {(r.k, r.t): (r.request, r.attempt, r.fate) for r in tried.collect()}
    want = {(k, t * 7): w for k, steps in history.items() for t, w in enumerate(gone_through(steps, tries))}
    assert got == want
    for r in fate.fates(tried, ["k"]).collect():
        own = [w for (k, _), w in sorted(want.items(), key=lambda x: x[0][1]) if k == r.k and w[0] == r.request]
        last = own[-1][2]
        assert (r.tries, r.refreshes, r.fate) == (len(own), sum(w[2] == "refresh" for w in own), "open" if last in ("retry", "refresh") else last)


@pytest.mark.parametrize("most", [1_000_000, 10])
def test_waits(spark, monkeypatch, most):
    monkeypatch.setattr(slices, "MOST_ROWS", most)
    rng = random.Random(7)
    pauses = [(rng.choice("ab"), T0 + timedelta(seconds=rng.randint(0, 60)), i, rng.choice([1.5, 10.0, 0.0])) for i in range(40)]
    tries = [(rng.choice("abc"), T0 + timedelta(seconds=rng.randint(0, 70)), i) for i in range(90)]
    got = resilience.waits(
        spark.createDataFrame(tries, "u string, ts timestamp, seq long"), spark.createDataFrame(pauses, "u string, ts timestamp, seq long, seconds double"), "u", ["seq"], slice_by=F.floor(F.unix_micros("ts") / 7_000_000)
    ).collect()
    want = {}
    for u, ts, seq in tries:
        before = [p for p in pauses if p[0] == u and p[1] <= ts]
        last = max(before, key=lambda p: (p[1], p[2]), default=None)
        want[seq] = max(0, int((last[1] + timedelta(seconds=last[3]) - ts) / timedelta(microseconds=1))) if last else 0
    assert {r.seq: r.wait_us for r in got} == want and any(want.values())


@pytest.mark.parametrize("most", [1_000_000, 5])
def test_block_fields(spark, monkeypatch, most):
    monkeypatch.setattr(slices, "MOST_ROWS", most)
    lines = ["frame=N/A", "fps=2.5", "progress=continue", "frame=1", "frame=2", "speed=1.5x", "out_time_us=5", "out_time_ms=6", "junk", "progress=end", "frame=9", "progress=continue"]
    df = spark.createDataFrame([(k, i, v) for k in ("s", "t") for i, v in enumerate(lines)] + [("u", 0, "frame=x"), ("u", 1, "progress=end"), ("open", 0, "frame=3")], schemas.PROGRESS_LINES)
    got = {tuple(r) for r in progress.block_fields(df, "source", ["line_no"], F.floor(F.col("line_no") / 3), strict=False).collect()}
    whole = [(0, None, 2.5, None, None, None, None, None, "continue"), (1, 2, None, 1.5, None, 5, 6, None, "end")]
    assert got == {(k, *w) for k in ("s", "t") for w in whole} | {("u", 0, None, None, None, None, None, None, None, "end")}
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        progress.block_fields(df, "source", ["line_no"]).collect()


@pytest.mark.parametrize(("n", "sizes"), [(1, [1, 1]), (100, [1, 1]), (101, [2, 1]), (10_000, [100, 1]), (10_001, [101, 2, 1])])
def test_merge_tree(spark, n, sizes):
    rows = segments.merge_tree(spark.createDataFrame([("v", n), ("none", 0)], "video_id string, segments long")).collect()
    by_level = {k: sorted((r.first, r.inputs) for r in rows if r.level == k) for k in range(len(sizes))}
    assert {r.video_id for r in rows} == {"v"} and [len(by_level[k]) for k in sorted(by_level)] == sizes
    for k, below in enumerate([n, *sizes[:-1]]):
        covered = [i for first, m in by_level[k] for i in range(first, first + m)]
        assert covered == list(range(below))
    assert [(r.level, r.node) for r in rows if r.is_output] == [(len(sizes) - 1, 0)]


def test_resume_after_a_change(spark, tmp_path):
    store = str(tmp_path / "signatures")
    first = spark.createDataFrame([("v", "https://h/l", "a\nb\nc"), ("w", "https://h/l", "x\ny")], schemas.PLAYLISTS)
    present = spark.createDataFrame([("v", 0, 9), ("v", 1, 0), ("w", 0, 9), ("w", 1, 9)], schemas.SEGMENTS_PRESENT)

    def to_fetch(playlists):
        return sorted((r.video_id, r.idx) for r in segments.resume(playlists, signatures.stored(spark, store), present).collect())

    assert to_fetch(first) == [("v", 0), ("v", 1), ("v", 2), ("w", 0), ("w", 1)]
    signatures.update(first, store)
    assert to_fetch(first) == [("v", 1), ("v", 2)]
    changed = first.where("video_id = 'w'").withColumn("content", F.lit("x\nz"))
    assert to_fetch(changed) == [("w", 0), ("w", 1)]
    for _ in range(2):  # run again it changes nothing
        assert signatures.update(changed, store).count() == 2
        assert sorted(p.name for p in (tmp_path / "signatures").glob("snapshot=*")) == ["snapshot=0", "snapshot=1"]
    assert to_fetch(changed) == [] and to_fetch(first) == [("v", 1), ("v", 2), ("w", 0), ("w", 1)]


def test_segment_folders(spark, tmp_path):
    for i in range(1000):
        folder = tmp_path / "media" / f"{i % 7}" / (f".film {i}_segments" if i % 2 else f"v{i}")
        folder.mkdir(parents=True)
        (folder / "00000.ts").write_bytes(b"x" * (i % 3))
        (folder / "00002.ts").write_bytes(b"xx")
        (folder / "batch_00000.ts").write_bytes(b"x")
    present = files.segment_folders(spark, str(tmp_path / "media" / "*" / "*"))
    assert present.count() == 1000 + sum(i % 3 > 0 for i in range(1000))
    names = [f"film {i}" if i % 2 else f"v{i}" for i in range(1000)]
    expected = spark.createDataFrame([(v, i) for v in names for i in range(3)], "video_id string, idx int")
    lost = segments.missing(expected, present, "video_id", "idx").collect()
    assert sorted((r.video_id, r.idx) for r in lost) == sorted([(v, 1) for v in names] + [(v, 0) for i, v in enumerate(names) if i % 3 == 0])
