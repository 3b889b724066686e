import random
import re
from datetime import datetime
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from tidemill import settings
from tidemill.functions import cookies, progress, quality, resilience, routing, status, text, urls


def one(spark, column, **given):
    kinds = {str: "string", int: "bigint", float: "double", bool: "boolean", list: "array<string>", type(None): "string", datetime: "timestamp"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in given.items()) or "x int"
    return spark.createDataFrame([tuple(given.values()) or (1,)], schema).select(column.alias("out")).first().out


def test_video_ids(spark):
    def ids(url):
        v = one(spark, urls.video_id(F.col("u")), u=url)
        return v and (v.owner, v.video)

    assert ids("https://media.example/video-12345_67890") == ("12345", "67890")
    assert ids("https://media.example/x/video--123_4?list=1") == ("-123", "4")
    assert ids("https://example.com/invalid") is None and ids("") is None and ids(None) is None
    assert one(spark, urls.full_id(F.col("u")), u="video-1_2") == "1_2"
    assert one(spark, urls.progress_id(F.col("u")), u="nothing") == "nothing"


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://example.com/video.m3u8?token=abc123", "https://example.com/***REDACTED***"),
        ("HTTPS://user:pw@example.com:8443/a", "https://user:pw@example.com:8443/***REDACTED***"),
        ("", "***REDACTED***"),
        ("not a valid url with ?query=params", "***REDACTED***"),
        (None, "***REDACTED***"),
    ],
)
def test_redact(spark, url, want):
    assert one(spark, urls.redact(F.col("u")), u=url) == want


@pytest.mark.parametrize(("url", "want"), [(" http://a/b ", "http://a/b"), ("//cdn/x", "https://cdn/x"), ("/cdn/x", "https://cdn/x"), ("cdn/x", "https://cdn/x")])
def test_normalize(spark, url, want):
    assert one(spark, urls.normalize(F.col("u")), u=url) == want


def test_titles_and_names(spark):
    title = urls.sanitize_title(F.col("t"))
    assert one(spark, title, t='my:title/with*illegal?chars|and"quotes<>п') == "my_title_with_illegal_chars_and_quotes__п"
    assert one(spark, title, t="a" * 150) == "a" * 100
    assert one(spark, title, t="　  \n") == ""
    name = urls.output_name(F.col("t"), F.lit("12345_67890"), F.col("i"))
    assert one(spark, name, t="Test Video", i=1) == "Test Video_12345_67890.mp4"
    assert one(spark, name, t=None, i=3) == "3_12345_67890.mp4"
    assert one(spark, name, t="", i=5) == "5_12345_67890.mp4"
    assert one(spark, urls.segment_name(F.col("i").cast("int")), i=1234567) == "1234567.ts"
    assert one(spark, urls.has_traversal(F.col("p")), p="a..b") is True


BASES = ["https://h/a/b/l.m3u8?t=1", "http://h", "https://h/", "https://h/a/b/", "HTTPS://u:p@h:8/a;x/b;y?q#f", "https://h/a//b/../c", "https://h?q=1", "https://h/a/./b/..", "https://h//a/b", "https://h/a;b/c;"]
TOKENS = ["a", "b", "..", ".", "/", "//", ";", "?", "#", "x=1", "é", " ", "%2F", "seg.ts", "ftp:", "data:", "https:", "\t", ":", "&"]


def test_join_as_the_library(spark):
    rng = random.Random(3)
    rows = [(rng.choice(BASES), "".join(rng.choice(TOKENS) for _ in range(rng.randint(0, 7)))) for _ in range(4000)]
    joined = spark.createDataFrame(rows, "b string, r string").select("b", "r", urls.join(F.col("b"), F.col("r")).alias("got"))
    assert "Python" not in joined._jdf.queryExecution().toString()
    for r in joined.collect():
        assert r.got == urljoin(r.b, r.r), (r.b, r.r)


def test_resolve(spark):
    def to(base, part):
        return one(spark, urls.resolve(F.col("b"), F.col("p")), b=base, p=part)

    assert to("https://h/a/b.m3u8?x=1", "s.ts") == "https://h/a/s.ts"
    assert to("https://h/a/b.m3u8", "../s.ts") == "https://h/s.ts"
    assert to("https://h/a/", "httpfoo.ts") == "httpfoo.ts"
    assert to("https://h/a/", None) is None


@pytest.mark.parametrize(
    ("asked", "want"),
    [("720", "720"), ("1080", "1080"), ("720p", "720"), ("480pp", "480"), ("best", "best"), ("worst", "worst"), ("", "best"), ("invalid_quality", None), (None, None)],
)
def test_quality_parse(spark, asked, want):
    assert one(spark, quality.parse(F.col("q")), q=asked) == want


def test_labels(spark):
    assert one(spark, quality.label(F.col("h")), h=0) == "unknown"
    assert one(spark, quality.label(F.col("h")), h=720) == "720p"
    assert one(spark, quality.resolution(F.col("w"), F.col("h")), w=0, h=5) is None
    assert one(spark, quality.bitrate(F.col("b")), b=1999.9) == 1999
    assert one(spark, quality.title(F.col("a"), F.col("b")), a="", b="full") == "full"
    assert one(spark, quality.selector(F.col("q")), q="720p") == "best[height<=720]"
    assert one(spark, quality.stream_format(F.col("u")), u="x.M3U8") == "mp4"


def test_playlists(spark):
    entries = text.entries(F.col("c"))
    assert one(spark, entries, c="#EXTM3U\nsegment1.ts\nsegment2.ts\nsegment3.ts") == ["segment1.ts", "segment2.ts", "segment3.ts"]
    assert one(spark, entries, c="#EXTM3U\r\n#EXT-X-VERSION:3\r\n segment1.ts \x85segment2.ts \n#EXT-X-ENDLIST") == ["segment1.ts", "segment2.ts"]
    assert one(spark, entries, c="#EXTM3U\n#EXT-X-ENDLIST\n") == []
    assert one(spark, F.size(text.lines(F.col("c"))), c="a\nb\n") == 2


def test_entries_line_by_line(spark):
    rng = random.Random(6)
    signs = ["a", "b.ts", "#x", " ", "\t", "\n", "\r\n", "\r", "\x0b", "\x1c", "\x1f", "\x85", "\u2028", "\u3000", "é", "  \n", "#"]
    contents = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(2000)] + [" " * 100_000 + "a" + " " * 100_000 + "\nb", ""]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "i int, c string").select("i", text.entries(F.col("c")).alias("e"))
    for r in rows.collect():
        assert r.e == [x for x in map(str.strip, contents[r.i].splitlines()) if x and not x.startswith("#")]


def test_entries_split_a_text_once(spark):
    df = spark.createDataFrame([("a\n",)], "c string").select(text.entries(F.col("c")).alias("e"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


@pytest.mark.parametrize("pattern", [text.BREAK, urls.PLAIN_BASE, urls.PLAIN_NAME, urls.PLAIN_ROOTED])
def test_classes_of_patterns_run_on_each_row_have_no_ranges(pattern):
    classes = re.findall(r"\[\^?((?:\\.|[^\]])*)\]", pattern)
    assert classes and not any(re.search(r"[A-Za-z0-9]-[A-Za-z0-9]|\\[swdSWD]", c) for c in classes)


def test_breaks_and_plain_urls_at_every_character(spark):
    bases = [F.concat(F.lit(a), "c", F.lit(b)) for a, b in (("https://h", "/x/y"), ("https://h/x", "/y"), ("https://h/x/", "y"), ("https://h/x?y", ""))]
    word, short = r"A-Za-z0-9_", F.concat(F.lit("a"), "c", F.lit("b"))
    pairs = [(u, urls.PLAIN_BASE, rf"^(https?://[^/?#;\s]+)((?:/[{word}-]+)*/)[^/?#;\s]*(?:\?[^#\s]*)?$") for u in bases]
    pairs += [(u, urls.PLAIN_NAME, rf"^[{word}-][{word}.-]*$") for u in (F.col("c"), short)]
    pairs += [(F.concat(F.lit("/"), u), urls.PLAIN_ROOTED, rf"^(?:/[{word}-][{word}.-]*)+$") for u in (F.col("c"), short)]
    chars = spark.createDataFrame([(chr(i),) for i in range(0x3100)], "c string")
    for r in chars.select("c", text.lines(short).alias("lines"), *[u.rlike(p) == u.rlike(ranges) for u, p, ranges in pairs]).collect():
        assert r.lines == f"a{r.c}b".splitlines() and all(r[2:]), r


@pytest.mark.parametrize(("line", "want"), [("frame=120", ("frame", "120")), ("  frame=120  ", ("frame", "120")), ("invalid line", None), ("a=b=c", ("a", "b=c"))])
def test_key_value(spark, line, want):
    got = one(spark, text.key_value(F.col("l")), l=line)
    assert (got and tuple(got)) == want


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("[download]   40.3% of 649.37MiB at 983.45KiB/s ETA 06:43", (int(int(649.37 * 1024**2) * 40.3 / 100), int(649.37 * 1024**2))),
        ("[download]  10% of 500.00KiB at 1KiB/s ETA 00:01", (51200, 512000)),
        ("[download]  25% of 2.00GB at 1KiB/s ETA --:--:--", (500000000, 2000000000)),
        ("[download]  1.0% of 4.93GiB at Unknown B/s ETA Unknown", (int(int(4.93 * 1024**3) * 1.0 / 100), int(4.93 * 1024**3))),
        ("[download]  1.0% of ~4.93GiB at 1B/s ETA 1", None),
        ("[download] Destination: a.mp4", None),
        ("", None),
    ],
)
def test_download_line(spark, line, want):
    got = one(spark, progress.download_line(F.col("l")), l=line)
    assert (got and (got.downloaded, got.total)) == want


def test_fields(spark):
    assert one(spark, progress.field("speed", F.col("v")), v="1.2x") == 1.2
    assert one(spark, progress.field("frame", F.col("v")), v="N/A") is None
    assert one(spark, progress.field("frame", F.col("v"), strict=False), v="x1") is None
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        one(spark, progress.field("frame", F.col("v")), v="x1")


@pytest.mark.parametrize(
    ("given", "want"),
    [("120", 120.0), (None, None), ("invalid", None), ("not-a-date", None), ("Tue, 21 Oct 2025 07:28:00 GMT", 1680.0), ("Tue, 21 Oct 2025 06:28:00 GMT", None), ("-5", -5.0)],
)
def test_retry_after(spark, given, want):
    assert one(spark, resilience.retry_after(F.col("h"), F.lit("2025-10-21 07:00:00").cast("timestamp")), h=given) == want


def test_delays(spark):
    def bound(s, a, after):
        return one(spark, resilience.delay_bound(F.lit(s), F.lit(a), F.lit(after).cast("double")))

    assert bound(429, 100, None) == 30.0
    assert bound(429, 0, 5.0) == 5.0
    assert bound(429, 1, 1.0) == 2.0
    assert bound(503, 0, None) == 0.05
    assert bound(429, 0, 90.0) == 90.0
    assert 0 <= one(spark, resilience.sampled_delay(F.lit(429), F.lit(2), F.lit(None).cast("double"), 1)) <= 4
    for s in (200, 400, 403, 404, 429, 500, 502, 503, 504):
        assert one(spark, resilience.is_retryable(F.lit(s))) is (s in (429, 500, 502, 503, 504))
    assert [one(spark, resilience.goes_on(F.lit(503), F.lit(a), 3)) for a in range(3)] == [True, True, False]
    assert one(spark, resilience.outcome(F.lit(200), F.lit(0), F.lit(True))) == "retry"
    assert one(spark, resilience.outcome(F.lit(200), F.lit(0), F.lit(False))) == "failed"
    nothing = F.lit(None).cast("int")
    assert [one(spark, resilience.outcome(nothing, nothing, F.lit(p))) for p in (True, False)] == ["retry", "failed"]
    assert [one(spark, resilience.refresh(F.lit(s))) for s in (200, 403, 410, 404)] == ["text", "refresh", "refresh", "stop"]
    assert one(spark, resilience.refresh(nothing)) == "retry"
    assert [one(spark, resilience.refresh(F.lit(403), F.lit(a), F.lit(b))) for a, b in ((True, True), (False, True), (True, False), (True, None))] == ["refresh", "stop", "stop", "stop"]


@pytest.mark.parametrize(
    ("method", "source", "verify", "want"),
    [
        ("yt-dlp", "browser", True, ("direct_with_resume", "segments", True, False)),
        ("yt-dlp", "none", False, ("direct_with_resume", "segments", False, False)),
        ("ffmpeg", "browser", False, ("remux", "segments", True, True)),
        ("ffmpeg", None, True, ("remux", "segments", False, False)),
        ("auto", "browser", True, ("direct_with_resume", "segments", True, False)),
        ("auto", None, True, ("direct_with_resume", "segments", False, False)),
        ("other", "browser", False, (None, None, False, False)),
        (None, None, None, (None, None, False, False)),
    ],
)
def test_route(spark, method, source, verify, want):
    given = spark.createDataFrame([(method, source, verify)], "m string, s string, v boolean")
    assert tuple(given.select(routing.route(*[F.col(c) for c in "msv"]).alias("r")).first().r) == want


def test_statuses(spark):
    def both(kind, message="m", asked="480", available=()):
        df = spark.createDataFrame([(kind, message, asked, list(available))], "k string, m string, r string, a array<string>")
        cols = [F.col(c) for c in "kmra"]
        return tuple(df.select(status.error_code(cols[0]), status.status_label(cols[0], cols[3]), status.legacy_status(*cols)).first())

    assert both("base") == ("unexpected_error", "error: unexpected_error", "download_error: m")
    assert both("path_traversal") == ("path_traversal", "download_error", "download_error: m")
    assert both("quality_not_available")[1:] == ("no_streams", "no_streams: m")
    assert both("quality_not_available", available=["720", "1080"])[1:] == ("quality_not_available", "quality_not_available: requested 480p, available: 720, 1080")
    assert both("quality_not_available", asked="")[1:] == ("no_streams", "quality_not_available: requested p, available: ")
    assert both("KeyError") == (None, None, "unexpected_error: KeyError")
    assert len(one(spark, status.correlation_id())) == 8
    assert tuple(one(spark, status.log_context(F.col("k"), F.col("m")), k="download", m="no")) == ("download_error", "no")


def test_cookies(spark):
    assert one(spark, cookies.header(cookies.parse(F.col("c"))), c="a=1; none; key=value=with=equals") == "a=1; key=value=with=equals"
    assert one(spark, cookies.file_of_string(F.col("c"), ".example"), c="a=abc123; session=xyz789").split("\n")[3:] == [".example\tTRUE\t/\tFALSE\t0\ta\tabc123", ".example\tTRUE\t/\tFALSE\t0\tsession\txyz789"]
    assert len(one(spark, cookies.file_of_string(F.col("c"), ".example"), c="").split("\n")) == 3
    rows = "array(named_struct('name','n','value','v','domain',cast(null as string),'path',cast(null as string),'secure',true,'expires',5L), named_struct('name','','value','v','domain','d','path','/','secure',false,'expires',0L))"
    assert one(spark, cookies.file_text(F.expr(rows), ".example")).split("\n")[3:] == [".example\tTRUE\t/\tTRUE\t5\tn\tv"]


def test_settings():
    assert settings.from_environment({"TIDEMILL_MAX_RETRIES": "5", "TIDEMILL_LOG_LEVEL": "debug", "TIDEMILL_LOG_FILE": ""}) == settings.Settings(max_retries=5, log_level="DEBUG")
    assert settings.unknown_names({"TIDEMILL_ZZZ": "1", "TIDEMILL_MAX_RETRIES": "1", "OTHER": "2"}) == ["TIDEMILL_ZZZ"]
    for bad in ({"max_retries": 11}, {"throttled_rate": 1}, {"log_level": "LOUD"}):
        with pytest.raises(ValueError):
            settings.Settings(**bad)
    with pytest.raises(TypeError):
        settings.from_environment({}, nothing=1)


def test_env_file(spark):
    given = "# none\nexport TIDEMILL_MAX_RETRIES = 7 # seven\nTIDEMILL_LOG_LEVEL='error'\n\nTIDEMILL_LOG_FILE=\"a #b\"\nnothing\n"
    got = settings.from_environment({"TIDEMILL_LOG_LEVEL": "INFO"}, given, throttled_rate=2000)
    assert got == settings.Settings(max_retries=7, log_level="INFO", log_file="a #b", throttled_rate=2000)
    names = spark.createDataFrame([("m1", "TIDEMILL_ZZZ"), ("m2", "TIDEMILL_ZZZ"), ("m1", "tidemill_max_retries"), ("m1", "PATH"), ("m1", None)], "machine string, name string")
    assert sorted(map(tuple, settings.unknown_settings(names).collect())) == [("m1", "TIDEMILL_ZZZ"), ("m2", "TIDEMILL_ZZZ")]


def test_settings_message(spark):
    errors = F.array(*[F.struct(F.lit(f).alias("field"), F.lit("bad").alias("message")) for f in ("max_retries", "log_level")])
    assert one(spark, routing.settings_message(errors, "X_")) == "Settings that can't be used:\nX_MAX_RETRIES = (hidden): bad\nX_LOG_LEVEL = (hidden): bad"
