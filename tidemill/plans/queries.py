"""The engine's operators on the supplied tables, each with the SQL that gives the same rows.

The tables hold no media data, so each operator runs on a stand-in: `lineitem` rows are an order's streams, `events`
are attempts, progress lines or results, `pages` and `documents` give urls and texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cookies, progress, quality, resilience, routing, status, text, urls
from ..operators import fate
from ..operators import progress as progress_ops
from ..operators import resilience as resilience_ops
from ..operators import results, segments, select
from ..operators.slices import hours
from ..settings import PREFIX
from ..sources import files, metadata, responses

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as a video's streams; returned ones have no known height."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    height = F.when(F.col("l_returnflag") != "R", F.floor("l_quantity").cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("video_id"), F.row_number().over(order).alias("pos"), height.alias("height"), "l_linestatus")
    return rows.withColumn("quality", quality.label(F.col("height")))


STREAMS = """streams AS (
  SELECT l_orderkey AS video_id,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS pos,
    CASE WHEN l_returnflag <> 'R' THEN CAST(floor(l_quantity) AS INT) END AS height, l_linestatus,
    CASE WHEN l_returnflag <> 'R' AND floor(l_quantity) <> 0 THEN CAST(CAST(floor(l_quantity) AS INT) AS VARCHAR) || 'p' ELSE 'unknown' END AS quality
  FROM lineitem)"""


def _first(order: str) -> str:
    return f"""WITH {STREAMS}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY {order}) AS n FROM streams)
SELECT video_id, pos, height, quality FROM r WHERE n = 1"""


@query(_first("(height IS NOT NULL) DESC, coalesce(height, 0) DESC, pos"))
def q01_best_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.best_stream(streams(spark, sf_dir), "pos", "height", "quality")


@query(_first("(height IS NULL), coalesce(height, 0), pos"))
def q02_worst_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.worst_stream(streams(spark, sf_dir), "pos", "height", "quality")


@query(f"WITH {STREAMS} SELECT video_id, min(pos) AS pos FROM streams WHERE quality IN ('20', '20p') GROUP BY video_id")
def q03_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.exact_stream(streams(spark, sf_dir), "20p", "pos")


@query(
    f"""WITH {STREAMS}, d AS (SELECT DISTINCT video_id, quality, coalesce(TRY_CAST(replace(quality, 'p', '') AS BIGINT), 0) AS k FROM streams),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY k DESC, quality) AS n FROM d)
SELECT video_id, string_agg(quality, ',' ORDER BY k DESC, quality) AS qualities FROM r WHERE n <= 8 GROUP BY video_id"""
)
def q04_quality_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = select.catalog(streams(spark, sf_dir))
    return found.select("video_id", F.array_join(F.slice("qualities", 1, select.TOP), ",").alias("qualities"))


@query(
    """SELECT page_id, CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+')
  THEN lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1) || '/***REDACTED***'
  ELSE '***REDACTED***' END AS redacted FROM pages"""
)
def q05_url_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.redact(F.col("url")).alias("redacted"))


@query(
    """WITH u AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'https://media.example/video-' || o_custkey || '_' || o_orderkey
  WHEN 1 THEN 'https://media.example/video--' || o_custkey || '_' || o_orderkey ELSE 'https://media.example/clip/' || o_orderkey END AS url FROM orders)
SELECT o_orderkey, regexp_extract(url, 'video-(-?[0-9]+)_([0-9]+)', 1) AS owner, regexp_extract(url, 'video-(-?[0-9]+)_([0-9]+)', 2) AS video,
  regexp_extract(url, 'video-(-?[0-9]+)_([0-9]+)', 1) || '_' || regexp_extract(url, 'video-(-?[0-9]+)_([0-9]+)', 2) AS full_id,
  regexp_extract(url, '_([^_]*)$', 1) AS progress_id
FROM u WHERE regexp_matches(url, 'video-(-?[0-9]+)_([0-9]+)')"""
)
def q06_video_id_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner, key = F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")
    url = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("https://media.example/video-"), owner, F.lit("_"), key))
    url = url.when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("https://media.example/video--"), owner, F.lit("_"), key)).otherwise(F.concat(F.lit("https://media.example/clip/"), key))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", url.alias("url")).where(urls.has_video_id(F.col("url")))
    v = urls.video_id(F.col("url"))
    return rows.select("o_orderkey", v["owner"].alias("owner"), v["video"].alias("video"), urls.full_id(F.col("url")).alias("full_id"), urls.progress_id(F.col("url")).alias("progress_id"))


ENTRIES = r"""list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND x[1] <> '#')"""


@query(f"WITH s AS (SELECT doc_id, {ENTRIES} AS e FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(len(e) AS INT) AS segments, sha256(array_to_string(e, chr(10))) AS signature FROM s")
def q07_playlist_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", text.entries(F.col("text")).alias("e"))
    return rows.select("doc_id", F.size("e").alias("segments"), text.signature(F.col("e")).alias("signature"))


@query(f"WITH {STREAMS} SELECT video_id, pos FROM streams WHERE l_linestatus <> 'F'")
def q08_missing_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams(spark, sf_dir)
    present = rows.where("l_linestatus = 'F'").select("video_id", "pos", F.lit(1).alias("length"))
    return segments.missing(rows.select("video_id", "pos"), present, "video_id", "pos")


@query(
    f"""WITH {STREAMS} SELECT video_id, count(*) AS segments, bool_and(l_linestatus = 'F') AS all_ok,
  coalesce(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (l_linestatus <> 'F'), '') AS failed FROM streams GROUP BY video_id"""
)
def q09_segment_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = streams(spark, sf_dir).select("video_id", F.col("pos").alias("idx"), (F.col("l_linestatus") == "F").alias("ok"))
    return segments.tally(done).select("video_id", "segments", "all_ok", F.array_join("failed", ",").alias("failed"))


INDEXED = "i AS (SELECT user_id AS video_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS idx FROM events)"


@query(
    f"""WITH {INDEXED} SELECT video_id, idx - idx % 100 AS batch_start, count(*) AS segments,
  string_agg('file ''' || printf('%05d', idx) || '.ts''', chr(10) ORDER BY idx) AS listing FROM i GROUP BY 1, 2"""
)
def q10_merge_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resilience_ops.numbered_attempts(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], F.floor(F.col("event_id") / 100_000))
    return segments.merge_batches(rows.select(F.col("user_id").alias("video_id"), F.col("attempt").alias("idx")))


@query(r"""SELECT doc_id, substr(regexp_replace(translate(text, '/\:*?"<>|', '_________'), '^\s+|\s+$', '', 'g'), 1, 100) AS title FROM documents""")
def q11_title_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", urls.sanitize_title(F.col("text")).alias("title"))


@query(
    """WITH b AS (SELECT *, coalesce(count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block,
  count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, block, count(*) AS n_lines, max(event_id) FILTER (event_type = 'purchase') AS ended_by,
  arg_max(value, struct_pack(t := ts, e := event_id)) FILTER (event_type = 'click') AS click FROM b WHERE block < n GROUP BY user_id, block"""
)
def q12_progress_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.col("event_type") == "purchase"
    rows = progress_ops.blocks(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ends, hours(F.col("ts").cast("timestamp")))
    click = F.when(F.col("event_type") == "click", F.struct("ts", "event_id"))
    return rows.groupBy("user_id", "block").agg(F.count("*").alias("n_lines"), F.max(F.when(ends, F.col("event_id"))).alias("ended_by"), F.max_by("value", click).alias("click"))


@query(
    """WITH l AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'error'),
b AS (SELECT DISTINCT user_id // 60 AS batch FROM l), r AS (SELECT batch, batch * 60 + range AS i FROM b, range(60))
SELECT batch, string_agg('video_' || i || ': ' || coalesce(CAST(trunc(value) AS BIGINT), 0) || '/' || coalesce(event_id, 0), ', ' ORDER BY i) AS progress
FROM r LEFT JOIN l ON i = user_id AND n = 1 GROUP BY batch"""
)
def q13_progress_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = table(spark, sf_dir, "events").where("event_type = 'error'")
    updates = errors.select(F.col("user_id").alias("url_index"), F.col("value").cast("bigint").alias("downloaded"), F.col("event_id").alias("total"), "ts", "event_id")
    return progress_ops.progress_texts(progress_ops.latest(updates, "url_index", ["ts", "event_id"], "downloaded", "total"), 60)


@query(
    """WITH i AS (SELECT event_type, epoch_us(ts) AS s, epoch_us(ts) + CAST(trunc(value * 60000000) AS BIGINT) AS e FROM events),
d AS (SELECT event_type, s AS t, 1 AS d FROM i UNION ALL SELECT event_type, e, -1 FROM i),
g AS (SELECT event_type, t, sum(d) AS d FROM d GROUP BY 1, 2),
r AS (SELECT event_type, sum(d) OVER (PARTITION BY event_type ORDER BY t) AS n FROM g)
SELECT event_type, CAST(greatest(max(n), 0) AS BIGINT) AS peak FROM r GROUP BY event_type"""
)
def q14_peak_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select("event_type", start.alias("started"), (start + (F.col("value") * 60_000_000).cast("bigint")).alias("ended"))
    return resilience_ops.peak_concurrency(rows, "event_type")


@query(
    """WITH a AS (SELECT event_id, CASE event_type WHEN 'error' THEN 429 ELSE 500 END AS status, value,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS attempt FROM events WHERE event_type IN ('error', 'click'))
SELECT event_id, attempt, status, least(CASE status WHEN 429 THEN 1.0::DOUBLE ELSE 0.05::DOUBLE END * pow(2.0, attempt), 30.0) AS longest,
  greatest(least(CASE status WHEN 429 THEN 1.0::DOUBLE ELSE 0.05::DOUBLE END * pow(2.0, attempt), 30.0), CASE WHEN event_id % 2 = 0 THEN value END) AS bound, attempt < 2 AS goes_on FROM a"""
)
def q15_retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_type IN ('error', 'click')")
    rows = resilience_ops.numbered_attempts(rows, ["user_id"], ["ts", "event_id"], hours(F.col("ts").cast("timestamp"))).withColumn("status", F.when(F.col("event_type") == "error", 429).otherwise(500))
    after = F.when(F.col("event_id") % 2 == 0, F.col("value"))
    s, a = F.col("status"), F.col("attempt")
    return rows.select("event_id", "attempt", "status", resilience.longest_delay(s, a).alias("longest"), resilience.delay_bound(s, a, after).alias("bound"), resilience.goes_on(s, a, 3).alias("goes_on"))


@query("SELECT event_type, count(*) AS total, count(*) FILTER (value >= 50) AS successful, count(*) FILTER (NOT value >= 50) AS failed FROM events GROUP BY ROLLUP (event_type)")
def q16_status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.summary_by(table(spark, sf_dir, "events"), "event_type", F.col("value") >= 50)


@query(
    """WITH p AS (SELECT event_id, ts, last_value(CASE WHEN event_type = 'error' THEN ts + INTERVAL 10 MINUTE END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM events)
SELECT event_id, coalesce(ts < until, false) AS paused FROM p"""
)
def q17_paused_at_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return resilience_ops.paused(rows, "user_id", ["ts", "event_id"], F.col("event_type") == "error", seconds=600, slice_by=hours("ts")).select("event_id", "paused")


@query(
    """WITH h AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS u FROM pages), e AS (SELECT page_id, unnest(u) AS u, generate_subscripts(u, 1) AS p FROM h),
f AS (SELECT page_id, u, min(p) AS p FROM e GROUP BY 1, 2) SELECT page_id, string_agg(u, ' ' ORDER BY p) AS urls FROM f GROUP BY page_id"""
)
def q18_ordered_url_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    rows = table(spark, sf_dir, "pages").select("page_id", results.ordered_distinct(found).alias("u")).where(F.size("u") > 0)
    return rows.select("page_id", F.array_join("u", " ").alias("urls"))


@query(
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor(l_tax * 100) AS INT) + 0.5::DOUBLE AS pct, CAST(floor(l_quantity) AS INT) + 0.37::DOUBLE AS n,
  CASE l_linenumber % 4 WHEN 0 THEN 1024.0::DOUBLE WHEN 1 THEN 1048576 WHEN 2 THEN 1000000000 ELSE 1 END AS f FROM lineitem),
t AS (SELECT *, CAST(trunc(n * f) AS BIGINT) AS total FROM l)
SELECT l_orderkey, l_linenumber, l_partkey, CAST(trunc(CAST(total AS DOUBLE) * pct / 100) AS BIGINT) AS downloaded, total FROM t"""
)
def q19_download_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, ("KiB", "MiB", "GB", "iB"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    whole = [F.floor(c).cast("int").cast("string") for c in (F.col("l_tax") * 100, F.col("l_quantity"))]
    line = F.concat(F.lit("[download]  "), whole[0], F.lit(".5% of "), whole[1], F.lit(".37"), unit, F.lit(" at 983.45KiB/s ETA 06:43"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", progress.download_line(line).alias("p"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "p.downloaded", "p.total")


@query(
    """WITH v AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '  ' || url || ' ' WHEN 1 THEN regexp_replace(url, '^https?:', '') WHEN 2 THEN regexp_replace(url, '^https?:/', '') ELSE regexp_replace(url, '^https?://', '') END AS u FROM pages)
SELECT page_id, CASE WHEN trim(u) LIKE 'http://%' OR trim(u) LIKE 'https://%' THEN trim(u) ELSE 'https://' || regexp_replace(trim(u), '^//?', '') END AS url FROM v"""
)
def q20_url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 4
    given = F.when(k == 0, F.concat(F.lit("  "), "url", F.lit(" "))).when(k == 1, F.regexp_replace("url", "^https?:", "")).when(k == 2, F.regexp_replace("url", "^https?:/", "")).otherwise(F.regexp_replace("url", "^https?://", ""))
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize(given).alias("url"))


@query(
    """SELECT event_id, 'id' AS name, CAST(event_id AS VARCHAR) AS value, 'id=' || event_id || '; props=' || props || '=' AS header FROM events
UNION ALL SELECT event_id, 'props', props || '=', 'id=' || event_id || '; props=' || props || '=' FROM events"""
)
def q21_cookie_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("id="), F.col("event_id").cast("string"), F.lit("; none; props="), "props", F.lit("="))
    rows = table(spark, sf_dir, "events").select("event_id", cookies.parse(line).alias("c"))
    rows = rows.withColumn("header", cookies.header(F.col("c"))).withColumn("each", F.explode("c"))
    return rows.select("event_id", "each.name", "each.value", "header")


@query("""SELECT page_id, 0 AS place, url || '.m3u8' AS found FROM pages UNION ALL SELECT page_id, 1, url || '?v.M3U8' FROM pages""")
def q22_json_url_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit('{"z":{"url":"'), "url", F.lit('.m3u8","n":1},"a":["bare.m3u8",{"u":"'), "url", F.lit('?v.M3U8","x":"y"}]}'))
    return responses.json_urls(table(spark, sf_dir, "pages").select("page_id", body.alias("body")), "page_id")


@query(
    r"""WITH b AS (SELECT page_id, url, regexp_extract(url, '^(\w+://[^/?#]+)', 1) AS site, regexp_extract(url, '^\w+://[^/?#]+([^?#]*)', 1) AS path FROM pages)
SELECT page_id, site || CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || 'seg1.ts' AS near, site || '/abs/seg2.ts' AS rooted, 'https://cdn.example/s.ts' AS absolute FROM b"""
)
def q23_segment_url_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {"near": "seg1.ts", "rooted": "/abs/seg2.ts", "absolute": "https://cdn.example/s.ts"}
    return table(spark, sf_dir, "pages").select("page_id", *[urls.resolve(F.col("url"), F.lit(s)).alias(n) for n, s in parts.items()])


NOW = "2025-10-21 07:00:00"


@query(
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 120.0::DOUBLE WHEN 1 THEN CAST(event_id % 1000 AS DOUBLE) + 0.5 WHEN 3 THEN 1680.0 WHEN 5 THEN -5.0 END AS seconds FROM events"""
)
def q24_retry_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 6
    given = F.when(k == 0, "120").when(k == 1, F.concat((F.col("event_id") % 1000).cast("string"), F.lit(".5"))).when(k == 2, "not-a-date")
    given = given.when(k == 3, "Tue, 21 Oct 2025 07:28:00 GMT").when(k == 4, "Tue, 21 Oct 2025 06:28:00 GMT").otherwise("-5")
    return table(spark, sf_dir, "events").select("event_id", resilience.retry_after(given, F.lit(NOW).cast("timestamp")).alias("seconds"))


@query(
    """WITH k AS (SELECT event_id, CAST(event_id AS VARCHAR) AS m, CASE event_type WHEN 'signup' THEN 'video_not_found' WHEN 'error' THEN 'quality_not_available' WHEN 'click' THEN 'path_traversal' WHEN 'view' THEN 'base' ELSE 'KeyError' END AS kind, event_id % 3 AS a FROM events)
SELECT event_id, CASE kind WHEN 'base' THEN 'unexpected_error' WHEN 'KeyError' THEN NULL ELSE kind END AS error_code,
  CASE kind WHEN 'base' THEN 'error: unexpected_error' WHEN 'path_traversal' THEN 'download_error' WHEN 'quality_not_available' THEN CASE WHEN a = 0 THEN 'quality_not_available' ELSE 'no_streams' END WHEN 'KeyError' THEN NULL ELSE kind END AS label,
  CASE kind WHEN 'quality_not_available' THEN CASE a WHEN 0 THEN 'quality_not_available: requested 480p, available: 720p, 720p' WHEN 1 THEN 'no_streams: ' || m ELSE 'quality_not_available: requested p, available: ' END
    WHEN 'KeyError' THEN 'unexpected_error: KeyError' WHEN 'video_not_found' THEN 'video_not_found: ' || m ELSE 'download_error: ' || m END AS legacy FROM k"""
)
def q25_status_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"signup": "video_not_found", "error": "quality_not_available", "click": "path_traversal", "view": "base"}
    kind = F.coalesce(*[F.when(F.col("event_type") == e, k) for e, k in kinds.items()], F.lit("KeyError"))
    place = F.col("event_id") % 3
    available = F.when(place == 0, F.array(F.lit("720p"), F.lit("720p"))).otherwise(F.array().cast("array<string>"))
    asked, message = F.when(place == 2, "").otherwise("480"), F.col("event_id").cast("string")
    return table(spark, sf_dir, "events").select("event_id", status.error_code(kind).alias("error_code"), status.status_label(kind, available).alias("label"), status.legacy_status(kind, message, asked, available).alias("legacy"))


@query(
    r"""WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE p_name || '?/' || p_type END AS title, '7_' || p_partkey AS id FROM part),
s AS (SELECT *, substr(regexp_replace(translate(title, '/\:*?"<>|', '_________'), '^\s+|\s+$', '', 'g'), 1, 100) AS c FROM t)
SELECT p_partkey, coalesce(nullif(c, ''), CAST(p_partkey AS VARCHAR)) || '_' || id || '.mp4' AS file, contains(title, '..') AS traversal FROM s"""
)
def q26_output_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(F.concat("p_name", F.lit("?/"), "p_type"))
    full = F.concat(F.lit("7_"), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", urls.output_name(title, full, F.col("p_partkey")).alias("file"), urls.has_traversal(title).alias("traversal"))


@query(
    f"""WITH {STREAMS}, w AS (SELECT DISTINCT o_orderkey AS video_id, CASE o_orderkey % 4 WHEN 0 THEN 'best' WHEN 1 THEN '720p' WHEN 2 THEN 'worst' ELSE 'any' END AS wanted FROM orders),
o AS (SELECT video_id, string_agg(quality, ',' ORDER BY pos) AS available, first(pos ORDER BY (height IS NOT NULL) DESC, coalesce(height, 0) DESC, pos) AS best,
  first(pos ORDER BY (height IS NULL), coalesce(height, 0), pos) AS worst, min(pos) FILTER (quality IN ('720', '720p')) AS fit FROM streams GROUP BY video_id)
SELECT video_id, wanted, CASE wanted WHEN 'best' THEN best WHEN 'worst' THEN worst WHEN '720p' THEN fit END AS pos,
  CASE WHEN wanted = 'any' THEN 'quality_parse' WHEN CASE wanted WHEN 'best' THEN best WHEN 'worst' THEN worst ELSE fit END IS NULL THEN 'quality_not_available' END AS error,
  coalesce(available, '') AS available FROM w LEFT JOIN o USING (video_id)"""
)
def q27_choose_or_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    wanted = F.when(k == 0, "best").when(k == 1, "720p").when(k == 2, "worst").otherwise("any")
    requests = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video_id"), wanted.alias("wanted")).distinct()
    return select.choose(requests, streams(spark, sf_dir)).withColumn("available", F.array_join("available", ","))


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS video_id, 'full' AS title, 0 AS pos, 'https://m.example/' || o_orderkey || '.m3u8' AS url, 'hls' AS format,
  CASE WHEN o_custkey % 100 = 0 THEN 'unknown' ELSE (o_custkey % 100) || 'p' END AS quality, CASE WHEN o_custkey % 100 <> 0 THEN '640x' || (o_custkey % 100) END AS resolution, 1999 AS bitrate FROM orders
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'full', 3, 'https://m.example/a.mp4', 'mp4', 'unknown', NULL, NULL FROM orders"""
)
def q28_metadata_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, height = F.col("o_orderkey").cast("string"), (F.col("o_custkey") % 100).cast("string")
    body = F.concat(
        F.lit('{"id":"'), key, F.lit('","title":"","fulltitle":"full","formats":[{"url":"https://m.example/'), key, F.lit('.m3u8","height":'), height,
        F.lit(',"width":640,"tbr":1999.9,"vcodec":"avc1"},{"url":"https://m.example/x.m4a","vcodec":"none"},{"url":"","vcodec":"avc1"},{"url":"https://m.example/a.mp4","tbr":0}]}'),
    )
    return metadata.streams(table(spark, sf_dir, "orders").select(body.alias("json"))).drop("width", "height")


@query(f"WITH {STREAMS} SELECT video_id, count(*) AS expected, count(*) FILTER (l_linestatus <> 'F') AS missing, bool_and(l_linestatus = 'F') AS ready FROM streams GROUP BY video_id")
def q29_resume_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams(spark, sf_dir).withColumnRenamed("pos", "idx")
    present = rows.select("video_id", "idx", F.when(F.col("l_linestatus") == "F", 10).otherwise(0).alias("length"))
    return segments.session(rows.select("video_id", "idx"), present)


@query(
    """WITH r AS (SELECT event_id, event_id % 7 <> 0 AS there, CASE WHEN value >= 50 THEN 'success' ELSE 'failed' END AS status FROM events)
SELECT event_id AS pos, CASE WHEN there THEN status ELSE 'cancelled' END AS status FROM r WHERE NOT there OR status <> 'success'"""
)
def q30_batch_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.lit("u").alias("url"), "value")
    done = rows.where("pos % 7 <> 0").select("pos", F.lit("f").alias("output_path"), F.when(F.col("value") >= 50, "success").otherwise("failed").alias("status"))
    return results.failures(results.gather(rows.drop("value"), done)).drop("url")


@query(
    """WITH l AS (SELECT event_id, event_id % 4 AS k FROM events WHERE event_id % 4 < 3)
SELECT event_id, CASE k WHEN 0 THEN 'frame' WHEN 1 THEN 'speed' ELSE 'fps' END AS key,
  CASE k WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN (event_id % 7) || '.5x' ELSE 'N/A' END AS value,
  CASE k WHEN 0 THEN CAST(event_id AS INT) END AS frame, CASE k WHEN 1 THEN event_id % 7 + 0.5::DOUBLE END AS speed FROM l"""
)
def q31_progress_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, key = F.col("event_id") % 4, F.col("event_id").cast("string")
    line = F.when(k == 0, F.concat(F.lit("frame="), key)).when(k == 1, F.concat(F.lit("  speed="), (F.col("event_id") % 7).cast("string"), F.lit(".5x "))).when(k == 2, "fps=N/A").otherwise("no pair")
    rows = table(spark, sf_dir, "events").select("event_id", text.key_value(line).alias("p")).where("p IS NOT NULL").select("event_id", "p.key", "p.value")
    return rows.select("event_id", "key", "value", *[F.when(F.col("key") == n, progress.field(n, F.col("value"), strict=False)).alias(n) for n in ("frame", "speed")])


@query(
    r"""SELECT event_id, array_to_string(['# Netscape HTTP Cookie File', '# This file is generated, do not edit.', '',
  array_to_string(['.media.example', 'TRUE', '/', 'FALSE', '0', 'id', CAST(event_id AS VARCHAR)], chr(9)),
  array_to_string(['.media.example', 'TRUE', '/', 'FALSE', '0', 'type', event_type], chr(9))], chr(10)) AS file FROM events"""
)
def q32_cookie_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("id="), F.col("event_id").cast("string"), F.lit("; bare; type="), "event_type")
    return table(spark, sf_dir, "events").select("event_id", cookies.file_of_string(line, ".media.example").alias("file"))


@query(
    """WITH a AS (SELECT event_id, CASE event_type WHEN 'error' THEN 503 WHEN 'signup' THEN 404 WHEN 'purchase' THEN 403 WHEN 'click' THEN 200 END AS status, event_id % 2 AS size, event_id % 3 = 0 AS parallel, event_id % 5 > 0 AS known FROM events)
SELECT event_id, CASE WHEN status = 200 AND size > 0 THEN 'ok' WHEN status = 503 THEN 'retry' WHEN parallel AND (status IS NULL OR status = 200) THEN 'retry' ELSE 'failed' END AS outcome,
  CASE WHEN status IS NULL THEN 'retry' WHEN status = 200 THEN 'text' WHEN status = 403 AND known THEN 'refresh' ELSE 'stop' END AS playlist FROM a"""
)
def q33_attempt_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("event_type") == "error", 503).when(F.col("event_type") == "signup", 404).when(F.col("event_type") == "purchase", 403).when(F.col("event_type") == "click", 200)
    outcome = resilience.outcome(code, F.col("event_id") % 2, F.col("event_id") % 3 == 0)
    return table(spark, sf_dir, "events").select("event_id", outcome.alias("outcome"), resilience.refresh(code, F.col("event_id") % 5 > 0).alias("playlist"))


@query(
    """SELECT o_orderkey AS video_id, 0 AS idx, 'https://media.example/v/' || o_orderkey || '/seg.ts' AS url FROM orders
UNION ALL SELECT o_orderkey, 1, 'https://cdn.example/' || o_orderkey || '.ts' FROM orders UNION ALL SELECT o_orderkey, 2, 'https://media.example/end.ts' FROM orders"""
)
def q34_playlist_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    base = F.concat(F.lit("https://media.example/v/"), key, F.lit("/list.m3u8?token=1"))
    content = F.concat(F.lit("#EXTM3U\n#EXT-X-VERSION:3\n seg.ts\r\nhttps://cdn.example/"), key, F.lit(".ts\n\n/end.ts\n#EXT-X-ENDLIST\n"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video_id"), base.alias("m3u8_url"), content.alias("content"))
    return segments.segments(rows).select("video_id", "idx", "url")


@query(
    """WITH r AS (SELECT page_id, page_id % 3 = 0 AS direct, url || CASE WHEN page_id % 3 = 0 THEN '/list.M3U8' ELSE '/video' END AS url FROM pages),
f AS (SELECT page_id, -1 AS place, url FROM r WHERE direct UNION ALL SELECT page_id, 0, 'https://cdn.example/' || page_id % 50 || '.m3u8' FROM r WHERE page_id % 2 = 0 AND contains(url, 'video'))
SELECT min(page_id) AS seq, arg_min(place, page_id) AS place, url FROM f GROUP BY url"""
)
def q35_response_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat("url", F.when(F.col("page_id") % 3 == 0, "/list.M3U8").otherwise("/video"))
    body = F.concat(F.lit('{"a":{"u":"//cdn.example/'), (F.col("page_id") % 50).cast("string"), F.lit('.m3u8"},"b":"c"}'))
    kind = F.when(F.col("page_id") % 2 == 0, "application/json").otherwise("text/html")
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), url.alias("url"), kind.alias("content_type"), F.lit(None).cast("string").alias("content_length"), body.alias("body"))
    return responses.playlist_urls(rows)


@query("SELECT doc_id AS video_id, doc_id % 2 <> 0 AS stale FROM documents WHERE text IS NOT NULL")
def q36_stale_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select(F.col("doc_id").alias("video_id"), F.col("text").alias("content"))
    stored = rows.where("video_id % 4 <> 3").select("video_id", text.signature(text.entries(F.col("content"))).alias("s"), (F.col("video_id") % 4 == 1).alias("old"))
    return segments.stale(rows, stored.select("video_id", F.when(F.col("old"), "another").otherwise(F.col("s")).alias("signature"))).select("video_id", "stale")


@query("SELECT count(*) AS total, count(*) FILTER (value >= 50) AS successful, count(*) FILTER (NOT value >= 50) AS failed, 3 AS skipped, 1 AS exit_code FROM events")
def q37_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.when(F.col("value") >= 50, "success").otherwise("failed").alias("status"))
    return results.summary(rows, 3).withColumn("exit_code", F.when((F.col("total") > 0) & (F.col("failed") == 0), 0).otherwise(1))


@query(
    r"""WITH f AS (SELECT CAST(o_orderkey AS VARCHAR) AS source, ['# list ' || o_orderkey, '', '  video-' || o_custkey || '_' || o_orderkey, 'https://h/clip' || CASE WHEN o_orderkey % 2 = 0 THEN '/video--1_2' ELSE '' END || '  '] AS l FROM orders),
e AS (SELECT source, unnest(l) AS line, CAST(generate_subscripts(l, 1) - 1 AS INT) AS pos FROM f)
SELECT source, pos, trim(line) AS line, regexp_matches(line, 'video-(-?[0-9]+)_([0-9]+)') AS valid FROM e WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')"""
)
def q38_url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    last = F.concat(F.lit("https://h/clip"), F.when(F.col("o_orderkey") % 2 == 0, "/video--1_2").otherwise(""))
    content = F.concat(F.lit("# list "), key, F.lit("\n\r\n  video-"), F.col("o_custkey").cast("string"), F.lit("_"), key, F.lit("\n"), last, F.lit("  \n"))
    return files.url_list(table(spark, sf_dir, "orders").select(key.alias("path"), content.alias("content")))


@query(
    f"""WITH {INDEXED}, m AS (SELECT i.video_id, idx FROM i JOIN (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events) e ON user_id = video_id AND n = idx WHERE event_type = 'error')
SELECT video_id, string_agg(printf('%05d', idx) || '.ts', ' ' ORDER BY idx) AS names FROM m GROUP BY video_id"""
)
def q39_missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resilience_ops.numbered_attempts(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], F.floor(F.col("event_id") / 100_000))
    rows = rows.select(F.col("user_id").alias("video_id"), F.col("attempt").alias("idx"), "event_type")
    present = rows.where("event_type <> 'error' OR idx % 2 = 0").select("video_id", "idx", F.when(F.col("event_type") == "error", 0).otherwise(9).alias("length"))
    return segments.missing_files(rows, present).select("video_id", F.array_join("names", " ").alias("names"))


@query(
    """WITH f AS (SELECT user_id, min(struct_pack(t := ts, e := event_id)) FILTER (event_type = 'purchase') AS f FROM events GROUP BY user_id)
SELECT user_id, count(*) AS n_lines, max(event_id) AS last_id FROM events JOIN f USING (user_id) WHERE f IS NULL OR struct_pack(t := ts, e := event_id) <= f GROUP BY user_id"""
)
def q40_until_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = progress_ops.until_end(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "purchase", hours(F.col("ts").cast("timestamp")))
    return rows.groupBy("user_id").agg(F.count("*").alias("n_lines"), F.max("event_id").alias("last_id"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'best' ELSE 'best[height<=' || CAST(floor(l_quantity) AS INT) || ']' END AS selector FROM lineitem"""
)
def q41_format_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.when(F.col("l_returnflag") == "R", "worst").otherwise(F.concat(F.floor("l_quantity").cast("string"), F.lit("p")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", quality.selector(asked).alias("selector"))


@query(
    """SELECT page_id AS seq, 'https://cdn.example/' || page_id || '.m3u8' AS url FROM pages
WHERE page_id % 5 <> 0 AND CASE page_id % 4 WHEN 0 THEN 10 WHEN 1 THEN 999999 WHEN 2 THEN 1000000 ELSE 0 END < 1000000 AND page_id % 7 <> 0"""
)
def q42_response_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id").cast("string")
    length = F.when(F.col("page_id") % 4 == 0, "10").when(F.col("page_id") % 4 == 1, "999999").when(F.col("page_id") % 4 == 2, "1000000").otherwise("unknown")
    body = F.concat(F.lit('{"u":"https://cdn.example/'), key, F.lit('.m3u8"'), F.when(F.col("page_id") % 7 == 0, "").otherwise("}"))
    url = F.concat(F.lit("https://h/"), F.when(F.col("page_id") % 5 == 0, "clip/").otherwise("video/"), key)
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), url.alias("url"), F.lit("application/json").alias("content_type"), length.alias("content_length"), body.alias("body"))
    return responses.playlist_urls(rows).select("seq", "url")


@query(
    """WITH m AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'yt-dlp' WHEN 'view' THEN 'ffmpeg' WHEN 'purchase' THEN 'auto' END AS method, event_id % 2 = 0 AS verify, CASE event_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'browser' END AS source FROM events)
SELECT event_id, CASE WHEN method IN ('yt-dlp', 'auto') THEN 'direct_with_resume' WHEN method = 'ffmpeg' THEN 'remux' END AS way, CASE WHEN method IS NOT NULL THEN 'segments' END AS fallback,
  method IS NOT NULL AND source IS NOT NULL AND source <> 'none' AS cookies, coalesce(method = 'ffmpeg' AND NOT verify, false) AS warns FROM m"""
)
def q43_method_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    method = F.when(kind == "click", "yt-dlp").when(kind == "view", "ffmpeg").when(kind == "purchase", "auto")
    source = F.when(F.col("event_id") % 3 == 0, "none").when(F.col("event_id") % 3 == 1, "browser")
    return table(spark, sf_dir, "events").select("event_id", routing.route(method, source, F.col("event_id") % 2 == 0).alias("r")).select("event_id", "r.*")


@query("""SELECT event_id, CAST(user_id AS VARCHAR) AS video_id, coalesce(CASE WHEN event_id % 4 > 0 THEN event_id END, 0) AS downloaded, coalesce(CASE WHEN event_id % 4 > 0 THEN event_id END, 0) AS total FROM events""")
def q44_remux_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://h/video-1_"), F.col("user_id").cast("string"))
    size = F.when(F.col("event_id") % 4 > 0, F.col("event_id").cast("long"))
    return table(spark, sf_dir, "events").select("event_id", routing.remux_update(url, size).alias("u")).select("event_id", "u.*")


@query(
    """SELECT c_custkey, 'Settings that can''t be used:' || chr(10) || 'TIDEMILL_MAX_RETRIES = (hidden): ' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || 'TIDEMILL_LOG_LEVEL = (hidden): unknown' ELSE '' END AS message FROM customer"""
)
def q45_settings_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.struct(F.lit("max_retries").alias("field"), F.col("c_mktsegment").alias("message"))
    second = F.struct(F.lit("log_level").alias("field"), F.lit("unknown").alias("message"))
    errors = F.when(F.col("c_custkey") % 2 == 0, F.array(first, second)).otherwise(F.array(first))
    return table(spark, sf_dir, "customer").select("c_custkey", routing.settings_message(errors, PREFIX).alias("message"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as a video's attempts, for a third of the users each: one by one, in parallel and of a playlist.

    Views are playlists and segments that got no answer, and some bodies are empty.
    """
    kind, k = F.col("event_type"), F.col("event_id")
    code = F.when(kind == "error", 503).when(kind == "signup", 404).when(kind == "purchase", F.when(k % 2 == 0, 403).otherwise(410)).when(kind == "click", 200)
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("status", code)
    segment = resilience.outcome(F.col("status"), k % 5, F.col("user_id") % 3 == 1)
    playlist = resilience.refresh(F.col("status"), k % 4 > 0, k % 7 > 0)
    return rows.select("user_id", "event_id", "ts", "status", F.when(F.col("user_id") % 3 == 2, playlist).otherwise(segment).alias("step"))


STEPS = """a AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 503 WHEN 'signup' THEN 404 WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 403 ELSE 410 END WHEN 'click' THEN 200 END AS status,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT *, CASE WHEN user_id % 3 = 2 THEN CASE WHEN status IS NULL THEN 'retry' WHEN status = 200 THEN 'text' WHEN status IN (403, 410) AND event_id % 4 > 0 AND event_id % 7 > 0 THEN 'refresh' ELSE 'stop' END
  WHEN status = 200 AND event_id % 5 > 0 THEN 'ok' WHEN status = 503 THEN 'retry' WHEN user_id % 3 = 1 AND coalesce(status, 200) = 200 THEN 'retry' ELSE 'failed' END AS step FROM a),
r AS (SELECT user_id, n, step, status, 0 AS attempt, 0 AS request FROM s WHERE n = 1
  UNION ALL SELECT s.user_id, s.n, s.step, s.status, CASE WHEN r.step IN ('retry', 'refresh') AND r.attempt < 2 THEN r.attempt + 1 ELSE 0 END, CASE WHEN r.step IN ('retry', 'refresh') AND r.attempt < 2 THEN r.request ELSE r.request + 1 END
  FROM r JOIN s ON s.user_id = r.user_id AND s.n = r.n + 1)"""


@query(
    f"""WITH RECURSIVE {STEPS}
SELECT user_id, CAST(request AS BIGINT) AS request, count(*) AS tries, count(*) FILTER (step = 'refresh' AND attempt < 2) AS refreshes,
  CASE WHEN max(attempt) = 2 AND arg_max(step, n) IN ('retry', 'refresh') THEN 'used_up' WHEN arg_max(step, n) IN ('retry', 'refresh') THEN 'open' ELSE arg_max(step, n) END AS fate,
  max(CASE WHEN status = 503 AND attempt < 2 THEN 0.05::DOUBLE * pow(2.0, attempt) END) AS longest FROM r GROUP BY user_id, request"""
)
def q46_request_fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    tried = fate.requests(attempts(spark, sf_dir), ["user_id"], ["ts", "event_id"], "step", 3, hours("ts"))
    wait = F.when(resilience.goes_on(F.col("status"), F.col("attempt"), 3), resilience.longest_delay(F.col("status"), F.col("attempt")))
    return fate.fates(tried, ["user_id"], F.max(wait).alias("longest"))


@query(
    f"""WITH e AS (SELECT doc_id, {ENTRIES} AS e FROM documents), n AS (SELECT doc_id, len(e) AS n, doc_id % 3 <> 1 AS stale FROM e WHERE e IS NOT NULL),
i AS (SELECT doc_id, n, stale, unnest(range(n)) AS i FROM n), f AS (SELECT doc_id, count(*) AS m FROM i WHERE stale OR (doc_id + i) % 4 = 0 GROUP BY doc_id)
SELECT doc_id AS video_id, n AS expected, stale, coalesce(m, 0) AS to_fetch, coalesce(m, 0) = 0 AS ready FROM n LEFT JOIN f USING (doc_id)"""
)
def q47_session_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    playlists = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), F.concat(F.lit("https://h/"), F.col("doc_id").cast("string"), F.lit("/l.m3u8")).alias("m3u8_url"), F.col("text").alias("content"))
    known = playlists.where("video_id % 3 > 0").select("video_id", F.when(F.col("video_id") % 3 == 1, text.signature(text.entries(F.col("content")))).otherwise("another").alias("signature"))
    each = playlists.select("video_id", F.posexplode(text.entries(F.col("content"))).alias("idx", "segment"))
    present = each.where("(video_id + idx) % 4 <> 1 OR idx % 2 = 0").select("video_id", "idx", F.when((F.col("video_id") + F.col("idx")) % 4 == 0, 0).otherwise(188).alias("length"))
    present = present.unionByName(each.where("(video_id + idx) % 4 = 1 AND idx % 2 > 0").select("video_id", "idx", F.lit(1).alias("length")))
    open_ = segments.resume(playlists, known, present).groupBy("video_id").agg(F.count("*").alias("m"))
    whole = playlists.where("content IS NOT NULL").select("video_id", F.size(text.entries(F.col("content"))).cast("long").alias("expected"))
    out = whole.join(segments.stale(playlists, known).select("video_id", "stale"), "video_id").join(open_, "video_id", "left").withColumn("to_fetch", F.coalesce("m", F.lit(0).cast("long")))
    return out.select("video_id", "expected", "stale", "to_fetch", (F.col("to_fetch") == 0).alias("ready"))


@query(
    """WITH p AS (SELECT user_id, ts, arg_max(epoch_us(ts) + CAST(trunc(value * 10 * 1000000) AS BIGINT), event_id) AS until FROM events WHERE event_type = 'error' GROUP BY user_id, ts),
a AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'error')
SELECT event_id, greatest(coalesce(until - epoch_us(a.ts), 0), 0) AS wait_us FROM a ASOF LEFT JOIN p ON p.user_id = a.user_id AND a.ts >= p.ts"""
)
def q48_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    pauses = rows.where("event_type = 'error'").select("user_id", "ts", "event_id", (F.col("value") * 10).alias("seconds"))
    tried = rows.where("event_type <> 'error'").select("user_id", "ts", "event_id")
    return resilience_ops.waits(tried, pauses, "user_id", ["event_id"], slice_by=hours("ts")).select("event_id", "wait_us")


LINES = """l AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'click' THEN 'frame' WHEN 'view' THEN 'speed' WHEN 'error' THEN 'total_size' WHEN 'signup' THEN 'out_time' ELSE 'progress' END AS k,
  CASE event_type WHEN 'click' THEN CAST(event_id AS VARCHAR) WHEN 'view' THEN (event_id % 9) || '.5x' WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'N/A' ELSE CAST(event_id * 1000 AS VARCHAR) END
    WHEN 'signup' THEN '00:' || (event_id % 60) ELSE CASE WHEN event_id % 11 = 0 THEN 'end' ELSE 'continue' END END AS v FROM events)"""


@query(
    f"""WITH {LINES}, e AS (SELECT *, coalesce(bool_or(k = 'progress' AND v = 'end') OVER w, false) AS over, count(*) FILTER (k = 'progress') OVER w AS block FROM l
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT user_id, block, arg_max(v, struct_pack(t := ts, e := event_id)) FILTER (k = 'frame') AS frame, arg_max(v, struct_pack(t := ts, e := event_id)) FILTER (k = 'speed') AS speed,
  arg_max(v, struct_pack(t := ts, e := event_id)) FILTER (k = 'total_size') AS total_size, arg_max(v, struct_pack(t := ts, e := event_id)) FILTER (k = 'out_time') AS out_time,
  arg_max(v, struct_pack(t := ts, e := event_id)) FILTER (k = 'progress') AS progress FROM e WHERE NOT over GROUP BY user_id, block)
SELECT user_id, block, CAST(frame AS INT) AS frame, CAST(rtrim(speed, 'x') AS DOUBLE) AS speed, CAST(nullif(total_size, 'N/A') AS BIGINT) AS total_size, out_time, progress FROM b WHERE progress IS NOT NULL"""
)
def q49_block_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, key = F.col("event_type"), F.col("event_id").cast("string")
    line = F.when(kind == "click", F.concat(F.lit(" frame="), key)).when(kind == "view", F.concat(F.lit("speed="), (F.col("event_id") % 9).cast("string"), F.lit(".5x ")))
    line = line.when(kind == "error", F.concat(F.lit("total_size="), F.when(F.col("event_id") % 3 == 0, "N/A").otherwise((F.col("event_id") * 1000).cast("string"))))
    line = line.when(kind == "signup", F.concat(F.lit("out_time=00:"), (F.col("event_id") % 60).cast("string")))
    line = line.otherwise(F.when(F.col("event_id") % 11 == 0, "progress=end").otherwise("progress=continue"))
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("line", line)
    return progress_ops.block_fields(rows, "user_id", ["ts", "event_id"], hours("ts")).drop("fps", "out_time_us", "out_time_ms")


@query(
    """WITH RECURSIVE c AS (SELECT o_orderkey AS video_id, CAST(floor(o_totalprice / 1000) AS BIGINT) + CASE WHEN o_orderkey % 1000 = 0 THEN 10001 ELSE 0 END AS n FROM orders),
t AS (SELECT video_id, 0 AS level, n AS below, (n + 99) // 100 AS nodes FROM c WHERE n > 0 UNION ALL SELECT video_id, level + 1, nodes, (nodes + 99) // 100 FROM t WHERE nodes > 1 OR level = 0)
SELECT video_id, CAST(level AS INT) AS level, node, node * 100 AS first, least(100, below - node * 100) AS inputs, level > 0 AND nodes = 1 AS is_output FROM (SELECT *, unnest(range(nodes)) AS node FROM t)"""
)
def q50_merge_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.floor(F.col("o_totalprice") / 1000) + F.when(F.col("o_orderkey") % 1000 == 0, 10_001).otherwise(0)
    return segments.merge_tree(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video_id"), n.cast("long").alias("segments")))


def downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From videos' metadata to what is downloaded: the asked stream, its file and the result of each order."""
    lines = table(spark, sf_dir, "lineitem")
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    height = F.when(F.col("l_returnflag") != "R", F.floor("l_quantity").cast("int") * 10)
    address = F.concat(F.lit("https://m.example/"), F.col("l_partkey").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, ".m3u8").otherwise(".mp4"))
    stream = F.struct(address.alias("url"), height.alias("height"), F.when(F.col("l_linestatus") == "F", "none").otherwise("avc1").alias("vcodec"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), stream.alias("s")))), lambda x: x["s"])
    name = F.concat(F.lit("order: "), F.col("l_orderkey").cast("string"))
    body = F.to_json(F.struct(F.col("l_orderkey").cast("string").alias("id"), F.when(F.col("l_orderkey") % 3 > 0, name).otherwise("").alias("title"), F.col("formats")))
    metadata_rows = lines.groupBy("l_orderkey").agg(listed.alias("formats")).select(body.alias("json"))
    streams_ = metadata.streams(metadata_rows)
    wanted = F.element_at(F.array(*map(F.lit, ("best", "worst", "240p", "480", "odd"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("video_id"), wanted.alias("wanted")).distinct()
    # row by row: lists made before the shuffle take more of it, and memory next to the parsed metadata
    chosen = select.choose(asked, streams_.repartition("video_id"), "title", "url")
    failed = status.status_label(F.col("error"), F.col("available"))
    file = F.when(F.col("error").isNull(), urls.output_name(F.col("title"), F.concat(F.lit("1_"), "video_id"), F.col("video_id")))
    return chosen.select("video_id", "wanted", "url", file.alias("output_path"), F.coalesce(failed, F.lit("success")).alias("status"))


DOWNLOADS = """l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos,
  'https://m.example/' || l_partkey || CASE WHEN l_linenumber % 2 = 0 THEN '.m3u8' ELSE '.mp4' END AS url, CASE WHEN l_returnflag <> 'R' THEN CAST(floor(l_quantity) AS INT) * 10 END AS h, l_linestatus FROM lineitem),
s AS (SELECT * FROM l WHERE l_linestatus <> 'F'), w AS (SELECT DISTINCT o_orderkey AS k, ['best', 'worst', '240p', '480', 'odd'][o_orderkey % 5 + 1] AS wanted FROM orders),
o AS (SELECT k, first(url ORDER BY (h IS NOT NULL) DESC, coalesce(h, 0) DESC, pos) AS best, first(url ORDER BY (h IS NULL), coalesce(h, 0), pos) AS worst,
  first(url ORDER BY pos) FILTER (h = 240) AS u240, first(url ORDER BY pos) FILTER (h = 480) AS u480 FROM s GROUP BY k),
c AS (SELECT w.k, wanted, o.k IS NOT NULL AS there, CASE wanted WHEN 'best' THEN best WHEN 'worst' THEN worst WHEN '240p' THEN u240 WHEN '480' THEN u480 END AS url FROM w LEFT JOIN o ON o.k = w.k),
d AS (SELECT CAST(k AS VARCHAR) AS video_id, wanted, url, CASE WHEN url IS NOT NULL THEN CASE WHEN k % 3 > 0 THEN 'order_ ' || k ELSE CAST(k AS VARCHAR) END || '_1_' || k || '.mp4' END AS output_path,
  CASE WHEN wanted = 'odd' THEN 'invalid_quality' WHEN url IS NOT NULL THEN 'success' WHEN there THEN 'quality_not_available' ELSE 'no_streams' END AS status FROM c)"""


@query(f"WITH {DOWNLOADS} SELECT video_id, wanted, url, output_path, status FROM d")
def q51_download_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return downloads(spark, sf_dir)


@query(f"WITH {DOWNLOADS} SELECT wanted, count(*) AS total, count(*) FILTER (status = 'success') AS successful, count(*) FILTER (status <> 'success') AS failed FROM d GROUP BY ROLLUP (wanted)")
def q52_download_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.summary_by(downloads(spark, sf_dir), "wanted", F.col("status") == "success")


@query(
    r"""WITH u AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS site, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages),
d AS (SELECT *, regexp_replace(path, '[^/]*$', '') AS dir FROM u)
SELECT page_id, site || CASE WHEN path = '' THEN '/' ELSE regexp_replace(dir, '[^/]+/$', '') END || 'up.ts' AS up, site || CASE WHEN path = '' THEN '' ELSE path END || '?t=1' AS same, regexp_extract(site, '^([a-z]+:)', 1) || '//cdn.example/x/' AS other FROM d"""
)
def q53_relative_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {"up": "./../up.ts", "same": "?t=1", "other": "//cdn.example/x/"}
    return table(spark, sf_dir, "pages").select("page_id", *[urls.join(F.col("url"), F.lit(s)).alias(n) for n, s in parts.items()])


@query(
    """WITH u AS (SELECT page_id, CASE page_id % 6 WHEN 1 THEN '' WHEN 2 THEN '   ' WHEN 3 THEN upper(url) WHEN 4 THEN '//h/video-' || page_id || '_7' WHEN 5 THEN url END AS u FROM pages)
SELECT page_id, CASE WHEN regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') THEN lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1) || '/***REDACTED***' ELSE '***REDACTED***' END AS redacted,
  CASE WHEN trim(u) LIKE 'http://%' OR trim(u) LIKE 'https://%' THEN trim(u) ELSE 'https://' || regexp_replace(trim(u), '^//?', '') END AS normal,
  coalesce(page_id % 6 = 4, false) AS has_id, CASE WHEN page_id % 6 = 4 THEN page_id || '_7' END AS full_id, coalesce(contains(lower(u), '.m3u8'), false) AS playlist FROM u"""
)
def q54_odd_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 6
    given = F.when(k == 1, "").when(k == 2, "   ").when(k == 3, F.upper("url")).when(k == 4, F.concat(F.lit("//h/video-"), F.col("page_id").cast("string"), F.lit("_7"))).when(k == 5, F.col("url"))
    rows = table(spark, sf_dir, "pages").select("page_id", given.alias("u"))
    u = F.col("u")
    return rows.select("page_id", urls.redact(u).alias("redacted"), urls.normalize(u).alias("normal"), urls.has_video_id(u).alias("has_id"), urls.full_id(u).alias("full_id"), urls.is_playlist(u).alias("playlist"))


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS video_id, CASE WHEN o_orderkey % 12 < 6 THEN 'full' END AS title, 1 AS pos, 'https://m.example/' || o_orderkey || '.M3U8' AS url, 'mp4' AS format, 'unknown' AS quality,
  CAST(NULL AS VARCHAR) AS resolution, CAST(NULL AS INT) AS bitrate FROM orders WHERE o_orderkey % 6 = 5"""
)
def q55_odd_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, k = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 6
    stream = F.concat(F.lit('{"url":null,"height":720},{"url":"https://m.example/'), key, F.lit('.M3U8","height":null,"width":640,"vcodec":null}'))
    full = F.when(F.col("o_orderkey") % 12 < 6, '"full"').otherwise("null")
    whole = F.concat(F.lit('{"id":"'), key, F.lit('","title":null,"fulltitle":'), full, F.lit(',"formats":['), stream, F.lit("]}"))
    body = F.when(k == 1, "").when(k == 2, "not json").when(k == 3, "{}").when(k == 4, '{"id":"x","formats":null}').when(k == 5, whole)
    return metadata.streams(table(spark, sf_dir, "orders").select(body.alias("json"))).drop("width", "height")


@query(
    """SELECT event_id, event_id % 7 AS level, CASE event_type WHEN 'error' THEN 'extraction_error' WHEN 'click' THEN 'path_traversal' WHEN 'view' THEN 'unexpected_error' END AS error_code, value IS NOT NULL AND event_id % 2 = 0 AS told,
  event_id % 3 = 0 AS master FROM events"""
)
def q56_log_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "extraction").when(F.col("event_type") == "click", "path_traversal").when(F.col("event_type") == "view", "base").when(F.col("event_type") == "signup", "OSError")
    message = F.when(F.col("event_id") % 2 == 0, F.col("value").cast("string"))
    playlist = F.concat(F.lit("#EXTM3U\n"), F.when(F.col("event_id") % 3 == 0, "#EXT-X-STREAM-INF:BANDWIDTH=1\n").otherwise("#EXTINF:4,\n"), F.lit("a.m3u8\n"))
    rows = table(spark, sf_dir, "events").select("event_id", status.log_context(kind, message).alias("context"), text.is_master(playlist).alias("master"))
    return rows.select("event_id", (F.col("event_id") % 7).alias("level"), "context.error_code", F.col("context.message").isNotNull().alias("told"), "master")


@query(
    """SELECT user_id // 10 AS batch, CASE WHEN count(*) FILTER (event_type = 'signup') > 20 THEN 130 WHEN count(*) FILTER (value < 1) = 0 THEN 0 ELSE 1 END AS exit_code FROM events GROUP BY user_id // 10"""
)
def q57_exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.floor(F.col("user_id") / 10).alias("batch"), F.when(F.col("value") >= 1, "success").otherwise("failed").alias("status"), (F.col("event_type") == "signup").alias("broke"))
    return results.exit_codes(rows, "batch", F.count_if("broke") > 20)
