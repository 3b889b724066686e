"""Schemas of the engine's tables. Order is never implied: each list has its position as a column."""

from __future__ import annotations

URL_LIST = "pos bigint, line string"
STREAMS = "video_id string, pos int, url string, format string, quality string, resolution string, bitrate int, width int, height int"
PLAYLISTS = "video_id string, m3u8_url string, content string"
SEGMENTS_PRESENT = "video_id string, idx int, length bigint"
SEGMENT_RESULTS = "video_id string, idx int, ok boolean"
RESPONSES = "seq bigint, url string, content_type string, content_length string, body string"
PROGRESS_LINES = "source string, line_no bigint, line string"
ATTEMPTS = "url string, segment_index int, status int, retry_after string, ts timestamp"
PAUSES = "video_url string, ts timestamp, duration_s double"
PROGRESS_UPDATES = "url_index int, downloaded bigint, total bigint, ts timestamp"
BATCH_RESULTS = "pos int, url string, output_path string, status string"
ERRORS = "kind string, message string, requested string, available array<string>"
#: What is read of a video's metadata.
METADATA = "id string, title string, fulltitle string, formats array<struct<url:string,vcodec:string,height:int,width:int,tbr:double>>"
