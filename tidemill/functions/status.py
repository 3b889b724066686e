"""Statuses of results and errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The errors' codes and labels.
CODES = {
    "base": "unexpected_error",
    "video_not_found": "video_not_found",
    "invalid_url": "invalid_url",
    "quality_not_available": "quality_not_available",
    "quality_parse": "quality_parse_error",
    "extraction": "extraction_error",
    "download": "download_error",
    "path_traversal": "path_traversal",
}
LABELS = {
    "base": "error: unexpected_error",
    "video_not_found": "video_not_found",
    "invalid_url": "invalid_url",
    "quality_parse": "invalid_quality",
    "extraction": "extraction_error",
    "download": "download_error",
    "path_traversal": "download_error",
}
PREFIXES = LABELS | {"base": "download_error"}


def _choose(kind: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for name, value in table.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def _none(available: Column) -> Column:
    return F.coalesce(F.size(available), F.lit(0)) <= 0


def error_code(kind: Column) -> Column:
    return _choose(kind, CODES)


def status_label(kind: Column, available: Column) -> Column:
    """The label of an error; a missing quality says whether there were any streams."""
    missing = F.when(_none(available), "no_streams").otherwise("quality_not_available")
    return F.when(kind == "quality_not_available", missing).otherwise(_choose(kind, LABELS))


def legacy_status(kind: Column, message: Column, requested: Column, available: Column) -> Column:
    """The older one-line form; other kinds are the names of unexpected errors."""
    asked = F.coalesce(requested, F.lit(""))
    listed = F.concat(F.lit("quality_not_available: requested "), asked, F.lit("p, available: "), F.array_join(F.coalesce(available, F.array().cast("array<string>")), ", "))
    missing = F.when(_none(available) & (asked != ""), F.concat(F.lit("no_streams: "), message)).otherwise(listed)
    prefix = _choose(kind, PREFIXES)
    return F.when(kind == "quality_not_available", missing).when(prefix.isNull(), F.concat(F.lit("unexpected_error: "), kind)).otherwise(F.concat(prefix, F.lit(": "), message))


def log_context(kind: Column, message: Column) -> Column:
    return F.struct(error_code(kind).alias("error_code"), message.alias("message"))


def correlation_id() -> Column:
    """Eight hexadecimal digits, another for each row."""
    return F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 8)
