"""Labels of streams and requested qualities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The qualities that can be asked for.
QUALITIES = ("240", "360", "480", "720", "1080", "1440", "2160", "best", "worst")


def _set(c: Column) -> Column:
    """Null for 0 and for empty text."""
    return F.nullif(c, F.lit(0))


def label(height: Column) -> Column:
    return F.coalesce(F.concat(_set(height).cast("string"), F.lit("p")), F.lit("unknown"))


def resolution(width: Column, height: Column) -> Column:
    return F.concat(_set(width).cast("string"), F.lit("x"), _set(height).cast("string"))


def bitrate(total: Column) -> Column:
    return _set(total.cast("double")).cast("int")


def stream_format(url: Column) -> Column:
    return F.when(url.contains(".m3u8"), "hls").otherwise("mp4")


def title(first: Column, full: Column) -> Column:
    return F.coalesce(F.nullif(first, F.lit("")), full)


def parse(asked: Column) -> Column:
    """The quality asked for; trailing p's are ignored, empty means best, null marks an error."""
    bare = F.rtrim(asked, F.lit("p"))
    return F.when(asked == "", "best").when(asked.isin(*QUALITIES), asked).when(bare.isin(*QUALITIES), bare)


def normalise(quality: Column) -> Column:
    """Without any p."""
    return F.replace(quality, F.lit("p"), F.lit(""))


def as_number(quality: Column) -> Column:
    """The label's number for sorting, 0 if it is none."""
    return F.coalesce(normalise(quality).try_cast("bigint"), F.lit(0).cast("long"))


def selector(quality: Column) -> Column:
    """The format expression: heights up to a number, else the best."""
    n = normalise(quality)
    return F.when(n.rlike(r"^\d+$"), F.concat(F.lit("best[height<="), n, F.lit("]"))).otherwise("best")
