"""Videos' metadata as tables of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import quality


def streams(metadata: DataFrame, column: str = "json") -> DataFrame:
    """A row for each stream with a picture and a url, in the metadata's order; others are dropped."""
    parsed = metadata.select(F.from_json(column, schemas.METADATA).alias("m"))
    each = parsed.select(F.col("m.id").alias("video_id"), quality.title(F.col("m.title"), F.col("m.fulltitle")).alias("title"), F.posexplode("m.formats").alias("pos", "f"))
    kept = each.where(~F.col("f.vcodec").eqNullSafe("none") & (F.coalesce("f.url", F.lit("")) != ""))
    return kept.select(
        "video_id", "title", "pos", F.col("f.url").alias("url"), quality.stream_format(F.col("f.url")).alias("format"), quality.label(F.col("f.height")).alias("quality"),
        quality.resolution(F.col("f.width"), F.col("f.height")).alias("resolution"), quality.bitrate(F.col("f.tbr")).alias("bitrate"), F.col("f.width").alias("width"), F.col("f.height").alias("height"),
    )
