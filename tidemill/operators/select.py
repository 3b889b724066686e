"""Choosing a video's stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quality

TOP = 8


def _height() -> Column:
    return F.coalesce("height", F.lit(0))


def best_stream(streams: DataFrame, *keep: str) -> DataFrame:
    """Each video's stream of the largest known height; the first of equal ones."""
    order = F.struct(F.col("height").isNotNull(), _height(), -F.col("pos"))
    return streams.groupBy("video_id").agg(F.max_by(F.struct(*keep), order).alias("s")).select("video_id", "s.*")


def worst_stream(streams: DataFrame, *keep: str) -> DataFrame:
    """Each video's stream of the least known height; unknown ones last, the first of equal ones."""
    order = F.struct(F.col("height").isNull(), _height(), F.col("pos"))
    return streams.groupBy("video_id").agg(F.min_by(F.struct(*keep), order).alias("s")).select("video_id", "s.*")


def exact_stream(streams: DataFrame, wanted: str, *keep: str) -> DataFrame:
    """Each video's first stream of a quality, with or without a p."""
    bare = wanted.replace("p", "")
    return streams.where(F.col("quality").isin(wanted, bare, f"{bare}p")).groupBy("video_id").agg(F.min_by(F.struct(*keep), "pos").alias("s")).select("video_id", "s.*")


def catalog(streams: DataFrame) -> DataFrame:
    """Each video's distinct qualities, the largest number first and equal numbers by name."""
    ranked = F.array_sort(F.collect_set(F.struct((-quality.as_number(F.col("quality"))).alias("k"), F.col("quality").alias("q"))))
    return streams.groupBy("video_id").agg(F.transform(ranked, lambda x: x["q"]).alias("qualities"))


def choose(requests: DataFrame, streams: DataFrame, *keep: str) -> DataFrame:
    """requests of video_id and wanted: the chosen stream's pos, or an error with what there is.

    error is null, quality_parse or quality_not_available; available lists the qualities in the streams' order,
    with repeats. keep names further columns of the chosen stream, null without one; if a video has several streams at
    the chosen pos, each makes a row.
    """
    best = F.max_by("pos", F.struct(F.col("height").isNotNull(), _height(), -F.col("pos")))
    worst = F.min_by("pos", F.struct(F.col("height").isNull(), _height(), F.col("pos")))
    listed = F.array_sort(F.collect_list(F.struct("pos", "quality", *keep)))
    offer = streams.groupBy("video_id").agg(best.alias("best"), worst.alias("worst"), listed.alias("offer"))
    both = requests.join(offer, "video_id", "left").withColumn("asked", quality.parse(F.col("wanted")))
    bare = quality.normalise(F.col("asked"))
    fits = F.filter("offer", lambda s: (s["quality"] == bare) | (s["quality"] == F.concat(bare, F.lit("p"))))
    pos = F.when(F.col("asked") == "best", F.col("best")).when(F.col("asked") == "worst", F.col("worst")).otherwise(F.get(fits, F.lit(0))["pos"])
    error = F.when(F.col("asked").isNull(), "quality_parse").when(pos.isNull(), "quality_not_available")
    available = F.coalesce(F.transform("offer", lambda s: s["quality"]), F.array().cast("array<string>"))
    out = ["video_id", "wanted", "pos", "error", "available"]
    chosen = both.withColumns({"pos": F.when(F.col("asked").isNotNull(), pos), "error": error, "available": available})
    if not keep:
        return chosen.select(*out)
    there = F.transform(F.filter("offer", lambda s: s["pos"] == F.col("pos")), lambda s: F.struct(*[s[c].alias(c) for c in keep]))
    return chosen.select(*out, F.inline_outer(there))
