"""What is left to fetch of a playlist, and in which order it is merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls

#: Fixed value: segments of one batch of a merge.
FAN_IN = 100


def segments(playlists: DataFrame) -> DataFrame:
    """video_id, idx, segment and url of the segments of rows of video_id, m3u8_url and content."""
    each = playlists.select("video_id", "m3u8_url", F.posexplode(text.entries(F.col("content"))).alias("idx", "segment"))
    return each.select("video_id", "idx", "segment", urls.resolve(F.col("m3u8_url"), F.col("segment")).alias("url"))


def stale(playlists: DataFrame, stored: DataFrame) -> DataFrame:
    """video_id, signature and stale: whether the stored signature is another or missing, so that files are void."""
    now = playlists.select("video_id", text.signature(text.entries(F.col("content"))).alias("signature"))
    old = stored.select("video_id", F.col("signature").alias("stored"))
    return now.join(old, "video_id", "left").select("video_id", "signature", (~F.col("signature").eqNullSafe(F.col("stored"))).alias("stale"))


def kept(present: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The files that are still good: those of videos whose signature is the stored one. verdicts as `stale` gives them."""
    return present.join(verdicts.where("NOT stale").select("video_id"), "video_id", "left_semi")


def resume(playlists: DataFrame, stored: DataFrame, present: DataFrame) -> DataFrame:
    """video_id, idx, segment and url of what is to be fetched: all of a changed playlist, else what has no file."""
    verdicts = stale(playlists, stored)
    return missing(segments(playlists), kept(present, verdicts), "video_id", "idx")


def missing(expected: DataFrame, present: DataFrame, *keys: str) -> DataFrame:
    """Expected rows without a file that isn't empty."""
    return expected.join(present.where("length > 0"), list(keys), "left_anti")


def session(expected: DataFrame, present: DataFrame) -> DataFrame:
    """video_id, expected, missing and ready: with nothing missing the merge can begin."""
    there = present.where("length > 0").select("video_id", "idx", F.lit(True).alias("there")).distinct()
    rows = expected.join(there, ["video_id", "idx"], "left").groupBy("video_id")
    out = rows.agg(F.count("*").alias("expected"), F.count_if(F.col("there").isNull()).alias("missing"))
    return out.withColumn("ready", F.col("missing") == 0)


def tally(results: DataFrame) -> DataFrame:
    """video_id, segments, all_ok and the failed indexes in order."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("idx"))))
    return results.groupBy("video_id").agg(F.count("*").alias("segments"), F.bool_and("ok").alias("all_ok"), failed.alias("failed"))


def merge_batches(expected: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """video_id, batch_start, segments and the list of file names of each batch of a merge."""
    start = (F.col("idx") - F.col("idx") % fan_in).alias("batch_start")
    ordered = F.array_sort(F.collect_list("idx"))
    line = F.transform(ordered, lambda i: F.concat(F.lit("file '"), urls.segment_name(i), F.lit("'")))
    return expected.groupBy("video_id", start).agg(F.count("*").alias("segments"), F.array_join(line, "\n").alias("listing"))


def merge_tree(counts: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """The merges that make one file of each video's segments: video_id, level, node, first, inputs and is_output.

    counts: video_id and segments. A merge of level 0 takes up to fan_in segments from `first` on, one of a higher level
    so many nodes of the level below. The last one makes the output; there is one above level 0 even for one batch.
    """
    n, fan = F.col("segments"), F.lit(fan_in)
    # sizes: the number of nodes of each level; 64 bits of segments have no more than 64 levels
    sizes = F.aggregate(
        F.sequence(F.lit(1), F.lit(64)),
        F.array(F.ceil(n / fan)),
        lambda done, _: F.when((F.element_at(done, -1) > 1) | (F.size(done) == 1), F.concat(done, F.array(F.ceil(F.element_at(done, -1) / fan)))).otherwise(done),
    )
    levels = counts.where(n > 0).select("video_id", n.alias("below"), F.posexplode(sizes).alias("level", "nodes"), sizes.alias("sizes"))
    below = F.when(F.col("level") == 0, F.col("below")).otherwise(F.get("sizes", F.col("level") - 1))
    each = levels.withColumn("below", below).withColumn("node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nodes") - 1)))
    first = F.col("node") * fan_in
    return each.select("video_id", "level", "node", first.alias("first"), F.least(F.lit(fan_in).cast("long"), F.col("below") - first).alias("inputs"), (F.col("level") == F.size("sizes") - 1).alias("is_output"))


def missing_files(expected: DataFrame, present: DataFrame) -> DataFrame:
    """video_id and the names of files without which a merge can't begin, in order."""
    lost = missing(expected.select("video_id", "idx"), present, "video_id", "idx")
    return lost.groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list("idx")), urls.segment_name).alias("names"))
