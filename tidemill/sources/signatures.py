"""A table of the playlists' signatures, kept as snapshots.

A folder holds one snapshot after the other, each a whole table of video_id and signature. A change writes the next
one beside the last; it counts once its files are committed, so readers see the old table or the new one, and a change
that failed or is run again leaves the table as if it had run once.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

SCHEMA = "video_id string, signature string"


def _last(spark: SparkSession, path: str) -> int:
    """The number of the last snapshot, -1 before the first."""
    try:
        found = spark.read.schema(f"{SCHEMA}, snapshot int").parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return -1
        raise
    last = found.agg(F.max("snapshot").alias("n")).first().n
    return -1 if last is None else last


def stored(spark: SparkSession, path: str) -> DataFrame:
    """video_id and signature of the last snapshot."""
    last = _last(spark, path)
    return spark.createDataFrame([], SCHEMA) if last < 0 else spark.read.schema(SCHEMA).parquet(f"{path}/snapshot={last}")


def update(playlists: DataFrame, path: str) -> DataFrame:
    """The table with the signatures of rows of video_id and content in place of older ones; written only if any differs.

    A video that is there twice keeps the greater signature.
    """
    spark = playlists.sparkSession
    now = playlists.groupBy(F.col("video_id").cast("string").alias("video_id")).agg(F.max(text.signature(text.entries(F.col("content")))).alias("new"))
    last = _last(spark, path)
    merged = stored(spark, path).join(now, "video_id", "full")
    if not merged.where("new IS NOT NULL AND NOT new <=> signature").isEmpty():
        merged.select("video_id", F.coalesce("new", "signature").alias("signature")).write.mode("overwrite").parquet(f"{path}/snapshot={last + 1}")
    return stored(spark, path)
