"""Text files: url lists, playlists, captured logs, segment folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators.slices import sum_before


def texts(spark: SparkSession, path: str) -> DataFrame:
    """path and content of whole files; one row for each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("content"))


def numbered_lines(files: DataFrame) -> DataFrame:
    """source, line_no (from 0) and line of rows of path and content."""
    return files.select(F.col("path").alias("source"), F.posexplode(text.lines(F.col("content"))).alias("line_no", "line"))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """source, line_no (from 0) and line of text files of any size: read in splits, numbered over them.

    For captured logs; lines end with CR, LF or both, and at no other break of Unicode (numbered_lines, for playlists
    and url lists, knows those as well).
    """
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))
    return sum_before(read, ["source"], ["split", "place"], F.lit(1).cast("long"), F.col("split"), "line_no").select("source", "line_no", "line")


def url_list(files: DataFrame) -> DataFrame:
    """source, pos, line and valid (has a video id) of the entries of url lists, in order."""
    rows = numbered_lines(files).select("source", F.col("line_no").alias("pos"), text.strip(F.col("line")).alias("line"))
    return rows.where(text.is_entry(F.col("line"))).withColumn("valid", urls.has_video_id(F.col("line")))


def segment_folder(spark: SparkSession, path: str) -> DataFrame:
    """idx and length of a folder's segment files; names that are no number, as of merged batches, are left out, and
    so are empty files, which count as missing."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.ts").load(path).select("path", "length")
    idx = F.regexp_extract("path", r"/(\d+)\.ts$", 1)
    return found.where(idx != "").select(idx.cast("int").alias("idx"), "length")


def segment_folders(spark: SparkSession, folders: str) -> DataFrame:
    """video_id, idx and length of the segment files in all folders that a glob names, as segment_folder's.

    A video's folder is named `.<name>_segments`, or anything else that is its id. Names that begin with a dot are
    hidden from Spark's listing, so the glob must reach the folders themselves, such as `media/*/*`; the driver expands
    it and a job lists the files.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.ts").load(folders).select("path", "length")
    folder, idx = F.url_decode(F.regexp_extract("path", r"/([^/]+)/\d+\.ts$", 1)), F.regexp_extract("path", r"/(\d+)\.ts$", 1)
    return found.where(idx != "").select(F.regexp_replace(folder, r"^\.(.*)_segments$", "$1").alias("video_id"), idx.cast("int").alias("idx"), "length")


def write_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
