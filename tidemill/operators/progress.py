"""Progress of downloads: blocks of lines, the latest state, one line for all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import progress, text
from .slices import by_size, sum_before


def _ones(where: Column) -> Column:
    return F.when(where, 1).otherwise(0).cast("long")


def blocks(lines: DataFrame, key: str, order: list[str], terminator: Column, slice_by: Column | None = None, count: bool = True) -> DataFrame:
    """lines with block: the number of terminators before; a block without its own terminator is left out.

    slice_by doesn't fall along the order and deals a key's lines out; without count all keys are taken as large.
    """
    return sum_before(lines, [key], order, _ones(terminator), slice_by, "block", "n_blocks", count).where("block < n_blocks").drop("n_blocks")


def block_fields(lines: DataFrame, key: str, order: list[str], slice_by: Column | None = None, strict: bool = True) -> DataFrame:
    """A row for each finished block of `line`s: key, block and the fields with their types, the last value of each.

    Lines after the end are left out, a block without its progress line too. A field that is missing or N/A is null; a
    bad number raises, or is null with strict=False.
    """
    pairs = lines.withColumn("_pair", text.key_value(F.col("line"))).where("_pair IS NOT NULL")
    name = F.col("_pair")["key"]

    def finished(some: DataFrame, by: Column | None) -> DataFrame:
        rows = until_end(some, key, order, (name == "progress") & (F.col("_pair")["value"] == "end"), by, count=False)
        return blocks(rows, key, order, name == "progress", by, count=False)

    rows = by_size(pairs, [key], slice_by, lambda some: finished(some, None), lambda some: finished(some, slice_by))
    last = [F.max_by(F.col("_pair")["value"], F.when(name == f, F.struct(*order))).alias(f) for f in progress.FIELDS]
    whole = rows.groupBy(key, "block").agg(*last)
    return whole.select(key, "block", *[progress.field(f, F.col(f), strict).alias(f) for f in progress.FIELDS])


def until_end(lines: DataFrame, key: str, order: list[str], end: Column, slice_by: Column | None = None, count: bool = True) -> DataFrame:
    """lines up to the first end, itself included; slice_by and count as for blocks."""
    return sum_before(lines, [key], order, _ones(end), slice_by, "_ends", count=count).where("_ends = 0").drop("_ends")


def latest(updates: DataFrame, key: str, order: list[str], *keep: str) -> DataFrame:
    """The last update of each key."""
    return updates.groupBy(key).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("s")).select(key, "s.*")


def progress_text(state: DataFrame, n: int) -> DataFrame:
    """One row: the state of videos 0 to n - 1 in order, 0/0 for those without one. n is a batch's few videos."""
    index = state.sparkSession.range(n).select(F.col("id").cast("int").alias("url_index"))
    part = F.concat(F.lit("video_"), F.col("url_index").cast("string"), F.lit(": "), F.coalesce("downloaded", F.lit(0)).cast("string"), F.lit("/"), F.coalesce("total", F.lit(0)).cast("string"))
    rows = index.join(state, "url_index", "left").select("url_index", part.alias("part"))
    ordered = F.array_sort(F.collect_list(F.struct("url_index", "part")))
    return rows.agg(F.array_join(F.transform(ordered, lambda x: x["part"]), ", ").alias("progress"))


def progress_texts(state: DataFrame, size: int) -> DataFrame:
    """batch and progress: a text for each batch of `size` videos (by url_index) that has a state, as progress_text's."""
    part = F.concat(F.coalesce("downloaded", F.lit(0)).cast("string"), F.lit("/"), F.coalesce("total", F.lit(0)).cast("string"))
    place = F.pmod("url_index", F.lit(size)).cast("int")
    rows = state.groupBy(F.floor(F.col("url_index") / size).alias("batch")).agg(F.map_from_entries(F.collect_list(F.struct(place, part))).alias("known"))

    def line(i: Column) -> Column:
        return F.concat(F.lit("video_"), (F.col("batch") * size + i).cast("string"), F.lit(": "), F.coalesce(F.element_at("known", i), F.lit("0/0")))

    return rows.select("batch", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), line), ", ").alias("progress"))
