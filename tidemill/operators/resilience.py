"""Attempts, pauses and concurrency over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.resilience import PAUSE
from .slices import last_before, sum_before


def numbered_attempts(rows: DataFrame, keys: list[str], order: list[str], slice_by: Column | None = None) -> DataFrame:
    """rows with attempt, from 0 for each key; slice_by doesn't fall along the order and deals a key's rows out."""
    return sum_before(rows, keys, order, F.lit(1).cast("long"), slice_by, "attempt").withColumn("attempt", F.col("attempt").cast("int"))


def paused(rows: DataFrame, key: str, order: list[str], is_pause: Column, ts: str = "ts", seconds: float = PAUSE, slice_by: Column | None = None) -> DataFrame:
    """rows with paused: whether the key's last pause before the row, and no earlier one, still lasts at its time."""
    until = F.when(is_pause, F.unix_micros(ts) + F.lit(int(seconds * 1_000_000)))
    known = last_before(rows, [key], order, until, slice_by, "until")
    return known.withColumn("paused", F.coalesce(F.unix_micros(ts) < F.col("until"), F.lit(False))).drop("until")


def waits(attempts: DataFrame, pauses: DataFrame, key: str, order: list[str], ts: str = "ts", slice_by: Column | None = None) -> DataFrame:
    """attempts with wait_us: how long each still has to wait, in microseconds, for the last pause of its key that was
    set at or before its time; 0 without one. A later pause replaces an earlier one, even a longer one.

    pauses: the key, the time, seconds, and `order`, which tells rows of one time apart in both tables. An as-of join:
    both tables in one order of time, each attempt with the last value before it; slice_by is made of key and time.
    """
    until = F.unix_micros(ts) + (F.col("seconds") * 1_000_000).cast("long")
    marked = attempts.withColumn("_until", F.lit(None).cast("long")).withColumn("_kind", F.lit(1))
    both = marked.unionByName(pauses.select(key, ts, *order, until.alias("_until"), F.lit(0).alias("_kind")), allowMissingColumns=True)
    known = last_before(both, [key], [ts, "_kind", *order], F.col("_until"), slice_by, "_last").where("_kind = 1")
    left = F.greatest(F.col("_last") - F.unix_micros(ts), F.lit(0).cast("long"))
    return known.withColumn("wait_us", F.coalesce(left, F.lit(0).cast("long"))).drop("_until", "_kind", "_last")


def peak_concurrency(intervals: DataFrame, key: str, slice_seconds: int = 3600) -> DataFrame:
    """The most intervals of a key that are open at one time; one that ends when another begins doesn't overlap it.

    intervals: key, started and ended in microseconds. Starts and ends are summed up in slices of time and then over
    slices, so that a key with very many intervals is not one task's work.
    """
    begin = intervals.select(key, F.col("started").alias("t"), F.lit(1).alias("delta"))
    end = intervals.select(key, F.col("ended").alias("t"), F.lit(-1).alias("delta"))
    steps = begin.unionByName(end).groupBy(key, "t").agg(F.sum("delta").alias("net"))
    steps = steps.withColumn("slice", F.floor(F.col("t") / (slice_seconds * 1_000_000)))
    sums = steps.groupBy(key, "slice").agg(F.sum("net").alias("slice_net"))
    earlier = Window.partitionBy(key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(key, "slice", F.coalesce(F.sum("slice_net").over(earlier), F.lit(0)).alias("open"))
    inside = Window.partitionBy(key, "slice").orderBy("t")
    running = steps.withColumn("running", F.sum("net").over(inside)).join(offsets, [key, "slice"])
    return running.groupBy(key).agg(F.greatest(F.max(F.col("running") + F.col("open")), F.lit(0)).alias("peak"))
