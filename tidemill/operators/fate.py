"""What becomes of a request over its attempts.

A key's attempts are gone through in order: one that is neither tried again nor refreshed ends its request, and so does
the last of the tries that a request has; the next attempt begins another request. That state is the number of
attempts since the last end, which sums and last values before a row give, so a key's history needs no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.resilience import GOING_ON
from .slices import by_size, last_before, sum_before


def requests(attempts: DataFrame, keys: list[str], order: list[str], step: str, tries: int, slice_by: Column | None = None) -> DataFrame:
    """attempts with request (from 0 for each key), attempt (from 0 for each request) and fate: the step, or used_up
    where another try would follow but none is left.

    step is a column that says what an attempt leads to; slice_by doesn't fall along the order and deals a key's rows
    out.
    """
    goes_on = F.col(step).isin(*GOING_ON)

    def numbered(rows: DataFrame, by: Column | None) -> DataFrame:
        rows = sum_before(rows, keys, order, F.lit(1).cast("long"), by, "_place", count=False)
        rows = last_before(rows, keys, order, F.when(~goes_on, F.col("_place") + 1), by, "_begin", count=False)
        rows = rows.withColumn("attempt", ((F.col("_place") - F.coalesce("_begin", F.lit(0))) % tries).cast("int"))
        rows = rows.withColumn("fate", F.when(goes_on & (F.col("attempt") == tries - 1), "used_up").otherwise(F.col(step)))
        ends = F.when(F.col("fate").isin(*GOING_ON), 0).otherwise(1).cast("long")
        return sum_before(rows, keys, order, ends, by, "request", count=False).drop("_place", "_begin")

    return by_size(attempts, keys, slice_by, lambda rows: numbered(rows, None), lambda rows: numbered(rows, slice_by))


def fates(tried: DataFrame, keys: list[str], *further: Column) -> DataFrame:
    """A row for each request of `requests`: tries, refreshes and its last attempt's fate, open where the attempts stop
    before the request ends; further aggregates come along."""
    last = F.max_by("fate", "attempt")
    fate = F.when(last.isin(*GOING_ON), "open").otherwise(last)
    return tried.groupBy(*keys, "request").agg(F.count("*").alias("tries"), F.count_if(F.col("fate") == "refresh").alias("refreshes"), fate.alias("fate"), *further)
