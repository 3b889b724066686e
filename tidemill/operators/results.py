"""Results of batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gather(url_list: DataFrame, results: DataFrame) -> DataFrame:
    """url_list with each position's result; what has none was cancelled."""
    return url_list.join(results.select("pos", "output_path", "status"), "pos", "left").withColumn("status", F.coalesce("status", F.lit("cancelled")))


def counts(success: Column) -> list[Column]:
    return [F.count("*").alias("total"), F.count_if(success).alias("successful"), (F.count("*") - F.count_if(success)).alias("failed")]


def summary(results: DataFrame, skipped: int = 0) -> DataFrame:
    """One row: total, successful, failed and skipped."""
    return results.agg(*counts(F.col("status") == "success")).withColumn("skipped", F.lit(skipped))


def summary_by(results: DataFrame, column: str, success: Column) -> DataFrame:
    """The counts for each value of a column and, with null there, for all."""
    return results.rollup(column).agg(*counts(success))


def failures(results: DataFrame) -> DataFrame:
    """Failed urls with their reasons; pos keeps the input's order."""
    return results.where(F.col("status") != "success").select("pos", "url", "status")


#: Fixed value: the exit code of a run that its user broke off.
BROKEN_OFF = 130


def _code(broken_off: Column | None) -> Column:
    code = F.when((F.count("*") > 0) & (F.count_if(F.col("status") != "success") == 0), 0).otherwise(1)
    return (code if broken_off is None else F.when(broken_off, BROKEN_OFF).otherwise(code)).alias("exit_code")


def exit_code(results: DataFrame, broken_off: Column | None = None) -> DataFrame:
    """One row: 130 if the run was broken off (an aggregate over results), 0 if there are results and all are
    successful, else 1."""
    return results.agg(_code(broken_off))


def exit_codes(results: DataFrame, batch: str, broken_off: Column | None = None) -> DataFrame:
    """The exit code of each batch."""
    return results.groupBy(batch).agg(_code(broken_off))


def ordered_distinct(values: Column) -> Column:
    """The distinct elements of an array by first occurrence."""
    return F.array_distinct(values)
