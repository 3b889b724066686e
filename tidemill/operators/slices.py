"""What came before a row of its key; keys of many rows are worked out in slices of the order, so that none is one
task's work.

A slice is a value that doesn't fall along the order, such as an hour of a time. Sums or last values go over the slices
first (one row for each), then over the rows inside a slice. Keys of up to MOST_ROWS rows need no slices: a window
sorts them, and where all keys are such nothing else runs but a count. A null key is a key; without slices each key is
one window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a key that one task sorts.
MOST_ROWS = 1_000_000


def hours(ts: Column | str) -> Column:
    """The hour that a time lies in, as a slice."""
    return F.floor(F.unix_micros(ts) / 3_600_000_000)


def _with_slices(rows: DataFrame, keys: list[str], slice_by: Column, whole: Column, over_slices: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """rows with _slice and columns computed over the slices from each slice's `whole`."""
    marked = rows.withColumn("_slice", slice_by)
    each = marked.groupBy(*keys, "_slice").agg(whole.alias("_whole"))
    names = {k: f"_key{i}" for i, k in enumerate([*keys, "_slice"])}
    over = each.select(*[F.col(k).alias(n) for k, n in names.items()], *[f(F.col("_whole"), F.col("_slice")).alias(n) for n, f in over_slices.items()])
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return marked.join(over, same).drop(*names.values())


def _earlier(keys: list[str], *order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def by_size(rows: DataFrame, keys: list[str], slice_by: Column | None, plain: Callable[[DataFrame], DataFrame], sliced: Callable[[DataFrame], DataFrame], count: bool = True) -> DataFrame:
    """plain of the keys of up to MOST_ROWS rows and sliced of the others, of which there are few beside rows; all is
    sliced if they need no count."""
    if slice_by is None:
        return plain(rows)
    if not count:
        return sliced(rows)
    names = [f"_large{i}" for i in range(len(keys))]
    large = rows.groupBy(*keys).count().where(F.col("count") > MOST_ROWS).select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)])
    if large.isEmpty():
        return plain(rows)
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    return plain(rows.join(large, same, "left_anti")).unionByName(sliced(rows.join(large, same, "left_semi")))


def sum_before(rows: DataFrame, keys: list[str], order: list[str], value: Column, slice_by: Column | None, name: str, total: str | None = None, count: bool = True) -> DataFrame:
    """rows with `name`, the sum of value over the key's rows before, and `total`, over all of the key's rows.

    Without count all keys are taken as large.
    """
    zero = F.lit(0).cast("long")

    def plain(some: DataFrame) -> DataFrame:
        out = some.withColumn(name, F.coalesce(F.sum(value).over(_earlier(keys, *order)), zero))
        return out.withColumn(total, F.sum(value).over(Window.partitionBy(*keys))) if total else out

    over = {"_before": lambda whole, _: F.coalesce(F.sum(whole).over(_earlier(keys, "_slice")), zero)}
    if total:
        over[total] = lambda whole, _: F.sum(whole).over(Window.partitionBy(*keys))
    inside = F.coalesce(F.sum(value).over(_earlier([*keys, "_slice"], *order)), zero)

    def sliced(some: DataFrame) -> DataFrame:
        return _with_slices(some, keys, slice_by, F.sum(value), over).withColumn(name, F.col("_before") + inside).drop("_slice", "_before")

    return by_size(rows, keys, slice_by, plain, sliced, count)


def last_before(rows: DataFrame, keys: list[str], order: list[str], value: Column, slice_by: Column | None, name: str, count: bool = True) -> DataFrame:
    """rows with `name`, the last value that isn't null over the key's rows before; count as for sum_before."""
    last = F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))
    over = {"_before": lambda whole, _: F.last_value(whole, ignoreNulls=True).over(_earlier(keys, "_slice"))}

    def plain(some: DataFrame) -> DataFrame:
        return some.withColumn(name, F.last_value(value, ignoreNulls=True).over(_earlier(keys, *order)))

    def sliced(some: DataFrame) -> DataFrame:
        inside = F.last_value(value, ignoreNulls=True).over(_earlier([*keys, "_slice"], *order))
        return _with_slices(some, keys, slice_by, last, over).withColumn(name, F.coalesce(inside, F.col("_before"))).drop("_slice", "_before")

    return by_size(rows, keys, slice_by, plain, sliced, count)
