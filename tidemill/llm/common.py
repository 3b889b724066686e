"""What the training-data operators share: column picking, lineage cuts, joins on hot keys, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The columns' types, for tables written without a schema.
DOCUMENT_TYPES = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A key with over 1 / HOT_SHARE of all rows is hot, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 1000
#: Rows that go to a Python worker at a time.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Has a session's Arrow batches hold BATCH_ROWS rows at most from now on, as whole texts may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, found by exact name first and then without regard to case.

    Works by position, so further columns may have any names, equal ones included; they are dropped. Operators begin
    here, so it also bounds the batches that go to Python workers.
    """
    small_batches(df.sparkSession)
    have = df.columns
    folded = [c.lower() for c in have]
    inner = [f"c{i}" for i in range(len(have))]
    at = [have.index(n) if n in have else folded.index(n.lower()) for n in names]
    return df.toDF(*inner).select(*[F.col(inner[p]).alias(n) for p, n in zip(at, names, strict=True)])


def documents_of(df: DataFrame) -> DataFrame:
    """The five columns of `documents`, with their types; further columns are dropped."""
    return pick(df, *DOCUMENT_COLUMNS).select(*[F.col(c).cast(t).alias(c) for c, t in DOCUMENT_TYPES.items()])


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, UPPER.lower())


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. One is made only where none is set and all runs in one process, as in tests;
    on a cluster a folder of one machine would not do, so that raises."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder, with no lineage; for narrow rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def write(df: DataFrame) -> str:
    """The path, in the shared checkpoint folder, of the rows written as Parquet."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder as Parquet; for whole documents."""
    return df.sparkSession.read.parquet(write(df))


def delete(spark: SparkSession, path: str) -> None:
    """Deletes what `write` has written, when nothing reads it any more."""
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Has the actions on tables made inside delete their shuffle files as they end.

    Else these stay until the driver happens to collect its garbage, and an operator of many actions holds those of all.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def join_hot(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, how: str = "left") -> DataFrame:
    """left joined to right, which has one row for each key and in `weight` the key's number of rows in left.

    Keys with over total / HOT_SHARE rows are fewer than HOT_SHARE, so their right rows are broadcast and the
    left rows stay where they are; the other keys are shuffled, and none of them can fill a task.
    """
    limit = max(total // HOT_SHARE, 1000)
    hot = right.where(F.col(weight) > limit).drop(weight)
    rest = right.where(F.col(weight) <= limit).drop(weight)
    marked = left.join(F.broadcast(hot.select(key).withColumn("hot_key", F.lit(True))), key, "left")
    is_hot = F.coalesce(F.col("hot_key"), F.lit(False))
    a = marked.where(is_hot).drop("hot_key").join(F.broadcast(hot), key, how)
    b = marked.where(~is_hot).drop("hot_key").join(rest, key, how)
    return a.unionByName(b)


def running_sum(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """rows with `name`, the sum of `value` (no nulls) over the rows of the same keys that come before in order.

    rows are read twice, so they come from a written table or a checkpoint; order should tell all rows of a key apart.
    They are dealt out by ranges of keys and order, so a key of many rows is spread over many tasks, and summed inside
    a range. Of each range only the sums of its first and last key come to the driver, and what the first key has in the
    ranges before goes back as one row for each range.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(rows.repartitionByRange(parts, *keys, *order).withColumn("part", F.spark_partition_id()))
    ends = dealt.groupBy("part", *keys).agg(F.sum(value).alias("amount")).groupBy("part").agg(F.min(F.struct(*keys, "amount")).alias("first"), F.max(F.struct(*keys, "amount")).alias("last"))
    offsets, key, carried = [], None, 0
    for r in sorted(ends.collect(), key=lambda r: r.part):
        first, last = tuple(r.first)[:-1], tuple(r.last)[:-1]
        offset = carried if first == key else 0
        offsets.append((r.part, *first, offset))
        key, carried = last, r.last.amount + (offset if first == last else 0)
    fields = [dealt.schema["part"], *[dealt.schema[k] for k in keys]]
    schema = ", ".join([f"p{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)] + ["carried long"])
    same = [F.col(f.name).eqNullSafe(F.col(f"p{i}")) for i, f in enumerate(fields)]
    before = Window.partitionBy("part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.join(F.broadcast(spark.createDataFrame(offsets, schema)), same, "left")
    inside = F.coalesce(F.sum(value).over(before), F.lit(0))
    return joined.withColumn(name, F.coalesce("carried", F.lit(0)) + inside).drop("part", "carried", *[f"p{i}" for i in range(len(fields))])


def texts(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column, null as empty."""
    return [t if t is not None else "" for t in column.to_pylist()]


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column, null as empty."""
    return [t if t is not None else b"" for t in column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 8_000_000) -> Iterable[pa.RecordBatch]:
    """The batches cut so that each has about `most` bytes of text, or one row."""
    for batch in batches:
        size = np.asarray(pc.binary_length(batch.column(column)).fill_null(0)).astype(np.int64)
        ends = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            base = ends[at] - size[at]
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def matrix(column: pa.Array, dtype: type = np.float64) -> np.ndarray:
    """Rows of an Arrow binary column of equally long vectors."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), dtype=dtype).reshape(len(parts), -1) if parts else np.zeros((0, 0), dtype)
