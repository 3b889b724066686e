"""What the vector searches share: checked vectors, blocks of queries against streams of candidates, running top k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

QUERY_EVERY = 20
TOP = 20


def checked(df: DataFrame, scale: float | None = None, zero: bool = True) -> DataFrame:
    """vec_id, dim, size (length) and vec (doubles as binary) of the rows of vec_id and embedding that take part.

    Left out are rows whose id or vector is null and vectors that are empty or hold null or non-finite components;
    with zero=False also zero vectors. With a scale each component x becomes floor(scale * x).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
            offsets = np.asarray(column.offsets).astype(np.int64)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
            if scale is not None:
                values = np.floor(scale * values)
            dims = np.diff(offsets)
            fit = (bad[offsets[1:]] == bad[offsets[:-1]]) & (dims > 0) & np.asarray(column.is_valid()) & np.asarray(batch.column("vec_id").is_valid())
            rows = [values[a:b] for a, b in zip(offsets[:-1][fit].tolist(), offsets[1:][fit].tolist(), strict=True)]
            size = np.array([np.sqrt(v @ v) for v in rows])
            ids = np.asarray(batch.column("vec_id").filter(pa.array(fit)))
            if not zero:
                some = np.array([bool(v.any()) for v in rows], dtype=bool)
                rows, size, ids, dims = [v for v, s in zip(rows, some, strict=True) if s], size[some], ids[some], dims[fit][some]
            else:
                dims = dims[fit]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(size, pa.float64()), pa.array([v.tobytes() for v in rows], pa.binary())], ["vec_id", "dim", "size", "vec"])

    source = pick(df, "vec_id", "embedding").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return source.mapInArrow(run, "vec_id long, dim int, size double, vec binary")


def queries_of(vectors: DataFrame, every: int = QUERY_EVERY) -> DataFrame:
    """The rows whose vec_id is divisible by `every`; of repeated ids the smallest row."""
    rows = vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("dim", "size", "vec")).alias("r"))
    return rows.select("vec_id", "r.*")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The rows cut where (grp, dim, side) changes; rows come sorted by them."""
    for batch in batches:
        keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("grp", "dim", "side")])
        edges = np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [batch.num_rows])) if batch.num_rows else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield tuple(keys[:, a].tolist()), batch.slice(int(a), int(b - a))


class Best:
    """The k largest scores of each of n queries so far; equal scores go to the smaller id."""

    def __init__(self, n: int, k: int, dtype: type):
        self.low = np.iinfo(np.int64).min if dtype is np.int64 else -np.inf
        self.scores = np.full((n, k), self.low, dtype=dtype)
        self.ids = np.full((n, k), np.iinfo(np.int64).max, dtype=np.int64)
        self.k = k

    def least(self) -> np.ndarray:
        """What a score must reach to enter."""
        return self.scores[:, -1]

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(rows):
            return
        touched = np.unique(rows)
        all_rows = np.concatenate((np.repeat(touched, self.k), rows))
        all_ids = np.concatenate((self.ids[touched].ravel(), ids))
        all_scores = np.concatenate((self.scores[touched].ravel(), scores))
        order = np.lexsort((all_ids, np.negative(np.maximum(all_scores, self.low + 1)) if self.scores.dtype == np.int64 else -all_scores, all_rows))
        all_rows = all_rows[order]
        start = np.searchsorted(all_rows, touched)
        place = np.arange(len(all_rows)) - np.repeat(start, np.diff(np.concatenate((start, [len(all_rows)]))))
        keep = place < self.k
        self.ids[touched] = all_ids[order][keep].reshape(len(touched), self.k)
        self.scores[touched] = all_scores[order][keep].reshape(len(touched), self.k)

    def add_block(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, own: np.ndarray) -> None:
        """Scores of queries `rows` (whose ids are own) by candidates ids; a query's own id is left out."""
        scores = np.where(ids[None, :] == own[:, None], self.low, scores)
        floor = self.least()[rows]
        if scores.shape[1] > self.k:
            floor = np.maximum(floor, np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k])
        i, j = np.nonzero((scores >= floor[:, None]) & (scores > self.low))
        self.add(rows[i], ids[j], scores[i, j])

    def batch(self, own: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
        i, j = np.nonzero(self.scores > self.low)
        return pa.RecordBatch.from_arrays([pa.array(own[i], pa.int64()), pa.array(self.ids[i, j], pa.int64()), pa.array(self.scores[i, j], kind)], ["query_id", "vec_id", "score"])


def best_of_all(found: DataFrame, k: int = TOP) -> DataFrame:
    """Each query's k best of what the blocks found, with rank."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
