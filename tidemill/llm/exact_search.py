"""Exact top-k search by inner product over norm-bucketed vectors.

The HEAD longest candidates are the first bucket: every query is scored against them, and its k-th best score there is
its floor. A candidate shorter than floor / |q| can't enter that query's best, so queries of similar such reach form a
band, and a candidate is sent only to the bands that its length reaches.
Queries of a band are dealt into blocks and candidates into splits; each pair of block and split is one group of rows,
sorted so that the queries come first and then the candidates by falling length. A task holds a block of queries and one
bucket of candidates of similar length at a time. With the k-th best score t of a query q so far (its floor at least) and a bucket's
largest length l, the local cosine threshold is t / (|q| l): above 1 the bucket can't matter, and as lengths only
fall neither can any later one; where it is high, candidates are pruned by their largest-weight coordinate, else by
length alone. What is left is verified by its product.

Products are of integers and exact: by doubles where no sum can reach 2^53, else by Python integers, with scores
beyond 64 bits set to the nearest long.

Defined cases: vectors that are null, empty or hold null or non-finite components, and rows with a null id, take no
part. Only vectors of equal dimension meet. Repeated ids: of a query the smallest row is used, candidates count row
by row; no row with the query's id is its candidate. Fewer than k candidates: all are returned. An empty table gives
an empty result. Further columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import cut, matrix
from .vectors import TOP, Best, best_of_all, checked, queries_of, runs

SCALE = 64.0
QUERIES, CANDIDATES = 1024, 8192
#: Longest candidates that give the floors (they are broadcast), and bands of queries, at most.
HEAD, BANDS = 1024, 16
#: Tasks, at most; a task takes its groups one after another.
MOST_TASKS = 20_000
#: Candidates of a bucket, at most, and the least ratio of its shortest to its longest.
BUCKET, RATIO = 1024, 0.9
#: Local cosine threshold from which coordinates prune.
COORDINATE_FROM = 0.7
SLACK = 1e-9


class Block:
    """A block of queries and its best candidates so far; scores under a query's floor are not taken."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, sizes: np.ndarray, floors: np.ndarray, k: int):
        self.ids, self.vectors, self.sizes, self.floors = ids, vectors, sizes, floors
        self.best = Best(len(ids), k, np.int64)
        self.most = float(np.abs(vectors).max(initial=0.0))
        self.over = False

    def products(self, rows: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        if self.most * np.abs(vectors).max(initial=0.0) * vectors.shape[1] < 2**53:
            return (self.vectors[rows] @ vectors.T).astype(np.int64)
        a = np.vectorize(int, otypes=[object])(self.vectors[rows])
        b = np.vectorize(int, otypes=[object])(vectors)
        limit = np.iinfo(np.int64)
        return np.array([[max(limit.min + 1, min(limit.max, sum(x * y for x, y in zip(p, q, strict=True)))) for q in b] for p in a], dtype=np.int64).reshape(len(a), len(b))

    def add(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        scores = self.products(rows, vectors)
        scores[scores < self.floors[rows][:, None]] = self.best.low
        self.best.add_block(rows, ids, scores, self.ids[rows])

    def bucket(self, ids: np.ndarray, vectors: np.ndarray, sizes: np.ndarray) -> None:
        """One bucket: candidates by falling length."""
        least = np.maximum(self.best.least(), self.floors).astype(np.float64)
        reach = self.sizes * sizes[0]
        rows = np.flatnonzero(least <= reach * (1 + SLACK) + SLACK)
        if not len(rows):
            self.over = True
            return
        cosine = np.where(reach[rows] > 0, least[rows] / np.maximum(reach[rows], 1e-300), -1.0)
        sharp = cosine >= COORDINATE_FROM
        self._by_length(rows[~sharp], ids, vectors, sizes, least)
        self._by_coordinate(rows[sharp], ids, vectors, sizes, least)

    def _by_length(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, sizes: np.ndarray, least: np.ndarray) -> None:
        if len(rows):
            shortest = np.min(least[rows] / np.maximum(self.sizes[rows], 1e-300))
            n = int(np.searchsorted(-sizes, -shortest * (1 - SLACK) + SLACK, side="right")) if shortest > 0 else len(ids)
            if n:
                self.add(rows, ids[:n], vectors[:n])

    def _by_coordinate(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, sizes: np.ndarray, least: np.ndarray) -> None:
        if not len(rows):
            return
        unit = self.vectors[rows] / self.sizes[rows][:, None]
        focus = np.argmax(np.abs(unit), axis=1)
        for f in np.unique(focus):
            mine = rows[focus == f]
            q = unit[focus == f, f]
            c = vectors[:, f] / np.maximum(sizes, 1e-300)
            # the largest cosine that vectors with these coordinates can have
            bound = np.outer(q, c) + np.outer(np.sqrt(np.maximum(0, 1 - q * q)), np.sqrt(np.maximum(0, 1 - c * c)))
            left = bound * np.outer(self.sizes[mine], sizes) >= least[mine][:, None] * (1 - SLACK) - SLACK
            some = left.any(axis=0)
            if some.any():
                self.add(mine, ids[some], vectors[some])


def buckets(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of buckets of lengths that fall."""
    at = 0
    while at < len(sizes):
        to = int(np.searchsorted(-sizes, -sizes[at] * RATIO, side="right"))
        to = min(max(to, at + 1), at + BUCKET)
        yield at, to
        at = to


def floored(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The queries with floor, the k-th best score among the HEAD longest candidates, and reach, the length from which
    a candidate can have that score."""
    head: dict[int, list[Row]] = {}
    for r in vectors.select("dim", "vec_id", "vec", "size").orderBy(F.desc("size"), "vec_id").limit(HEAD).collect():
        head.setdefault(r.dim, []).append(r)
    longest = {dim: (np.array([r.vec_id for r in rows]), np.frombuffer(b"".join(r.vec for r in rows)).reshape(len(rows), -1)) for dim, rows in head.items()}
    shared = vectors.sparkSession.sparkContext.broadcast(longest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                sizes, none = np.array(part.column("size")), np.full(part.num_rows, np.iinfo(np.int64).min)
                block = Block(np.array(part.column("vec_id")), matrix(part.column("vec")), sizes, none, k)
                if dim in shared.value:
                    block.add(np.arange(part.num_rows), *shared.value[dim])
                floor = block.best.least()
                reach = np.where((floor > 0) & (sizes > 0), floor / np.maximum(sizes, 1e-300) * (1 - SLACK) - SLACK, 0.0)
                columns = [*[part.column(c) for c in ("vec_id", "dim", "size", "vec")], pa.array(floor), pa.array(np.maximum(reach, 0.0))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "dim", "size", "vec", "floor", "reach"])

    return queries.select("vec_id", "dim", "size", "vec").mapInArrow(run, "vec_id long, dim int, size double, vec binary, floor long, reach double")


def dealt(vectors: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, int]:
    """The rows of all groups of a block and a split, queries and those candidates that their band needs; and the number of groups."""
    queries = cut(floored(vectors, queries, k))
    asked, held = queries.count(), vectors.count()
    bands = max(1, min(BANDS, math.ceil(asked / QUERIES)))
    edges = sorted(set(queries.approxQuantile("reach", [i / bands for i in range(1, bands)], 0.01))) if bands > 1 else []
    band = reduce(lambda x, e: x + (F.col("reach") >= e).cast("int"), edges, F.lit(0))
    # at most BANDS rows
    found = {r.band: r for r in queries.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.min("reach").alias("least")).collect()}
    sizes = [math.ceil(found[i].n / QUERIES) if i in found else 0 for i in range(len(edges) + 1)]
    blocks, splits = sum(sizes), max(1, math.ceil(held / CANDIDATES))
    first, of_band = (F.get(F.array(*map(F.lit, x)), band) for x in ([sum(sizes[:i]) for i in range(len(sizes))], sizes))
    # bands come by rising reach, so a candidate's blocks are the first so many
    needed = reduce(lambda x, b: x + F.when(F.col("size") >= found[b].least, sizes[b]).otherwise(0), found, F.lit(0))

    def grouped(df: DataFrame, side: int, floor: Column) -> DataFrame:
        return df.select((F.col("block") * splits + F.col("split")).cast("long").alias("grp"), "dim", F.lit(side).alias("side"), "vec_id", "size", "vec", floor.alias("floor"))

    asking = queries.withColumn("block", first + F.pmod(F.xxhash64("vec_id"), of_band)).withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    offered = vectors.withColumn("needed", needed).where("needed > 0").withColumn("block", F.explode(F.expr("sequence(0, needed - 1)"))).withColumn("split", F.pmod(F.xxhash64(F.lit("split"), "vec_id", "vec"), F.lit(splits)))
    return grouped(asking, 0, F.col("floor")).unionByName(grouped(offered, 1, F.lit(0).cast("long"))), max(1, blocks * splits)


def search(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """query_id, vec_id and score of each group's best k for its queries; best_of_all joins the groups."""
    rows, groups = dealt(vectors, queries, k)
    tasks = rows.repartition(min(groups, MOST_TASKS), "grp").sortWithinPartitions("grp", "dim", "side", F.desc("size"), "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at, held = None, None, []

        def rest() -> Iterator[pa.RecordBatch]:
            if block is not None:
                flush()
                yield block.best.batch(block.ids, pa.int64())

        def flush() -> None:
            if held and not block.over:
                ids, sizes = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                data = np.concatenate([h[2] for h in held])
                for a, b in buckets(sizes):
                    if not block.over:
                        block.bucket(ids[a:b], data[a:b], sizes[a:b])
            held.clear()

        for (grp, dim, side), part in runs(batches):
            ids, sizes, data = np.array(part.column("vec_id")), np.array(part.column("size")), matrix(part.column("vec"))
            if at != (grp, dim):
                yield from rest()
                held.clear()
                block, at = None, (grp, dim)
            if side == 0:
                own = (ids, data, sizes, np.array(part.column("floor")))
                block = Block(*own, k) if block is None else Block(*map(np.concatenate, zip((block.ids, block.vectors, block.sizes, block.floors), own, strict=True)), k)
            elif block is not None and not block.over:
                held.append((ids, sizes, data))
                if sum(len(h[0]) for h in held) >= BUCKET:
                    flush()
        yield from rest()

    return tasks.mapInArrow(run, "query_id long, vec_id long, score long")


def op6(embeddings: DataFrame) -> DataFrame:
    vectors = cut(checked(embeddings, scale=SCALE))
    return best_of_all(search(vectors, queries_of(vectors)))
