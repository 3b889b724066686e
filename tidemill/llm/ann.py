"""Approximate nearest neighbours by inner product: an inverted file with product-quantised residuals.

Fitting. Coarse centroids and, for the residuals, a codebook for each group of components are fitted by k-means on at
most SAMPLE rows, those with the smallest hashes, shared by the dimensions there are. There are about as many lists as
the square root of the rows: COARSE centroids at most, and where that is fewer each one's list is divided by finer
centroids, fitted on the residuals. Every row is then indexed: its nearest centroid's list, its residual's codes and
their error.
Search. Each query probes lists of its own choice. With the lists' sizes and the spread of their residuals, taken as
normal, the score of its k-th neighbour is estimated, and from that the share of the neighbours in each list; lists are
probed by falling share until they hold `cover` of all, so a query in a tight group probes few and one far from all
groups many. cover is the least with which, on the sample, the WORST of the queries with the lowest recall still reach
RECALL. Small lists are packed into splits and large ones dealt into several; a task holds a split and a block of
queries at a time. There tables of the queries' products with all codebook entries give every probed row's approximate
score by lookups. The best by that, k and one in RERANKED_OF of the split's rows, are scored exactly on the original
vectors, and then all others whose approximate score comes within ERRORS times its usual error of the k-th exact one.
The splits' best are joined for each query.

Recall on the tables here, which are close to random directions and so hard: see the README.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id, take
no part. Only vectors of equal dimension meet. Repeated ids: of a query the smallest row is used, candidates count
row by row; no row with the query's id is its candidate. Fewer candidates than k are all returned. An empty table gives an empty result. Further columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, matrix
from .vectors import TOP, Best, best_of_all, checked, queries_of, runs

SAMPLE = 16_000
COARSE = 1000
#: The share of queries whose mean recall on the sample is to be RECALL at least.
WORST, RECALL = 0.1, 0.93
#: Usual errors of an approximate score within which a row is scored exactly.
ERRORS = 3.0
#: Rows that a query sees at least, as a multiple of k.
LEAST = 5
#: Queries of the sample by which cover is chosen, and steps in which a k-th score is estimated.
TRIED, STEPS = 400, 14
#: Components of one sub-vector, entries of its codebook.
WIDTH, ENTRIES = 4, 256
CHUNK, QUERIES, RERANKED_OF = 8192, 4096, 64
#: Pairs of query and row that are scored exactly at a time.
RESCORED = 200_000
#: Pairs of query and row for a task, and tasks, at most; a task takes its groups one after another.
PAIRS, MOST_TASKS = 8_000_000, 20_000
ROUNDS, SEED = 8, 20_240_229


def k_means(data: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Up to k centroids."""
    centres = data[rng.permutation(len(data))[:k]].copy()
    for _ in range(ROUNDS):
        near = nearest(data, centres)
        order = np.argsort(near, kind="stable")
        some, first, count = np.unique(near[order], return_index=True, return_counts=True)
        centres[some] = np.add.reduceat(data[order], first, axis=0) / count[:, None]
    return centres


def nearest(data: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(data), dtype=np.int64)
    half = (centres**2).sum(axis=1) / 2
    for at in range(0, len(data), 4096):
        out[at : at + 4096] = np.argmax(data[at : at + 4096] @ centres.T - half, axis=1)
    return out


def beyond(x: np.ndarray) -> np.ndarray:
    """The share of a normal distribution above x, to a few millionths (a polynomial for the error function)."""
    t = 1 / (1 + 0.3275911 * np.abs(x) / math.sqrt(2))
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-x * x / 2) / 2
    return np.where(x >= 0, tail, 1 - tail)


class Model:
    """Centroids and codebooks for one dimension of `rows` rows."""

    def __init__(self, sample: np.ndarray, rows: int, k: int = TOP):
        rng = np.random.default_rng(SEED)
        wanted = max(1, round(math.sqrt(rows)))
        self.coarse = k_means(sample, min(COARSE, wanted), rng)
        rest = sample - self.coarse[nearest(sample, self.coarse)]
        finer = math.ceil(wanted / COARSE)
        self.fine = k_means(rest, finer, rng) if finer > 1 else np.zeros((1, sample.shape[1]))
        self.lists = len(self.coarse) * len(self.fine)
        lists, rest = self._listed(sample)
        count = np.bincount(lists, minlength=self.lists)
        squares = np.bincount(lists, (rest**2).sum(axis=1), minlength=self.lists)
        usual = squares.sum() / max(len(sample), 1)
        #: The spread of a list's residuals along a direction; the usual one weighs as much as two rows.
        self.spread = np.sqrt((squares + 2 * usual) / (count + 2) / sample.shape[1])
        self.parts = np.array_split(np.arange(sample.shape[1]), math.ceil(sample.shape[1] / WIDTH))
        self.books = [k_means(rest[:, p], ENTRIES, rng) for p in self.parts]
        self.cover = self._enough(sample, lists, count, k)

    def _listed(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = nearest(data, self.coarse)
        rest = data - self.coarse[first]
        second = nearest(rest, self.fine)
        return first * len(self.fine) + second, rest - self.fine[second]

    def products(self, queries: np.ndarray) -> np.ndarray:
        """The inner product of each query with each list's centre."""
        return ((queries @ self.coarse.T)[:, :, None] + (queries @ self.fine.T)[:, None, :]).reshape(len(queries), -1)

    def _shares(self, queries: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
        """The estimated share of each query's k neighbours in each list, which orders the lists; where it is next to
        nothing the products do."""
        centre = self.products(queries)
        spread = np.maximum(np.linalg.norm(queries, axis=1)[:, None] * self.spread[None, :], 1e-300)
        held = sizes > 0
        low, high = (centre - 6 * spread)[:, held].min(axis=1), (centre + 8 * spread)[:, held].max(axis=1)
        for _ in range(STEPS):
            middle = (low + high) / 2
            above = beyond((middle[:, None] - centre) / spread) @ sizes
            low, high = np.where(above > k, middle, low), np.where(above > k, high, middle)
        reach = np.maximum(np.ptp(centre, axis=1), 1e-300)[:, None]
        share = beyond((low[:, None] - centre) / spread) * sizes
        return share / np.maximum(share.sum(axis=1), 1e-300)[:, None] + 1e-9 * (centre - centre.min(axis=1)[:, None]) / reach

    def _enough(self, sample: np.ndarray, lists: np.ndarray, sizes: np.ndarray, k: int) -> float:
        """The least cover with which the lowest recalls of some of the sample's rows are RECALL on average."""
        if len(sample) <= k:
            return math.inf
        tried = sample[:TRIED]
        score = tried @ sample.T
        score[np.arange(len(tried)), np.arange(len(tried))] = -np.inf
        near = np.argpartition(-score, k - 1, axis=1)[:, :k]
        share = self._shares(tried, sizes, k)
        order = np.argsort(-share, axis=1, kind="stable")
        ranked = np.take_along_axis(share, order, axis=1)
        before = np.empty_like(share)
        np.put_along_axis(before, order, np.cumsum(ranked, axis=1) - ranked, axis=1)
        needed = np.take_along_axis(before, lists[near], axis=1)  # what must be covered for a neighbour to be seen
        worst = max(1, round(WORST * len(tried)))
        covers = np.unique(np.quantile(needed, np.linspace(0.5, 1, 200)))
        enough = [c for c in covers.tolist() if np.sort((needed <= c).mean(axis=1))[:worst].mean() >= RECALL]
        return enough[0] if enough else math.inf

    def index(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row's list, codes and the error of its codes along a direction."""
        lists, rest = self._listed(data)
        codes = np.stack([nearest(rest[:, p], b) for p, b in zip(self.parts, self.books, strict=True)], axis=1)
        lost = sum(((rest[:, p] - b[codes[:, j]]) ** 2).sum(axis=1) for j, (p, b) in enumerate(zip(self.parts, self.books, strict=True)))
        return lists, codes.astype(np.uint8), np.sqrt(lost / data.shape[1])

    def probes(self, queries: np.ndarray, sizes: np.ndarray, k: int = TOP) -> list[np.ndarray]:
        """Each query's lists, the likeliest first; sizes are the lists' rows."""
        out = []
        step = max(1, 4_000_000 // self.lists)
        for at in range(0, len(queries), step):
            share = self._shares(queries[at : at + step], sizes, k)
            order = np.argsort(-share, axis=1, kind="stable")
            ranked = np.take_along_axis(share, order, axis=1)
            wanted = (np.cumsum(ranked, axis=1) - ranked <= self.cover).sum(axis=1)
            few = (np.cumsum(sizes[order], axis=1) - sizes[order] <= LEAST * k).sum(axis=1)
            out += [row[: max(int(n), int(m))] for row, n, m in zip(order, wanted, few, strict=True)]
        return out

    def approximate(self, queries: np.ndarray, probing: list[np.ndarray], lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Scores of rows by the queries' tables, -inf where a query doesn't probe the row's list; rows come by list."""
        tables = [np.ascontiguousarray((book @ queries[:, p].T).astype(np.float32)) for p, book in zip(self.parts, self.books, strict=True)]
        coarse = self.products(queries).T.astype(np.float32)
        asked = np.zeros((self.lists, len(queries)), dtype=bool)
        for i, probed in enumerate(probing):
            asked[probed, i] = True
        out = np.full((len(codes), len(queries)), -np.inf, dtype=np.float32)
        edges = np.concatenate((np.flatnonzero(np.diff(lists, prepend=-1)), [len(lists)]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            who = asked[lists[a]]
            few = 3 * who.sum() < len(who)  # their tables are taken apart; else all are looked up, which is as fast
            if not who.any():
                continue
            part = np.repeat((coarse[lists[a]][who] if few else coarse[lists[a]])[None, :], b - a, axis=0)
            for j, table in enumerate(tables):
                part += np.take(table[:, who] if few else table, codes[a:b, j], axis=0)
            if few:
                out[a:b, who] = part
            else:
                out[a:b] = np.where(who, part, -np.inf)
        return np.ascontiguousarray(out.T)


def fit(vectors: DataFrame, k: int = TOP) -> dict[int, Model]:
    """A model for each dimension, on SAMPLE rows at most in all."""
    counts = {r.dim: r.n for r in vectors.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    first = Window.partitionBy("dim").orderBy(F.xxhash64("vec_id"), "vec_id", "vec")
    chosen = vectors.select("dim", "vec", F.row_number().over(first).alias("place")).where(F.col("place") <= max(1, SAMPLE // len(counts)))
    held: dict[int, list[bytes]] = {}
    for r in chosen.orderBy("dim", "place").collect():
        held.setdefault(r.dim, []).append(r.vec)
    return {dim: Model(np.frombuffer(b"".join(vecs)).reshape(len(vecs), -1), counts[dim], k) for dim, vecs in held.items()}


def indexed(vectors: DataFrame, models: dict[int, Model]) -> DataFrame:
    """The vectors with list, codes and error."""
    shared = vectors.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                lists, codes, error = shared.value[dim].index(matrix(part.column("vec")))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("vec_id", "dim", "vec")], pa.array(lists, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], ["vec_id", "dim", "vec", "list", "codes", "error"])

    return vectors.select("vec_id", "dim", "vec").mapInArrow(run, "vec_id long, dim int, vec binary, list int, codes binary, error double")


def packed(sizes: dict[tuple[int, int], int]) -> dict[tuple[int, int], tuple[int, int]]:
    """Each list's first split and number of splits: large lists have several of their own, small ones share one."""
    out, next_split, room, last = {}, 0, 0, None
    for dim, k in sorted(sizes):
        n = sizes[dim, k]
        if n > CHUNK:
            out[dim, k] = (next_split, math.ceil(n / CHUNK))
            next_split, room = next_split + out[dim, k][1], 0
        else:
            if n > room or dim != last:
                next_split, room = next_split + 1, CHUNK
            out[dim, k], room, last = (next_split - 1, 1), room - n, dim
    return out


def probing(queries: DataFrame, models: dict[int, Model], sizes: dict[tuple[int, int], int], k: int) -> DataFrame:
    """vec_id, dim, vec and the lists that a query probes."""
    shared = queries.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims).tolist():
                part, model = batch.filter(pa.array(dims == dim)), shared.value[dim]
                rows = np.array([sizes.get((dim, i), 0) for i in range(model.lists)])
                lists = [np.sort(x[rows[x] > 0]) for x in model.probes(matrix(part.column("vec")), rows, k)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("vec_id", "dim", "vec")], pa.array([x.astype(np.int32) for x in lists], pa.list_(pa.int32()))], ["vec_id", "dim", "vec", "lists"])

    return queries.select("vec_id", "dim", "vec").mapInArrow(run, "vec_id long, dim int, vec binary, lists array<int>")


def search(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """query_id, vec_id and score: what each group finds for its queries; best_of_all joins the groups."""
    spark, models = vectors.sparkSession, fit(vectors, k)
    index = cut(indexed(vectors, models))
    sizes = {(r.dim, r.list): r.n for r in index.groupBy("dim", "list").agg(F.count("*").alias("n")).collect()}  # a model's lists
    probes = cut(probing(queries, models, sizes, k))
    splits = packed(sizes)
    places = F.broadcast(spark.createDataFrame([(*key, *place) for key, place in splits.items()], "dim int, list int, first long, splits int"))
    each = probes.select("vec_id", "dim", F.explode("lists").alias("list")).join(places, ["dim", "list"]).groupBy("first", "splits")
    asked = {r["first"]: (r.splits, r.n) for r in each.agg(F.count_distinct("vec_id").alias("n")).collect()}  # one for each pack of lists
    blocks = {first: math.ceil(n / QUERIES) for first, (_, n) in asked.items()}
    packs = F.broadcast(spark.createDataFrame([(*key, first, n, blocks.get(first, 0)) for key, (first, n) in splits.items()], "dim int, list int, first long, splits int, blocks int"))
    most = max(blocks.values(), default=1)
    tasks = max(1, min(MOST_TASKS, math.ceil(sum(sizes[key] * asked.get(first, (1, 0))[1] for key, (first, _) in splits.items()) / PAIRS)))
    group = (F.col("split") * most + F.col("block")).alias("grp")
    block = F.pmod(F.xxhash64("vec_id"), F.col("blocks"))
    asking = probes.select("*", F.explode("lists").alias("list")).join(packs, ["dim", "list"]).select("vec_id", "dim", "vec", "lists", "first", "splits", block.alias("block")).distinct()
    asking = asking.withColumn("split", F.explode(F.expr("sequence(first, first + splits - 1)"))).select(group, "dim", F.lit(0).alias("side"), F.lit(-1).alias("list"), "vec_id", "vec", "lists", F.lit(None).cast("binary").alias("codes"), F.lit(0.0).alias("error"))
    held_by = index.join(packs, ["dim", "list"]).where("blocks > 0").withColumn("split", F.col("first") + F.pmod(F.xxhash64("vec_id", "vec"), F.col("splits")))
    held_by = held_by.withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).select(group, "dim", F.lit(1).alias("side"), "list", "vec_id", "vec", F.lit(None).cast("array<int>").alias("lists"), "codes", "error")
    dealt = asking.unionByName(held_by).repartition(tasks, "grp").sortWithinPartitions("grp", "dim", "side", "list", "vec_id")
    shared = spark.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple]] = [[], []]
        at: tuple[int, int] | None = None

        def finish() -> Iterator[pa.RecordBatch]:
            if held[0] and held[1]:
                own, data = (np.concatenate([h[i] for h in held[0]]) for i in (0, 1))
                probed = [p for h in held[0] for p in h[2]]
                ids, there, lists, codes, error = (np.concatenate([h[i] for h in held[1]]) for i in range(5))
                keep = min(k + len(ids) // RERANKED_OF, len(ids))
                for a in range(0, len(own), 256):
                    q, names = data[a : a + 256], own[a : a + 256]
                    score = shared.value[at[1]].approximate(q, probed[a : a + 256], lists, codes)
                    score[ids[None, :] == names[:, None]] = -np.inf
                    best = Best(len(q), k, np.float64)
                    chosen = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
                    # of equal scores at the border the smaller ids stay
                    border = np.take_along_axis(score, chosen, axis=1).min(axis=1)
                    for i in np.flatnonzero((score == border[:, None]).sum(axis=1) > 1):
                        chosen[i] = np.lexsort((ids, -score[i]))[:keep]
                    for i in range(0, len(q), 16):
                        mine = chosen[i : i + 16]
                        exact = (there[mine] * q[i : i + 16, None, :]).sum(axis=2)
                        some = np.isfinite(np.take_along_axis(score[i : i + 16], mine, axis=1))
                        rows, columns = np.nonzero(some)
                        best.add(rows + i, ids[mine[rows, columns]], exact[rows, columns])
                    np.put_along_axis(score, chosen, -np.inf, axis=1)
                    reach = np.linalg.norm(q, axis=1)[:, None] * (ERRORS * error)[None, :]
                    rows, columns = np.nonzero((score > -np.inf) & (score + reach >= best.least()[:, None]))
                    for i in range(0, len(rows), RESCORED):
                        r, c = rows[i : i + RESCORED], columns[i : i + RESCORED]
                        best.add(r, ids[c], (there[c] * q[r]).sum(axis=1))
                    yield best.batch(names, pa.float64())
            held[0].clear()
            held[1].clear()

        for (grp, dim, side), part in runs(batches):
            if at != (grp, dim):
                yield from finish()
                at = (grp, dim)
            ids, data = np.array(part.column("vec_id")), matrix(part.column("vec"))
            if side == 0:
                held[0].append((ids, data, [np.array(x) for x in part.column("lists").to_pylist()]))
            else:
                held[1].append((ids, data, np.array(part.column("list")), matrix(part.column("codes"), np.uint8), np.array(part.column("error"))))
        yield from finish()

    return dealt.mapInArrow(run, "query_id long, vec_id long, score double")


def op9(embeddings: DataFrame) -> DataFrame:
    vectors = cut(checked(embeddings, zero=False))
    return best_of_all(search(vectors, queries_of(vectors)))
