"""Runs of repeated phrases: every stretch of words that repeats with some period at least MIN_EXPONENT times.

All-lag scan: the words of a text become numbers, and the array is compared with itself shifted by each lag up to
n / MIN_EXPONENT; a long enough stretch of equal places is a run with that lag as a period. A run at lag q has over 3 q
equal places in a row, so it covers three places in a row of every q-th one. Those are compared first; all places are
compared only around them, so a lag costs n / q comparisons where nothing repeats. The smallest of the periods that
give one stretch is the run's.

Texts of up to SPLIT_BYTES are scanned where they are read. Of a longer one the numbers are sent out with ranges of
lags, which are scanned by different machines, and the runs found come together again for each text.

Defined cases: a null, empty or blank text has no words and no runs. Texts are taken whole, however long. A null
doc_id and repeated rows each get their row. An empty table gives an empty result. Further columns are dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, slices, utf8, written

MIN_EXPONENT, LEAST = 4, 6
#: Texts of more bytes have their lags dealt out, at least so many lags at a time, in MOST_RANGES ranges at most.
SPLIT_BYTES, RANGE_LAGS, MOST_RANGES = 65_536, 1024, 64
#: Lags that each range looks at first for long runs, whose multiples needn't be compared again.
SMALL_LAGS = 64

Run = tuple[int, int, int]
#: Changes a text's words before they are scanned: takes doc_id and words.
Change = Callable[[int | None, list[bytes]], list[bytes]]
RUNS = "array<struct<start: long, length: long, period: long>>"
RUNS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def numbers(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int32, count=len(words))


def stretches(equal: np.ndarray, least: int) -> list[tuple[int, int]]:
    """First and end of each stretch of True with at least `least` places."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], equal, [False])).view(np.int8)))
    return [(a, b) for a, b in edges.reshape(-1, 2).tolist() if b - a >= least]


def scan(ids: np.ndarray, first: int, last: int, least: int = LEAST, exponent: int = MIN_EXPONENT) -> list[Run]:
    """start, length and period of the stretches that have a period of first to last; several periods may give one."""
    n = len(ids)
    known: list[Run] = []  # long runs, whose period has multiples among the lags to come
    out: list[Run] = []
    lags = [*range(1, min(first, SMALL_LAGS + 1)), *range(first, min(last, n // exponent) + 1)]
    for lag in lags:
        need = max((exponent - 1) * lag, least - lag)
        sampled = ids[: n - lag : lag] == ids[lag::lag]
        samples = need // lag
        if np.count_nonzero(sampled) < samples:
            continue
        for a, b in stretches(sampled, samples):
            at, to = a * lag, b * lag
            if any(lag % p == 0 and s <= at and to < s + size and size >= p + lag for s, size, p in known):
                continue
            low, high = max(0, at - lag + 1), min(n - lag, to)
            for s, e in stretches(ids[low:high] == ids[low + lag : high + lag], need):
                run = (low + s, e - s + lag, lag)
                if run[1] >= 2 * exponent * lag:
                    known.append(run)
                if lag >= first:
                    out.append(run)
    return out


def smallest(found: list[Run]) -> list[Run]:
    """One run for each stretch, with the smallest of its periods, by start and period."""
    best: dict[tuple[int, int], int] = {}
    for start, length, period in found:
        best[start, length] = min(period, best.get((start, length), period))
    return sorted(((s, n, p) for (s, n), p in best.items()), key=lambda r: (r[0], r[2], r[1]))


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words without those that a run repeats, joined by spaces."""
    if runs:
        steps = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            steps[start + period] += 1
            steps[start + length] -= 1
        keep = np.cumsum(steps[:-1]) == 0
        words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
    return b" ".join(words)


def _rows(batch: pa.RecordBatch, change: Change | None) -> Iterator[tuple[int | None, list[bytes]]]:
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
        words = text.split()
        yield doc_id, change(doc_id, words) if change else words


def _output(ids: pa.Array, runs: list[list[Run]], kept: list[bytes]) -> pa.RecordBatch:
    listed = [[{"start": s, "length": n, "period": p} for s, n, p in each] for each in runs]
    return pa.RecordBatch.from_arrays([ids, pa.array(listed, RUNS_ARROW), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])


OUTPUT = f"doc_id long, runs {RUNS}, collapsed string"


def _whole(docs: DataFrame, change: Change | None) -> DataFrame:
    """Texts scanned where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            runs, kept = [], []
            for _, words in _rows(batch, change):
                ids = numbers(words)
                runs.append(smallest(scan(ids, 1, len(ids))))
                kept.append(collapsed(words, runs[-1]))
            yield _output(batch.column("doc_id"), runs, kept)

    return docs.select("doc_id", "text").mapInArrow(run, OUTPUT)


def _dealt(docs: DataFrame, change: Change | None, range_lags: int) -> DataFrame:
    """Texts scanned by ranges of lags."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for row, (_, words) in zip(batch.column("row").to_pylist(), _rows(batch, change), strict=True):
                lags = len(words) // MIN_EXPONENT
                step = max(range_lags, -(-lags // MOST_RANGES))
                ids = numbers(words).tobytes()
                for first in range(1, lags + 1, step):
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([first], pa.int64()), pa.array([first + step - 1], pa.int64()), pa.array([ids], pa.binary())], ["row", "first", "last", "ids"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for row, first, last, ids in zip(*[batch.column(c).to_pylist() for c in ("row", "first", "last", "ids")], strict=True):
                got = scan(np.frombuffer(ids, np.int32), first, last)
                found += got
                rows += [row] * len(got)
            columns = [pa.array(c, pa.int64()) for c in (rows, [f[0] for f in found], [f[1] for f in found], [f[2] for f in found])]
            yield pa.RecordBatch.from_arrays(columns, ["row", "start", "length", "period"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            runs, kept = [], []
            for (_, words), each in zip(_rows(batch, change), batch.column("runs").to_pylist(), strict=True):
                runs.append(smallest([(r["start"], r["length"], r["period"]) for r in each or []]))
                kept.append(collapsed(words, runs[-1]))
            yield _output(batch.column("doc_id"), runs, kept)

    docs = written(docs.withColumn("row", F.monotonically_increasing_id()))
    ranges = docs.mapInArrow(send, "row long, first long, last long, ids binary").repartition("row", "first")
    runs = ranges.mapInArrow(find, "row long, start long, length long, period long").groupBy("row", "start", "length").agg(F.min("period").alias("period"))
    each = runs.groupBy("row").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    return docs.join(each, "row", "left").select("doc_id", "text", "runs").mapInArrow(finish, OUTPUT)


def collapse(docs: DataFrame, change: Change | None = None, split_bytes: int = SPLIT_BYTES, range_lags: int = RANGE_LAGS) -> DataFrame:
    """doc_id, runs (by start, then period) and collapsed, the text without the words that runs repeat, of every row.

    A row holds its text's runs, of which there are fewer than words.
    """
    docs = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    is_long = F.coalesce(F.octet_length("text") > split_bytes, F.lit(False))
    return _whole(docs.where(~is_long), change).unionByName(_dealt(docs.where(is_long), change, range_lags))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Words of which, for one doc_id in ten by its crc32, an end repeats a phrase."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def strongest(runs: Column) -> Column:
    """The run with the greatest length for its period; of equal ones the first. Null without any."""
    return F.aggregate(runs, F.get(runs, 0), lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))


def op12(docs: DataFrame) -> DataFrame:
    best, parts = F.col("best"), ("start", "length", "period")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[p].cast("string") for p in parts]), F.lit("\n")))
    rows = collapse(docs, planted).withColumn("best", strongest(F.col("runs")))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[best[p].alias(p) for p in parts], F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
