"""Language ID by rank-order profiles.

A language's profile is its most frequent n-grams of letters (one to three, with a mark at word ends) in rank order.
A document's own most frequent n-grams are compared with each profile by the out-of-place distance: the sum over
the document's n-grams of how far their rank is from the profile's, or the profile's length where it lacks one. The
nearest profile wins; the score is 1 less the distance as a share of the largest possible.

Profiles are counted over all training rows; nothing is sampled. All languages are learned. They travel with the tasks
in shards of AT_ONCE languages; with several shards each document keeps its nearest profile over all of them.

Defined cases: a null text, or one without letters, is `und` with score 0, as is every text if nothing was learned.
Equal distances go to the first language by code point; equal counts of n-grams to the smaller code. Rows with a
null doc_id are predicted but neither learned from nor held out. Texts are taken whole, in any length; repeated rows
each get their row. An empty table gives an empty result. Further columns are dropped.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, documents_of, pick, slices, texts

PROFILE = 300
#: Languages of a shard, whose profiles make one table of ranks.
AT_ONCE = 250
UNKNOWN = "und"
#: The pipeline's stage rejects what is scored below this: text that resembles no learned language.
MIN_SCORE = 0.05
#: Bytes of text and counted n-grams that a task holds at a time.
SLICE, HELD = 500_000, 1_000_000
#: Stands for a word's end; no letter has this code.
END = 1


@cache
def letter_codes() -> np.ndarray:
    """For each code point: its lower-case letter's code point, or 0 if it isn't a letter."""
    out = np.zeros(0x110000, dtype=np.int64)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def ngrams(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams of one to three letters, and the row of each. Between two words stands one mark."""
    code = letter_codes()[np.frombuffer("\n".join(["", *batch, ""]).encode("utf-32-le"), dtype=np.uint32)]
    sizes = np.array([len(t) + 1 for t in batch])
    sizes[0] += 1
    row = np.repeat(np.arange(len(batch), dtype=np.int32), sizes)
    stay = (code != 0) | np.concatenate(([True], code[:-1] != 0))
    code, row = np.where(code == 0, END, code)[stay], row[stay]
    letter = code != END
    pairs = (code[:-1] << 21 | code[1:], np.where(letter[:-1], row[:-1], row[1:]))
    middle = letter[1:-1]
    triples = ((code[:-2] << 42 | code[1:-1] << 21 | code[2:])[middle], row[1:-1][middle])
    if len(code) == 1:
        return code[:0], row[:0]
    return np.concatenate((code[letter], pairs[0], triples[0])), np.concatenate((row[letter], pairs[1], triples[1]))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return grams, np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(grams)).astype(np.int64)


def ranked(codes: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent codes, the most frequent first and equal counts by code."""
    if not len(codes):
        return codes
    codes = np.sort(codes)
    at = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    count = np.diff(np.concatenate((at, [len(codes)])))
    return codes[at][np.argsort(-count, kind="stable")[:most]]


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame) -> dict[str, list[int]]:
    """The profile of each language: its n-grams, the most frequent first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for name, parts in kept.items():
                grams, n = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])
            kept.clear()

        for batch in slices(batches, most=SLICE):
            langs = batch.column("lang").dictionary_encode()
            code, row = ngrams(texts(batch.column("text")))
            lang = np.asarray(langs.indices)[row]
            for k, name in enumerate(langs.dictionary.to_pylist()):
                kept.setdefault(name, []).append(np.unique(code[lang == k], return_counts=True))
                held += len(kept[name][-1][0])
            if held > HELD:
                kept = {name: [merged(parts)] for name, parts in kept.items()}
                held = sum(len(parts[0][0]) for parts in kept.values())
                if held > HELD // 2:
                    yield from flush()
                    held = 0
        yield from flush()

    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    counts = labelled.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = cut(counts.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= PROFILE))
    rows = top.select("lang", "gram", "rank").collect()  # PROFILE for each language
    profiles: dict[str, list[tuple[int, int]]] = {}
    for r in rows:
        profiles.setdefault(r.lang, []).append((r.rank, r.gram))
    return {lang: [g for _, g in sorted(grams)] for lang, grams in sorted(profiles.items())}


class Judge:
    """All profiles as one table of ranks: a row for each n-gram, a column for each language."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.langs = sorted(profiles)
        self.known = np.unique(np.array([g for grams in profiles.values() for g in grams], dtype=np.int64))
        self.ranks = np.full((len(self.known) + 1, len(self.langs)), -1, dtype=np.int32)
        for k, lang in enumerate(self.langs):
            grams = np.array(profiles[lang], dtype=np.int64)
            self.ranks[np.searchsorted(self.known, grams), k] = np.arange(len(grams))

    def __call__(self, own: np.ndarray) -> tuple[int, str]:
        """The least distance of a document's ranked n-grams, and its language."""
        at = np.searchsorted(self.known, own)
        at[(at == len(self.known)) | (self.known[np.minimum(at, len(self.known) - 1)] != own)] = len(self.known)
        ranks = self.ranks[at]
        apart = np.where(ranks < 0, PROFILE, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(np.argmin(apart))
        return int(apart[best]), self.langs[best]


def predict(docs: DataFrame, profiles: dict[str, list[int]], *keep: str) -> DataFrame:
    """The kept columns with lang_pred and score, from the text alone."""
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "lang_pred string", "score double"])
    columns = list(dict.fromkeys([*keep, "text"]))
    names = sorted(profiles)
    shards = [docs.sparkSession.sparkContext.broadcast({n: profiles[n] for n in names[a : a + AT_ONCE]}) for a in range(0, len(names), AT_ONCE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = Judge(shards[0].value) if len(shards) == 1 else None
        for batch in slices(batches, most=SLICE):
            code, row = ngrams(texts(batch.column("text")))
            order = np.argsort(row, kind="stable")
            code = code[order]
            ends = np.searchsorted(row[order], np.arange(batch.num_rows + 1))
            own = [ranked(code[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            best: list[tuple[int, str] | None] = [None] * len(own)
            for shard in shards:
                judge = only or Judge(shard.value)
                best = [b if not len(o) else judge(o) if b is None else min(b, judge(o)) for o, b in zip(own, best, strict=True)]
            found = [(UNKNOWN, 0.0) if b is None else (b[1], 1.0 - b[0] / (PROFILE * len(o))) for o, b in zip(own, best, strict=True)]
            arrays = [batch.column(c) for c in keep] + [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "lang_pred", "score"])

    return docs.select(*columns).mapInArrow(run, schema)


def accept(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents in a language learned from docs; what is `und` or scored below min_score goes."""
    docs = documents_of(docs)
    judged = predict(docs, learn(docs), *docs.columns)
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select(*docs.columns)


def op4(docs: DataFrame) -> DataFrame:
    docs = pick(docs, "doc_id", "text", "lang").select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    found = predict(docs, learn(docs), "doc_id")
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
