"""Packing token sequences to a length, mixed in proportion in each of them.

Deficit round-robin: each source is a queue of its documents, and each round gives it as many tokens of credit as its
share of a sequence is. A queue sends what its credit covers, in packets of PACKET tokens at most, and what is left
over is carried to the next round. So the packet that ends at a queue's token E is sent in round ceil(E / credit): the
rounds follow from sums of lengths along each queue, without going through them one by one. In order of round, source
and place the packets make one line of tokens, which is cut every LENGTH tokens; its places are sums of lengths once
more. Both sums run over ranges of the order, so deficits are carried over sequences and partitions alike.

Without weights a source's share is its share of all tokens, so every sequence has the proportions of the whole, but
for PACKET tokens of each source. With weights (by the sources' code points, null last, repeating) the sequences have
those proportions until a source ends; the others share what is left by their weights.

Every sequence is full but the last one. Texts are read once; their ids are written as numbers of two bytes (four for
large vocabularies) and come back for the digests of the pieces.

Defined cases: a null or empty text has only the end id. Null is a source of its own, the last, and differs from the
empty one. Texts are taken whole, however long. A null doc_id and repeated rows each get their pieces. An empty table
gives an empty result. Further columns are dropped.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import printable_bytes
from .common import cut, join_hot, pick, running_sum, slices, utf8, written
from .mixing import ranked_sources

VOCABULARY = "word_bpe_49k.json"
LENGTH, PACKET, END = 4096, 256, 2
#: Words whose ids a worker remembers in each of two generations, and the bytes of the longest of them.
REMEMBERED, LONGEST = 500_000, 64
#: Words that are parted here: printable ASCII and the Latin letters of two bytes that lower-case to one letter.
LATIN = re.compile("[!-~À-ÖØ-öø-įıĲ-ſ]+")
PARTS = re.compile("[a-zß-öø-ſ]+|[0-9]|[^a-zß-öø-ſ0-9]+")


class Words:
    """A tokenizer that is asked once for each word between ASCII spaces, as its tokens and its normalisation never
    reach over a space.

    Words of Latin letters, digits and ASCII signs are parted as the tokenizer parts them, into letters, digits and
    runs of signs, and its model is asked for the parts; other words, and those with apostrophes or special tokens, go
    through the whole tokenizer.
    """

    def __init__(self, text: str):
        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.end = self._bytes([END])
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(" " in t or "<|" not in t for t in special):
            raise ValueError("only special tokens that hold <| and no space are supported")
        self.sign_of = {b: c for c, b in printable_bytes().items()}
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _bytes(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _new(self, part: bytes) -> bytes:
        """The ids of a part of a word, lower-cased."""
        signs = part.decode("latin-1")
        return self._bytes([t.id for t in self.model.tokenize(signs if part.isascii() else signs.translate(self.sign_of))])

    def _part(self, part: bytes, known: dict[bytes, bytes]) -> bytes:
        """The same, if it isn't known yet; new ones are added to known."""
        ids = self.young.get(part) or self.old.get(part) or known.get(part)
        if ids is None:
            ids = known[part] = self._new(part)
        return ids

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of words that aren't among the younger ones, and of their parts."""
        known: dict[bytes, bytes] = {}
        others = []
        for word in words:
            ids = self.old.get(word) or known.get(word)
            if ids is None and word.isalpha():  # ASCII letters only
                small = word.lower()
                ids = self._new(word) if small == word else self._part(small, known)
            elif ids is None:
                text = word.decode()
                if "'" in text or "<|" in text or not LATIN.fullmatch(text):
                    others.append(word)
                    continue
                ids = b"".join([self._part(p.encode(), known) for p in PARTS.findall(text.lower())])
            known[word] = ids
        for word, got in zip(others, self.tokenizer.encode_batch_fast([w.decode() for w in others], add_special_tokens=False), strict=True):
            known[word] = self._bytes(got.ids)
        if len(self.young) >= REMEMBERED:
            self.old, self.young = self.young, {}
        self.young.update(known)
        for word in [w for w in known if len(w) > LONGEST]:
            del self.young[word]
        return known

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of whole texts, each with the end id."""
        split = [t.split() for t in texts]
        here: dict[bytes, bytes] = {}
        new = []
        for word in set().union(*split):
            ids = self.young.get(word)
            if ids is None:
                new.append(word)
            else:
                here[word] = ids
        here.update(self.learn(new))
        return [b"".join(map(here.__getitem__, words)) + self.end for words in split]


_words: dict[int, Words] = {}


def _model(text: str) -> Words:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
    key = hash(text)
    if key not in _words:
        _words.clear()
        _words[key] = Words(text)
    return _words[key]


def tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, source, n (tokens with the end id) and ids (as bytes) of every row."""
    with open(vocabulary or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # the file, of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for batch in slices(batches):
            ids = model.encode(utf8(batch.column("text")))
            n = pa.array([len(i) // model.kind.itemsize for i in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), n, pa.array(ids, pa.binary())], ["doc_id", "source", "n", "ids"])

    rows = pick(docs, "doc_id", "text", "source").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    return rows.mapInArrow(run, "doc_id long, source string, n long, ids binary")


def _credits(lengths: DataFrame, length: int, weights: tuple[int, ...] | None) -> DataFrame:
    """queue, rows and credit (tokens of a sequence) of each source."""
    sums = lengths.groupBy("queue").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    if weights is None:
        total = lengths.agg(F.sum("n").alias("t")).first().t or 1
        return sums.select("queue", "rows", (F.col("total") * length / F.lit(float(total))).alias("credit"))
    ranked = cut(ranked_sources(sums.withColumnRenamed("queue", "source")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight)
    total = ranked.agg(F.sum("weight").alias("w")).first().w or 1.0
    return ranked.select(F.col("source").alias("queue"), "rows", (F.col("weight") * length / F.lit(total)).alias("credit"))


def _packets(placed: DataFrame, packet: int) -> DataFrame:
    """row, start and n of the pieces of documents that are sent in one round; placed: before is where a document
    begins in its queue.

    A piece is made of packets; cuts lists the packets of a document that are the last ones of their round.
    """
    whole = F.ceil(F.col("n") / packet)
    sent = f"ceil((before + least(n, k * {packet}L)) / credit)"
    after = f"ceil((before + least(n, (k + 1) * {packet}L)) / credit)"
    rows = placed.withColumn("packets", whole).withColumn("cuts", F.expr(f"filter(sequence(1L, packets), k -> k = packets OR {sent} <> {after})"))
    each = rows.select("row", "doc_id", "queue", "n", "before", "credit", "cuts", F.posexplode("cuts").alias("place", "k"))
    each = each.withColumn("start", F.when(F.col("place") == 0, 0).otherwise(F.get("cuts", F.col("place") - 1) * packet))
    return each.select("row", "queue", "before", F.expr(sent).alias("round"), "start", (F.least(F.col("n"), F.col("k") * packet) - F.col("start")).alias("n"))


def plan(lengths: DataFrame, length: int = LENGTH, packet: int = PACKET, weights: tuple[int, ...] | None = None) -> DataFrame:
    """row, start, n, sequence_id and offset of every piece; lengths (from a written table): row, doc_id, source and n."""
    queues = lengths.select("row", "doc_id", F.when(F.col("source").isNull(), "~").otherwise(F.concat(F.lit("="), "source")).alias("queue"), "n")
    placed = running_sum(queues, ["queue"], ["doc_id", "row"], "n", "before")
    credits = cut(_credits(queues, length, weights))
    rows = credits.agg(F.sum("rows").alias("r")).first().r or 0
    pieces = _packets(join_hot(placed, credits, "queue", "rows", rows, "inner"), packet)
    line = running_sum(cut(pieces.withColumn("all", F.lit(0))), ["all"], ["round", "queue", "before", "start"], "n", "at")
    each = line.withColumn("sequence_id", F.explode(F.expr(f"sequence(at div {length}, (at + n - 1) div {length})")))
    first = F.greatest(F.col("at"), F.col("sequence_id") * length)
    last = F.least(F.col("at") + F.col("n"), (F.col("sequence_id") + 1) * length)
    return each.select("row", (F.col("start") + first - F.col("at")).alias("start"), (last - first).alias("n"), "sequence_id", (first % length).alias("offset"))


PIECES = "array<struct<start: long, n: long, sequence_id: long, offset: long>>"


def pack(docs: DataFrame, length: int = LENGTH, packet: int = PACKET, weights: tuple[int, ...] | None = None, vocabulary: str | None = None) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id and offset of every piece of every row's tokens."""
    table = written(tokens(docs, vocabulary).withColumn("row", F.monotonically_increasing_id()))
    pieces = plan(table.select("row", "doc_id", "source", "n"), length, packet, weights)
    listed = pieces.groupBy("row").agg(F.collect_list(F.struct("start", "n", "sequence_id", "offset")).alias("pieces"))
    with open(vocabulary or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        kind = Words(f.read()).kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            rows = []
            for doc_id, n, ids, each in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "n", "ids", "pieces")], strict=True):
                values = np.frombuffer(ids, kind).astype("<u4")
                rows += [(doc_id, p["start"], p["n"], values[p["start"] : p["start"] + p["n"]].tobytes(), n, p["sequence_id"], p["offset"]) for p in each]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if name == "ids" else pa.int64()) for c, name in zip(columns, names, strict=True)], names)

    whole = table.select("row", "doc_id", "n", "ids").join(listed, "row").drop("row")
    return whole.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op13(docs: DataFrame) -> DataFrame:
    rows = pack(docs)
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
