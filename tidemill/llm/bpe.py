"""Byte-level BPE: an exact encoder by backtracking over longest matches, and decoding by an offset table.

Encoding. An Aho-Corasick automaton gives the longest token that starts at each byte of a word. Tokens are laid
down from the left, the longest first; a token fits its predecessor if merging the bytes of both by rank would
leave the place between them alone, which a table of pairs remembers. Where none fits, the last token is exchanged
for its next shorter prefix. A prefix of a word has one encoding only, so a place that failed once is never tried
again, and the work stays linear.
Decoding. All tokens' bytes lie in one array; a table of offsets turns ids into slices of it.

Defined cases: a null or empty text has no tokens (the digests are of the empty string). A null doc_id and repeated
rows each get their row. Texts are taken whole. An empty table gives an empty result. Further columns are dropped.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, slices, texts

VOCABULARY = "byte_bpe_50k.json"
#: Words that a worker remembers in each of two generations, and the characters of the longest of them.
REMEMBERED, LONGEST = 200_000, 64
#: Pairs of tokens that a worker remembers.
PAIRS = 250_000
#: The first character beyond the basic plane. Texts with such ones are split in spans of about SPAN characters, which
#: end before a space that something else than white space follows: whatever stands around it, a word begins there.
BEYOND, SPAN, EDGE = "\U00010000", 256, re.compile(r" (?=\S)")
#: Ids that are Python numbers at a time.
SOME = 1 << 16
LAST = 1 << 62

# Letters and numbers of Unicode 16, which the tokenizers library knows and Python 3.13 does not.
UNICODE_16_LETTERS = """1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E
11390-113B5 113B7 113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0"""
UNICODE_16_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"


def character_class(kind: str, later: str, below: int) -> str:
    """The ranges, as in a character class, of a general category and of the listed code points, up to a code point."""
    inside = bytearray(unicodedata.category(chr(c))[0] == kind for c in range(below))
    for part in later.split():
        first, _, last = part.partition("-")
        for c in range(int(first, 16), min(int(last or first, 16) + 1, below)):
            inside[c] = 1
    edges = np.flatnonzero(np.diff(np.concatenate(([0], np.frombuffer(inside, np.uint8), [0])).astype(np.int8)))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.reshape(-1, 2).tolist())


def word_pattern(below: int = 0x110000) -> re.Pattern:
    """The byte-level tokenizers' splitting pattern, with its classes written out so that all match one Unicode version.

    For texts whose characters are all below a code point: where a character is in no range of a class, all of those
    beyond the basic plane are gone through, which takes longer than anything else.
    """
    letters, numbers = character_class("L", UNICODE_16_LETTERS, below), character_class("N", UNICODE_16_NUMBERS, below)
    space = "".join(f"\\u{c:04x}" for c in range(min(below, 0x10000)) if chr(c).isspace() and not 0x1C <= c <= 0x1F)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")


def printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file, by the format's rule."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Tables of one vocabulary; built once in each worker."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, byte_of = spec["model"], printable_bytes()
        if model["type"] != "BPE" or model.get("ignore_merges") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("only byte-level BPE with plain added tokens is supported")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        data = [b""] * size
        for token, i in model["vocab"].items():
            data[i] = token.encode() if token in self.special else bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            data[i] = token.encode()
        self.offsets = np.concatenate(([0], np.cumsum([len(d) for d in data]))).astype(np.int64)
        self.flat = np.frombuffer(b"".join(data), dtype=np.uint8)
        self.length = [len(d) for d in data]
        self.decimal = [str(i) for i in range(size)]
        id_of = {d.decode("latin-1"): i for i, d in enumerate(data) if i not in set(self.special.values())}
        vocab = model["vocab"]
        self.rank: dict[tuple[int, int], int] = {}
        #: For a merged token: its rank and its halves.
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.rank[a, b] = rank
            self.made.setdefault(c, (rank, a, b))
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._fits: dict[int, bool] = {}
        usable = {t: i for t, i in id_of.items() if t and (i not in self.made and len(t) == 1 or i in self.made and self.stays_apart(*self.made[i][1:], self.made[i][0]))}
        self.whole = usable
        self.automaton = ahocorasick.Automaton()
        for t, i in usable.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.shorter = [-1] * size
        for t, i in usable.items():
            self.shorter[i] = next((usable[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in usable), -1)
        self.words, self.plane_words, self.ascii_words = word_pattern(), word_pattern(0x10000), word_pattern(0x80)
        self.split = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _edge(self, token: int, half: int, known: dict[int, list[tuple[int, int]]]) -> list[tuple[int, int]]:
        """The tokens at a token's right (half 2) or left (half 1) end over time, with the rank that ends each."""
        if token not in known:
            out, ends, t = [], LAST, token
            while True:
                out.append((t, ends))
                if t not in self.made:
                    break
                ends = self.made[t][0]
                t = self.made[t][half]
            known[token] = out[::-1]
        return known[token]

    def stays_apart(self, a: int, b: int, before: int = LAST) -> bool:
        """Whether no merge of a rank below `before` crosses from a's bytes to b's.

        Of equal ranks the left one merges first, so the tie goes to a's own merge and against b's.
        """
        left, right = self._edge(a, 2, self._right), self._edge(b, 1, self._left)
        i = j = 0
        while True:
            x, x_ends = left[i]
            y, y_ends = right[j]
            rank = self.rank.get((x, y))
            if rank is not None and rank < before and rank < x_ends and rank <= y_ends:
                return False
            if x_ends == LAST and y_ends == LAST:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def fits(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > PAIRS:
                self._fits.clear()
            known = self._fits[key] = self.stays_apart(a, b)
        return known

    def word_ids(self, word: str) -> list[int]:
        """Ids of a word given as one Latin-1 character for each byte."""
        if word in self.whole:
            return [self.whole[word]]
        end, length, shorter, fits = len(word), self.length, self.shorter, self.fits
        longest = [-1] * (end + 1)
        for last, token in self.automaton.iter(word):
            longest[last + 1 - length[token]] = token
        path: list[int] = []
        failed: set[int] = set()
        at, token = 0, longest[0]
        while at < end:
            while token >= 0 and (at + length[token] in failed or path and not fits(path[-1], token)):
                token = shorter[token]
            if token >= 0:
                path.append(token)
                at += length[token]
                token = longest[at]
            else:
                failed.add(at)
                token = path.pop()
                at -= length[token]
                token = shorter[token]
        return path

    def split_words(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if text.isascii():
            return self.ascii_words.findall(text)
        if max(text) < BEYOND:
            return self.plane_words.findall(text)
        words, at = [], 0
        while at < len(text):
            edge = EDGE.search(text, at + SPAN)
            to = edge.start() if edge else len(text)
            span = text[at:to]
            words += (self.plane_words if max(span) < BEYOND else self.words).findall(span)
            at = to
        return words

    def _word(self, word: str) -> bytes:
        """The ids of a word that wasn't among the younger ones."""
        ids = self.young.get(word) or self.old.get(word) or array("i", self.word_ids(word.encode().decode("latin-1"))).tobytes()
        if len(word) <= LONGEST:
            if len(self.young) >= REMEMBERED:
                self.old, self.young = self.young, {}
            self.young[word] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        """The ids of a text without special tokens."""
        words = self.split_words(text)
        return b"".join([ids or self._word(w) for w, ids in zip(words, map(self.young.get, words), strict=True)])

    def encode(self, text: str) -> tuple[str, np.ndarray]:
        """The ids of a whole text, as decimal numbers joined by commas and as an array."""
        parts = self.split.split(text) if self.split else [text]
        data = [array("i", [self.special[p]]).tobytes() if p in self.special else self._plain(p) for p in parts]
        ids = np.frombuffer(b"".join(data), dtype=np.int32)
        return ",".join([",".join(map(self.decimal.__getitem__, ids[i : i + SOME].tolist())) for i in range(0, len(ids), SOME)]), ids

    def rest(self) -> None:
        """Keeps the younger words only, as a worker may go on to other work."""
        self.old = {}

    def decode(self, ids: np.ndarray) -> str:
        starts = self.offsets[ids]
        sizes = self.offsets[ids + 1] - starts
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        where = np.repeat(starts - (ends - sizes), sizes) + np.arange(total)
        return self.flat[where].tobytes().decode("utf-8", errors="replace")


_encoders: dict[int, Encoder] = {}


def encoder(text: str) -> Encoder:
    key = hash(text)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(text)
    return _encoders[key]


def tokenize(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids, n_tokens, ids_sha256 and decoded_sha256 of every row; vocabulary is the file's path."""
    with open(vocabulary or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # the file, of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(shared.value)
        for batch in slices(batches):
            rows = []
            for text in texts(batch.column("text")):
                joined, ids = model.encode(text)
                back = model.decode(ids)
                rows.append((ids, len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
            ends = np.concatenate(([0], np.cumsum([r[1] for r in rows]))).astype(np.int32)
            flat = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.string())], ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"])
        model.rest()

    source = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")


def detokenize(tokens: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; null ids give a null text."""
    with open(vocabulary or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        shared = tokens.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(shared.value)
        for batch in batches:
            back = [None if ids is None else model.decode(np.array(ids, dtype=np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(back, pa.string())], ["doc_id", "text"])

    return pick(tokens, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op7(docs: DataFrame) -> DataFrame:
    return tokenize(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
