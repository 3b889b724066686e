"""License scans by a positional index of rare words.

Templates are short license texts with phrases that must occur. The index posts each template's rarest words, by
document frequency over the whole corpus, with their positions, from inside and outside its phrases. A file's
occurrences of posted words each say where a template would start; starts around which several words agree, within SLACK
words, are candidates. A candidate counts if all its mandatory phrases stand there word by word, if words of LEAST of its
weight stand there, each within SLACK words of its place, and if no negation leads up to it. Base phrases are
templates of one phrase each: every place of theirs holds their rarest word, so looking that word up finds all places.
Identifiers, in a file's SPDX line or by themselves, are templates too; from there an expression is read on, over `or`,
`and` and `with`.

The score is the largest share, weighted by rarity, of an accepted template's words that stand there.

Defined cases: equal frequencies go by place in the template. A null text is empty: 0 words, no places, empty labels, null first and last word, score 0. Texts are
taken whole. Null and repeated doc_ids each keep their rows. An empty table gives an empty result. Further columns
are dropped.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, slices, utf8

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Words posted for a template, the rarest first.
POSTED = 4
#: Share of a template's weight that must stand at its places.
LEAST = 0.5
#: Words by which a word or phrase may be off its place in the template.
SLACK = 3
#: Words that take a template's meaning back where they stand before its first phrase, and those that may come between.
NEGATIONS = frozenset({b"not", b"never", b"nor"})
BETWEEN = frozenset(b"a an any as available be covered distributed is licensed made of offered provided published released subject terms the to under".split())

# The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Templates as (label, text, mandatory phrases separated by |).
TEMPLATES = (
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("artistic-2.0", "the artistic license 2 0", "artistic license 2 0"),
    ("bsl-1.0", "boost software license version 1 0", "boost software license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc-nd", "cc by nc nd 4 0", "cc by nc nd"),
    ("cc-by-nc-sa", "cc by nc sa 4 0", "cc by nc sa"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-text", "creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0"),
    ("epl", "eclipse public license v 2 0", "eclipse public license"),
    ("gpl-2", "gnu general public license version 2", "general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3", "general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("mit", "released under the mit license", "the mit license"),
    ("mit", "mit license", "mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "permission is hereby granted free of charge|to deal in the software without restriction",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
        "without any express or implied warranty|in no event will the authors be held liable",
    ),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("mpl-2.0", "mozilla public license version 2 0", "mozilla public license version 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
)


# Identifiers of licenses, as words, and their labels; those of one word count in expressions only.
SPDX = {
    "agpl 3 0": "agpl", "apache 2 0": "apache-2.0", "artistic 2 0": "artistic-2.0", "bsl 1 0": "bsl-1.0", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "cc by 4 0": "cc-by-4.0", "cc by sa 4 0": "cc-by-sa", "cc0 1 0": "cc0", "epl 2 0": "epl",
    "gpl 2 0": "gpl-2", "gpl 3 0": "gpl-3", "isc": "isc", "lgpl 2 1": "lgpl", "lgpl 3 0": "lgpl", "mit": "mit", "mpl 2 0": "mpl-2.0", "unlicense": "unlicense", "zlib": "zlib",
}


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    #: Phrases with their place in the template.
    phrases: tuple[tuple[int, tuple[bytes, ...]], ...]
    base: bool
    #: The word from which an expression is read, for identifiers.
    reads: int | None = None


def templates() -> list[Template]:
    out = [Template(label, t, ((0, t),), True) for text, label in BASE for t in [tuple(text.encode().split())]]
    marked = [("", "spdx license identifier", 3), *((label, name, 0) for name, label in SPDX.items() if " " in name)]
    out += [Template(label, t, ((0, t),), False, reads) for label, text, reads in marked for t in [tuple(text.encode().split())]]
    for label, text, phrases in TEMPLATES:
        words = tuple(text.encode().split())
        need = []
        for phrase in phrases.split("|"):
            p = tuple(phrase.encode().split())
            need.append((next(i for i in range(len(words)) if words[i : i + len(p)] == p), p))
        out.append(Template(label, words, tuple(need), False))
    return out


NOTHING: tuple[set[str], float, tuple[int, int]] = (set(), 0.0, (0, 0))


def outermost(found: list[tuple[set[str], float, tuple[int, int]]]) -> tuple[set[str], float]:
    """The labels and the best score of what fits, without what lies inside another's longer phrase."""
    spans = {(a, b) for _, _, (a, b) in found}
    kept = [(got, share) for got, share, (a, b) in found if got and not any(c <= a and b <= d and (c, d) != (a, b) for c, d in spans)]
    return set().union(*[got for got, _ in kept]), max([share for _, share in kept], default=0.0)


def negated(words: list[bytes], at: int) -> bool:
    at -= 1
    while at >= 0 and words[at] in BETWEEN:
        at -= 1
    return at >= 0 and words[at] in NEGATIONS


_NAMES = {tuple(name.encode().split()): label for name, label in SPDX.items()}


def expression(words: list[bytes], at: int) -> set[str]:
    """Labels of the identifiers that an expression names, read from a place on."""
    out: set[str] = set()
    while True:
        size = next((n for n in (3, 2, 1) if tuple(words[at : at + n]) in _NAMES), 0)
        if not size:
            return out
        out.add(_NAMES[tuple(words[at : at + size])])
        at += size
        at += 1 if words[at : at + 1] == [b"only"] else 2 if words[at : at + 2] == [b"or", b"later"] else 0
        if words[at : at + 1] not in ([b"or"], [b"and"], [b"with"]):
            return out
        at += 1


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased."""
    return WORD.findall(text.lower())


def frequencies(docs: DataFrame) -> tuple[int, dict[bytes, int]]:
    """The number of rows, and for each word of a template the number of rows that have it; over all rows."""
    known = {w for t in templates() for w in t.words}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[bytes] = Counter()
        for batch in slices(batches):
            for text in utf8(batch.column("text")):
                n[b""] += 1
                n.update(known.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in n], pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # one for each word of a template
    found = {r.word.encode(): r.n for r in rows}
    return found.pop(b"", 0), found


class Index:
    """Postings of the rarest words: word -> (template, position)."""

    def __init__(self, rows: int, frequency: dict[bytes, int]):
        self.templates = templates()
        self.idf = {w: math.log((rows + 1) / (frequency.get(w, 0) + 1)) + 1e-6 for t in self.templates for w in t.words}
        self.weight = [sum(self.idf[w] for w in t.words) for t in self.templates]
        self.need: list[int] = []
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for k, t in enumerate(self.templates):
            # a base phrase is looked up by its rarest word alone, others by the rarest words of all, and of each phrase
            rarest = sorted(range(len(t.words)), key=lambda i: (-self.idf[t.words[i]], i))
            inside = [min(range(at, at + len(p)), key=lambda i: (-self.idf[t.words[i]], i)) for at, p in t.phrases]
            two = [i for at, p in t.phrases for i in sorted(range(at, at + len(p)), key=lambda i: (-self.idf[t.words[i]], i))[:2]]
            rare = rarest[:1] if t.base else sorted({*rarest[:POSTED], *inside, *two})
            self.need.append(1 if t.base else min(2, len(rare)))
            for i in rare:
                self.postings.setdefault(t.words[i], []).append((k, i))

    def fits(self, k: int, words: list[bytes], start: int) -> tuple[set[str], float, tuple[int, int]]:
        """A template's labels, if it stands at a start, the share of its weight that does, and the place of its first
        phrase."""
        t = self.templates[k]
        if t.reads is not None:
            there = start >= 0 and tuple(words[start : start + len(t.words)]) == t.words and not negated(words, start)
            got = expression(words, start + t.reads) if there else set()
            return (got, 1.0, (start, start + len(t.words))) if got else NOTHING
        places = [next((a for a in range(max(0, start + at - SLACK), start + at + SLACK + 1) if tuple(words[a : a + len(p)]) == p), None) for at, p in t.phrases]
        if None in places or negated(words, places[0]):
            return NOTHING
        there = sum(self.idf[w] for i, w in enumerate(t.words) if w in words[max(0, start + i - SLACK) : max(0, start + i + SLACK + 1)])
        return ({t.label}, there / self.weight[k], (places[0], places[0] + len(t.phrases[0][1]))) if there >= LEAST * self.weight[k] else NOTHING

    def scan(self, text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
        words = words_of(text)
        postings = self.postings
        starts: Counter[tuple[int, int]] = Counter()
        if not postings.keys().isdisjoint(words):
            for at, w in enumerate(words):
                if w in postings:
                    starts.update((k, at - i) for k, i in postings[w])
        places, base, labels, score = [], set(), set(), 0.0
        tried: set[tuple[int, int]] = set()
        found = []
        for k, start in starts:
            t = self.templates[k]
            if t.base:
                if start >= 0 and tuple(words[start : start + len(t.words)]) == t.words:
                    places.append(start)
                    base.add(t.label)
                    score = 1.0
                continue
            if sum(starts.get((k, start + d), 0) for d in range(-2 * SLACK, 2 * SLACK + 1)) < self.need[k]:
                continue
            tried.update((k, start + d) for d in range(-SLACK, SLACK + 1))
        for k, start in tried:
            if sum(starts.get((k, start + d), 0) for d in range(-SLACK, SLACK + 1)) >= self.need[k]:
                found.append(self.fits(k, words, start))
        more, best = outermost(found)
        labels, score = labels | more, max(score, best)
        first, last = (min(places), max(places)) if places else (None, None)
        return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), min(score, 1.0)


def scan(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score."""
    docs = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows, frequency = frequencies(docs)
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(rows, frequency)
        for batch in slices(batches):
            found = list(zip(*[index.scan(t) for t in utf8(batch.column("text"))], strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(found, kinds, strict=True)]], ["doc_id", *names])

    return docs.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op5(docs: DataFrame) -> DataFrame:
    return scan(docs)
