import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemill.llm import packing

from .fixtures import docs, edge_rows

PATH = public_tokenizers.path(packing.VOCABULARY)
LIBRARY = Tokenizer.from_file(PATH)
with open(PATH, encoding="utf-8") as f:
    OURS = packing.Words(f.read())


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [2]


def ours(texts):
    return [np.frombuffer(b, OURS.kind).tolist() for b in OURS.encode([t.encode() for t in texts])]


PIECES = st.sampled_from(["a", "The", "  ", "\n", "'s", "’ll", "12", "é", "é", "́", "!!", "<|endoftext|>", "<|endof", "ΑΣ", "İ", "각", "ᄀ", "ᅡ", "\x1c", "\x85", " ", " ", "東京", "🙂"])


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(st.characters(exclude_categories=["Cs"])), st.lists(PIECES).map("".join)))
def test_ids(text):
    assert ours([text]) == [ids_of(text)]


def test_every_code_point():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["a ".join(points[i : i + 512]) + " a".join(points[i : i + 512]) + " ".join(points[i : i + 512]) for i in range(0, len(points), 512)]
    assert ours(texts) == [e.ids + [2] for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def check(rows, got, length):
    """Every id in exactly one piece, and sequences without gaps, all full but the last."""
    want, texts, have = Counter(), defaultdict(set), Counter()
    for r in rows:
        want[r[0], tuple(ids_of(r[1]))] += 1
        texts[r[0]].add(tuple(ids_of(r[1])))
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        (ids,) = [t for t in texts[r.doc_id] if len(t) == r.doc_tokens]
        piece = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
        assert len(piece) == 4 * r.length > 0 and r.ids_crc32 == zlib.crc32(piece)
        for i in range(r.start, r.start + r.length):
            have[r.doc_id, ids, i] += 1
    assert have == Counter({(d, ids, i): n for (d, ids), n in want.items() for i in range(len(ids))})
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for sequence, parts in by_sequence.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == length if sequence < len(by_sequence) - 1 else 0 < at <= length


def rows(n=150):
    words = "the water under a bridge Of Stone runs 12 times".split()
    return [r for r in edge_rows() if r[0] != 7] + [(100 + i, " ".join(words[(i * j) % 9] for j in range(i * i % 211)), "en", ["hot", "hot", "hot", "b", "c", None][i % 6]) for i in range(n)] + [(900, "long way " * 9000, "en", "b")]


def test_query(spark):
    got = packing.op13(docs(spark, rows(), extra=True)).collect()
    check(rows(), got, packing.LENGTH)
    again = packing.op13(docs(spark, rows()).repartition(5)).collect()
    tokens = {r[0] for r in rows()}
    assert {r.doc_id for r in again} == tokens


@pytest.mark.parametrize("packet", [16, 5000])
def test_small_sequences(spark, packet):
    some = [r for r in rows() if r[0] != 900]
    frame = packing.pack(docs(spark, some), length=64, packet=packet)
    got = frame.selectExpr("doc_id", "start", "length", "crc32(ids) AS ids_crc32", "doc_tokens", "sequence_id", "offset").collect()
    check(some, got, 64)


def mixes(spark, some, weights):
    """The tokens of each source in each sequence."""
    source = {r[0]: r[3] for r in some}
    out = defaultdict(Counter)
    for r in packing.pack(docs(spark, some), length=1000, packet=20, weights=weights).collect():
        out[r.sequence_id][source[r.doc_id]] += r.length
    return [out[i] for i in range(len(out))]


def test_proportions(spark):
    some = [(i, "word " * (i * 37 % 400), "en", "abbcccx"[i % 7].replace("x", "c")) for i in range(400)]
    totals = Counter()
    for r in some:
        totals[r[3]] += len(ids_of(r[1]))
    whole = sum(totals.values())
    for mix in mixes(spark, some, None)[:-1]:
        for source, n in totals.items():
            assert abs(mix[source] - 1000 * n / whole) <= 3 * 20
    weighted = mixes(spark, some, (1, 1, 1))
    for mix in weighted[: totals["a"] * 3 // 1000 - 1]:
        for source in totals:
            assert abs(mix[source] - 1000 / 3) <= 3 * 20
    assert weighted[-2]["a"] == 0  # the smallest source has ended


def test_against_rounds_one_by_one(spark):
    """The line of packets is that of a deficit round-robin that is gone through."""
    some = [(i, "word " * (i * 53 % 200), "en", "aab"[i % 3]) for i in range(60)]
    packet, length, queues, sent = 30, 100, {}, []
    for source in "ab":
        queues[source] = [(r[0], s, min(packet, len(ids_of(r[1])) - s)) for r in some if r[3] == source for s in range(0, len(ids_of(r[1])), packet)]
    deficit = dict.fromkeys(queues, 0.0)
    while any(queues.values()):
        for source in queues:
            deficit[source] += length / 2
            while queues[source] and queues[source][0][2] <= deficit[source]:
                sent.append(queues[source].pop(0))
                deficit[source] -= sent[-1][2]
    line = [(d, s + i) for d, s, n in sent for i in range(n)]
    got = packing.pack(docs(spark, some), length=length, packet=packet, weights=(1,)).collect()
    assert [(r.doc_id, r.start + i) for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)) for i in range(r.length)] == line


def test_empty(spark):
    assert packing.op13(docs(spark, [])).collect() == []
    (row,) = packing.op13(docs(spark, [(None, None, None, None)])).collect()
    assert tuple(row) == (None, 0, 1, zlib.crc32(b"\x02\0\0\0"), 1, 0, 0)
