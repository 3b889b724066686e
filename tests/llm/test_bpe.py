import hashlib
import time
from unittest import mock

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemill.llm import bpe

from .fixtures import docs, edge_rows

PATH = public_tokenizers.path(bpe.VOCABULARY)
LIBRARY = Tokenizer.from_file(PATH)
with open(PATH, encoding="utf-8") as f:
    OURS = bpe.Encoder(f.read())
PIECES = st.sampled_from(["a", "the", "  ", "\n", "'s", "'ll", "1", "é", "!!", "<|endoftext|>", "<|endof", "aaa", "\U0003fa85", "ࢗ", "ʼ", "\x1c", "᠎"])


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(st.characters(exclude_categories=["Cs"])), st.lists(PIECES).map("".join)))
def test_ids_and_round_trip(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    joined, ids = OURS.encode(text)
    assert ids.tolist() == want
    assert joined == ",".join(map(str, want))
    assert OURS.decode(ids) == LIBRARY.decode(want, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.text("abcdefinorst ", min_size=30, max_size=400).map(lambda t: t.replace(" ", "")))
def test_long_words(word):
    assert OURS.encode(word)[1].tolist() == LIBRARY.encode(word, add_special_tokens=False).ids


def test_every_code_point():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["'s".join(points[i : i + 256]) + " " + " ".join(points[i : i + 256]) for i in range(0, len(points), 256)]
    for text, want in zip(texts, LIBRARY.encode_batch(texts, add_special_tokens=False), strict=True):
        assert OURS.encode(text)[1].tolist() == want.ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\x1c", "\xa0", "a", "B", "'s", "'", "1", "!", "é", "\U0001d7ce", "\U0001f600", "\U00020000"])).map("".join), st.sampled_from([1, 2, 5]))
def test_spans_of_texts_beyond_the_basic_plane(text, span):
    with mock.patch.object(bpe, "SPAN", span):
        assert OURS.split_words("\U0001f600" + text) == OURS.words.findall("\U0001f600" + text)
        assert OURS.split_words(text + "\U0001f600") == OURS.words.findall(text + "\U0001f600")


def test_splitting_by_the_widest_character():
    borders = ["a", "1", "!", " ", "\n", "\x7f", "\x80", "\xa0", "\u2003", "é", "\u0663", "\ufffd", "\uffff", "\U00010000", "\U0001d7ce", "\U0001f600"]
    wide = bpe.word_pattern()
    for below in ("\x80", "\U00010000", "\U0010ffff"):
        few = [c for c in borders if c < below]
        text = "".join(a + b + c for a in few for b in few for c in few)
        assert OURS.split_words(text) == wide.findall(text)
        assert OURS.encode(text)[1].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_remembered_words_cost_less_than_the_widest_classes():
    text = "The cat, of 12 mats; " * 5000
    wide = bpe.word_pattern()

    def seconds(function):
        began = time.process_time()
        function(text)
        return time.process_time() - began

    assert min(seconds(OURS.encode) for _ in range(7)) < min(seconds(wide.findall) for _ in range(7))


def test_words_forgotten_and_met_again(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "SOME", 4)
    text = "one two three four five six, one two " * 3 + "x" * 100
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    for _ in range(2):
        joined, ids = OURS.encode(text)
        assert (joined, ids.tolist()) == (",".join(map(str, want)), want)
        OURS.rest()


def test_query_on_edge_rows(spark):
    rows = edge_rows()
    got = sorted(map(tuple, bpe.op7(docs(spark, rows, extra=True)).collect()), key=str)

    def want(doc_id, text):
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        back = LIBRARY.decode(ids, skip_special_tokens=False)
        return doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()

    assert got == sorted((want(r[0], r[1]) for r in rows), key=str)
    assert bpe.op7(docs(spark, [])).collect() == []
    back = bpe.detokenize(bpe.tokenize(docs(spark, rows)))
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=str) == sorted(((r[0], r[1] or "") for r in rows), key=str)
