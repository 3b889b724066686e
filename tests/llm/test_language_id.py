import random
import zlib
from collections import Counter

import pytest

from tidemill.llm import language_id as li

from .fixtures import docs, edge_rows

WORDS = {
    "en": "the and of to in is that it for was on are with as his they at be this from",
    "fr": "le la les de des un une et est que qui dans pour pas sur au avec ce il sont",
    "ru": "и в не на что он как это по но они мы все она так его было от для из",
}


def brute(text):
    """n-gram counts of a text by plain loops."""
    words, word = [], ""
    for c in text + " ":
        if c.isalpha():
            word += c.lower() if len(c.lower()) == 1 else c
        elif word:
            words.append(word)
            word = ""
    counts = Counter()
    for w in words:
        padded = "_" + w + "_"
        counts.update(w)
        counts.update(padded[i : i + 2] for i in range(len(padded) - 1))
        counts.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return counts


def code(gram):
    out = 0
    for c in gram:
        out = out << 21 | (li.END if c == "_" else ord(c))
    return out


@pytest.mark.parametrize("batch", [["abc d", "", "é!Éa", "12", "x"], [""], ["a"], ["..", "東京 tokyo"]])
def test_ngrams(batch):
    grams, rows = li.ngrams(batch)
    for i, text in enumerate(batch):
        assert Counter(grams[rows == i].tolist()) == Counter({code(g): n for g, n in brute(text).items()})


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def brute_predictions(rows):
    profiles = {}
    for doc_id, text, lang, _ in rows:
        if lang is not None and text is not None and doc_id is not None and not held_out(doc_id):
            profiles.setdefault(lang, Counter()).update({code(g): n for g, n in brute(text).items()})
    rank = {lang: {g: r for r, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[: li.PROFILE])} for lang, c in profiles.items() if c}
    out = []
    for doc_id, text, _, _ in rows:
        own = [g for g, _ in sorted(((code(g), n) for g, n in brute(text or "").items()), key=lambda x: (-x[1], x[0]))[: li.PROFILE]]
        lang, score = "und", 0.0
        if own and rank:
            apart = {k: sum(abs(r[g] - i) if g in r else li.PROFILE for i, g in enumerate(own)) for k, r in rank.items()}
            lang = min(apart, key=lambda k: (apart[k], k))
            score = 1 - apart[lang] / (li.PROFILE * len(own))
        out.append((doc_id, doc_id is not None and held_out(doc_id), lang, round(score, 9)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rows = edge_rows()
    for k, (lang, words) in enumerate(WORDS.items()):
        words = words.split()
        rows += [(1000 * (k + 1) + i, " ".join(words[(i * j + j) % len(words)] for j in range(1, 30)), lang, "s") for i in range(40)]
    got = sorted(((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in li.op4(docs(spark, rows, extra=True)).collect()), key=str)
    assert got == brute_predictions(rows)
    own = {r[0]: r[2] for r in got}
    assert all(own[1000 * (k + 1) + i] == lang for k, lang in enumerate(WORDS) for i in range(40))
    kept = li.accept(docs(spark, rows, extra=True))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {1, 2, 3, 9}.isdisjoint(r.doc_id for r in kept.collect())
    assert kept.count() >= 120


def test_nothing_to_learn(spark):
    assert li.op4(docs(spark, [])).collect() == []
    got = li.op4(docs(spark, [(4, "text", None, "a"), (None, "text", "en", "a")])).collect()
    assert {(r.doc_id, r.lang_pred, r.score) for r in got} == {(4, "und", 0.0), (None, "und", 0.0)}


def test_shards_of_languages(spark, monkeypatch):
    """More languages than a shard holds, and more than a thousand: the same predictions as with one shard."""
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(1100):
        own = rng.sample(letters, 5)
        rows += [(2 * k + j, " ".join("".join(rng.choice(own) for _ in range(5)) for _ in range(12)), f"l{k:04d}", "s") for j in range(2)]
    frame = docs(spark, rows)
    profiles = li.learn(frame)
    assert len(profiles) > 1000
    asked = frame.where("doc_id < 60")
    sharded = sorted(map(tuple, li.predict(asked, profiles, "doc_id").collect()))
    monkeypatch.setattr(li, "AT_ONCE", 5000)
    assert sharded == sorted(map(tuple, li.predict(asked, profiles, "doc_id").collect()))
