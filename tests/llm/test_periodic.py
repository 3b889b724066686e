import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import periodic

from .fixtures import docs, edge_rows


def brute(words):
    """Runs by their definition: every stretch with its smallest period that can't be made longer."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        start = 0
        while start + q < n:
            end = start
            while end + q < n and words[end] == words[end + q]:
                end += 1
            size = end - start + q
            stretch = words[start : start + size]
            if end > start and size >= max(6, 4 * q) and not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                out.append((start, size, q))
            start = end + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def want(doc_id, text):
    words = periodic.planted(doc_id, (text or "").encode().split())
    runs = brute(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    rest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *rest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept(words, runs))).hexdigest()


TEXTS = st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=6), st.integers(1, 9)), max_size=6).map(lambda parts: [w for phrase, n in parts for w in phrase * n])


@settings(max_examples=400, deadline=None)
@given(TEXTS, st.integers(1, 30))
def test_scan(words, step):
    ids = periodic.numbers([w.encode() for w in words])
    lags = max(1, len(words) // 4)
    assert periodic.smallest(periodic.scan(ids, 1, lags)) == brute(words)
    parts = [r for first in range(1, lags + 1, step) for r in periodic.scan(ids, first, first + step - 1)]
    assert periodic.smallest(parts) == brute(words)


def test_other_bounds():
    ids = np.array([1, 2, 1, 2, 1, 3, 3], np.int32)
    assert periodic.smallest(periodic.scan(ids, 1, 7, least=2, exponent=2)) == [(0, 5, 2), (5, 2, 1)]


def rows():
    rng = random.Random(5)
    out = [r for r in edge_rows() if r[0] != 7]
    for i in range(120):
        phrase = [rng.choice("abcdefg") for _ in range(rng.randint(1, 9))]
        words = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 40))] + phrase * rng.randint(1, 9) + [rng.choice("abc") for _ in range(rng.randint(0, 40))]
        out.append((1000 + i, rng.choice([" ", "\n", "  \t"]).join(words), "en", "s"))
    return out


@pytest.mark.parametrize("split_bytes", [periodic.SPLIT_BYTES, 60])
def test_against_brute_force(spark, monkeypatch, split_bytes):
    monkeypatch.setattr(periodic.collapse, "__defaults__", (None, split_bytes, 7))
    got = periodic.op12(docs(spark, rows(), extra=True)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((want(i, t) for i, t, _, _ in rows()), key=str)
    assert sum(r.n_runs > 0 for r in got) > 50


def test_long_texts(spark):
    rng = random.Random(1)
    phrase = [f"w{rng.randint(0, 500)}" for _ in range(700)]
    texts = ["so " * 200_000, " ".join([f"v{i}" for i in range(30_000)] + phrase * 5 + ["end"])]
    got = {r.doc_id: r for r in periodic.collapse(docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    assert [tuple(r) for r in got[0].runs] == [(0, 200_000, 1)] and got[0].collapsed == "so"
    assert [tuple(r) for r in got[1].runs] == [(30_000, 3500, 700)]
    assert got[1].collapsed.split() == [f"v{i}" for i in range(30_000)] + phrase + ["end"]


def test_nulls_and_empty(spark):
    assert periodic.op12(docs(spark, [])).collect() == []
    (row,) = periodic.op12(docs(spark, [(None, None, None, None)])).collect()
    assert tuple(row) == want(None, None)
