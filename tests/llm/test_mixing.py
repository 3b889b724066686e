import math
import re
from collections import defaultdict

import pytest

from tidemill.llm import mixing

from .fixtures import docs, edge_rows


def brute_targets(sizes):
    """Targets by sharing the excess again until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        target = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in order}
        above = {s for s in free if target[s] > 3 * sizes[s]}
        if not above:
            return target
        capped |= above


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, got):
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for _, text, _, source in rows:
        sizes[source] += size(text)
    assert sorted(((r.doc_id, r.size, r.source_size) for r in got), key=str) == sorted(((r[0], size(r[1]), sizes[r[3]]) for r in rows), key=str)
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    want = brute_targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
    for source in sizes:
        assert target[source] == pytest.approx(want[source])
        assert taken[source] == math.floor(target[source] + 1e-6) or taken[source] == math.floor(target[source])


@pytest.mark.parametrize("limit", [mixing.BROADCAST_SOURCES, 0])
def test_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", limit)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 16)
    rows = edge_rows() + [(100 + i, "w " * (i % 37), "en", f"s{min(i % 9, 4)}") for i in range(400)] + [(900, "long " * 5000, "en", "tiny"), (901, "a", "en", "s10"), (902, None, "en", "blank")]
    mixed = mixing.mix(docs(spark, rows))
    got = mixed.collect()
    check(rows, got)
    again = mixing.mix(docs(spark, rows).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


@pytest.mark.parametrize(("range_rows", "wide", "at_once"), [(8, 4, 3), (1, 2, 1)])
def test_cuts_over_wide_ranges(spark, monkeypatch, range_rows, wide, at_once):
    """More ranges than a wide one holds, and more equal rows than are written out at a time."""
    for name, value in (("RANGE_ROWS", range_rows), ("WIDE", wide), ("AT_ONCE", at_once)):
        monkeypatch.setattr(mixing, name, value)
    rows = [(i, "w " * (i % 13), "en", "hot" if i % 2 else f"s{i % 5}") for i in range(600)] + [(7000, "many equal rows", "en", "hot")] * 40
    check(rows, mixing.mix(docs(spark, rows)).collect())
    taken = sum(r.taken for r in mixing.op8(docs(spark, rows)).collect())
    assert sum(size(r.text) for r in mixing.mixed_documents(docs(spark, rows)).collect()) == taken


def test_query_and_documents(spark):
    rows = edge_rows() + [(100 + i, f"one\ttwo  three{i}\nfour ", "en", "abc"[i % 3]) for i in range(60)]
    df = docs(spark, rows, extra=True)
    assert mixing.op8(df).columns == ["doc_id", "size", "source_size", "target", "taken"]
    taken = sum(r.taken for r in mixing.op8(df).collect())
    out = mixing.mixed_documents(df)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    parts = out.collect()
    assert sum(size(r.text) for r in parts) == taken
    whole = defaultdict(set)
    for r in rows:
        whole[r[0]].add(r[1])
    assert all(any((t or "").startswith(r.text) for t in whole[r.doc_id]) for r in parts)


def test_empty_and_blank(spark):
    assert mixing.op8(docs(spark, [])).collect() == []
    assert mixing.mixed_documents(docs(spark, [])).collect() == []
    got = mixing.op8(docs(spark, [(1, None, None, None), (2, " ", None, "a")])).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
