import random
import time
from math import comb
from pathlib import Path

import numpy as np
import pytest
import xxhash

from tidemill.llm import simhash
from tidemill.llm.common import cut

from .fixtures import docs, edge_rows


def brute_fingerprint(text, words=3):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    found = [w for w in lower.split(" ") if w]
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, distance):
    n = len(ids)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    best = {}
    for i in range(n):
        if ids[i] is not None:
            best[find(i)] = min(best.get(find(i), ids[i]), ids[i])
    return [best.get(find(i)) for i in range(n)]


def test_against_brute_force(spark):
    rng = random.Random(7)
    base = [" ".join(rng.choice("abcdefghij") for _ in range(60)) for _ in range(12)]
    rows = edge_rows() + [(100 + i, rng.choice(base) + (" tail" if rng.random() < 0.4 else "") + (" more" * rng.randint(0, 2)), "en", "s") for i in range(150)]
    got = sorted(map(tuple, simhash.op10(docs(spark, rows, extra=True)).collect()), key=str)
    prints = [brute_fingerprint(r[1]) for r in rows]
    roots = brute_components([r[0] for r in rows], prints, 2)
    assert got == sorted(((r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, roots, strict=True)), key=str)


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_links_of_dense_and_spread_values(spark, distance):
    rng = np.random.default_rng(distance)
    spread = rng.integers(-(2**63), 2**63 - 1, 300, dtype=np.int64)
    centre = int(spread[0])
    dense = [centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (250, 2))]
    low = list(range(0, 400))
    values = sorted({*map(int, spread), *dense, *low})
    found = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), distance, split_over=100)
    got = sorted((r.a, r.b) for r in found.collect())
    u = np.array(values, dtype=np.int64).view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= distance
    assert got == [(values[i], values[j]) for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True)]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(2000, 2001), (2000, 2001)]
    got = {r.node: r.root for r in simhash.components(cut(spark.createDataFrame(edges, "a long, b long"))).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{1000 + i: 1000 for i in range(1, 50)}, 2001: 2000}


def test_thresholds_cover_the_distance():
    rng = np.random.default_rng(1)
    sample = rng.integers(-(2**63), 2**63 - 1, 500, dtype=np.int64)
    for total in (1_000, 10**6, 10**9, 10**12):
        parts, thresholds = simhash.plan(sample, total, 2)
        assert sorted(b for p in parts for b in p) == list(range(64))
        assert sum(t + 1 for t in thresholds) == 3


@pytest.mark.parametrize("distance", [2, 6])
def test_probes_of_any_number_of_rows_are_bounded(distance):
    """Each probe is a shuffled row: at 2 million rows the plan took some 280 for each at a distance of 6."""
    rng = np.random.default_rng(2)
    sample = rng.integers(-(2**63), 2**63 - 1, 3000, dtype=np.int64)
    for total in (1_000, 230_000, 2_800_000, 14_000_000, 10**9):
        parts, thresholds = simhash.plan(sample, total, distance)
        assert sum(t + 1 for t in thresholds) == distance + 1
        assert sum(comb(len(p), flipped) for p, t in zip(parts, thresholds, strict=True) for flipped in range(t + 1)) <= 64


@pytest.mark.parametrize("cost", [0.001, 50.0, 1e6])
def test_links_are_the_same_by_many_and_few_probes(spark, monkeypatch, cost):
    monkeypatch.setattr(simhash, "PROBE_COST", cost)
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 60, dtype=np.uint64)
    near = np.repeat(centres, 8) ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (480, 4), dtype=np.uint64), axis=1)
    values = np.unique(near).view(np.int64)
    got = sorted((r.a, r.b) for r in simhash.links(spark.createDataFrame([(v,) for v in values.tolist()], "fp long"), 6, split_over=6).collect())
    u = values.view(np.uint64)
    close = np.bitwise_count(u[:, None] ^ u[None, :]) <= 6
    want = sorted((int(min(values[i], values[j])), int(max(values[i], values[j]))) for i, j in zip(*np.nonzero(np.triu(close, 1)), strict=True))
    assert got == want and len(want) > 100


def test_shuffle_files_go_with_their_action(spark):
    """What the operator's own actions shuffle is gone when it returns, whether or not the driver collects garbage."""
    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def shuffled():
        return {f.name for folder in folders for f in Path(folder).rglob("shuffle_*.data")}

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffled(), spark.conf.get(name, None)
    rows = edge_rows() + [(100 + i, " ".join(f"w{i % 10}x{j}" for j in range(50)) + f" end{i}", "en", "s") for i in range(60)]
    kept = simhash.keep_one(docs(spark, rows), words=1, distance=6, similarity=0.8, distinct=True)
    found = simhash.near_duplicates(docs(spark, rows))
    deadline = time.monotonic() + 10  # executors delete them in the background
    while shuffled() - before and time.monotonic() < deadline:
        time.sleep(0.1)
    assert not shuffled() - before
    assert spark.conf.get(name, None) == setting
    assert kept.count() == kept.count() < found.count() == found.count() == len(rows)


def test_links_between_components(spark):
    rng = np.random.default_rng(4)
    near = np.uint64(99) ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (400, 3), dtype=np.uint64), axis=1)
    values = np.unique(np.concatenate((near, rng.integers(0, 2**63, 300, dtype=np.uint64)))).view(np.int64)
    roots = np.where(rng.random(len(values)) < 0.6, 7, rng.integers(100, 140, len(values)))
    frame = spark.createDataFrame(list(zip(values.tolist(), roots.tolist(), strict=True)), "fp long, root long")
    u = values.view(np.uint64)
    apart = np.bitwise_count(u[:, None] ^ u[None, :])
    for beyond, reach in ((0, 2), (2, 4), (4, 6)):
        wanted = np.triu((apart > beyond) & (apart <= reach) & (roots[:, None] != roots[None, :]), 1)
        want = sorted((int(min(values[i], values[j])), int(max(values[i], values[j]))) for i, j in zip(*np.nonzero(wanted), strict=True))
        assert len(want) > 20
        for largest in (None, 7):
            assert sorted((r.a, r.b) for r in simhash.links(frame, reach, split_over=50, beyond=beyond, largest=largest).collect()) == want


@pytest.mark.parametrize("distance", [4, 5, 6])
def test_similar_texts_against_brute_force(spark, distance):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 400))]
        for copy in range(6):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 8, 30])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((group * 10 + copy, " ".join(own), "en", "s"))
    rows += [(900, None, "en", "s"), (901, " ", "en", "s"), (None, rows[0][1] + " more", "en", "s"), (902, "short text", "en", "s"), (903, "short text", "en", "s")]
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs(spark, rows, extra=True), 2, distance, 0.8).collect()}
    named = [r for r in rows if r[0] is not None]
    prints = [brute_fingerprint(r[1], 2) for r in named]

    def shingles(text):
        found = (text or "").split()
        return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))}

    sets = [shingles(r[1]) for r in named]
    root = list(range(len(named)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    linked = 0
    for i in range(len(named)):
        for j in range(i):
            near = (prints[i] ^ prints[j]).bit_count()
            if near == 0 or near <= distance and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
                linked += near > 0
    assert linked > 20
    want = {(r[0], min(named[k][0] for k in range(len(named)) if find(k) == find(i))) for i, r in enumerate(named)}
    assert {g for g in got if g[0] is not None} == want


@pytest.mark.parametrize("crowded", [32, 2])
def test_equal_fingerprints_are_verified(spark, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = random.Random(3)
    rows = []
    for i in range(40):
        own = [f"own{rng.randrange(10**6)}" for _ in range(90)]
        rows += [(2 * i, "the quick brown fox jumps over fences " * 100 + " ".join(own), "en", "s")]
        if i % 4 == 0:  # a near copy with the same fingerprint
            rows += [(2 * i + 1, rows[-1][1] + " end", "en", "s")]
    rows += [(0, rows[-1][1] + " last", "en", "s"), (None, rows[1][1], "en", "s"), (None, "no id at all", "en", "s"), (None, "no id at all", "en", "s")]
    assert len({brute_fingerprint(r[1], 2) for r in rows[:-2]}) == 1
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(spark, rows[:-4], extra=True), 2, 6, 0.8).collect()}
    assert found == {r[0]: r[0] - r[0] % 2 for r in rows[:-4]}
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs(spark, rows, extra=True), 2, 6, 0.8).collect()), key=str)
    want = [(r[0], r[1]) for r in rows[:-4] if r[0] % 2 == 0 and r[0] != rows[-5][0]]
    assert kept == sorted([*want, (0, rows[-4][1]), (None, "no id at all")], key=str)


def five_words(text):
    found = (text or "").lower().split()
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))}


def distinct_print(text):
    """The stage's fingerprint: of the distinct words."""
    hashes = {xxhash.xxh64_intdigest(w.encode(), 42) for w in (text or "").lower().split()}
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def edited(rng, words, n, vocabulary):
    own = list(words)
    for _ in range(n):
        at = rng.randrange(len(own))
        own[at : at + 1] = rng.choice([[rng.choice(vocabulary)], [], [own[at], rng.choice(vocabulary)]])
    return own or ["x"]


@pytest.mark.parametrize("crowded", [1024, 3])
def test_the_stages_groups_against_brute_force(spark, monkeypatch, crowded):
    """The pipeline's parameters: links are pairs within 6 bits, equal fingerprints too, that share 0.8 of their shingles."""
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for group in range(24):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 300))]
        for copy in range(7):
            own = rng.sample(base, len(base)) if copy == 6 else edited(rng, base, rng.choice([0, 0, 1, 2, 4, 9, 30]), vocabulary)
            rows.append((group * 10 + copy, " ".join(own), "en", "s"))  # a shuffled copy has the same fingerprint
    rows += [(900, None, "en", "s"), (901, " ", "en", "s"), (902, "short text", "en", "s"), (903, "Short  text", "en", "s"), (904, "text short", "en", "s")]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(spark, rows, extra=True), words=1, distance=6, similarity=0.8, distinct=True).collect()}
    prints, sets = [distinct_print(r[1]) for r in rows], [five_words(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    linked = apart = 0
    for i in range(len(rows)):
        for j in range(i):
            near = (prints[i] ^ prints[j]).bit_count() <= 6
            similar = len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            if near and similar:
                root[max(find(i), find(j))] = min(find(i), find(j))
                linked += prints[i] != prints[j]
            apart += prints[i] == prints[j] and not similar
    assert linked > 20 and apart > 20
    assert got == {r[0]: rows[find(i)][0] for i, r in enumerate(rows)}


def test_the_stages_recall_of_planted_near_copies(spark):
    """Of all pairs that share 0.8 of their shingles, by any fingerprint, at least 0.9 end in one group."""
    rng = random.Random(22)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for group in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 500))]
        rows += [(group * 10 + copy, " ".join(edited(rng, base, int(len(base) * rate), vocabulary)), "en", "s") for copy, rate in enumerate((0, 0.005, 0.01, 0.015, 0.02, 0.03))]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(spark, rows), words=1, distance=6, similarity=0.8, distinct=True).collect()}
    sets = [five_words(r[1]) for r in rows]
    pairs = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(pairs) > 300
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs)
    assert all(got[a] // 10 == a // 10 for a in got)  # texts of different groups stay apart


def test_keep_one_and_empty(spark):
    rows = edge_rows()
    kept = simhash.keep_one(docs(spark, rows, extra=True))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([None, 1, 4, 5, 7, 8, 9], key=str)
    assert simhash.op10(docs(spark, [])).collect() == []
    assert simhash.keep_one(docs(spark, [])).collect() == []
