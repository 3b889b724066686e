import numpy as np
import pytest

from tidemill.llm import ann, exact_search, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, score int, Rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], SCHEMA)


def brute(rows, k=20, integers=True):
    """Each query's best by sorting all candidates."""
    kept = [(i, [float(np.float32(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    kept = [(i, [int(np.floor(64 * x)) for x in v] if integers else v) for i, v in kept if integers or any(v)]
    out = []
    for q, v in {i: w for i, w in sorted(kept, key=lambda x: (x[0], len(x[1])), reverse=True) if i % 20 == 0}.items():
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in kept if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


def edge_vectors(rng):
    rows = [(i, rng.normal(size=6).tolist()) for i in range(60)]
    return rows + [(None, [1.0] * 6), (100, None), (120, []), (140, [None, 1.0]), (160, [float("nan")] * 6), (180, [float("inf")] * 6), (200, [0.0] * 6), (220, [1.0, 2.0]), (221, [3.0, -1.0]), (5, rows_five := rng.normal(size=6).tolist()), (5, rows_five), (240, [1e30] * 6)]


def test_exact_edge_rows(spark):
    rows = edge_vectors(np.random.default_rng(0))[:-1]
    got = exact_search.op6(table(spark, rows)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)
    assert exact_search.op6(table(spark, [])).collect() == []
    huge = [(0, [1e10, 1.0]), (1, [1e10, 1.0]), (2, [-1e10, 2.0]), (3, [3e9, 0.5])]
    limit = 2**63 - 1
    assert sorted((r.vec_id, r.score) for r in exact_search.op6(table(spark, huge)).collect()) == sorted((i, max(-limit, min(limit, s))) for _, _, i, s in brute(huge))


@pytest.mark.parametrize("kind", ["spread", "tight", "ties"])
def test_exact_in_blocks(spark, monkeypatch, kind):
    monkeypatch.setattr(exact_search, "QUERIES", 16)
    monkeypatch.setattr(exact_search, "CANDIDATES", 300)
    monkeypatch.setattr(exact_search, "BUCKET", 32)
    rng = np.random.default_rng(1)
    data = rng.normal(size=(900, 12))
    if kind == "spread":  # lengths differ, so buckets are pruned
        data *= rng.lognormal(0, 1.5, size=(900, 1))
    elif kind == "tight":  # near one direction, so local thresholds are high and coordinates prune
        data = np.array([5.0] + [0.2] * 11) * (1 + rng.normal(size=(900, 12)) * 0.05) * np.linspace(0.5, 2, 900)[:, None]
    else:
        data[:300] = data[0]
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    got = exact_search.op6(table(spark, rows)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_short_candidates_are_not_sent(spark, monkeypatch):
    monkeypatch.setattr(exact_search, "QUERIES", 16)
    monkeypatch.setattr(exact_search, "CANDIDATES", 300)
    monkeypatch.setattr(exact_search, "HEAD", 64)
    rng = np.random.default_rng(5)
    data = rng.normal(size=(900, 4)) * rng.lognormal(0, 2, size=(900, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(i, [i / 10_000, 0.1]) for i in range(2000, 2060)]
    checked = vectors.checked(table(spark, rows), scale=exact_search.SCALE)
    sent, groups = exact_search.dealt(checked, vectors.queries_of(checked), 20)
    assert groups in (3 * 4, 4 * 4, 5 * 4)
    assert sent.where("side = 1").count() < 0.6 * 960 * groups / 4
    assert sorted(tuple(r) for r in exact_search.op6(table(spark, rows)).collect()) == brute(rows)


def test_nearest_edge_rows(spark):
    rows = edge_vectors(np.random.default_rng(2))[:-1]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.op9(table(spark, rows)).collect())
    want = brute(rows, integers=False)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want])
    assert ann.op9(table(spark, [])).collect() == []


def test_nearest_recall(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(4000, 32))
    data /= np.linalg.norm(data, axis=1)[:, None]
    data = data.astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    found = ann.op9(table(spark, rows)).collect()
    exact = data.astype(np.float64)
    hits = total = 0
    by_query = {}
    for r in found:
        by_query.setdefault(r.query_id, []).append(r)
    assert len(by_query) == 200
    for q, own in by_query.items():
        score = exact @ exact[q]
        score[q] = -9
        best = set(np.argsort(-score)[:20].tolist())
        hits += len(best & {r.vec_id for r in own})
        total += 20
        assert [r["rank"] for r in sorted(own, key=lambda r: (-r.score, r.vec_id))] == list(range(1, 21))
        assert all(abs(r.score - score[r.vec_id]) < 1e-12 for r in own)
    assert hits / total >= 0.9


def table_of(kind, rng, n=6000, d=24):
    data = rng.normal(size=(n, d))
    data /= np.linalg.norm(data, axis=1)[:, None]
    if kind == "clustered":  # three quarters in tight groups; the queries outside are hard
        centres = data[:40].copy()
        data[: 3 * n // 4] = centres[rng.integers(0, 40, 3 * n // 4)] + 0.02 * rng.normal(size=(3 * n // 4, d))
    elif kind == "copies":  # a third near copies of one vector
        data[: n // 3] = data[0] + 0.003 * rng.normal(size=(n // 3, d))
    return data[rng.permutation(n)].astype(np.float32)


@pytest.mark.parametrize("kind", ["random", "clustered", "copies"])
def test_recall_of_the_worst_queries(spark, kind):
    data = table_of(kind, np.random.default_rng(8))
    found = {}
    for r in ann.op9(table(spark, [(i, v.tolist()) for i, v in enumerate(data)])).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    exact, recall = data.astype(np.float64), []
    assert len(found) == 300 and all(len(f) == 20 for f in found.values())
    for q, own in found.items():
        score = exact @ exact[q]
        score[q] = -9
        recall.append(len(own & set(np.argsort(-score)[:20].tolist())) / 20)
    assert np.mean(recall) >= 0.95
    assert np.mean(sorted(recall)[:30]) >= 0.9


def test_lists_beyond_the_coarse_centroids(spark, monkeypatch):
    monkeypatch.setattr(ann, "COARSE", 10)
    data = table_of("clustered", np.random.default_rng(9))
    model = ann.Model(data.astype(np.float64), len(data))
    assert model.lists == len(model.coarse) * len(model.fine) >= 77 > len(model.coarse) == 10
    found = ann.op9(table(spark, [(i, v.tolist()) for i, v in enumerate(data)])).collect()
    exact = data.astype(np.float64)
    hits = sum(exact[r.query_id] @ exact[r.vec_id] >= np.sort(np.delete(exact @ exact[r.query_id], r.query_id))[-20] - 1e-12 for r in found)
    assert hits / len(found) >= 0.9


def test_nearest_among_copies_are_the_smallest_ids(spark):
    data = np.random.default_rng(4).normal(size=(900, 8))
    data[::3] = 3.0
    found = ann.op9(table(spark, [(i, v.tolist()) for i, v in enumerate(data)])).where("query_id = 60").collect()
    copies = [i for i in range(0, 900, 3) if i != 60]
    assert [r.vec_id for r in sorted(found, key=lambda r: r["rank"])] == copies[:20]


def test_best_breaks_ties_by_id():
    best = vectors.Best(2, 3, np.int64)
    best.add_block(np.array([0, 1]), np.arange(10)[::-1].copy(), np.zeros((2, 10), np.int64), np.array([0, 99]))
    best.add_block(np.array([1]), np.array([50]), np.array([[7]]), np.array([99]))
    assert best.ids.tolist() == [[1, 2, 3], [50, 0, 1]]
