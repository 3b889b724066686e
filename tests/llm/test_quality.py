import math
import pytest
import random

from tidemill.llm import quality

from .fixtures import docs, edge_rows

LABELS = "doc_id long, quality int, toxic int, keep int"
PAGES = "page_id long, url string, html string"


def tables(spark, seed=0, n=600):
    rng = random.Random(seed)
    rows, labels, pages, truth = [], [], [], {}
    for i in range(n):
        good, toxic = rng.random() < 0.7, rng.random() < 0.15
        words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(40)]
        if not good:
            words = [w + rng.choice(["$$$", "###"]) for w in words[:10]] * 4
        if toxic:
            words[5] = words[15] = "vile"
        truth[i] = good and not toxic
        rows.append((i, " ".join(words), "en", f"s{i % 3}"))
        if i % 2:
            labels.append((i, int(good), int(toxic), 7))
        if i % 5 == 0:
            pages.append((i, f"https://h{i % 4}.example/en/{i}.html?x", ""))
    return rows, labels, pages, truth


def test_held_out_rows(spark):
    rows, labels, pages, truth = tables(spark)
    got = {r.doc_id: r for r in quality.op1(docs(spark, rows, extra=True), spark.createDataFrame(labels, LABELS), spark.createDataFrame(pages, PAGES)).collect()}
    unseen = [i for i in truth if i % 2 == 0]
    assert sum(got[i].keep == truth[i] for i in unseen) / len(unseen) > 0.97
    assert got[10].host == "h2.example" and got[10].path == "/en" and got[11].host == "s2"


def test_toxic_word_of_a_small_language_in_many_forms(spark):
    rows, labels, pages, _ = tables(spark)
    rng = random.Random(1)
    forms = [f"reéux{e}" for e in ("a", "o", "as", "os", "amos", "aba", "ando", "ido")]
    for i in range(1000, 1240):
        words = [rng.choice("uno dos tres cuatro cinco seis siete ocho".split()) for _ in range(40)]
        if i % 8 == 0:
            words[7], words[21] = rng.sample(forms, 2)
        rows.append((i, " ".join(words), "es", f"s{i % 3}"))
        if i % 5 < 2:
            labels.append((i, 1, int(i % 8 == 0), 7))
    got = {r.doc_id: r.p_toxic >= 0.75 for r in quality.op1(docs(spark, rows), spark.createDataFrame(labels, LABELS), spark.createDataFrame(pages, PAGES)).collect()}
    unseen = [i for i in range(1000, 1240) if i % 5 >= 2]
    assert all(got[i] == (i % 8 == 0) for i in unseen)


def test_sites_shrink_to_the_prior(spark):
    rows = [(i, "plain words", "en", "big" if i < 200 else "small" if i < 202 else f"o{i % 9}") for i in range(400)]
    labels = [(i, int(not (i < 202)), 0, 0) for i in range(400)]
    got = {r.doc_id: r for r in quality.op1(docs(spark, rows), spark.createDataFrame(labels, LABELS), spark.createDataFrame([], PAGES)).collect()}
    assert got[0].quality_site < got[200].quality_site < got[300].quality_site
    assert got[0].quality_site < 0.05


def test_edge_rows(spark):
    none = spark.createDataFrame([], LABELS), spark.createDataFrame([], PAGES)
    rows = edge_rows()
    got = quality.op1(docs(spark, rows, extra=True), *none).collect()
    assert sorted((str(r.doc_id) for r in got)) == sorted(str(r[0]) for r in rows)
    assert all(0 <= r.p_quality <= 1 and r.keep is not None for r in got)
    odd = spark.createDataFrame([(None, 1, 0, 0), (1, None, None, 0), (4, 1, None, 0), (4, 0, 1, 0)], LABELS)
    pages = spark.createDataFrame([(1, None, ""), (None, "https://h/en/4", ""), (3, "https://h/en/4", "")], PAGES)
    assert len(quality.op1(docs(spark, rows), odd, pages).collect()) == len(rows)
    assert quality.op1(docs(spark, []), *none).collect() == []


def test_posteriors_against_brute_force(spark):
    """Nested analysis of variance and shrinkage, redone row by row."""
    rng = random.Random(9)
    rows = []
    for i in range(400):
        host, path = f"h{min(rng.randrange(12), 8)}", f"/p{rng.randrange(4)}"
        lean = 2.5 * (host in ("h1", "h8")) - 1 + (path == "/p0")
        rows.append((i if i % 50 else None, host, path, rng.gauss(lean, 1), rng.gauss(-lean, 1), rng.choice([None, 0.0, 1.0]), rng.choice([None, None, 1.0, 0.0])))
    frame = spark.createDataFrame(rows, "doc_id long, host string, path string, good double, bad double, quality double, toxic double")
    got = {(r.host, r.path, r.good): r for r in quality.posteriors(frame).collect()}
    for t, e, at in (("quality", 3, 5), ("toxic", 4, 6)):
        known = [r[at] for r in rows if r[at] is not None]
        prior = sum(known) / len(known)
        own = [r[at] if r[at] is not None else 1 / (1 + math.exp(-(r[e] + math.log(prior / (1 - prior))))) for r in rows]
        mean, n = sum(own) / len(own), len(own)

        def groups(key):
            out = {}
            for r, v in zip(rows, own, strict=True):
                out.setdefault(key(r), []).append(v)
            return out

        hosts, paths = groups(lambda r: r[1]), groups(lambda r: r[1:3])
        p_within = sum((v - sum(g) / len(g)) ** 2 for g in paths.values() for v in g) / (n - len(paths))
        h_between = sum(len(g) * (sum(g) / len(g) - mean) ** 2 for g in hosts.values())
        p_between = sum(len(g) * (sum(g) / len(g) - sum(hosts[k[0]]) / len(hosts[k[0]])) ** 2 for k, g in paths.items())
        h_each = n - sum(len(g) ** 2 for g in hosts.values()) / n
        p_each = n - sum(len(g) ** 2 / len(hosts[k[0]]) for k, g in paths.items())

        def counts_as(between, df, each):
            spread = (between - df * p_within) / each
            return min(quality.MANY, max(quality.FEWEST, p_within / spread)) if spread > 0 else quality.MANY

        a, b = counts_as(h_between, len(hosts) - 1, h_each), counts_as(p_between, len(paths) - len(hosts), p_each)
        for r, v in zip(rows, own, strict=True):
            h, p = hosts[r[1]], paths[r[1:3]]
            host = (a * prior + sum(h) - v - (mean - prior) * (len(h) - 1)) / (len(h) - 1 + a)
            site = (b * host + sum(p) - v - (mean - prior) * (len(p) - 1)) / (len(p) - 1 + b)
            assert got[r[1], r[2], r[3]][f"{t}_site"] == pytest.approx(site, rel=1e-6, abs=1e-9)


def test_evidence_against_brute_force(spark):
    """Log-odds of words and stems, counted and drawn towards 0 by hand, and the sums of the strongest."""
    rows, labels, _, _ = tables(spark, seed=4)
    text, sides = {r[0]: r[1] for r in rows}, {"quality": 1, "toxic": 2}
    want: dict[str, list[float]] = {}
    for t, at in sides.items():
        groups = [[quality.features(text[r[0]]) for r in labels if r[at] == side] for side in (0, 1)]
        all_no, all_yes = map(len, groups)
        for word in set().union(*groups[0], *groups[1]):
            no, yes = (sum(word in f for f in g) for g in groups)
            odds = math.log((yes + 0.5) / (all_yes + 1)) - math.log((no + 0.5) / (all_no + 1))
            error = math.sqrt(1 / (yes + 0.5) + 1 / (no + 0.5))
            if t == "toxic":
                value = odds / (1 + error**2 / quality.VARIANCE)
            else:
                value = odds - math.copysign(quality.DRAWN * error, odds) if abs(odds) / error >= quality.LEAST_Z and not word.startswith("<stem ") else 0.0
            if no + yes >= quality.LEAST_ROWS:
                want.setdefault(word, []).append(value)
    words = quality.fit(docs(spark, rows).select("doc_id", "text"), spark.createDataFrame(labels, LABELS).select("doc_id", "quality", "toxic"))
    assert set(words) <= set(want) and len(words) > 20
    for word, (good, bad) in words.items():
        assert (good, bad) == pytest.approx(want[word], abs=1e-9)
    assert all(abs(v) < 1e-9 for word, values in want.items() if word not in words for v in values)
    found = quality.scored(docs(spark, rows).select("doc_id", "source", "text"), words).collect()
    for r in found:
        for value, k in ((r.good, 0), (r.bad, 1)):
            hits = sorted(words[f][k] for f in quality.features(text[r.doc_id]) if f in words)
            total = sum(sorted(h for h in hits if h < 0)[: quality.STRONGEST]) + sum(sorted((h for h in hits if h > 0), reverse=True)[: quality.STRONGEST])
            assert value == pytest.approx(quality.MOST * math.tanh(total / quality.MOST), abs=1e-9)
