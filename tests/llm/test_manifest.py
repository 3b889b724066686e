import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidemill.llm import manifest

from .fixtures import docs, edge_rows


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, text, lang, source):
    n = len(text or "")
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)))


def tree(nodes, fanout):
    """The root and each node's path, as pairs of siblings before and after."""
    paths = [[] for _ in nodes]
    at = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [list(range(i, min(i + fanout, len(nodes)))) for i in range(0, len(nodes), fanout)]
        for run in runs:
            for i in run:
                for x in at[i]:
                    paths[x].append(("".join(nodes[j] for j in run if j < i), "".join(nodes[j] for j in run if j > i)))
        at = [[x for i in run for x in at[i]] for run in runs]
        nodes = [sha("".join(nodes[i] for i in run)) for run in runs]
    return nodes[0], paths


def brute(rows, fanout=3):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    below = []
    for source in sources:
        own = sorted((r for r in rows if r[3] == source), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        below.append((own, *tree([leaf(*r) for r in own], fanout)))
    root, upper = tree([subroot for _, subroot, _ in below], fanout)
    out = []
    for (own, subroot, paths), rest in zip(below, upper, strict=True):
        for r, path in zip(own, paths, strict=True):
            path = path + rest
            change = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            # the tampered text has its old n_chars
            acc = sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], len(r[1] or ""), r[1].replace("\n", "")))) if change else leaf(*r)
            for before, after in path:
                acc = sha(before + acc + after)
            out.append((r[0], leaf(*r), subroot, root, sha("".join(a + b for a, b in path)), acc, acc == root))
    return sorted(out, key=str)


def rows_of(n, sources):
    return [(i, f"text {i}" + "\nline" * (i % 3), "en", sources[i * i % len(sources)]) for i in range(n)]


@pytest.mark.parametrize("rows", [edge_rows(), rows_of(1, ["a"]), rows_of(28, ["a"]), rows_of(83, ["b", None, "é", "", "a", "b", "b"]), rows_of(60, [f"s{i}" for i in range(60)])])
def test_against_brute_force(spark, rows):
    assert sorted(map(tuple, manifest.op11(docs(spark, rows, extra=True)).collect()), key=str) == brute(rows)


def test_fanout_and_verification(spark):
    rows = rows_of(40, ["a", "b", "b", "b"])
    built = manifest.manifest(docs(spark, rows), fanout=2).select("doc_id", F.hex("root").alias("root"), manifest.folded(F.col("leaf"), F.col("path")).alias("again"))
    got = built.collect()
    assert len(got) == 40 and {r.root.lower() for r in got} == {r.again for r in got} == {brute(rows, 2)[0][3]}


def test_empty(spark):
    assert manifest.op11(docs(spark, [])).collect() == []


def test_order_of_rows_does_not_matter(spark):
    rows = edge_rows() + rows_of(50, ["a", None])
    assert sorted(map(str, manifest.op11(docs(spark, rows).repartition(7)).collect())) == sorted(map(str, manifest.op11(docs(spark, rows[::-1])).collect()))
