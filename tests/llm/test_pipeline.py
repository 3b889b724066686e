import hashlib
import importlib
import os
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from .fixtures import docs, edge_rows

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def pipeline():
    return importlib.import_module("corpus_pipeline")


def test_stages_on_edge_rows(spark, pipeline, tmp_path):
    words = "the and of to in is that it for was on are with".split()
    rows = edge_rows() + [(100 + i, " ".join(words[(i * j) % 13] + str(j % 3) * (j % 2) for j in range(1, 40)) + f" mail u{i}@h.org", "en", f"s{i % 2}") for i in range(30)]
    rows += [(500 + i, r[1], "en", "s1") for i, r in enumerate(rows[-3:])]
    frame = docs(spark, rows, extra=True)
    sizes = []
    for place, (_, stage) in enumerate(pipeline.STAGES):
        frame = stage(spark, frame, "")
        if place < 4:
            assert frame.columns == COLUMNS
        frame.write.parquet(str(tmp_path / str(place)))
        frame = spark.read.parquet(str(tmp_path / str(place)))
        sizes.append(frame.count())
    assert sizes[0] <= len(rows) and sizes[1] <= sizes[0] - 3 and sizes[2] == sizes[1]
    texts = {r.text for r in spark.read.parquet(str(tmp_path / "2")).collect()}
    assert not any(re.search(r"u\d+@h\.org", t) for t in texts)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mixed = sorted((r.doc_id, r.text) for r in spark.read.parquet(str(tmp_path / "3")).where("doc_id is not null").collect())
    want = sorted((i, hashlib.sha256(",".join(map(str, library.encode(t, add_special_tokens=False).ids)).encode()).hexdigest()) for i, t in mixed)
    assert sorted((r.doc_id, r.ids_sha256) for r in frame.where("doc_id is not null").collect()) == want


def test_run(spark, pipeline, monkeypatch):
    """All but the last of the stages' files are gone by the end."""
    gone, delete = [], pipeline.delete
    monkeypatch.setattr(pipeline, "delete", lambda session, path: (gone.append(path), delete(session, path)))
    assert pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert len(gone) == len(pipeline.STAGES) - 2
    assert not any(os.path.exists(path.removeprefix("file:")) for path in gone)


def test_empty(spark, pipeline):
    frame = docs(spark, [])
    for _, stage in pipeline.STAGES:
        frame = stage(spark, frame, "")
    assert frame.collect() == []
