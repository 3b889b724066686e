"""Quality by hierarchical empirical Bayes: a document's own evidence with its host's and path's posteriors.

Evidence. A word's presence in labelled documents gives its log-odds for quality and for toxicity, drawn towards 0 by
their standard errors. For quality, words that are not clearly on one side count nothing. For toxicity all words count,
as do their stems, which pool a word's forms: toxic words of languages with few labels are never clear by themselves. As words depend on each other, a
document's evidence is the sum of only the STRONGEST on either side, softly bounded. Labels
are taken from at most FIT_ROWS labelled rows, those with the smallest hashes; the words from these rows' whole texts.
Sites. Over all documents the evidence (or, where there is one, the label) is averaged for each host and each host's
paths. How much hosts differ from all, and paths from their own host, beyond what their documents differ (nested
analysis of variance) says how many documents the prior counts as; a host's posterior is shrunk to the global prior,
and a path's to its host's. A document's own share is left out of its site's.
The result joins both: the odds of the path's posterior times the document's own.

Defined cases: texts are taken whole, however long; ties have no part. A null text has no words and gets its site's posterior. A document without a page has its source as
host and no path; null sources are one host. Null and repeated doc_ids each keep their rows; of several pages or
labels of a document the first page by id and the mean label count. Without labels all evidence is 0. An empty table
gives an empty result. Further columns are dropped.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot, pick, slices, texts
from .url_filter import host_and_path

FIT_ROWS = 20_000
#: Words and stems have evidence from so many documents on, and for quality from so many standard errors.
LEAST_ROWS, LEAST_Z = 2, 4.0
#: Letters of a stem, and the variance that log-odds of toxicity are taken to have.
STEM, VARIANCE = 5, 2.0
#: Standard errors by which log-odds are drawn towards 0, and the words that count on either side.
DRAWN, STRONGEST = 2.0, 3
#: Bounds of a document's evidence and of what the prior counts as.
MOST, FEWEST, MANY = 8.0, 2.0, 200.0
#: What is kept: at least so likely good, and less than so likely toxic.
GOOD_FROM, TOXIC_FROM = 0.5, 0.75
_WORD = re.compile(r"[^\W\d_]+|[^\w\s]+")
TARGETS = ("quality", "toxic")


@lru_cache(maxsize=200_000)
def stem(start: str) -> str:
    """The stem of words with these first STEM characters: their letters without accents."""
    return f"<stem {''.join(c for c in unicodedata.normalize('NFD', start) if not unicodedata.combining(c))[:STEM]}>"


def features(text: str) -> set[str]:
    """Distinct words, their stems without accents, runs of signs, and marks for a text's shape."""
    found = Counter(_WORD.findall(text))
    words = [w for w in found if w[0].isalpha()]
    lower = set(map(str.lower, words))
    out = {w.lower() for w in found.keys() - set(words)} | lower
    out.update(map(stem, {w[:STEM] for w in lower}))
    n = sum(map(found.__getitem__, words))
    out.add(f"<length {min(12, n.bit_length())}>")
    if n:
        out.add(f"<distinct {10 * len(lower) // n}>")
        out.add(f"<upper {10 * sum(map(found.__getitem__, filter(str.isupper, words))) // n}>")
        out.add(f"<signs {min(10, 10 * (found.total() - n) // n)}>")
    return out


def fit(docs: DataFrame, labels: DataFrame) -> dict[str, tuple[float, float]]:
    """Log-odds of words for quality and for toxicity, from at most FIT_ROWS labelled rows."""
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    rows = docs.join(F.broadcast(chosen), "doc_id").select("text", *TARGETS)  # a bounded number of small rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[Counter[str]] = [Counter() for _ in range(2 * len(TARGETS))]
        for batch in slices(batches):
            sides = [batch.column(t).to_pylist() for t in TARGETS]
            for text, *side in zip(texts(batch.column("text")), *sides, strict=True):
                found = features(text) | {""}
                for k, v in enumerate(side):
                    if v is not None:
                        counts[2 * k + (v >= 0.5)].update(found)
        for side, n in enumerate(counts):
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.string()), pa.array([side] * len(n), pa.int32()), pa.array(n.values(), pa.int64())], ["word", "side", "n"])

    sums = [F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0)).alias(f"n{s}") for s in range(4)]
    counts = cut(rows.mapInArrow(count, "word string, side int, n long").groupBy("word").agg(*sums))
    total = counts.where("word = ''").first()
    if total is None:
        return {}

    def evidence(k: int) -> tuple[Column, Column]:
        no, yes = F.col(f"n{2 * k}"), F.col(f"n{2 * k + 1}")
        all_no, all_yes = total[f"n{2 * k}"], total[f"n{2 * k + 1}"]
        odds = F.log((yes + 0.5) / (all_yes + 1.0)) - F.log((no + 0.5) / (all_no + 1.0))
        error = F.sqrt(1 / (yes + 0.5) + 1 / (no + 0.5))
        z = F.abs(odds) / error
        both = min(all_no, all_yes) > 0
        if k:
            return odds / (1 + error * error / VARIANCE) if both else F.lit(0.0), z if both else F.lit(0.0)
        clear = (z >= LEAST_Z) & ~F.col("word").startswith("<stem ") if both else F.lit(False)
        return F.when(clear, odds - F.signum(odds) * DRAWN * error).otherwise(0.0), F.when(clear, z).otherwise(0.0)

    (good, good_z), (bad, bad_z) = evidence(0), evidence(1)
    scored = counts.where("word <> ''").where(sum(F.col(f"n{s}") for s in range(4)) >= 2 * LEAST_ROWS)
    scored = scored.select("word", good.alias("good"), bad.alias("bad"), F.greatest(good_z, bad_z).alias("z")).where("z > 0")
    return {r.word: (r.good, r.bad) for r in scored.collect()}  # words that two of FIT_ROWS rows share


def soft(values: list[float]) -> float:
    """The sum of the STRONGEST values on either side, within MOST."""
    values.sort()
    total = sum(v for v in values[:STRONGEST] if v < 0) + sum(v for v in values[-STRONGEST:] if v > 0)
    return MOST * math.tanh(total / MOST)


def scored(docs: DataFrame, words: dict[str, tuple[float, float]]) -> DataFrame:
    """doc_id, source and the evidence of the whole text: log-odds of quality and of toxicity."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches):
            good, bad = [], []
            for text in texts(batch.column("text")):
                hits = [known[f] for f in features(text) & known.keys()]
                good.append(soft([h[0] for h in hits]))
                bad.append(soft([h[1] for h in hits]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(good, pa.float64()), pa.array(bad, pa.float64())], ["doc_id", "source", "good", "bad"])

    return docs.select("doc_id", "source", "text").mapInArrow(run, "doc_id long, source string, good double, bad double")


def sites_of(pages: DataFrame) -> DataFrame:
    """doc_id, host and path (its first part) of pages whose url's path ends in a document's number."""
    host, path = host_and_path(F.col("url"))
    number = F.regexp_extract(path, r"/(\d{1,18})(?:\.\w+)?/?$", 1)
    rows = pages.select("page_id", host.alias("host"), F.regexp_extract(path, "^(/[^/]*)", 1).alias("path"), number.alias("number")).where("number <> ''")
    return rows.groupBy(F.col("number").cast("long").alias("doc_id")).agg(F.min(F.struct("page_id", "host", "path")).alias("p")).select("doc_id", "p.host", "p.path")


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(p / (1 - p))


def strengths(paths: DataFrame, hosts: DataFrame, target: str) -> tuple[float, float, float]:
    """The mean of all, and how many documents it counts as for a host, and a host's posterior for a path.

    paths: n, the target's sum and squares of each; hosts: n, the sum, and the sum of their paths' squared n.
    """
    n, total = F.col("n"), F.col(target)
    p = paths.agg(F.sum(n).alias("n"), F.sum(total).alias("s"), F.sum(f"{target}_squares").alias("q"), F.sum(total * total / n).alias("b"), F.count("*").alias("k")).first()
    h = hosts.agg(F.sum(total * total / n).alias("b"), F.sum(n * n).alias("nn"), F.sum(F.col("path_nn") / n).alias("inner"), F.count("*").alias("k")).first()
    if not p.n:
        return 0.5, MANY, MANY
    within = max(p.q - p.b, 0.0) / max(p.n - p.k, 1)

    def counts_as(between: float, groups: int, each: float) -> float:
        """groups: degrees of freedom; each: documents that a group has on the whole."""
        spread = (between / groups - within) * groups / each if groups > 0 and each > 0 else 0.0
        return min(MANY, max(FEWEST, within / spread)) if spread > 0 else MANY

    return p.s / p.n, counts_as(h.b - p.s * p.s / p.n, h.k - 1, p.n - h.nn / p.n), counts_as(p.b - h.b, p.k - h.k, p.n - h.inner)


def posteriors(rows: DataFrame) -> DataFrame:
    """rows of doc_id, host, path, good, bad and labels: adds quality_site and toxic_site, without the row's own share."""
    soft_label = {"quality": ("good", "quality"), "toxic": ("bad", "toxic")}
    known = rows.agg(F.count("*").alias("n"), *[F.avg(t).alias(t) for t in TARGETS]).first()
    prior = {t: 0.5 if known[t] is None else min(0.999, max(0.001, known[t])) for t in TARGETS}
    for t, (evidence, label) in soft_label.items():
        own = F.coalesce(F.col(label), _sigmoid(F.col(evidence) + math.log(prior[t] / (1 - prior[t]))))
        rows = rows.withColumn(f"{t}_own", own)
    rows = cut(rows.withColumn("site", F.xxhash64("host", "path")).withColumn("host_key", F.xxhash64("host")))
    sums = [x for t in TARGETS for x in (F.sum(f"{t}_own").alias(t), F.sum(F.col(f"{t}_own") * F.col(f"{t}_own")).alias(f"{t}_squares"))]
    paths = cut(rows.groupBy("host_key", "site").agg(F.count("*").alias("n"), *sums))
    hosts = cut(paths.groupBy("host_key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("path_nn"), *[F.sum(t).alias(t) for t in TARGETS]))
    out = rows
    for key, groups, prefix in (("host_key", hosts, "host"), ("site", paths, "path")):
        named = groups.select(key, F.col("n").alias(f"{prefix}_n"), *[F.col(t).alias(f"{prefix}_{t}") for t in TARGETS], F.col("n").alias("weight"))
        out = join_hot(out, named, key, "weight", known.n, "inner")
    for t in TARGETS:
        mean, a, b = strengths(paths, hosts, t)
        off = F.lit(mean - prior[t])  # soft scores may lie higher or lower than labels on the whole; sites are set right by that
        host = (F.lit(a * prior[t]) + F.col(f"host_{t}") - F.col(f"{t}_own") - off * (F.col("host_n") - 1)) / (F.col("host_n") - 1 + a)
        out = out.withColumn(f"{t}_host", host)
        out = out.withColumn(f"{t}_site", (F.lit(b) * F.col(f"{t}_host") + F.col(f"path_{t}") - F.col(f"{t}_own") - off * (F.col("path_n") - 1)) / (F.col("path_n") - 1 + b))
    return out


def _with_known(evidence: DataFrame, labels: DataFrame, sites: DataFrame) -> DataFrame:
    """evidence with its documents' labels and sites; rows without an id, and ids of very many rows, stay dealt out."""
    copies = evidence.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("copies"))
    known = cut(labels.join(sites, "doc_id", "full").join(copies, "doc_id"))
    named = join_hot(evidence.where(F.col("doc_id").isNotNull()), known, "doc_id", "copies", evidence.count())
    return named.unionByName(evidence.where(F.col("doc_id").isNull()), allowMissingColumns=True)


def judge(docs: DataFrame, labels: DataFrame, pages: DataFrame) -> DataFrame:
    """For each row of docs: doc_id, host, path, p_quality, p_toxic and keep."""
    docs = pick(docs, "doc_id", "text", "source").select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string"))
    labels = pick(labels, "doc_id", *TARGETS).where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.avg(t).alias(t) for t in TARGETS])
    evidence = cut(scored(docs, fit(docs, labels)))
    sites = sites_of(pick(pages, "page_id", "url"))
    rows = _with_known(evidence, labels, sites)
    rows = rows.select("doc_id", F.coalesce("host", "source", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "good", "bad", *TARGETS)
    found = posteriors(rows)
    quality = _sigmoid(_logit(F.col("quality_site")) + F.col("good"))
    toxic = _sigmoid(_logit(F.col("toxic_site")) + F.col("bad"))
    out = found.select("doc_id", "host", "path", "quality_site", "toxic_site", quality.alias("p_quality"), toxic.alias("p_toxic"))
    return out.withColumn("keep", (F.col("p_quality") >= GOOD_FROM) & (F.col("p_toxic") < TOXIC_FROM))


def op1(docs: DataFrame, labels: DataFrame, pages: DataFrame) -> DataFrame:
    return judge(docs, labels, pages)
