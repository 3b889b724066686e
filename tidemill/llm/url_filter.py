"""URL filters by a cascade of Bloom filters.

The keys are hosts. All keys of the corpus are known, so the filters can be made exact for them: level 0 encodes the
listed keys; level 1 those unlisted keys that level 0 wrongly admits; level 2 those listed keys that level 1 wrongly
admits; and so on until a level admits none wrongly. A key's levels, read until one does not hold it, say whether it
is listed. The filters are broadcast, so the corpus is judged in one pass without a join.

A filter has some 10 bits for each listed key. Listed keys are dealt into shards by hash so that one shard's cascade
stays below SHARD_KEYS keys; each shard is broadcast for a pass over its own rows, which keeps what is broadcast
bounded.

Rules go before the method's verdict. A rule is a host and the start of a path: it fits its host and all subdomains
if the url's path starts with the rule's path, and the longest rule wins.

Defined cases: a null url, or one without `://`, has empty host and path. Urls are taken whole, however long. Hosts compare with A-Z lower-cased. Null
and repeated page_ids each keep their rows. Without listed keys nothing is blocked but by rules. An empty table gives
an empty result. Further columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, pick

#: Share of unlisted keys that a level admits wrongly, about.
ERROR = 0.01
#: Listed keys of one shard's cascade, at most about; 10 bits each make some 20 MB.
SHARD_KEYS = 16_000_000
LEVELS = 64

# The rules of the query.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Words by which the query makes its table of listed hosts.
LISTED_WORDS = ("ads", "adult", "bet", "bets", "casino", "pills", "porn", "spam", "viagra", "warez")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^([^?#]*)", 1)
    return ascii_lower(host), path


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; of equally long ones the first by code point."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (rule, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")


def positions(h1: np.ndarray, h2: np.ndarray, bits: int, hashes: int, level: int) -> Iterator[np.ndarray]:
    """For each of a level's hash functions the keys' bits; levels have functions of their own."""
    a, b = h1.view(np.uint64), h2.view(np.uint64)
    for i in range(hashes):
        x = a + np.uint64(level * 16 + i + 1) * (b | np.uint64(1))
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
        yield (x ^ (x >> np.uint64(32))) % np.uint64(bits)


class Level:
    """One Bloom filter."""

    def __init__(self, words: np.ndarray, bits: int, hashes: int, level: int):
        self.words, self.bits, self.hashes, self.level = words, bits, hashes, level

    def admits(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.ones(len(h1), dtype=bool)
        for at in positions(h1, h2, self.bits, self.hashes, self.level):
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def build_level(keys: DataFrame, n: int, level: int) -> Level:
    """A filter of the n keys (h1, h2). Tasks set bits in words of 64; equal words are joined by OR in the shuffle."""
    bits = max(64, math.ceil(n * -math.log(ERROR) / math.log(2) ** 2 / 64) * 64)
    hashes = max(1, round(bits / max(n, 1) * math.log(2)))
    hashes = min(hashes, 16)

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(list(positions(np.array(batch.column("h1")), np.array(batch.column("h2")), bits, hashes, level))).astype(np.int64))
            word, first = np.unique(at >> 6, return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(value.view(np.int64), pa.int64())], ["word", "value"])

    words = np.zeros(bits // 64, dtype=np.uint64)
    rows = keys.select("h1", "h2").mapInArrow(set_bits, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value"))
    table = rows.toArrow()  # bits / 64 rows at most: bounded by SHARD_KEYS
    words[table.column("word").to_numpy()] = table.column("value").to_numpy().view(np.uint64)
    return Level(words, bits, hashes, level)


def admitted(keys: DataFrame, level: Level) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.admits(np.array(batch.column("h1")), np.array(batch.column("h2")))))

    return keys.mapInArrow(run, "h1 long, h2 long")


def cascade(universe: DataFrame) -> list[Level]:
    """Levels for distinct keys h1, h2 with the column listed, exact for all of them."""
    inside = cut(universe.where("listed").select("h1", "h2"))
    outside = universe.where("NOT listed").select("h1", "h2")
    levels: list[Level] = []
    while n := inside.count():
        if len(levels) == LEVELS:
            raise RuntimeError("two keys of the corpus have equal hashes")
        levels.append(build_level(inside, n, len(levels)))
        inside, outside = cut(admitted(outside, levels[-1])), inside
    return levels


def is_listed(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each key's first level that doesn't hold it is an odd one."""
    out = np.zeros(len(h1), dtype=bool)
    open_keys = np.arange(len(h1))
    for k, level in enumerate(levels):
        held = level.admits(h1[open_keys], h2[open_keys])
        out[open_keys[~held]] = k % 2 == 1
        open_keys = open_keys[held]
    out[open_keys] = len(levels) % 2 == 1
    return out


def _universe(hosts: DataFrame, listed: Column | DataFrame) -> DataFrame:
    """h1, h2 and listed of the distinct hosts."""
    if isinstance(listed, Column):
        return hosts.select(*_hashes(F.col("host")), F.coalesce(listed, F.lit(False)).alias("listed"))
    keys = pick(listed, "host").select(ascii_lower(F.col("host").cast("string")).alias("host")).distinct().withColumn("listed", F.lit(True))
    return hosts.join(keys, "host", "left").select(*_hashes(F.col("host")), F.coalesce("listed", F.lit(False)).alias("listed"))


def judge(pages: DataFrame, listed: Column | DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """page_id, host, path, rule, verdict and is_listed for rows of page_id and url.

    listed: a table of hosts, in a column of that name (nulls list nothing, repeats count once), or whether a host is on
    the list, as a column over `host`. It meets the distinct hosts of the corpus once, to fill the filters.
    """
    pages = pick(pages, "page_id", "url").select(F.col("page_id").cast("long"), F.col("url").cast("string"))
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    universe = cut(_universe(split.select("host").distinct(), listed))
    n = universe.where("listed").count()
    shards = max(1, math.ceil(n / shard_keys))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    keyed = split.select("*", *_hashes(F.col("host")), rule.alias("rule"), verdict.alias("by_rule"))
    schema = "page_id long, host string, path string, rule string, verdict string, is_listed boolean"
    shard = F.pmod(F.xxhash64(F.lit("shard"), "h1"), F.lit(shards))

    def passes(k: int) -> DataFrame:
        shared = pages.sparkSession.sparkContext.broadcast(cascade(universe.where(shard == k) if shards > 1 else universe))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                there = is_listed(shared.value, np.array(batch.column("h1")), np.array(batch.column("h2")))
                own = np.where(there, "block", "allow")
                verdicts = [r if r is not None else v for r, v in zip(batch.column("by_rule").to_pylist(), own.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("page_id", "host", "path", "rule")], pa.array(verdicts, pa.string()), pa.array(there)], ["page_id", "host", "path", "rule", "verdict", "is_listed"])

        rows = keyed.where(shard == k) if shards > 1 else keyed
        return rows.mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, [passes(k) for k in range(shards)])


def by_words(words: tuple[str, ...] = LISTED_WORDS) -> Column:
    """Lists the hosts that have one of the words between dots or hyphens."""
    return F.arrays_overlap(F.split("host", "[.-]"), F.array(*[F.lit(w) for w in words]))


def hosts_with(pages: DataFrame, words: tuple[str, ...] = LISTED_WORDS) -> DataFrame:
    """A table of the pages' hosts that have one of the words."""
    hosts = pick(pages, "url").select(host_and_path(F.col("url").cast("string"))[0].alias("host"))
    return hosts.where(by_words(words)).distinct()


def op3(pages: DataFrame) -> DataFrame:
    return judge(pages, hosts_with(pages))
