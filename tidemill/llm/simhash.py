"""SimHash near-duplicates: fingerprints, links by a generalised pigeonhole, and components.

Links. A fingerprint's 64 bits are dealt into parts of correlated bits. With thresholds t_i (-1: the part is not
probed) whose sum of (t_i + 1) is above the distance sought, two linked fingerprints differ by at most t_i bits in
some part i. A dynamic programme picks the t_i that make the fewest estimated candidates; each fingerprint probes
part i with all values within t_i bits, and each candidate is verified on all bits.
A value of a part that many fingerprints share is split further, again by pigeonhole, on the bits that are left; what
is still crowded then is salted, so that no task holds such a group and no link is dropped.
Components of verified texts: a node is a fingerprint with one set of shingles, so texts that share a fingerprint but
not their shingles stay apart. First each node is compared with its neighbours in four sorted orders of the
fingerprints (the bits rotated), which joins large groups of near copies by a number of pairs in proportion to their
size. Then all pairs of nodes within the distance are verified that are still in different components, as others
change nothing; the largest component is searched but doesn't probe. So a group of near copies doesn't make its square
of pairs, and the components are those of all links.

Defined cases: a null or blank text has fingerprint 0 and links like any other. A text with fewer words than a
shingle is one shingle. Repeated rows each get their row. A null doc_id gets a row; it is the smallest id of its
component only if the component has no other. Texts are taken whole, however long, in batches
bounded by bytes. Ties have no part: a component is a set, and its id the smallest. An empty table gives an empty result. Further columns are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, documents_of, freed_shuffles, join_hot, pick, slices, utf8

BITS = 64
#: Rows of distinct fingerprints from which the bits' correlations are measured.
STATISTICS_ROWS = 20_000
#: Values of a part that more fingerprints than this share are split further.
SPLIT_OVER = 4096
#: Splitting multiplies a crowded value's rows by no more than this; beyond it they are salted.
SPLIT_ROWS = 9
#: Salts of a crowded value, at most.
SALTS = 64
#: What a probe costs, in candidates: it is shuffled with its row's sketch (5.5 microseconds, a candidate 0.1).
PROBE_COST = 50.0
#: Documents whose ids are broadcast when their texts are compared: 16 bytes each.
BROADCAST_IDS = 1_000_000
#: Texts of a fingerprint, each with shingles of its own, above which not all of its pairs are compared but those that
#: share a rare shingle.
CROWDED = 1024
#: Bits of a set's sketch.
SKETCH = 512
#: Places up to which neighbours in sorted order are compared.
PLACES = 12
#: Bytes of shingles up to which the sets of compared texts are broadcast.
BROADCAST_BYTES = 16_000_000
#: Edges above which hubs of the components are joined apart; fewer edges fit in a task even if all are of one hub.
HUB_EDGES = 1_000_000
#: A group whose fingerprints can differ in no more bits than this isn't split.
FREE_BITS = 9
#: Probes of a fingerprint, of all parts together. Each is a shuffled row, so this bounds the disk for any number of
#: rows; thresholds with fewer probes make more candidates and find the same links.
PROBES = 64
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint_of(text: bytes, words: int, distinct: bool = False) -> int:
    """SimHash of the shingles of a UTF-8 text, as a signed 64-bit integer; repeats count once if distinct."""
    found = _WORD.findall(text.lower())  # bytes.lower() touches A-Z only
    if not found:
        return 0
    digest = xxhash.xxh64_intdigest
    if words == 1 and distinct:
        hashes = [digest(w, 42) for w in set(found)]
    elif len(found) <= words:
        hashes = [digest(b" ".join(found), 42)]
    else:
        whole = b" ".join(found)
        ends = np.cumsum([len(w) + 1 for w in found]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(found) - words + 1].tolist()
        hashes = [digest(whole[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]
    values = np.array(hashes, dtype=np.uint64)
    return int(majority(np.unique(values) if distinct else values))


def majority(hashes: np.ndarray) -> np.int64:
    """Each bit that over half of the hashes have."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0]


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = [fingerprint_of(t, words) for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    source = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, "doc_id long, fp long")


def row_prints(docs: DataFrame, words: int, distinct: bool, similar_words: int | None) -> DataFrame:
    """doc_id, row (a hash of the text), fp, node, size and sketch for every row.

    A node is a fingerprint with one set of shingles of similar_words words, size their number and sketch the SKETCH
    slots that they hash to; without these, a node is a fingerprint.
    """

    def node_of(fp: int, text: bytes) -> tuple[int, int, list[int]]:
        if similar_words is None:
            return fp, 0, []
        shingles = shingles_of(text, similar_words)
        n = xxhash.xxh64_intdigest(shingles.tobytes(), fp & (1 << BITS) - 1)
        held = np.zeros(SKETCH, dtype=bool)
        held[shingles & SKETCH - 1] = True
        return n - (1 << BITS) if n >> BITS - 1 else n, len(shingles), np.packbits(held, bitorder="little").view(np.int64).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = utf8(batch.column("text"))
            fp = [fingerprint_of(t, words, distinct) for t in found]
            node = [node_of(f, t) for f, t in zip(fp, found, strict=True)]
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()))
            columns = [batch.column("doc_id"), batch.column("row"), pa.array(fp, pa.int64()), *[pa.array([n[i] for n in node], t) for i, t in enumerate(kinds)]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "fp", "node", "size", "sketch"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("row")).mapInArrow(run, "doc_id long, row long, fp long, node long, size int, sketch array<long>")


def correlated_parts(sample: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in `parts` groups of nearly equal size, each grown from a free bit by the largest correlations."""
    bits = (sample[:, None].view(np.uint64) >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)
    moving = bits.astype(np.float64) - bits.mean(axis=0) if len(sample) else np.zeros((1, BITS))
    norm = np.sqrt((moving**2).sum(axis=0))
    related = np.abs(moving.T @ moving) / np.maximum(np.outer(norm, norm), 1e-12)
    free, out = set(range(BITS)), []
    for k in range(parts):
        size = (BITS - sum(map(len, out))) // (parts - k)
        group = [min(free)]
        free.discard(group[0])
        while len(group) < size:
            best = max(sorted(free), key=lambda b: related[b, group].mean())
            group.append(best)
            free.discard(best)
        out.append(sorted(group))
    return out


def _key(values: np.ndarray, part: list[int]) -> np.ndarray:
    out = np.zeros(len(values), dtype=np.uint64)
    for i, b in enumerate(part):
        out |= ((values >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return out


def ball(bits: int, within: int) -> int:
    """Values within so many bits of one."""
    return sum(comb(bits, i) for i in range(within + 1))


def estimate(sample: np.ndarray, part: list[int], total: int, most: int) -> list[float]:
    """Estimated candidates plus probes when a part is probed with threshold -1, 0, ... most.

    Pairs of the sample within e bits in the part, scaled to all pairs; a probe is a shuffled row and costs as much as
    PROBE_COST candidates, which are compared where they meet.
    """
    cost = [0.0]
    keys = _key(sample.view(np.uint64), part)[:2000]
    pairs = max(len(keys) * (len(keys) - 1) / 2, 1)
    near = np.zeros(BITS + 1)
    for at in range(0, len(keys), 500):
        distance = np.bitwise_count(keys[at : at + 500, None] ^ keys[None, :])
        near += np.bincount(distance[np.arange(len(distance))[:, None] + at < np.arange(len(keys))[None, :]].ravel(), minlength=BITS + 1)
    for e in range(most + 1):
        share = max(near[: e + 1].sum() / pairs, ball(len(part), e) / 2.0 ** len(part))
        cost.append(share * total * total / 2 + float(total) * ball(len(part), e) * PROBE_COST)
    return cost


def allocate(costs: list[list[float]], sizes: list[int], distance: int) -> tuple[float, list[int]]:
    """Thresholds of least total cost whose (t + 1) sum to distance + 1, with PROBES probes at most; costs[i][t + 1] is
    the cost of part i, which has sizes[i] bits. An infinite cost if there are none."""
    best: dict[tuple[int, int], tuple[float, list[int]]] = {(0, 0): (0.0, [])}
    for row, size in zip(costs, sizes, strict=True):
        step: dict[tuple[int, int], tuple[float, list[int]]] = {}
        for (used, probes), (cost, chosen) in best.items():
            for slot, more in enumerate(row):
                at = used + slot, probes + ball(size, slot - 1)
                if at[0] <= distance + 1 and at[1] <= PROBES and (at not in step or cost + more < step[at][0]):
                    step[at] = (cost + more, [*chosen, slot - 1])
        best = step
    return min((found for (used, _), found in best.items() if used == distance + 1), default=(float("inf"), []))


def plan(sample: np.ndarray, total: int, distance: int) -> tuple[list[list[int]], list[int]]:
    """The parts and thresholds with the least estimated cost, over numbers of parts up to distance + 2."""
    options = []
    for count in range(1, distance + 3):
        parts = correlated_parts(sample, count)
        cost, thresholds = allocate([estimate(sample, p, total, min(distance, 3)) for p in parts], [len(p) for p in parts], distance)
        options.append((cost, count, parts, thresholds))
    if min(o[0] for o in options) == float("inf"):
        raise ValueError(f"no thresholds within {PROBES} probes for a distance of {distance}")
    _, _, parts, thresholds = min(options, key=lambda o: o[:2])
    return parts, thresholds


def _mask(bits: list[int]) -> int:
    """The bits as a signed long."""
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def _choices(part: list[int], within: int) -> list[int]:
    return [_mask(list(chosen)) for n in range(within + 1) for chosen in combinations(part, n)]


def _longs(values: list[int]) -> Column:
    return F.expr(f"cast(split('{','.join(map(str, values))}', ',') as array<bigint>)")


def _apart(mask: int | None = None) -> Column:
    """Bits in which a joined pair differs, of all or of a part's."""
    bits = F.col("fp").bitwiseXOR(F.col("p_fp"))
    return F.bit_count(bits if mask is None else bits.bitwiseAND(F.lit(mask).cast("long")))


def _unseen(earlier: list[tuple[int, int]]) -> Column:
    """Whether a pair differs in more than t bits of each earlier part (mask, t)."""
    return reduce(lambda x, y: x & y, [_apart(mask) > t for mask, t in earlier], F.lit(True))


def close_pairs(rows: DataFrame, key: str, wanted: Column, distance: int, largest: int | None = None, split_over: int = SPLIT_OVER) -> DataFrame:
    """All wanted pairs of rows whose column fp differs in at most `distance` bits, each once.

    `wanted` may use one row's columns under their names and the other's as p_...; a pair is `key`, which names a row, and
    p_key. Rows of the root `largest` are searched but don't probe.
    """
    columns = rows.columns
    once = F.col(key) < F.col(f"p_{key}")  # a pair meets from both sides, unless one side doesn't probe
    wanted = (_apart() <= distance) & wanted & (once if largest is None else once | (F.col("root") == largest))
    total = rows.count()
    taken = rows.select("fp").orderBy(F.xxhash64("fp")).limit(STATISTICS_ROWS).collect()  # bounded, for correlations and costs
    parts, thresholds = plan(np.array([r.fp for r in taken], dtype=np.int64), total, distance)
    probed = [(p, t) for p, t in zip(parts, thresholds, strict=True) if t >= 0]
    steps = [(_mask(p), flip) for p, t in probed for flip in _choices(p, t)]
    value = F.col("fp").bitwiseAND(F.col("slot"))
    index = rows.select("*", F.explode(_longs([_mask(p) for p, _ in probed])).alias("slot")).select(*columns, "slot", value.alias("value"))
    probes = rows if largest is None else rows.where(F.col("root") != largest)
    probes = probes.select("*", F.explode(F.arrays_zip(_longs([m for m, _ in steps]).alias("slot"), _longs([f for _, f in steps]).alias("flip"))).alias("s")).select(*columns, "s.slot", "s.flip")
    probes = probes.select(*[F.col(c).alias(f"p_{c}") for c in columns], "slot", value.bitwiseXOR(F.col("flip")).alias("value"))
    first = F.lit(False)
    for k, (p, _) in enumerate(probed):
        first = F.when(F.col("slot") == _mask(p), _unseen([(_mask(q), t) for q, t in probed[:k]])).otherwise(first)
    found, fixed, grown = [], {_mask(p): p for p, _ in probed}, 1
    at = ["slot", "value"]
    while True:
        closed = [m for m, have in fixed.items() if BITS - len(have) <= FREE_BITS]
        sizes = cut(index.groupBy(*at).agg(F.count("*").alias("n")).where(F.col("n") > split_over))
        crowded = F.broadcast(cut(probes.select(*at).join(F.broadcast(sizes), at).distinct()))  # a row for split_over rows of the index at most
        slots = [r.slot for r in crowded.select("slot").distinct().collect()]  # at most as many as masks
        met = index.join(probes, at) if not slots else index.join(crowded, at, "left_anti").join(probes.join(crowded, at, "left_anti"), at)
        found.append(met.where(wanted & first if grown == 1 else wanted).select(key, f"p_{key}"))
        if not slots:
            break
        if grown * (distance + 1) > SPLIT_ROWS or set(slots) & set(closed):
            salts = crowded.withColumn("salts", F.least(F.ceil(F.col("n") / split_over), F.lit(SALTS)).cast("int")).drop("n")
            here = index.join(F.broadcast(salts), at).withColumn("salt", F.pmod(F.xxhash64(key), F.col("salts")).cast("int"))
            there = probes.join(F.broadcast(salts), at).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
            met = here.drop("salts").join(there.drop("salts"), [*at, "salt"])
            found.append(met.where(wanted & first if grown == 1 else wanted).select(key, f"p_{key}"))
            break
        finer: dict[int, list[int]] = {}
        for m in slots:
            free = [b for b in range(BITS) if b not in set(fixed[m])]
            finer[m] = [_mask(free[k :: distance + 1]) for k in range(distance + 1)]
        named = [(m, m | more, more) for m, out in finer.items() for more in out]
        fixed = {f: [b for b in range(BITS) if f >> b & 1] for _, f, _ in named}
        steps_to = F.broadcast(rows.sparkSession.createDataFrame(named, "slot long, finer long, more long"))

        def refine(level: DataFrame, names: list[str], fp: str, crowded: DataFrame = crowded, steps_to: DataFrame = steps_to) -> DataFrame:
            dense = level.join(crowded, at, "left_semi").join(steps_to, "slot")
            return cut(dense.select(*names, F.col("finer").alias("slot"), F.col("value").bitwiseOR(F.col(fp).bitwiseAND(F.col("more"))).alias("value")).distinct())

        index, probes = refine(index, columns, "fp"), refine(probes, [f"p_{c}" for c in columns], "p_fp")
        grown *= distance + 1
    out = reduce(DataFrame.unionByName, found)
    return out.distinct() if len(found) > 1 else out  # values that are split may find a pair again


def links(distinct: DataFrame, distance: int = 2, split_over: int = SPLIT_OVER, beyond: int = 0, largest: int | None = None) -> DataFrame:
    """All pairs a < b of the column fp's distinct values that differ in over `beyond` to `distance` bits, each once.

    With a column root, the component so far, only pairs of different roots; `largest` is the root with most members.
    """
    rooted = "root" in distinct.columns
    wanted = _apart() > beyond
    if rooted:
        wanted &= F.col("root") != F.col("p_root")
    met = close_pairs(distinct.select("fp", "root") if rooted else distinct.select("fp"), "fp", wanted, distance, largest, split_over)
    return met.select(F.least("fp", "p_fp").alias("a"), F.greatest("fp", "p_fp").alias("b"))


def neighbours(nodes: DataFrame, distance: int, similarity: float) -> DataFrame:
    """Pairs a < b of nodes next to each other (by up to PLACES) where the fingerprints are sorted, and within the
    distance and of sketches that can be similar; in four orders that begin with different bits."""
    turned = [F.shiftleft("fp", r).bitwiseOR(F.shiftrightunsigned("fp", BITS - r)) if r else F.col("fp") for r in (0, 16, 32, 48)]
    orders = F.explode(F.array(*[F.struct(F.lit(k).alias("slot"), t.alias("turned")) for k, t in enumerate(turned)])).alias("o")
    rows = nodes.select("node", "fp", "size", "sketch", orders).select("node", "fp", "size", "sketch", "o.*")
    order = ["slot", "turned", "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[np.ndarray] | None = None
        for batch in batches:
            now = [np.asarray(batch.column(c)) for c in ("slot", "node", "fp", "size")]
            now.append(np.asarray(batch.column("sketch").flatten()).view(np.uint64).reshape(batch.num_rows, -1))
            if last is not None:
                now = [np.concatenate((x[-PLACES:], y)) for x, y in zip(last, now, strict=True)]
            slot, node, fp, size, sketch = now
            pairs = []
            for gap in range(1, min(PLACES, len(fp) - 1) + 1):
                near = (slot[gap:] == slot[:-gap]) & (np.bitwise_count((fp[gap:] ^ fp[:-gap]).view(np.uint64)) <= distance)
                missing = [np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64) for x, y in ((sketch[gap:], sketch[:-gap]), (sketch[:-gap], sketch[gap:]))]
                shared = np.minimum(size[gap:] - missing[0], size[:-gap] - missing[1])
                near &= shared >= similarity * (size[gap:] + size[:-gap].astype(np.int64) - shared) - 1e-9
                pairs.append(np.stack((np.minimum(node[gap:], node[:-gap])[near], np.maximum(node[gap:], node[:-gap])[near])))
            a, b = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            last = now

    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (its component's smallest node) of the graph with the edges a < b.

    Alternating large-star and small-star steps: only minima are gathered for a node, never its neighbours.
    """
    pairs = cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).distinct())

    def around(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def joined(left: DataFrame, right: DataFrame, key: str, edges: int) -> DataFrame:
        return join_hot(left, right, key, "degree", edges, "inner") if edges > HUB_EDGES else left.join(right, key)

    seen = mark(pairs)
    while seen[0]:
        both = around(pairs)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("degree"))
        large = joined(both.where(F.col("v") > F.col("u")), least, "u", 2 * seen[0]).select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("degree"))
        small = joined(large, least, "b", seen[0]).select(F.explode(F.array(F.struct(F.col("m").alias("x"), F.col("a").alias("y")), F.struct(F.col("m").alias("x"), F.col("b").alias("y")))).alias("e")).select(F.col("e.x").alias("a"), F.col("e.y").alias("b")).where("a < b")
        pairs = cut(small.distinct())
        now = mark(pairs)
        if now == seen:
            break
        seen = now
    return pairs.select(F.col("b").alias("node"), F.col("a").alias("root"))


def shingles_of(text: bytes, words: int) -> np.ndarray:
    """Distinct hashes of a text's shingles, sorted; the whole text if it has fewer words."""
    found = _WORD.findall(text.lower())
    parts = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    return np.unique(np.array([xxhash.xxh32_intdigest(p) for p in parts], dtype=np.uint32)).view(np.int32)


def shingle_sets(asked: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """node and its text's distinct shingles.

    asked: node, doc_id and row. Only their texts are looked at; the keys are broadcast up to BROADCAST_IDS, else
    joined by a shuffle.
    """
    asked = cut(asked.select("node", F.col("doc_id").alias("own_id"), F.col("row").alias("own_row")))
    few = asked.count() <= BROADCAST_IDS
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("row")).join(F.broadcast(asked) if few else asked, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("row") == F.col("own_row"))).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles_of(t, words) for t in utf8(batch.column("text"))]
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists], ["node", "shingles"])

    return cut(rows.mapInArrow(run, "node long, shingles array<int>").groupBy("node").agg(F.min("shingles").alias("shingles")))


def similar(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, similarity: float, words: int) -> DataFrame:
    """The pairs of nodes whose texts share so large a part of their distinct shingles (Jaccard)."""
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = shingle_sets(asked.join(nodes, "node"), docs, words)
    small = 4 * (sets.agg(F.sum(F.size("shingles"))).first()[0] or 0) <= BROADCAST_BYTES
    x, y = (sets.select(F.col("node").alias(n), F.col("shingles").alias(c)) for n, c in (("a", "x"), ("b", "y")))
    both = pairs.join(F.broadcast(x) if small else x, "a").join(F.broadcast(y) if small else y, "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= F.lit(similarity) * (F.size("x") + F.size("y") - shared)).select("a", "b")


def _crowded_pairs(rooted: DataFrame, crowds: DataFrame, docs: DataFrame, distance: int, similarity: float, words: int) -> DataFrame:
    """Pairs of nodes of different components of which one has a crowded fingerprint, within the distance, that share
    one of their rarest shingles: of two similar sets of n and m shingles, the n - similarity * n + 1 rarest of one
    meet the rarest of the other."""
    prints = rooted.groupBy("fp").agg(F.min("root").alias("low"), F.max("root").alias("high")).join(crowds.withColumn("crowd", F.lit(True)), "fp", "left")
    met = close_pairs(cut(prints), "fp", F.coalesce("crowd", "p_crowd"), distance)
    asked = crowds.unionByName(met.select(F.explode(F.array("fp", "p_fp")).alias("fp"))).distinct()
    here = cut(rooted.join(asked, "fp", "left_semi").join(crowds.withColumn("crowd", F.lit(True)), "fp", "left"))
    each = shingle_sets(here, docs, words).select("node", F.explode("shingles").alias("shingle"))
    rarity = each.groupBy("shingle").agg(F.count("*").alias("n"))
    each = join_hot(each, rarity.withColumn("weight", F.col("n")), "shingle", "weight", each.count(), "inner").join(here, "node")
    least = (F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1).cast("int")
    rarest = each.groupBy("node", "fp", "root", "size", "sketch", "crowd").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("s"))
    keyed = cut(rarest.withColumn("s", F.explode(F.slice("s", F.lit(1), least))).where("s.n > 1").withColumn("shingle", F.col("s.shingle")).drop("s"))
    other = keyed.select("shingle", *[F.col(c).alias(f"p_{c}") for c in ("node", "fp", "root", "size", "sketch", "crowd")])
    wanted = (F.col("node") < F.col("p_node")) & F.coalesce("crowd", "p_crowd") & (_apart() <= distance) & _may_be(similarity)
    return keyed.join(other, "shingle").where(wanted).select(F.col("node").alias("a"), F.col("p_node").alias("b")).distinct()


def _may_be(similarity: float) -> Column:
    """Whether a pair is in different components and can be similar, by sizes and sketches: slots that only one set
    holds are as many shingles, at least, that the other doesn't have. No similar pair is lost. Written short:
    with a term for each of a sketch's words, a candidate takes many times as long."""

    def missing(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseAND(F.bitwise_not(b)))), F.lit(0), lambda n, more: n + more)

    total = F.col("size") + F.col("p_size")
    least = F.ceil(total * (similarity / (1 + similarity)) - 1e-9)  # shared shingles of a similar pair
    kept = F.least(F.col("size") - missing("sketch", "p_sketch"), F.col("p_size") - missing("p_sketch", "sketch"))
    return (F.col("root") != F.col("p_root")) & (F.least("size", "p_size") >= least) & (kept >= least)


def verified_components(nodes: DataFrame, docs: DataFrame, distance: int, similarity: float, words: int) -> DataFrame:
    """node and root of the graph whose links are pairs of nodes within `distance` bits and with the similarity.

    nodes: node, fp, size, sketch, doc_id and row. Neighbours in sorted order are joined first, then all that is still apart.
    """
    roots = components(similar(cut(neighbours(nodes, distance, similarity)), docs, nodes, similarity, words))
    rooted = cut(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    top = roots.groupBy("root").count().orderBy(F.desc("count"), "root").first()
    crowds = cut(nodes.groupBy("fp").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).select("fp"))
    narrow, crowded = rooted.select("fp", "node", "root", "size", "sketch"), crowds.limit(1).count() > 0
    few = narrow.join(crowds, "fp", "left_anti") if crowded else narrow
    met = close_pairs(few, "node", _may_be(similarity), distance, top and top.root)
    pairs = met.select(F.least("node", "p_node").alias("a"), F.greatest("node", "p_node").alias("b"))
    if crowded:
        pairs = pairs.unionByName(_crowded_pairs(rooted, crowds, docs, distance, similarity, words))
    edges = similar(cut(pairs), docs, nodes, similarity, words)
    return components(edges.unionByName(roots.select(F.col("root").alias("a"), F.col("node").alias("b"))))


def _rows(docs: DataFrame, words: int, distance: int, similarity: float | None, similar_words: int, distinct: bool) -> DataFrame:
    """doc_id, row (with doc_id a row's key), fp, root and component_id for every row of docs."""
    texts = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    with freed_shuffles(docs.sparkSession):
        prints = cut(row_prints(texts, words, distinct, similar_words if similarity is not None else None))
        first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row", "sketch"))
        nodes = cut(prints.groupBy("node", "fp", "size").agg(first.alias("first"), F.count("*").alias("copies")).select("node", "fp", "size", "copies", "first.doc_id", "first.row", "first.sketch"))
        total = nodes.agg(F.sum("copies")).first()[0] or 0
        if similarity is None:
            roots = components(links(nodes, distance))
        else:
            roots = verified_components(nodes.drop("copies"), texts, distance, similarity, similar_words)
        rooted = nodes.join(roots, "node", "left").select("node", "copies", "doc_id", F.coalesce("root", "node").alias("root"))
        groups = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
        classes = cut(join_hot(rooted, groups, "root", "n", total, "inner").select("node", "root", "component_id", "copies"))
    return join_hot(prints, classes, "node", "copies", total)


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2, similarity: float | None = None, similar_words: int = 5, distinct: bool = False) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links reach, for every row of docs.

    With a similarity, links also need that Jaccard similarity of shingles of similar_words words, within a
    fingerprint too. With distinct, repeats of a shingle count once in the fingerprint.
    """
    if similarity is not None:
        return _rows(docs, words, distance, similarity, similar_words, distinct).select("doc_id", "fp", "component_id")
    with freed_shuffles(docs.sparkSession):
        prints = cut(fingerprints(docs, words))
        distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")))
        total = distinct.agg(F.sum("copies")).first()[0] or 0
        roots = components(links(distinct, distance))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "copies", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = rooted.join(smallest, "root").select("fp", "component_id", "copies")
    return join_hot(prints, classes, "fp", "copies", total)


def keep_one(docs: DataFrame, words: int = 3, distance: int = 2, similarity: float | None = None, distinct: bool = False) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row with the smallest doc_id stays.

    Of repeated rows with that id in the component the first by text stays; a component without ids keeps one row, also
    the first by text. The kept rows' keys are broadcast up to BROADCAST_IDS, else the rows are shuffled once.
    """
    docs = documents_of(docs)
    with freed_shuffles(docs.sparkSession):
        found = _rows(docs, words, distance, similarity, 5, distinct)
        first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        kept = cut(first.groupBy("root", F.col("doc_id").alias("own_id"), F.col("row").alias("own_row")).agg(F.count("*").alias("rows")))
        several = cut(kept.groupBy("root").agg(F.sum("rows").alias("n")).where("n > 1").select("root"))
    own = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.xxhash64("text") == F.col("own_row"))
    repeats = several.limit(1).count() > 0
    lone = (kept.join(several, "root", "left_anti") if repeats else kept).select("own_id", "own_row")
    single = docs.join(F.broadcast(lone) if kept.count() <= BROADCAST_IDS else lone, own, "left_semi")
    if not repeats:
        return single
    repeated = docs.join(kept.join(several, "root", "left_semi").drop("rows"), own)
    once = repeated.groupBy("root", "doc_id").agg(F.min(F.struct(*[c for c in docs.columns if c != "doc_id"])).alias("row"))
    return single.unionByName(once.select("doc_id", "row.*"))


def op10(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
