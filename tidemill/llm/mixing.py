"""Mixing sources to target weights, with DataFrame functions only.

Each row gets a hash-random key. Within a source the rows are sorted by key in ranges of the key space, the sizes
are summed up along that order by distributed prefix sums (over wide ranges, then over the ranges in the one with the
cut, then inside the range with the cut), and the source is cut at its exact budget; a budget above the source's size
repeats whole epochs first. The row that the cut falls on is taken in part.

Budgets: a source's share of all sizes is its weight's share; no target is above `repeats` times the source's size,
and what is cut off there is shared anew by weight among the others until none is above.

Equal rows have one key. Where the cut falls among them they are counted first and then told apart by number, so that
one much repeated row doesn't fill a task.

Defined cases: texts are taken whole, however long. A null or blank text has size 0 and takes 0. Null is a source of its own, the last. Rows with null or
repeated doc_id, and rows that are equal in all columns, count each by themselves; which of equal rows takes more is
open, the rows of the result as a whole are the same in each run. If all sizes are 0 all targets are 0. An empty
table gives an empty result. Further columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, cut, documents_of, pick

#: Weights by the sources' order, repeating.
WEIGHTS = (1, 2, 3)
REPEATS = 3
#: Rows of a source that one range of keys holds, about.
RANGE_ROWS = 2048
#: Ranges of a wide one, and equal rows that are written out at a time.
WIDE, AT_ONCE = 1024, 10_000
#: Plans of up to so many sources are broadcast: some 100 bytes each.
BROADCAST_SOURCES = 100_000
SEED = 20_240_229
WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    """Number of words; Spark counts them without making an array of them."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), n.cast("int")), "")


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """source, source_size and rows with `place`, the source's place by code point from 0, null last.

    Sources are dealt out by range; a place is its partition's offset and the place in the partition, so no task
    holds all sources. The partitions' offsets come to the driver: a few numbers.
    """
    parts = max(1, int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(sizes.repartitionByRange(parts, F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    counts = {r.part: r.n for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect()}
    offsets, at = [], 0
    for part in sorted(counts):
        offsets.append((part, at))
        at += counts[part]
    if not offsets:
        return dealt.withColumn("place", F.lit(0).cast("long")).drop("part")
    values = ", ".join(f"({part}, {offset}L)" for part, offset in offsets)
    offset = F.broadcast(sizes.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(part, offset)"))
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return dealt.join(offset, "part").withColumn("place", F.col("offset") + F.row_number().over(inside) - 1).drop("part", "offset")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """The sources with weight and target (double). Only sums over sources come to the driver."""
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = cut(ranked_sources(sizes).withColumn("weight", weight))
    most = F.col("source_size") * repeats
    total = ranked.agg(F.sum("source_size").alias("t")).first().t or 0
    level, full = 0.0, -1
    while total:
        above = most <= F.lit(level) * F.col("weight") if full >= 0 else F.lit(False)
        r = ranked.agg(F.sum(F.when(above, most).otherwise(0)).alias("taken"), F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("weights"), F.count_if(above).alias("full")).first()
        if r.full == full or not r.weights:
            break
        full, level = r.full, float(total - r.taken) / float(r.weights)
    return ranked.withColumn("target", F.least(most.cast("double"), F.lit(level) * F.col("weight")) if total else F.lit(0.0))


def _with_plan(left: DataFrame, plan: DataFrame, sources: int, rows: int) -> DataFrame:
    """left with the columns of its source's plan. Up to BROADCAST_SOURCES sources are broadcast; beyond that only
    the large ones are, which are few, and rows of the others are shuffled to them."""
    named = plan.withColumnRenamed("source", "plan_source")
    same = F.col("source").eqNullSafe(F.col("plan_source"))
    if sources <= BROADCAST_SOURCES:
        return left.join(F.broadcast(named), same).drop("plan_source")
    large = F.col("rows") > max(rows // HOT_SHARE, 1000)
    a = left.join(F.broadcast(named.where(large)), same)
    b = left.join(F.broadcast(named.where(large).select("plan_source")), same, "left_anti").join(named.where(~large), same)
    return a.unionByName(b).drop("plan_source")


def _range_of(key: Column, ranges: Column) -> Column:
    """The range of a source's key space, of `ranges` equal ones, in which a key lies."""
    return F.floor(F.shiftrightunsigned(key, 32) * ranges / F.lit(2.0**32))


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    return docs.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "text"))


def _located(sums: DataFrame, column: str) -> DataFrame:
    """place, column and before of the row in which a place's rest lies, along the column; sums: place, the column,
    amount, rest and base, what comes before the first row."""
    order = Window.partitionBy("place").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    rows = sums.withColumn("before", F.col("base") + F.coalesce(F.sum("amount").over(order), F.lit(0)))
    return rows.where("before <= rest AND rest < before + amount").select("place", column, "before")


def _cuts(narrow: DataFrame, weights: tuple[int, ...], repeats: int) -> tuple[DataFrame, int, int]:
    """The plan of each source (place, target, epochs, rest, ranges, and the range of its cut), with the numbers of
    sources and rows; narrow: source, size and key."""
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    budget = F.floor("target")
    plan = cut(
        targets(sizes, weights, repeats)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(0))
        .withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
        .withColumn("ranges", F.ceil(F.col("rows") / RANGE_ROWS))
        .drop("weight")
    )
    counted = plan.agg(F.count("*").alias("sources"), F.sum("rows").alias("rows")).first()
    sources, rows = counted.sources, counted.rows or 0
    dealt = _with_plan(narrow, plan.select("source", "place", "rows", "ranges"), sources, rows)
    sums = cut(dealt.groupBy("place", _range_of(F.col("key"), F.col("ranges")).alias("range")).agg(F.sum("size").alias("amount")))
    wide = F.floor(F.col("range") / WIDE).alias("wide")
    rest = plan.select("place", "rest", F.lit(0).cast("long").alias("base"))
    first = _located(sums.groupBy("place", wide).agg(F.sum("amount").alias("amount")).join(rest, "place"), "wide")
    inside = sums.withColumn("wide", wide).join(first, ["place", "wide"]).withColumnRenamed("before", "base").join(rest.drop("base"), "place")
    cuts = _located(inside.select("place", "range", "amount", "rest", "base"), "range").withColumnRenamed("range", "cut_range")
    return cut(plan.join(cuts, "place", "left")), sources, rows


def _placed(rows: DataFrame, plan: DataFrame, sources: int, n: int) -> tuple[DataFrame, DataFrame]:
    """Rows outside the ranges of the cuts, with `again`, 1 before the cut and 0 after; and rows inside."""
    placed = _with_plan(rows, plan, sources, n).withColumn("range", _range_of(F.col("key"), F.col("ranges")))
    at_cut = F.coalesce(F.col("range") == F.col("cut_range"), F.lit(False))
    outside = placed.where(~at_cut).withColumn("again", F.when(F.col("range") < F.col("cut_range"), 1).otherwise(0))
    return outside, placed.where(at_cut)


def _at_cut(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Equal rows inside the ranges of the cuts as one: `equal`, their number, and `part`, the words taken of them."""
    groups = rows.groupBy(*columns, "size", "key", "place", "epochs", "rest", "before", "source_size", "target").agg(F.count("*").alias("equal"))
    inside = Window.partitionBy("place").orderBy(F.shiftrightunsigned("key", 1), "doc_id", "size", *[c for c in columns if c not in ("doc_id", "source", "text")]).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("equal")).over(inside), F.lit(0))
    return groups.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size") * F.col("equal"), F.col("rest") - start)))


def _numbered(rows: DataFrame, times: str) -> DataFrame:
    """Each row `times` times with n from 0, in steps so that no long array is made."""
    steps = rows.where(F.col(times) > 0).withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / AT_ONCE))))
    return steps.withColumn("n", F.explode(F.sequence(F.col("step") * AT_ONCE, F.least((F.col("step") + 1) * AT_ONCE, F.col(times)) - 1))).drop("step")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """docs without text, with size, source_size, target and taken, the words that the mix takes of the row, repeats
    counted.

    Texts are read once, for sizes and keys. Rows before and after the range that a source's cut lies in need no more
    than the ranges' sums, so only that range's rows, about RANGE_ROWS for each source, are shuffled and sorted.
    """
    columns = [c for c in docs.columns if c != "text"]
    narrow = cut(_keyed(docs.withColumn("size", words_in(F.col("text"))), seed).drop("text"))
    plan, sources, n = _cuts(narrow.select("source", "size", "key"), weights, repeats)
    outside, inside = _placed(narrow, plan, sources, n)
    whole = outside.withColumn("taken", (F.col("epochs") + F.col("again")) * F.col("size"))
    each = _numbered(_at_cut(inside, columns), "equal")
    partly = each.withColumn("taken", F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("part") - F.col("n") * F.col("size"))))
    names = [*columns, "size", "source_size", "target", "taken"]
    return whole.select(*names).unionByName(partly.select(*names))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """The mix itself: each row once for each whole time that it is taken, and once more, cut, if taken in part.

    Words are counted once, for the plan, and then in the ranges of the cuts only.
    """
    docs = documents_of(docs)
    keyed, size = _keyed(docs, seed), words_in(F.col("text"))
    plan, sources, n = _cuts(cut(keyed.select("source", size.alias("size"), "key")), weights, repeats)
    outside, inside = _placed(keyed, plan, sources, n)
    times = F.when(F.col("text").rlike(WORD), F.col("epochs") + F.col("again")).otherwise(0)
    whole = outside.withColumn("times", times.cast("int")).where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    at_cut = _at_cut(inside.withColumn("size", size), docs.columns).where("size > 0")
    at_cut = at_cut.withColumn("full", F.col("epochs") * F.col("equal") + F.floor(F.col("part") / F.col("size"))).withColumn("left", F.col("part") % F.col("size"))
    each = _numbered(at_cut.withColumn("copies", F.col("full") + F.when(F.col("left") > 0, 1).otherwise(0)), "copies")
    short = F.col("n") >= F.col("full")
    each = each.withColumn("text", F.when(short, first_words(F.col("text"), F.col("left"))).otherwise(F.col("text")))
    partly = each.withColumn("n_chars", F.when(short, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return whole.select(*docs.columns).unionByName(partly.select(*docs.columns))


def op8(docs: DataFrame) -> DataFrame:
    docs = pick(docs, "doc_id", "text", "source").select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string"))
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
