"""A Merkle manifest of a dataset: one digest for all rows, and for each row a proof that it is part of it.

A row's leaf is a digest of its fields. The leaves of a source are numbered in order of doc_id, and level by level the
runs of FANOUT neighbours (row number divided by FANOUT) are hashed into parents, until each source has its subroot.
The subroots, in order of source, make the root in the same way. Each level is a table of groups: the parent with its
children in order. Going back from the root, a join of each level with the one above hands the path down: for each
step the digests that stand left and right of the node in its run. Digests travel as 32 bytes and are hashed as
hexadecimal text.

A path has one step for each level, about log3 of a source's rows; joins carry it for parents, of which there are a
third as many, and only the last step writes it out for rows. A run has FANOUT rows at most, so no group grows.

Defined cases: nulls of any column count as `-`. Null is a source of its own, the first, and differs from the empty
one. Rows with null doc_id come first in their source. Rows with the same doc_id follow each other by leaf, and equal
rows each have a leaf and a proof. Texts are taken whole, however long. An empty table gives an empty result. Further
columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, documents_of, running_sum

FANOUT = 3
#: The order of a document's fields in its leaf.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before: binary, after: binary>>"


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def hexed(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: dict[str, Column]) -> Column:
    """The digest of a row, of its columns by name."""
    return digest(F.concat(*[field(columns[name]) for name in FIELDS]))


def tree_of(source: Column) -> Column:
    """A source's name for its tree; null's comes before all others."""
    return F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source))


def numbered(nodes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """nodes (a checkpoint) with idx, the row number from 0 of each key."""
    return cut(running_sum(nodes.withColumn("one", F.lit(1).cast("long")), keys, order, "one", "idx").drop("one"))


def _groups(nodes: DataFrame, fanout: int, *payload: str) -> DataFrame:
    """tree, parent, children in order and hash; lone marks the group of a tree's only node, its root."""
    parent = F.expr(f"idx div {fanout}").alias("parent")
    groups = nodes.groupBy("tree", parent).agg(F.array_sort(F.collect_list(F.struct("idx", "hash", *payload))).alias("children"))
    text = F.array_join(F.transform("children", lambda c: hexed(c["hash"])), "")
    return groups.withColumn("hash", digest(text)).withColumn("lone", (F.col("parent") == 0) & (F.size("children") == 1))


def levels(nodes: DataFrame, fanout: int, *payload: str) -> list[DataFrame]:
    """The groups of each level, from the leaves up; nodes: tree, idx, hash and the leaves' further columns."""
    most = nodes.agg(F.max("idx").alias("m")).first().m
    left, out = 0 if most is None else most + 1, []
    while left:
        out.append(cut(_groups(nodes, fanout, *(payload if not out else ()))))
        nodes = out[-1].where("NOT lone").select("tree", F.col("parent").alias("idx"), "hash")
        left = 0 if left == 1 else -(-left // fanout)
    return out


def roots(groups: list[DataFrame]) -> DataFrame:
    """tree, hash and level of the root of each tree."""
    found = [g.where("lone").select("tree", F.get("children", 0)["hash"].alias("hash"), F.lit(k).alias("level")) for k, g in enumerate(groups)]
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return out


def _joined(hashes: Column) -> Column:
    return F.aggregate(hashes, F.lit(b""), lambda a, h: F.concat(a, h))


def _step(hashes: Column, place: Column) -> Column:
    """The path's step of the child at a place (from 0) of a run."""
    before, after = F.slice(hashes, F.lit(1), place), F.slice(hashes, place + 2, F.size(hashes))
    return F.struct(_joined(before).alias("before"), _joined(after).alias("after"))


def paths(groups: list[DataFrame], tops: DataFrame, fanout: int, *payload: str) -> DataFrame:
    """tree, path, subroot and the leaves' columns; tops: tree, level, path (of the tree's root) and subroot."""
    known = None
    for k in reversed(range(len(groups))):
        level = groups[k].select("tree", "parent", "children", "lone")
        here = level.where("lone").join(tops.where(F.col("level") == k).select("tree", "path", "subroot"), "tree")
        if known is not None:
            above = known.select("tree", F.col("parent").alias("up"), F.transform("children", lambda c: c["hash"]).alias("run"), F.col("lone").alias("top"), "path", "subroot")
            inner = level.where("NOT lone").withColumn("up", F.expr(f"parent div {fanout}")).join(above, ["tree", "up"])
            step = _step(F.col("run"), (F.col("parent") % fanout).cast("int"))
            path = F.when(F.col("top"), F.col("path")).otherwise(F.concat(F.array(step), "path"))
            here = here.unionByName(inner.select("tree", "parent", "children", "lone", path.alias("path"), "subroot"))
        known = here
    run = F.transform("children", lambda c: c["hash"])
    each = known.select("tree", "path", "subroot", "lone", run.alias("run"), F.posexplode("children").alias("place", "child"))
    path = F.when(F.col("lone"), F.col("path")).otherwise(F.concat(F.array(_step(F.col("run"), F.col("place"))), "path"))
    return each.select("tree", path.alias("path"), "subroot", "child.hash", *[f"child.{p}" for p in payload])


def manifest(docs: DataFrame, fanout: int = FANOUT, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, path, subroot and root (binary) of every row.

    tampered is the text with which rows are to be checked later, null where it is the same; their leaf then comes as
    `changed`. The texts are read once.
    """
    docs = documents_of(docs)
    columns = {name: F.col(name) for name in FIELDS}
    other = F.lit(None).cast("string") if tampered is None else tampered
    changed = F.when(F.col("other").isNotNull(), leaf(columns | {"text": F.col("other")}))
    rows = docs.withColumn("other", other).select(tree_of(F.col("source")).alias("tree"), "doc_id", leaf(columns).alias("hash"), changed.alias("changed"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    below = levels(numbered(rows, ["tree"], ["doc_id", "hash", "row"]), fanout, "doc_id", "changed")
    if not below:
        return docs.sparkSession.createDataFrame([], f"doc_id long, leaf binary, changed binary, path {PATH}, subroot binary, root binary")
    subroots = cut(roots(below))
    upper = levels(numbered(subroots.select(F.lit("").alias("all"), F.col("tree").alias("name"), "hash", "level"), ["all"], ["name"]).withColumn("tree", F.lit("")), fanout, "name", "level")
    root = roots(upper).first()
    top = subroots.sparkSession.range(1).select(F.lit("").alias("tree"), F.lit(root.level).alias("level"), F.array().cast(PATH).alias("path"), F.lit(bytes(root.hash)).alias("subroot"))
    named = paths(upper, top, fanout, "name", "level")
    tops = cut(named.select(F.col("name").alias("tree"), "level", "path", F.col("hash").alias("subroot")))
    out = paths(below, tops, fanout, "doc_id", "changed")
    return out.select("doc_id", F.col("hash").alias("leaf"), "changed", "path", "subroot", F.lit(bytes(root.hash)).alias("root"))


def folded(start: Column, path: Column) -> Column:
    """The root, in hexadecimal text, that a leaf (binary) and a path lead to."""
    return F.aggregate(path, hexed(start), lambda a, p: F.sha2(F.concat(hexed(p["before"]), a, hexed(p["after"])).cast("binary"), 256))


def proof(path: Column) -> Column:
    """The digest of all siblings, from the leaf's to the root's."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(hexed(p["before"]), hexed(p["after"]))), "").cast("binary"), 256)


def op11(docs: DataFrame) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    rows = manifest(docs, tampered=F.when(even, F.replace("text", F.lit("\n"), F.lit(""))))
    again = folded(F.coalesce("changed", "leaf"), F.col("path"))
    out = rows.select("doc_id", *[hexed(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], proof(F.col("path")).alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
