"""The training-data operators as registered queries: each takes (spark, sf_dir) and applies to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, exact_search, language_id, licenses, manifest, mixing, packing, periodic, pii, quality, simhash, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op1(*[table(spark, sf_dir, name) for name in ("documents", "labels", "pages")])


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op2(table(spark, sf_dir, "documents"))


def op3_url_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.op3(table(spark, sf_dir, "pages"))


def op4_language_rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.op4(table(spark, sf_dir, "documents"))


def op5_license_rare_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op5(table(spark, sf_dir, "documents"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.op6(table(spark, sf_dir, "embeddings"))


def op7_bpe_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op7(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op8(table(spark, sf_dir, "documents"))


def op9_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.op9(table(spark, sf_dir, "embeddings"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op10(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.op11(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.op12(table(spark, sf_dir, "documents"))


def op13_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op13(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_quality_hierarchical,
        op2_pii_surrogates,
        op3_url_bloom_cascade,
        op4_language_rank_order,
        op5_license_rare_tokens,
        op6_exact_top_k,
        op7_bpe_backtracking,
        op8_source_mixing,
        op9_ivf_pq,
        op10_simhash_near_dedup,
        op11_merkle_manifest,
        op12_periodic_runs,
        op13_mixture_packing,
    )
}


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || {value} END"


def _leaf(text: str) -> str:
    return "sha256(concat(" + ", ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + "))"


def _tree(name: str, nodes: str) -> str:
    """Levels of a Merkle tree for each key of nodes: key, idx, h and n, the number of its nodes."""
    return f"""{name} AS (SELECT 0 AS level, * FROM {nodes}
  UNION ALL SELECT level + 1, key, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY level, key, idx // 3, n)"""


def _steps(name: str, leaves: str) -> str:
    """level, and what stands before and after a leaf's node in its run, of each level."""
    at = "(d.idx // CAST(pow(3, t.level) AS BIGINT))"
    return f"""SELECT d.key, d.idx, t.level, coalesce(string_agg(t.h, '' ORDER BY t.idx) FILTER (t.idx < {at}), '') AS b, coalesce(string_agg(t.h, '' ORDER BY t.idx) FILTER (t.idx > {at}), '') AS a
  FROM {leaves} d JOIN {name} t ON t.key = d.key AND t.n > 1 AND t.idx // 3 = {at} // 3 GROUP BY d.key, d.idx, t.level"""


_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
  lambda c, x: list_reduce(list_prepend(xor(c, x), list_transform(range(8), lambda y: y::BIGINT)), lambda v, y: xor(v >> 1, 3988292384 * (v & 1)))))"""

_LISTED = ", ".join(f"'{w}'" for w in url_filter.LISTED_WORDS)

#: DuckDB SQL for the queries that SQL can express on whole tables; tests hold the others against brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_url_bloom_cascade": f"""
WITH s AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^([^/?#]*)', 1) AS h FROM s),
p AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^([^?#]*)', 1) AS path FROM h),
r AS (SELECT *, len(list_intersect(regexp_split_to_array(host, '[.-]'), [{_LISTED}])) > 0 AS is_listed,
  CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM p)
SELECT page_id, host, path, rule, is_listed, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL OR is_listed THEN 'block' ELSE 'allow' END AS verdict FROM r""",
    "op6_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op11_merkle_manifest": f"""
WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS key, {_leaf("text")} AS h,
  CASE WHEN {_CRC32} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS again FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY key) AS n FROM d),
ln AS (SELECT key, idx, h, n FROM l), {_tree("t", "ln")},
s AS (SELECT key AS name, 'all' AS key, row_number() OVER (ORDER BY key) - 1 AS idx, h, count(*) OVER () AS n FROM t WHERE n = 1),
sn AS (SELECT key, idx, h, n FROM s), {_tree("u", "sn")},
p AS (SELECT * FROM ({_steps("t", "l")}) UNION ALL SELECT l.key, l.idx, 1000 + w.level, w.b, w.a FROM l JOIN s ON s.name = l.key JOIN ({_steps("u", "s")}) w ON w.idx = s.idx),
f AS (SELECT key, idx, string_agg(b || a, '' ORDER BY level) AS proof, list(b || '|' || a ORDER BY level) AS steps FROM p GROUP BY key, idx),
r AS (SELECT doc_id, l.h AS leaf, s.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
  list_reduce(list_prepend(again, coalesce(steps, [])), lambda x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2))) AS folded_root
  FROM l JOIN s ON s.name = l.key LEFT JOIN f ON f.key = l.key AND f.idx = l.idx)
SELECT *, folded_root = root AS verified FROM r""",
}
