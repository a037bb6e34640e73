"""Registered queries of the operators, and their oracles where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limitloom.llm import archives, compressors, edits, jaccard, languages, linehash, merkle, packing, pivots, suffixes, surrogates, templates, whitening
from limitloom.llm.frames import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = archives.round_trip(read_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op1_arc_to_warc"] = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, payload_bytes, max(page_id) AS m FROM p WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < m THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < m THEN m END AS refers_to
FROM p LEFT JOIN g USING (payload_digest, payload_bytes)
"""


# The key of the registered query; a run of its own takes one from its secret store.
SURROGATE_KEY = "registered-query"


@_query
def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace(read_table(spark, sf_dir, "documents"), SURROGATE_KEY, count="n_replaced")


@_query
def op3_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressors.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@_query
def op4_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_classes(read_table(spark, sf_dir, "documents"), k=4, percent=85)


@_query
def op5_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


@_query
def op7_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLES["op7_pivot_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""


@_query
def op9_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return languages.identify(docs, languages.train(docs), languages.page_evidence(read_table(spark, sf_dir, "pages")))


@_query
def op10_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.apply_edits(edits.stored_trees(read_table(spark, sf_dir, "documents"), edits.sample_edits()))


@_query
def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(read_table(spark, sf_dir, "documents"))


@_query
def op8_template_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@_query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    out = merkle.manifest(read_table(spark, sf_dir, "documents"), {"text": F.translate("text", ascii_uppercase, ascii_lowercase)}, tampered)
    return out.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_ENTRY = "coalesce(CAST(strlen({0}) AS VARCHAR) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_ENTRY.format(f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"

# Trees level by level: `up` and `top` hold every node, with the number of nodes of its level.
ORACLES["op11_merkle_manifest"] = f"""
WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT doc_id, lang, {_LEAF.format(text="text")} AS leaf, {_LEAF.format(text=f"translate(text, '{ascii_uppercase}', '{ascii_lowercase}')")} AS changed,
    xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda s, b: list_reduce(range(8),
      lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, xor(s, b)), CAST(4294967295 AS BIGINT))) % 3 = 0 AS tampered FROM documents)),
up AS (SELECT lang, 0 AS level, CAST(idx AS BIGINT) AS idx, CAST(n AS BIGINT) AS n, leaf AS node FROM d
  UNION ALL SELECT lang, level + 1, idx // 8, (min(n) + 7) // 8, sha256(string_agg(node, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY lang, level, idx // 8),
s AS (SELECT lang, level AS height, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS langs FROM up WHERE n = 1),
top AS (SELECT 0 AS level, CAST(place AS BIGINT) AS idx, CAST(langs AS BIGINT) AS n, subroot AS node FROM s
  UNION ALL SELECT level + 1, idx // 8, (min(n) + 7) // 8, sha256(string_agg(node, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY level, idx // 8),
r AS (SELECT node AS root FROM top WHERE n = 1),
x AS (SELECT d.*, s.height, s.subroot, s.place, row_number() OVER () AS id FROM d JOIN s ON d.lang IS NOT DISTINCT FROM s.lang),
around AS (SELECT x.id, up.level, up.idx, up.node, up.idx = x.idx // CAST(8 ** up.level AS BIGINT) AS own FROM x JOIN up ON x.lang IS NOT DISTINCT FROM up.lang AND up.n > 1
    AND up.idx // 8 = x.idx // CAST(8 ** (up.level + 1) AS BIGINT)
  UNION ALL SELECT x.id, x.height + top.level, top.idx, top.node, top.idx = x.place // CAST(8 ** top.level AS BIGINT) FROM x JOIN top ON top.n > 1
    AND top.idx // 8 = x.place // CAST(8 ** (top.level + 1) AS BIGINT)),
runs AS (SELECT a.id, a.level, coalesce(string_agg(a.node, '' ORDER BY a.idx) FILTER (WHERE a.idx < o.idx), '') AS l, coalesce(string_agg(a.node, '' ORDER BY a.idx) FILTER (WHERE a.idx > o.idx), '') AS r
  FROM around a JOIN around o ON a.id = o.id AND a.level = o.level AND o.own GROUP BY a.id, a.level),
proofs AS (SELECT id, string_agg(l || r, '' ORDER BY level) AS proof, count(*) AS steps FROM runs GROUP BY id),
fold AS (SELECT id, 0 AS level, CASE WHEN tampered THEN changed ELSE leaf END AS node FROM x
  UNION ALL SELECT f.id, f.level + 1, sha256(runs.l || f.node || runs.r) FROM fold f JOIN runs ON runs.id = f.id AND runs.level = f.level)
SELECT x.doc_id, x.leaf, x.subroot, r.root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.node AS folded_root, f.node = r.root AS verified
FROM x CROSS JOIN r LEFT JOIN proofs p ON p.id = x.id JOIN fold f ON f.id = x.id AND f.level = coalesce(p.steps, 0)
"""


@_query
def op12_line_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = linehash.drop_lines(docs, linehash.build_index(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLES["op12_line_hash_dedup"] = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, r, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{ascii_uppercase}', '{ascii_lowercase}') AS key FROM l),
g AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, g.key IS NOT NULL AND (doc_id IS NULL OR doc_id < last) AS gone FROM k LEFT JOIN g USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY r
"""


@_query
def op13_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(read_table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "component", "n", F.col("deviation").cast("long").alias("deviation"), "whitened", "explained", "identity_error")
