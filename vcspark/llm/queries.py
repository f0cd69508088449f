"""One query for each operator of this package, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vcspark.llm.exact_dedup import exact_dedup
from vcspark.llm.extraction import extract_pages
from vcspark.llm.langid import identify_pages
from vcspark.llm.lm_scoring import score_documents
from vcspark.llm.mixing import mix_sources
from vcspark.llm.near_dedup import near_duplicates
from vcspark.llm.packing import pack_documents
from vcspark.llm.prefix_trie import conversation_trie
from vcspark.llm.tandem import periodic_runs
from vcspark.llm.topk import top_k, usable_vectors
from vcspark.llm.toxicity import score_toxicity
from vcspark.llm.url_filter import filter_urls
from vcspark.llm.warc import archive_pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable_vectors(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_pages(_table(spark, sf_dir, "pages"))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), width=2, percent=80)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_lm_score": op3_lm_score,
    "op4_exact_topk": op4_exact_topk,
    "op5_language_id": op5_language_id,
    "op6_pack": op6_pack,
    "op7_url_filter": op7_url_filter,
    "op8_warc": op8_warc,
    "op9_extract_html": op9_extract_html,
    "op10_near_dedup": op10_near_dedup,
    "op11_toxicity": op11_toxicity,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_prefix_trie": op13_prefix_trie,
}

_FITS = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
""",
    "op4_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id,
         list_sum(list_transform(list_zip(q.e, x.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 10
""",
    "op7_url_filter": f"""
WITH p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), r AS (
  SELECT page_id, host, path, CASE
    WHEN {_FITS.format("example.org", "/en/1")} THEN 'example.org/en/1'
    WHEN {_FITS.format("example.org", "/es/")} THEN 'example.org/es/'
    WHEN {_FITS.format("com", "/fr/")} THEN 'com/fr/'
    WHEN {_FITS.format("com", "/de/")} THEN 'com/de/'
    WHEN {_FITS.format("org", "/")} THEN 'org/' END AS rule,
    regexp_matches(host || path, '(?i)(?:^|[^a-z0-9])(?:doubleclick|adserver|adservice|casino|porn|xxx|torrent|malware|phishing)(?:[^a-z0-9]|$)') AS listed
  FROM p
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL OR listed THEN 'block' ELSE 'allow' END AS verdict
FROM r
""",
    "op8_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, html, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h FROM p
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, 5 * (i // 4)::INTEGER + 1, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
FROM d WINDOW w AS (PARTITION BY html)
""",
    "op13_prefix_trie": r"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos,
    struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS item
  FROM conversations WHERE conv_id IS NOT NULL
), crc AS (
  SELECT DISTINCT c, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, 1 + length(c::VARCHAR)), lambda i: ascii(substr(c::VARCHAR, i::INTEGER, 1))::BIGINT)),
    lambda r, byte: list_reduce(list_prepend(xor(r, byte), range(8)), lambda v, k: xor(v >> 1, 3988292384 * (v & 1))))) % 4 AS h
  FROM t
), rebuilt AS (
  SELECT crc.c, t.pos, t.item FROM crc JOIN t ON t.c = crc.c - crc.c % 20 WHERE t.pos < crc.h
  UNION ALL SELECT crc.c, t.pos, t.item FROM crc JOIN t ON t.c = crc.c WHERE t.pos >= crc.h
), sequences AS (
  SELECT crc.c, coalesce(list(item ORDER BY pos) FILTER (pos IS NOT NULL), []) AS seq FROM crc LEFT JOIN rebuilt USING (c) GROUP BY crc.c
), prefixes AS (
  SELECT c, len(seq) AS total, d, seq[1:d] AS path FROM sequences, unnest(range(0, len(seq) + 1)) AS u(d)
), nodes AS (
  SELECT path, d, min(c) AS conv_id, count(*) AS n_convs,
    CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(any_value(path[d].text), '[^\x20\x09-\x0D]+')) END AS words,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (total = d), '')) AS ends_sha256
  FROM prefixes GROUP BY path, d
), children AS (
  SELECT path[1:d - 1] AS path, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2
), shown AS (
  SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children USING (path, d)
), sums AS (
  SELECT s.path[1:k] AS path, k AS d, sum((n_convs - 1) * words) AS saved, count(*) FILTER (n_children = 0) AS leaves
  FROM shown s, unnest(range(0, s.d + 1)) AS u(k) GROUP BY 1, 2
)
SELECT s.conv_id::BIGINT AS conv_id, s.d::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, s.n_convs, s.n_children,
  sums.leaves AS n_leaves, sums.saved::BIGINT AS saved_tokens, s.ends_sha256
FROM shown s JOIN sums USING (path, d) LEFT JOIN nodes p ON s.d > 0 AND p.d = s.d - 1 AND p.path = s.path[1:s.d - 1]
""",
}
