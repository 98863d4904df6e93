"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .encoding import vocabulary_path


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import secret_scan

    return secret_scan(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"))


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentence_spans import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import tokenize_to_files

    return tokenize_to_files(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), end_id=2)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), end_id=1)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive

    return archive(table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_quality": op3_quality,
    "op4_sentence_spans": op4_sentence_spans,
    "op5_token_files": op5_token_files,
    "op6_packing": op6_packing,
    "op7_bpe": op7_bpe,
    "op8_warc": op8_warc,
    "op9_simhash": op9_simhash,
    "op10_topk": op10_topk,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": """
WITH l AS (
  SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), one AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS j FROM l
), marked AS (
  SELECT doc_id, line, j, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS m FROM one
), cuts AS (
  SELECT doc_id, line, j,
    CASE WHEN (m + 65599 * coalesce(lag(m) OVER (PARTITION BY doc_id ORDER BY j), 0)) % 4294967291 % 3 = 0 THEN 1 ELSE 0 END AS cut
  FROM marked
), numbered AS (
  SELECT doc_id, line, j, coalesce(sum(cut) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c
  FROM cuts
), chunks AS (
  SELECT doc_id, c, string_agg(line, chr(10) ORDER BY j) AS body, count(*) AS n_lines,
    count(*) FILTER (WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]')) >= 2 AS ok
  FROM numbered GROUP BY doc_id, c
), judged AS (
  SELECT *, ok AND row_number() OVER (PARTITION BY ok, body ORDER BY doc_id, c) > 1 AS gone FROM chunks
), made AS (
  SELECT doc_id, coalesce(string_agg(body, chr(10) ORDER BY c) FILTER (WHERE NOT gone), '') AS left_text, count(*) AS n_chunks,
    count(*) FILTER (WHERE gone) AS n_cut_chunks, CAST(coalesce(sum(n_lines) FILTER (WHERE gone), 0) AS BIGINT) AS n_cut_lines
  FROM judged GROUP BY doc_id
)
SELECT l.doc_id, CASE WHEN n_cut_chunks = 0 THEN l.text ELSE left_text END AS text, n_chunks, n_cut_chunks, n_cut_lines
FROM l JOIN made ON l.doc_id = made.doc_id
""",
    "op8_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages
), m AS (SELECT body, min(page_id) AS first FROM p GROUP BY body)
SELECT p.page_id, CAST(octet_length(encode(p.body)) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(p.h, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT) // [32768, 1024, 32, 1][CAST(i % 4 + 1 AS INTEGER)]) % 32 + 1 AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN p.page_id = m.first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id <> m.first THEN m.first END AS refers_to
FROM p JOIN m ON p.body = m.body
""",
    "op10_topk": """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, r.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, r.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM rows q JOIN rows r ON q.vec_id % 20 = 0 AND r.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
""",
}
