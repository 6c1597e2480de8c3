"""One query for each operator of this subpackage over its whole table, with production parameters, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fixity, jaccard, line_chunks, naming, packing, pii, secrets, token_counts, toxicity
from .common import table

MODEL, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


@query
def op1_token_counts(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), model)


@query
def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as an archive, against a replica in which some records have rotted or are gone, by rules on the id."""
    pages = table(spark, sf_dir, "pages")
    rotten = F.when(F.col("page_id") % 97 == 5, F.concat(F.lit("#"), F.substring("html", 2, 2147483646))).otherwise(F.col("html"))
    replica = pages.where("page_id % 211 <> 7").withColumn("html", rotten)
    return fixity.audit(fixity.warc_records(pages), fixity.warc_records(replica)).withColumnRenamed("id", "page_id")


ORACLE["op2_warc_fixity"] = """
WITH records AS (
  SELECT page_id, html,
    strlen('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
      || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10)) AS bytes
  FROM pages),
placed AS (SELECT *, coalesce(sum(bytes) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM records)
SELECT page_id, "offset", bytes::BIGINT AS expected_bytes, CASE WHEN page_id % 211 = 7 THEN 0 ELSE bytes END::BIGINT AS actual_bytes,
  CASE WHEN page_id % 211 = 7 THEN 'missing' ELSE 'corrupt' END AS status
FROM placed WHERE page_id % 211 = 7 OR (page_id % 97 = 5 AND html[1] <> '#')
"""


@query
def op3_pii_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_columns(pii.sanitise_documents(table(spark, sf_dir, "documents")))


@query
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op4_benchmark_decontamination"] = r"""
WITH item_words AS (
  SELECT item_id, w FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark WHERE item_id IS NOT NULL)
  WHERE len(w) > 0),
placed AS (
  SELECT text_no, item_id, p AS ip, array_to_string(w[p : p + 9], ' ') AS win, least(len(w), 10) AS size
  FROM (SELECT *, row_number() OVER () AS text_no FROM item_words), unnest(range(1, greatest(1, len(w) - 9) + 1)) AS t(p)),
windows AS (SELECT DISTINCT item_id, win, size FROM placed),
doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
places AS (
  SELECT doc_id, p, size, array_to_string(w[p : p + size - 1], ' ') AS win
  FROM doc_words, (SELECT DISTINCT size FROM windows) AS s, unnest(range(1, len(w) - size + 2)) AS t(p)),
found AS (SELECT doc_id, p, size, item_id FROM places JOIN windows USING (win, size)),
hit AS (SELECT doc_id, count(DISTINCT p + i) AS n_hit FROM found, unnest(range(0, size)) AS t(i) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id),
pairs AS (SELECT doc_id, p, size, text_no, item_id::VARCHAR AS item, ip, p - row_number() OVER (PARTITION BY doc_id, text_no, p - ip ORDER BY p) AS run FROM places JOIN placed USING (win, size)),
chains AS (SELECT doc_id, min(p) - 1 AS a, item, min(ip) - 1 AS b, max(p) - min(p) + any_value(size) AS n FROM pairs GROUP BY doc_id, text_no, item, p - ip, run),
longest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, a, item, b) AS rn FROM chains) WHERE rn = 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(n, 0)::BIGINT AS longest, coalesce(a, -1)::BIGINT AS longest_start, coalesce(item, '') AS longest_item, coalesce(b, -1)::BIGINT AS longest_item_start
FROM doc_words d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)
"""


@query
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.exact_groups(table(spark, sf_dir, "documents"))


ORACLE["op5_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query
def op6_harmonic_packing(spark: SparkSession, sf_dir: str, tokenizer: str = WORDS) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer)


@query
def op7_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


@query
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


@query
def op9_line_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_chunks.deduplicate_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_chunks", "n_removed_lines", "n_removed_chunks", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


ORACLE["op9_line_chunk_dedup"] = """
WITH lines AS (
  SELECT doc_id, i, line, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), unnest(ls) WITH ORDINALITY AS t(line, i)),
marked AS (SELECT *, CASE WHEN i = 1 OR (lag(h) OVER d * 31 + h) % 4294967296 % 4 = 0 THEN 1 ELSE 0 END AS starts FROM lines WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
placed AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM marked),
chunks AS (SELECT doc_id, pos, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY i) AS chunk FROM placed GROUP BY doc_id, pos),
flagged AS (SELECT *, n_lines > 1 AND row_number() OVER (PARTITION BY chunk ORDER BY doc_id, pos) > 1 AS removed FROM chunks)
SELECT doc_id, sum(n_lines)::BIGINT AS n_lines, count(*)::BIGINT AS n_chunks, coalesce(sum(n_lines) FILTER (removed), 0)::BIGINT AS n_removed_lines,
  count(*) FILTER (removed)::BIGINT AS n_removed_chunks, sha256(coalesce(string_agg(chunk, chr(10) ORDER BY pos) FILTER (NOT removed), '')) AS text_sha256
FROM flagged GROUP BY doc_id
"""


@query
def op9_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated passage of two lines or more, and every repeated long line."""
    out = line_chunks.deduplicate_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


ORACLE["op9_passage_dedup"] = """
WITH lines AS (
  SELECT doc_id, i, line, strlen(line) > 100 AS long, lead(line) OVER d AS next
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), unnest(ls) WITH ORDINALITY AS t(line, i) WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
parts AS (SELECT doc_id, i, 2 AS n, line || chr(10) || next AS part FROM lines WHERE next IS NOT NULL UNION ALL SELECT doc_id, i, 1, line FROM lines WHERE long),
placed AS (SELECT doc_id, i, n, first_value(doc_id) OVER same AS doc0, first_value(i) OVER same AS i0 FROM parts WINDOW same AS (PARTITION BY n, part ORDER BY doc_id, i)),
gone AS (SELECT DISTINCT doc_id, i + k AS i, true AS g FROM (SELECT * FROM placed WHERE doc_id <> doc0 OR i >= i0 + n), unnest(range(0, n)) AS t(k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (g)::BIGINT AS n_removed_lines,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (g IS NULL), '')) AS text_sha256
FROM lines LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id
"""


@query
def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(table(spark, sf_dir, "documents"))
