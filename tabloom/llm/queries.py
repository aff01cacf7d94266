"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bit_packing, bm25_packing, exact_dedup, html_extract, mixing, quality, sharding, simhash, toxicity, warc
from .common import table
from .tokens import tokenizer_path


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_token_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_packing.encode_and_read_back(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op6_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write_and_audit(table(spark, sf_dir, "pages"), warc.flip_some)


def op9_shard_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = [f"shard-{k:04d}" for k in range(256)]
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", shards)


def op10_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_token_bit_packing": op2_token_bit_packing,
    "op3_bm25_packing": op3_bm25_packing,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_html_main_text": op5_html_main_text,
    "op6_pivotal_mixing": op6_pivotal_mixing,
    "op7_toxicity_trees": op7_toxicity_trees,
    "op8_warc_fixity": op8_warc_fixity,
    "op9_shard_placement": op9_shard_placement,
    "op10_quality_ledger": op10_quality_ledger,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
        FROM d""",
    "op8_warc_fixity": r"""
        WITH r AS (SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
            || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
            || 'WARC-Record-ID: <urn:page:' || CAST(page_id AS VARCHAR) || '>' || chr(13) || chr(10)
            || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
            || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10)
            || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS t FROM pages)
        SELECT page_id, CAST(strlen(t) AS BIGINT) AS record_bytes, sha256(t) AS record_sha256, page_id % 97 <> 13 AS intact FROM r""",
    "op10_quality_ledger": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
        k AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM p),
        again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS n FROM k) WHERE n > 1),
        c AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM again, (VALUES (0), (1), (2)) v(o) GROUP BY 1),
        l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
        b AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
        m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
            CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(b.dup, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(b.n_lines, 0) AS n_lines,
            length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS up, length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS letters FROM d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id),
        f AS (SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END) + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END)
            + (CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END) + (CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words) THEN 16 ELSE 0 END)
            + (CASE WHEN 10 * up > 5 * letters THEN 32 ELSE 0 END) + (CASE WHEN 10 * letters < 5 * word_chars THEN 64 ELSE 0 END) AS BIGINT) AS failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, failed = 0 AS kept, failed FROM f""",
}
