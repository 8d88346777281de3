"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import importlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import imatch, knn, lang_id, line_dedup, near_dup, packing, piece_codec, secret_scan, token_counts, warc


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file."""
    if folder := os.environ.get("GRANARY_TOKENIZERS"):
        return os.path.join(folder, name)
    return importlib.import_module("public_tokenizers").path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: str = "doc_id"):
    """Whether a row is kept from training."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = lang_id.fit(docs.where(~held_out()))
    return lang_id.predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_spans")


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(_table(spark, sf_dir, "embeddings"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(_table(spark, sf_dir, "documents"))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edit_report(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.cleaned(_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_digests(_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


def queries() -> dict:
    found = [op1_language, op2_top_k, op3_secrets, op4_packing, op5_token_counts, op6_near_dup, op7_fingerprint, op8_warc, op9_line_dedup, op10_pieces, pipeline]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_top_k": """
            WITH v AS (
                SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
                WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0
            ), s AS (
                SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(q.v, c.v)]) AS BIGINT) AS score
                FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
            ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
            SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
        "op8_warc": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
            d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
            t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d)
            SELECT page_id, payload_bytes, payload_digest,
                CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
                CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM t""",
        "op9_line_dedup": """
            WITH l AS (
                SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents
            ), w AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS word FROM l),
            b AS (SELECT word, min(doc_id) AS keeper FROM w WHERE word <> '' GROUP BY word HAVING count(DISTINCT source) >= 8),
            k AS (
                SELECT w.*, keeper, row_number() OVER (PARTITION BY w.doc_id, w.word ORDER BY i) AS nth FROM w LEFT JOIN b ON w.word = b.word
            ), t AS (
                SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM k WHERE keeper IS NULL OR (keeper = doc_id AND nth = 1) GROUP BY doc_id
            )
            SELECT d.doc_id, CAST(length(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END) AS BIGINT) AS n_chars,
                sha256(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END) AS text_sha256
            FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id""",
    }
