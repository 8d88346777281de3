"""A corpus pipeline of five stages: each takes the documents that the stage before kept, written as Parquet and read again.

* language_id drops documents without a determined language, those whose language scores below 0.15, and those with less
  than 0.4 of their letters in words that a learned language explains (lang_id.accepted).
* line_dedup removes lines seen on eight sources or more from all documents but one; documents stay, if empty.
* near_dup keeps one document of each group of near copies.
* secret_scan replaces secrets by a mark.
* packing gives the pieces of the training sequences.

All stages but the last keep the columns of documents, whatever else there is and however it is called; n_chars, where
there is such a column, follows the text. Null and empty texts go with the first stage, as their language is
undetermined; long texts are taken whole; null sources count for no spread of lines and form one source of the mixture;
of repeated rows and of ties in a group one row stays, that of the least key; null keys pass, and are kept of a group
only if all its keys are null; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import lang_id, line_dedup, near_dup, packing, secret_scan
from granary.llm.common import cut, remove
from granary.llm.queries import held_out, tokenizer


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lang_id.accepted(docs, lang_id.fit(docs.where(~held_out())))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(docs, line_dedup.cleaned(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.deduplicated(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(docs, secret_scan.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


def _recounted(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, follows the text."""
    if "n_chars" not in docs.columns:
        return changed
    return changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dup", near), ("secret_scan", secrets), ("packing", packed)]
#: Language models, sketches and tokenizers are beyond SQL; tests compare run() to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
        if before is not None:
            remove(before)  # the stage after it has been written
        before = docs
    return docs
