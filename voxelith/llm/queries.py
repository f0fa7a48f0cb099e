"""The registered queries of this subpackage, one for each operator, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import classifier, linededup, minhash, packing, pii, quality, simhash, spm, tokencount, warc
from .sql import ORACLE_SQL


def _tokenizers():
    import public_tokenizers

    return public_tokenizers


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_read(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.report(_read(spark, sf_dir, "documents"), _tokenizers().path("piece_bpe_32k.model"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_read(spark, sf_dir, "pages"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return classifier.score(docs, classifier.fit(docs, _read(spark, sf_dir, "labels")))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_read(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By documents' source, the only site that they name; `pages` has hosts, see the tests."""
    return linededup.line_dedup(_read(spark, sf_dir, "documents")).select("doc_id", "source", "n_lines", "n_dropped", "text")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tokenizers()
    return tokencount.token_counts(_read(spark, sf_dir, "documents"), t.path("byte_bpe_50k.tiktoken"), t.PATTERN)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), _tokenizers().path("word_bpe_49k.json"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited_pairs(_read(spark, sf_dir, "documents"))


_ALL = (
    op1_quality_rules,
    op2_sentencepiece,
    op3_warc,
    op4_quality_classifier,
    op5_pii,
    op6_line_dedup,
    op7_token_counts,
    op8_simhash_near_dedup,
    op9_best_fit_packing,
    op10_document_fingerprints,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
