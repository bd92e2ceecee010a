"""The queries of this package: one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .audit import AUDIT_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mainpart import extract_main_text

    return extract_main_text(_table(spark, sf_dir, "pages"))


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shards import assign_shards

    return assign_shards(_table(spark, sf_dir, "documents"), shards=8)


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op5_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .idfiles import id_files_path, read_id_files, write_id_files

    path = id_files_path(spark)
    write_id_files(_table(spark, sf_dir, "documents"), path)
    return read_id_files(spark, path)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_sequences

    return pack_sequences(_table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digest, find_pii

    return digest(find_pii(_table(spark, sf_dir, "documents")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(_table(spark, sf_dir, "documents"), labels=_table(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokencount import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .audit import audit_filters

    return audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .middle import digest, fill_in_middle

    return digest(fill_in_middle(_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard,
        op2_main_text,
        op3_shards,
        op4_near_vectors,
        op5_id_files,
        op6_packing,
        op7_pii,
        op8_quality,
        op9_token_counts,
        op10_mixing,
        op11_toxicity,
        op12_filter_audit,
        op13_fill_in_middle,
    )
}

ORACLE_SQL: dict[str, str] = {"op12_filter_audit": AUDIT_SQL}
