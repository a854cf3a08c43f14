"""The registered queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .oracles import ORACLE


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages, read_captures, url_key

    pages = _read(spark, sf_dir, "pages")
    return read_captures(spark, archive_pages(pages, least=0), pages.select(url_key(pages["url"])))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_scan

    return secret_scan(_read(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import byte_shards

    return byte_shards(_read(spark, sf_dir, "documents"), shards=16)


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(_read(spark, sf_dir, "embeddings"), k=10, every=100)


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_duplicates import jaccard_components

    return jaccard_components(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import delete_repeated_lines

    return delete_repeated_lines(_read(spark, sf_dir, "documents"), counts="deleted_words").select("doc_id", "deleted_words", "text")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_scores

    return toxicity_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import token_digests

    return token_digests(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline  # noqa: F401  the query below needs it

    own = [op1_warc, op2_secrets, op3_sharding, op4_ann, op5_jaccard, op6_quality, op7_decontaminate, op8_line_dedup, op9_toxicity, op10_bpe, pipeline]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
