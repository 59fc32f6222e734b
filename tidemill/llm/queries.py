"""The subpackage's queries: opN_<name>, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.katz import katz_scores

    return katz_scores(_documents(spark, sf_dir))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.token_file import read_token_files, write_token_files

    return read_token_files(write_token_files(_documents(spark, sf_dir), _vocabulary("byte_bpe_50k.json"), end_id=0), with_ids=False)


def op3_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.media import describe_streams, store_streams

    return describe_streams(store_streams(_documents(spark, sf_dir)))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.near_dups import near_duplicates

    return near_duplicates(_documents(spark, sf_dir), words=2)


def op5_first_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.packing import pack_documents

    return pack_documents(_documents(spark, sf_dir), _vocabulary("word_bpe_49k.json"), end_id=1).drop("ids")


def op6_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.language import identify

    return identify(_documents(spark, sf_dir))


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.quality_rules import line_quality

    return line_quality(_documents(spark, sf_dir), with_text=False).drop("clean_text")


def op8_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.weak_labels import weak_quality

    return weak_quality(_documents(spark, sf_dir))


def op9_block_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.mixing import mixed_counts

    return mixed_counts(_documents(spark, sf_dir))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.licenses import documents_as_files, license_scan

    return license_scan(documents_as_files(_documents(spark, sf_dir)))


def op11_window_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.decontamination import contamination, digests

    return digests(contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def op12_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.whitening import whitened

    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm.lexical_search import lexical_search

    return lexical_search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_katz_scores": op1_katz_scores,
    "op2_token_files": op2_token_files,
    "op3_transport_streams": op3_transport_streams,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_first_fit_packing": op5_first_fit_packing,
    "op6_ppm_language": op6_ppm_language,
    "op7_line_quality": op7_line_quality,
    "op8_weak_quality": op8_weak_quality,
    "op9_block_mixing": op9_block_mixing,
    "op10_license_scan": op10_license_scan,
    "op11_window_decontamination": op11_window_decontamination,
    "op12_whitened_embeddings": op12_whitened_embeddings,
    "op13_lexical_search": op13_lexical_search,
    "pipeline": pipeline,
}
