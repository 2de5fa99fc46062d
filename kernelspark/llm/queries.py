"""The queries op1_ to op13_ and pipeline: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelspark.llm import ann, hardneg, langid, mixing, ngram_join, packing, passages, quality, resample, tokenbin, treebpe, warc, wrapper
from kernelspark.llm._util import documents


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The installed public vocabulary that the queries use; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(documents(spark, sf_dir))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.token_files(documents(spark, sf_dir), tokenizer_path())


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path(), ids=False).drop("source")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(documents(spark, sf_dir))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treebpe.digests(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return hardneg.mine(hardneg.scaled(vectors).withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language, op2_passages, op3_ngram_join, op4_warc, op5_main_text, op6_token_files, op7_packing, op8_quality, op9_nearest, op10_mixing, op11_bpe, op12_hard_negatives, op13_resample)}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_ngram_join": ngram_join.ORACLE.replace("{docs}", "documents"),
        "op4_warc": warc.ORACLE.replace("{pages}", "pages"),
        "op8_quality": quality.ORACLE.replace("{docs}", "documents"),
        "op10_mixing": mixing.ORACLE.replace("{docs}", "documents"),
        "op12_hard_negatives": hardneg.ORACLE.replace("{vectors}", "embeddings"),
        "op13_resample": resample.ORACLE.replace("{docs}", "documents"),
    }
