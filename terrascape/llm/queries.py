"""The opN_<name> queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pipeline, quality
from .decontaminate import find_leaks
from .exact import exact_groups
from .mixing import mix_sources
from .near import near_groups
from .personal import find_personal
from .scoring import held_out, lm_scores
from .store import Stash
from .substring import remove_repeats
from .tokens import read_vocabulary, token_counts
from .toxicity import learn, toxicity_scores


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), Stash(spark, "op1"), parts=5)


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(table(spark, sf_dir, "documents"), Stash(spark, "op2"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels"), fold=(3, 1), train_rows=3000)
    scored = quality.quality_scores(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 3).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), Stash(spark, "op4"), k=13)


def vocabulary_path() -> str:
    """The public vocabulary that op5 counts with."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), *read_vocabulary(vocabulary_path()))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), Stash(spark, "op7"), keep="max")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"), fold=(3, 1), train_rows=3000)
    scored = toxicity_scores(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 3).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), Stash(spark, "op9")).select("doc_id", "size", "source_size", "target", "taken")


def op10_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), Stash(spark, "op10")).drop("text_key")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_lm_scores, op2_personal_data, op3_quality, op4_substring_dedup, op5_token_counts, op6_decontaminate, op7_exact_dedup, op8_toxicity, op9_mix_sources, op10_minhash_neardup]
    return {f.__name__: f for f in found} | {"pipeline": pipeline.run}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return dict(SQL)
