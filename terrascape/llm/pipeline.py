"""The corpus pipeline: toxicity, exact dedup, near dedup, decontamination and mixing, each on what the one before kept.

Every stage takes (spark, docs, sf_dir) and acts on each row of docs, whole texts: null ids, null and empty texts, ties and repeated rows are
treated as the operators' docstrings say, all columns of docs are kept (but for mixing, which reports), whatever their names, and
an empty table stays empty.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import drop_leaked
from .exact import digest, exact_groups
from .mixing import mix_sources
from .near import near_groups
from .store import Stash
from .toxicity import drop_toxic, learn

#: SQL can't express the toxicity stage; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below 0.7 stay. The model learns from the stage's own rows that have a label; a null or empty text scores as one without words."""
    return drop_toxic(docs, learn(docs, _table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the least doc_id stays; null counts as the empty text; null ids stay only where a group has no other; of rows equal in id and text one stays."""
    stash = Stash(spark, "pipeline-exact")
    return _without(docs, exact_groups(docs, stash, keep="min").withColumnRenamed("text_sha256", "key"), digest(F.col("text")), stash)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the row with the least doc_id stays. Rows without words are linked with nothing and stay; a row without an id stays unless it is linked with one that has."""
    stash = Stash(spark, "pipeline-near")
    return _without(docs, near_groups(docs, stash, k=5, percent=80).withColumnRenamed("text_key", "key"), F.xxhash64("text"), stash)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item stay, null and empty texts among them."""
    return drop_leaked(docs, _table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of the rows of which the mix takes some words."""
    return mix_sources(docs, Stash(spark, "pipeline-mix")).where("taken > 0")


def _without(docs: DataFrame, decided: DataFrame, key: Column, stash: Stash) -> DataFrame:
    """Rows of docs that the operator keeps. decided: doc_id, key, kept, one row for each of docs.

    Rows are told apart by id and key of the text. Of rows that repeat in both, of which some are kept and some not, one stays.
    """
    of = stash.keep(decided.groupBy("doc_id", "key").agg(F.max("kept").alias("some"), F.min("kept").alias("all")).where("NOT all"), "decided")
    columns = docs.columns
    mark, id_, key_ = (next(n for n in itertools.chain([name], (f"{name}{i}" for i in itertools.count())) if n.lower() not in {c.lower() for c in columns}) for name in ("_mark", "_id", "_key"))
    keyed = docs.withColumn(mark, key)
    same = lambda right: F.col("doc_id").eqNullSafe(right[id_]) & F.col(mark).eqNullSafe(right[key_])
    gone = of.where("NOT some").select(F.col("doc_id").alias(id_), F.col("key").alias(key_))
    kept = keyed.join(gone.hint("merge"), same(gone), "left_anti")
    repeats = of.where("some").select(F.col("doc_id").alias(id_), F.col("key").alias(key_))
    if not repeats.isEmpty():
        once = kept.join(repeats, same(repeats), "left_semi").dropDuplicates(["doc_id", mark])
        kept = kept.join(repeats, same(repeats), "left_anti").unionByName(once)
    return kept.select(*columns)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each on what the one before kept, written and read again."""
    docs = _table(spark, sf_dir, "documents")
    stash = Stash(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = stash.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
