"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Stash
from .textkit import WORD

#: Rows of one source that share one local window.
BIN_ROWS = 2000


def text_size(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cycle: int = 3, most_epochs: int = 3) -> DataFrame:
    """source, source_size -> with target: weights 1..cycle in order of the sources, capped at most_epochs sizes.

    The excess of capped sources is shared again by weight until none is above: target = min(cap, level * weight),
    where level follows from prefix sums over the sources in order of cap / weight. One row per source, so these windows stay small.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    t = (
        sizes.withColumn("_w", (F.pmod(F.row_number().over(order) - 1, F.lit(cycle)) + 1).cast("double"))
        .withColumn("_cap", (F.col("source_size") * most_epochs).cast("double"))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_place", F.row_number().over(by_ratio))
        .withColumn("_cap_before", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_w_before", F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_level", (F.sum("source_size").over(everything) - F.col("_cap_before")) / (F.sum("_w").over(everything) - F.col("_w_before")))
        .withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_place", "_level"))).over(everything)["_level"])
    )
    return t.select("source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_level"), F.lit(0.0)) * F.col("_w")).alias("target"))


def mix_sources(docs: DataFrame, stash: Stash, seed: str = "mix", bin_rows: int = BIN_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words the mix takes, repeats counted) of each row of docs.

    Documents get a hash-random key of their id (of their text without one), each source is sorted by it in bins of about bin_rows rows, prefix sums are taken
    within bins and over bins, and each source is cut at its exact budget: whole epochs first, then a partial one whose
    last document is taken in part. No source, however large, meets in one task. A null source is a source of its own, the
    last; a null or empty text has size 0 and taken 0; rows that repeat are rows of their own, rows equal in key, id
    and size are interchangeable; an empty table gives an empty result; further columns of docs are not read.
    """
    own = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    d = docs.select("doc_id", "source", text_size(F.col("text")).alias("size"), F.md5(F.concat(F.lit(f"{seed}:"), own)).alias("_key"))
    d = stash.keep(d, "sizes")
    per_source = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    rows = per_source.select(F.col("source").alias("_s"), "_rows")
    shares = stash.keep(targets(per_source.drop("_rows")).join(rows, F.col("_s").eqNullSafe(F.col("source"))).drop("source"), "targets")
    bin_of = F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * F.ceil(F.col("_rows") / F.lit(bin_rows)) / F.lit(1 << 32)).cast("long")
    d = d.join(shares, F.col("_s").eqNullSafe(F.col("source"))).drop("_s").withColumn("_bin", bin_of)
    over_bins = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = d.groupBy(F.col("source").alias("_s"), F.col("_bin").alias("_b")).agg(F.sum("size").alias("_sum"))
    starts = starts.select("_s", "_b", F.coalesce(F.sum("_sum").over(over_bins), F.lit(0)).alias("_start"))
    within = Window.partitionBy("source", "_bin").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    d = d.join(starts, F.col("_s").eqNullSafe(F.col("source")) & (F.col("_b") == F.col("_bin")))
    budget = F.round(F.col("target")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = budget - epochs * F.col("source_size") - F.col("_start") - F.col("_before")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return d.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
