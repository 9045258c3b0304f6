"""Correlations of columns and what is selected by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import pearson_p
from ..sources.metadata import Instances


def correlations(df: DataFrame, left: tuple[str, ...], right: tuple[str, ...]) -> DataFrame:
    """feature, algo, rho, n, pval of every pair of a left and a right column, over rows that have both. One aggregate pass.

    The pairs' results are as many as there are pairs of columns, so p-values are found on the driver.
    """
    pairs = [(a, b) for a in left for b in right]
    both = lambda a, b: F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1))
    row = df.agg(*[c for k, (a, b) in enumerate(pairs) for c in (F.corr(a, b).alias(f"r{k}"), both(a, b).alias(f"n{k}"))]).first()
    rows = []
    for k, (a, b) in enumerate(pairs):
        r = row[f"r{k}"]
        r = None if r is None or r != r else max(-1.0, min(1.0, r))
        rows.append((a, b, r, row[f"n{k}"], pearson_p(r, row[f"n{k}"])))
    return df.sparkSession.createDataFrame(rows, "feature string, algo string, rho double, n long, pval double")


def masked(rho: DataFrame, p: float = 0.05) -> DataFrame:
    """rho_masked: 0 where rho is missing or not significant."""
    return rho.withColumn("rho_masked", F.when(F.col("rho").isNull() | F.col("pval").isNull() | (F.col("pval") > p), 0.0).otherwise(F.col("rho")))


def rank_features(rho: DataFrame) -> DataFrame:
    """rank: place of the feature by |rho_masked| for each algorithm, ties by name."""
    return rho.withColumn("rank", F.row_number().over(Window.partitionBy("algo").orderBy(F.round(F.abs("rho_masked"), 9).desc(), "feature")))


def above(rho: DataFrame, least: float) -> DataFrame:
    """The rows whose |rho_masked| reaches least."""
    return rho.where(F.abs("rho_masked") >= least)


def select_by_correlation(t: Instances, least: float, p: float = 0.05) -> list[str]:
    """The best feature of each algorithm, and all features that reach |rho| >= least with some algorithm, in table order."""
    ranked = rank_features(masked(correlations(t.df, t.features, t.algos), p))
    found = {r["feature"] for r in ranked.where((F.col("rank") == 1) | (F.abs("rho_masked") >= least)).select("feature").distinct().collect()}
    return [f for f in t.features if f in found]
