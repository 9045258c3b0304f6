"""Column selection and removal of rows and columns with too little data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.metadata import Instances


def select_features(t: Instances, names: list[str] | None) -> Instances:
    """Keeps the named features, in table order; unknown names count for nothing, and without any known name all stay."""
    found = [f for f in t.features if f in set(names or ())]
    return t.keep(features=found) if found else t


def select_algos(t: Instances, names: list[str] | None) -> Instances:
    found = [a for a in t.algos if a in set(names or ())]
    return t.keep(algos=found) if found else t


def drop_missing_rows(t: Instances) -> Instances:
    """Drops rows whose features, or whose algorithms, are all missing."""
    some = lambda cols: F.coalesce(*cols).isNotNull() if cols else F.lit(True)
    return t.with_df(t.df.where(some(t.features) & some(t.algos)))


def missing_ratios(t: Instances) -> DataFrame:
    """One row: the share of missing values of each feature."""
    return t.df.agg(*[F.avg(F.col(f).isNull().cast("double")).alias(f) for f in t.features])


def drop_sparse_features(t: Instances, limit: float = 0.2) -> Instances:
    """Drops features of which at least `limit` is missing. One aggregate over all features."""
    row = missing_ratios(t).first()
    return t.keep(features=[f for f in t.features if row[f] is None or row[f] < limit])


def distinct_ratio(t: Instances) -> DataFrame:
    """One row: n_rows, n_distinct (rows of features), ratio."""
    distinct = t.df.select(*t.features).distinct().agg(F.count(F.lit(1)).alias("n_distinct"))
    return t.df.agg(F.count(F.lit(1)).alias("n_rows")).crossJoin(distinct).withColumn("ratio", F.try_divide(F.col("n_distinct").cast("double"), F.col("n_rows")))


def preprocess(t: Instances, feats: list[str] | None = None, algos: list[str] | None = None, warn=print) -> Instances:
    """Selection by name, then rows without data, then sparse features; says so if less than half of the rows are distinct."""
    t = drop_sparse_features(drop_missing_rows(select_algos(select_features(t, feats), algos)))
    ratio = distinct_ratio(t).first()["ratio"]
    if ratio is not None and ratio < 0.5:
        warn(f"Only {ratio:.2f} of the instances are distinct")
    return t
