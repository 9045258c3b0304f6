"""Instance tables: one row an instance, numeric feature_* and algo_* columns, an id and an optional source."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..session import durable


@dataclass(frozen=True)
class Instances:
    """A wide DataFrame with iid (order of the rows), instances, source (null if absent), features and algorithms as doubles, missing as null."""

    df: DataFrame
    features: tuple[str, ...]
    algos: tuple[str, ...]

    def with_df(self, df: DataFrame) -> Instances:
        return replace(self, df=df)

    def keep(self, features: list[str] | None = None, algos: list[str] | None = None) -> Instances:
        """The same rows with fewer columns; other columns than features and algorithms stay."""
        f = tuple(self.features if features is None else features)
        a = tuple(self.algos if algos is None else algos)
        gone = (set(self.features) - set(f)) | (set(self.algos) - set(a))
        return Instances(self.df.select(*[c for c in self.df.columns if c not in gone]), f, a)


def from_dataframe(df: DataFrame, iid: str | None = None) -> Instances:
    """Roles by name, whatever the case: instances, source, feature_..., algo_...; other columns are left out; NaN becomes null.

    iid: a column that orders the rows, else the position of the row in the scan; such numbers are kept once, so that
    later scans agree on them.
    """
    lower = {c.lower(): c for c in df.columns}
    if "instances" not in lower:
        raise ValueError("Instance table has no 'instances' column")
    features = [c for c in df.columns if c.lower().startswith("feature_")]
    algos = [c for c in df.columns if c.lower().startswith("algo_")]
    number = {c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)) for c in (*features, *algos)}
    source = F.col(lower["source"]).cast("string") if "source" in lower else F.lit(None).cast("string")
    order = F.col(iid).cast("long") if iid else F.monotonically_increasing_id()
    out = df.select(order.alias("iid"), F.col(lower["instances"]).cast("string").alias("instances"), source.alias("source"), *[c.alias(n) for n, c in number.items()])
    return Instances(out if iid else durable(out), tuple(features), tuple(algos))


def from_csv(spark: SparkSession, path: str) -> Instances | None:
    """Reads a CSV with header; numbers are read as doubles without a scan for types. A missing or unreadable file prints why and gives None."""
    try:
        header = spark.read.csv(path, header=True).columns
        kinds = T.StructType([T.StructField(c, T.DoubleType() if c.lower().startswith(("feature_", "algo_")) else T.StringType()) for c in header])
        return from_dataframe(spark.read.csv(path, header=True, schema=kinds, enforceSchema=True))
    except (AnalysisException, ValueError) as e:
        print(f"{path}: {e}")
        return None


def row_index(spark: SparkSession, path: str) -> DataFrame:
    """One column of 1-based row ids."""
    return spark.read.csv(path, schema="row long").where("row IS NOT NULL")
