"""Boundary of the space: corners of the feature box, pruned by correlation, projected, and their hulls."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import convex_hull
from ..sources.metadata import Instances
from .correlate import correlations, masked
from .project import Projection

#: There are 2^F corners; more features than this are refused.
MOST_FEATURES = 24


def corners(t: Instances) -> DataFrame:
    """corner, bit_<feature>, and the features at their least (bit 0) or largest (bit 1) value; bit j of the corner is feature j's."""
    if len(t.features) > MOST_FEATURES:
        raise ValueError(f"{len(t.features)} features have too many corners; choose at most {MOST_FEATURES}")
    ends = t.df.agg(*[F.min(f).alias(f"lo_{i}") for i, f in enumerate(t.features)], *[F.max(f).alias(f"hi_{i}") for i, f in enumerate(t.features)]).first()
    bit = lambda j: F.shiftright("id", j).bitwiseAND(F.lit(1)).cast("int")
    cols = [c for j, f in enumerate(t.features) for c in (bit(j).alias("bit_" + f.removeprefix("feature_")), F.when(bit(j) == 1, F.lit(ends[f"hi_{j}"])).otherwise(F.lit(ends[f"lo_{j}"])).alias(f))]
    return t.df.sparkSession.range(2 ** len(t.features)).select(F.col("id").alias("corner"), *cols)


def prune(found: DataFrame, t: Instances, rho: dict[tuple[str, str], float], limit: float) -> DataFrame:
    """Corners that no strong correlation forbids: strongly correlated features have equal signs, strongly opposed ones different signs. One generated predicate."""
    bad = [F.lit(False)]
    for j, a in enumerate(t.features):
        for b in t.features[j + 1 :]:
            same = F.sign(F.col(a)) == F.sign(F.col(b))
            if rho[a, b] > limit:
                bad.append(~same)
            elif rho[a, b] < -limit:
                bad.append(same)
    return found.where(~reduce(lambda x, y: x | y, bad))


def feature_rho(t: Instances, p: float) -> dict[tuple[str, str], float]:
    """Correlation of each pair of features; 0 where it is not significant at p."""
    rows = masked(correlations(t.df, t.features, t.features), p).collect()
    return {(r["feature"], r["algo"]): r["rho_masked"] for r in rows}


def hull(points: DataFrame) -> DataFrame:
    """ord, z_1, z_2: corners of the convex hull of z_1, z_2, counter-clockwise; empty for points on a line. Hulls of the partitions first, then the hull of those."""

    def of(batches):
        import pandas as pd

        held = np.zeros((0, 2))
        for pdf in batches:
            held = np.vstack([held, pdf[["z_1", "z_2"]].to_numpy()])
            small = convex_hull(held)
            held = np.array(small) if small else np.unique(held, axis=0)[[0, -1]] if len(held) else held
        yield pd.DataFrame(held, columns=["z_1", "z_2"])

    def ends(pdf):
        import pandas as pd

        ring = convex_hull(pdf[["z_1", "z_2"]].to_numpy())
        return pd.DataFrame([(i, *p) for i, p in enumerate(ring)], columns=["ord", "z_1", "z_2"]).astype({"ord": "int64", "z_1": "float64", "z_2": "float64"})

    partial = points.select("z_1", "z_2").where("z_1 IS NOT NULL AND z_2 IS NOT NULL").mapInPandas(of, "z_1 double, z_2 double")
    return partial.withColumn("_all", F.lit(True)).groupBy("_all").applyInPandas(ends, "ord long, z_1 double, z_2 double")


def edges(t: Instances, projection: Projection, p: float = 0.05, limit: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Hulls of all corners and of those that correlations allow; the former for both if none is left."""
    found = corners(t)
    full = hull(projection.apply(found))
    pruned = prune(found, t, feature_rho(t, p), limit)
    return full, full if pruned.isEmpty() else hull(projection.apply(pruned))
