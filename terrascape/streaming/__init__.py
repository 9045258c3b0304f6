"""Scoring of new instances, in batches or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.project import Projection
from ..operators.scale import boxcox, winsorise


def scorer(bounds: dict[str, tuple[float, float]], scaling: dict[str, tuple[float, float, float, float, float]], projection: Projection):
    """A function that adds z_1, z_2 to any DataFrame with the features, streaming or not: bounds, Box-Cox and z-scores by column arithmetic with fixed numbers.

    bounds: lo, hi by feature; scaling: low, add, lambda, mean, std by feature, as normalise() gives them.
    """

    def apply(df: DataFrame) -> DataFrame:
        new = {}
        for f in projection.features:
            low, add, lam, mean, std = scaling[f]
            raw = winsorise(F.col(f), *bounds[f]) if f in bounds else F.col(f)
            new[f] = F.try_divide(boxcox(F.greatest(raw - F.lit(low) + F.lit(add), F.lit(1e-12)), lam) - F.lit(mean), F.lit(std))
        keep = [c for c in df.columns if c not in new]
        scaled = df.select(*keep, *[F.when(F.col(f).isNotNull(), c).alias(f) for f, c in new.items()])
        return projection.apply(scaled)

    return apply


def score_stream(spark, path: str, schema, apply, sink: str, checkpoint: str, fmt: str = "parquet"):
    """Starts a query that scores files as they arrive and appends them to sink; what was done is in checkpoint, so it resumes exactly."""
    stream = apply(spark.readStream.schema(schema).format(fmt).load(path))
    return stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
