"""Nearest rows of a stated, bounded set of query rows among all rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest(rows: DataFrame, queries: DataFrame, cols: list[str], k: int = 3, block: int = 4096) -> DataFrame:
    """iid, rank, near, distance: the k nearest other rows of each query row, ties to the smaller iid.

    Query rows are taken in blocks of bounded size; each partition gives its own k best for the block, and these are ranked by query row. Rows with missing values are left out.
    """
    full = lambda df: df.where(F.coalesce(*[F.when(F.col(c).isNull(), True) for c in cols]).isNull()).select("iid", *cols)
    asked = full(queries).orderBy("iid")
    ids = [r["iid"] for r in asked.select("iid").toLocalIterator()]
    schema, out = "iid long, near long, distance double", None
    for i in range(0, max(1, len(ids)), block):
        part = asked.where(F.col("iid").between(ids[i], ids[min(len(ids), i + block) - 1])).toPandas() if ids else asked.limit(0).toPandas()
        held = rows.sparkSession.sparkContext.broadcast((part["iid"].to_numpy(), part[cols].to_numpy(float)))

        def run(batches, held=held):
            import pandas as pd

            q_ids, q = held.value
            for pdf in batches:
                x, x_ids = pdf[cols].to_numpy(float), pdf["iid"].to_numpy()
                found = []
                for a, v in zip(q_ids, q, strict=True):
                    d = np.sqrt(((x - v) ** 2).sum(1))
                    d[x_ids == a] = np.inf
                    best = np.lexsort((x_ids, d))[:k]
                    found += [(int(a), int(x_ids[j]), float(d[j])) for j in best if np.isfinite(d[j])]
                yield pd.DataFrame(found, columns=["iid", "near", "distance"])

        got = full(rows).mapInPandas(run, schema)
        out = got if out is None else out.unionByName(got)
    rank = F.row_number().over(Window.partitionBy("iid").orderBy("distance", "near"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("iid", "rank", "near", "distance")
