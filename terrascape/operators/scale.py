"""Column statistics, bounds, Box-Cox and z-scores, weights and colours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import boxcox_loss, minimise_1d, power_moments
from ..session import held
from ..sources.metadata import Instances
from .label import TINY

#: Values that are gathered of one bracket at most; a wider one is narrowed first.
GATHERED = 16_384
#: Share of a bracket on either side of a place that approximate quantiles leave open; their accuracy, one in so many. One task reads a sketch of each task and bracket.
OPEN, SKETCH = 0.002, 1000
#: Tasks of one pass of power sums at most; each gives a few rows for the driver to add up.
TASKS = 4096


def order_statistics(df: DataFrame, cols: list[str], shares: list[float]) -> dict[str, dict[float, tuple[float, float] | None]]:
    """Exact order statistics: for each column and share q the values at floor and ceiling of (n - 1) q, nulls left out.

    A place is known to be within a bracket of values, with so many values below it and so many in it. Each pass is one aggregate over all columns: approximate
    quantiles of the brackets' values, or their middle where those don't narrow them, and counts on either side. A bracket of at most GATHERED values is
    read, one that has shrunk to a single value, however frequent, is the answer; so no pass gathers more than that for a place, at any number of rows.
    """
    if not cols:
        return {}
    first = df.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(cols) for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    wanted = {(i, int(p)) for i in range(len(cols)) for q in shares if (n := first[f"n_{i}"]) for p in ((n - 1) * q, -(-((n - 1) * q) // 1))}
    # place -> least and greatest value of its bracket, values below it, values in it, whether the last pass halved the latter
    open_ = {key: (first[f"lo_{key[0]}"], first[f"hi_{key[0]}"], 0, first[f"n_{key[0]}"], True) for key in wanted}
    found: dict[tuple[int, int], float] = {}
    while open_:
        keys, narrow = sorted(open_), {}
        found |= {key: open_[key][0] for key in keys if open_[key][0] == open_[key][1]}
        keys = [key for key in keys if key not in found]
        within = lambda key: F.when(F.col(cols[key[0]]).between(open_[key][0], open_[key][1]), F.col(cols[key[0]]))
        read = [key for key in keys if open_[key][3] <= GATHERED]
        cut = [key for key in keys if key not in read]
        bracket = {key: (key[0], *open_[key][:2]) for key in read}  # several places can be in one
        shared = {b: (k, key) for k, (key, b) in enumerate(bracket.items())}
        aggs = [F.sort_array(F.collect_list(within(key))).alias(f"v{k}") for k, key in shared.values()]
        sketch: dict[tuple, list[tuple]] = {}  # of each bracket that is cut by quantiles, its places
        for key in cut:
            if open_[key][4]:
                sketch.setdefault((key[0], *open_[key][:4]), []).append(key)
        for k, keys in enumerate(sketch.values()):
            at = [(key[1] - open_[key][2]) / open_[key][3] for key in keys]
            aggs.append(F.percentile_approx(within(keys[0]), [p for a in at for p in (max(0.0, a - OPEN), min(1.0, a + OPEN))], SKETCH).alias(f"e{k}"))
        row = df.agg(*aggs).first() if aggs else None
        ends = {key: tuple(row[f"e{k}"][2 * n : 2 * n + 2]) for k, keys in enumerate(sketch.values()) for n, key in enumerate(keys)}
        found |= {key: row[f"v{shared[bracket[key]][0]}"][key[1] - open_[key][2]] for key in read}
        for k, key in enumerate(cut):
            lo, hi, *_, quick = open_[key]
            narrow[key] = ends[key] if quick else (lo, min(hi, max(lo, lo / 2 + hi / 2)))
        if cut:
            c = lambda key: F.col(cols[key[0]])
            counts = {"a": lambda v, x, y: F.count_if(v < x), "b": lambda v, x, y: F.count_if(v <= y), "prior": lambda v, x, y: F.max(F.when(v < x, v)), "least": lambda v, x, y: F.min(F.when(v >= x, v)),
                      "top": lambda v, x, y: F.max(F.when(v <= y, v)), "after": lambda v, x, y: F.min(F.when(v > y, v))}
            row = df.agg(*[f(c(key), *narrow[key]).alias(f"{n}{k}") for k, key in enumerate(cut) for n, f in counts.items()]).first()
        following = {}
        for k, key in enumerate(cut):
            (lo, hi, below, inside, _), a, b = open_[key], row[f"a{k}"], row[f"b{k}"]
            if a <= key[1] < b:
                new = row[f"least{k}"], row[f"top{k}"], a, b - a
            elif key[1] >= b:
                new = row[f"after{k}"], hi, b, below + inside - b
            else:
                new = lo, row[f"prior{k}"], below, a - below
            following[key] = (*new, new[3] * 2 <= inside)
        open_ = following
    out: dict[str, dict] = {c: dict.fromkeys(shares) for c in cols}
    for i, c in enumerate(cols):
        for q in shares:
            if n := first[f"n_{i}"]:
                out[c][q] = found[i, int((n - 1) * q)], found[i, int(-(-((n - 1) * q) // 1))]
    return out


def column_stats(t: Instances, cols: list[str]) -> DataFrame:
    """One row a column: name, n, median, iqr (midpoint of neighbouring order statistics), lo, hi (median -/+ 5 iqr), min, max, mean, std."""
    spark = t.df.sparkSession
    with held(t.df.select(*cols)) as df:
        ranks = order_statistics(df, cols, [0.25, 0.5, 0.75])
        row = df.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(cols) for n, f in (("n", F.count), ("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_samp))]).first()
    mid = lambda pair: None if pair is None else (pair[0] + pair[1]) / 2
    rows = []
    for i, c in enumerate(cols):
        low, med, high = (mid(ranks[c][q]) for q in (0.25, 0.5, 0.75))
        iqr = None if low is None else high - low
        rows.append((c, row[f"n_{i}"], med, iqr, None if low is None else med - 5 * iqr, None if low is None else med + 5 * iqr, row[f"min_{i}"], row[f"max_{i}"], row[f"mean_{i}"], row[f"std_{i}"]))
    return spark.createDataFrame(rows, "name string, n long, median double, iqr double, lo double, hi double, min double, max double, mean double, std double")


def winsorise(c: Column, lo: float, hi: float) -> Column:
    """Values beyond a bound become the bound; missing stays missing."""
    return F.when(c.isNotNull(), F.greatest(F.lit(float(lo)), F.least(c, F.lit(float(hi)))))


def boxcox(c: Column, lam: float) -> Column:
    return F.log(c) if lam == 0 else (F.pow(c, F.lit(float(lam))) - 1) / float(lam)


def bound(t: Instances) -> tuple[Instances, DataFrame]:
    """Features within median -/+ 5 iqr, and the statistics that bound them."""
    stats = column_stats(t, list(t.features))
    by = {r["name"]: r for r in stats.collect()}
    new = {f: winsorise(F.col(f), by[f]["lo"], by[f]["hi"]) for f in t.features if by[f]["iqr"] is not None}
    return t.with_df(t.df.select(*[new[c].alias(c) if c in new else F.col(c) for c in t.df.columns])), stats


def shifted(c: str, low: float, add: float) -> Column:
    """c - low + add, in this order: add may be tiny."""
    return F.col(c) - F.lit(float(low)) + F.lit(float(add))


class _Ask(Exception):
    """The points that a search wants to know."""


def boxcox_lambdas(df: DataFrame, cols: list[str], shift: dict[str, tuple[float, float]]) -> dict[str, float]:
    """Lambda of each column, shifted to be positive: the one of greatest likelihood, 1 where all values are equal.

    The searches of all columns go on side by side. Each step is one pass over the rows where they are: the points that any of them may ask for next, as sums of powers by
    partition. All searches begin alike, with growing steps up or down, so the points of both ways are in the first pass.
    """
    opening: set[float] = set()
    for sign in (1, -1):
        minimise_1d(lambda x, sign=sign: sign * x, most=14, ahead=opening.update)
    known: dict[str, dict[float, float]] = {c: {} for c in cols}
    found: dict[str, float] = {}

    def search(c: str) -> float:
        def ahead(points: list[float]) -> None:
            if missing := [p for p in points if p not in known[c]]:
                raise _Ask(missing)

        return minimise_1d(known[c].__getitem__, ahead=ahead)

    while True:
        asked = {}
        for c in cols:
            if c not in found:
                try:
                    found[c] = search(c)
                except _Ask as ask:
                    asked[c] = sorted(opening) if not known[c] else list(dict.fromkeys(ask.args[0]))
        if not asked:
            return found

        def moments(batches, asked=asked):
            sums = {(c, k): np.zeros(4) for c, points in asked.items() for k in range(len(points))}
            for batch in batches:
                for c, points in asked.items():
                    x = batch.column(c).drop_null().to_numpy(zero_copy_only=False).astype(float)
                    logs = np.log(x - shift[c][0] + shift[c][1])
                    for k, lam in enumerate(points):
                        sums[c, k] += (len(x), logs.sum(), *power_moments(logs, lam))
            rows = [(c, k, *map(float, v)) for (c, k), v in sums.items()]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*rows, strict=True)], ["name", "k", "n", "logs", "total", "squares"])

        got = df.select(*asked).coalesce(TASKS).mapInArrow(moments, "name string, k long, n double, logs double, total double, squares double")
        sums: dict[tuple[str, int], np.ndarray] = {}
        for name, k, *v in got.collect():  # a row a task, column and point
            sums[name, k] = sums.get((name, k), 0) + np.array(v)
        for (name, k), v in sums.items():
            known[name][asked[name][k]] = boxcox_loss(asked[name][k], *map(float, v))
        for c in asked:  # a column without rows, or with one value, has no likelihood
            if known[c].get(0.0, np.inf) == np.inf:
                found[c] = 1.0
            known[c] |= {lam: np.inf for lam in asked[c] if lam not in known[c]}


def normalise(t: Instances) -> tuple[Instances, DataFrame]:
    """Box-Cox with fitted lambda, then z-scores. Features are shifted to at least 1, performance by its least value over all algorithms.

    Also one row a column: name, low, add, lambda, mean, std.
    """
    cols = [*t.features, *t.algos]
    with held(t.df.select(*cols)) as raw:
        row = raw.agg(*[F.min(c).alias(c) for c in cols]).first()
        low = min((row[a] for a in t.algos if row[a] is not None), default=0.0)
        shift = {c: (row[c] or 0.0, 1.0) for c in t.features} | dict.fromkeys(t.algos, (low, TINY))
        lam = boxcox_lambdas(raw, cols, shift)
        raised = {c: boxcox(shifted(c, *shift[c]), lam.get(c, 1.0)) for c in cols}
        z, moments = zscores(raw.select(*[x.alias(c) for c, x in raised.items()]), cols)
    df = t.df.select(*[raised[c].alias(c) if c in raised else F.col(c) for c in t.df.columns])
    stats = t.df.sparkSession.createDataFrame([(c, *map(float, shift[c]), lam.get(c, 1.0), *moments[c]) for c in cols], "name string, low double, add double, lambda double, mean double, std double")
    return t.with_df(df.select(*[z[c].alias(c) if c in z else F.col(c) for c in df.columns])), stats


def zscores(df: DataFrame, cols: list[str]) -> tuple[dict[str, Column], dict[str, tuple[float | None, float | None]]]:
    """Each column as its z-score (sample deviation; missing where there is none), and mean and deviation, from one aggregate."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"s_{c}") for c in cols]).first()
    moments = {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in cols}
    return {c: F.try_divide(F.col(c) - F.lit(m), F.lit(s)) for c, (m, s) in moments.items()}, moments


def weights(t: Instances) -> DataFrame:
    """iid and w_<algo>: |y - mean of all performance|; zero becomes the least positive weight, missing the largest."""
    total = sum((F.coalesce(F.col(a), F.lit(0.0)) for a in t.algos), F.lit(0.0))
    n = sum((F.col(a).isNotNull().cast("int") for a in t.algos), F.lit(0))
    mean = t.df.agg((F.sum(total) / F.sum(n)).alias("m")).first()["m"] or 0.0
    w = {a: F.abs(F.col(a) - F.lit(mean)) for a in t.algos}
    ends = t.df.agg(*[F.min(F.when(w[a] > 0, w[a])).alias(f"lo_{a}") for a in t.algos], *[F.max(w[a]).alias(f"hi_{a}") for a in t.algos]).first()
    lo = min((ends[f"lo_{a}"] for a in t.algos if ends[f"lo_{a}"] is not None), default=0.0)
    hi = max((ends[f"hi_{a}"] for a in t.algos if ends[f"hi_{a}"] is not None), default=0.0)
    return t.df.select("iid", *[F.coalesce(F.when(w[a] == 0, F.lit(lo)).otherwise(w[a]), F.lit(hi)).alias("w_" + a.removeprefix("algo_")) for a in t.algos])


def colour_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Each column as floor(255 (x - min) / (max - min)) of its own; 0 where all are equal."""
    e = df.agg(*[F.min(c).alias(f"a_{c}") for c in cols], *[F.max(c).alias(f"b_{c}") for c in cols]).first()
    one = lambda c: F.when(F.col(c).isNotNull(), F.coalesce(F.floor(F.try_divide(255 * (F.col(c) - F.lit(e[f"a_{c}"])), F.lit(e[f"b_{c}"]) - F.lit(e[f"a_{c}"]))), F.lit(0)))
    return df.select("iid", *[one(c).cast("long").alias(c) for c in cols])


def colour_global(df: DataFrame, cols: list[str]) -> DataFrame:
    """All columns as round(255 (x - min) / (max - min)) over all of them, halves to even."""
    e = df.agg(*[F.min(c).alias(f"a_{c}") for c in cols], *[F.max(c).alias(f"b_{c}") for c in cols]).first()
    lo = min((e[f"a_{c}"] for c in cols if e[f"a_{c}"] is not None), default=0.0)
    hi = max((e[f"b_{c}"] for c in cols if e[f"b_{c}"] is not None), default=0.0)
    one = lambda c: F.when(F.col(c).isNotNull(), F.coalesce(F.bround(F.try_divide(255 * (F.col(c) - F.lit(lo)), F.lit(hi) - F.lit(lo)), 0), F.lit(0.0)))
    return df.select("iid", *[one(c).cast("long").alias(c) for c in cols])
