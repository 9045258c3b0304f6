"""Good and best labels of algorithms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.metadata import Instances

#: Stands for zero in relative measures.
TINY = 2.220446049250313e-16


@dataclass(frozen=True)
class Performance:
    """max_perf: larger is better; abs_perf: epsilon is a threshold, else a share of the best; beta: share of good algorithms of easy instances."""

    max_perf: bool = False
    abs_perf: bool = True
    epsilon: float = 0.2
    beta: float = 0.55


def best_value(algos: tuple[str, ...], larger: bool) -> Column:
    if len(algos) == 1:
        return F.col(algos[0])
    return F.greatest(*algos) if larger else F.least(*algos)


def nonzero(c: Column) -> Column:
    return F.when(c == 0, F.lit(TINY)).otherwise(c)


def relative(y: Column, best: Column, larger: bool) -> Column:
    """1 - y / best, or 1 - best / y where less is better."""
    return 1 - nonzero(y) / nonzero(best) if larger else 1 - nonzero(best) / nonzero(y)


def is_good(a: str, perf: Performance, best: Column | None = None) -> Column:
    """Missing performance is not good."""
    y = F.col(a)
    if perf.abs_perf:
        good = y >= perf.epsilon if perf.max_perf else y <= perf.epsilon
    else:
        good = relative(y, F.col("y_best") if best is None else best, perf.max_perf) <= perf.epsilon
    return F.coalesce(good, F.lit(False))


def good_name(a: str) -> str:
    return "good_" + a.removeprefix("algo_")


def label(t: Instances, perf: Performance) -> Instances:
    """Adds y_best, p (1-based first best, 0 if none), good_<algo>, n_good, beta. All in one projection, without a shuffle."""
    df = t.df.withColumn("y_best", best_value(t.algos, perf.max_perf))
    df = df.withColumn("p", F.coalesce(F.array_position(F.array(*t.algos), F.col("y_best")), F.lit(0)).cast("int"))
    df = df.select("*", *[is_good(a, perf).alias(good_name(a)) for a in t.algos])
    n_good = sum((F.col(good_name(a)).cast("int") for a in t.algos), F.lit(0))
    df = df.withColumn("n_good", n_good).withColumn("beta", F.col("n_good") > F.lit(perf.beta * len(t.algos)))
    return t.with_df(df)


def relative_values(t: Instances, larger: bool) -> Instances:
    """Performance as its distance from the best of the row."""
    best = best_value(t.algos, larger)
    new = {a: relative(F.col(a), best, larger) for a in t.algos}
    return t.with_df(t.df.select(*[new[c].alias(c) if c in new else F.col(c) for c in t.df.columns]))


def tie_percentage(t: Instances) -> DataFrame:
    """One row: pct of labelled rows on which several algorithms are best."""
    ties = sum((F.coalesce((F.col(a) == F.col("y_best")).cast("int"), F.lit(0)) for a in t.algos), F.lit(0))
    return t.df.agg(F.round(F.avg((ties > 1).cast("double")) * 100).alias("pct"))


def portfolio(t: Instances) -> DataFrame:
    """How often each algorithm is best: p, algo, n, n_beta (easy instances), mean_best."""
    names = F.element_at(F.array(F.lit("none"), *[F.lit(a) for a in t.algos]), F.col("p") + 1)
    return t.df.groupBy("p", names.alias("algo")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("beta").cast("long")).alias("n_beta"), F.avg("y_best").alias("mean_best"))
