"""Projection of instances to two dimensions, from the Gram matrix of their columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import bfgs
from ..session import durable
from ..sources.metadata import Instances

#: Lanes that rows are dealt to for comparing all pairs; each two lanes are a task.
LANES = 24


@dataclass(frozen=True)
class Projection:
    """z = x A'; xhat = z B', yhat = z C'. error: summed squares of what is lost; r2 by column; alpha, starts, losses and scores of numeric trials."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    features: tuple[str, ...]
    algos: tuple[str, ...]
    error: float
    r2: np.ndarray
    alpha: np.ndarray | None = None
    starts: np.ndarray | None = None
    losses: np.ndarray | None = None
    scores: np.ndarray | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        """Adds z_1, z_2 by column arithmetic."""
        z = [sum((F.col(f) * F.lit(float(w)) for f, w in zip(self.features, row, strict=True)), F.lit(0.0)) for row in self.a]
        return df.select("*", z[0].alias("z_1"), z[1].alias("z_2"))

    def summary(self, spark) -> DataFrame:
        return spark.createDataFrame([(f"Z_{{{k + 1}}}", *map(float, row)) for k, row in enumerate(self.a)], "Row string, " + ", ".join(f"`{f}` double" for f in self.features))


def gram(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Products, sums and number of rows without missing values, by one aggregate pass; its size depends on the columns alone."""
    full = df.where(F.coalesce(*[F.when(F.col(c).isNull(), True) for c in cols]).isNull())
    aggs = [F.sum(F.col(a) * F.col(b)).alias(f"g{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i]
    row = full.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)], *aggs).first()
    m = len(cols)
    g = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(m)] for i in range(m)])
    return g, np.array([row[f"s{i}"] or 0.0 for i in range(m)]), row["n"]


def _finish(g: np.ndarray, s: np.ndarray, n: int, a: np.ndarray, bc: np.ndarray, t: Instances, **more) -> Projection:
    f = len(t.features)
    w = bc @ a
    lost = g - 2 * (g[:, :f] @ w.T) + w @ g[:f, :f] @ w.T
    error = float(np.trace(lost))
    # r2 by column: squared correlation of x and xhat, from the same sums
    mean, fit = s / n, w @ s[:f] / n
    cov = np.einsum("ij,ij->i", w, g[:, :f]) / n - mean * fit
    vx, vf = np.diag(g) / n - mean**2, np.einsum("ij,jk,ik->i", w, g[:f, :f], w) / n - fit**2
    r2 = np.divide(cov**2, vx * vf, out=np.zeros(len(g)), where=vx * vf > 1e-300)
    return Projection(a, bc[:f], bc[f:], t.features, t.algos, error, r2, **more)


def analytic(t: Instances) -> Projection:
    """The two leading eigenvectors of the Gram matrix of features and algorithms; A solves the features' normal equations."""
    g, s, n = gram(t.df, [*t.features, *t.algos])
    f = len(t.features)
    values, vectors = np.linalg.eigh(g)
    v = -vectors[:, np.argsort(-np.abs(values))[:2]]
    a = np.linalg.lstsq(g[:f, :f], (v.T @ g[:, :f]).T, rcond=None)[0].T
    return _finish(g, s, n, a, v, t)


def topology(df: DataFrame, t: Instances, planes: list[np.ndarray], block: int = 1000) -> np.ndarray:
    """For each projection (2 x F) the correlation of distances in full space and in the projection, over all pairs of rows without missing values.

    Equal rows are one row with its count. Rows are dealt to at most LANES lanes of equal size; a task has two lanes and compares their rows, packed into
    blocks of at most `block`, giving moments of both distances, which are added. A row is sent as often as there are lanes, however many rows there are; the work
    grows with the square of the number of distinct rows, a task's memory with a lane's share of them.
    """
    cols, f = [*t.features, *t.algos], len(t.features)
    full = df.where(F.coalesce(*[F.when(F.col(c).isNull(), True) for c in cols]).isNull()).select(*[F.col(c).cast("double") for c in cols])
    mean = np.array([v or 0.0 for v in full.agg(*[F.avg(c) for c in cols]).first()])
    rows = durable(full.groupBy(*cols).agg(F.count(F.lit(1)).cast("double").alias("_n")))
    lanes = max(1, min(-(-rows.count() // block), LANES))

    def pack(batches):
        lane = TaskContext.get().partitionId()
        for pdf in batches:
            x = pdf.to_numpy(float)
            x[:, :-1] -= mean
            for i in range(0, len(x), block):
                yield pd.DataFrame({"lane": [lane], "x": [np.ascontiguousarray(x[i : i + block]).tobytes()]})

    def moments(batches):
        held = {}
        for pdf in batches:
            for i, j, lane, x in zip(pdf["i"], pdf["j"], pdf["lane"], pdf["x"], strict=True):
                held.setdefault((i, j), {}).setdefault(lane, []).append(np.frombuffer(x).reshape(-1, len(cols) + 1))
        out = []
        for (i, j), of in held.items():
            left, right = of.get(i, []), of.get(j, [])
            for k, x in enumerate(left):
                for m in range(k if i == j else 0, len(right)):
                    out += _moments(x, right[m], planes, f, i == j and k == m)
            out = [(c, *np.sum([r[1:] for r in out if r[0] == c], axis=0)) for c in range(len(planes))] if out else []
        yield pd.DataFrame(out, columns=["c", *"nuvpqr"])

    blocks = durable(rows.repartition(lanes).mapInPandas(pack, "lane int, x binary"))
    got = _meet(blocks, lanes).mapInPandas(moments, "c int, n double, u double, v double, p double, q double, r double")
    out = np.full(len(planes), np.nan)
    for row in got.groupBy("c").agg(*[F.sum(k).alias(k) for k in "nuvpqr"]).collect():
        c, n, u, v, p, q, r = row
        vx, vz = p / n - (u / n) ** 2 if n else 0.0, q / n - (v / n) ** 2 if n else 0.0
        if n > 2 and vx > 0 and vz > 0:
            out[c] = (r / n - u / n * v / n) / (vx * vz) ** 0.5
    return out


def _meet(blocks: DataFrame, lanes: int) -> DataFrame:
    """i, j, lane, x: the blocks of lanes i and j (i up to j) for each two lanes and each with itself, a partition a pair. Each block is there `lanes` times."""
    i, j = F.least("lane", "other"), F.greatest("lane", "other")
    sent = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("other")).select(i.alias("i"), j.alias("j"), "lane", "x")
    return sent.repartitionById(lanes * (lanes + 1) // 2, (F.col("j") * (F.col("j") + 1) / 2 + F.col("i")).cast("int"))


def _moments(x: np.ndarray, y: np.ndarray, planes: list[np.ndarray], f: int, same: bool, strip: int = 64) -> list[tuple]:
    """(plane, pairs, sums of both distances, of their squares and of their products) of rows of x with rows of y, whose last column is their count; same: of one block, each two rows once."""
    wx, wy, half = x[:, -1], y[:, -1], 0.5 if same else 1.0
    pairs = wx.sum() * (wx.sum() - 1) / 2 if same else wx.sum() * wy.sum()
    flat = [(np.ascontiguousarray((x[:, :f] @ a.T).T), np.ascontiguousarray((y[:, :f] @ a.T).T)) for a in planes]
    tall = np.ascontiguousarray(x[:, :-1].T), np.ascontiguousarray(y[:, :-1].T)
    sums = np.zeros((len(planes), 5))
    for k in range(0, len(x), strip):
        w = wx[k : k + strip] * half
        far = _squared(tall[0][:, k : k + strip], tall[1])
        p = w @ (far @ wy)
        np.sqrt(far, out=far)
        u = w @ (far @ wy)
        for c, (a, b) in enumerate(flat):
            near = _squared(a[:, k : k + strip], b)
            q = w @ (near @ wy)
            np.sqrt(near, out=near)
            v = w @ (near @ wy)
            near *= far
            sums[c] += u, v, p, q, w @ (near @ wy)
    return [(c, pairs, *row) for c, row in enumerate(sums)]


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of y, both given by columns."""
    total = np.zeros((x.shape[1], y.shape[1]))
    apart = np.empty_like(total)
    for a, b in zip(x, y, strict=True):
        np.subtract(a[:, None], b[None, :], out=apart)
        apart *= apart
        total += apart
    return total


def numeric(t: Instances, tries: int = 5, seed: int = 0, alpha: np.ndarray | None = None, starts: np.ndarray | None = None) -> Projection:
    """Least squares over A and B with C by BFGS from random starts; of all trials the one that keeps distances best. Loss and gradient need the
    Gram matrix only, so steps don't depend on the number of rows. alpha: a solution to use as it is; starts: columns of starting points."""
    g, s, n = gram(t.df, [*t.features, *t.algos])
    f, m = len(t.features), len(g)
    gx, gxx = g[:, :f], g[:f, :f]
    split = lambda v: (v[: 2 * f].reshape(2, f), v[2 * f :].reshape(m, 2))

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        a, b = split(v)
        w = b @ a
        dw = 2 * (w @ gxx - gx) / (n * m)
        value = (np.trace(g) - 2 * np.sum(gx * w) + np.sum((w @ gxx) * w)) / (n * m)
        return float(value), np.concatenate([(b.T @ dw).ravel(), (dw @ a.T).ravel()])

    if alpha is not None:
        return _finish(g, s, n, *split(np.asarray(alpha, float).ravel()), t, alpha=np.asarray(alpha).reshape(-1, 1))
    if starts is None:
        starts = 2 * np.random.default_rng(seed).random((2 * m + 2 * f, tries)) - 1
    found = [bfgs(loss, starts[:, k]) for k in range(starts.shape[1])]
    scores = topology(t.df, t, [split(x)[0] for x, _ in found])
    best = int(np.nanargmax(scores)) if np.isfinite(scores).any() else int(np.argmin([v for _, v in found]))
    return _finish(g, s, n, *split(found[best][0]), t, alpha=np.stack([x for x, _ in found], 1), starts=starts, losses=np.array([v for _, v in found]), scores=scores)
