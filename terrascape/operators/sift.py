"""Feature selection: by correlation, then one feature of each cluster of like features by a genetic search."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions.learn import Evolution, genetic, kmeans, mean_silhouette
from ..sources.metadata import Instances
from .correlate import select_by_correlation
from .label import good_name
from .project import gram


class NotEnoughFeatureError(ValueError):
    """Selection needs more than one feature."""


@dataclass(frozen=True)
class Sifted:
    table: Instances
    chosen: tuple[str, ...]
    labels: dict[str, int] = field(default_factory=dict)
    silhouettes: tuple[float, ...] = ()
    fitness: float | None = None


def feature_points(g: np.ndarray) -> np.ndarray:
    """The features as points with the inner products g, so with the distances that their columns have over all rows."""
    values, vectors = np.linalg.eigh(g)
    return vectors * np.sqrt(np.maximum(values, 0))


def feature_clusters(g: np.ndarray, k: int, tries: int = 100, most: int = 1000, seed: int = 0) -> np.ndarray:
    """Features are the points; g: their Gram matrix."""
    return kmeans(feature_points(g), k, tries, most, seed)


def silhouette_sweep(g: np.ndarray, s: np.ndarray, n: int, tries: int = 20, seed: int = 0) -> list[float]:
    """Silhouette of clusterings with k = 2 ... F - 1, from products, sums and number of rows."""
    cov = g / n - np.outer(s, s) / n**2
    d = 1 - cov / np.sqrt(np.outer(np.diag(cov), np.diag(cov)))
    return [mean_silhouette(d, feature_clusters(g, k, tries, seed=seed)) for k in range(2, len(g))]


def project_features(g: np.ndarray, f: int) -> np.ndarray:
    """Two-dimensional projection (2 x f) by the leading eigenvectors; g: Gram matrix of f features and the algorithms."""
    values, vectors = np.linalg.eigh(g)
    v = -vectors[:, np.argsort(-np.abs(values))[:2]]
    return np.linalg.lstsq(g[:f, :f], g[:f] @ v, rcond=None)[0].T


_NEAR = "near array<struct<d: double, id: long, y: array<double>>>"


def _nearest(q: pd.DataFrame, p: pd.DataFrame, k: int) -> list[list[dict]]:
    """The k rows of p (in iid order) nearest to each row of q, of other folds."""
    z, fold, ids, ys, out = p[["z_1", "z_2"]].to_numpy(), p["fold"].to_numpy(), p["iid"].tolist(), p["y"].tolist(), []
    for i in range(0, len(q), 512):
        part = q.iloc[i : i + 512]
        d = ((part[["z_1", "z_2"]].to_numpy()[:, None] - z[None]) ** 2).sum(2)
        d[part["fold"].to_numpy()[:, None] == fold[None]] = np.inf
        at = np.argsort(d, axis=1, kind="stable")[:, :k]
        out += [[{"d": float(d[r, j]), "id": ids[j], "y": ys[j]} for j in js if np.isfinite(d[r, j])] for r, js in enumerate(at)]
    return out


def knn_errors(t: Instances, n: int, planes: list[np.ndarray], k: int = 3, folds: int = 5, strip: int = 1000) -> list[float]:
    """For each projection of the features (2 x F) the largest, over the algorithms, error of the k nearest rows of other folds: the share of rows whose good
    label most of them don't have, or, in a table without labels, the mean squared error of their mean performance.

    All n rows of t are judged, none with a missing value. A projection is cut into strips of about `strip` rows. Rows ask their own strip, then
    those that their k-th distance reaches into.
    """
    feats, algos, cuts = list(t.features), list(t.algos), -(-n // strip)
    labelled = all(good_name(a) in t.df.columns for a in algos)
    target = [F.coalesce(F.col(good_name(a)), F.lit(False)).cast("double").alias(a) if labelled else F.col(a) for a in algos]
    edges = [np.zeros(0)] * len(planes)
    if cuts > 1:
        z = [sum((F.col(c) * F.lit(float(w)) for c, w in zip(feats, a[0], strict=True)), F.lit(0.0)) for a in planes]
        at = [i / cuts for i in range(1, cuts)]
        edges = [np.unique(e) for e in t.df.agg(*[F.percentile_approx(c, at, max(10_000, 20 * cuts)).alias(f"e{i}") for i, c in enumerate(z)]).first()]

    def place(batches):
        for pdf in batches:
            x, y = pdf[feats].to_numpy(float), pdf[algos].to_numpy(float)
            for c, a in enumerate(planes):
                z = (x[:, None] * a[None]).sum(2)
                yield pd.DataFrame({"cand": c, "strip": np.searchsorted(edges[c], z[:, 0], "right"), "iid": pdf["iid"], "fold": pdf["fold"], "z_1": z[:, 0], "z_2": z[:, 1], "y": list(y)})

    def own(pdf):
        pdf, edge = pdf.sort_values("iid", ignore_index=True), edges[int(pdf["cand"].iloc[0])]
        near = _nearest(pdf, pdf, k)
        reach = np.array([np.sqrt(r[-1]["d"]) * (1 + 1e-9) if len(r) == k else np.inf for r in near])
        return pdf.assign(near=near, lo=np.searchsorted(edge, pdf["z_1"] - reach, "right"), hi=np.searchsorted(edge, pdf["z_1"] + reach, "right"))

    def others(q, p):
        near = _nearest(q, p.sort_values("iid", ignore_index=True), k) if len(p) else [[] for _ in range(len(q))]
        return q[["cand", "iid"]].assign(near=near)

    placed = t.df.select("iid", *feats, *target, F.pmod(F.xxhash64("iid"), F.lit(min(folds, max(n, 1)))).cast("int").alias("fold"))
    placed = placed.mapInPandas(place, row := "cand int, strip int, iid long, fold int, z_1 double, z_2 double, y array<double>")
    first = placed.groupBy("cand", "strip").applyInPandas(own, f"{row}, {_NEAR}, lo int, hi int").persist()
    found = first.select("cand", "iid", "fold", "y", "near")
    if cuts > 1:
        asks = first.select("cand", "iid", "fold", "z_1", "z_2", F.col("strip").alias("mine"), F.explode(F.sequence("lo", "hi")).alias("strip")).where("strip != mine")
        more = asks.groupBy("cand", "strip").cogroup(placed.groupBy("cand", "strip")).applyInPandas(others, f"cand int, iid long, {_NEAR}")
        found = found.unionByName(more, allowMissingColumns=True).groupBy("cand", "iid").agg(F.max("fold").alias("fold"), F.max("y").alias("y"), F.flatten(F.collect_list("near")).alias("near"))
    found = found.select("cand", "fold", "y", F.slice(F.sort_array("near"), 1, k).alias("near")).where(F.size("near") > 0)
    guess = lambda j: F.aggregate("near", F.lit(0.0), lambda total, r: total + r["y"][j]) / F.size("near")
    lost = lambda j: ((guess(j) > 0.5) != (F.col("y")[j] > 0.5)).cast("double") if labelled else F.pow(guess(j) - F.col("y")[j], F.lit(2.0))
    loss = found.groupBy("cand", "fold").agg(*[F.avg(lost(j)).alias(f"l{j}") for j in range(len(algos))])
    worst = F.greatest(F.lit(0.0), *[F.avg(f"l{j}") for j in range(len(algos))])
    got = {r["cand"]: r["worst"] for r in loss.groupBy("cand").agg(worst.alias("worst")).collect()}
    first.unpersist()
    return [got.get(c, np.inf) for c in range(len(planes))]


def sift(t: Instances, rho: float = 0.1, p: float = 0.05, k: int = 6, tries: int = 100, most: int = 1000, evolution: Evolution = Evolution(), seed: int = 0) -> Sifted:
    """Correlation first; with more than three features left, and more than k, clusters and the search. Clusters and projections come from the Gram matrix; candidates of a generation are judged together over all full rows, equal ones once."""
    if len(t.features) <= 1:
        raise NotEnoughFeatureError("There must be more than one feature")
    if len(t.features) <= 3:
        return Sifted(t, t.features)
    t = t.keep(features=select_by_correlation(t, rho, p))
    if len(t.features) <= 1:
        raise NotEnoughFeatureError("Correlation leaves fewer than two features")
    if len(t.features) <= max(3, k):
        return Sifted(t, t.features)
    cols, f = [*t.features, *t.algos], len(t.features)
    full = t.with_df(t.df.where(F.coalesce(*[F.when(F.col(c).isNull(), True) for c in cols]).isNull()).select("iid", *cols, *[c for c in map(good_name, t.algos) if c in t.df.columns]).persist())
    g, s, n = gram(full.df, cols)
    label = feature_clusters(g[:f, :f], k, tries, most, seed)
    groups = [np.flatnonzero(label == c) for c in range(k) if (label == c).any()]
    known: dict[tuple[int, ...], float] = {}

    def judge(candidates: list[tuple[int, ...]]) -> list[float]:
        sets = [tuple(sorted({int(o[v % len(o)]) for v, o in zip(genes, groups, strict=True)})) for genes in candidates]
        if fresh := sorted(set(sets) - known.keys()):
            planes = []
            for some in fresh:
                a, own = np.zeros((2, f)), list(some)
                use = [*own, *range(f, len(cols))]
                a[:, own] = project_features(g[np.ix_(use, use)], len(own))
                planes.append(a)
            known.update(zip(fresh, knn_errors(full, n, planes), strict=True))
        return [-known[c] for c in sets]

    genes, fitness = genetic(judge, len(groups), int(max(map(len, groups))) * 1000, evolution, seed)
    picked = {t.features[int(g[v % len(g)])] for v, g in zip(genes, groups, strict=True)}
    chosen = tuple(f for f in t.features if f in picked)
    sweep = tuple(silhouette_sweep(g[:f, :f], s[:f], n, seed=seed))
    full.df.unpersist()
    return Sifted(t.keep(features=list(chosen)), chosen, dict(zip(t.features, map(int, label), strict=True)), sweep, fitness)


