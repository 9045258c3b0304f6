"""Small learners in numpy: kernel machines, k-means, silhouettes and a genetic search."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


def kernel(x: np.ndarray, y: np.ndarray, gamma: float, poly: bool) -> np.ndarray:
    if poly:
        return (gamma * x @ y.T + 1) ** 2
    return np.exp(-gamma * np.maximum(0, (x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T))


def svm_fit(k: np.ndarray, y: np.ndarray, c: np.ndarray, tol: float = 1e-3, most: int = 20_000) -> tuple[np.ndarray, float]:
    """Dual coefficients (with signs) and bias by sequential optimisation of the most violating pair; y in -1, 1; c: bound of each row."""
    n = len(y)
    a, g = np.zeros(n), -np.ones(n)
    for _ in range(most):
        up = ((y > 0) & (a < c)) | ((y < 0) & (a > 0))
        low = ((y > 0) & (a > 0)) | ((y < 0) & (a < c))
        score = -y * g
        if not up.any() or not low.any():
            break
        i, j = int(np.where(up, score, -np.inf).argmax()), int(np.where(low, score, np.inf).argmin())
        if score[i] - score[j] <= tol:
            break
        step = (score[i] - score[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        step = min(step, c[i] - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else c[j] - a[j])
        a[i] += y[i] * step
        a[j] -= y[j] * step
        g += step * y * (k[:, i] - k[:, j])
    up, low = ((y > 0) & (a < c)) | ((y < 0) & (a > 0)), ((y > 0) & (a > 0)) | ((y < 0) & (a < c))
    score = -y * g
    ends = [score[up].max() if up.any() else None, score[low].min() if low.any() else None]
    known = [e for e in ends if e is not None]
    return a * y, float(np.mean(known)) if known else 0.0


class Machine:
    """Support vector machine with a logistic map to probabilities."""

    def __init__(self, x: np.ndarray, good: np.ndarray, c: float, gamma: float, poly: bool = False, weight: np.ndarray | None = None):
        self.gamma, self.poly = gamma, poly
        y = np.where(good, 1.0, -1.0)
        self.constant = None if y.min() < y.max() else float(y[0]) if len(y) else -1.0
        if self.constant is None:
            coef, self.bias = svm_fit(kernel(x, x, gamma, poly), y, c * (np.ones(len(y)) if weight is None else weight / weight.mean()))
            use = np.abs(coef) > 1e-12
            self.x, self.coef = x[use], coef[use]
            self.slope, self.offset = self._logistic(self.margin(x), y)

    @staticmethod
    def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        t = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
        x, w = np.c_[m, np.ones(len(m))], np.zeros(2)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w = w - np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + 1e-6 * np.eye(2), x.T @ (p - t) + 1e-6 * w)
        return float(w[0]), float(w[1])

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.constant) if self.constant is not None else kernel(x, self.x, self.gamma, self.poly) @ self.coef + self.bias

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.margin(x) > 0

    def chance(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), float(self.constant > 0))
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.offset, -30, 30)))


def latin_hypercube(n: int, dims: int, seed: int = 0) -> np.ndarray:
    g = np.random.default_rng(seed)
    return np.stack([(g.permutation(n) + g.random(n)) / n for _ in range(dims)], 1)


def search_grid(n: int = 30, seed: int = 0) -> np.ndarray:
    """n pairs (C, gamma) from 2^-10 to 2^4, one in each of n strips of either."""
    return 2.0 ** (14 * latin_hypercube(n, 2, seed) - 10)


def stratified_folds(good: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    g, out = np.random.default_rng(seed), np.zeros(len(good), int)
    for v in (False, True):
        rows = np.flatnonzero(good == v)
        out[g.permutation(rows)] = np.arange(len(rows)) % k
    return out


def kmeans(x: np.ndarray, k: int, tries: int = 100, most: int = 1000, seed: int = 0) -> np.ndarray:
    """Labels of the best of several runs from spread starts."""
    g, best, loss = np.random.default_rng(seed), np.zeros(len(x), int), np.inf
    for _ in range(tries):
        c = [x[g.integers(len(x))]]
        while len(c) < k:
            d = np.min([((x - m) ** 2).sum(1) for m in c], axis=0)
            c.append(x[g.choice(len(x), p=d / d.sum()) if d.sum() > 0 else g.integers(len(x))])
        c, label = np.array(c), None
        for _ in range(most):
            d = ((x[:, None] - c[None]) ** 2).sum(2)
            new = d.argmin(1)
            if label is not None and (new == label).all():
                break
            label = new
            c = np.array([x[label == j].mean(0) if (label == j).any() else c[j] for j in range(k)])
        total = d.min(1).sum()
        if total < loss - 1e-12:
            best, loss = label, total
    return best


def silhouette(x: np.ndarray, label: np.ndarray) -> float:
    """Mean silhouette of the points with 1 - correlation as distance; 0 for points alone in their cluster."""
    return mean_silhouette(1 - np.corrcoef(x), label)


def mean_silhouette(d: np.ndarray, label: np.ndarray) -> float:
    """The same from distances d."""
    out = []
    for i in range(len(d)):
        own = (label == label[i]) & (np.arange(len(d)) != i)
        if not own.any():
            out.append(0.0)
            continue
        a, b = d[i, own].mean(), min((d[i, label == c].mean() for c in set(label.tolist()) - {label[i]}), default=np.nan)
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))


@dataclass(frozen=True)
class Evolution:
    """How a genetic search goes on. parents: how many mate; selection: tournament, rws (wheel by fitness above the worst), sus (the same with even steps), rank, sss (the best) or random;
    crossover: scattered, uniform, single_point or two_points; mutation: random (a new value), swap, inversion or scramble; stop: saturate_N (N generations without gain) or reach_X."""

    population: int = 50
    generations: int = 100
    parents: int = 2
    selection: str = "tournament"
    tournament: int = 4
    elite: int = 2
    crossover: str = "scattered"
    crossover_chance: float = 0.8
    mutation: str = "random"
    mutation_chance: float = 0.05
    stop: str = "saturate_5"

    def __post_init__(self):
        for value, known in ((self.selection, ("tournament", "rws", "sus", "rank", "sss", "random")), (self.crossover, ("scattered", "uniform", "single_point", "two_points")), (self.mutation, ("random", "swap", "inversion", "scramble"))):
            if value not in known:
                raise ValueError(f"{value!r} is not one of {', '.join(known)}")
        if not re.fullmatch(r"(saturate_[0-9]+|reach_-?[0-9.]+)", self.stop):
            raise ValueError(f"{self.stop!r} is neither saturate_N nor reach_X")

    def mates(self, pop: list[tuple[int, ...]], fit: np.ndarray, g: np.random.Generator) -> list[tuple[int, ...]]:
        """pop: the best first; fit: the fitness of each."""
        n = max(2, self.parents)
        if self.selection == "tournament":
            at = [min(int(i) for i in g.integers(0, len(pop), self.tournament)) for _ in range(n)]
        elif self.selection == "sss":
            at = list(range(min(n, len(pop))))
        elif self.selection == "sus":
            wheel = np.cumsum(fit - fit.min() + 1e-12)
            at = np.minimum(np.searchsorted(wheel, (g.random() + np.arange(n)) / n * wheel[-1], "right"), len(pop) - 1).tolist()
        else:
            weight = {"rws": fit - fit.min() + 1e-12, "rank": np.arange(len(pop), 0, -1.0), "random": np.ones(len(pop))}[self.selection]
            at = [int(i) for i in g.choice(len(pop), n, p=weight / weight.sum())]
        return [pop[i] for i in at]

    def child(self, a: tuple[int, ...], b: tuple[int, ...], high: int, g: np.random.Generator) -> tuple[int, ...]:
        n = len(a)
        if g.random() < self.crossover_chance:
            if self.crossover in ("scattered", "uniform"):
                own = g.random(n) < 0.5
            else:
                cut = np.sort(g.integers(0, n + 1, 2)) if self.crossover == "two_points" else np.array([g.integers(0, n + 1), n])
                own = (np.arange(n) < cut[0]) | (np.arange(n) >= cut[1])
            new = [x if o else y for x, y, o in zip(a, b, own, strict=True)]
        else:
            new = list(a)
        if self.mutation == "random":
            return tuple(int(g.integers(0, high)) if g.random() < self.mutation_chance else v for v in new)
        if n > 1 and g.random() < self.mutation_chance:
            i, j = sorted(int(v) for v in g.choice(n, 2, replace=False))
            if self.mutation == "swap":
                new[i], new[j] = new[j], new[i]
            else:
                part = new[i : j + 1]
                new[i : j + 1] = part[::-1] if self.mutation == "inversion" else [part[int(k)] for k in g.permutation(len(part))]
        return tuple(new)


def genetic(fitness: Callable[[list[tuple[int, ...]]], list[float]], genes: int, high: int, evolution: Evolution = Evolution(), seed: int = 0) -> tuple[tuple[int, ...], float]:
    """Maximises fitness of whole-number genes below high. fitness is asked for a whole generation at once, so it can be worked out in parallel."""
    g, known = np.random.default_rng(seed), {}
    pop = [tuple(int(v) for v in r) for r in g.integers(0, high, (evolution.population, genes))]
    kind, _, bound = evolution.stop.partition("_")
    top, stale = -np.inf, 0
    for _ in range(evolution.generations):
        fresh = sorted(set(pop) - known.keys())
        known.update(zip(fresh, fitness(fresh), strict=True)) if fresh else None
        pop.sort(key=lambda s: (-known[s], s))
        stale = 0 if known[pop[0]] > top else stale + 1
        top = max(top, known[pop[0]])
        if kind == "saturate" and stale >= int(bound) or kind == "reach" and top >= float(bound):
            break
        mates = evolution.mates(pop, np.array([known[s] for s in pop]), g)
        following = pop[: evolution.elite]
        while len(following) < evolution.population:
            a, b = (mates[int(i)] for i in g.integers(0, len(mates), 2))
            following.append(evolution.child(a, b, high, g))
        pop = following
    best = max(known, key=lambda s: (known[s], tuple(-v for v in s)))
    return best, known[best]


def bayes_search(score: Callable[[float, float], float], n: int = 30, seed: int = 0, first: int = 10) -> tuple[float, float]:
    """The best of n pairs (C, gamma) from 2^-10 to 2^4 under score: `first` of a latin hypercube, then one after the other where a Gaussian process over the
    logarithms expects the largest improvement, among 512 places of a hypercube of each step."""
    x = latin_hypercube(min(first, n), 2, seed)
    y = np.array([score(*2.0 ** (14 * p - 10)) for p in x])
    like = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(2) / (2 * 0.2**2))
    for step in range(len(x), n):
        places = latin_hypercube(512, 2, seed + step)
        scale = y.std() or 1.0
        solve = np.linalg.solve(like(x, x) + 1e-3 * np.eye(len(x)), np.c_[(y - y.mean()) / scale, like(x, places)])
        across = like(places, x)
        mean, dev = across @ solve[:, 0], np.sqrt(np.maximum(1e-12, 1 - np.einsum("ij,ji->i", across, solve[:, 1:])))
        gain = mean - (y.max() - y.mean()) / scale
        z = gain / dev
        tail = np.array([0.5 * math.erfc(-v / 2**0.5) for v in z])
        best = places[int(np.argmax(gain * tail + dev * np.exp(-z * z / 2) / (2 * np.pi) ** 0.5))]
        x, y = np.vstack([x, best]), np.r_[y, score(*2.0 ** (14 * best - 10))]
    c, gamma = 2.0 ** (14 * x[int(y.argmax())] - 10)
    return float(c), float(gamma)
