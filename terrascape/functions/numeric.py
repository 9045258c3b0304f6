"""One-dimensional search for Box-Cox, Student's t tail, BFGS."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def minimise_1d(f: Callable[[float], float], start: float = 0.0, step: float = 0.00025, tol: float = 1e-4, most: int = 200, ahead: Callable[[list[float]], None] = lambda points: None) -> float:
    """Downhill simplex of two points: reflection, expansion, contraction, shrinking; ends when points and values are within tol. ahead: told the points that a step may ask for."""
    ahead([start, start + step])
    pts = sorted([(f(start), start), (f(start + step), start + step)])
    for _ in range(most):
        (fb, b), (fw, w) = pts
        if abs(w - b) <= tol and abs(fw - fb) <= tol:
            break
        r, e, out, into = 2 * b - w, 3 * b - 2 * w, 1.5 * b - 0.5 * w, 0.5 * b + 0.5 * w
        ahead([r, e, out, into, b + 0.5 * (w - b)])
        fr = f(r)
        if fr < fb:
            fe = f(e)
            new = (fe, e) if fe < fr else (fr, r)
        else:
            c = out if fr < fw else into
            fc = f(c)
            new = (fc, c) if (fc <= fr if fr < fw else fc < fw) else (f(b + 0.5 * (w - b)), b + 0.5 * (w - b))
        pts = sorted([(fb, b), new], key=lambda p: p[0])
    return pts[0][1]


def power_moments(logs: np.ndarray, lam: float) -> tuple[float, float]:
    """Sum and sum of squares of x^lam / lam, less a constant, from the logarithms of x (the logarithms themselves at 0)."""
    with np.errstate(all="ignore"):
        y = logs if lam == 0 else np.expm1(lam * logs) / lam
        return float(y.sum()), float((y * y).sum())


def boxcox_loss(lam: float, n: int, logs: float, total: float, squares: float) -> float:
    """Minus the log likelihood of lambda for n positive values: logs is the sum of their logarithms, total and squares are their power_moments."""
    var = squares / n - (total / n) ** 2 if n else 0.0
    return math.inf if not var > 0 or not math.isfinite(var) else -((lam - 1) * logs - n / 2 * math.log(var))


def boxcox_lambda(x: np.ndarray) -> float:
    """Lambda of greatest likelihood for positive values."""
    logs = np.log(np.asarray(x, float))
    return minimise_1d(lambda lam: boxcox_loss(lam, len(logs), float(logs.sum()), *power_moments(logs, lam)))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated forwards."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / (c if abs(c) > tiny else tiny)
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def pearson_p(r: float | None, n: int) -> float | None:
    """Two-sided p-value of a correlation r of n pairs."""
    if r is None or n is None or n < 3 or not math.isfinite(r):
        return None
    if abs(r) >= 1:
        return 0.0
    t2 = r * r * (n - 2) / (1 - r * r)
    return incomplete_beta((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def critical_r(n: int, p: float) -> float:
    """The least |r| of n pairs whose p-value is at most p."""
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if (pearson_p(mid, n) or 0.0) <= p else (mid, hi)
    return hi


def bfgs(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, most: int = 1000, tol: float = 1e-5) -> tuple[np.ndarray, float]:
    """Quasi-Newton minimisation; f gives value and gradient."""
    x, n = x.astype(float), len(x)
    h, (v, g) = np.eye(n), f(x)
    for it in range(most):
        if np.abs(g).max() <= tol:
            break
        d = -h @ g
        slope = g @ d
        if slope >= 0:
            h, d = np.eye(n), -g
            slope = g @ d
        a = 1.0
        while True:
            y = x + a * d
            vy, gy = f(y)
            if vy <= v + 1e-4 * a * slope or a < 1e-12:
                break
            a /= 2
        s, q = y - x, gy - g
        x, v, g = y, vy, gy
        sq = s @ q
        if sq > 1e-12:
            if it == 0:
                h *= sq / (q @ q)
            left = np.eye(n) - np.outer(s, q) / sq
            h = left @ h @ left.T + np.outer(s, s) / sq
        if a < 1e-12:
            break
    return x, float(v)
