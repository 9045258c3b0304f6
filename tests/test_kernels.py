import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terrascape.functions import geometry as geo
from terrascape.functions import learn
from terrascape.functions.numeric import bfgs, boxcox_lambda, critical_r, incomplete_beta, pearson_p


def test_boxcox_makes_lognormal_normal():
    x = np.exp(np.random.default_rng(0).normal(size=4000))
    assert abs(boxcox_lambda(x)) < 0.05
    assert abs(boxcox_lambda(np.abs(np.random.default_rng(1).normal(10, 1, 4000))) - 1) < 0.6


def test_p_values():
    assert incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-10)
    assert pearson_p(0.0, 50) == pytest.approx(1.0)
    assert pearson_p(0.6319, 10) == pytest.approx(0.05, abs=1e-4)
    assert critical_r(10, 0.05) == pytest.approx(0.6319, abs=1e-4)
    assert pearson_p(None, 9) is None and pearson_p(1.0, 9) == 0.0


def test_bfgs_finds_the_minimum():
    def f(x):
        return float((x[0] - 1) ** 2 + 10 * (x[1] + 2) ** 2), np.array([2 * (x[0] - 1), 20 * (x[1] + 2)])

    assert bfgs(f, np.zeros(2))[0] == pytest.approx([1, -2], abs=1e-4)


points = st.lists(st.tuples(st.floats(-5, 5), st.floats(-5, 5)), min_size=3, max_size=40)


@settings(max_examples=40, deadline=None)
@given(points)
def test_hull_holds_all_points(pts):
    ring = geo.convex_hull(pts)
    if ring:
        assert geo.ring_area(ring) > 0
        assert all(geo.cross(a, b, p) >= -1e-9 for a, b in zip(ring, [*ring[1:], ring[0]]) for p in pts)


def test_triangles_cover_the_hull():
    p = np.random.default_rng(3).random((120, 2))
    total = sum(abs(geo.ring_area(p[t])) for t in geo.delaunay(p))
    assert total == pytest.approx(geo.ring_area(geo.convex_hull(p)), rel=1e-9)


def test_clip_and_minus_keep_area():
    a, b = [(0, 0), (2, 0), (2, 2), (0, 2)], [(1, 1), (3, 1), (3, 3), (1, 3)]
    both = sum(map(geo.ring_area, geo.overlap([a], [b])))
    assert both == pytest.approx(1)
    assert sum(map(geo.ring_area, geo.minus([a], [b]))) == pytest.approx(4 - both)


def test_within_leaves_borders_out():
    square = [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], [(0.0, 0.0), (1.0, 1.0), (0.0, 1.0)]]
    assert geo.within(square, [(0.5, 0.5), (0, 0), (1, 0.5), (2, 2)]).tolist() == [True, False, False, False]


def test_clusters_grow_through_border_points():
    x = np.array([[0.0, 0], [0.1, 0], [0.2, 0], [0.3, 0], [0.55, 0], [0.8, 0], [5, 5]])
    assert geo.dbscan(x, 0.26, 3).tolist() == [1, 1, 1, 1, 1, 1, -1]
    assert geo.dbscan(np.zeros((0, 2)), 1.0, 3).tolist() == []


def test_machines_separate_rings():
    g = np.random.default_rng(0)
    x = g.normal(size=(200, 2))
    good = (x**2).sum(1) < 1
    for poly in (False, True):
        m = learn.Machine(x, good, 8.0, 1.0, poly)
        assert (m.predict(x) == good).mean() > 0.95
        assert m.chance(x)[good].mean() > 0.8 > 0.3 > m.chance(x)[~good].mean()


def test_small_learners():
    x = np.vstack([np.random.default_rng(0).normal(c, 0.05, (10, 2)) for c in (0, 3, 6)])
    assert len(set(learn.kmeans(x, 3, 5)[:10])) == 1
    grid = learn.search_grid(30)
    assert grid.min() >= 2**-10 and grid.max() <= 16 and len(np.unique(np.floor((np.log2(grid[:, 0]) + 10) / 14 * 30))) == 30
    best, fit = learn.genetic(lambda c: [-sum(abs(v - 3) for v in s) for s in c], 4, 8, seed=1)
    assert best == (3, 3, 3, 3) and fit == 0
    folds = learn.stratified_folds(np.arange(100) < 20, 5)
    assert all(((folds == f) & (np.arange(100) < 20)).sum() == 4 for f in range(5))
    assert math.isfinite(learn.silhouette(np.random.default_rng(0).random((6, 30)), np.array([0, 0, 1, 1, 2, 2])))


def test_rim_keeps_the_border():
    points = np.random.default_rng(3).random((4000, 2)) * 4
    some = points[geo.rim(points, 1 / 2.15)]
    rings = [sorted(map(sorted, geo.boundary(p, geo.alpha_triangles(p)))) for p in (points, some)]
    assert len(some) < len(points) and rings[0] == rings[1]
