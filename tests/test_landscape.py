import json
import random
import struct
import threading
import zlib

import numpy as np
import pytest

from terrascape.functions import geometry as geo
from terrascape.functions import learn
from terrascape.operators import clean, footprints, label, project, sift, subset
from terrascape.operators.label import Performance
from terrascape.plans.landscape import DEFAULT_STAGES, Landscape, Choosing, Preprocessing, Mapping, from_directory
from terrascape.plans.stage import Stage, StageBuilder, StageResolutionError, StageRunner, StageRunningError
from terrascape.sources import metadata, options


def make(spark, rows, feats=2, algos=2):
    cols = ["Instances", *[f"feature_{i}" for i in range(feats)], *[f"algo_{i}" for i in range(algos)]]
    kinds = "Instances string, " + ", ".join(f"{c} double" for c in cols[1:])
    df = spark.createDataFrame([(f"i{k}", *r) for k, r in enumerate(rows)], kinds)
    return metadata.from_dataframe(df.coalesce(1))


def test_missing_rows_and_sparse_features(spark):
    nan = float("nan")
    t = make(spark, [(1.0, nan, 1.0, 2.0), (nan, nan, 1.0, 2.0), (3.0, nan, nan, nan), (4.0, 5.0, 1.0, nan)])
    t = clean.drop_missing_rows(t)
    assert sorted(r.instances for r in t.df.collect()) == ["i0", "i3"]
    assert clean.drop_sparse_features(t).features == ("feature_0",)


def test_labels(spark):
    t = label.label(make(spark, [(0.0, 0.0, 1.0, 1.0), (0.0, 0.0, 3.0, 2.0), (0.0, 0.0, None, 9.0), (0.0, 0.0, None, None)]), Performance(epsilon=2.0))
    got = {r.instances: (r.p, r.n_good, r.beta) for r in t.df.collect()}
    assert got == {"i0": (1, 2, True), "i1": (2, 1, False), "i2": (2, 0, False), "i3": (0, 0, False)}


def test_one_algorithm(spark):
    t = label.label(make(spark, [(0.0, 0.0, 1.0)], algos=1), Performance(epsilon=2.0))
    assert t.df.first().y_best == 1.0


def test_thinning_is_greedy(spark):
    g = random.Random(4)
    rows = [(g.random() * 2, g.random() * 2, g.random(), g.random()) for _ in range(60)]
    t = label.label(make(spark, rows), Performance(epsilon=0.6))
    for kind in subset.TYPES:
        removed, near = set(), set()
        for i, x in enumerate(rows):
            for j in range(i + 1, len(rows)):
                if i in removed:
                    break
                y = rows[j]
                if ((x[0] - y[0]) ** 2 + (x[1] - y[1]) ** 2) ** 0.5 <= 0.3:
                    near.add(j)
                    both = all(v <= 0.6 for v in (*x[2:], *y[2:]))
                    close = ((x[2] - y[2]) ** 2 + (x[3] - y[3]) ** 2) ** 0.5 <= 0.3
                    if {"Ftr": True, "Ftr&AP": close, "Ftr&Good": both, "Ftr&AP&Good": both and close}[kind]:
                        removed.add(j)
        got = {r.iid: r for r in subset.thin(t, 0.3, kind).collect()}
        order = sorted(got)
        assert {k for k, i in enumerate(order) if got[i].removed} == removed
        assert {k for k, i in enumerate(order) if not got[i].dissimilar} == near
    with pytest.raises(ValueError):
        subset.close_pairs(t, 0.3, "Ftr&&Good")


def test_thinning_of_long_chains(spark):
    t = make(spark, [(k * 0.25, 0.0, 0.0, 0.0) for k in range(2500)])  # each is close to its neighbours only
    order = sorted((r.iid, r.removed, r.dissimilar) for r in subset.thin(t, 0.3, pairs_a_task=1000).collect())
    assert [r[1:] for r in order] == [(k % 2 == 1, k % 2 == 0) for k in range(2500)]


def test_subsets(spark):
    t = make(spark, [(float(i), 0.0, 1.0, 1.0) for i in range(21)])
    assert subset.fractional(t, 0.5).df.count() == 11
    rows = spark.createDataFrame([(1,), (21,), (0,), (99,), (21,)], "row long")
    assert sorted(r.instances for r in subset.by_index(t, rows).df.collect()) == ["i0", "i20"]


def test_options(tmp_path):
    o = options.from_dict({"perf": {"MaxPerf": True, "_": "note"}, "selvars": {"type": "Ftr"}, "pythia": {"UseLibSVM": True}})
    assert o.perf.max_perf and o.selvars.selvars_type == "Ftr" and o.pythia.use_grid_search and o.sifted.k == 6
    with pytest.raises(ValueError, match="more than once"):
        options.from_dict({"pilot": {"ntries": 3, "n_tries": 4}})
    with pytest.raises(ValueError):
        options.from_dict({"pilot": {"nope": 3}})
    with pytest.raises(ValueError):
        options.from_dict({"other": {}})
    assert options.from_json(tmp_path / "none.json") is None
    (tmp_path / "bad.json").write_text("{")
    assert options.from_json(tmp_path / "bad.json") is None


class A(Stage):
    inputs, outputs = ("x",), ("y",)

    def run(self, x):
        return {"y": x + 1}


class B(Stage):
    inputs, outputs = ("y",), ("y", "z")

    def run(self, y):
        return {"y": y * 10, "z": y}


class C(Stage):
    inputs, outputs = ("y",), ("w",)

    def run(self, y):
        return {"w": y}


def test_stages():
    waves = StageBuilder().add_stage(C).add_stage(B).add_stage(A).resolve({"x"})
    assert waves == [[A], [B], [C]]
    r = StageRunner(waves, {"x": 1})
    assert r.run_all()["w"] == 20
    assert r.run_stage(A, x=4) == {"y": 5}
    with pytest.raises(StageRunningError):
        r.run_stage(C)
    assert r.run_until_stage(B)["z"] == 5
    with pytest.raises(StageResolutionError):
        StageBuilder().add_stage(C).resolve({"x"})
    with pytest.raises(ValueError):
        StageBuilder().add_stage(A).add_stage(A)


class First(Stage):
    outputs, before = ("v",), (A,)

    def run(self):
        return {"v": 0}


class Left(Stage):
    inputs, outputs = ("y",), ("left",)

    def run(self, y):
        barrier.wait(timeout=20)
        return {"left": y + 1}


class Right(Stage):
    inputs, outputs = ("y",), ("right",)

    def run(self, y):
        barrier.wait(timeout=20)
        return {"right": y - 1}


barrier = threading.Barrier(2)  # passed only by stages that run at the same time


def test_stages_in_parallel():
    waves = StageBuilder().add_stage(A).add_stage(Left).add_stage(Right).add_stage(First).resolve({"x"})
    assert waves == [[First], [A], [Left, Right]]
    r = StageRunner(waves, {"x": 1})
    with pytest.raises(StageRunningError):
        r.run_many_stages_parallel([Left, Right])
    r.run_until_stage(A)
    assert r.run_many_stages_parallel([Left, Right]) == {"Left": {"left": 3}, "Right": {"right": 1}}
    assert r.arguments == {"x": 1, "v": 0, "y": 2, "left": 3, "right": 1}


class Extra(Stage):
    inputs, outputs = ("table", "factor"), ("doubled",)
    after = (Preprocessing,)

    def run(self, table, factor):
        return {"doubled": factor * table.df.count()}


def test_whole_analysis(spark, tmp_path):
    g = random.Random(7)
    rows = []
    for _ in range(90):
        f = [g.random() for _ in range(5)]
        rows.append((*f, f[0] + 0.3 * g.random(), 1 - f[0] + 0.3 * g.random(), f[1] + 0.2 * g.random()))
    header = "Instances,source," + ",".join(f"feature_{i}" for i in range(5)) + "," + ",".join(f"algo_{i}" for i in range(3))
    (tmp_path / "metadata.csv").write_text(header + "\n" + "\n".join(f"i{k},s{k % 2}," + ",".join(map(str, r)) for k, r in enumerate(rows)) + "\n")
    (tmp_path / "options.json").write_text(json.dumps({"perf": {"epsilon": 0.6}, "pilot": {"analytic": True}, "sifted": {"flag": False}}))
    made = from_directory(spark, str(tmp_path))
    space = Landscape(made.metadata, made.options, [*DEFAULT_STAGES, Extra], {"factor": 2})
    model = space.build()
    assert model.doubled == 180 and model.projected.df.count() == 90
    assert model.trace_summary.count() == 3 and model.z_edge.count() >= 3
    assert all(0 <= r.purity <= 1 and r.area >= 0 for r in model.footprints.collect())
    out = tmp_path / "out"
    out.mkdir()
    model.save_for_web(out)
    model.save(out)
    assert (out / "coordinates.csv").exists()
    drawn = (out / "distribution_portfolio.png").read_bytes()
    size = int.from_bytes(drawn[16:20], "big")
    assert drawn[:8] == b"\x89PNG\r\n\x1a\n" and b"Title\0distribution portfolio" in drawn
    data = drawn[drawn.index(b"IDAT") + 4 :]
    lines = np.frombuffer(zlib.decompressobj().decompress(data), np.uint8).reshape(size, 1 + 3 * size)[:, 1:].reshape(size, size, 3)
    assert ((lines != 255).any(2) & (lines != 160).any(2)).sum() >= model.projected.df.count() and (out / "footprint_portfolio.png").exists()
    mat = model.save_mat(out).read_bytes()
    letters = mat.index(struct.pack("<II", 4, 2 * sum(len(a) - 5 for a in model.projected.algos)))
    assert mat[:10] == b"MATLAB 5.0" and mat[124:128] == b"\x00\x01IM" and b"algolabels" in mat and (len(mat) - 128) % 8 == 0
    names = np.frombuffer(mat[letters + 8 :], np.uint16, 2 * 0 + sum(len(a) - 5 for a in model.projected.algos)).reshape(len(model.projected.algos), -1, order="F")
    assert ["".join(map(chr, r)) for r in names] == [a.removeprefix("algo_") for a in model.projected.algos]
    assert (out / "coordinates.csv").read_text().count("\n") == 91
    assert (out / "color_table.csv").read_text().count("\n") == 257
    assert model.save_zip("all", out).is_file()
    with pytest.raises(ValueError):
        model.save_to_csv(tmp_path / "missing")
    assert space.runner.waves.index([Preprocessing]) == 0
    assert any(Choosing in w for w in space.runner.waves) and space.runner.waves[-1] == [Mapping] or Mapping in space.runner.waves[-1]


def test_too_few_features(spark):
    with pytest.raises(sift.NotEnoughFeatureError):
        sift.sift(make(spark, [(1.0, 2.0, 3.0)], feats=1))


def test_csv_failures(spark, tmp_path):
    assert metadata.from_csv(spark, str(tmp_path / "none.csv")) is None


def test_footprints_take_all_rows(spark):
    g = np.random.default_rng(2)
    z = np.vstack([g.random((24_946, 2)) * 4, g.random((54, 2)) * 0.2 + 8])  # 51 of the 54 are needed for a cluster
    df = spark.createDataFrame([(i, float(a), float(b), 0, True, True) for i, (a, b) in enumerate(z)], "iid long, z_1 double, z_2 double, algo int, good boolean, best boolean")
    got = footprints.footprints(df).first()
    assert len(got.rings) == 2


def test_nearest_distances(spark):
    g = np.random.default_rng(9)
    x = np.vstack([g.normal(size=(120, 4)), g.normal(size=(30, 4)) * 1e-3 + 50, [[1e4, 0, 0, 0]], [[3.0, 3, 3, 3]] * 2])
    t = make(spark, [[*r, 0.0, 0.0] for r in x.tolist()], feats=4)
    ids = [r["iid"] for r in t.df.orderBy("iid").collect()]
    d = np.linalg.norm(x[:, None] - x[None], axis=2) + np.diag(np.full(len(x), np.inf))
    got = {r["iid"]: r["d"] for r in subset.nearest_distances(t).collect()}
    assert [got[i] for i in ids] == pytest.approx(d.min(1))
    assert subset.nearest_distances(make(spark, [(1.0, 2.0, 3.0, 4.0)])).count() == 0


def test_tight_drops_slivers():
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    sliver = [(1.0, 0.0), (6.0, 0.0), (6.0, 0.02), (1.0, 0.02)]
    away = [(10.0, 10.0), (11.0, 10.0), (10.5, 11.0)]
    touching = [(0.0, 1.0), (-1.0, 2.0), (-1.0, 1.0)]
    assert sorted(map(len, geo.parts([square, sliver, away, touching]))) == [1, 1, 2]
    g = np.random.default_rng(3)
    z = np.vstack([g.random((300, 2)), [[10.5, 10.4], [3.0, 0.01]]])
    pieces, rings = footprints.tight([square, sliver, away], z, np.ones(len(z), bool), 0.55)
    got = sum(map(geo.ring_area, pieces))
    assert 0.8 < got < 1.06 and not geo.within(pieces, np.array([[10.5, 10.4], [5.0, 0.01]])).any() and rings
    assert footprints.tight([], z, np.ones(len(z), bool), 0.55) == ([], [])


@pytest.mark.parametrize("how", [{"selection": "rws"}, {"selection": "sus"}, {"selection": "rank", "crossover": "two_points"}, {"selection": "sss", "crossover": "single_point", "mutation": "swap"}, {"selection": "random", "mutation": "inversion"}, {"mutation": "scramble", "stop": "reach_0"}])
def test_evolution_options(how):
    asked = []

    def fitness(pop):
        asked.append(len(pop))
        return [-float(sum((v - 7) ** 2 for v in s)) for s in pop]

    best, value = learn.genetic(fitness, 3, 20, learn.Evolution(population=40, generations=60, elite=2, mutation_chance=0.3, **({"stop": "saturate_60"} | how)), seed=1)
    assert value == -sum((v - 7) ** 2 for v in best) and value > -40
    with pytest.raises(ValueError):
        learn.Evolution(**{next(iter(how)): "none"})


def test_bayes_search_climbs():
    peak = lambda c, gamma: -((np.log2(c) - 1) ** 2 + (np.log2(gamma) + 3) ** 2)
    c, gamma = learn.bayes_search(peak, 30, seed=2)
    grid = max(peak(*p) for p in learn.search_grid(30, 2))
    assert peak(c, gamma) >= grid and peak(c, gamma) > -0.5


def test_order_statistics_narrow_their_brackets(spark, monkeypatch):
    from terrascape.operators import scale

    monkeypatch.setattr(scale, "GATHERED", 7)
    g = np.random.default_rng(4)
    data = {"even": g.normal(size=3000), "ties": np.repeat([1.0, 2.0, 5.0], 1000), "heavy": np.where(g.random(3000) < 0.7, 0.0, g.exponential(size=3000)), "wide": np.exp(g.normal(size=3000) * 40), "one": np.full(3000, 3.0)}
    df = spark.createDataFrame(list(zip(*[v.tolist() for v in data.values()], strict=True)), ", ".join(f"{c} double" for c in data)).repartition(5)
    shares = [0.0, 0.25, 0.5, 0.75, 1.0, 0.3333]
    got = scale.order_statistics(df, list(data), shares)
    for c, v in data.items():
        v = np.sort(v)
        assert got[c] == {q: (v[int(np.floor(2999 * q))], v[int(np.ceil(2999 * q))]) for q in shares}
    assert scale.order_statistics(df.where("even > 1e9"), ["even"], [0.5]) == {"even": {0.5: None}}


def test_clusters_like_the_kernel(spark):
    from terrascape.operators import cluster

    g = np.random.default_rng(8)
    z = np.vstack([g.normal(size=(150, 2)) * 0.3, g.normal(size=(150, 2)) * 0.3 + 3, g.random((40, 2)) * 8 - 2, np.full((60, 2), 6.0)])  # the last are one place
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(z)], "iid long, z_1 double, z_2 double")
    got = {r["iid"]: r["cluster"] for r in cluster.dbscan(df, 0.4, 5).collect()}
    label = geo.dbscan(z, 0.4, 5)
    first = {c: int(np.flatnonzero(label == c)[0]) for c in set(label.tolist()) - {-1}}
    assert got == {i: first.get(int(c)) for i, c in enumerate(label)} and len(first) >= 3 and (label == -1).any()
    near = (np.linalg.norm(z[:, None] - z[None], axis=2) <= 0.4).sum(1)
    assert {r["iid"]: r["degree"] for r in cluster.degrees(df, 0.4).collect()} == dict(enumerate(near.tolist()))


def test_search_judges_all_rows(spark):
    g, n = np.random.default_rng(5), 2500
    x = g.normal(size=(n, 5))
    x[:, 3:] = x[:, :2] + g.normal(size=(n, 2)) * 0.3
    y = np.c_[x[:, 0] + x[:, 1] ** 2, x[:, 2] - x[:, 4]]
    t = make(spark, np.c_[x, y].tolist(), feats=5)
    found = sift.sift(t, rho=0.0, p=1.0, k=3, tries=5)
    cols = found.chosen
    rows = t.df.selectExpr("pmod(xxhash64(iid), 5)", *cols, *t.algos).orderBy("iid").collect()
    fold, z, y = (np.array([tuple(r) for r in rows])[:, k] for k in (0, slice(1, 1 + len(cols)), slice(1 + len(cols), None)))
    full = np.c_[z, y]
    z = z @ sift.project_features(full.T @ full, len(cols)).T
    d = ((z[:, None] - z[None]) ** 2).sum(2)
    d[fold[:, None] == fold[None]] = np.inf
    lost = (y[np.argsort(d, axis=1)[:, :3]].mean(1) - y) ** 2
    assert found.fitness == pytest.approx(-np.mean([lost[fold == f].mean(0) for f in range(5)], axis=0).max())
    assert found.silhouettes[1] == pytest.approx(learn.silhouette(x.T, sift.feature_clusters(x.T @ x, 3, 5)))


def test_topology_takes_all_pairs(spark):
    g = np.random.default_rng(6)
    x = g.normal(size=(1500, 5)) * [1, 2, 3, 1, 1]
    t, a = make(spark, x.tolist(), feats=3), [g.normal(size=(2, 3)) for _ in range(2)]
    i, j = np.triu_indices(len(x), 1)
    apart = lambda v: np.linalg.norm(v[i] - v[j], axis=1)
    want = [np.corrcoef(apart(x), apart(x[:, :3] @ b.T))[0, 1] for b in a]
    assert project.topology(t.df.repartition(3), t, a, block=200) == pytest.approx(want)
    scores = project.numeric(t, tries=2)
    assert scores.scores == pytest.approx([np.corrcoef(apart(x), apart(x[:, :3] @ v[:6].reshape(2, 3).T))[0, 1] for v in scores.alpha.T])
