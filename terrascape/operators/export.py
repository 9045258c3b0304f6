"""Files of a finished model: CSV, colour tables for the web, tables to plot from, and a zip of a folder."""

from __future__ import annotations

import csv
import struct
import zipfile
import zlib
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .label import good_name
from .scale import colour_columns, colour_global


def write_csv(df: DataFrame, path: Path, order: str | None = "Row") -> None:
    """One file with header, rows streamed from partitions in order, so it does not need the driver's memory."""
    with path.open("w", newline="") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        for row in (df.orderBy(order) if order else df).toLocalIterator():
            out.writerow(["" if v is None else v for v in row])


def _folder(folder: str | Path) -> Path:
    folder = Path(folder)
    if not folder.is_dir():
        raise ValueError(f"{folder} is not a directory")
    return folder


def _rows(df: DataFrame, cols: dict[str, str], order: str = "iid") -> DataFrame:
    return df.select(F.col("instances").alias("Row"), *[F.col(c).alias(n) for c, n in cols.items()])


def save_csv(model, folder: str | Path) -> None:
    folder = _folder(folder)
    t, raw = model.projected, model.unscaled
    feats, algos = {f: f.removeprefix("feature_") for f in t.features}, {a: a.removeprefix("algo_") for a in t.algos}
    raw = raw.df.join(t.df.select("iid"), "iid", "left_semi")
    tables = {
        "coordinates": _rows(t.df, {"z_1": "z_1", "z_2": "z_2"}), "feature_raw": _rows(raw, feats), "feature_process": _rows(t.df, feats), "algorithm_raw": _rows(raw, algos), "algorithm_process": _rows(t.df, algos),
        "algorithm_bin": _rows(t.df, {good_name(a): n for a, n in algos.items()}), "good_algos": _rows(t.df, {"n_good": "NumGoodAlgos"}), "beta_easy": _rows(t.df, {"beta": "IsBetaEasy"}), "portfolio": _rows(t.df, {"p": "Best_Algorithm"}),
        "projection_matrix": model.projection.summary(t.df.sparkSession),
        "bounds": _edge(model.z_edge), "bounds_prunned": _edge(model.z_ecorr),
        "svm_table": model.svm_summary.withColumnRenamed("name", "Row").drop("algo"),
        "footprint_performance": model.trace_summary.withColumnRenamed("name", "Row").drop("algo"),
    }
    names = t.df.select("iid", "instances")
    hats = model.predictions.groupBy("iid").pivot("algo", list(range(1, len(t.algos) + 1))).agg(F.first("hat_good"))
    tables["algorithm_svm"] = _rows(hats.join(names, "iid"), {str(k + 1): n for k, n in enumerate(algos.values())})
    tables["portfolio_svm"] = _rows(model.selections.join(names, "iid"), {"selection0": "Best_Algorithm"})
    for name, df in tables.items():
        write_csv(df, folder / f"{name}.csv")
    for r in model.footprints.where("kind IN ('good', 'best')").toLocalIterator():
        with (folder / f"footprint_{t.algos[r['algo'] - 1].removeprefix('algo_')}_{r['kind']}.csv").open("w", newline="") as f:
            out = csv.writer(f)
            out.writerow(["Row", "z_1", "z_2"])
            out.writerows([f"bnd_pnt_{i}", p["x"], p["y"]] for i, p in enumerate((p for ring in r["rings"] for p in ring), 1))


def _edge(hull: DataFrame) -> DataFrame:
    return hull.select(F.concat(F.lit("bnd_pnt_"), F.format_string("%d", F.col("ord") + 1)).alias("Row"), "z_1", "z_2")


def save_web(model, folder: str | Path) -> None:
    folder = _folder(folder)
    t, raw = model.projected, model.unscaled
    raw_df = raw.df.join(t.df.select("iid"), "iid", "left_semi")
    names = t.df.select("iid", "instances")
    files = {
        "feature_raw_color": colour_columns(raw_df, list(t.features)), "algorithm_raw_single_color": colour_columns(raw_df, list(t.algos)), "feature_process_color": colour_columns(t.df, list(t.features)), "algorithm_process_single_color": colour_columns(t.df, list(t.algos)),
        "algorithm_raw_color": colour_global(raw_df, list(t.algos)), "algorithm_process_color": colour_global(t.df, list(t.algos)), "good_algos_color": colour_global(t.df, ["n_good"]),
    }
    for name, df in files.items():
        cols = [c for c in df.columns if c != "iid"]
        write_csv(df.join(names, "iid").select(F.col("instances").alias("Row"), *[F.col(c).alias(c.removeprefix("feature_").removeprefix("algo_")) for c in cols]), folder / f"{name}.csv")
    with (folder / "color_table.csv").open("w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["R", "G", "B"])
        out.writerows(_palette(i / 255) for i in range(256))


#: Anchors of the colour ramp, dark blue over green to yellow; fixed values.
_ANCHORS = ((68, 1, 84), (59, 82, 139), (33, 145, 140), (94, 201, 98), (253, 231, 37))


def _palette(x: float) -> list[int]:
    at = x * (len(_ANCHORS) - 1)
    i = min(int(at), len(_ANCHORS) - 2)
    return [round(a + (b - a) * (at - i)) for a, b in zip(_ANCHORS[i], _ANCHORS[i + 1], strict=True)]


#: Pixels of a picture's side, and of its margin.
SIDE, MARGIN = 480, 24


def title(name: str) -> str:
    """What stands over a picture: the name without underscores."""
    return name.replace("_", " ")


def write_png(path: Path, pixels: np.ndarray, text: str) -> None:
    """pixels: height x width x 3, 8 bits each; text: the picture's title."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    h, w, _ = pixels.shape
    lines = np.hstack([np.zeros((h, 1), np.uint8), pixels.reshape(h, w * 3)]).tobytes()
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"tEXt", b"Title\0" + text.encode("latin-1", "replace")) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b""))


class Picture:
    """A square view of the plane. Places are counted by pixel where they are, so what comes to the driver is bounded by the pixels."""

    def __init__(self, places: DataFrame):
        e = places.agg(F.min("z_1"), F.max("z_1"), F.min("z_2"), F.max("z_2")).first()
        self.low = (e[0] or 0.0, e[2] or 0.0)
        self.span = ((e[1] or 0.0) - self.low[0] or 1.0, (e[3] or 0.0) - self.low[1] or 1.0)
        self.inner = SIDE - 2 * MARGIN - 1

    def _blank(self) -> np.ndarray:
        out = np.full((SIDE, SIDE, 3), 255, np.uint8)
        edge = MARGIN // 2
        out[edge, edge:-edge], out[-edge - 1, edge:-edge], out[edge:-edge, edge], out[edge:-edge, -edge - 1] = (np.uint8(160),) * 4
        return out

    def _pixel(self, c: str, k: int) -> Column:
        return F.floor((F.col(c) - F.lit(self.low[k])) / F.lit(self.span[k]) * self.inner).cast("int")

    def places(self, df: DataFrame, path: Path, text: str) -> None:
        """df: z_1, z_2, value (0..1). Each place is a dot in the colour of the mean value of its pixel."""
        out = self._blank()
        cells = df.where("z_1 IS NOT NULL AND z_2 IS NOT NULL AND value IS NOT NULL").groupBy(self._pixel("z_1", 0).alias("x"), self._pixel("z_2", 1).alias("y")).agg(F.avg(F.col("value").cast("double")).alias("v"))
        for x, y, v in sorted(map(tuple, cells.collect())):  # at most as many as pixels
            row, col = SIDE - 1 - MARGIN - y, MARGIN + x
            out[row - 1 : row + 2, col - 1 : col + 2] = _palette(min(1.0, max(0.0, v)))
        write_png(path, out, text)

    def rings(self, rings: list[tuple[float, list[tuple[float, float]]]], path: Path, text: str) -> None:
        """Closed lines, each with a value (0..1) for its colour."""
        out = self._blank()
        for value, ring in rings:
            z = (np.array(ring, float) - self.low) / self.span * self.inner
            for a, b in zip(z, np.roll(z, -1, 0), strict=True):
                steps = int(np.abs(b - a).max()) + 2
                line = np.clip(np.round(a + (b - a) * np.linspace(0, 1, steps)[:, None]), -MARGIN, self.inner + MARGIN).astype(int)
                out[SIDE - 1 - MARGIN - line[:, 1], MARGIN + line[:, 0]] = _palette(value)
        write_png(path, out, text)


def save_plot_tables(model, folder: str | Path) -> None:
    """What each picture shows, as a table and drawn: places with values scaled to 0..1, labels and choices, and footprint borders.

    Performance on a common scale is log10(y + 1) less the least of all algorithms, over its own range. A picture's title is its name without underscores.
    """
    folder = _folder(folder)
    t, raw = model.projected, model.unscaled.df.join(model.projected.df.select("iid"), "iid", "left_semi")
    places = t.df.select("iid", "z_1", "z_2")
    picture = Picture(places)
    log = lambda a: F.log10(F.col(a) + 1)
    e = raw.agg(*[F.min(c).alias(f"a_{c}") for c in (*t.features, *t.algos)], *[F.max(c).alias(f"b_{c}") for c in (*t.features, *t.algos)], *[f(log(a)).alias(f"{n}_{a}") for a in t.algos for n, f in (("la", F.min), ("lb", F.max))]).first()
    unit = lambda x, lo, hi: F.coalesce(F.try_divide(x - F.lit(lo), F.lit(hi)), F.lit(0.0))
    span = lambda lo, hi: None if lo is None or hi is None else float(hi - lo)
    low = min((e[f"la_{a}"] for a in t.algos if e[f"la_{a}"] is not None), default=0.0)

    def put(name: str, df: DataFrame, label: str, drawn: Column | None = None) -> None:
        joined = places.join(df, "iid")
        write_csv(joined, folder / f"{name}.csv", "iid")
        picture.places(joined.withColumn("value", F.col("value").cast("double") if drawn is None else drawn), folder / f"{name}.png", title(label))

    for f in t.features:
        put("distribution_" + f, raw.select("iid", unit(F.col(f), e[f"a_{f}"], span(e[f"a_{f}"], e[f"b_{f}"])).alias("value")), f)
    for a in t.algos:
        name = a.removeprefix("algo_")
        put(f"distribution_performance_global_normalized_{name}", raw.select("iid", unit(log(a), low, span(e[f"la_{a}"], e[f"lb_{a}"])).alias("value")), name)
        put(f"distribution_performance_individual_normalized_{name}", raw.select("iid", unit(F.col(a), e[f"a_{a}"], span(e[f"a_{a}"], e[f"b_{a}"])).alias("value")), name)
        put(f"binary_performance_{name}", t.df.select("iid", F.col(good_name(a)).alias("value")), name)
        put(f"binary_svm_{name}", model.predictions.where(F.col("name") == a).select("iid", F.col("hat_good").alias("value")), name)
    share = F.col("value") / len(t.algos)
    for name, c, drawn in (("distribution_number_good_algos", "n_good", share), ("distribution_portfolio", "p", share), ("distribution_beta_score", "beta", None), ("distribution_sources", "source", F.pmod(F.xxhash64("value"), F.lit(997)) / 996)):
        if name != "distribution_sources" or not t.df.where("source IS NOT NULL").isEmpty():
            put(name, t.df.select("iid", F.col(c).alias("value")), name, drawn)
    put("distribution_svm_portfolio", model.selections.select("iid", F.col("selection0").alias("value")), "svm_portfolio", share)
    border = model.footprints.select("algo", "kind", F.posexplode("rings").alias("ring", "points")).select("algo", "kind", "ring", F.posexplode("points").alias("ord", "p")).select("algo", "kind", "ring", "ord", F.col("p.x").alias("z_1"), F.col("p.y").alias("z_2"))
    write_csv(border, folder / "footprint_portfolio.csv", None)
    for kind in ("good", "best"):
        found = model.footprints.where(F.col("kind") == kind).select("algo", "rings").collect()  # one row an algorithm
        rings = {r["algo"]: [[(p["x"], p["y"]) for p in ring] for ring in r["rings"]] for r in found}
        for algo, own in rings.items():
            name = t.algos[algo - 1].removeprefix("algo_")
            picture.rings([(algo / len(t.algos), ring) for ring in own], folder / f"footprint_{name}_{kind}.png", title(f"{name}_{kind}"))
        if kind == "best":
            picture.rings([(a / len(t.algos), ring) for a, own in rings.items() for ring in own], folder / "footprint_portfolio.png", title("footprint_portfolio"))


def save_mat(model, folder: str | Path) -> Path:
    """model.mat: a struct `data` whose field algolabels is a matrix of letters, one algorithm a row. The layout is that of MAT files of level 5, uncompressed."""
    path = _folder(folder) / "model.mat"
    names = [a.removeprefix("algo_") for a in model.projected.algos]
    wide = max(map(len, names), default=0)
    letters = np.array([[ord(c) for c in n.ljust(wide)] for n in names], np.uint16).reshape(len(names), wide)

    def element(kind: int, data: bytes) -> bytes:
        return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)

    def matrix(cls: int, shape: tuple[int, int], name: str, body: bytes) -> bytes:
        return element(14, element(6, struct.pack("<II", cls, 0)) + element(5, struct.pack("<ii", *shape)) + element(1, name.encode()) + body)

    chars = matrix(4, letters.shape, "", element(4, letters.tobytes(order="F")))
    field = b"algolabels"
    data = matrix(2, (1, 1), "data", struct.pack("<HHi", 5, 4, 32) + element(1, field.ljust(32, b"\0")) + chars)
    path.write_bytes(b"MATLAB 5.0 MAT-file".ljust(116) + b"\0" * 8 + struct.pack("<H", 0x0100) + b"IM" + data)
    return path


def save_zip(name: str, folder: str | Path) -> Path:
    """All files of a folder, flat, under output/ of a zip beside them."""
    folder = _folder(folder)
    path = folder / (name if name.endswith(".zip") else f"{name}.zip")
    files = [p for p in sorted(folder.rglob("*")) if p.is_file() and p != path]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in files:
            z.write(p, f"output/{p.name}")
    return path
