"""The whole analysis: its stages, the facade and the model."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions.learn import Evolution
from ..operators import classify, clean, corners, footprints, label, project, scale, sift, subset
from ..sources import metadata as meta
from ..sources import options as opts
from ..sources.metadata import Instances
from ..sources.options import Options
from .stage import Stage, StageBuilder, StageRunner


class Preprocessing(Stage):
    inputs, outputs = ("raw", "options"), ("table",)

    def run(self, raw: Instances, options: Options) -> dict[str, Any]:
        return {"table": clean.preprocess(raw, options.selvars.feats, options.selvars.algos)}


class Prelim(Stage):
    """Labels, bounds, normalised columns, then the subset. labelled holds all rows; unscaled keeps raw columns beside labels."""

    inputs, outputs = ("table", "options"), ("table", "unscaled", "all_rows", "bounds", "scaling")

    def run(self, table: Instances, options: Options) -> dict[str, Any]:
        perf = label.Performance(options.perf.max_perf, options.perf.abs_perf, options.perf.epsilon, options.perf.beta_threshold)
        t = label.label(table, perf)
        if not perf.abs_perf:
            t = label.relative_values(t, perf.max_perf)
        unscaled, bounds, scaling = t, None, None
        if options.bound.flag and options.auto.preproc:
            t, bounds = scale.bound(t)
        if options.norm.flag and options.auto.preproc:
            t, scaling = scale.normalise(t)
        everything, v = t, options.selvars
        if v.small_scale_flag:
            t = subset.choose(t, small_scale=v.small_scale)
        elif v.file_idx_flag and v.file_idx:
            t = subset.choose(t, rows=meta.row_index(t.df.sparkSession, v.file_idx))
        elif v.density_flag:
            t = subset.choose(t, density=(v.min_distance, v.selvars_type))
        return {"table": t, "unscaled": unscaled, "all_rows": everything, "bounds": bounds, "scaling": scaling}


class Sift(Stage):
    inputs, outputs = ("table", "options", "unscaled"), ("table", "sifted")

    def run(self, table: Instances, options: Options, unscaled: Instances) -> dict[str, Any]:
        s = options.sifted
        if not s.flag:
            return {"table": table, "sifted": sift.Sifted(table, table.features)}
        how = Evolution(s.sol_per_pop, s.num_generations, s.num_parents_mating, s.parent_selection_type, s.k_tournament, s.keep_elitism, s.crossover_type, s.cross_over_probability, s.mutation_type, s.mutation_probability, s.stop_criteria)
        found = sift.sift(table, s.rho, k=s.k, tries=s.replicates, most=s.max_iter, evolution=how)
        return {"table": found.table, "sifted": found}


class Projecting(Stage):
    inputs, outputs = ("table", "options", "sifted"), ("projection", "projected")

    def run(self, table: Instances, options: Options, sifted: sift.Sifted) -> dict[str, Any]:
        p = project.analytic(table) if options.pilot.analytic else project.numeric(table, options.pilot.n_tries, alpha=options.pilot.alpha, starts=options.pilot.x0)
        return {"projection": p, "projected": table.with_df(p.apply(table.df).persist())}


class Boundary(Stage):
    inputs, outputs = ("table", "projection", "options"), ("z_edge", "z_ecorr")

    def run(self, table: Instances, projection: project.Projection, options: Options) -> dict[str, Any]:
        full, pruned = corners.edges(table, projection, options.cloister.p_val, options.cloister.c_thres)
        return {"z_edge": full, "z_ecorr": pruned}


class Choosing(Stage):
    inputs, outputs = ("projected", "options"), ("predictions", "selections", "svm_summary", "z_stats")

    def run(self, projected: Instances, options: Options) -> dict[str, Any]:
        t, z_stats = classify.znorm(projected)
        o = options.pythia
        pred = classify.fit_predict(t, classify.Training(o.cv_folds, o.is_poly_krnl, o.use_weights, params=o.params, bayes=not o.use_grid_search)).persist()
        return {"predictions": pred, "selections": classify.selections(pred), "svm_summary": classify.summary(t, pred, larger=options.perf.max_perf), "z_stats": z_stats}


class Mapping(Stage):
    inputs, outputs = ("projected", "predictions", "selections", "options"), ("footprints", "trace_summary")

    def run(self, projected: Instances, predictions: DataFrame, selections: DataFrame, options: Options) -> dict[str, Any]:
        rows = footprints.trace_rows(projected, *((predictions, selections) if options.trace.use_sim else ()))
        found = footprints.footprints(rows, options.trace.purity).persist()
        settled = footprints.contradictions(found, rows, options.trace.purity)
        found = found.where("kind != 'best'").unionByName(settled)
        return {"footprints": found, "trace_summary": footprints.summary(found, {k + 1: a for k, a in enumerate(projected.algos)})}


DEFAULT_STAGES: tuple[type[Stage], ...] = (Preprocessing, Prelim, Sift, Projecting, Choosing, Boundary, Mapping)


@dataclass(frozen=True)
class Model:
    """All that the stages gave, by argument name."""

    arguments: dict[str, Any]

    def __getattr__(self, name: str) -> Any:
        try:
            return self.__dict__["arguments"][name]
        except KeyError:
            raise AttributeError(name) from None

    def save(self, folder: str | Path) -> None:
        """The files that the options' outputs ask for."""
        o = self.options.outputs
        for wanted, write in ((o.csv, self.save_to_csv), (o.web, self.save_for_web), (o.png, self.save_graphs)):
            if wanted:
                write(folder)

    def save_to_csv(self, folder: str | Path) -> None:
        from ..operators.export import save_csv

        save_csv(self, folder)

    def save_for_web(self, folder: str | Path) -> None:
        from ..operators.export import save_web

        save_web(self, folder)

    def save_graphs(self, folder: str | Path) -> None:
        from ..operators.export import save_plot_tables

        save_plot_tables(self, folder)

    def save_mat(self, folder: str | Path) -> Path:
        from ..operators.export import save_mat

        return save_mat(self, folder)

    def save_zip(self, name: str, folder: str | Path) -> Path:
        from ..operators.export import save_zip

        return save_zip(name, folder)


class Landscape:
    """Takes an instance table and options, orders the stages, further ones included, and runs them. extra: initial arguments of further stages."""

    def __init__(self, table: Instances, options: Options | None = None, stages: tuple[type[Stage], ...] | list[type[Stage]] = DEFAULT_STAGES, extra: dict[str, Any] | None = None):
        self.metadata, self.options = table, options or Options()
        builder = StageBuilder()
        for s in stages:
            builder.add_stage(s)
        initial = {"raw": table, "options": self.options} | (extra or {})
        self.runner = StageRunner(builder.resolve(set(initial)), initial)

    @property
    def model(self) -> Model:
        return Model(self.runner.arguments)

    def build(self) -> Model:
        self.runner.run_all()
        return self.model

    def run_iter(self):
        return self.runner.run_iter()

    def run_stage(self, stage: type[Stage], **override: Any) -> dict[str, Any]:
        return self.runner.run_stage(stage, **override)

    def run_until_stage(self, stage: type[Stage]) -> dict[str, Any]:
        return self.runner.run_until_stage(stage)

    def run_many_stages_parallel(self, stages: list[type[Stage]]) -> dict[str, dict[str, Any]]:
        return self.runner.run_many_stages_parallel(stages)


def from_files(spark: SparkSession, table: str, options: str) -> Landscape | None:
    t, o = meta.from_csv(spark, table), opts.from_json(options)
    return None if t is None or o is None else Landscape(t, o)


def from_directory(spark: SparkSession, folder: str) -> Landscape | None:
    """metadata.csv and options.json of a folder."""
    return from_files(spark, f"{folder}/metadata.csv", f"{folder}/options.json")
