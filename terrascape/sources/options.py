"""Options of the analysis, from JSON, a dict or defaults."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any


# The names and defaults of the options below, and their other spellings, are the format of option files.


@dataclass(frozen=True)
class Parallel:
    flag: bool = False
    n_cores: int = 2


@dataclass(frozen=True)
class Perf:
    max_perf: bool = False
    abs_perf: bool = True
    epsilon: float = 0.2
    beta_threshold: float = 0.55


@dataclass(frozen=True)
class Auto:
    preproc: bool = True


@dataclass(frozen=True)
class Bound:
    flag: bool = True


@dataclass(frozen=True)
class Norm:
    flag: bool = True


@dataclass(frozen=True)
class Selvars:
    small_scale_flag: bool = False
    small_scale: float = 0.5
    file_idx_flag: bool = False
    file_idx: str = ""
    feats: list[str] | None = None
    algos: list[str] | None = None
    selvars_type: str = "Ftr&Good"
    min_distance: float = 0.1
    density_flag: bool = False


@dataclass(frozen=True)
class Sifted:
    flag: bool = True
    rho: float = 0.1
    k: int = 6
    n_trees: int = 50
    max_iter: int = 1000
    replicates: int = 100
    num_generations: int = 100
    num_parents_mating: int = 2
    sol_per_pop: int = 50
    parent_selection_type: str = "tournament"
    k_tournament: int = 4
    keep_elitism: int = 2
    crossover_type: str = "scattered"
    cross_over_probability: float = 0.8
    mutation_type: str = "random"
    mutation_probability: float = 0.05
    stop_criteria: str = "saturate_5"


@dataclass(frozen=True)
class Pilot:
    x0: Any = None
    alpha: Any = None
    analytic: bool = False
    n_tries: int = 5


@dataclass(frozen=True)
class Cloister:
    p_val: float = 0.05
    c_thres: float = 0.7


@dataclass(frozen=True)
class Pythia:
    cv_folds: int = 5
    is_poly_krnl: bool = False
    use_weights: bool = False
    use_grid_search: bool = False
    params: Any = None


@dataclass(frozen=True)
class Trace:
    use_sim: bool = True
    purity: float = 0.55


@dataclass(frozen=True)
class Outputs:
    csv: bool = True
    web: bool = False
    png: bool = True


@dataclass(frozen=True)
class Options:
    parallel: Parallel = field(default_factory=Parallel)
    perf: Perf = field(default_factory=Perf)
    auto: Auto = field(default_factory=Auto)
    bound: Bound = field(default_factory=Bound)
    norm: Norm = field(default_factory=Norm)
    selvars: Selvars = field(default_factory=Selvars)
    sifted: Sifted = field(default_factory=Sifted)
    pilot: Pilot = field(default_factory=Pilot)
    cloister: Cloister = field(default_factory=Cloister)
    pythia: Pythia = field(default_factory=Pythia)
    trace: Trace = field(default_factory=Trace)
    outputs: Outputs = field(default_factory=Outputs)


#: Other accepted spellings of fields, in lower case; fixed values.
ALIASES: dict[str, dict[str, str]] = {
    "parallel": {"ncores": "n_cores"},
    "perf": {"maxperf": "max_perf", "absperf": "abs_perf", "betathreshold": "beta_threshold"},
    "selvars": {"smallscaleflag": "small_scale_flag", "smallscale": "small_scale", "fileidxflag": "file_idx_flag", "fileidx": "file_idx", "densityflag": "density_flag", "mindistance": "min_distance", "type": "selvars_type"},
    "sifted": {"ntrees": "n_trees", "maxiter": "max_iter"},
    "pilot": {"ntries": "n_tries"},
    "cloister": {"pval": "p_val", "cthres": "c_thres"},
    "pythia": {"cvfolds": "cv_folds", "ispolykrnl": "is_poly_krnl", "useweights": "use_weights", "uselibsvm": "use_grid_search"},
    "trace": {"pi": "purity", "usesim": "use_sim"},
}


def _group(name: str, kind: type, given: dict[str, Any]) -> Any:
    known, alias = {f.name.lower(): f.name for f in fields(kind)}, ALIASES.get(name, {})
    values, unknown = {}, []
    for key, value in given.items():
        low = key.lower()
        if low == "_":  # a comment
            continue
        at = known.get(low) or alias.get(low)
        if at is None:
            unknown.append(key)
        elif at in values:
            raise ValueError(f"{name}: the option {at} is given more than once")
        else:
            values[at] = value
    if unknown:
        raise ValueError(f"Unknown fields in '{name}': {', '.join(unknown)}")
    return kind(**values)


def from_dict(given: dict[str, dict[str, Any]]) -> Options:
    kinds = {f.name: f.default_factory for f in fields(Options)}
    extra = [k for k in given if k.lower() not in kinds]
    if extra:
        raise ValueError(f"Unknown option groups: {', '.join(extra)}")
    return Options(**{k.lower(): _group(k.lower(), kinds[k.lower()], v) for k, v in given.items()})


def from_json(path: str | Path) -> Options | None:
    """Prints why and gives None where the file is missing or no JSON; wrong options raise ValueError."""
    try:
        given = json.loads(Path(path).read_text())
    except (OSError, json.JSONDecodeError) as e:
        print(f"{path}: {e}")
        return None
    return from_dict(given)
