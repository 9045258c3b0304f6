"""Stages: named steps from inputs to outputs, put in order by what they need."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any, ClassVar


class StageResolutionError(ValueError):
    """Stages can't be put in order."""


class StageRunningError(RuntimeError):
    """A stage was asked for before the stages that it needs."""


class Stage(ABC):
    """inputs and outputs are argument names; an output that is also an input replaces it. before, after: stages it must precede or follow."""

    inputs: ClassVar[tuple[str, ...]] = ()
    outputs: ClassVar[tuple[str, ...]] = ()
    before: ClassVar[tuple[type[Stage], ...]] = ()
    after: ClassVar[tuple[type[Stage], ...]] = ()

    @abstractmethod
    def run(self, **inputs: Any) -> dict[str, Any]: ...


class StageBuilder:
    def __init__(self) -> None:
        self.stages: list[type[Stage]] = []

    def add_stage(self, stage: type[Stage]) -> StageBuilder:
        if stage in self.stages:
            raise ValueError(f"{stage.__name__} has been added already")
        if not stage.outputs:
            raise ValueError(f"{stage.__name__} has no output")
        self.stages.append(stage)
        return self

    def resolve(self, initial: set[str]) -> list[list[type[Stage]]]:
        """Waves of stages. A stage that replaces an argument runs alone, before other stages that read it; two that could replace one at the same time can't be ordered."""
        left, have, waves = list(self.stages), set(initial), []
        done: set[type[Stage]] = set()
        while left:
            ready = [s for s in left if set(s.inputs) <= have and not any(a in left for a in s.after) and not any(s in o.before for o in left if o is not s)]
            if not ready:
                lines = [f"{s.__name__} lacks {', '.join(sorted(set(s.inputs) - have)) or 'its place in the order'}" for s in left]
                raise StageResolutionError("No stage can run: " + "; ".join(lines))
            changing = {s: set(s.inputs) & set(s.outputs) for s in ready}
            mutators = [s for s in ready if changing[s]]
            for i, s in enumerate(mutators):
                for o in mutators[i + 1 :]:
                    if both := changing[s] & changing[o]:
                        raise StageResolutionError(f"{s.__name__} and {o.__name__} both replace {', '.join(sorted(both))}")
            # a stage waits for any stage yet to come that replaces what it reads
            wave = [mutators[0]] if mutators else [s for s in ready if not any(set(s.inputs) & set(o.inputs) & set(o.outputs) for o in left if o is not s)]
            if not wave:
                wave = ready
            made: dict[str, str] = {}
            for s in wave:
                for out in s.outputs:
                    if out in made or out in have and out not in s.inputs:
                        raise StageResolutionError(f"{out} is an output of {s.__name__} and of {made.get(out, 'an earlier stage')}")
                    made[out] = s.__name__
            have |= set(made)
            done |= set(wave)
            left = [s for s in left if s not in done]
            waves.append(wave)
        return waves


class StageRunner:
    """Runs waves. Each wave's arguments are kept as they were before it; values are DataFrames or frozen, so a snapshot can't change later."""

    def __init__(self, waves: list[list[type[Stage]]], initial: dict[str, Any]):
        self.waves = waves
        self.snapshots: list[dict[str, Any]] = [dict(initial)]
        self.ran: list[set[type[Stage]]] = [set() for _ in waves]

    @property
    def arguments(self) -> dict[str, Any]:
        return self.snapshots[-1]

    def _wave(self, stage: type[Stage]) -> int:
        for i, wave in enumerate(self.waves):
            if stage in wave:
                return i
        raise StageRunningError(f"{stage.__name__} is not one of the stages")

    def run_stage(self, stage: type[Stage], **override: Any) -> dict[str, Any]:
        """Runs one stage of the present wave, or of an earlier one after a rollback to it. Overrides hold for this run alone."""
        at = self._wave(stage)
        now = len(self.snapshots) - 1
        if now < len(self.waves) and at > now or at > len(self.snapshots) - 1:
            raise StageRunningError(f"{stage.__name__} can't run before the earlier stages")
        if at < now or self.ran[at] == set(self.waves[at]):
            self.rollback(at)
        given = self.snapshots[at] | override
        out = stage().run(**{k: given[k] for k in stage.inputs})
        if missing := set(stage.outputs) - out.keys():
            raise StageRunningError(f"{stage.__name__} did not give {', '.join(sorted(missing))}")
        self.ran[at].add(stage)
        self.pending = (self.pending if at == getattr(self, "pending_at", -1) else {}) | out
        self.pending_at = at
        if self.ran[at] == set(self.waves[at]):
            self.snapshots.append(self.snapshots[at] | self.pending)
            self.pending = {}
            self.pending_at = -1
        return out

    def rollback(self, wave: int) -> None:
        self.snapshots = self.snapshots[: wave + 1]
        for later in self.ran[wave:]:
            later.clear()
        self.pending, self.pending_at = {}, -1

    def run_iter(self) -> Iterator[tuple[type[Stage], dict[str, Any]]]:
        for wave in self.waves[len(self.snapshots) - 1 :]:
            for stage in wave:
                yield stage, self.run_stage(stage)

    def run_all(self) -> dict[str, Any]:
        for _ in self.run_iter():
            pass
        return self.arguments

    def run_until_stage(self, stage: type[Stage]) -> dict[str, Any]:
        """Runs up to the stage, itself included."""
        at = self._wave(stage)
        for done, _ in self.run_iter():
            if done is stage:
                break
        return self.arguments if len(self.snapshots) > at + 1 else self.arguments | self.pending

    def run_many_stages_parallel(self, stages: list[type[Stage]]) -> dict[str, dict[str, Any]]:
        """Runs stages of the present wave at the same time; their Spark jobs share the cluster."""
        at = len(self.snapshots) - 1
        if any(self._wave(s) != at for s in stages):
            raise StageRunningError("Stages of one wave only can run together")
        given = self.snapshots[at]
        with ThreadPoolExecutor(max_workers=max(1, len(stages))) as pool:
            outs = list(pool.map(lambda s: s().run(**{k: given[k] for k in s.inputs}), stages))
        merged = {k: v for o in outs for k, v in o.items()}
        self.ran[at] |= set(stages)
        self.pending, self.pending_at = getattr(self, "pending", {}) | merged, at
        if self.ran[at] == set(self.waves[at]):
            self.snapshots.append(given | self.pending)
            self.pending, self.pending_at = {}, -1
        return dict(zip([s.__name__ for s in stages], outs, strict=True))
