"""A step graph: which steps run, in which order, and what is reused.

A step is a function of an artifact catalogue (names to DataFrames or plain values) that
returns new artifacts.  Nothing here looks at data; steps build lazy plans.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Step:
    """A named function with the artifacts it needs and makes, and the settings that matter to it."""

    name: str
    requires: tuple[str, ...]
    produces: tuple[str, ...]
    run: Callable[[dict[str, Any], dict[str, Any]], dict[str, Any]]
    settings: tuple[str, ...] = ()


def nested(name: str, steps: Iterable[Step]) -> Step:
    """Steps run one after another as one; it needs what they don't make themselves."""
    steps = list(steps)
    made: set[str] = set()
    needs: list[str] = []
    for s in steps:
        needs += [k for k in s.requires if k not in made and k not in needs]
        made.update(s.produces)

    def run(have: dict[str, Any], config: dict[str, Any]) -> dict[str, Any]:
        out: dict[str, Any] = {}
        for s in steps:
            out |= s.run(have | out, config)
        return out

    produces = tuple(dict.fromkeys(k for s in steps for k in s.produces))
    return Step(name, tuple(needs), produces, run, tuple(dict.fromkeys(k for s in steps for k in s.settings)))


class Graph:
    """Steps ordered by their artifacts; ties in the order of declaration."""

    def __init__(self, steps: Iterable[Step]):
        steps = list(steps)
        names = [s.name for s in steps]
        if any(not n for n in names) or len(set(names)) != len(names):
            raise ValueError(f"step names must be distinct and not empty: {names}")
        self.steps = {s.name: s for s in steps}
        self.maker: dict[str, str] = {}
        for s in steps:
            for k in s.produces:
                if k in self.maker:
                    raise ValueError(f"{k} is made by both {self.maker[k]} and {s.name}")
                self.maker[k] = s.name
        self.before = {s.name: {self.maker[k] for k in s.requires if k in self.maker} for s in steps}
        self.external = sorted({k for s in steps for k in s.requires if k not in self.maker})
        self.order: list[str] = []
        left = dict(self.before)
        while left:
            ready = next((n for n in left if left[n] <= set(self.order)), None)
            if ready is None:
                raise RuntimeError(f"the steps {sorted(left)} depend on each other in a circle")
            self.order.append(ready)
            del left[ready]

    def _known(self, names: Iterable[str]) -> list[str]:
        names = list(names)
        for n in names:
            if n not in self.steps:
                raise ValueError(f"unknown step {n!r}; there are {self.order}")
        return names

    def upstream(self, targets: Iterable[str] | None = None) -> list[str]:
        """The targets (all, if None) and what they need, in order."""
        if targets is None:
            return list(self.order)
        need, todo = set(), self._known(targets)
        while todo:
            n = todo.pop()
            if n not in need:
                need.add(n)
                todo += self.before[n]
        return [n for n in self.order if n in need]

    def downstream(self, name: str) -> list[str]:
        """What depends on a step, directly or not, in order."""
        reached = set(self._known([name]))
        for n in self.order:
            if self.before[n] & reached:
                reached.add(n)
        return [n for n in self.order if n in reached and n != name]


@dataclass
class Engine:
    """Runs a graph against an artifact store, reusing what is unchanged, also between processes.

    In debug mode targets run again, and other steps only if an output is missing, whatever
    their settings and inputs are now.  ``export`` is told of every step that was run or reused.
    """

    graph: Graph
    store: Any
    config: dict[str, Any] = field(default_factory=dict)
    debug: bool = False
    export: Callable[[str, dict[str, Any]], None] | None = None

    def settings(self, step: Step) -> dict[str, Any]:
        def look(path: str) -> Any:
            value: Any = self.config
            for part in path.split("."):
                value = value.get(part) if isinstance(value, dict) else None
            return value

        return {k: look(k) for k in step.settings}

    def decide(self, targets: Iterable[str] | None = None, force: bool = False) -> dict[str, bool]:
        """For each selected step, whether it would run; asking changes nothing.

        A step runs if it is forced, an output is missing, its fingerprint has changed (not in
        debug mode), or a step it depends on runs.  The last selected step always runs.
        """
        selected = self.graph.upstream(targets)
        chosen = set(targets or [])
        runs: dict[str, bool] = {}
        for n in selected:
            step = self.graph.steps[n]
            runs[n] = any(runs.get(b) for b in self.graph.before[n]) or n == selected[-1] or any(not self.store.has(k) for k in step.produces)
            runs[n] = runs[n] or (force and (n in chosen or not chosen)) or (self.debug and n in chosen)
            # inputs are all there by now: what makes them doesn't run
            runs[n] = runs[n] or (not self.debug and self.store.steps.get(n) != self.fingerprint(step))
        return runs

    def fingerprint(self, step: Step) -> str:
        return self.store.fingerprint(self.settings(step), step.requires)

    def run(self, targets: Iterable[str] | None = None, callback: Callable[..., None] | None = None, force: bool = False) -> dict[str, Any]:
        """Run the selected steps; returns all artifacts."""
        tell = callback or (lambda *a: None)
        targets = None if targets is None else list(targets)
        missing = [k for k in self.graph.external if any(k in self.graph.steps[n].requires for n in self.graph.upstream(targets)) and not self.store.has(k)]
        if missing:
            raise RuntimeError(f"not given: {', '.join(missing)}")
        decided = self.decide(targets, force)
        tell("step_start", len(decided))
        for n, runs in decided.items():
            step = self.graph.steps[n]
            if not runs:
                tell("step_skipped", n)
                self._export(step)
                continue
            tell("step_running", n)
            began = time.monotonic()
            made = step.run({k: self.store.get(k) for k in step.requires}, self.config | {"keep": self.store.keep})
            absent = [k for k in step.produces if k not in made]
            if absent:
                raise RuntimeError(f"{n} did not make {', '.join(absent)}")
            for k in step.produces:
                self.store.put(k, made[k])
            self.store.done(n, self.fingerprint(step))
            tell("step_done", n, time.monotonic() - began)
            self._export(step)
        self.store.tidy()
        return self.store.all()

    def _export(self, step: Step) -> None:
        if self.export:
            self.export(step.name, {k: self.store.get(k) for k in step.produces})

    def cached(self, name: str) -> bool:
        """Whether a step would be reused; asking changes nothing."""
        step = self.graph.steps[name]
        return all(self.store.has(k) for k in (*step.produces, *step.requires)) and (self.debug or self.store.steps.get(name) == self.fingerprint(step))
