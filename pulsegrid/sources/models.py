"""The model registry and the choice of a model for each task."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass(frozen=True)
class ModelSpec:
    name: str
    task: str
    hf_repo: str
    filename: str
    format: str
    input_norm: str
    output_activation: str
    revision: str = "main"
    input_channels: tuple[str, ...] = field(default_factory=tuple)


class Registry:
    """Models by name, and names by task in the order of the file."""

    def __init__(self, models: dict[str, dict]):
        self.models = {n: ModelSpec(n, **{**v, "input_channels": tuple(v.get("input_channels", ()))}) for n, v in models.items()}
        self.tasks: dict[str, list[str]] = {}
        for n, m in self.models.items():
            self.tasks.setdefault(m.task, []).append(n)

    @classmethod
    def from_file(cls, path: str) -> Registry:
        """From a JSON file, or YAML where that can be imported."""
        import json

        with open(path, encoding="utf-8") as f:
            if path.endswith(".json"):
                return cls(json.load(f))
            import yaml  # optional

            return cls(yaml.safe_load(f))

    def get(self, name: str) -> ModelSpec:
        if name not in self.models:
            raise KeyError(f"unknown model {name!r}; there are {sorted(self.models)}")
        return self.models[name]


class Manager:
    """The current model of each task (the first, unless changed) and its local file.

    fetch(spec, again) returns a model's local path, downloading it where it isn't there, or in
    any case if again is true; without one, local_files() looks in a folder.  Its text names the
    current models and revisions, so that is what fingerprints of steps hold.
    """

    def __init__(self, registry: Registry, fetch: Callable[[ModelSpec, bool], str] | None = None, backends: dict[str, Callable[[str], object]] | None = None):
        self.registry, self.fetch, self.backends = registry, fetch, backends or {}
        self.current = {t: names[0] for t, names in registry.tasks.items()}
        self.paths: dict[str, str] = {}

    def __str__(self) -> str:
        return "; ".join(f"{t}={n}@{self.registry.get(n).revision}" for t, n in sorted(self.current.items()))

    def choices(self, task: str) -> list[str]:
        """Names of the task's models."""
        if task not in self.registry.tasks:
            raise ValueError(f"unknown task {task!r}")
        return list(self.registry.tasks[task])

    def backend(self, spec: ModelSpec) -> Callable[[str], object] | None:
        """How to load a model of this format, where that isn't the built-in way."""
        return self.backends.get(spec.format)

    def change(self, task: str, name: str) -> None:
        if task not in self.registry.tasks:
            raise ValueError(f"unknown task {task!r}")
        if name not in self.registry.models:
            raise ValueError(f"unknown model {name!r}")
        if name not in self.registry.tasks[task]:
            raise ValueError(f"{name!r} is a model for {self.registry.get(name).task!r}, not {task!r}")
        self.current[task] = name

    def resolve(self, task: str, refresh: bool = False) -> tuple[ModelSpec, str]:
        """The task's model and its file, fetched at first use, or again with refresh."""
        if task not in self.current:
            raise ValueError(f"unknown task {task!r}")
        spec = self.registry.get(self.current[task])
        if refresh or spec.name not in self.paths:
            if self.fetch is None:
                raise RuntimeError(f"no way to fetch {spec.hf_repo}/{spec.filename}")
            self.paths[spec.name] = self.fetch(spec, refresh)
        return spec, self.paths[spec.name]


def local_files(folder: str) -> Callable[[ModelSpec, bool], str]:
    """A fetch function that finds models already lying in a folder that all executors see."""
    from pathlib import Path

    def fetch(spec: ModelSpec, again: bool) -> str:
        path = Path(folder) / spec.filename
        if not path.is_file():
            raise FileNotFoundError(f"{spec.name}: {path} is missing")
        return str(path)

    return fetch


def hub_files(cache: str) -> Callable[[ModelSpec, bool], str]:
    """A fetch function that downloads into a folder that all executors see; needs huggingface_hub and a network."""

    def fetch(spec: ModelSpec, again: bool) -> str:
        from huggingface_hub import hf_hub_download  # optional

        return hf_hub_download(repo_id=spec.hf_repo, filename=spec.filename, revision=spec.revision, cache_dir=cache, force_download=again)

    return fetch
