"""Acquisition and result folders, batch lists, and settings files."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Acquisition:
    """What one acquisition folder holds."""

    acq_id: str
    settings: Path
    moments: Path


def resolve_path(path: str | Path) -> Path:
    """A folder, or the folder beside a .holo file that has its name."""
    p = Path(path)
    if p.suffix == ".holo":
        p = p.parent / p.stem
    if not p.is_dir():
        raise NotADirectoryError(f"{p} is no folder")
    return p


def acquisition(path: str | Path) -> Acquisition:
    """<m>/<m>_HD: json/parameters.json (else the first JSON) and h5/*output.h5, *raw.h5, or the first .h5."""
    parent = resolve_path(path)
    home = parent / f"{parent.name}_HD"
    if not home.is_dir():
        raise FileNotFoundError(f"{home} is missing")
    named = home / "json" / "parameters.json"
    settings = named if named.is_file() else next(iter(sorted((home / "json").glob("*.json"))), None)
    if settings is None:
        raise FileNotFoundError(f"{home}/json has no JSON file")
    files = sorted((home / "h5").glob("*.h5"))
    if not files:
        raise FileNotFoundError(f"{home}/h5 has no .h5 file")
    return Acquisition(parent.name, settings, min(files, key=lambda f: (priority(f.name), f.name)))


def priority(name: str) -> int:
    """0 for *output.h5, 1 for *raw.h5, 2 for others."""
    return 0 if name.endswith("output.h5") else 1 if name.endswith("raw.h5") else 2


def batch(path: str | Path) -> list[str]:
    """Paths of a text file (one a line, blank lines left out) or the folders inside a folder."""
    p = Path(path)
    if p.is_dir():
        return [str(x) for x in sorted(p.iterdir()) if x.is_dir()]
    return [x.strip() for x in p.read_text().splitlines() if x.strip()]


def next_output(names: list[str]) -> str:
    """The name after the highest output_<n>."""
    found = [int(m[1]) for n in names if (m := re.fullmatch(r"output_(\d+)", n))]
    return f"output_{max(found, default=-1) + 1}"


class Results:
    """<m>_DV beside an acquisition's data: h5 (artifacts), output, cache and config folders.

    The settings file is written with the defaults where there is none.  An output folder is
    only made when something is put in it; the run's settings are then written there.
    """

    def __init__(self, path: str | Path, settings: dict | None = None):
        from .settings import ensure_file

        parent = resolve_path(path)
        self.home = parent / f"{parent.name}_DV"
        for d in ("h5", "output", "cache", "config"):
            (self.home / d).mkdir(parents=True, exist_ok=True)
        self.settings_file = ensure_file(self.home / "config", "settings.json")
        self.settings, self.made = settings, None

    @property
    def artifacts(self) -> Path:
        return self.home / "h5"

    def output(self) -> Path:
        """This run's output folder, made at the first call."""
        if self.made is None:
            self.made = self.home / "output" / next_output([x.name for x in (self.home / "output").iterdir() if x.is_dir()])
            self.made.mkdir()
            if self.settings is not None:
                (self.made / "settings.json").write_text(json.dumps(self.settings, default=str))
        return self.made


def strip_keys(value: Any) -> Any:
    """Spaces out of all keys of nested objects; of keys that become equal the last wins."""
    if isinstance(value, dict):
        return {k.replace(" ", ""): strip_keys(v) for k, v in value.items()}
    return [strip_keys(v) for v in value] if isinstance(value, list) else value


def load_json(path: str | Path) -> dict:
    return strip_keys(json.loads(Path(path).read_text()))


def ordered(value: Any) -> Any:
    """Nested objects and lists in an order of their own, for comparisons that ignore order."""
    if isinstance(value, dict):
        return sorted((k, ordered(v)) for k, v in value.items())
    return sorted((ordered(v) for v in value), key=repr) if isinstance(value, list) else value


def flatten_layout(layout: dict, at: str = "") -> dict[str, str]:
    """{artifact: "group/name"} from nested groups whose leaves are artifact names."""
    out: dict[str, str] = {}
    for k, v in layout.items():
        here = f"{at}/{k}" if at else k
        out |= flatten_layout(v, here) if isinstance(v, dict) else {v: here}
    return out


def workers(setting: float, cores: int) -> int:
    """-1: all cores; -2: all but one; under 1: a share; else a number."""
    if setting == -1:
        return cores
    if setting == -2:
        return max(1, cores - 1)
    return max(1, int(cores * setting)) if 0 < setting < 1 else max(1, int(setting))
