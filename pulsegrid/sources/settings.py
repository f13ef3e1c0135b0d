"""Settings: the defaults, where results go, what is rendered, and a user's own copies of these files."""

from __future__ import annotations

import json
import logging
import os
import sys
from collections.abc import Callable
from pathlib import Path

from .folders import load_json

#: The settings that the steps read, with their defaults.
DEFAULTS = {
    "FlatFieldCorrection": {"GWRatio": 0.07, "Border": 0.15},
    "NumberOfWorkers": 0.5,
    "Mask": {"VesselSegmentationMethod": "AI", "DiaphragmRadius": 0.45, "CropChoroidRadius": 0.1},
    "VelocityEstimation": {"LocalBackgroundDist": 2, "Lambda": 8.52e-7, "Phi": 0.25},
    "DebugMode": False,
    "Version": 1.0,
}
#: The groups of a result folder and the artifacts in them.
LAYOUT = {
    "segmentation": {
        "Retina": {"vessel_mask": "retinal_vessel_mask", "labeled_vessels": "labeled_vessels", "vessel_segmentation_logits": "vessel_segmentation_logits", "artery_mask": "retinal_artery_mask", "vein_mask": "retinal_vein_mask"},
        "Choroid": {"vessel_mask": "choroidal_vessel_mask"},
        "OpticDisc": {"disc": "optic_disc"},
    },
    "waveform": {"Retina": {"M0_vessel_branch": "branch_signals"}},
    "analysis": {
        "retinal_velocity_array": "retinal_vessel_velocity",
        "retinal_artery_velocity_signal": "retinal_artery_velocity_signal",
        "retinal_vein_velocity_signal": "retinal_vein_velocity_signal",
        "velocity_map_avg": "velocity_map_avg",
        "fRMS_avg": "fRMS_avg",
        "fRMS_bkg_avg": "fRMS_bkg_avg",
        "velocitysignal_per_beat": "retinal_artery_velocity_signal_filtered_perbeat",
        "velocitysignal_filtered": "retinal_artery_velocity_signal_filtered",
        "beat_indices": "beat_indices",
        "time_per_beat": "time_per_beat",
    },
}
#: What is rendered of a run, and how.
RENDERED = {
    "image": ["M0_ff_image", "vessel_segmentation_logits", "correlation", "diasys_image", "velocity_map_avg", "fRMS_avg", "fRMS_bkg_avg"],
    "mask": ["retinal_vessel_mask", "retinal_artery_mask", "retinal_vein_mask", "pre_artery_mask", "pre_vein_mask", "choroidal_vessel_mask"],
    "signal": ["pre_arterial_pulse", "pre_arterial_pulse_filtered", "pre_arterial_pulse_interpolated", "choroidal_pulse", "choroidal_pulse_filtered", "retinal_artery_velocity_signal", "retinal_vein_velocity_signal"],
    "optic_disc": ["optic_disc"],
    "labeled_mask": ["labeled_vessels"],
}
#: Files of a user's folder and their defaults.
FILES = {"settings.json": DEFAULTS, "layout.json": LAYOUT, "rendered.json": {k: kind for kind, keys in RENDERED.items() for k in keys}}


def user_folder(name: str = "pulsegrid") -> Path:
    """The user's settings folder on this system, created where it is missing."""
    base = Path(os.environ.get("APPDATA") or Path.home()) if sys.platform == "win32" else Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config")
    path = base / name
    path.mkdir(parents=True, exist_ok=True)
    return path


def version_of(settings: dict) -> float:
    return settings.get("Version", 0)


def ensure_file(folder: str | Path, name: str, versioned: bool = False) -> Path:
    """The folder's file of this name: written from the default where it is missing, or older if versions count."""
    path = Path(folder) / name
    default = FILES[name]
    if not path.exists() or (versioned and version_of(load_json(path)) < version_of(default)):
        path.write_text(json.dumps(default, indent=2))
    return path


def merged(base: dict, over: dict) -> dict:
    """Nested settings, those of ``over`` first."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def load_settings(explicit: str | None, local: str | Path | None, mode: str = "local") -> dict:
    """The defaults, under the acquisition's own settings (mode "local"), under the ones given explicitly."""
    if mode not in ("local", "default"):
        raise ValueError(f"unknown settings mode {mode!r}; there are local and default")
    out = DEFAULTS
    if mode == "local" and local is not None and Path(local).exists():
        out = merged(out, load_json(local))
    return merged(out, load_json(explicit)) if explicit else out


def load_or_default(path: str | None, name: str, read: Callable = load_json) -> dict:
    """A given file, or the default of that name."""
    return read(path) if path else FILES[name]


def start_logging(folder: str | Path | None = None, level: int = logging.INFO) -> Path:
    """Messages to the terminal, and with their times to last_run.log, which begins anew; returns the file."""
    folder = Path(folder) if folder else user_folder() / "logs"
    folder.mkdir(parents=True, exist_ok=True)
    root, path = logging.getLogger(), folder / "last_run.log"
    root.setLevel(level)
    for old in list(root.handlers):
        root.removeHandler(old)
        old.close()
    terminal, file = logging.StreamHandler(), logging.FileHandler(path, mode="w", encoding="utf-8")
    terminal.setFormatter(logging.Formatter("%(message)s"))
    file.setFormatter(logging.Formatter("%(asctime)s | %(levelname)s | %(name)s | %(message)s"))
    for h in (terminal, file):
        root.addHandler(h)
    return path
