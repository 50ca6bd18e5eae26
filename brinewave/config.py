"""Settings as frozen dataclasses, from files and the environment."""

from __future__ import annotations

import os
import tomllib
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Stft:
    n_fft: int = 2048
    hop_length: int = 512
    window: str = "hann"


@dataclass(frozen=True)
class Mfcc:
    n_mfcc: int = 13
    n_mels: int = 128


@dataclass(frozen=True)
class Segmentation:
    threshold_db: float = -40.0
    min_silence: float = 0.1
    min_segment: float = 0.2
    padding: float = 0.05


@dataclass(frozen=True)
class Scaling:
    kind: str = "standard"


@dataclass(frozen=True)
class Logging:
    level: str = "INFO"


@dataclass(frozen=True)
class Settings:
    stft: Stft = field(default_factory=Stft)
    mfcc: Mfcc = field(default_factory=Mfcc)
    segmentation: Segmentation = field(default_factory=Segmentation)
    scaling: Scaling = field(default_factory=Scaling)
    logging: Logging = field(default_factory=Logging)


def _merged(base: Any, more: dict) -> Any:
    known = {f.name: getattr(base, f.name) for f in fields(base)}
    unknown = more.keys() - known.keys()
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return replace(base, **{k: _merged(known[k], v) if is_dataclass(known[k]) else type(known[k])(v) for k, v in more.items()})


def load(files: list[str | Path] = (), environ: dict[str, str] | None = None, prefix: str = "BRINEWAVE__") -> Settings:
    """Defaults, then files in order, then variables such as BRINEWAVE__STFT__HOP_LENGTH."""
    out = Settings()
    for path in files:
        if Path(path).exists():
            with open(path, "rb") as f:
                out = _merged(out, tomllib.load(f))
    for key, value in (os.environ if environ is None else environ).items():
        if key.startswith(prefix):
            section, _, name = key[len(prefix) :].lower().partition("__")
            out = _merged(out, {section: {name: value}})
    return out


def show(settings: Settings, path: str = "") -> dict:
    """The settings, or one section, as a dictionary."""
    out: Any = asdict(settings)
    for part in filter(None, path.split(".")):
        out = out[part]
    return out
