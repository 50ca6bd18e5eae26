"""Plugins: manifests, compatibility, state, and what they register."""

from __future__ import annotations

import importlib
import importlib.metadata
import json
import re
import sys
import tomllib
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from brinewave import __version__
from brinewave.sources.formats import Registry

REQUIRED = ("name", "version", "api", "entry_point")
GROUP = "brinewave.plugins"


class Plugin(Protocol):
    """What an entry point gives; the hooks get the registry."""

    name: str
    version: str

    def setup(self, config: dict) -> None: ...
    def register(self, registry: Registry) -> None: ...
    def teardown(self) -> None: ...


def manifest(path: str | Path) -> dict:
    """A plugin.toml with name, version, api and entry_point."""
    with open(path, "rb") as f:
        out = tomllib.load(f)
    missing = [k for k in REQUIRED if not out.get(k)]
    if missing:
        raise ValueError(f"{path}: missing {', '.join(missing)}")
    return out


def compatible(spec: str, version: str = __version__) -> bool:
    """Whether a version fulfils clauses such as ``>=0.1,<2``."""
    number = lambda v: [int(x) for x in re.findall(r"\d+", v)][:3] + [0] * (3 - len(re.findall(r"\d+", v)[:3]))
    tests = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, "<": lambda a, b: a < b}
    for clause in filter(None, map(str.strip, spec.split(","))):
        m = re.fullmatch(r"(==|!=|>=|<=|>|<|~=)?\s*(\d[\w.]*)", clause)
        if not m:
            raise ValueError(f"not a version clause: {clause!r}")
        op, v = m[1] or "==", number(m[2])
        if op == "~=":
            parts = len(re.findall(r"\d+", m[2]))
            if not (number(version) >= v and number(version)[: max(1, parts - 1)] == v[: max(1, parts - 1)]):
                return False
        elif not tests[op](number(version), v):
            return False
    return True


class Loader:
    """Finds plugins (entry points first, then folders), loads the enabled ones, keeps their status."""

    def __init__(self, registry: Registry, folder: str | Path | None = None, state: str | Path | None = None):
        self.registry, self.folder, self.state = registry, folder, Path(state) if state else None
        self.loaded: dict[str, Plugin] = {}
        self.status: dict[str, tuple[str, str, str]] = {}

    def _disabled(self) -> set[str]:
        return set(json.loads(self.state.read_text())["disabled"]) if self.state and self.state.exists() else set()

    def enable(self, name: str, on: bool = True) -> None:
        if not self.state:
            raise ValueError("the loader has no state file")
        off = self._disabled() - {name} if on else self._disabled() | {name}
        self.state.write_text(json.dumps({"disabled": sorted(off)}))

    def load(self, config: dict | None = None) -> None:
        for point in importlib.metadata.entry_points(group=GROUP):
            self._one(point.name, "", "", point.load, config)
        for path in sorted(Path(self.folder).glob("*/plugin.toml")) if self.folder else ():
            try:
                m = manifest(path)
            except (ValueError, tomllib.TOMLDecodeError) as error:
                self.status[path.parent.name] = ("", "error-load_failed", str(error))
                continue
            if m["name"] not in self.loaded:
                self._one(m["name"], m["version"], m["api"], lambda m=m, p=path: self._import(m["entry_point"], p.parent), config)

    @staticmethod
    def _import(entry: str, folder: Path):
        module, _, attribute = entry.partition(":")
        sys.path.insert(0, str(folder))
        try:
            return getattr(importlib.import_module(module), attribute)
        finally:
            sys.path.remove(str(folder))

    def _one(self, name: str, version: str, api: str, get, config: dict | None) -> None:
        if name in self._disabled():
            self.status[name] = (version, "disabled", "")
            return
        if api and not compatible(api):
            self.status[name] = (version, "error-incompatible", f"needs {api}, there is {__version__}")
            return
        try:
            plugin = get()()
            plugin.setup(config or {})
            plugin.register(self.registry)
        except Exception as error:  # a broken plugin must not stop the others
            self.status[name] = (version, "error-load_failed", str(error))
            return
        self.loaded[name] = plugin
        self.status[name] = (version or plugin.version, "loaded", "")

    def catalog(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(n, *s) for n, s in sorted(self.status.items())], "name string, version string, status string, reason string")

    def teardown(self) -> None:
        for plugin in self.loaded.values():
            plugin.teardown()
        self.loaded.clear()
