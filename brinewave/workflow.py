"""Batches of steps: a directed acyclic graph of frames, run in order of need."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame


@dataclass
class Step:
    """``run`` gets the frames of the steps it depends on, in their order."""

    name: str
    run: Callable[..., DataFrame]
    depends_on: list[str] = field(default_factory=list)


def run(steps: list[Step], keep_going: bool = False) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """(frames by step, errors by step). Spark runs what sinks need; steps only declare plans.

    With ``keep_going`` a failing step takes those that depend on it along, no others.
    """
    by_name = {s.name: s for s in steps}
    if len(by_name) < len(steps):
        raise ValueError("step names must differ")
    for s in steps:
        for d in s.depends_on:
            if d not in by_name:
                raise ValueError(f"step {s.name!r} depends on unknown {d!r}")
    try:
        order = list(TopologicalSorter({s.name: s.depends_on for s in steps}).static_order())
    except CycleError as error:
        raise ValueError(f"steps depend on each other: {error.args[1]}") from error
    frames: dict[str, DataFrame] = {}
    errors: dict[str, str] = {}
    for name in order:
        step = by_name[name]
        failed = [d for d in step.depends_on if d in errors]
        if failed:
            errors[name] = f"needs {failed[0]}"
            continue
        try:
            frames[name] = step.run(*[frames[d] for d in step.depends_on])
        except Exception as error:
            if not keep_going:
                raise
            errors[name] = str(error)
    return frames, errors
