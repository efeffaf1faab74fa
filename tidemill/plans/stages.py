"""Planning: stages of transforms from the fields they read and write; scheduling of pipelines."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import TypeVar

from pyspark.sql import DataFrame

Tables = dict[str, DataFrame]
Result = TypeVar("Result")


@dataclass(frozen=True)
class Retry:
    """How often and after what pauses (seconds) a failed call is made again."""

    mode: str = "exponential"  # or "fixed", "none"
    times: int = 3
    base: float = 0.1
    factor: float = 2.0
    cap: float = 30.0
    jitter: float = 0.1

    def __post_init__(self):
        if self.mode not in ("exponential", "fixed", "none"):
            raise ValueError(f"no retry mode {self.mode!r}")

    def pauses(self) -> list[float]:
        """The pause before each further attempt, without jitter."""
        grow = self.factor if self.mode == "exponential" else 1.0
        return [] if self.mode == "none" else [min(self.cap, self.base * grow**k) for k in range(self.times)]


@dataclass
class RunStats:
    """What a run did: rows, calls made again, and seconds."""

    rows: int | None = None
    retries: int = 0
    seconds: float = 0.0
    error: Exception | None = None


def retrying(call: Callable[[], Result], policy: Retry = Retry(), stats: RunStats | None = None) -> Result:
    """``call()``, made again by ``policy`` when it fails: for the read of a source or the write of a
    sink. Spark retries tasks by itself; this is for what fails as a whole. The last error is raised."""
    for pause in [*policy.pauses(), None]:
        try:
            return call()
        except Exception:
            if pause is None:
                raise
            if stats is not None:
                stats.retries += 1
            time.sleep(pause * (1 + random.uniform(-policy.jitter, policy.jitter)))
    raise AssertionError("unreachable")


@dataclass(frozen=True)
class Transform:
    """A transform over tables that declares its fields as (table, field), or (table, "*") for all."""

    name: str
    reads: frozenset[tuple[str, str]]
    writes: frozenset[tuple[str, str]]
    run: Callable[[Tables], Tables]


def _meets(a: frozenset, b: frozenset) -> bool:
    return any(x[0] == y[0] and (x[1] == y[1] or "*" in (x[1], y[1])) for x in a for y in b)


def stages(transforms: list[Transform], schemas: dict[str, list[str]] | None = None) -> list[list[Transform]]:
    """Levels of the conflict graph: a later transform waits for an earlier one that writes what it
    reads or writes, or reads what it writes. Undeclared tables or fields are errors."""
    for t in transforms:
        for table, name in t.reads | t.writes if schemas else ():
            if table not in schemas:
                raise ValueError(f"{t.name}: no table {table!r}")
            if name != "*" and name not in schemas[table]:
                raise ValueError(f"{t.name}: {table} has no field {name!r}; it has {schemas[table]}")
    level: list[int] = []
    for j, b in enumerate(transforms):
        waits = [level[i] for i, a in enumerate(transforms[:j]) if _meets(a.writes, b.reads | b.writes) or _meets(a.reads, b.writes)]
        level.append(max(waits, default=-1) + 1)
    return [[t for t, at in zip(transforms, level) if at == k] for k in range(max(level, default=-1) + 1)]


def run_stages(transforms: list[Transform], tables: Tables, made: dict[str, list[str]] | None = None) -> Tables:
    """Applies the transforms stage by stage. Nothing runs here: Spark sees one plan.

    Declared fields are checked against the columns of ``tables`` and those that the transforms
    declare to write; ``made`` adds fields that they make besides.
    """
    tables = dict(tables)
    known = {name: list(df.columns) for name, df in tables.items()}
    for t in transforms:
        for name, column in t.writes:
            known.setdefault(name, []).append(column)
    for name, columns in (made or {}).items():
        known.setdefault(name, []).extend(columns)
    for stage in stages(transforms, known):
        for t in stage:
            tables |= t.run(tables)
    return tables


@dataclass
class Pipeline:
    name: str
    run: Callable[[], int]  # returns the rows produced
    after: dict[str, str] = field(default_factory=dict)  # predecessor -> "order" or "data"
    priority: int = 0
    ready: Callable[[], bool] = lambda: True


def schedule(pipelines: list[Pipeline]) -> list[list[Pipeline]]:
    """Stages of pipelines by dependency, each sorted by priority; a cycle is an error."""
    left, done, out = {p.name: p for p in pipelines}, set(), []
    while left:
        free = [p for p in left.values() if set(p.after) <= done]
        if not free:
            raise ValueError(f"a cycle among {sorted(left)}")
        out.append(sorted(free, key=lambda p: p.priority))
        done |= {p.name for p in free}
        for p in free:
            del left[p.name]
    return out


def run_schedule(pipelines: list[Pipeline], retries: int = 0, pause: float = 0.0, retry: Retry | None = None, stats: dict[str, RunStats] | None = None, carry_on: bool = False) -> dict[str, int | None]:
    """Rows produced by each pipeline, or None if it was skipped: it wasn't ready, or a predecessor
    by data was skipped or produced nothing. ``stats`` gets the figures of each. With ``carry_on``
    a pipeline that fails counts as skipped and the others go on; its error is in the figures."""
    policy = retry or Retry(times=retries, base=pause, jitter=0.0)
    rows: dict[str, int | None] = {}
    for stage in schedule(pipelines):
        for p in stage:
            figures = RunStats()
            if stats is not None:
                stats[p.name] = figures
            if any(kind == "data" and not rows[q] for q, kind in p.after.items()) or not p.ready():
                rows[p.name] = None
                continue
            began = time.monotonic()
            try:
                rows[p.name] = figures.rows = retrying(p.run, policy, figures)
            except Exception as error:
                if not carry_on:
                    raise
                rows[p.name], figures.error = None, error
            figures.seconds = time.monotonic() - began
    return rows
