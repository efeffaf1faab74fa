"""A graph of named nodes, each a function of the frames that its edges bring."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame

from tidemill.operators.routing import fan_in


@dataclass(frozen=True)
class Node:
    """``apply`` gets the union of what ``inputs`` return, or nothing if it has none (a source)."""

    name: str
    apply: Callable[..., DataFrame]
    inputs: tuple[str, ...] = ()
    #: Columns that every input must have; others may come along.
    needs: frozenset[str] = frozenset()


def run_workflow(nodes: list[Node]) -> dict[str, DataFrame]:
    """Walks the graph in topological order; one node's frame feeds all edges that leave it."""
    named = {n.name: n for n in nodes}
    for node in nodes:
        if unknown := set(node.inputs) - set(named):
            raise ValueError(f"{node.name} reads unknown nodes {sorted(unknown)}")
    try:
        order = list(TopologicalSorter({n.name: n.inputs for n in nodes}).static_order())
    except CycleError as e:
        raise ValueError(f"the workflow has a cycle: {e.args[1]}") from None
    done: dict[str, DataFrame] = {}
    for name in order:
        node = named[name]
        frames = [done[i] for i in node.inputs]
        for source, frame in zip(node.inputs, frames):
            if missing := node.needs - set(frame.columns):
                raise ValueError(f"{source} brings {name} no {sorted(missing)}")
        done[name] = node.apply(fan_in(*frames)) if frames else node.apply()
    return done
