"""What a factor graph says about itself: the order of its nodes, what depends on what, and how many rows a value reaches."""

from __future__ import annotations

import math
from collections.abc import Callable
from graphlib import CycleError, TopologicalSorter

#: Weights below this are lost in a double, so an exponential mean reaches no further.
EPSILON = 1e-16


def _decay(c: float) -> int:
    return math.ceil(math.log(EPSILON) / math.log(c)) if c > 0 else 0


def _mean(p: dict, default: int) -> int:
    n = int(p.get("period", default))
    return _decay(1 - 2 / (n + 1)) + n


#: How many rows before its own a node's value depends on, given its parameters.
REACH: dict[str, Callable[[dict], int]] = {
    "SMA": lambda p: int(p.get("period", 20)) - 1,
    "BOLL": lambda p: int(p.get("period", 20)) - 1,
    "EMA": lambda p: _mean(p, 20),
    "RSI": lambda p: _decay(1 - 1 / int(p.get("period", 14))) + int(p.get("period", 14)) + 1,
    "MACD": lambda p: _decay(1 - 2 / 27) + 26 + _decay(1 - 2 / 10) + 9,
    "CROSS_ABOVE": lambda p: 1,
    "CROSS_BELOW": lambda p: 1,
    **dict.fromkeys(("THRESHOLD", "AND", "OR", "NOT", "ABOVE", "BELOW"), lambda p: 0),
}


def node_order(spec: list[dict]) -> list[dict]:
    """The nodes in order of their dependencies; a repeated id or a cycle is an error."""
    nodes = {n["id"]: n for n in spec}
    if len(nodes) != len(spec):
        raise ValueError("node ids must be distinct")
    try:
        return [nodes[i] for i in TopologicalSorter({k: {i for i in n["inputs"] if i in nodes} for k, n in nodes.items()}).static_order()]
    except CycleError as e:
        raise ValueError(f"cycle: {e.args[1]}") from e


def dependents(spec: list[dict], changed: set[str]) -> list[str]:
    """The nodes that depend on changed fields or nodes, directly or through others, in order."""
    touched = set(changed)
    for n in node_order(spec):
        if touched & set(n["inputs"]):
            touched.add(n["id"])
    return [n["id"] for n in node_order(spec) if n["id"] in touched]


def reaches(spec: list[dict], changed: set[str], extra: dict[str, Callable[[dict], int]] | None = None) -> dict[str, int]:
    """For each dependent node the rows that a changed row moves on to it, along the longest of its paths from what changed."""
    own, far = REACH | (extra or {}), dict.fromkeys(changed, 0)
    for n in node_order(spec):
        paths = [far[i] for i in n["inputs"] if i in far]
        if paths:
            far[n["id"]] = max(far.get(n["id"], 0), own[n["op"]](n.get("params", {})) + max(paths))
    return {n["id"]: far[n["id"]] for n in spec if n["id"] in far}


def lookback(spec: list[dict], wanted: set[str], given: set[str] = frozenset(), extra: dict[str, Callable[[dict], int]] | None = None) -> int:
    """How many rows before it a row of the wanted nodes needs, where the given nodes are read and not computed."""
    own, back = REACH | (extra or {}), {}
    for n in node_order(spec):
        back[n["id"]] = 0 if n["id"] in given else own[n["op"]](n.get("params", {})) + max([back.get(i, 0) for i in n["inputs"]], default=0)
    return max([back[i] for i in wanted], default=0)
