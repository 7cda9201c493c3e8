"""Factor graphs: named columns over bars, each from bar fields or other nodes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.functions import factors, signals
from marketlake.plans.spec import node_order


def _column(make: Callable[..., Column]) -> Callable[[DataFrame, list[str], dict, str], DataFrame]:
    return lambda df, ins, params, out: df.withColumn(out, make(ins, params))


OPS: dict[str, Callable[[DataFrame, list[str], dict, str], DataFrame]] = {
    "SMA": _column(lambda i, p: factors.sma(i[0], int(p.get("period", 20)))),
    "EMA": lambda df, i, p, out: factors.ema(df, i[0], int(p.get("period", 20)), out, p.get("seed", "first")),
    "RSI": lambda df, i, p, out: factors.rsi(df, int(p.get("period", 14)), i[0], out),
    "MACD": lambda df, i, p, out: factors.macd(df, i[0]).withColumnRenamed("macd_hist", out).drop("macd", "macd_signal"),
    "BOLL": _column(lambda i, p: factors.bollinger(i[0], int(p.get("period", 20)), float(p.get("k", 2.0)))[{"upper": 0, "middle": 1, "lower": 2}[p.get("band", "middle")]]),
    "CROSS_ABOVE": _column(lambda i, p: signals.cross_above(i[0], i[1])),
    "CROSS_BELOW": _column(lambda i, p: signals.cross_below(i[0], i[1])),
    "THRESHOLD": _column(lambda i, p: signals.threshold_sign(F.col(i[0]), float(p["value"]))),
    "AND": _column(lambda i, p: signals.and_bool(F.col(i[0]), F.col(i[1]))),
    "OR": _column(lambda i, p: signals.or_bool(F.col(i[0]), F.col(i[1]))),
    "NOT": _column(lambda i, p: signals.not_(F.col(i[0]))),
    "ABOVE": _column(lambda i, p: signals.above(F.col(i[0]), F.col(i[1]))),
    "BELOW": _column(lambda i, p: signals.below(F.col(i[0]), F.col(i[1]))),
}


def apply_factor_graph(bars: DataFrame, spec: list[dict], extra: dict[str, Callable[[DataFrame, list[str], dict, str], DataFrame]] | None = None) -> DataFrame:
    """``bars`` with one more column for each node {id, op, inputs, params}, in order of their dependencies.

    An unknown operation, a reference to nothing, a repeated id or a cycle is an error. ``extra`` adds operations: functions of
    (frame, inputs, params, name of the output). All window columns share one partitioning and order, so one sort serves them.
    """
    ops, nodes = OPS | (extra or {}), {n["id"]: n for n in spec}
    if len(nodes) != len(spec) or set(nodes) & set(bars.columns):
        raise ValueError("node ids must be distinct and differ from bar fields")
    for n in spec:
        if n["op"] not in ops:
            raise ValueError(f"unknown operation {n['op']}")
        if bad := [i for i in n["inputs"] if i not in nodes and i not in bars.columns]:
            raise ValueError(f"{n['id']} refers to {bad}")
    for n in node_order(spec):
        bars = ops[n["op"]](bars, n["inputs"], n.get("params", {}), n["id"])
    return bars


def handle_signals(signals: DataFrame, handlers: dict[str, Callable[[DataFrame], DataFrame]], signal: str = "signal") -> dict[str, DataFrame]:
    """What each user handler makes of the rows with a signal, by name: rows of orders, alerts and so on. A handler is a function of
    tables, so it is planned with the rest and works on streams too."""
    live = signals.filter(F.col(signal).isNotNull() & (F.col(signal) != 0))
    return {name: live.transform(handler) for name, handler in handlers.items()}
