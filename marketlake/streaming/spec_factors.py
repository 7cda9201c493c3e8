"""A factor graph as stream state: each node keeps what its next value needs, and no more."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from marketlake.plans.spec import node_order
from marketlake.streaming.moving import window_sum

Step = Callable[[list, tuple, dict], float | None]


def _window(state: list, x: float | None, n: int) -> tuple[list, float] | None:
    """The last n values and their mean, if all are there; state: the number of rows so far and the last values."""
    rows, last = state or (0, [])
    rows, last = rows + 1, [*last, x][-n:]
    state[:] = (rows, last)
    return (last, window_sum(last, rows - n) / n) if len(last) == n and None not in last else None


def _sma(state: list, ins: tuple, p: dict) -> float | None:
    found = _window(state, ins[0], int(p.get("period", 20)))
    return found[1] if found else None


def _boll(state: list, ins: tuple, p: dict) -> float | None:
    found = _window(state, ins[0], int(p.get("period", 20)))
    if not found:
        return None
    last, mean = found
    side = {"upper": 1, "middle": 0, "lower": -1}[p.get("band", "middle")]
    return mean + side * float(p.get("k", 2.0)) * math.sqrt(sum((x - mean) ** 2 for x in last) / len(last))


def _mean(state: list, x: float | None, alpha: float, start: int) -> float | None:
    """An exponential mean that starts from the plain mean of the first values; state: their number and the mean so far."""
    if x is None:
        return None
    n, y = state or (0, 0.0)
    n += 1
    y = y + (x - y) / n if n <= start else y + (x - y) * alpha
    state[:] = (n, y)
    return y if n >= start else None


def _ema(state: list, ins: tuple, p: dict) -> float | None:
    n = int(p.get("period", 20))
    return _mean(state, ins[0], 2 / (n + 1), 1 if p.get("seed", "first") == "first" else n)


def _rsi(state: list, ins: tuple, p: dict) -> float | None:
    n, x = int(p.get("period", 14)), ins[0]
    before, gains, losses = state or (None, [], [])
    gain = loss = None
    if x is not None and before is not None:
        gain, loss = _mean(gains, max(x - before, 0.0), 1 / n, n), _mean(losses, max(before - x, 0.0), 1 / n, n)
    state[:] = (x, gains, losses)
    if loss is None:
        return None
    return 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss)


def _macd(state: list, ins: tuple, p: dict) -> float | None:
    fast, slow, line = state or ([], [], [])
    f, s = _mean(fast, ins[0], 2 / 13, 12), _mean(slow, ins[0], 2 / 27, 26)
    macd = None if f is None or s is None else f - s
    signal = _mean(line, macd, 2 / 10, 9)
    state[:] = (fast, slow, line)
    return None if signal is None else macd - signal


def _cross(sign: float) -> Step:
    def step(state: list, ins: tuple, p: dict) -> float:
        a, b = ins
        pa, pb = state or (None, None)
        state[:] = (a, b)
        if None in (a, b, pa, pb):
            return 0.0
        return sign if sign * pa <= sign * pb and sign * a > sign * b else 0.0

    return step


def _over(x: float | None, limit: float = 0.0) -> bool:
    return x is not None and x > limit


#: What each operation of a factor graph keeps, in a list of its own, and gives for the next row; the same values as its columns.
STEPS: dict[str, Step] = {
    "SMA": _sma,
    "BOLL": _boll,
    "EMA": _ema,
    "RSI": _rsi,
    "MACD": _macd,
    "CROSS_ABOVE": _cross(1.0),
    "CROSS_BELOW": _cross(-1.0),
    "THRESHOLD": lambda s, i, p: 1.0 if _over(i[0], float(p["value"])) else -1.0 if i[0] is not None and i[0] < -float(p["value"]) else 0.0,
    "AND": lambda s, i, p: 1.0 if _over(i[0]) and _over(i[1]) else 0.0,
    "OR": lambda s, i, p: 1.0 if _over(i[0]) or _over(i[1]) else 0.0,
    "NOT": lambda s, i, p: None if i[0] is None else -i[0],
    "ABOVE": lambda s, i, p: i[0] - i[1] if None not in i and i[0] > i[1] else 0.0,
    "BELOW": lambda s, i, p: i[1] - i[0] if None not in i and i[0] < i[1] else 0.0,
}


class SpecFactors(StatefulProcessor):
    """The nodes of a spec for one symbol, bar by bar in time order. A bar that is not later than the last one is marked late and changes nothing."""

    def __init__(self, nodes: list[dict], fields: list[str], steps: dict[str, Step]) -> None:
        self.nodes, self.fields, self.steps = nodes, fields, steps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("nodes", "last timestamp, nodes string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        last, nodes = None, {n["id"]: [] for n in self.nodes}
        if self.state.exists():
            last, text = self.state.get()
            nodes, last = json.loads(text), pd.Timestamp(last)
        batch = pd.concat(list(rows)).sort_values("ts", kind="stable")
        names, out = [n["id"] for n in self.nodes], []
        for ts, *values in zip(batch["ts"], *[batch[f] for f in self.fields], strict=True):
            late = last is not None and ts <= last
            now = {f: None if pd.isna(v) else float(v) for f, v in zip(self.fields, values, strict=True)}
            if not late:
                last = ts
                for n in self.nodes:
                    now[n["id"]] = self.steps[n["op"]](nodes[n["id"]], tuple(now[i] for i in n["inputs"]), n.get("params", {}))
            out.append((key[0], ts, late, *[None if late else now[n] for n in names]))
        self.state.update((last.to_pydatetime(), json.dumps(nodes)))
        frame = pd.DataFrame(out, columns=["symbol", "ts", "late", *names])
        yield frame.astype(dict.fromkeys(names, "float64"))

    def close(self) -> None:
        pass


def live_spec_factors(bars: DataFrame, spec: list[dict], extra: dict[str, Step] | None = None) -> DataFrame:
    """(symbol, ts, late, one column for each node) of a stream of closed bars; the same spec as ``apply_factor_graph`` takes.

    State of a symbol is a window for each moving mean, a mean and a count for each exponential one and the last pair of each
    cross, whatever the length of the stream. A symbol's bars of one micro-batch are sorted in memory, so the source's
    ``maxFilesPerTrigger`` or ``maxBytesPerTrigger`` bounds it. Late bars have no values: ``keep_factors`` recomputes what they reach. Of bars
    of one time the first counts. ``extra`` adds operations: functions of (state list, inputs, params) that change the list and give the value.
    """
    nodes, steps = node_order(spec), STEPS | (extra or {})
    ids = {n["id"] for n in nodes}
    for n in nodes:
        if n["op"] not in steps:
            raise ValueError(f"unknown operation {n['op']}")
    fields = sorted({i for n in nodes for i in n["inputs"]} - ids)
    if missing := [f for f in fields if f not in bars.columns]:
        raise ValueError(f"bars have no {missing}")
    schema = "symbol string, ts timestamp, late boolean, " + ", ".join(f"`{n['id']}` double" for n in nodes)
    rows = bars.select("symbol", "ts", *[F.col(f).cast("double").alias(f) for f in fields])
    return rows.groupBy("symbol").transformWithStateInPandas(SpecFactors(nodes, fields, steps), schema, "Append", "None")
