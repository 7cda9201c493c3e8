"""Row-level signals over factor columns, and combinations of strategies' signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from marketlake.functions.factors import by_symbol


def cross_above(a: str, b: str, key: str = "symbol", order: str = "ts") -> Column:
    """1 where a was not above b one row before and is now; else 0."""
    w = by_symbol(key, order)
    return F.coalesce(F.when((F.lag(a).over(w) <= F.lag(b).over(w)) & (F.col(a) > F.col(b)), 1.0), F.lit(0.0))


def cross_below(a: str, b: str, key: str = "symbol", order: str = "ts") -> Column:
    """-1 where a was not below b one row before and is now; else 0."""
    w = by_symbol(key, order)
    return F.coalesce(F.when((F.lag(a).over(w) >= F.lag(b).over(w)) & (F.col(a) < F.col(b)), -1.0), F.lit(0.0))


def above(a: Column, b: Column) -> Column:
    return F.coalesce(F.when(a > b, a - b), F.lit(0.0))


def below(a: Column, b: Column) -> Column:
    return F.coalesce(F.when(a < b, b - a), F.lit(0.0))


def and_(*s: Column) -> Column:
    """The least of all-positive signals, the greatest of all-negative ones, else 0."""
    up = reduce(lambda x, y: x & y, [c > 0 for c in s])
    down = reduce(lambda x, y: x & y, [c < 0 for c in s])
    return F.when(up, F.least(*s)).when(down, F.greatest(*s)).otherwise(0.0)


def or_(*s: Column) -> Column:
    """The greatest positive signal, else the least negative one, else 0."""
    top, low = F.greatest(*s), F.least(*s)
    return F.when(top > 0, top).when(low < 0, low).otherwise(0.0)


def and_bool(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), 1.0).otherwise(0.0)


def or_bool(a: Column, b: Column) -> Column:
    return F.when((a > 0) | (b > 0), 1.0).otherwise(0.0)


def not_(s: Column) -> Column:
    return -s


def threshold_gate(s: Column, v: float) -> Column:
    return F.when(F.abs(s) >= v, s).otherwise(0.0)


def threshold_sign(s: Column, v: float) -> Column:
    return F.when(s > v, 1.0).when(s < -v, -1.0).otherwise(0.0)


def direction(value: Column) -> tuple[Column, Column]:
    """(direction, strength); both null for a null value."""
    d = F.when(value > 0, "LONG").when(value < 0, "SHORT").when(value == 0, "EXIT")
    return d, F.abs(value)


def live_signals(df: DataFrame, value: str, factors: list[str]) -> DataFrame:
    """Rows with |value| above 0.001: side, quantity, confidence and a snapshot of the factors."""
    v = F.col(value)
    out = df.withColumn("side", F.when(v > 0.001, 1).when(v < -0.001, -1)).filter("side is not null")
    snap = F.map_from_arrays(F.array(*map(F.lit, factors)), F.array(*[F.col(f).cast("double") for f in factors]))
    return out.withColumn("quantity", F.floor(F.abs(v) * 100).cast("int")).withColumn("confidence", F.abs(v)).withColumn("factors", snap)


def combine(signals: DataFrame, method: str, strategies: int, keys: tuple[str, ...] = ("ts", "symbol")) -> DataFrame:
    """One signal per key from the rows (strategy_no, weight, direction, strength) of several strategies.

    union: the first strategy's; vote: at least max(1, n // 2 + 1) signals, mean strength, the first's direction;
    weighted: the sum of strength * weight over all strategies' weights, the heaviest's direction.
    """
    first = F.min_by("direction", "strategy_no").alias("direction")
    if method == "union":
        return signals.groupBy(*keys).agg(first, F.min_by("strength", "strategy_no").alias("strength"))
    if method == "vote":
        return signals.groupBy(*keys).agg(first, F.avg("strength").alias("strength"), F.count("*").alias("n")).filter(F.col("n") >= max(1, strategies // 2 + 1)).drop("n")
    if method == "weighted":
        total = signals.select("strategy_no", "weight").distinct().agg(F.sum("weight").alias("total"))
        heavy = F.max_by("direction", F.struct("weight", -F.col("strategy_no"))).alias("direction")
        out = signals.groupBy(*keys).agg(heavy, F.sum(F.col("strength") * F.col("weight")).alias("s"))
        return out.join(F.broadcast(total)).select(*keys, "direction", F.try_divide("s", "total").alias("strength"))  # one row
    raise ValueError(f"unknown method {method}")


def combine_layered(signals: DataFrame, strategies: int, keys: tuple[str, ...] = ("ts", "symbol")) -> DataFrame:
    """The first half of the strategies proposes, the second confirms: each proposing strategy's first signal at a time whose
    symbol both layers hold long or short. Fewer than two strategies: union."""
    if strategies < 2:
        return combine(signals, "union", strategies, keys)
    live = signals.filter(F.col("direction").isin("LONG", "SHORT"))
    half = strategies // 2
    timing = live.filter(F.col("strategy_no") >= half).select(*keys).distinct()
    confirmed = live.filter(F.col("strategy_no") < half).join(timing, list(keys), "left_semi")
    w = Window.partitionBy("strategy_no", keys[0]).orderBy(*keys[1:])
    return confirmed.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select(*keys, "strategy_no", "direction", "strength")


def ma_cross(fast: str = "sma_5", slow: str = "sma_20") -> Column:
    """Golden cross 1, death cross -1, else 0."""
    return cross_above(fast, slow) + cross_below(fast, slow)


def rsi_ma_combo(rsi: str = "rsi", fast: str = "sma_5", slow: str = "sma_20", low: float = 30, high: float = 70) -> Column:
    """A golden cross below the upper RSI bound buys, a death cross above the lower one sells."""
    up, down = cross_above(fast, slow), cross_below(fast, slow)
    return F.when((up > 0) & (F.col(rsi) < high), 1.0).when((down < 0) & (F.col(rsi) > low), -1.0).otherwise(0.0)
