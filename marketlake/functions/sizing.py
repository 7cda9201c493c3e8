"""Position sizes within a rebalance group; inactive symbols get 0, strengths are clipped to [0, 1]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import Window


def _strength(s: Column) -> Column:
    return F.least(F.greatest(F.abs(s), F.lit(0.0)), F.lit(1.0))


def _active(signal: str) -> Column:
    return F.coalesce(F.col(signal) != 0, F.lit(False))


def equal_weight(group: str, cash: Column, signal: str = "signal") -> Column:
    n = F.sum(_active(signal).cast("int")).over(Window.partitionBy(group))
    return F.when(_active(signal), cash / n * _strength(F.col(signal))).otherwise(0.0)


def risk_parity(group: str, cash: Column, vol: str, signal: str = "signal", floor: float = 0.01, default: float = 0.25) -> Column:
    inverse = 1 / F.greatest(F.coalesce(F.col(vol), F.lit(default)), F.lit(floor))
    total = F.sum(F.when(_active(signal), inverse)).over(Window.partitionBy(group))
    return F.when(_active(signal), cash * inverse / total).otherwise(0.0)


def kelly(cash: Column, p: Column, b: Column, signal: str = "signal", fraction: float = 0.25) -> Column:
    p, b = F.coalesce(p, F.lit(0.55)), F.coalesce(b, F.lit(1.5))
    share = F.greatest(F.lit(0.0), (p * b - (1 - p)) / b)
    return F.when(_active(signal), cash * share * fraction * _strength(F.col(signal))).otherwise(0.0)


def target_vol(group: str, cash: Column, vol: str, signal: str = "signal", target: float = 0.15, max_leverage: float = 1.0) -> Column:
    n = F.sum(_active(signal).cast("int")).over(Window.partitionBy(group))
    scale = F.least(F.coalesce(F.try_divide(F.lit(target), F.col(vol)), F.lit(max_leverage)), F.lit(max_leverage))
    return F.when(_active(signal), cash / n * scale * _strength(F.col(signal))).otherwise(0.0)


def to_lots(amount: Column, price: Column, lot: int = 100) -> Column:
    return F.when(price > 0, F.floor(amount / price / lot) * lot).otherwise(0).cast("long")
