"""Joins between bars, features, constituents and dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_features_labels(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.join(y, ["symbol", "date"])


def constituent_diff(members: DataFrame, a: str, b: str) -> DataFrame:
    """(change, code) between two snapshots of an index (snapshot, code)."""
    old, new = (members.filter(F.col("snapshot") == s).select("code").distinct() for s in (a, b))
    added = new.join(old, "code", "left_anti").select(F.lit("added").alias("change"), "code")
    return added.unionByName(old.join(new, "code", "left_anti").select(F.lit("removed").alias("change"), "code"))


def align_calendar(bars: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """The bars of each time of a calendar (ts), or of the union of all symbols' times; a symbol without a bar has no row, a time without any has
    one with a null symbol."""
    times = bars.select("ts").distinct() if calendar is None else calendar.select("ts").distinct()
    return times.join(bars, "ts", "left")


def dense_calendar(bars: DataFrame, few: int = 100_000) -> DataFrame:
    """Every symbol on every time that any symbol has, missing bars being null: rows are times by symbols. Up to ``few`` symbols are broadcast."""
    times, symbols = bars.select("ts").distinct(), bars.select("symbol").distinct()
    return times.join(F.broadcast(symbols) if symbols.count() <= few else symbols, how="cross").join(bars, ["symbol", "ts"], "left")


def overlay(cached: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Live rows, and cached ones for keys without."""
    return live.unionByName(cached.join(live.select(*keys), keys, "left_anti"))


def industry_of(symbols: DataFrame, specific: DataFrame, general: DataFrame) -> DataFrame:
    """(symbol, industry): a symbol's own row, else that of its level. symbols: (symbol, level)."""
    out = symbols.join(specific.withColumnRenamed("industry", "own"), "symbol", "left").join(general.withColumnRenamed("industry", "wide"), "level", "left")
    return out.select("symbol", F.coalesce("own", "wide").alias("industry"))


def confirmed(factor_layer: DataFrame, timing_layer: DataFrame, keys: list[str]) -> DataFrame:
    return factor_layer.join(timing_layer.select(*keys).distinct(), keys, "left_semi")
