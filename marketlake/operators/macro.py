"""Macro series: changes, rebasing, leading indicator and regimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.functions.factors import pct_change


def mom(x: str = "value", key: str = "series", order: str = "date") -> Column:
    return pct_change(x, 1, key, order) * 100


def yoy(x: str = "value", periods: int = 12, key: str = "series", order: str = "date") -> Column:
    return pct_change(x, periods, key, order) * 100


def rebase(df: DataFrame, base_date: str | None = None, base_value: float = 100.0) -> DataFrame:
    """Each series relative to its first value at or after the base date; a base of 0 gives null."""
    since = df if base_date is None else df.filter(F.col("date") >= F.lit(base_date))
    base = since.groupBy("series").agg(F.min_by("value", "date").alias("base"))
    return df.join(base, "series").select("series", "date", (F.try_divide("value", F.nullif("base", F.lit(0.0))) * base_value).alias("rebased"))


def align(df: DataFrame, names: list[str]) -> DataFrame:
    """One column for each series, on the dates that all of them have."""
    wide = df.filter(F.col("series").isin(names)).groupBy("date").agg(*[F.max(F.when(F.col("series") == n, F.col("value"))).alias(n) for n in names])
    return wide.na.drop(subset=names)


def _z(df: DataFrame) -> DataFrame:
    s = df.groupBy("series").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    return df.join(s, "series").withColumn("value", F.try_divide(F.col("value") - F.col("m"), F.col("s"))).drop("m", "s")


def leading_indicator(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted sum of standardised series; weights are equal unless given."""
    z = _z(df)
    if weights is None:
        return z.groupBy("date").agg(F.avg("value").alias("indicator"))
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return z.groupBy("date").agg(F.sum(F.col("value") * F.try_element_at(w, F.col("series"))).alias("indicator"))


def classify_regime(df: DataFrame, growth: str, inflation: str, activity: str) -> DataFrame:
    """Regime of each common date from growth and inflation, standardised over their whole series."""
    wide = align(_z(df), [growth, inflation, activity])
    g, i = F.col(growth), F.col(inflation)
    regime = F.when((g > 0) & (i < 0.5), "expansion").when((g > 0) & (i >= 0.5), "overheating").when((g <= 0) & (i >= 0.5), "stagflation").otherwise("recession")
    return wide.select("date", regime.alias("regime"))


def calendar_within(events: DataFrame, today: Column, days: int, country: str | None = None) -> DataFrame:
    """Events of the next ``days`` days."""
    out = events.filter((F.col("date") >= today) & (F.col("date") <= F.date_add(today, days)))
    return out.filter(F.col("country") == country) if country else out
