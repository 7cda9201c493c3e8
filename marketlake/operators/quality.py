"""Checks and repairs of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: A relation that a bar must satisfy; a null operand breaks it.
RELATIONS = {"high_low": "high >= low", "high_open": "high >= open", "high_close": "high >= close", "low_open": "low <= open", "low_close": "low <= close"}


def check_ohlc(bars: DataFrame) -> DataFrame:
    """Violations of each relation per symbol."""
    bad = [F.count_if(~F.coalesce(F.expr(e), F.lit(False))).alias(n) for n, e in RELATIONS.items()]
    return bars.groupBy("symbol").agg(*bad)


def check_completeness(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Days of the calendar (day) between a symbol's first and last bar on which it has none."""
    span = bars.groupBy("symbol").agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b"))
    want = span.join(F.broadcast(calendar), F.col("day").between(F.col("a"), F.col("b"))).select("symbol", "day")
    return want.join(bars.select("symbol", F.to_date("ts").alias("day")).distinct(), ["symbol", "day"], "left_anti")


def check_nulls(bars: DataFrame, cols: list[str], error: float = 0.2, warning: float = 0.05) -> DataFrame:
    """The largest share of nulls over the columns, per symbol, and its level."""
    worst = F.greatest(*[F.avg(F.col(c).isNull().cast("double")) for c in cols], F.lit(0.0))
    level = F.when(F.col("max_null_ratio") > error, "ERROR").when(F.col("max_null_ratio") > warning, "WARNING").otherwise("PASS")
    return bars.groupBy("symbol").agg(worst.alias("max_null_ratio")).withColumn("level", level)


def max_abs_z(cols: list[str], key: str = "symbol") -> Column:
    """The largest |z| of a row over the columns; columns without deviation count as 0."""
    w = Window.partitionBy(key)
    zs = []
    for c in cols:
        s = F.stddev_samp(c).over(w)
        zs.append(F.coalesce(F.when(s > 0, F.abs((F.col(c) - F.avg(c).over(w)) / s)), F.lit(0.0)))
    return F.greatest(*zs, F.lit(0.0))


def check_outliers(bars: DataFrame, cols: list[str], limit: float = 3.0, ratio: float = 0.01) -> DataFrame:
    rows = bars.withColumn("z", max_abs_z(cols))
    out = rows.groupBy("symbol").agg(F.count_if(F.col("z") > limit).alias("outliers"), F.count("*").alias("n"))
    return out.withColumn("level", F.when(F.col("outliers") > ratio * F.col("n"), "WARNING").otherwise("PASS"))


def anomalies_iqr(bars: DataFrame, cols: list[str], k: float = 1.5, approximate: bool = False) -> DataFrame:
    """Rows outside the quartiles by k times their distance in any column; quartiles interpolate linearly, or come from
    sketches where ``approximate``."""
    pick = (lambda c: F.percentile_approx(c, [0.25, 0.75])) if approximate else (lambda c: F.percentile(c, [0.25, 0.75]))
    q = bars.groupBy("symbol").agg(*[pick(c).alias(f"__q_{c}") for c in cols])
    out = bars.join(q, "symbol")
    odd = F.lit(False)
    for c in cols:
        lo, hi = F.col(f"__q_{c}")[0], F.col(f"__q_{c}")[1]
        odd = odd | F.coalesce((F.col(c) < lo - k * (hi - lo)) | (F.col(c) > hi + k * (hi - lo)), F.lit(False))
    return out.withColumn("anomaly", odd).drop(*[f"__q_{c}" for c in cols])


def quality_report(bars: DataFrame, cols: list[str]) -> DataFrame:
    """(symbol, rows, bad_ohlc, max_null_ratio, outliers, level); level is the worst of all checks."""
    bad = sum((F.count_if(~F.coalesce(F.expr(e), F.lit(False))) for e in RELATIONS.values()), F.lit(0))
    worst = F.greatest(*[F.avg(F.col(c).isNull().cast("double")) for c in cols], F.lit(0.0))
    rows = bars.withColumn("z", max_abs_z(cols))
    r = rows.groupBy("symbol").agg(F.count("*").alias("rows"), bad.alias("bad_ohlc"), worst.alias("max_null_ratio"), F.count_if(F.col("z") > 3).alias("outliers"))
    level = F.when((F.col("bad_ohlc") > 0) | (F.col("max_null_ratio") > 0.2), "ERROR").when((F.col("max_null_ratio") > 0.05) | (F.col("outliers") > 0.01 * F.col("rows")), "WARNING").otherwise("PASS")
    return r.withColumn("level", level)


def gate(bars: DataFrame, report: DataFrame) -> DataFrame:
    """Bars of the symbols whose report is not an ERROR."""
    return bars.join(report.filter("level = 'ERROR'").select("symbol"), "symbol", "left_anti")
