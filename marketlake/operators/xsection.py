"""Cross-sectional operators: standardising, ranking and comparing values of one date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from marketlake.functions.prefix import running_sums, slice_of, value_bounds


def cs_zscore(x: str, by: str = "date") -> Column:
    d = Window.partitionBy(by)
    return F.try_divide(F.col(x) - F.avg(x).over(d), F.stddev_samp(x).over(d))


def average_rank(x: str, *by: str) -> Column:
    """Ranks from 1 with ties at their mean; null for null."""
    d = Window.partitionBy(*by, F.col(x).isNull())
    rank = F.rank().over(d.orderBy(x)) + (F.count("*").over(Window.partitionBy(*by, x)) - 1) / 2
    return F.when(F.col(x).isNotNull(), rank)


def cs_rank_pct(x: str, by: str = "date") -> Column:
    return average_rank(x, by) / F.count(x).over(Window.partitionBy(by))


def winsorize(df: DataFrame, x: str, n_sigma: float = 3.0, by: str | None = None) -> DataFrame:
    """Values clipped to mean +- n_sigma * sample deviation, over all rows or per group."""
    stats = (df.groupBy(by) if by else df.groupBy()).agg(F.avg(x).alias("__m"), F.stddev_samp(x).alias("__s"))
    joined = df.join(stats, by) if by else df.join(F.broadcast(stats))  # one row
    clipped = F.least(F.greatest(F.col(x), F.col("__m") - n_sigma * F.col("__s")), F.col("__m") + n_sigma * F.col("__s"))
    return joined.withColumn(x, F.when(F.col(x).isNotNull(), F.coalesce(clipped, F.col(x)))).drop("__m", "__s")


def fill_mean(df: DataFrame, cols: list[str]) -> DataFrame:
    means = df.agg(*[F.avg(c).alias(f"__{c}") for c in cols])
    out = df.join(F.broadcast(means))  # one row
    return out.withColumns({c: F.coalesce(c, f"__{c}") for c in cols}).drop(*[f"__{c}" for c in cols])


def ts_zscore(x: str, key: str = "symbol") -> Column:
    """Over the whole span of a symbol; a deviation of 0 divides by 1."""
    w = Window.partitionBy(key)
    s = F.stddev_samp(x).over(w)
    return (F.col(x) - F.avg(x).over(w)) / F.when(s > 0, s).otherwise(1.0)


def ts_rank_pct(x: str, key: str = "symbol") -> Column:
    return average_rank(x, key) / F.count(x).over(Window.partitionBy(key))


def rank_ic(df: DataFrame, pred: str, actual: str) -> DataFrame:
    """Spearman correlation over all rows with both values. Ranks over a whole table need one total order: the ranks
    come from counts per distinct value, added up by slices of the values, so no row-level window runs in one task."""
    both = df.filter(F.col(pred).isNotNull() & F.col(actual).isNotNull())
    for c in (pred, actual):
        counts = both.groupBy(c).agg(F.count("*").alias("__n"))
        counts = counts.withColumn("__slice", slice_of(F.col(c).cast("double"), value_bounds(both, c)))
        upto = running_sums(counts, [], "__slice", [c], {"__upto": F.col("__n")})
        both = both.join(upto.select(c, (F.col("__upto") - (F.col("__n") - 1) / 2).alias(f"__rank_{c}")), c)
    return both.agg(F.corr(f"__rank_{pred}", f"__rank_{actual}").alias("rank_ic"))


def ic_series(df: DataFrame, pred: str, actual: str, by: str = "date") -> DataFrame:
    """Spearman correlation per date; 0 for two rows or fewer, or where a side does not vary."""
    both = df.filter(F.col(pred).isNotNull() & F.col(actual).isNotNull())
    r = both.select(by, average_rank(pred, by).alias("a"), average_rank(actual, by).alias("b"))
    n = F.count("*")
    cov = F.sum(F.col("a") * F.col("b")) - F.sum("a") * F.sum("b") / n
    va, vb = F.sum(F.col("a") * F.col("a")) - F.sum("a") ** 2 / n, F.sum(F.col("b") * F.col("b")) - F.sum("b") ** 2 / n
    ic = F.when((n > 2) & (va > 0) & (vb > 0), cov / F.sqrt(va * vb)).otherwise(0.0)
    return r.groupBy(by).agg(ic.alias("ic"))


def ic_summary(ics: DataFrame) -> DataFrame:
    """Mean and mean / deviation; the ratio is 0 for fewer than two dates or no deviation."""
    s = F.stddev_samp("ic")
    return ics.agg(F.avg("ic").alias("ic_mean"), F.coalesce(F.when(s > 0, F.avg("ic") / s), F.lit(0.0)).alias("ic_ir"))
