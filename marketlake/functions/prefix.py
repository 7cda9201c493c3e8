"""Running sums in a total order that no task has to sort alone: inside slices, and over the slices' totals."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the cluster's shared folder (``spark.checkpoint.dir``), so that what reads it twice does not compute it twice."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if where is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="marketlake-"))
    return df.checkpoint()


def value_bounds(df: DataFrame, x: str, n: int = 128) -> list[float]:
    """Bounds of about n slices of equal rows, from approximate quantiles; how good they are decides how even slices are, not what they give."""
    wanted = [i / n for i in range(1, n)]
    return sorted(set(df.approxQuantile(x, wanted, 1 / (4 * n)))) if n > 1 else []


def slice_of(x: Column, bounds: list[float]) -> Column:
    """The number of bounds up to a value, so slices follow each other as values do."""
    return F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b <= x)) if bounds else F.lit(0)


def sliced_join(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what a table of slices has for theirs; null keys meet null keys."""
    renamed = small.select(*[F.col(k).alias(f"__of_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys])
    return df.join(renamed, same, "left").drop(*[f"__of_{k}" for k in keys])


def running_sums(df: DataFrame, keys: list[str], slices: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with a running sum of each column in the order, this row included, over all rows of the same keys.

    ``slices`` is a column that follows the order: rows are sorted by keys and slice, the slices' totals, a row each, by keys. A key, or with no
    keys the whole table, then spreads over as many tasks as it has slices. Null counts as 0.
    """
    local = Window.partitionBy(*keys, slices).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(slices).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, slices).agg(*[F.sum(c).alias(f"__sum_{n}") for n, c in sums.items()])
    starts = totals.select(*keys, slices, *[F.coalesce(F.sum(f"__sum_{n}").over(before), F.lit(0)).alias(f"__from_{n}") for n in sums])
    rows = sliced_join(df.withColumns({n: F.coalesce(F.sum(c).over(local), F.lit(0)) for n, c in sums.items()}), starts, [*keys, slices])
    return rows.withColumns({n: F.col(n) + F.col(f"__from_{n}") for n in sums}).drop(*[f"__from_{n}" for n in sums])
