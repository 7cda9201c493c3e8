"""Linear recurrences y[t] = c * y[t-1] + u[t] as windows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from marketlake.functions.prefix import cut, sliced_join

#: Blocks are so long that a carry shrinks to 1e-8 over one, so what comes from beyond two blocks is below a double's precision.
_SHRINK = 1e-8


def linear_scan(df: DataFrame, key: str, order: str, u: str, c: float, out: str, slices: str | None = None) -> DataFrame:
    """Adds ``out``, the recurrence over the non-null u in order within each key; a row without u has the value before it, or null.

    Rows are cut into blocks. Inside a block z[j] = c^j * sum of u[i] * c^-i, a running sum; the last z of the block before it
    and, shrunk by c^K, that of the one before are carried on by windows. All windows are partitioned by the key (or the key and
    the block), so scans one after the other share one shuffle and need no join. A key is then sorted in one task; nothing is folded
    row by row. With ``slices``, a column that follows the order, each slice of a key is scanned for itself: it maps what comes in
    to c^m times that plus its own end, and these maps, a row a slice, are combined by the same scan at their rows' numbers.
    """
    if not 0 <= c < 1:
        raise ValueError("c must be in [0, 1)")
    if c == 0:
        return df.withColumn(out, F.col(u))
    if slices is not None:
        return _sliced(df, key, order, u, c, out, slices)
    return _scan(df, [key], order, u, c, out, F.count(u).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - 1)


def _scan(df: DataFrame, keys: list[str], order: str, u: str, c: float, out: str, position) -> DataFrame:
    k = max(1, int(math.log(_SHRINK) / math.log(c)))
    rows = df.withColumn("__scan_i", position)
    rows = rows.withColumn("__scan_b", F.floor(F.col("__scan_i") / k)).withColumn("__scan_j", F.pmod("__scan_i", F.lit(k)))
    run = Window.partitionBy(*keys, "__scan_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    z = F.sum(F.coalesce(F.col(u), F.lit(0.0)) * F.pow(F.lit(c), -F.col("__scan_j"))).over(run) * F.pow(F.lit(c), F.col("__scan_j"))
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ends = lambda x: F.last(F.when((F.col("__scan_j") == k - 1) & F.col(u).isNotNull(), F.col(x)), True).over(before)
    rows = rows.withColumn("__scan_z", z).withColumn("__scan_e", ends("__scan_z"))
    rows = rows.withColumn("__scan_f", ends("__scan_e"))
    carry = F.coalesce("__scan_e", F.lit(0.0)) + F.coalesce("__scan_f", F.lit(0.0)) * c**k
    value = F.when(F.col("__scan_i") >= 0, F.col("__scan_z") + F.pow(F.lit(c), F.col("__scan_j") + 1) * carry)
    return rows.withColumn(out, value).drop("__scan_i", "__scan_b", "__scan_j", "__scan_z", "__scan_e", "__scan_f")


def _sliced(df: DataFrame, key: str, order: str, u: str, c: float, out: str, slices: str) -> DataFrame:
    inside = Window.partitionBy(key, slices).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = _scan(df.withColumn("__at", F.count(u).over(inside)), [key, slices], order, u, c, "__local", F.col("__at") - 1)
    rows = cut(rows)  # read for the maps and again for the result
    # a row a slice: how many steps it has and where it ends on its own
    maps = rows.groupBy(key, slices).agg(F.max("__at").alias("m"), F.max_by("__local", order).alias("e"))
    so_far = Window.partitionBy(key).orderBy(slices).rowsBetween(Window.unboundedPreceding, 0)
    k = max(1, int(math.log(_SHRINK) / math.log(c)))
    maps = maps.withColumn("e", F.when(F.col("m") > 0, F.col("e"))).withColumn("p", F.sum("m").over(so_far))
    maps = maps.withColumn("b", F.floor(F.col("p") / k)).withColumn("j", F.pmod("p", F.lit(k)))
    run = Window.partitionBy(key, "b").orderBy(slices)
    w = F.sum(F.coalesce(F.col("e"), F.lit(0.0)) * F.pow(F.lit(c), -F.col("j"))).over(run.rowsBetween(Window.unboundedPreceding, 0))
    maps = maps.withColumn("w", w).withColumn("last", F.row_number().over(Window.partitionBy(key, "b").orderBy(F.desc(slices))) == 1)
    end = F.when(F.col("last"), F.col("w") * c**k)
    near = lambda n: F.coalesce(F.sum(end).over(Window.partitionBy(key).orderBy("b").rangeBetween(-n, -n)), F.lit(0.0))
    maps = maps.withColumn("y", F.pow(F.lit(c), F.col("j")) * (F.col("w") + near(1) + near(2) * c**k))
    started = F.sum("m").over(so_far.rowsBetween(Window.unboundedPreceding, -1))
    maps = maps.select(key, slices, F.when(started > 0, F.lag("y").over(Window.partitionBy(key).orderBy(slices))).alias("__carry"))
    rows = sliced_join(rows, maps, [key, slices])
    carried = F.coalesce(F.col("__carry") * F.pow(F.lit(c), F.col("__at")), F.lit(0.0))
    value = F.when(F.col("__local").isNotNull() | F.col("__carry").isNotNull(), F.coalesce("__local", F.lit(0.0)) + carried)
    return rows.withColumn(out, value).drop("__at", "__local", "__carry")
