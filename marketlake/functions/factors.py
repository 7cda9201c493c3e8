"""Per-symbol time-series factors. All share one partitioning and order; missing values are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window, WindowSpec

from marketlake.functions.prefix import cut, running_sums, sliced_join
from marketlake.functions.scan import linear_scan


def by_symbol(key: str = "symbol", order: str = "ts") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def last_n(n: int, key: str = "symbol", order: str = "ts") -> WindowSpec:
    if n <= 0:
        raise ValueError("period must be positive")
    return by_symbol(key, order).rowsBetween(-(n - 1), 0)


def full(value: Column, x: Column, n: int, w: WindowSpec, least: int | None = None) -> Column:
    """``value`` where the frame holds enough non-null x."""
    return F.when(F.count(x).over(w) >= (n if least is None else least), value)


def sma(x: str = "close", n: int = 20, key: str = "symbol", order: str = "ts", least: int | None = None) -> Column:
    """Mean of the last n rows; null before row n, or before ``least`` values."""
    w = last_n(n, key, order)
    return full(F.avg(x).over(w), F.col(x), n, w, least)


def bollinger(x: str = "close", n: int = 20, k: float = 2.0, key: str = "symbol", order: str = "ts") -> tuple[Column, Column, Column]:
    """Upper, middle and lower band with the population deviation."""
    w = last_n(n, key, order)
    mid, dev = F.avg(x).over(w), F.stddev_pop(x).over(w)
    return tuple(full(c, F.col(x), n, w) for c in (mid + k * dev, mid, mid - k * dev))


def pct_change(x: str = "close", n: int = 1, key: str = "symbol", order: str = "ts") -> Column:
    return F.try_divide(F.col(x), F.lag(x, n).over(by_symbol(key, order))) - 1


def volatility(returns: str, n: int = 20, key: str = "symbol", order: str = "ts") -> Column:
    """Sample deviation of the last n returns."""
    w = last_n(n, key, order)
    return full(F.stddev_samp(returns).over(w), F.col(returns), n, w)


def turnover_ratio(n: int = 20) -> Column:
    return F.try_divide(F.col("volume"), sma("volume", n)) - 1


def ma_ratio(n: int = 20) -> Column:
    return F.try_divide(F.col("close"), sma("close", n))


def high_low_ratio() -> Column:
    return F.try_divide(F.col("high") - F.col("low"), F.col("close"))


def rolling_corr(x: str, y: str, n: int, key: str = "symbol", order: str = "ts") -> Column:
    """Pearson correlation of the last n rows from moments; null where a side does not vary."""
    w = last_n(n, key, order)
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)).cast("double"), F.when(both, F.col(y)).cast("double")
    m, sx, sy = F.count(a).over(w), F.sum(a).over(w), F.sum(b).over(w)
    cov = F.sum(a * b).over(w) - sx * sy / m
    vx, vy = F.sum(a * a).over(w) - sx * sx / m, F.sum(b * b).over(w) - sy * sy / m
    return F.when((m >= n) & (vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))


def trend_deviation(x: str, n: int = 12, key: str = "symbol", order: str = "ts") -> Column:
    mean = sma(x, n, key, order)
    return F.try_divide(F.col(x) - mean, mean) * 100


def drawdown(x: str, key: str = "symbol", order: str = "ts") -> Column:
    return F.try_divide(F.col(x), F.max(x).over(by_symbol(key, order).rowsBetween(Window.unboundedPreceding, 0))) - 1


def forward_return(k: int = 5, x: str = "close", key: str = "symbol", order: str = "ts") -> Column:
    return F.try_divide(F.lead(x, k).over(by_symbol(key, order)), F.col(x)) - 1


def forward_binary(k: int = 5, x: str = "close", null_as_zero: bool = False) -> Column:
    r = forward_return(k, x)
    up = F.when(r > 0, 1.0).when(r <= 0, 0.0)
    return F.coalesce(up, F.lit(0.0)) if null_as_zero else up


def prev_close(x: str = "close") -> Column:
    return F.lag(x).over(by_symbol())


def ffill(x: str, limit: int | None = None, key: str = "symbol", order: str = "ts") -> Column:
    back = Window.unboundedPreceding if limit is None else -limit
    return F.last(x, ignorenulls=True).over(by_symbol(key, order).rowsBetween(back, 0))


def bfill(x: str, limit: int | None = None, key: str = "symbol", order: str = "ts") -> Column:
    ahead = Window.unboundedFollowing if limit is None else limit
    return F.first(x, ignorenulls=True).over(by_symbol(key, order).rowsBetween(0, ahead))


def interpolate(df: DataFrame, x: str, out: str, key: str = "symbol", order: str = "ts") -> DataFrame:
    """Linear by row number between the non-null neighbours; trailing nulls take the last value, leading ones stay."""
    w = by_symbol(key, order)
    df = df.withColumn("__i", F.row_number().over(w)).withColumn("__k", F.when(F.col(x).isNotNull(), F.col("__i")))
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    p, q = F.last(x, True).over(back), F.first(x, True).over(ahead)
    i, j = F.last("__k", True).over(back), F.first("__k", True).over(ahead)
    mid = p + (q - p) * F.try_divide(F.col("__i") - i, (j - i).cast("double"))
    return df.withColumn(out, F.when(F.col(x).isNotNull(), F.col(x)).when(q.isNull(), p).otherwise(mid)).drop("__i", "__k")


def history(x: str, n: int) -> Column:
    """The last n values as an array."""
    return F.collect_list(x).over(last_n(n))


def ema(
    df: DataFrame, x: str, n: int, out: str, seed: str = "first", key: str = "symbol", order: str = "ts", alpha: float | None = None, slices: str | None = None
) -> DataFrame:
    """Exponential mean with weight 2/(n+1), or ``alpha``; it starts from the first non-null value, or for seed "sma" from
    the mean of the first n, and is null before. Rows without a value have no mean and do not move it. With ``slices``, a column that follows
    the order, a symbol is computed slice by slice in as many tasks; rows are checkpointed between the steps."""
    if n <= 0:
        raise ValueError("period must be positive")
    a = 2 / (n + 1) if alpha is None else alpha
    if slices is None:
        w = by_symbol(key, order).rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumn("__n", F.count(x).over(w)).withColumn("__m", F.avg(x).over(w))
    else:
        df = running_sums(cut(df), [key], slices, [order], {"__n": F.col(x).isNotNull().cast("long"), "__m": F.col(x).cast("double")})
        df = df.withColumn("__m", F.try_divide("__m", "__n"))
    start = 1 if seed == "first" else n
    u = F.when(F.col("__n") < start, 0.0).when(F.col("__n") == start, F.col("__m")).otherwise(F.col(x) * a)
    done = linear_scan(df.withColumn("__u", F.when(F.col(x).isNotNull(), u)), key, order, "__u", 1 - a, "__y", slices)
    return done.withColumn(out, F.when(F.col(x).isNotNull() & (F.col("__n") >= start), F.col("__y"))).drop("__n", "__m", "__u", "__y")


def _change(df: DataFrame, x: str, out: str, key: str, order: str, slices: str | None) -> DataFrame:
    """The change from the row before; over slices the last value of the slice before is carried over."""
    if slices is None:
        return df.withColumn(out, F.col(x) - F.lag(x).over(by_symbol(key, order)))
    df = cut(df)
    ends = df.groupBy(key, slices).agg(F.max_by(F.struct(x), order).alias("__end"))
    ends = ends.select(key, slices, F.lag("__end").over(Window.partitionBy(key).orderBy(slices))[x].alias("__end"))
    w = Window.partitionBy(key, slices).orderBy(order)
    rows = sliced_join(df.withColumn("__first", F.row_number().over(w) == 1).withColumn("__lag", F.lag(x).over(w)), ends, [key, slices])
    return rows.withColumn(out, F.col(x) - F.when(F.col("__first"), F.col("__end")).otherwise(F.col("__lag"))).drop("__first", "__lag", "__end")


def rsi(df: DataFrame, n: int = 14, x: str = "close", out: str = "rsi", key: str = "symbol", order: str = "ts", slices: str | None = None) -> DataFrame:
    """Wilder's index: simple means of the first n changes, then (mean * (n-1) + change) / n; no loss gives 100."""
    df = _change(df, x, "__d", key, order, slices).withColumn("__g", F.greatest("__d", F.lit(0.0))).withColumn("__l", F.greatest(-F.col("__d"), F.lit(0.0)))
    df = df.withColumn("__g", F.when(F.col("__d").isNotNull(), F.col("__g"))).withColumn("__l", F.when(F.col("__d").isNotNull(), F.col("__l")))
    df = ema(df, "__g", n, "__ag", "sma", key, order, 1 / n, slices)
    df = ema(df, "__l", n, "__al", "sma", key, order, 1 / n, slices)
    value = F.when(F.col("__al") == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide("__ag", "__al")))
    return df.withColumn(out, F.when(F.col("__al").isNotNull(), value)).drop("__d", "__g", "__l", "__ag", "__al")


def rsi_two_point(n: int = 14, x: str = "close", key: str = "symbol", order: str = "ts") -> Column:
    """The two-point form: means of the last two changes only, (new + (n-1) * before) / n."""
    w = by_symbol(key, order)
    now, before = F.col(x) - F.lag(x).over(w), F.lag(x, 1).over(w) - F.lag(x, 2).over(w)
    zero = F.lit(0.0)
    g = (F.greatest(now, zero) + (n - 1) * F.greatest(before, zero)) / n
    loss = (F.greatest(-now, zero) + (n - 1) * F.greatest(-before, zero)) / n
    return F.when(before.isNotNull() & now.isNotNull(), F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(g, loss))))


def macd(df: DataFrame, x: str = "close", fast: int = 12, slow: int = 26, signal: int = 9, slices: str | None = None) -> DataFrame:
    """Adds macd, macd_signal and macd_hist; all means start from simple ones."""
    df = ema(ema(df, x, fast, "__f", "sma", slices=slices), x, slow, "__s", "sma", slices=slices)
    df = ema(df.withColumn("macd", F.col("__f") - F.col("__s")), "macd", signal, "macd_signal", "sma", slices=slices)
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("__f", "__s")


def factor_pack(bars: DataFrame) -> DataFrame:
    """SMA 5/10/20/60, EMA 10/30 and RSI 14 in long form (symbol, ts, factor, value)."""
    df = bars.select("symbol", "ts", "close")
    for n in (10, 30):
        df = ema(df, "close", n, f"ema_{n}", "sma")
    df = rsi(df, 14, out="rsi_14")
    smas = {f"sma_{n}": sma("close", n) for n in (5, 10, 20, 60)}
    df = df.withColumns(smas)
    return df.unpivot(["symbol", "ts"], [*smas, "ema_10", "ema_30", "rsi_14"], "factor", "value")
