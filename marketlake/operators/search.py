"""Parameter grids, and their search by backtests on train and test parts, over one split or walk-forward windows."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from marketlake.operators import backtest as bt
from marketlake.operators import perf


def range_values(low: float | None = None, high: float | None = None, step: float | None = None, values: list | None = None) -> list[float]:
    """The given values, or low, low + step, ... up to high, or the middle."""
    if values:
        return [float(v) for v in values]
    if step:
        return [low + i * step for i in range(max(0, math.floor((high + step / 2 - low) / step - 1e-9) + 1))]
    return [(low + high) / 2]


def param_grid(spark: SparkSession, ranges: dict[str, list[float]]) -> DataFrame:
    """Every combination of the values, numbered in order of the values."""
    frames = [spark.createDataFrame([(float(v),) for v in vs], f"`{n}` double") for n, vs in ranges.items()]
    grid = reduce(lambda a, b: a.join(b, how="cross"), frames)  # parameters are few
    return grid.withColumn("trial", F.row_number().over(Window.orderBy(*ranges)) - 1)


def param_sample(spark: SparkSession, ranges: dict[str, list[float]], n: int, seed: int = 42) -> DataFrame:
    out = spark.range(n).withColumnRenamed("id", "trial")
    for i, (name, vs) in enumerate(ranges.items()):
        out = out.withColumn(name, F.element_at(F.array(*map(F.lit, vs)), F.floor(F.rand(seed + i) * len(vs)).cast("int") + 1))
    return out


def best_params(results: DataFrame, score: str = "train_score", by: list[str] | None = None) -> DataFrame:
    """The row with the greatest score, the first trial on ties (to nine digits); one for each group of ``by``."""
    cols = results.columns
    best = results.filter(F.col(score).isNotNull()).groupBy(*(by or [])).agg(F.max_by(F.struct(*cols), F.struct(F.round(score, 9), -F.col("trial"))).alias("b"))
    return best.select("b.*")


def walk_forward(days: DataFrame, train: int, test: int) -> DataFrame:
    """(window_id, train_start, train_end, test_start, test_end) over a table of days; windows move on by ``test`` days. A calendar is small."""
    n = days.withColumn("i", F.row_number().over(Window.orderBy("day")) - 1)
    starts = n.filter(F.col("i") % test == 0).select((F.col("i") / test).cast("int").alias("window_id"), F.col("i").alias("a"))
    pick = lambda df, offset, name: df.join(F.broadcast(n.select(F.col("day").alias(name), F.col("i").alias("__j"))), F.col("a") + offset == F.col("__j")).drop("__j")
    out = starts
    for offset, name in ((0, "train_start"), (train - 1, "train_end"), (train, "test_start"), (train + test - 1, "test_end")):
        out = pick(out, offset, name)
    return out.drop("a")


def split_parts(windows: DataFrame, ratio: float) -> DataFrame:
    """(window_id, part, begin, end) of windows (window_id, start, end[, test_start, test_end]): train ends ``ratio`` of the days after
    the start. The days after it are the test part, or the validation part where a window has a test part of its own."""
    cut = F.date_add("start", F.floor(F.date_diff("end", "start") * F.lit(ratio)).cast("int"))
    own = "test_start" in windows.columns
    parts = [("train", F.col("start"), cut), ("validation" if own else "test", F.date_add(cut, 1), F.col("end"))]
    if own:
        parts.append(("test", F.col("test_start"), F.col("test_end")))
    each = F.array(*[F.struct(F.lit(n).alias("part"), a.alias("begin"), b.alias("end")) for n, a, b in parts])
    return windows.select("window_id", F.explode(each).alias("p")).select("window_id", "p.*")


def score_parts(bars: DataFrame, parts: DataFrame, params: list[str], signal: str = "signal", metric: str = "sharpe") -> DataFrame:
    """(window_id, trial, params, a score for each part) of bars (trial, params, symbol, ts, close, signal).

    Every (window, part, trial, symbol) is a backtest with its own cash, all of them groups of one job. A score is the mean over
    the symbols of ``final_value`` (the last total value) or of a column of the performance report. Windows are few.
    """
    names = ["train", "validation", "test"]
    day = F.to_date("ts")
    rows = bars.join(F.broadcast(parts), (day >= F.col("begin")) & (day <= F.col("end"))).drop("begin", "end")
    keys = ["window_id", "part", "trial", "symbol"]
    nav = bt.backtest_single(rows, signal, keys)
    if metric == "final_value":
        each = nav.groupBy(*keys).agg(F.max_by("total_value", "ts").alias("score"))
    else:
        report = perf.performance_report(nav.select(F.struct(*keys).alias("strategy"), "ts", "total_value"))
        each = report.select("strategy.*", F.col(metric).alias("score"))
    scores = [F.avg(F.when(F.col("part") == n, F.col("score"))).alias(f"{n}_score") for n in names]
    values = bars.select("trial", *params).distinct()  # parameters are few
    return each.groupBy("window_id", "trial").agg(*scores).join(F.broadcast(values), "trial").select("window_id", "trial", *params, *[f"{n}_score" for n in names])


def grid_search(bars: DataFrame, params: list[str], signal: str = "signal", metric: str = "sharpe", ratio: float = 0.7) -> DataFrame:
    """(trial, params, train_score, test_score) of every trial; training ends int(days * ratio) days after the first day of the bars."""
    day = F.to_date("ts")
    whole = bars.agg(F.lit(0).alias("window_id"), F.min(day).alias("start"), F.max(day).alias("end"))
    return score_parts(bars, split_parts(whole, ratio), params, signal, metric).drop("window_id", "validation_score")


def walk_forward_search(bars: DataFrame, days: DataFrame, train: int, test: int, params: list[str], signal: str = "signal", metric: str = "sharpe", ratio: float = 0.8) -> DataFrame:
    """The best trial of each walk-forward window by its train score, with the dates of the window.

    A window's ``train`` days are split at ``ratio`` into a train and a validation part; its test score is of the days after them.
    """
    windows = walk_forward(days, train, test)
    spans = windows.select("window_id", F.col("train_start").alias("start"), F.col("train_end").alias("end"), "test_start", "test_end")
    best = best_params(score_parts(bars, split_parts(spans, ratio), params, signal, metric), by=["window_id"])
    return windows.join(best, "window_id")
