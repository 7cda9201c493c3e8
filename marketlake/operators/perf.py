"""Performance of net-asset-value series, many strategies at once, and other grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from marketlake.functions.prefix import running_sums, slice_of, value_bounds


def performance_report(nav: DataFrame, benchmark: DataFrame | None = None, rf: float = 0.03, periods: int = 252) -> DataFrame:
    """One row per strategy from (strategy, ts, total_value[, positions_value, positions_count]).

    One window pass for returns, drawdowns and changes, then one aggregation. Strategies with fewer than two returns are
    left out. Deviations below 1e-10 give a Sharpe ratio of 0; without losses the loss terms count as 1.
    """
    w = Window.partitionBy("strategy").orderBy("ts")
    peak = F.max("total_value").over(w.rowsBetween(Window.unboundedPreceding, 0))
    has = set(nav.columns)
    rows = nav.select(
        "strategy", "ts", "total_value", (F.try_divide("total_value", F.lag("total_value").over(w)) - 1).alias("r"), (F.try_divide(F.col("total_value"), peak) - 1).alias("dd"),
        F.abs(F.col("positions_value") - F.lag("positions_value").over(w)).alias("dv") if "positions_value" in has else F.lit(0.0).alias("dv"),
        F.abs(F.col("positions_count") - F.lag("positions_count").over(w)).alias("dc") if "positions_count" in has else F.lit(0).alias("dc"),
    )
    n, last, first = F.count("r"), F.max_by("total_value", "ts"), F.min_by("total_value", "ts")
    agg = rows.groupBy("strategy").agg(
        n.alias("n"), (last / first - 1).alias("total_return"), F.stddev_samp("r").alias("sd"), F.avg("r").alias("mean"), F.min("dd").alias("max_drawdown"),
        F.stddev_samp(F.when(F.col("r") < 0, F.col("r"))).alias("down"), F.avg((F.col("r") > 0).cast("double")).alias("win_rate"),
        F.avg(F.when(F.col("r") > 0, F.col("r"))).alias("gain"), F.abs(F.avg(F.when(F.col("r") < 0, F.col("r")))).alias("loss"),
        F.try_divide(F.sum("dv"), F.avg("total_value")).alias("turnover"), F.coalesce(F.sum("dc"), F.lit(0)).cast("long").alias("total_trades"),
    ).filter("n >= 2")
    annual = F.pow(1 + F.col("total_return"), F.lit(float(periods)) / F.col("n")) - 1
    root = float(periods) ** 0.5
    out = agg.select(
        "strategy", "n", "total_return", annual.alias("annual_return"), (F.col("sd") * root).alias("annual_volatility"), "max_drawdown",
        F.when(F.col("sd") < 1e-10, 0.0).otherwise((F.col("mean") - rf / periods) / F.col("sd") * root).alias("sharpe"),
        ((annual - rf) / F.coalesce(F.nullif(F.col("down") * root, F.lit(0.0)), F.lit(1.0))).alias("sortino"),
        F.when(F.col("max_drawdown") == 0, 0.0).otherwise(annual / F.abs("max_drawdown")).alias("calmar"), "win_rate",
        (F.coalesce("gain", F.lit(0.0)) / F.coalesce("loss", F.lit(1.0))).alias("profit_loss_ratio"), "turnover", "total_trades",
        (F.col("win_rate") * F.col("n") / periods).alias("avg_holding_days"),
    )
    if benchmark is None:
        return out
    b = benchmark.agg((F.max_by("close", "ts") / F.min_by("close", "ts") - 1).alias("benchmark_return"))
    return out.join(F.broadcast(b)).withColumn("excess_return", F.col("total_return") - F.col("benchmark_return"))  # one row


def drawdown_duration(nav: DataFrame) -> DataFrame:
    """Longest run of rows below the running maximum, per strategy."""
    w = Window.partitionBy("strategy").orderBy("ts")
    peak = F.max("total_value").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = nav.withColumn("down", F.col("total_value") < peak).withColumn("i", F.row_number().over(w))
    runs = rows.filter("down").withColumn("run", F.col("i") - F.row_number().over(w)).groupBy("strategy", "run").agg(F.count("*").alias("n"))
    longest = runs.groupBy("strategy").agg(F.max("n").alias("n"))
    return nav.select("strategy").distinct().join(longest, "strategy", "left").select("strategy", F.coalesce("n", F.lit(0)).cast("long").alias("drawdown_duration"))


def monthly_returns(nav: DataFrame) -> DataFrame:
    w = Window.partitionBy("strategy").orderBy("ts")
    r = nav.withColumn("r", F.try_divide("total_value", F.lag("total_value").over(w)) - 1).filter("r is not null")
    return r.groupBy("strategy", F.date_format("ts", "yyyy-MM").alias("month")).agg((F.product(1 + F.col("r")) - 1).alias("monthly_return"))


def regression_metrics(df: DataFrame, pred: str, actual: str) -> DataFrame:
    e = F.col(pred) - F.col(actual)
    mse = F.avg(e * e)
    total = F.sum(F.col(actual) * F.col(actual)) - F.sum(actual) ** 2 / F.count(actual)
    return df.agg(mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.when(total == 0, 0.0).otherwise(1 - F.sum(e * e) / total).alias("r2"))


def portfolio_value(positions: DataFrame, accounts: DataFrame) -> DataFrame:
    """(account, total_value, unrealized, pnl_pct) from positions (account, quantity, avg_cost, price) and accounts (account, cash)."""
    mv, cost = F.col("quantity") * F.col("price"), F.col("quantity") * F.col("avg_cost")
    p = positions.groupBy("account").agg(F.sum(mv).alias("mv"), F.sum(mv - cost).alias("unrealized"), F.sum(cost).alias("cost"))
    out = accounts.join(p, "account", "left")
    zero = F.lit(0.0)
    return out.select("account", (F.col("cash") + F.coalesce("mv", zero)).alias("total_value"), F.coalesce("unrealized", zero).alias("unrealized"), F.coalesce(F.try_divide("unrealized", "cost"), zero).alias("pnl_pct"))


def order_fill_summary(orders: DataFrame, fills: DataFrame) -> DataFrame:
    """Filled quantity, amount and average price per order (order_id, quantity); FILLED or PARTIAL."""
    s = fills.groupBy("order_id").agg(F.sum("quantity").alias("filled"), F.sum(F.col("quantity") * F.col("price")).alias("amount"))
    status = F.when(F.col("filled") >= F.col("quantity"), "FILLED").otherwise("PARTIAL")
    return orders.join(s, "order_id").select("order_id", "filled", "amount", F.try_divide("amount", "filled").alias("avg_price"), status.alias("status"))


def histogram(df: DataFrame, x: str, bounds: list[float]) -> DataFrame:
    """(bucket, upper, count) of buckets (lower, upper]; the last has no upper bound."""
    bucket = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        bucket = F.when(F.col(x) <= bounds[i], i).otherwise(bucket)
    upper = F.try_element_at(F.array(*map(F.lit, bounds)), F.col("bucket") + 1)
    return df.filter(F.col(x).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("count")).select("bucket", upper.alias("upper"), "count")


def histogram_percentile(hist: DataFrame, q: float, lowest: float = 0.0) -> DataFrame:
    """The q-quantile interpolated inside its bucket; the open bucket gives its lower bound. The histogram is a few rows."""
    w = Window.orderBy("bucket")
    h = hist.withColumn("done", F.sum("count").over(w)).withColumn("lower", F.coalesce(F.lag("upper").over(w), F.lit(lowest)))
    total = F.broadcast(hist.agg(F.sum("count").alias("total")))
    h = h.join(total).withColumn("want", F.col("total") * q).filter("done >= want")
    inside = F.col("lower") + (F.col("upper") - F.col("lower")) * (F.col("want") - (F.col("done") - F.col("count"))) / F.col("count")
    return h.agg(F.min_by(F.coalesce(inside, F.col("lower")), "bucket").alias("value"))


def classification_metrics(df: DataFrame, score: str, label: str, cutoff: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall, and the area under the curve from rank sums of distinct scores, added up by slices of the scores."""
    p, y = F.col(score) >= cutoff, F.col(label) == 1
    base = df.agg(F.avg((p == y).cast("double")).alias("accuracy"), F.try_divide(F.count_if(p & y), F.count_if(p)).alias("precision"), F.try_divide(F.count_if(p & y), F.count_if(y)).alias("recall"))
    d = df.groupBy(score).agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))
    d = d.withColumn("slice", slice_of(F.col(score).cast("double"), value_bounds(d, score)))
    below = running_sums(d, [], "slice", [score], {"upto": F.col("neg")}).withColumn("below", F.col("upto") - F.col("neg"))
    auc = below.agg(F.try_divide(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"))
    return base.join(F.broadcast(auc))  # one row each


def latency_stats(df: DataFrame, kind: str, latency: Column) -> DataFrame:
    return df.groupBy(kind).agg(F.count("*").alias("events"), F.avg(latency).alias("mean_latency"))
