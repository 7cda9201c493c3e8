"""Corporate actions: derivation, as-of prices and price adjustment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

PRICES = ("open", "high", "low", "close")


def asof_price(actions: DataFrame, bars: DataFrame, days: int = 9) -> DataFrame:
    """``actions`` (symbol, action_date, ...) with the close of the day, or of the nearest earlier one within ``days``: one
    union and one ordered window, no range join."""
    cols = [c for c in actions.columns if c not in ("symbol", "action_date")]
    a = actions.select("symbol", F.col("action_date").alias("d"), F.struct(*cols, F.lit(1).alias("__a")).alias("row"), F.lit(None).cast("double").alias("close"))
    b = bars.select("symbol", F.to_date("ts").alias("d"), "close").withColumn("row", F.lit(None).cast(a.schema["row"].dataType))
    w = Window.partitionBy("symbol").orderBy(F.unix_date("d")).rangeBetween(-days, 0)
    both = a.unionByName(b).withColumn("asof_close", F.last("close", ignorenulls=True).over(w))
    return both.filter("row is not null").select("symbol", F.col("d").alias("action_date"), *[F.col(f"row.{c}").alias(c) for c in cols], "asof_close")


def derive_actions(plans: DataFrame, bars: DataFrame) -> DataFrame:
    """(symbol, action_date, type, value, adjust_factor) from executed plans (symbol, action_date, dividend10, bonus10).

    A dividend per ten shares gives close / (close - dividend), within [1, 1.5], 1 without a price; a bonus of r shares a
    share gives 1 + r, the factor by which earlier prices are divided.
    """
    p = asof_price(plans, bars)
    div, bonus = F.col("dividend10") / 10, F.col("bonus10") / 10
    factor = F.least(F.greatest(F.coalesce(F.try_divide(F.col("asof_close"), F.col("asof_close") - div), F.lit(1.0)), F.lit(1.0)), F.lit(1.5))
    factor = F.when(F.coalesce(F.col("asof_close"), F.lit(0.0)) <= 0, 1.0).otherwise(factor)
    rows = F.array(
        F.when(div > 0, F.struct(F.lit("dividend").alias("type"), div.alias("value"), factor.alias("adjust_factor"))),
        F.when(bonus > 0, F.struct(F.lit("split").alias("type"), bonus.alias("value"), (1 + bonus).alias("adjust_factor"))),
    )
    return p.select("symbol", "action_date", F.explode(F.array_compact(rows)).alias("x")).select("symbol", "action_date", "x.*")


def given_actions(rows: DataFrame) -> DataFrame:
    """Suspensions and rights issues (symbol, action_date, type, value, adjust_factor) carried through with the factor as given, 1 where there is none."""
    return rows.filter(F.col("type").isin("suspension", "rights")).select("symbol", "action_date", "type", "value", F.coalesce("adjust_factor", F.lit(1.0)).alias("adjust_factor"))


def actions_in_range(actions: DataFrame, symbol: str | None, start: str, end: str) -> DataFrame:
    df = actions.filter(F.col("action_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return df.filter(F.col("symbol") == symbol) if symbol else df


def adjust_prices(bars: DataFrame, actions: DataFrame, method: str = "backward") -> DataFrame:
    """Prices divided by the product of all factors dated after the bar's day (backward), or multiplied by the product of those up
    to it (forward). Actions enter each symbol's series, and the product is a window; no theta join."""
    if method == "none":
        return bars
    if method not in ("backward", "forward"):
        raise ValueError(f"unknown method {method}")
    acts = actions.groupBy("symbol", F.col("action_date").alias("d")).agg(F.product("adjust_factor").alias("f"))
    rows = bars.withColumn("d", F.to_date("ts")).withColumn("f", F.lit(None).cast("double")).withColumn("bar", F.lit(True))
    both = rows.unionByName(acts.withColumn("bar", F.lit(False)), allowMissingColumns=True)
    # a bar comes before an action of its own day, which therefore counts as later only if its date is
    day = Window.partitionBy("symbol").orderBy(F.unix_date("d"))
    w = day.rangeBetween(1, Window.unboundedFollowing) if method == "backward" else day.rangeBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("k", F.coalesce(F.product("f").over(w), F.lit(1.0))).filter("bar")
    change = (lambda c: F.col(c) / F.col("k")) if method == "backward" else (lambda c: F.col(c) * F.col("k"))
    return both.select(*[change(c).alias(c) if c in PRICES else F.col(c) for c in bars.columns])
