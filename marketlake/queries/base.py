"""Views of the given tables as bars, news, orders and so on, in Spark and as SQL for the checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.sources.bars import make_bars

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def round_as_sql(x: Column, digits: int) -> Column:
    """A double rounded as the SQL rounds it: the product with the power of ten, in doubles, goes to the nearest whole number. Spark's own rounding
    goes by the shortest decimal of the double, and so takes a double a little below a half up."""
    return F.round(x * 10.0**digits) / 10.0**digits


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    return df.select(*[round_as_sql(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def bars_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of event values, one symbol for each event type."""
    e = table(spark, sf_dir, "events")
    return make_bars(e, F.col("event_type"), F.col("ts"), F.col("value"), F.struct("ts", "event_id"), "HOUR")


def bars_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order prices, one symbol for each priority."""
    o = table(spark, sf_dir, "orders")
    return make_bars(o, F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_totalprice"), F.col("o_orderkey"), "DAY")


BE = """be AS (SELECT event_type AS symbol, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
 min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume, sum(value) AS amount FROM events GROUP BY 1, 2)"""
BO = """bo AS (SELECT o_orderpriority AS symbol, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS ts, arg_min(o_totalprice, o_orderkey) AS open,
 max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume, sum(o_totalprice) AS amount FROM orders GROUP BY 1, 2)"""
W = "PARTITION BY symbol ORDER BY ts"


def last_n(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def sma_sql(x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {last_n(n)} >= {n} THEN avg({x}) OVER {last_n(n)} END"
