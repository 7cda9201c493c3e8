"""Trading days, market phases and times of day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Phases of a trading day by the time they start at, China Standard Time.
PHASES = [("00:00", "PreOpen"), ("09:15", "CallAuction"), ("09:25", "PreContinuous"), ("09:30", "Morning"), ("11:30", "Noon"), ("13:00", "Afternoon"), ("14:57", "ClosingAuction"), ("15:00", "AfterHours")]


def trading_days(bars: DataFrame) -> DataFrame:
    return bars.select(F.to_date("ts").alias("day")).distinct()


def neighbours(days: DataFrame) -> DataFrame:
    """(day, prev_day, next_day, number); a calendar is small: one row a day."""
    w = Window.orderBy("day")
    return days.select("day", F.lag("day").over(w).alias("prev_day"), F.lead("day").over(w).alias("next_day"), F.row_number().over(w).alias("number"))


def day_count(days: DataFrame, spans: DataFrame) -> DataFrame:
    """Trading days of each span (a, b), both ends included."""
    return spans.join(F.broadcast(days), F.col("day").between(F.col("a"), F.col("b")), "left").groupBy("a", "b").agg(F.count("day").alias("days"))


def minutes(clock: str) -> int:
    return int(clock[:2]) * 60 + int(clock[3:])


def market_phase(ts: Column, trading_day: Column) -> Column:
    """The phase at a local time; Closed on other days."""
    m = F.hour(ts) * 60 + F.minute(ts)
    out = F.lit(PHASES[0][1])
    for start, name in PHASES[1:]:
        out = F.when(m >= minutes(start), name).otherwise(out)
    return F.when(trading_day, out).otherwise("Closed")


def within_trading_hours(ts: Column, start: str = "09:30", end: str = "15:00") -> Column:
    return (F.hour(ts) * 60 + F.minute(ts)).between(minutes(start), minutes(end))
