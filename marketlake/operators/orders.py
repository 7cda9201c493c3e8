"""Order life cycles and execution schedules as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Allowed changes of an order's status.
TRANSITIONS = {"PENDING_NEW": ["NEW", "REJECTED"], "NEW": ["PARTIAL", "FILLED", "PENDING_CANCEL", "EXPIRED", "SUSPENDED"], "PARTIAL": ["FILLED", "CANCELLED", "PENDING_CANCEL"], "PENDING_CANCEL": ["CANCELLED"], "SUSPENDED": ["NEW"]}


def validate_orders(orders: DataFrame) -> DataFrame:
    """Adds reason: why an order is not valid, null if it is."""
    reason = F.when(F.coalesce(F.col("quantity") <= 0, F.lit(True)), "quantity").when(F.coalesce(F.col("symbol") == "", F.lit(True)), "symbol")
    return orders.withColumn("reason", reason)


def invalid_transitions(events: DataFrame) -> DataFrame:
    """Events (order_id, seq, status) that the status before does not allow."""
    w = Window.partitionBy("order_id").orderBy("seq")
    allowed = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    rows = events.withColumn("before", F.lag("status").over(w)).filter("before is not null")
    return rows.filter(~F.coalesce(F.array_contains(F.try_element_at(allowed, F.col("before")), F.col("status")), F.lit(False)))


def current_status(events: DataFrame) -> DataFrame:
    return events.groupBy("order_id").agg(F.max_by("status", "seq").alias("status"))


#: Statuses of orders that can still be filled.
ACTIVE = ["PENDING_NEW", "NEW", "PARTIAL", "PENDING_CANCEL", "SUSPENDED"]


def status_counts(events: DataFrame) -> DataFrame:
    """(symbol, status, orders, active) of the orders by their symbol and last status; events (order_id, symbol, seq, status)."""
    last = events.groupBy("order_id").agg(F.max_by("status", "seq").alias("status"), F.max_by("symbol", "seq").alias("symbol"))
    return last.groupBy("symbol", "status").agg(F.count("*").alias("orders"), F.count_if(F.col("status").isin(ACTIVE)).alias("active"))


def twap_schedule(parents: DataFrame, seconds: int = 30) -> DataFrame:
    """(order_id, slice, ts, quantity) of parents (order_id, quantity, start, duration): the target int(total * elapsed / duration) less what
    earlier slices took. Without a duration one slice of max(1, total / 10)."""
    steps = F.ceil(F.col("duration") / seconds).cast("int")
    rows = parents.filter("duration > 0").withColumn("slice", F.explode(F.sequence(F.lit(1), steps)))
    elapsed = F.least(F.lit(1.0), F.col("slice") * seconds / F.col("duration"))
    target = F.floor(F.col("quantity") * elapsed)
    before = F.coalesce(F.lag("target").over(Window.partitionBy("order_id").orderBy("slice")), F.lit(0))
    out = rows.withColumn("target", target).select("order_id", "slice", F.timestamp_add("SECOND", F.col("slice") * seconds, F.col("start")).alias("ts"), F.greatest(F.col("target") - before, F.lit(0)).cast("long").alias("quantity"))
    single = parents.filter("duration is null or duration <= 0").select("order_id", F.lit(1).alias("slice"), F.col("start").alias("ts"), F.greatest(F.floor(F.col("quantity") / 10), F.lit(1)).cast("long").alias("quantity"))
    return out.unionByName(single)


def volume_profile(bars: DataFrame, bucket: Column) -> DataFrame:
    """(bucket, weight): each bucket's share of the volume."""
    v = bars.groupBy(bucket.alias("bucket")).agg(F.sum("volume").alias("v"))
    return v.join(F.broadcast(v.agg(F.sum("v").alias("t")))).select("bucket", (F.col("v") / F.col("t")).alias("weight"))  # one row


def _capped(rows: DataFrame, want: Column, order: str) -> DataFrame:
    """Slices in order until the parent's quantity is used up."""
    w = Window.partitionBy("order_id").orderBy(order)
    rows = rows.withColumn("want", want)
    before = F.sum("want").over(w) - F.col("want")
    return rows.withColumn("take", F.least(F.col("want"), F.greatest(F.col("quantity") - before, F.lit(0))).cast("long"))


def vwap_schedule(parents: DataFrame, profile: DataFrame) -> DataFrame:
    """(order_id, bucket, quantity): max(1, int(total * weight)) for each bucket while any is left."""
    rows = parents.join(F.broadcast(profile), how="cross")  # a row for each bucket of a day
    out = _capped(rows, F.greatest(F.floor(F.col("quantity") * F.col("weight")), F.lit(1)), "bucket")
    return out.select("order_id", "bucket", F.col("take").alias("quantity"))


def pov_schedule(parents: DataFrame, bars: DataFrame, rate: float = 0.1) -> DataFrame:
    """(order_id, ts, quantity): max(1, int(volume * rate)) of each of the symbol's bars from the start on while any is left.

    Bars have a running sum of what may be taken. Parents sorted in among them by time learn what was there before their start, and
    sorted in by that plus their quantity, at which bar it is used up; so a parent meets only the bars that it takes from, and no others.
    """
    by_time = Window.partitionBy("symbol").orderBy("ts", "bar", "order_id").rowsBetween(Window.unboundedPreceding, 0)
    takes = bars.filter("ts IS NOT NULL").select("symbol", "ts", F.greatest(F.floor(F.col("volume") * rate), F.lit(1)).cast("long").alias("want"), F.lit(True).alias("bar"))
    asks = parents.filter("quantity > 0 AND start IS NOT NULL").select("symbol", F.col("start").alias("ts"), F.lit(0).cast("long").alias("want"), F.lit(False).alias("bar"), "order_id", "quantity")
    both = takes.unionByName(asks, allowMissingColumns=True)  # of equal times a parent comes first: its own bar counts
    both = both.withColumn("upto", F.sum("want").over(by_time)).withColumn("number", F.count_if("bar").over(by_time))
    by_volume = Window.partitionBy("symbol").orderBy("at", "bar", "order_id").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("at", F.col("upto") + F.coalesce("quantity", F.lit(0)))
    both = both.withColumn("bars_before", F.count_if("bar").over(by_volume))
    found = both.filter("NOT bar").select("symbol", "order_id", F.col("upto").alias("base"), F.col("at").alias("end"), F.explode(F.sequence(F.col("number") + 1, F.col("bars_before") + 1)).alias("number"))
    numbered = both.filter("bar").select("symbol", "number", "ts", "want", "upto")
    taken = F.least("upto", "end") - F.greatest(F.col("upto") - F.col("want"), F.col("base"))
    return found.join(numbered, ["symbol", "number"]).select("order_id", "ts", taken.alias("quantity")).filter("quantity > 0")
