"""Live bars, factors, signals and orders with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from marketlake.functions import news as nw
from marketlake.operators import backtest as bt
from marketlake.operators.orders import TRANSITIONS
from marketlake.sources.merge_table import MergeTable
from marketlake.streaming.moving import window_means
from marketlake.streaming.ordered import in_order
from marketlake.streaming.spec_factors import live_spec_factors

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def windowed_bars(ticks: DataFrame, interval: str, delay: str = "10 minutes") -> DataFrame:
    """Closed bars of a stream of ticks (symbol, ts, price, seq); ticks later than the delay are dropped."""
    t = ticks.withWatermark("ts", delay).groupBy("symbol", F.window("ts", interval))
    order = F.struct("ts", "seq")
    b = t.agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").alias("volume"))
    return b.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def drop_repeated(bars: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first of equal (symbol, ts) within the watermark; a last-write-wins table is ``upsert_sink``."""
    return bars.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["symbol", "ts"])


def subscribe(events: DataFrame, symbols: list[str] | None = None, types: list[str] | None = None) -> DataFrame:
    """Events of the symbols and types asked for; rows without a symbol pass."""
    if symbols:
        events = events.filter(F.col("symbol").isin(symbols) | F.col("symbol").isNull())
    return events.filter(F.col("type").isin(types)) if types else events


def upsert_sink(path: str, keys: list[str], sequence: str | None = None, part: Column | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: last write per key wins, within a batch the one with the greatest ``sequence``.

    A batch is a layer of the parts that it touches in a ``MergeTable``, in the log by one entry, so a reader never sees half of it; a
    batch that is replayed is there already and adds nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        table = MergeTable(batch.sparkSession, path, keys, part, sequence)
        if table.last_batch("upserts") >= number:
            batch.write.format("noop").mode("overwrite").save()  # a stream with state wants each batch to be run
            return
        table.merge(batch, "upserts", number)

    return write


def current(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """An upserted table as it is now: of each key the row of the last batch that has it."""
    return MergeTable(spark, path, keys).read()


def compact(spark: SparkSession, path: str, target: str, keys: list[str], part: Column | None = None) -> None:
    """The table at the path as a new one of one layer at ``target``; ``MergeTable.compact`` does it in place."""
    MergeTable(spark, target, keys, part).merge(current(spark, path, keys))


class LiveFactors(StatefulProcessor):
    """Per symbol and bar in time order: simple means of 5 and 20, an exponential mean and the cross of the two means."""

    def __init__(self, sequence: str | None = None) -> None:
        self.order = ["ts", sequence] if sequence else ["ts"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("factors", "closes array<double>, ema double, n long, f double, s double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        before, ema, n, f, s = [], None, 0, None, None
        if self.state.exists():
            before, ema, n, f, s = self.state.get()
            before = list(before)
        for batch in in_order((x[[*self.order, "close"]] for x in rows), self.order):
            closes, emas = batch["close"].to_numpy("float64"), []
            for x in closes.tolist():
                ema = x if ema is None else ema + (x - ema) * 2 / 21
                emas.append(ema)
            every = np.concatenate([before, closes])
            means = [window_means(every, k, n - len(before))[len(before) :] for k in (5, 20)]
            (fs, ss), (pf, ps) = means, [np.concatenate([[np.nan if x is None else x], m[:-1]]) for x, m in zip((f, s), means, strict=True)]
            cross = np.where((pf <= ps) & (fs > ss), 1.0, np.where((pf >= ps) & (fs < ss), -1.0, 0.0))  # 0 where a mean is missing
            before, n = every[-20:].tolist(), n + len(closes)
            f, s = (None if np.isnan(m[-1]) else float(m[-1]) for m in means)
            yield pd.DataFrame({"symbol": key[0], **{c: batch[c].to_numpy() for c in self.order}, "close": closes, "sma_5": fs, "sma_20": ss, "ema_20": emas, "cross": cross})
        self.state.update((before, ema, n, f, s))

    def close(self) -> None:
        pass


def live_factors(bars: DataFrame, sequence: str | None = None) -> DataFrame:
    """Factors of a stream of closed bars (symbol, ts, close): constant state per symbol. Bars have to come in time order
    from batch to batch; a late one belongs to ``recompute``. However many rows of a symbol a batch has, they pass in time order in frames of
    bounded size. Where a symbol has several rows of one time, as ticks have, ``sequence`` orders them; without it they are taken as they come."""
    own = [sequence] if sequence else []
    kept = "".join(f"`{c}` {bars.schema[c].dataType.simpleString()}, " for c in own)
    schema = f"symbol string, ts timestamp, {kept}close double, sma_5 double, sma_20 double, ema_20 double, cross double"
    return bars.select("symbol", "ts", *own, "close").groupBy("symbol").transformWithStateInPandas(LiveFactors(sequence), schema, "Append", "None")


class Breaker(StatefulProcessor):
    """Orders of an account in time order; after some rejections in a row all are rejected for a while. With event time a timer ends it."""

    def __init__(self, rejects: int, seconds: float, timers: bool = False) -> None:
        self.rejects, self.seconds, self.timers = rejects, seconds, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("breaker", "streak int, until timestamp")

    def rows(self, out: list[tuple]) -> pd.DataFrame:
        if self.timers:
            frame = pd.DataFrame(out, columns=["order_id", "account", "ts", "broken", "final", "reset"])
            return frame.astype({"order_id": "Int64", "ts": "datetime64[us]"})
        return pd.DataFrame([(i, account, broken, final) for i, account, _, broken, final, _ in out], columns=["order_id", "account", "broken", "final"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        streak, until = self.state.get() if self.state.exists() else (0, None)
        out, batch = [], pd.concat(list(rows)).sort_values(["ts", "order_id"])
        for order, ts, ok in zip(batch["order_id"], batch["ts"], batch["approved"], strict=True):
            if self.timers and until is not None and ts >= until:  # ended before the order, though the timer has not come yet
                self.handle.deleteTimer(_millis(until))
                out.append((None, key[0], until, False, None, True))
                streak, until = 0, None
            broken = until is not None and ts < until
            if not broken:
                streak = 0 if ok else streak + 1
                if streak >= self.rejects:
                    streak, until = 0, ts + pd.Timedelta(seconds=self.seconds)
                    if self.timers:
                        self.handle.registerTimer(_millis(until))
            out.append((int(order), key[0], ts, bool(broken), bool(ok and not broken), False))
        self.state.update((int(streak), until))
        yield self.rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        streak, until = self.state.get() if self.state.exists() else (0, None)
        if until is not None and _millis(until) <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
            yield self.rows([(None, key[0], pd.Timestamp(until), False, None, True)])

    def close(self) -> None:
        pass


def _millis(ts) -> int:
    return int(pd.Timestamp(ts).timestamp() * 1000)


def circuit_breaker(orders: DataFrame, rejects: int = 3, seconds: float = 300.0) -> DataFrame:
    """A stream of checked orders (order_id, account, ts, approved) with broken and final."""
    return orders.groupBy("account").transformWithStateInPandas(Breaker(rejects, seconds), "order_id long, account long, broken boolean, final boolean", "Append", "None")


def timed_breaker(orders: DataFrame, rejects: int = 3, seconds: float = 300.0, delay: str = "1 minute") -> DataFrame:
    """As ``circuit_breaker``, in event time: (order_id, account, ts, broken, final, reset) with a row of its own, without an order, when a
    breaker closes. A timer closes it once the watermark has passed the end of its cooldown, whether or not the account orders again, and the
    account's state goes; orders later than the delay are dropped."""
    schema = "order_id long, account long, ts timestamp, broken boolean, final boolean, reset boolean"
    rows = orders.withWatermark("ts", delay).select("order_id", "account", "ts", "approved")
    return rows.groupBy("account").transformWithStateInPandas(Breaker(rejects, seconds, True), schema, "Append", "EventTime")


class Rates(StatefulProcessor):
    """Each order of an account with the number of its orders in the seconds up to it; only the times of these seconds are kept."""

    def __init__(self, limit: int, seconds: int) -> None:
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "second long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "order_id"])
        before = np.array([t for (t,) in self.times.get()], np.int64) if self.times.exists() else np.zeros(0, np.int64)
        now = np.array([pd.Timestamp(t).timestamp() // 1 for t in batch["ts"]], np.int64)
        every = np.sort(np.concatenate([before, now]))
        n = np.searchsorted(every, now, "right") - np.searchsorted(every, now - self.seconds, "left")
        kept = every[every >= every[-1] - self.seconds]
        self.times.put([(int(t),) for t in kept])
        self.handle.registerTimer(int(every[-1] + self.seconds + 1) * 1000)
        yield pd.DataFrame({"order_id": batch["order_id"].astype("int64").to_numpy(), "account": key[0], "ts": batch["ts"].to_numpy(), "orders": n, "passed": n <= self.limit})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.times.exists() and max(t for (t,) in self.times.get()) + self.seconds < expiredTimerInfo.getExpiryTimeInMs() // 1000:
            self.times.clear()
        return iter(())

    def close(self) -> None:
        pass


def order_rate_limit(orders: DataFrame, limit: int, seconds: int = 60, delay: str = "1 minute") -> DataFrame:
    """A stream of orders (order_id, account, ts) with orders, their number in the account's last seconds, this one and others of its second
    included, and passed. An account's state goes when the watermark has passed its last order by as long."""
    schema = "order_id long, account long, ts timestamp, orders long, passed boolean"
    rows = orders.withWatermark("ts", delay).select("order_id", "account", "ts")
    return rows.groupBy("account").transformWithStateInPandas(Rates(limit, seconds), schema, "Append", "EventTime")


def order_rates(orders: DataFrame, limit: int, delay: str = "1 minute") -> DataFrame:
    """(account, start, n) of the sliding minutes in which an account sends more orders than the limit; ``order_rate_limit`` judges each order."""
    w = orders.withWatermark("ts", delay).groupBy("account", F.window("ts", "60 seconds", "10 seconds")).agg(F.count("*").alias("n"))
    return w.filter(F.col("n") > limit).select("account", F.col("window.start").alias("start"), "n")


def order_status(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The last status of each order so far (update mode)."""
    return events.groupBy("order_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


class Lifecycle(StatefulProcessor):
    """Reports of an order in sequence, each with the status before it and whether that allows it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("order", "status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        before = self.state.get()[0] if self.state.exists() else None
        out, batch = [], pd.concat(list(rows)).sort_values("seq")
        for seq, status in zip(batch["seq"], batch["status"], strict=True):
            out.append((key[0], int(seq), before, status, before is None or status in TRANSITIONS.get(before, [])))
            before = status
        self.state.update((before,))
        yield pd.DataFrame(out, columns=["order_id", "seq", "before", "status", "allowed"])

    def close(self) -> None:
        pass


def order_lifecycle(events: DataFrame) -> DataFrame:
    """A stream of reports (order_id, seq, status) with before and allowed; what is not allowed is reported, and the next one is held against it."""
    schema = "order_id long, seq long, before string, status string, allowed boolean"
    return events.select("order_id", "seq", "status").groupBy("order_id").transformWithStateInPandas(Lifecycle(), schema, "Append", "None")


def recompute(history: Callable[[], DataFrame], compute: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that recomputes only the symbols a batch touches, over their history, and upserts the result."""

    def run(batch: DataFrame, number: int) -> None:
        touched = batch.select("symbol").distinct()
        sink(compute(history().join(touched, "symbol", "left_semi")), number)

    return run


def envelope(df: DataFrame, channel: Column, ts: str = "ts") -> DataFrame:
    """JSON messages {channel, data, ts}."""
    data = F.struct(*[F.col(c) for c in df.columns if c != ts])
    return df.select(F.to_json(F.struct(channel.alias("channel"), data.alias("data"), F.col(ts).alias("ts"))).alias("value"))


CHAIN = ("factors", "signals", "orders", "fills")


def chain(
    bars: DataFrame, path: str, checkpoint: str, rules: Callable[[DataFrame], DataFrame], trigger: dict | None = None, spec: list[dict] | None = None, signals: tuple[str, ...] = ("cross",),
    sequence: str | None = None,
) -> StreamingQuery:
    """Bars to factors to signals to checked orders to fills, one query; each stage merges into a table under ``path``. Factors are those of
    the spec, or three means and their cross. Of a bar's signals the first one that is not zero counts, in the order given. Orders that the rules
    reject have no fill; the others fill at the close, worsened by slippage, with commission. A replayed batch adds nothing to the tables
    that have it; ``chain_tables`` reads them at a batch that all have. Tables hold one row of a symbol and time, or with ``sequence`` one of each of
    its numbers; a spec takes one bar of each time."""
    if sequence and spec is not None:
        raise ValueError("a spec takes one bar of each time, so no sequence")
    keys = ["symbol", "ts", sequence] if sequence else ["symbol", "ts"]

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            batch.count()  # run also if all tables have the batch: the state of the factors goes on with it
            fired = F.coalesce(*[F.when(F.col(s) != 0, F.col(s)) for s in signals])
            found = batch.withColumn("signal", fired).filter("signal IS NOT NULL").select(*keys, "close", "signal")
            orders = rules(found.withColumn("side", F.when(F.col("signal") > 0, "BUY").otherwise("SELL")))
            price = bt.slippage(F.col("close"), F.col("side"))
            fills = orders.filter("approved").select(*keys, "side", price.alias("price"), bt.commission(price, F.col("side")).alias("commission"))
            for name, df in zip(CHAIN, (batch, found, orders, fills), strict=True):
                MergeTable(batch.sparkSession, f"{path}/{name}", keys).merge(df, "chain", number)
        finally:
            batch.unpersist()

    if spec is None:
        factors = live_factors(bars, sequence)
    else:
        nodes = live_spec_factors(bars.withColumn("close_of_bar", F.col("close")), [*spec, {"id": "close", "op": "FIELD", "inputs": ["close_of_bar"]}], {"FIELD": lambda state, ins, params: ins[0]})
        factors = nodes.filter("NOT late").drop("late")
    return factors.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def chain_tables(spark: SparkSession, path: str, sequence: str | None = None) -> dict[str, DataFrame]:
    """The tables of a chain by name, all as of the last batch that each of them has."""
    keys = ["symbol", "ts", sequence] if sequence else ["symbol", "ts"]
    tables = {name: MergeTable(spark, f"{path}/{name}", keys) for name in CHAIN}
    batch = min(t.last_batch("chain") for t in tables.values())
    return {name: t.read(t.version_with("chain", batch)) for name, t in tables.items()}


def news_stream(news: DataFrame, **dictionaries) -> DataFrame:
    """Tagged news of a stream (title, content, published_at)."""
    return nw.tag_news(news, **dictionaries)
