"""From signals to fills, positions and net asset values, for many symbols, strategies and parameter sets at once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from marketlake.functions.factors import sma


def slippage(price: Column, side: Column, model: str = "percentage", rate: float = 0.001) -> Column:
    """The price worsened for the side: by a share, a fixed amount or basis points."""
    move = {"percentage": price * rate, "fixed": F.lit(rate), "bps": price * rate / 10000}[model]
    return F.when(side == "BUY", price + move).otherwise(price - move)


def commission(value: Column, side: Column, rate: float = 0.00025, least: float = 5.0, tax: float = 0.001) -> Column:
    return F.greatest(value * rate, F.lit(least)) + F.when(side == "SELL", value * tax).otherwise(0.0)


def limit_blocked(side: Column, close: Column, prev: Column, ratio: float = 0.1) -> Column:
    """Whether a buy is at the upper or a sell at the lower daily limit."""
    change = F.try_divide(close - prev, prev)
    return F.coalesce(((side == "BUY") & (change >= ratio)) | ((side == "SELL") & (change <= -ratio)), F.lit(False))


def volume_cap(quantity: Column, volume: Column, ratio: float = 0.001) -> Column:
    cap = F.floor(volume * ratio)
    return F.when(cap > 0, F.least(quantity, cap)).otherwise(quantity)


def make_fills(orders: DataFrame, bars: DataFrame, rate: float = 0.001, cap: float = 0.001) -> DataFrame:
    """Fills of orders (order_id, symbol, ts, side, quantity) at the bar of their time: slippage, price limits, commission on the
    ordered quantity, volume cap."""
    w = Window.partitionBy("symbol").orderBy("ts")
    b = bars.select("symbol", "ts", "close", "volume", F.lag("close").over(w).alias("prev"))
    o = orders.join(b, ["symbol", "ts"]).filter(~limit_blocked(F.col("side"), F.col("close"), F.coalesce("prev", "close")))
    price = slippage(F.col("close"), F.col("side"), rate=rate)
    return o.select("order_id", "symbol", "ts", "side", volume_cap(F.col("quantity"), F.col("volume"), cap).cast("long").alias("quantity"), price.alias("price"), commission(price * F.col("quantity"), F.col("side")).alias("commission"))


def trade_log(fills: DataFrame) -> DataFrame:
    return fills.select(F.to_date("ts").alias("date"), "symbol", "side", "quantity", F.round("price", 2).alias("price"))


def _states(live: DataFrame, signal: str, keys: list[str], cash: float, buy_weight: float, sell_weight: float) -> DataFrame:
    """(keys, ts, __cash, __pos) after each row with a signal, in time order within each group. A positive signal buys int(cash * weight / price),
    a negative one sells int(position * weight). The fold streams through sorted batches with the state of one group."""
    rows = live.select(*keys, "ts", F.col(signal).alias("__s"), F.col("close").alias("__p"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys, "ts").schema) + ", __cash double, __pos long"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, money, held = None, cash, 0
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                *key, _, s, p = row
                if key != now:
                    now, money, held = key, cash, 0
                if s > 0:
                    q = int(money * buy_weight / p)
                    money, held = money - q * p, held + q
                else:
                    q = int(held * sell_weight)
                    money, held = money + q * p, held - q
                out.append((money, held))
            yield batch[[*keys, "ts"]].assign(__cash=[x[0] for x in out], __pos=[x[1] for x in out])

    return rows.repartition(*keys).sortWithinPartitions(*keys, "ts").mapInPandas(fold, schema)


def _live(signal: str, least: float = 0.0) -> Column:
    return (F.abs(signal) > least) & (F.col(signal) != 0) & F.col(signal).isNotNull() & (F.col("close") > 0)


def backtest_single(bars: DataFrame, signal: str, keys: list[str], cash: float = 1_000_000.0, buy_weight: float = 0.95, sell_weight: float = 1.0, min_signal: float = 0.0) -> DataFrame:
    """NAV rows (keys, ts, cash, position, total_value) of each group of ``keys`` on its own cash.

    Signals change the state, other bars do not: only rows with a signal are folded, and what comes out is carried forward to all bars by a
    window. The fold is sequential by nature; it sees signal rows only, spread over all groups.
    """
    state = _states(bars.filter(_live(signal, min_signal)), signal, keys, cash, buy_weight, sell_weight)
    w = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    nav = bars.select(*keys, "ts", "close").join(state, [*keys, "ts"], "left")
    money, held = F.coalesce(F.last("__cash", True).over(w), F.lit(cash)), F.coalesce(F.last("__pos", True).over(w), F.lit(0))
    return nav.select(*keys, "ts", money.alias("cash"), held.cast("long").alias("position"), (money + held * F.col("close")).alias("total_value"))


#: So many strategies at most are broadcast to the bars; more are joined by the shuffle of a plain cross join's rows.
FEW = 10_000


def batch_backtest(bars: DataFrame, strategies: DataFrame, cash: float = 1_000_000.0) -> DataFrame:
    """(strategy, symbol, final_value, n, error) of average crosses (strategy, fast, slow) on every symbol, each on its own cash.

    A strategy with bad periods has one row with its error, and the others run. There is one window for each distinct period; bars meet
    the strategies map-side and only rows with a signal go on to the fold. A final value needs the last state and the last bar.
    """
    wrong = F.when(F.coalesce(F.col("fast") <= 0, F.lit(True)) | F.coalesce(F.col("slow") <= 0, F.lit(True)), "period must be positive").when(F.col("fast") >= F.col("slow"), "fast period must be below slow")
    checked = strategies.withColumn("error", wrong)
    good = checked.filter("error is null").select("strategy", "fast", "slow")
    periods = sorted({int(r[0]) for r in good.select("fast").union(good.select("slow")).distinct().collect()})
    few = good.count() <= FEW
    given = F.broadcast(good) if few else good
    means = F.create_map(*[x for n in periods for x in (F.lit(n), sma("close", n))]) if periods else F.lit(None).cast("map<int,double>")
    closes = bars.select("symbol", "ts", "close", means.alias("m")).withColumn("p", F.lag("m").over(Window.partitionBy("symbol").orderBy("ts")))
    f, s, pf, ps = (F.col(m)[F.col(c)] for m in ("m", "p") for c in ("fast", "slow"))
    signal = F.when((pf <= ps) & (f > s), 1.0).when((pf >= ps) & (f < s), -1.0).otherwise(0.0)
    fired = closes.join(given, how="cross").select("strategy", "symbol", "ts", "close", signal.alias("signal")).filter(_live("signal"))
    states = _states(fired, "signal", ["strategy", "symbol"], cash, 0.95, 1.0)
    last = states.groupBy("strategy", "symbol").agg(F.max_by(F.struct("__cash", "__pos"), "ts").alias("s"))
    ends = bars.groupBy("symbol").agg(F.max_by("close", "ts").alias("close"), F.count("*").alias("n")).join(given.select("strategy"), how="cross")
    value = F.coalesce("s.__cash", F.lit(cash)) + F.coalesce("s.__pos", F.lit(0)) * F.col("close")
    done = ends.join(last, ["strategy", "symbol"], "left").select("strategy", "symbol", value.alias("final_value"), "n", F.lit(None).cast("string").alias("error"))
    return done.unionByName(checked.filter("error is not null").select("strategy", "error"), allowMissingColumns=True)


def backtest_portfolio(signals: DataFrame, cash: float = 1_000_000.0, weight: float = 0.95, sequential: bool = False) -> DataFrame:
    """Trades (strategy, ts, symbol, side, quantity, price, cash) of strategies that share their cash over symbols.

    signals: (strategy, ts, symbol, direction, strength, close). LONG and flat buys int(cash * weight * strength / close) of the
    cash the time began with, or of what is left if ``sequential``; SHORT and EXIT sell the whole position. A strategy's signal rows stream
    through one task in sorted batches; only what it holds is kept.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, money, held, now, begin = None, cash, {}, None, cash
        for batch in batches:
            out = []
            for strategy, ts, symbol, d, strength, p in batch.itertuples(index=False):
                if strategy != own:
                    own, money, held, now, begin = strategy, cash, {}, None, cash
                if ts != now:
                    now, begin = ts, money
                if d == "LONG" and not held.get(symbol) and p > 0:
                    q = int((money if sequential else begin) * weight * strength / p)
                    if q > 0:
                        money, held[symbol] = money - q * p, q
                        out.append((strategy, ts, symbol, "BUY", q, p, money))
                elif d in ("SHORT", "EXIT") and held.get(symbol):
                    q = held.pop(symbol)
                    money += q * p
                    out.append((strategy, ts, symbol, "SELL", q, p, money))
            yield pd.DataFrame(out, columns=["strategy", "ts", "symbol", "side", "quantity", "price", "cash"])

    rows = signals.select("strategy", "ts", "symbol", "direction", "strength", "close").filter("direction is not null")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    rows = rows.repartition("strategy").sortWithinPartitions("strategy", "ts", "symbol")
    return rows.mapInPandas(fold, f"strategy {kinds['strategy']}, ts {kinds['ts']}, symbol {kinds['symbol']}, side string, quantity long, price double, cash double")


def mark_to_market(trades: DataFrame, bars: DataFrame, cash: float = 1_000_000.0) -> DataFrame:
    """NAV per strategy and time from its trades: positions and cash as step functions, priced at every bar."""
    signed = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    held = trades.groupBy("strategy", "symbol", "ts").agg(F.sum(signed).alias("dq"), F.sum(-signed * F.col("price")).alias("dc"))
    pairs = trades.select("strategy", "symbol").distinct()
    w = Window.partitionBy("strategy", "symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    grid = bars.select("symbol", "ts", "close").join(pairs, "symbol").join(held, ["strategy", "symbol", "ts"], "left")
    grid = grid.withColumn("q", F.coalesce(F.sum("dq").over(w), F.lit(0)))
    byts = grid.groupBy("strategy", "ts").agg(F.sum(F.col("q") * F.col("close")).alias("positions_value"), F.count_if(F.col("q") != 0).alias("positions_count"), F.coalesce(F.sum("dc"), F.lit(0.0)).alias("dc"))
    run = Window.partitionBy("strategy").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    out = byts.withColumn("cash", cash + F.sum("dc").over(run))
    return out.select("strategy", "ts", "cash", "positions_value", "positions_count", (F.col("cash") + F.col("positions_value")).alias("total_value"))
