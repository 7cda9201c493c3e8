"""Further single operators as queries of their own."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marketlake.functions import factors as fx
from marketlake.functions import news as nw
from marketlake.functions import signals as sg
from marketlake.operators import backtest as bt
from marketlake.operators import calendar as cal
from marketlake.operators import joins as jn
from marketlake.operators import macro as mc
from marketlake.operators import risk as rk
from marketlake.queries.base import BE, BO, Query, W, bars_events, bars_orders, last_n, rounded, sma_sql, table
from marketlake.queries.portfolio import _R, _bt_orders, _risk
from marketlake.queries.text import _D, TOPICS, _run, docs, events_stream, shared_root, state_store
from marketlake.sources import bars as src
from marketlake.streaming import live

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def add(name: str, fn: Query, sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        ORACLE[name] = sql


add("io13_normalize_columns", lambda s, d: rounded(src.normalize_columns(table(s, d, "orders").select(F.col("o_orderdate").cast("date").alias("trade_date"), F.col("o_totalprice").alias("px"), F.col("o_custkey").alias("vol")), {"px": "close", "vol": "volume"}, {"close", "volume", "date"}), 4), "SELECT CAST(o_orderdate AS DATE) AS date, round(o_totalprice, 4) AS close, o_custkey AS volume, round(o_custkey * o_totalprice, 4) AS amount FROM orders")
add("io22_ingest_counters", lambda s, d: table(s, d, "events").select("event_type", (F.col("value") > 50).alias("ok")).groupBy("event_type").agg(F.count("*").alias("received"), F.count_if("ok").alias("stored"), F.count_if(~F.col("ok")).alias("failed")), "SELECT event_type, count(*) AS received, count(*) FILTER (value > 50) AS stored, count(*) FILTER (NOT value > 50) AS failed FROM events GROUP BY 1")
add("fp02_event_types", lambda s, d: live.subscribe(table(s, d, "events").select("event_id", F.col("user_id").cast("string").alias("symbol"), F.col("event_type").alias("type")), None, ["click", "view"]), "SELECT event_id, CAST(user_id AS VARCHAR) AS symbol, event_type AS type FROM events WHERE event_type IN ('click', 'view')")
add("fp03_date_range", lambda s, d: table(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date")).filter(F.col("date").between(F.lit("1997-01-01").cast("date"), F.lit("1997-03-31").cast("date"))), "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-03-31'")
add("fp05_news_for_symbol", lambda s, d: nw.news_filter(docs(s, d).withColumn("symbols", F.array("source")), F.lit("2024-01-03").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz")).filter(F.array_contains("symbols", "src1")).select("news_id", "published_at"), _D + " SELECT news_id, published_at FROM n WHERE source = 'src1' AND published_at BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20'")
add("fp07_trading_days", lambda s, d: cal.trading_days(src.scan_bars(bars_orders(s, d), "1-URGENT", "1996-01-01", "1996-06-30")), f"WITH {BO} SELECT DISTINCT CAST(ts AS DATE) AS day FROM bo WHERE symbol = '1-URGENT' AND ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-06-30'")
add("fp10_drop_empty", lambda s, d: rounded(bars_events(s, d).select("symbol", "ts", fx.sma("close", 20).alias("a"), fx.pct_change("close", 5).alias("b")).na.drop(how="all", subset=["a", "b"])), f"WITH {BE}, m AS (SELECT symbol, ts, {sma_sql('close', 20)} AS a, close / lag(close, 5) OVER ({W}) - 1 AS b FROM be) SELECT symbol, ts, round(a, 6) AS a, round(b, 6) AS b FROM m WHERE a IS NOT NULL OR b IS NOT NULL")
add("ts14_rolling_mean", lambda s, d: rounded(bars_events(s, d).select("symbol", "ts", fx.sma("close", 3, least=1).alias("mean"), fx.prev_close().alias("prev"), fx.drawdown("close").alias("drawdown"))), f"WITH {BE} SELECT symbol, ts, round(avg(close) OVER {last_n(3)}, 6) AS mean, round(lag(close) OVER ({W}), 6) AS prev, round(close / max(close) OVER ({W} ROWS UNBOUNDED PRECEDING) - 1, 6) AS drawdown FROM be")
add("ts26_day_count", lambda s, d: cal.day_count(cal.trading_days(bars_orders(s, d)), table(s, d, "orders").select(F.to_date("o_orderdate").alias("a"), F.date_add(F.to_date("o_orderdate"), 10).alias("b")).distinct()), f"WITH {BO}, t AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM bo), s AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS a, CAST(CAST(o_orderdate AS DATE) + 10 AS DATE) AS b FROM orders) SELECT a, b, count(day) AS days FROM s LEFT JOIN t ON day BETWEEN a AND b GROUP BY 1, 2")


def _join(spark, d):
    b = bars_orders(spark, d).withColumn("date", F.to_date("ts"))
    return rounded(jn.join_features_labels(b.select("symbol", "date", fx.pct_change("close", 5).alias("x")), b.select("symbol", "date", fx.forward_return(5).alias("y"))))


add("jn01_features_labels", _join, f"WITH {BO} SELECT symbol, CAST(ts AS DATE) AS date, round(close / lag(close, 5) OVER ({W}) - 1, 6) AS x, round(lead(close, 5) OVER ({W}) / close - 1, 6) AS y FROM bo")
add("nw03_labels_importance", lambda s, d: docs(s, d).select("news_id", nw.event_types(F.col("content"), TOPICS | {"macro": ["est"]}).alias("t")).select("news_id", nw.event_importance(F.col("t")).alias("importance")))
add("bt09_trade_log", lambda s, d: bt.trade_log(bt.make_fills(_bt_orders(s, d), bars_orders(s, d), cap=0.5)).groupBy("date", "side").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity")), f"WITH {BO}, b AS (SELECT *, lag(close) OVER ({W}) AS prev FROM bo), o AS (SELECT ts, CASE WHEN day(ts) % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, volume * 100 AS q, volume, (close - coalesce(prev, close)) / coalesce(prev, close) AS ch FROM b) SELECT CAST(ts AS DATE) AS date, side, count(*) AS n, CAST(sum(CASE WHEN floor(volume * 0.5) > 0 THEN least(q, floor(volume * 0.5)) ELSE q END) AS BIGINT) AS quantity FROM o WHERE NOT (side = 'BUY' AND ch >= 0.1) AND NOT (side = 'SELL' AND ch <= -0.1) GROUP BY 1, 2")
add("rk01_single_rules", lambda s, d: _risk(s, d).select("order_id", rk.max_drawdown(0.1).alias("drawdown"), rk.concentration(0.3).alias("concentration"), rk.exposure(0.95).alias("exposure"), rk.order_limit(500000.0, 5000000.0).alias("order_limit"), rk.position_size(10000).alias("size"), rk.portfolio_risk(0.05).alias("risk")), _R + " SELECT order_id, r1 AS drawdown, r2 AS concentration, r3 AS exposure, r4 AS order_limit, r5 AS size, r6 AS risk FROM r")
add("rk07_trading_hours", lambda s, d: table(s, d, "events").select("event_id", (~cal.within_trading_hours(F.col("ts"))).alias("rejected")), "SELECT event_id, NOT (hour(ts) * 60 + minute(ts) BETWEEN 570 AND 900) AS rejected FROM events")
add("sg13_direction", lambda s, d: rounded(bars_events(s, d).withColumn("c", fx.pct_change()).filter("c is not null").select("symbol", "ts", sg.direction(F.col("c"))[0].alias("direction"), sg.direction(F.col("c"))[1].alias("strength"))), f"WITH {BE}, x AS (SELECT symbol, ts, close / lag(close) OVER ({W}) - 1 AS c FROM be) SELECT symbol, ts, CASE WHEN c > 0 THEN 'LONG' WHEN c < 0 THEN 'SHORT' ELSE 'EXIT' END AS direction, round(abs(c), 6) AS strength FROM x WHERE c IS NOT NULL")
add("xs06_weighted_indicator", lambda s, d: rounded(mc.leading_indicator(table(s, d, "orders").groupBy(F.col("o_orderstatus").alias("series"), F.trunc("o_orderdate", "MM").alias("date")).agg(F.sum("o_totalprice").alias("value")), {"F": 0.6, "O": 0.4}), 5), "WITH m AS (SELECT o_orderstatus AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2), z AS (SELECT series, date, (value - avg(value) OVER s) / stddev_samp(value) OVER s AS z FROM m WINDOW s AS (PARTITION BY series)) SELECT date, round(sum(z * CASE series WHEN 'F' THEN 0.6 WHEN 'O' THEN 0.4 END), 5) AS indicator FROM z GROUP BY 1")


def _dedup_stream(spark, d):
    e = events_stream(spark, d)
    return _run(live.drop_repeated(e.select("symbol", F.date_trunc("HOUR", "ts").alias("ts"), "price"), "30 days")).groupBy("symbol").agg(F.count("*").alias("n"))


add("st02_drop_repeated", _dedup_stream, f"WITH {BE} SELECT symbol, count(*) AS n FROM be GROUP BY 1")


def _live_signals(spark, d):
    f = _run(live.live_factors(events_stream(spark, d).withColumnRenamed("price", "close"), "seq"))
    return f.filter("cross <> 0").groupBy("symbol", F.when(F.col("cross") > 0, "BUY").otherwise("SELL").alias("side")).agg(F.count("*").alias("n"))


add("st05_live_signals", _live_signals, "WITH e AS (SELECT event_type AS symbol, ts, value AS close FROM events), m AS (SELECT symbol, ts, " + sma_sql("close", 5) + " AS f, " + sma_sql("close", 20) + f" AS s FROM e), x AS (SELECT *, lag(f) OVER ({W}) AS pf, lag(s) OVER ({W}) AS p FROM m) SELECT symbol, CASE WHEN pf <= p AND f > s THEN 'BUY' ELSE 'SELL' END AS side, count(*) AS n FROM x WHERE (pf <= p AND f > s) OR (pf >= p AND f < s) GROUP BY 1, 2")


def _chain(spark, d):
    """The whole live chain, then its orders table."""
    root = f"{shared_root(spark)}/chain-{uuid.uuid4().hex}"
    with state_store(spark):
        live.chain(events_stream(spark, d).withColumnRenamed("price", "close"), f"{root}/t", f"{root}/c", lambda s: s.withColumn("approved", F.col("close") < 100), sequence="seq").awaitTermination()
    return live.chain_tables(spark, f"{root}/t", "seq")["orders"].groupBy("symbol", "side", "approved").agg(F.count("*").alias("n"))


add("st10_live_chain", _chain, ORACLE["st05_live_signals"].replace("SELECT symbol, ts, ", "SELECT symbol, ts, close, ").replace("SELECT symbol, CASE", "SELECT symbol, close < 100 AS approved, CASE").replace("GROUP BY 1, 2", "GROUP BY 1, 2, 3"))
