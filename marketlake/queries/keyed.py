"""Queries over merge tables and over factor graphs that are kept up to date: selective recomputing, graphs as stream state, timers, counters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marketlake.functions import factors as fx
from marketlake.functions import news as nw
from marketlake.operators import joins as jn
from marketlake.operators import ml
from marketlake.plans.incremental import factor_rows, keep_factors
from marketlake.queries.base import BE, BO, Query, W, bars_events, bars_orders, last_n, rounded, sma_sql, table
from marketlake.queries.checks import _FEATURES, _breaker_sql, _mean_from
from marketlake.queries.market import ORACLE as MARKET
from marketlake.queries.portfolio import ORACLE as PORTFOLIO
from marketlake.queries.text import CONFIGS, _run, events_stream, shared_root, state_store
from marketlake.sources import bars as src
from marketlake.sources.merge_table import MergeTable
from marketlake.sources.progress import Loader
from marketlake.streaming import live
from marketlake.streaming.counters import IngestCounters, ingest_bars
from marketlake.streaming.spec_factors import live_spec_factors

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def add(name: str, fn: Query, sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        ORACLE[name] = sql


def scratch(spark, name):
    return f"{shared_root(spark)}/marketlake-{uuid.uuid4().hex}/{name}"


#: One graph for batches, for selective recomputing and for streams.
SPEC = [
    {"id": "fast", "op": "SMA", "inputs": ["close"], "params": {"period": 5}}, {"id": "slow", "op": "SMA", "inputs": ["close"], "params": {"period": 20}},
    {"id": "up", "op": "CROSS_ABOVE", "inputs": ["fast", "slow"]}, {"id": "down", "op": "CROSS_BELOW", "inputs": ["fast", "slow"]},
    {"id": "mean", "op": "EMA", "inputs": ["close"], "params": {"period": 10, "seed": "sma"}}, {"id": "rsi", "op": "RSI", "inputs": ["close"], "params": {"period": 14}},
    {"id": "hist", "op": "MACD", "inputs": ["close"]}, {"id": "top", "op": "BOLL", "inputs": ["close"], "params": {"band": "upper"}},
    {"id": "bottom", "op": "BOLL", "inputs": ["close"], "params": {"band": "lower"}}, {"id": "busy", "op": "SMA", "inputs": ["volume"], "params": {"period": 5}},
]
_NAMES = [n["id"] for n in SPEC]


def graph_sql(view: str) -> str:
    """CTEs that end in graph (symbol, ts, the nodes of SPEC) over a view of bars."""
    means = ", ".join(f"avg(close) OVER {last_n(n)} AS m{n}_close" for n in (10, 12, 26))
    return f"""o AS (SELECT *, row_number() OVER ({W}) AS i, close - lag(close) OVER ({W}) AS d, {means} FROM {view}),
 g AS (SELECT symbol, ts, i, greatest(d, 0) AS g, greatest(-d, 0) AS l, avg(greatest(d, 0)) OVER {last_n(14)} AS m14_g, avg(greatest(-d, 0)) OVER {last_n(14)} AS m14_l FROM o),
 {_mean_from('e10', 'o', 10, 2 / 11)}, {_mean_from('e12', 'o', 12, 2 / 13)}, {_mean_from('e26', 'o', 26, 2 / 27)}, {_mean_from('ag', 'g', 14, 1 / 14, 'g', 15)}, {_mean_from('al', 'g', 14, 1 / 14, 'l', 15)},
 ln AS (SELECT *, avg(x) OVER {last_n(9)} AS m9_x FROM (SELECT e26.symbol, e26.ts, e26.i, e12.v - e26.v AS x FROM e26 JOIN e12 ON e12.symbol = e26.symbol AND e12.i = e26.i)), {_mean_from('sg', 'ln', 9, 2 / 10, 'x', 34)},
 w AS (SELECT symbol, ts, i, {sma_sql('close', 5)} AS fast, {sma_sql('close', 20)} AS slow, {sma_sql('volume', 5)} AS busy, CASE WHEN count(close) OVER {last_n(20)} >= 20 THEN 2 * stddev_pop(close) OVER {last_n(20)} END AS dev FROM o),
 x AS (SELECT *, lag(fast) OVER ({W}) AS pf, lag(slow) OVER ({W}) AS ps FROM w),
 graph AS (SELECT x.symbol, x.ts, fast, slow, CASE WHEN pf <= ps AND fast > slow THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS up, CASE WHEN pf >= ps AND fast < slow THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS down, e10.v AS mean,
  CASE WHEN al.v = 0 THEN 100 ELSE 100 - 100 / (1 + ag.v / al.v) END AS rsi, ln.x - sg.v AS hist, slow + dev AS top, slow - dev AS bottom, busy FROM x LEFT JOIN e10 ON e10.symbol = x.symbol AND e10.i = x.i
  LEFT JOIN ag ON ag.symbol = x.symbol AND ag.i = x.i LEFT JOIN al ON al.symbol = x.symbol AND al.i = x.i LEFT JOIN ln ON ln.symbol = x.symbol AND ln.i = x.i LEFT JOIN sg ON sg.symbol = x.symbol AND sg.i = x.i)"""


def _wide() -> str:
    return ", ".join(f"round({n}, 4) AS {n}" for n in _NAMES)


def _bars_stream(spark, path):
    schema = "symbol string, ts timestamp, close double, volume double"
    return spark.readStream.schema(schema).parquet(path)


def _plain_bars(spark, d):
    return bars_events(spark, d).select("symbol", F.col("ts").cast("timestamp").alias("ts"), "close", F.col("volume").cast("double").alias("volume"))


# ST-04: the graph as state, stopped in the middle and resumed from its checkpoint
def _spec_stream(spark, d):
    path = scratch(spark, "bars")
    bars = _plain_bars(spark, d)
    for begin, end in (("2000-01-01", "2024-01-12"), ("2024-01-12", "2100-01-01")):
        bars.filter(F.col("ts").between(F.lit(begin).cast("timestamp"), F.expr(f"TIMESTAMP '{end}' - INTERVAL 1 SECOND"))).write.mode("append").parquet(path)
        with state_store(spark):
            out = live_spec_factors(_bars_stream(spark, path), SPEC)
            out.writeStream.format("parquet").option("path", f"{path}-out").option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(out.schema).parquet(f"{path}-out").filter("NOT late")
    return rounded(found.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), *_NAMES), 4)


add("st04_spec_factors", _spec_stream, f"WITH RECURSIVE {BE}, {graph_sql('be')} SELECT symbol, ts, {_wide()} FROM graph")


# ST-06: bars, then corrected prices of some, then corrected volumes of others; only what depends on them is computed anew
def _corrections(spark, d):
    bars = _plain_bars(spark, d)
    prices = bars.filter("symbol IN ('purchase', 'click') AND day(ts) = 11 AND hour(ts) % 5 = 0").withColumn("close", F.col("close") + 3)
    return bars, prices, bars.filter("symbol = 'view' AND day(ts) = 20").withColumn("volume", F.col("volume") * 2)


def _selective(spark, d):
    root = scratch(spark, "kept")
    keys = ["symbol", "ts"]
    bars = MergeTable(spark, f"{root}/bars", keys, F.concat_ws("/", F.lit("hour"), F.year("ts")))
    factors = MergeTable(spark, f"{root}/factors", ["factor", *keys], F.concat_ws("/", "factor", F.year("ts")))
    for batch in _corrections(spark, d):
        batch.write.mode("append").parquet(f"{root}/in")
        sink = keep_factors(bars, factors, SPEC, ["close", "volume"])
        _bars_stream(spark, f"{root}/in").writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    wide = factors.read().groupBy(*keys).pivot("factor", _NAMES).agg(F.first("value"))
    return rounded(wide.withColumn("ts", F.col("ts").cast("timestamp_ntz")), 4)


_FIXED = "bc AS (SELECT symbol, ts, CASE WHEN symbol IN ('purchase', 'click') AND day(ts) = 11 AND hour(ts) % 5 = 0 THEN close + 3 ELSE close END AS close, CASE WHEN symbol = 'view' AND day(ts) = 20 THEN volume * 2 ELSE volume END AS volume FROM be)"
add("st06_selective_recompute", _selective, f"WITH RECURSIVE {BE}, {_FIXED}, {graph_sql('bc')} SELECT symbol, ts, {_wide()} FROM graph")
add("st06_graph_rows", lambda s, d: rounded(factor_rows(_plain_bars(s, d), SPEC).groupBy("symbol", "factor").agg(F.count("value").alias("n"), F.avg("value").alias("mean")), 3), f"WITH RECURSIVE {BE}, {graph_sql('be')} SELECT symbol, factor, count(value) AS n, round(avg(value), 3) AS mean FROM (" + " UNION ALL ".join(f"SELECT symbol, '{n}' AS factor, {n} AS value FROM graph" for n in _NAMES) + ") GROUP BY 1, 2")


# IO-08: merges of orders by year, folded layers, a version of before
def _merged(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    t = MergeTable(spark, scratch(spark, "orders"), ["o_orderkey", "o_orderdate"], F.year("o_orderdate").cast("string"), fold=3)
    first = t.merge(o.filter("o_orderkey % 5 <> 0"), "orders", 0)
    t.merge(o.filter("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2), "orders", 1)
    t.merge(o.filter("year(o_orderdate) = 1996").withColumn("o_orderstatus", F.lit("X")), "orders", 2)
    t.merge(o.filter("year(o_orderdate) = 1996").withColumn("o_orderstatus", F.lit("X")), "orders", 2)  # comes again
    t.merge(o.filter("year(o_orderdate) = 1997 AND o_orderkey % 2 = 0").withColumn("o_totalprice", F.lit(1.0)), "orders", 3)
    t.compact()
    now = t.read().withColumn("version", F.lit("last"))
    rows = now.unionByName(t.read(first).withColumn("version", F.lit("first")))
    return rounded(rows.groupBy("version", F.year("o_orderdate").cast("long").alias("year"), "o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")), 2)


_LAST = "CASE WHEN year(o_orderdate) = 1997 AND o_orderkey % 2 = 0 THEN 1.0 WHEN year(o_orderdate) = 1996 THEN o_totalprice WHEN o_orderkey % 3 = 0 THEN 2 * o_totalprice ELSE o_totalprice END"
add("io08_merge_table", _merged, f"""WITH v AS (SELECT 'first' AS version, year(o_orderdate) AS year, o_orderstatus, o_totalprice AS p FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL
 SELECT 'last', year(o_orderdate), CASE WHEN year(o_orderdate) = 1996 THEN 'X' ELSE o_orderstatus END, {_LAST} FROM orders WHERE o_orderkey % 5 <> 0 OR o_orderkey % 3 = 0 OR year(o_orderdate) = 1996 OR (year(o_orderdate) = 1997 AND o_orderkey % 2 = 0))
 SELECT version, year, o_orderstatus, count(*) AS n, round(sum(p), 2) AS total FROM v GROUP BY 1, 2, 3""")


# ST-07, ST-08: limits and breakers in event time
def _rates(spark, d):
    e = events_stream(spark, d).select(F.col("event_id").alias("order_id"), F.col("user_id").alias("account"), "ts")
    return _run(live.order_rate_limit(e, 3, 86400)).select(F.col("order_id").alias("event_id"), "orders")


add("st07_rate_limit", _rates, PORTFOLIO["rk06_order_rate"])


def _resets(spark, d):
    e = events_stream(spark, d).select(F.col("event_id").alias("order_id"), F.col("user_id").alias("account"), "ts", (F.col("price") < 60).alias("approved"))
    found = _run(live.timed_breaker(e, 3, 86400.0))
    return found.groupBy("account").agg(F.count_if("broken").alias("broken"), F.count_if("final").alias("approved"), F.count_if("reset").alias("resets"), F.max(F.when(F.col("reset"), F.col("ts"))).cast("timestamp_ntz").alias("last_reset"))


add("st08_timed_breaker", _resets, f"""WITH RECURSIVE o AS (SELECT user_id AS account, ts, value < 60 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), {_breaker_sql('o', 'INTERVAL 1 DAY')},
 r AS (SELECT DISTINCT account, until FROM done WHERE until <= (SELECT max(ts) - INTERVAL 1 MINUTE FROM events)), c AS (SELECT account, count(*) AS resets, max(until) AS last_reset FROM r GROUP BY 1)
 SELECT account, count(*) FILTER (broken) AS broken, count(*) FILTER (final) AS approved, coalesce(any_value(resets), 0) AS resets, CAST(any_value(last_reset) AS TIMESTAMP) AS last_reset FROM done LEFT JOIN c USING (account) GROUP BY 1""")


# IO-09: days loaded in three batches, one of them twice, then a symbol anew
def _progress(spark, d):
    source = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("close"))
    loader, symbols = Loader(spark, scratch(spark, "loads")), source.select("symbol")
    loader.load(source, symbols.filter("symbol < '3'"), "1995-01-01", "1996-06-30")
    loader.load(source.withColumn("close", -F.col("close")), symbols, "1995-01-01", "1997-12-31")
    loader.load(source, symbols, "1995-01-01", "1999-12-31", batch=1)  # comes again: it is there
    loader.clear(symbols.filter("symbol = '5-LOW'"))
    loader.load(source, symbols.filter("symbol >= '4'"), "1997-01-01", "1998-12-31")
    data = loader.data.read().groupBy("symbol").agg(F.count("*").alias("days"), F.sum("close").alias("total"))
    return rounded(data.join(loader.progress_table(), "symbol"), 2)


add("io09_progress", _progress, """WITH s AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS close FROM orders GROUP BY 1, 2), l AS (
 SELECT symbol, date, CASE WHEN symbol < '3' AND date <= DATE '1996-06-30' THEN close WHEN symbol = '5-LOW' AND date >= DATE '1997-01-01' THEN close WHEN date <= DATE '1997-12-31' THEN -close ELSE close END AS close
 FROM s WHERE date <= DATE '1997-12-31' OR (symbol >= '4' AND date <= DATE '1998-12-31')) SELECT symbol, count(*) AS days, round(sum(close), 2) AS total, max(date) AS last_date FROM l WHERE date >= DATE '1995-01-01' GROUP BY 1""")


# IO-22: messages of which some are broken and some lack a field, counted by a listener
def _stream_counts(spark, d):
    root = scratch(spark, "messages")
    e = table(spark, d, "events")
    price = F.format_string("%.2f", F.col("value") + 1)
    volume = F.when(F.col("event_id") % 10 != 1, F.col("user_id"))
    millis = F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")  # the nearest, as epoch_ms has it
    message = F.to_json(F.struct(F.col("event_type").alias("symbol"), millis.alias("ts"), *[price.alias(c) for c in ("open", "high", "low", "close")], volume.alias("volume")))
    e.select(F.when(F.col("event_id") % 10 == 0, F.lit('{"symbol": "cut off')).otherwise(message).alias("value")).write.text(f"{root}/in")
    bars = MergeTable(spark, f"{root}/bars", ["symbol", "ts_us"], F.year(F.timestamp_micros("ts_us")).cast("string"))
    counters = IngestCounters()
    spark.streams.addListener(counters)
    try:
        query = ingest_bars(spark.readStream.text(f"{root}/in"), bars, f"{root}/checkpoint")
        query.awaitTermination()
        counters.wait(query)
    finally:
        spark.streams.removeListener(counters)
    return bars.read().agg(F.count("*").alias("in_table")).select("in_table", *[F.lit(n).cast("long").alias(c) for c, n in counters.totals("ingest").items()])


add("io22_stream_counters", _stream_counts, "SELECT count(DISTINCT (event_type, epoch_ms(ts))) FILTER (event_id % 10 > 1) AS in_table, count(*) AS received, count(*) FILTER (event_id % 10 > 1) AS stored, count(*) FILTER (event_id % 10 = 1) AS failed, count(*) FILTER (event_id % 10 = 0) AS parse_errors FROM events")

# JN-06: bars on a calendar of days, of which some have none
add("jn06_calendar_days", lambda s, d: rounded(jn.align_calendar(bars_orders(s, d).select("symbol", "ts", "close").filter("day(ts) > 2"), table(s, d, "orders").select(F.date_trunc("DAY", "o_orderdate").cast("timestamp_ntz").alias("ts"))), 4), f"WITH {BO} SELECT ts, symbol, round(close, 4) AS close FROM (SELECT DISTINCT CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS ts FROM orders) LEFT JOIN (SELECT symbol, ts, close FROM bo WHERE day(ts) > 2) USING (ts)")

# TS-02, TS-04: symbols cut into slices of days
add("ts02_sliced_ema", lambda s, d: rounded(fx.ema(_in_slices(s, d), "close", 20, "ema", slices="days").select("symbol", "ts", "ema"), 4), MARKET["ts02_ema_first"])
add("ts04_sliced_rsi", lambda s, d: rounded(fx.rsi(_in_slices(s, d), slices="days").select("symbol", "ts", "rsi"), 4), MARKET["ts04_rsi"])


def _in_slices(spark, d):
    return bars_events(spark, d).withColumn("days", F.floor(F.datediff("ts", F.lit("2024-01-01")) / 3))


# ML-03, ML-04: a model saved, put into production, loaded and held against the one that was fitted; of its 200 trees a tenth, since each level of
# each tree is a job of its own
def _reloaded(spark, d):
    path = scratch(spark, "models")
    rows = ml.build_features(bars_orders(spark, d), CONFIGS)
    names = [c for c in rows.columns if c not in ("symbol", "date", "label")]
    model = ml.fit_trees(ml.split_by_date(rows).filter("split = 'train'"), names, trees=20)
    row = spark.createDataFrame([("v1", False)], "version string, production boolean").withColumn("created", F.lit("2024-01-01").cast("timestamp_ntz"))
    ml.promote(ml.add_version(row, model, path), "v1").write.mode("overwrite").parquet(f"{path}-promoted/versions")
    model.write().save(f"{path}-promoted/models/v1")
    fitted = ml.predict(model, rows, names).select("symbol", "date", F.col("prediction").alias("p"))
    again = ml.score_with(spark, f"{path}-promoted", rows, names)
    return again.join(fitted, ["symbol", "date"]).groupBy("version").agg(F.count("*").alias("n"), F.count_if(F.col("p") != F.col("prediction")).alias("different"))


add("ml04_reloaded", _reloaded, _FEATURES + " SELECT 'v1' AS version, count(*) AS n, 0 AS different FROM ft")


# IO-18: bars and their signals in tables of the same buckets; the join and the window after it stay where the rows are
def _bucketed(spark, d):
    bars = bars_events(spark, d)
    tables = []
    for name, rows in (("bars", bars), ("signals", bars.filter("close > open").select("symbol", "ts", (F.col("close") - F.col("open")).alias("gain")))):
        tables.append(src.write_bucketed(rows, f"marketlake_{name}_{uuid.uuid4().hex}", 8, path=scratch(spark, name)))
    both = tables[0].join(tables[1].hint("merge"), ["symbol", "ts"])
    return rounded(both.select("symbol", "ts", fx.sma("gain", 3).alias("gain")), 4)


add("io18_bucketed", _bucketed, f"WITH {BE}, g AS (SELECT symbol, ts, close - open AS gain FROM be WHERE close > open) SELECT symbol, ts, round({sma_sql('gain', 3)}, 4) AS gain FROM g")
add("nw07_bounded_codes", lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(nw.extract_codes(F.concat_ws(" ", "text", F.lpad(F.col("doc_id").cast("string"), 7, "6"), F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit("x600519"), F.lit("600036.SH")), True), ",").alias("codes")),
    r"WITH c AS (SELECT doc_id, list_distinct(regexp_extract_all(regexp_replace(concat_ws(' ', text, lpad(CAST(doc_id AS VARCHAR), 7, '6'), lpad(CAST(doc_id AS VARCHAR), 6, '0'), 'x600519', '600036.SH'), '[0-9A-Za-z]*([0-9]{7}|[A-Za-z][0-9]{6}|[0-9]{6}[A-Za-z])[0-9A-Za-z]*', '#', 'g'), '[0-9]{6}(\.SH|\.SZ|\.BJ)?')) AS l FROM documents), e AS (SELECT doc_id, unnest(l) AS x FROM c), f AS (SELECT DISTINCT doc_id, CASE WHEN length(x) > 6 THEN x WHEN x[1] IN ('6', '9') THEN x || '.SH' WHEN x[1] IN ('0', '2', '3') THEN x || '.SZ' WHEN x[1] = '4' THEN x || '.BJ' END AS y FROM e) SELECT doc_id, coalesce(string_agg(y, ',' ORDER BY y), '') AS codes FROM f GROUP BY 1")
