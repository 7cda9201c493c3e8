"""Queries over bars: construction, scans, factors, signals, cross-sections."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from marketlake.functions import factors as fx
from marketlake.functions import signals as sg
from marketlake.operators import xsection as xs
from marketlake.queries.base import BE, BO, Query, W, bars_events, bars_orders, last_n, round_as_sql, rounded, sma_sql, table
from marketlake.sources import bars as src

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def add(name: str, fn: Query, sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        ORACLE[name] = sql


def _flagship(spark, d):
    b = bars_events(spark, d).withColumn("sma_5", fx.sma("close", 5)).withColumn("sma_20", fx.sma("close", 20))
    b = b.withColumn("cross", sg.ma_cross()).withColumn("next_return", fx.forward_return(1))
    return rounded(b.filter("cross <> 0").select("symbol", "ts", "close", "sma_5", "sma_20", "cross", "next_return"))


add("flagship_crosses", _flagship, f"""WITH {BE}, m AS (SELECT *, {sma_sql('close', 5)} AS sma_5, {sma_sql('close', 20)} AS sma_20, lead(close) OVER ({W}) AS nxt FROM be),
 x AS (SELECT *, lag(sma_5) OVER ({W}) AS p5, lag(sma_20) OVER ({W}) AS p20 FROM m)
 SELECT symbol, ts, round(close, 6) AS close, round(sma_5, 6) AS sma_5, round(sma_20, 6) AS sma_20, CASE WHEN p5 <= p20 AND sma_5 > sma_20 THEN 1.0::DOUBLE ELSE (-1.0)::DOUBLE END AS "cross",
 round(nxt / close - 1, 6) AS next_return FROM x WHERE (p5 <= p20 AND sma_5 > sma_20) OR (p5 >= p20 AND sma_5 < sma_20)""")

add("bars_events_hourly", lambda s, d: rounded(bars_events(s, d)), f"WITH {BE} SELECT symbol, ts, round(open,6) AS open, round(high,6) AS high, round(low,6) AS low, round(close,6) AS close, volume, round(amount,6) AS amount FROM be")
add("bars_orders_daily", lambda s, d: rounded(bars_orders(s, d), 4), f"WITH {BO} SELECT symbol, ts, round(open,4) AS open, round(high,4) AS high, round(low,4) AS low, round(close,4) AS close, volume, round(amount,4) AS amount FROM bo")
add("bars_resample_daily", lambda s, d: rounded(src.resample(bars_events(s, d), "DAY")),
    f"WITH {BE} SELECT symbol, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, round(arg_min(open, ts),6) AS open, round(max(high),6) AS high, round(min(low),6) AS low, round(arg_max(close, ts),6) AS close, CAST(sum(volume) AS BIGINT) AS volume, round(sum(amount),6) AS amount FROM be GROUP BY 1, 2")
add("io06_scan_range", lambda s, d: rounded(src.scan_bars(bars_events(s, d), "purchase", "2024-01-05", "2024-01-10", days=True).select("symbol", "ts", "close")),
    f"WITH {BE} SELECT symbol, ts, round(close,6) AS close FROM be WHERE symbol = 'purchase' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-11'")
add("io07_scan_fields", lambda s, d: rounded(src.scan_fields(bars_orders(s, d)), 4),
    f"WITH {BO} SELECT symbol, ts, field, round(value,4) AS value FROM (SELECT symbol, ts, 'open' AS field, open AS value FROM bo UNION ALL SELECT symbol, ts, 'high', high FROM bo UNION ALL SELECT symbol, ts, 'low', low FROM bo UNION ALL SELECT symbol, ts, 'close', close FROM bo UNION ALL SELECT symbol, ts, 'volume', CAST(volume AS DOUBLE) FROM bo UNION ALL SELECT symbol, ts, 'amount', amount FROM bo)")


def _upsert(spark, d):
    b = bars_events(spark, d).select("symbol", "ts", "close")
    new = b.filter(F.hour("ts") == 10).withColumn("close", F.col("close") * 2)
    return rounded(src.upsert(b, new, ["symbol", "ts"]))


add("io08_upsert", _upsert, f"WITH {BE} SELECT symbol, ts, round(CASE WHEN hour(ts) = 10 THEN close * 2 ELSE close END, 6) AS close FROM be")


def _incremental(spark, d):
    b = bars_orders(spark, d)
    progress = b.filter("symbol <> '1-URGENT'").groupBy("symbol").agg(F.max(F.to_date("ts")).alias("last_date"))
    return src.incremental_window(progress, b.select("symbol").distinct(), "1995-01-01", "2001-08-01")


add("io09_incremental_window", _incremental, f"WITH {BO}, p AS (SELECT symbol, max(CAST(ts AS DATE)) AS l FROM bo WHERE symbol <> '1-URGENT' GROUP BY 1), k AS (SELECT DISTINCT symbol FROM bo), x AS (SELECT k.symbol, coalesce(greatest(CAST(l + 1 AS DATE), DATE '1995-01-01'), DATE '1995-01-01') AS \"start\", DATE '2001-08-01' AS \"end\" FROM k LEFT JOIN p USING (symbol)) SELECT * FROM x WHERE \"start\" < \"end\"")


def _plan(spark, d):
    b = bars_events(spark, d)
    progress = b.filter(F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz")).groupBy("symbol").agg(F.max(F.to_date("ts")).alias("last_date"))
    return src.session_plan(b.select("symbol").distinct(), progress, "2024-01-01", "2024-01-31")


add("io10_session_plan", _plan, f"WITH {BE}, k AS (SELECT DISTINCT symbol FROM be), p AS (SELECT symbol, max(CAST(ts AS DATE)) AS l FROM be WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1), dd AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day) SELECT k.symbol, dd.day, '09:30' AS open, '15:00' AS close FROM k CROSS JOIN dd LEFT JOIN p USING (symbol) WHERE isodow(dd.day) <= 5 AND (l IS NULL OR dd.day > l)")


def _json(spark, d):
    e = table(spark, d, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("symbol"), F.lit(1700000000000).alias("ts"), F.when(F.col("event_id") % 2 == 0, F.format_string("%.2f", "value")).otherwise(F.floor(F.col("value") * 10000).cast("long").cast("string")).alias("open"), F.lit("1.5").alias("high"), F.lit("10000").alias("low"), F.when(F.col("event_id") % 5 != 0, F.lit("2.25")).alias("close"), F.lit(7).alias("volume"))).alias("value"))
    return src.parse_bar_json(e).agg(F.count("*").alias("n"), F.count_if("ok").alias("ok"), F.sum("open").alias("open_sum"), F.sum("close").alias("close_sum"), F.max("ts_us").alias("ts_us"))


add("io11_parse_json", _json, "SELECT count(*) AS n, CAST(count(*) FILTER (event_id % 5 <> 0) AS BIGINT) AS ok, CAST(sum(CASE WHEN event_id % 2 = 0 THEN floor(CAST(printf('%.2f', value) AS DOUBLE) * 10000 + 0.5) ELSE floor(value * 10000) END) AS BIGINT) AS open_sum, CAST(sum(CASE WHEN event_id % 5 <> 0 THEN 22500 END) AS BIGINT) AS close_sum, CAST(1700000000000000 AS BIGINT) AS ts_us FROM events")


def _items(spark, d):
    o = table(spark, d, "orders").select(F.concat(F.lit('{"data":{"items":[["'), F.date_format("o_orderdate", "yyyyMMdd"), F.lit('",'), F.col("o_orderkey"), F.lit(',2,3,4,5,6],["bad",1,2,3,4,5,6]]}}')).alias("value"))
    return src.parse_items_json(o).groupBy("date").agg(F.count("*").alias("n"), F.round(F.sum("open"), 4).alias("open_sum"))


add("io12_parse_items", _items, "SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n, round(sum(CAST(o_orderkey AS DOUBLE)), 4) AS open_sum FROM orders GROUP BY 1 UNION ALL SELECT NULL, count(*), round(sum(1.0::DOUBLE), 4) FROM orders")


def _csv(spark, d):
    o = table(spark, d, "orders")
    line = F.concat_ws(",", "o_orderpriority", F.when(F.col("o_orderkey") % 7 == 0, "bad").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")), F.lit("1"), F.lit("2"), F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise("3"), F.lit("4"), F.lit("5"))
    return src.load_stats(src.parse_bars_csv(o.select(line.alias("value"))).withColumn("file", F.col("symbol")))


add("io01_csv_stats", _csv, "SELECT o_orderpriority AS file, count(*) FILTER (o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0) AS loaded, count(*) FILTER (o_orderkey % 7 = 0 OR o_orderkey % 5 = 0) AS failed FROM orders GROUP BY 1")
add("io02_frequency", lambda s, d: table(s, d, "part").select("p_partkey", src.frequency_of_file(F.concat_ws("_", F.element_at(F.array(*map(F.lit, ["a1min", "b5min", "c15min", "d60min", "e"])), (F.col("p_partkey") % 5 + 1).cast("int")), "p_partkey")).alias("freq"), src.frequency(F.element_at(F.array(*map(F.lit, ["M1", "daily", "min15", "?"])), (F.col("p_partkey") % 4 + 1).cast("int"))).alias("freq2")),
    "SELECT p_partkey, ['1min','5min','15min','60min','day'][p_partkey % 5 + 1] AS freq, ['1min','day','15min',NULL][p_partkey % 4 + 1] AS freq2 FROM part")
add("io17_cross_section", lambda s, d: rounded(bars_orders(s, d).filter(F.to_date("ts") == F.lit("1996-03-04").cast("date")).select("symbol", F.col("close").alias("value")), 4),
    f"WITH {BO} SELECT symbol, round(close, 4) AS value FROM bo WHERE CAST(ts AS DATE) = DATE '1996-03-04'")
add("io19_latest_results", lambda s, d: rounded(src.latest(bars_orders(s, d), "symbol", "ts", 5).select("symbol", "ts", "close", F.col("rn").cast("long").alias("rn")), 4),
    f"WITH {BO} SELECT * FROM (SELECT symbol, ts, round(close,4) AS close, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bo) WHERE rn <= 5")
add("io21_data_coverage", lambda s, d: src.data_coverage(bars_events(s, d).withColumn("freq", F.lit("60min"))),
    f"WITH {BE} SELECT symbol, '60min' AS freq, min(ts) AS min_ts, max(ts) AS max_ts, count(*) AS row_count FROM be GROUP BY 1")
add("io25_normalize", lambda s, d: table(s, d, "orders").select("o_orderkey", src.to_fixed(F.col("o_totalprice")).alias("fixed"), F.round(src.from_fixed(F.col("o_orderkey")), 6).alias("price"), src.daily_close_time(F.to_date("o_orderdate")).alias("ts"), src.unify_symbol(F.concat(F.element_at(F.array(*map(F.lit, ["60", "00", "51"])), (F.col("o_orderkey") % 3 + 1).cast("int")), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0"))).alias("symbol")),
    "SELECT o_orderkey, CAST(floor(o_totalprice * 10000 + 0.5) AS BIGINT) AS fixed, round(o_orderkey / 10000.0::DOUBLE, 6) AS price, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 15 HOUR AS ts, ['60','00','51'][o_orderkey % 3 + 1] || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') || CASE WHEN o_orderkey % 3 = 1 THEN '.SZ' ELSE '.SH' END AS symbol FROM orders")
add("fp01_filter_symbols", lambda s, d: table(s, d, "events").filter(F.col("event_type").isin("click", "purchase") | F.col("event_type").isNull()).groupBy("event_type").agg(F.count("*").alias("n")),
    "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click','purchase') OR event_type IS NULL GROUP BY 1")
add("fp11_latest_value", lambda s, d: rounded(bars_events(s, d).withColumn("v", fx.sma("close", 5)).filter("v is not null").groupBy("symbol").agg(F.max_by("v", "ts").alias("value"))),
    f"WITH {BE}, m AS (SELECT symbol, ts, {sma_sql('close', 5)} AS v FROM be) SELECT symbol, round(arg_max(v, ts), 6) AS value FROM m WHERE v IS NOT NULL GROUP BY 1")

add("ts01_sma", lambda s, d: rounded(bars_orders(s, d).select("symbol", "ts", fx.sma("close", 5).alias("sma_5"), fx.sma("close", 60).alias("sma_60")), 4),
    f"WITH {BO} SELECT symbol, ts, round({sma_sql('close', 5)}, 4) AS sma_5, round({sma_sql('close', 60)}, 4) AS sma_60 FROM bo")


def _ema_sql(n: int, seed: str, cte: str = BE, view: str = "be") -> str:
    a = 2 / (n + 1)
    start = 1 if seed == "first" else n
    return f"""WITH RECURSIVE {cte}, o AS (SELECT *, row_number() OVER ({W}) AS i, avg(close) OVER ({W} ROWS BETWEEN {start - 1} PRECEDING AND CURRENT ROW) AS m FROM {view}),
 y AS (SELECT symbol, ts, i, m AS v FROM o WHERE i = {start} UNION ALL SELECT o.symbol, o.ts, o.i, {a!r} * o.close + (1 - {a!r}) * y.v FROM y JOIN o ON o.symbol = y.symbol AND o.i = y.i + 1)"""


add("ts02_ema_first", lambda s, d: rounded(fx.ema(bars_events(s, d), "close", 20, "ema").select("symbol", "ts", "ema"), 4), _ema_sql(20, "first") + " SELECT symbol, ts, round(v, 4) AS ema FROM y")
add("ts03_ema_sma_seed", lambda s, d: rounded(fx.ema(bars_events(s, d), "close", 10, "ema", "sma").select("symbol", "ts", "ema"), 4),
    _ema_sql(10, "sma") + " SELECT o.symbol, o.ts, round(y.v, 4) AS ema FROM o LEFT JOIN y ON o.symbol = y.symbol AND o.i = y.i")
_RSI = f"""WITH RECURSIVE {BE}, o AS (SELECT *, row_number() OVER ({W}) AS i, close - lag(close) OVER ({W}) AS d FROM be),
 g AS (SELECT symbol, ts, i, greatest(d, 0) AS g, greatest(-d, 0) AS l, avg(greatest(d, 0)) OVER ({W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS mg, avg(greatest(-d, 0)) OVER ({W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS ml FROM o),
 y AS (SELECT symbol, ts, i, mg AS a, ml AS b FROM g WHERE i = 15 UNION ALL SELECT g.symbol, g.ts, g.i, (y.a * 13 + g.g) / 14, (y.b * 13 + g.l) / 14 FROM y JOIN g ON g.symbol = y.symbol AND g.i = y.i + 1)"""
add("ts04_rsi", lambda s, d: rounded(fx.rsi(bars_events(s, d)).select("symbol", "ts", "rsi"), 4),
    _RSI + " SELECT o.symbol, o.ts, round(CASE WHEN y.b = 0 THEN 100 ELSE 100 - 100 / (1 + y.a / y.b) END, 4) AS rsi FROM o LEFT JOIN y ON o.symbol = y.symbol AND o.i = y.i")
add("ts05_rsi_two_point", lambda s, d: rounded(bars_events(s, d).select("symbol", "ts", fx.rsi_two_point().alias("rsi")), 4),
    f"WITH {BE}, o AS (SELECT *, close - lag(close) OVER ({W}) AS a, lag(close, 1) OVER ({W}) - lag(close, 2) OVER ({W}) AS b FROM be), g AS (SELECT *, (greatest(a, 0) + 13 * greatest(b, 0)) / 14 AS g, (greatest(-a, 0) + 13 * greatest(-b, 0)) / 14 AS l FROM o) SELECT symbol, ts, round(CASE WHEN b IS NULL THEN NULL WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END, 4) AS rsi FROM g")
add("ts06_macd", lambda s, d: rounded(fx.macd(bars_events(s, d)).select("symbol", "ts", "macd", "macd_signal", "macd_hist"), 4),
    f"""WITH RECURSIVE {BE}, o AS (SELECT *, row_number() OVER ({W}) AS i, avg(close) OVER {last_n(12)} AS m12, avg(close) OVER {last_n(26)} AS m26 FROM be),
 f AS (SELECT symbol, i, m12 AS v FROM o WHERE i = 12 UNION ALL SELECT o.symbol, o.i, (2/13.0::DOUBLE) * o.close + (1 - 2/13.0::DOUBLE) * f.v FROM f JOIN o ON o.symbol = f.symbol AND o.i = f.i + 1),
 s AS (SELECT symbol, i, m26 AS v FROM o WHERE i = 26 UNION ALL SELECT o.symbol, o.i, (2/27.0::DOUBLE) * o.close + (1 - 2/27.0::DOUBLE) * s.v FROM s JOIN o ON o.symbol = s.symbol AND o.i = s.i + 1),
 m AS (SELECT f.symbol, f.i, f.v - s.v AS macd, avg(f.v - s.v) OVER (PARTITION BY f.symbol ORDER BY f.i ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS m9 FROM f JOIN s ON f.symbol = s.symbol AND f.i = s.i),
 g AS (SELECT symbol, i, m9 AS v FROM m WHERE i = 34 UNION ALL SELECT m.symbol, m.i, 0.2::DOUBLE * m.macd + 0.8::DOUBLE * g.v FROM g JOIN m ON m.symbol = g.symbol AND m.i = g.i + 1)
 SELECT o.symbol, o.ts, round(m.macd, 4) AS macd, round(g.v, 4) AS macd_signal, round(m.macd - g.v, 4) AS macd_hist FROM o LEFT JOIN m ON o.symbol = m.symbol AND o.i = m.i LEFT JOIN g ON o.symbol = g.symbol AND o.i = g.i""")


def _boll(spark, d):
    u, m, low = fx.bollinger()
    return rounded(bars_events(spark, d).select("symbol", "ts", u.alias("upper"), m.alias("middle"), low.alias("lower")), 4)


add("ts07_bollinger", _boll, f"WITH {BE}, m AS (SELECT symbol, ts, count(close) OVER {last_n(20)} AS c, avg(close) OVER {last_n(20)} AS m, stddev_pop(close) OVER {last_n(20)} AS s FROM be) SELECT symbol, ts, CASE WHEN c >= 20 THEN round(m + 2 * s, 4) END AS upper, CASE WHEN c >= 20 THEN round(m, 4) END AS middle, CASE WHEN c >= 20 THEN round(m - 2 * s, 4) END AS lower FROM m")


def _features(spark, d):
    b = bars_orders(spark, d).withColumn("return_1d", fx.pct_change("close", 1))
    b = b.withColumns({"return_5d": fx.pct_change("close", 5), "return_20d": fx.pct_change("close", 20), "volatility": fx.volatility("return_1d", 20), "turnover": fx.turnover_ratio(20), "ma_ratio": fx.ma_ratio(20), "hl": fx.high_low_ratio(), "drawdown": fx.drawdown("close"), "trend": fx.trend_deviation("close", 12), "fwd": fx.forward_return(5), "up": fx.forward_binary(5)})
    return rounded(b.select("symbol", "ts", "return_1d", "return_5d", "return_20d", "volatility", "turnover", "ma_ratio", "hl", "drawdown", "trend", "fwd", "up"))


add("ts08_features", _features, f"""WITH {BO}, r AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS r1 FROM bo)
 SELECT symbol, ts, round(r1, 6) AS return_1d, round(close / lag(close, 5) OVER ({W}) - 1, 6) AS return_5d, round(close / lag(close, 20) OVER ({W}) - 1, 6) AS return_20d,
 round(CASE WHEN count(r1) OVER {last_n(20)} >= 20 THEN stddev_samp(r1) OVER {last_n(20)} END, 6) AS volatility, round(volume / ({sma_sql('volume', 20)}) - 1, 6) AS turnover, round(close / ({sma_sql('close', 20)}), 6) AS ma_ratio,
 round((high - low) / close, 6) AS hl, round(close / max(close) OVER ({W} ROWS UNBOUNDED PRECEDING) - 1, 6) AS drawdown, round((close - ({sma_sql('close', 12)})) / ({sma_sql('close', 12)}) * 100, 6) AS trend,
 round(lead(close, 5) OVER ({W}) / close - 1, 6) AS fwd, CASE WHEN lead(close, 5) OVER ({W}) / close - 1 > 0 THEN 1.0::DOUBLE WHEN lead(close, 5) OVER ({W}) IS NOT NULL THEN 0.0::DOUBLE END AS up FROM r""")
add("ts13_corr", lambda s, d: rounded(bars_orders(s, d).withColumn("r", fx.pct_change()).select("symbol", "ts", fx.rolling_corr("r", "volume", 20).alias("corr")), 4),
    f"WITH {BO}, r AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS r FROM bo) SELECT symbol, ts, round(CASE WHEN count(r) OVER {last_n(20)} >= 20 THEN corr(r, CASE WHEN r IS NOT NULL THEN CAST(volume AS DOUBLE) END) OVER {last_n(20)} END, 4) AS corr FROM r")


def _fill(spark, d):
    b = bars_events(spark, d).withColumn("x", F.when(F.hour("ts") % 3 == 0, F.col("close")))
    b = b.withColumns({"f": fx.ffill("x"), "f1": fx.ffill("x", 1), "b": fx.bfill("x")})
    return rounded(fx.interpolate(b, "x", "i").select("symbol", "ts", "f", "f1", "b", "i"))


add("ts23_fill", _fill, f"""WITH {BE}, x AS (SELECT *, CASE WHEN hour(ts) % 3 = 0 THEN close END AS x, row_number() OVER ({W}) AS n FROM be),
 k AS (SELECT *, CASE WHEN x IS NOT NULL THEN n END AS k FROM x), p AS (SELECT *, last_value(x IGNORE NULLS) OVER a AS f, first_value(x IGNORE NULLS) OVER z AS b, last_value(x IGNORE NULLS) OVER o AS f1, last_value(k IGNORE NULLS) OVER a AS ka, first_value(k IGNORE NULLS) OVER z AS kz FROM k WINDOW a AS ({W} ROWS UNBOUNDED PRECEDING), z AS ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), o AS ({W} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW))
 SELECT symbol, ts, round(f, 6) AS f, round(f1, 6) AS f1, round(b, 6) AS b, round(CASE WHEN x IS NOT NULL THEN x WHEN b IS NULL THEN f ELSE f + (b - f) * (n - ka) / (kz - ka) END, 6) AS i FROM p""")
add("ts20_history", lambda s, d: bars_events(s, d).select("symbol", "ts", F.size(fx.history("close", 30)).cast("long").alias("n"), F.round(F.array_min(fx.history("close", 30)), 6).alias("least")),
    f"WITH {BE} SELECT symbol, ts, count(*) OVER {last_n(30)} AS n, round(min(close) OVER {last_n(30)}, 6) AS least FROM be")
add("ts25_factor_pack", lambda s, d: rounded(fx.factor_pack(bars_events(s, d)).filter("value is not null").groupBy("symbol", "factor").agg(F.count("*").alias("n"), F.avg("value").alias("mean")), 3))


def _signals(spark, d):
    b = bars_events(spark, d).withColumns({"f": fx.sma("close", 5), "s": fx.sma("close", 20)}).filter("s is not null")
    b = b.withColumns({"a": F.col("f") - F.col("s"), "c": F.col("close") - F.col("f")})
    a, c, f, s = F.col("a"), F.col("c"), F.col("f"), F.col("s")
    return rounded(b.select("symbol", "ts", sg.above(f, s).alias("above"), sg.below(f, s).alias("below"), sg.and_(a, c).alias("and_s"), sg.or_(a, c).alias("or_s"), sg.and_bool(a, c).alias("and_b"), sg.or_bool(a, c).alias("or_b"), sg.not_(a).alias("not_s"), sg.threshold_gate(a, 5).alias("gate"), sg.threshold_sign(a, 5).alias("sign"), sg.direction(a)[0].alias("direction"), sg.direction(a)[1].alias("strength")))


add("sg03_signal_algebra", _signals, f"""WITH {BE}, m AS (SELECT symbol, ts, close, {sma_sql('close', 5)} AS f, {sma_sql('close', 20)} AS s FROM be), x AS (SELECT symbol, ts, f, s, f - s AS a, close - f AS c FROM m WHERE s IS NOT NULL)
 SELECT symbol, ts, round(CASE WHEN f > s THEN f - s ELSE 0 END, 6) AS above, round(CASE WHEN f < s THEN s - f ELSE 0 END, 6) AS below,
 round(CASE WHEN a > 0 AND c > 0 THEN least(a, c) WHEN a < 0 AND c < 0 THEN greatest(a, c) ELSE 0 END, 6) AS and_s, round(CASE WHEN greatest(a, c) > 0 THEN greatest(a, c) WHEN least(a, c) < 0 THEN least(a, c) ELSE 0 END, 6) AS or_s,
 CASE WHEN a > 0 AND c > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS and_b, CASE WHEN a > 0 OR c > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS or_b, round(-a, 6) AS not_s, round(CASE WHEN abs(a) >= 5 THEN a ELSE 0 END, 6) AS gate,
 CASE WHEN a > 5 THEN 1.0::DOUBLE WHEN a < -5 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS sign, CASE WHEN a > 0 THEN 'LONG' WHEN a < 0 THEN 'SHORT' ELSE 'EXIT' END AS direction, round(abs(a), 6) AS strength FROM x""")


def _strategies(spark, d):
    e = table(spark, d, "events")
    x = e.groupBy("user_id", F.to_date("ts").alias("ts"), (F.length("event_type") % 4).alias("strategy_no")).agg(F.avg("value").alias("v"))
    v = round_as_sql(F.col("v"), 6)
    return x.select(F.col("ts"), F.col("user_id").alias("symbol"), F.col("strategy_no").cast("int").alias("strategy_no"), (F.col("strategy_no") + 1.0).alias("weight"), F.when(v > 40, "LONG").when(v > 20, "SHORT").otherwise("EXIT").alias("direction"), (v / 100).alias("strength"))


add("sg11_combine_union", lambda s, d: rounded(sg.combine(_strategies(s, d), "union", 4)))
add("sg11_combine_vote", lambda s, d: rounded(sg.combine(_strategies(s, d), "vote", 4)))
add("sg11_combine_weighted", lambda s, d: rounded(sg.combine(_strategies(s, d), "weighted", 4), 9))
add("sg12_combine_layered", lambda s, d: rounded(sg.combine_layered(_strategies(s, d), 4)))
add("sg14_live_signals", lambda s, d: rounded(sg.live_signals(bars_events(s, d).withColumn("f", fx.pct_change()), "f", ["close", "f"]).select("symbol", "ts", F.col("side").cast("long").alias("side"), F.col("quantity").cast("long").alias("quantity"), "confidence", F.element_at("factors", "close").alias("close"))),
    f"WITH {BE}, x AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS f FROM be) SELECT symbol, ts, CAST(CASE WHEN f > 0.001 THEN 1 ELSE -1 END AS BIGINT) AS side, CAST(floor(abs(f) * 100) AS BIGINT) AS quantity, round(abs(f), 6) AS confidence, round(close, 6) AS close FROM x WHERE abs(f) > 0.001")
add("sg15_rsi_ma_combo", lambda s, d: fx.rsi(bars_events(s, d)).withColumns({"sma_5": fx.sma("close", 5), "sma_20": fx.sma("close", 20)}).select("symbol", "ts", sg.rsi_ma_combo().alias("signal")).filter("signal <> 0"))

XU = "xu AS (SELECT user_id AS symbol, CAST(ts AS DATE) AS date, avg(value) AS v FROM events GROUP BY 1, 2)"


def users(spark, d):
    """A user's mean value of a day, added up in the order of events: doubles added in another order would break ties of means, and so ranks."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("symbol"), F.to_date("ts").alias("date"), "event_id", "value")
    so_far = F.sum("value").over(Window.partitionBy("symbol", "date").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = rows.withColumn("sum", so_far).groupBy("symbol", "date").agg(F.max_by("sum", "event_id").alias("sum"), F.count("value").alias("n"))
    return last.select("symbol", "date", F.try_divide("sum", "n").alias("v"))


add("xs01_zscore_rank", lambda s, d: rounded(users(s, d).select("symbol", "date", xs.cs_zscore("v").alias("z"), xs.cs_rank_pct("v").alias("rank"), xs.ts_zscore("v").alias("tz"), xs.ts_rank_pct("v").alias("trank"))),
    f"WITH {XU} SELECT symbol, date, round((v - avg(v) OVER d) / nullif(stddev_samp(v) OVER d, 0), 6) AS z, round((rank() OVER (PARTITION BY date ORDER BY v) + (count(*) OVER (PARTITION BY date, v) - 1) / 2.0::DOUBLE) / count(v) OVER d, 6) AS rank, round((v - avg(v) OVER s) / CASE WHEN stddev_samp(v) OVER s > 0 THEN stddev_samp(v) OVER s ELSE 1 END, 6) AS tz, round((rank() OVER (PARTITION BY symbol ORDER BY v) + (count(*) OVER (PARTITION BY symbol, v) - 1) / 2.0::DOUBLE) / count(v) OVER s, 6) AS trank FROM xu WINDOW d AS (PARTITION BY date), s AS (PARTITION BY symbol)")
add("xs03_winsorize", lambda s, d: rounded(xs.winsorize(users(s, d), "v", 1.5)), f"WITH {XU}, m AS (SELECT avg(v) AS m, stddev_samp(v) AS s FROM xu) SELECT symbol, date, round(least(greatest(v, m - 1.5 * s), m + 1.5 * s), 6) AS v FROM xu, m")
add("xs04_fill_mean", lambda s, d: rounded(xs.fill_mean(users(s, d).withColumn("v", F.when(F.col("symbol") % 3 != 0, F.col("v"))), ["v"])), f"WITH {XU}, n AS (SELECT symbol, date, CASE WHEN symbol % 3 <> 0 THEN v END AS v FROM xu) SELECT symbol, date, round(coalesce(v, (SELECT avg(v) FROM n)), 6) AS v FROM n")


def _pred(spark, d):
    w = Window.partitionBy("symbol").orderBy("date")
    return users(spark, d).withColumn("nxt", F.lead("v").over(w)).filter("nxt is not null")


_IC = f"WITH {XU}, p AS (SELECT *, lead(v) OVER (PARTITION BY symbol ORDER BY date) AS nxt FROM xu), q AS (SELECT * FROM p WHERE nxt IS NOT NULL)"
add("xs08_rank_ic", lambda s, d: rounded(xs.rank_ic(_pred(s, d), "v", "nxt"), 5), _IC + ", r AS (SELECT rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY nxt) + (count(*) OVER (PARTITION BY nxt) - 1) / 2.0::DOUBLE AS b FROM q) SELECT round(corr(a, b), 5) AS rank_ic FROM r")
_ICS = _IC + ", r AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY v) + (count(*) OVER (PARTITION BY date, v) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY date ORDER BY nxt) + (count(*) OVER (PARTITION BY date, nxt) - 1) / 2.0::DOUBLE AS b FROM q), c AS (SELECT date, CASE WHEN count(*) > 2 THEN coalesce(corr(a, b), 0) ELSE 0 END AS ic FROM r GROUP BY 1)"
add("xs09_ic_series", lambda s, d: rounded(xs.ic_series(_pred(s, d), "v", "nxt"), 5), _ICS + " SELECT date, round(ic, 5) AS ic FROM c")
add("xs09_ic_summary", lambda s, d: rounded(xs.ic_summary(xs.ic_series(_pred(s, d), "v", "nxt")), 5), _ICS + " SELECT round(avg(ic), 5) AS ic_mean, round(avg(ic) / stddev_samp(ic), 5) AS ic_ir FROM c")
