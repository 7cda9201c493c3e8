"""Queries over performance, quality, actions, macro, calendars, joins, sizing, backtests, risk, orders and search."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from marketlake.functions import factors as fx
from marketlake.functions import signals as sg
from marketlake.functions import sizing as ps
from marketlake.operators import actions as ca
from marketlake.operators import backtest as bt
from marketlake.operators import calendar as cal
from marketlake.operators import joins as jn
from marketlake.operators import macro as mc
from marketlake.operators import orders as ox
from marketlake.operators import perf
from marketlake.operators import quality as dq
from marketlake.operators import risk as rk
from marketlake.operators import search as op
from marketlake.queries.base import BE, BO, Query, W, bars_events, bars_orders, rounded, sma_sql, table

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def add(name: str, fn: Query, sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        ORACLE[name] = sql


def nav(spark, d):
    """Daily prices as net asset values, one strategy for each priority."""
    return bars_orders(spark, d).select(F.col("symbol").alias("strategy"), "ts", F.col("close").alias("total_value"), (F.col("close") * 0.9).alias("positions_value"), F.col("volume").alias("positions_count"))


_NAV = f"WITH {BO}, n AS (SELECT symbol AS strategy, ts, close AS v, close * 0.9 AS pv, volume AS pc FROM bo), r AS (SELECT *, v / lag(v) OVER w - 1 AS r, v / max(v) OVER (PARTITION BY strategy ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS dd, abs(pv - lag(pv) OVER w) AS dv, abs(pc - lag(pc) OVER w) AS dc FROM n WINDOW w AS (PARTITION BY strategy ORDER BY ts))"
_REPORT = _NAV + """, a AS (SELECT strategy, count(r) AS n, arg_max(v, ts) / arg_min(v, ts) - 1 AS tr, stddev_samp(r) AS sd, avg(r) AS mean, min(dd) AS mdd, stddev_samp(CASE WHEN r < 0 THEN r END) AS down,
 avg(CASE WHEN r > 0 THEN 1.0::DOUBLE WHEN r IS NOT NULL THEN 0.0::DOUBLE END) AS win, avg(CASE WHEN r > 0 THEN r END) AS gain, abs(avg(CASE WHEN r < 0 THEN r END)) AS loss, sum(dv) / avg(v) AS turn, CAST(coalesce(sum(dc), 0) AS BIGINT) AS trades FROM r GROUP BY 1),
 b AS (SELECT *, pow(1 + tr, 252.0::DOUBLE / n) - 1 AS ar FROM a), bench AS (SELECT arg_max(close, ts) / arg_min(close, ts) - 1 AS br FROM bo WHERE symbol = '1-URGENT')
 SELECT strategy, n, round(tr, 6) AS total_return, round(ar, 6) AS annual_return, round(sd * sqrt(252), 6) AS annual_volatility, round(mdd, 6) AS max_drawdown, round((mean - 0.03 / 252) / sd * sqrt(252), 6) AS sharpe, round((ar - 0.03) / (down * sqrt(252)), 6) AS sortino, round(ar / abs(mdd), 6) AS calmar,
 round(win, 6) AS win_rate, round(gain / loss, 6) AS profit_loss_ratio, round(turn, 6) AS turnover, trades AS total_trades, round(win * n / 252, 6) AS avg_holding_days, round(br, 6) AS benchmark_return, round(tr - br, 6) AS excess_return FROM b, bench"""
add("ag14_performance_report", lambda s, d: rounded(perf.performance_report(nav(s, d), bars_orders(s, d).filter("symbol = '1-URGENT'"))), _REPORT)
add("ts19_drawdown_duration", lambda s, d: perf.drawdown_duration(nav(s, d)), _NAV + ", i AS (SELECT strategy, dd < 0 AS down, row_number() OVER (PARTITION BY strategy ORDER BY ts) AS i FROM r), g AS (SELECT strategy, i - row_number() OVER (PARTITION BY strategy ORDER BY i) AS g FROM i WHERE down) SELECT strategy, max(c) AS drawdown_duration FROM (SELECT strategy, g, count(*) AS c FROM g GROUP BY 1, 2) GROUP BY 1")
add("ag13_monthly_returns", lambda s, d: rounded(perf.monthly_returns(nav(s, d)), 5), _NAV + " SELECT strategy, strftime(ts, '%Y-%m') AS month, round(product(1 + r) - 1, 5) AS monthly_return FROM r WHERE r IS NOT NULL GROUP BY 1, 2")


def _regression(spark, d):
    b = bars_orders(spark, d).withColumn("pred", fx.sma("close", 5)).filter("pred is not null")
    return rounded(perf.regression_metrics(b, "pred", "close"), 4)


add("ag15_regression_metrics", _regression, f"WITH {BO}, p AS (SELECT close, {sma_sql('close', 5)} AS pred FROM bo), e AS (SELECT *, pred - close AS e FROM p WHERE pred IS NOT NULL) SELECT round(avg(e * e), 4) AS mse, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae, round(1 - sum(e * e) / (sum(close * close) - pow(sum(close), 2) / count(close)), 4) AS r2 FROM e")


def _pv(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    p = li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("account"), F.col("l_quantity").alias("quantity"), F.lit(100.0).alias("avg_cost"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    return rounded(perf.portfolio_value(p, table(spark, d, "customer").select(F.col("c_custkey").alias("account"), F.col("c_acctbal").alias("cash"))), 4)


add("ag16_portfolio_value", _pv, "WITH p AS (SELECT o_custkey AS account, sum(l_quantity * (l_extendedprice / l_quantity)) AS mv, sum(l_quantity * (l_extendedprice / l_quantity) - l_quantity * 100.0::DOUBLE) AS u, sum(l_quantity * 100.0::DOUBLE) AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) SELECT c_custkey AS account, round(c_acctbal + coalesce(mv, 0), 4) AS total_value, round(coalesce(u, 0), 4) AS unrealized, round(coalesce(u / c, 0), 4) AS pnl_pct FROM customer LEFT JOIN p ON account = c_custkey")


def _fills(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("price"))
    return rounded(perf.order_fill_summary(table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.lit(100.0).alias("quantity")), li), 10)


add("ag17_order_fills", _fills, "SELECT l_orderkey AS order_id, round(sum(l_quantity), 10) AS filled, round(sum(l_quantity * l_discount), 10) AS amount, round(sum(l_quantity * l_discount) / sum(l_quantity), 10) AS avg_price, CASE WHEN sum(l_quantity) >= 100 THEN 'FILLED' ELSE 'PARTIAL' END AS status FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
add("ag18_histogram", lambda s, d: perf.histogram(table(s, d, "events"), "value", [10.0, 20.0, 50.0, 100.0]).withColumn("bucket", F.col("bucket").cast("long")), "SELECT CAST(CASE WHEN value <= 10 THEN 0 WHEN value <= 20 THEN 1 WHEN value <= 50 THEN 2 WHEN value <= 100 THEN 3 ELSE 4 END AS BIGINT) AS bucket, any_value(CASE WHEN value <= 10 THEN 10.0::DOUBLE WHEN value <= 20 THEN 20.0::DOUBLE WHEN value <= 50 THEN 50.0::DOUBLE WHEN value <= 100 THEN 100.0::DOUBLE END) AS upper, count(*) AS \"count\" FROM events WHERE value IS NOT NULL GROUP BY 1")
add("ag18_histogram_percentile", lambda s, d: rounded(perf.histogram_percentile(perf.histogram(table(s, d, "events"), "value", [10.0, 20.0, 50.0, 100.0]), 0.5)), "WITH c AS (SELECT CASE WHEN value <= 10 THEN 0 WHEN value <= 20 THEN 1 WHEN value <= 50 THEN 2 WHEN value <= 100 THEN 3 ELSE 4 END AS b, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1), h AS (SELECT b, n, sum(n) OVER (ORDER BY b) AS done, [0, 10, 20, 50, 100][b + 1] AS lo, [10, 20, 50, 100, NULL][b + 1] AS hi, (SELECT sum(n) FROM c) * 0.5 AS want FROM c) SELECT round(arg_min(coalesce(lo + (hi - lo) * (want - (done - n)) / n, lo), b), 6) AS value FROM h WHERE done >= want")
add("ag19_pipeline_stats", lambda s, d: rounded(perf.latency_stats(table(s, d, "events"), "event_type", F.col("value")), 5).withColumnRenamed("event_type", "kind"), "SELECT event_type AS kind, count(*) AS events, round(avg(value), 5) AS mean_latency FROM events GROUP BY 1")
add("ag21_factor_entries", lambda s, d: fx.factor_pack(bars_events(s, d)).filter("value is not null").groupBy("factor").agg(F.count("*").alias("entries")), f"WITH {BE}, n AS (SELECT symbol, count(*) AS c FROM be GROUP BY 1), f(factor, w) AS (VALUES ('sma_5', 5), ('sma_10', 10), ('sma_20', 20), ('sma_60', 60), ('ema_10', 10), ('ema_30', 30), ('rsi_14', 15)) SELECT factor, CAST(sum(greatest(c - w + 1, 0)) AS BIGINT) AS entries FROM n, f GROUP BY 1")


def _scored(spark, d):
    return table(spark, d, "labels").withColumn("score", F.round((F.col("doc_id") % 97) / 97, 6))


add("ml05_classification", lambda s, d: rounded(perf.classification_metrics(_scored(s, d), "score", "quality")), "WITH l AS (SELECT quality = 1 AS y, round((doc_id % 97) / 97.0::DOUBLE, 6) AS s FROM labels), b AS (SELECT avg(CASE WHEN (s >= 0.5) = y THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy, count(*) FILTER (s >= 0.5 AND y) / CAST(count(*) FILTER (s >= 0.5) AS DOUBLE) AS precision, count(*) FILTER (s >= 0.5 AND y) / CAST(count(*) FILTER (y) AS DOUBLE) AS recall FROM l), u AS (SELECT sum(CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0.0 END) / count(*) AS auc FROM l p, l n WHERE p.y AND NOT n.y) SELECT round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CAST(auc AS DOUBLE), 6) AS auc FROM b, u")

# quality
_holes = lambda s, d: bars_orders(s, d).withColumn("open", F.when(F.col("volume") % 5 != 0, F.col("open"))).withColumn("high", F.when(F.dayofmonth("ts") == 13, F.col("low") - 1).otherwise(F.col("high")))
_H = f"WITH {BO}, h AS (SELECT symbol, ts, CASE WHEN volume % 5 <> 0 THEN open END AS open, CASE WHEN day(ts) = 13 THEN low - 1 ELSE high END AS high, low, close, volume FROM bo)"
add("dq01_ohlc", lambda s, d: dq.check_ohlc(_holes(s, d)), _H + " SELECT symbol, count(*) FILTER (NOT coalesce(high >= low, false)) AS high_low, count(*) FILTER (NOT coalesce(high >= open, false)) AS high_open, count(*) FILTER (NOT coalesce(high >= close, false)) AS high_close, count(*) FILTER (NOT coalesce(low <= open, false)) AS low_open, count(*) FILTER (NOT coalesce(low <= close, false)) AS low_close FROM h GROUP BY 1")
add("dq02_missing_days", lambda s, d: dq.check_completeness(bars_orders(s, d), cal.trading_days(bars_orders(s, d))), f"WITH {BO}, s AS (SELECT symbol, min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS b FROM bo GROUP BY 1), c AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM bo) SELECT symbol, day FROM s JOIN c ON day BETWEEN a AND b EXCEPT SELECT symbol, CAST(ts AS DATE) FROM bo")
add("dq03_nulls", lambda s, d: rounded(dq.check_nulls(_holes(s, d), ["open", "close"])), _H + ", r AS (SELECT symbol, greatest(avg(CASE WHEN open IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), avg(CASE WHEN close IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS m FROM h GROUP BY 1) SELECT symbol, round(m, 6) AS max_null_ratio, CASE WHEN m > 0.2 THEN 'ERROR' WHEN m > 0.05 THEN 'WARNING' ELSE 'PASS' END AS level FROM r")
_Z = ", z AS (SELECT *, greatest(coalesce(abs((close - avg(close) OVER s) / nullif(stddev_samp(close) OVER s, 0)), 0), coalesce(abs((volume - avg(volume) OVER s) / nullif(stddev_samp(volume) OVER s, 0)), 0)) AS z FROM {v} WINDOW s AS (PARTITION BY symbol))"
add("dq04_outliers", lambda s, d: dq.check_outliers(bars_orders(s, d), ["close", "volume"]), f"WITH {BO}" + _Z.format(v="bo") + " SELECT symbol, count(*) FILTER (z > 3) AS outliers, count(*) AS n, CASE WHEN count(*) FILTER (z > 3) > 0.01 * count(*) THEN 'WARNING' ELSE 'PASS' END AS level FROM z GROUP BY 1")
add("dq05_report", lambda s, d: rounded(dq.quality_report(_holes(s, d), ["open", "close"])))
add("dq06_zscore_anomalies", lambda s, d: rounded(bars_orders(s, d).withColumn("z", dq.max_abs_z(["close", "volume"])).filter("z > 3").select("symbol", "ts", "z"), 5), f"WITH {BO}" + _Z.format(v="bo") + " SELECT symbol, ts, round(z, 5) AS z FROM z WHERE z > 3")
add("dq07_iqr_anomalies", lambda s, d: rounded(dq.anomalies_iqr(bars_orders(s, d), ["close", "volume"]).filter("anomaly").select("symbol", "ts", "close"), 4), f"WITH {BO}, q AS (SELECT symbol, quantile_cont(close, 0.25) AS a, quantile_cont(close, 0.75) AS b, quantile_cont(volume, 0.25) AS c, quantile_cont(volume, 0.75) AS e FROM bo GROUP BY 1) SELECT symbol, ts, round(close, 4) AS close FROM bo JOIN q USING (symbol) WHERE close < a - 1.5 * (b - a) OR close > b + 1.5 * (b - a) OR volume < c - 1.5 * (e - c) OR volume > e + 1.5 * (e - c)")
add("dq08_gate", lambda s, d: dq.gate(_holes(s, d), dq.check_nulls(_holes(s, d), ["open"]).withColumn("level", F.when(F.col("symbol") == "2-HIGH", "ERROR").otherwise("PASS"))).groupBy("symbol").agg(F.count("*").alias("n")), _H + " SELECT symbol, count(*) AS n FROM h WHERE symbol <> '2-HIGH' GROUP BY 1")


# corporate actions on shipping prices
def bars_ship(spark, d):
    li = table(spark, d, "lineitem")
    b = li.groupBy(F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.date_trunc("DAY", "l_shipdate").cast("timestamp_ntz").alias("ts"))
    p = F.col("l_extendedprice") / F.col("l_quantity")
    return b.agg(F.min(p).alias("low"), F.max(p).alias("high"), F.avg(p).alias("close"), F.first(F.lit(1.0)).alias("open"), F.sum("l_quantity").alias("volume"))


BS = "bs AS (SELECT l_returnflag || l_linestatus AS symbol, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS ts, min(l_extendedprice / l_quantity) AS low, max(l_extendedprice / l_quantity) AS high, avg(l_extendedprice / l_quantity) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2)"


def plans(spark, d):
    """A dividend plan on the third and a bonus on the twentieth of each month with bars."""
    b = bars_ship(spark, d).filter(F.dayofmonth("ts").isin(3, 20))
    return b.select("symbol", F.date_add(F.to_date("ts"), 2).alias("action_date"), F.when(F.dayofmonth("ts") == 3, 20.0).otherwise(0.0).alias("dividend10"), F.when(F.dayofmonth("ts") == 20, 1.0).otherwise(0.0).alias("bonus10"))


_ACTS = f"WITH {BS}, p AS (SELECT symbol, CAST(CAST(ts AS DATE) + 2 AS DATE) AS action_date, CASE WHEN day(ts) = 3 THEN 20.0::DOUBLE ELSE 0 END AS dividend10, CASE WHEN day(ts) = 20 THEN 1.0::DOUBLE ELSE 0 END AS bonus10 FROM bs WHERE day(ts) IN (3, 20)), s AS (SELECT p.*, (SELECT arg_max(close, ts) FROM bs WHERE bs.symbol = p.symbol AND CAST(bs.ts AS DATE) BETWEEN p.action_date - 9 AND p.action_date) AS c FROM p), a AS (SELECT symbol, action_date, 'dividend' AS type, dividend10 / 10 AS value, least(greatest(c / (c - dividend10 / 10), 1), 1.5) AS f FROM s WHERE dividend10 > 0 UNION ALL SELECT symbol, action_date, 'split', bonus10 / 10, 1 + bonus10 / 10 FROM s WHERE bonus10 > 0)"
add("jn02_asof_price", lambda s, d: rounded(ca.asof_price(plans(s, d), bars_ship(s, d)), 5), _ACTS + " SELECT symbol, action_date, dividend10, bonus10, round(c, 5) AS asof_close FROM s")
add("ca02_derive_actions", lambda s, d: rounded(ca.derive_actions(plans(s, d), bars_ship(s, d))), _ACTS + " SELECT symbol, action_date, type, round(value, 6) AS value, round(f, 6) AS adjust_factor FROM a")
add("ca03_adjust_backward", lambda s, d: rounded(ca.adjust_prices(bars_ship(s, d), ca.derive_actions(plans(s, d), bars_ship(s, d))).select("symbol", "ts", "close"), 4), _ACTS + " SELECT b.symbol, b.ts, round(b.close / coalesce((SELECT product(f) FROM a WHERE a.symbol = b.symbol AND a.action_date > CAST(b.ts AS DATE)), 1), 4) AS close FROM bs b")
add("ca01_actions_range", lambda s, d: rounded(ca.actions_in_range(ca.derive_actions(plans(s, d), bars_ship(s, d)), "AF", "1996-01-01", "1997-01-01")), _ACTS + " SELECT symbol, action_date, type, round(value, 6) AS value, round(f, 6) AS adjust_factor FROM a WHERE symbol = 'AF' AND action_date BETWEEN DATE '1996-01-01' AND DATE '1997-01-01'")


# macro series: monthly totals of each priority
def macro(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.trunc("o_orderdate", "MM").alias("date")).agg(F.sum("o_totalprice").alias("value"))


_M = "WITH m AS (SELECT o_orderpriority AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2)"
_MW = "OVER (PARTITION BY series ORDER BY date)"
add("ts16_macro_changes", lambda s, d: rounded(macro(s, d).select("series", "date", mc.mom().alias("mom"), mc.yoy().alias("yoy"), fx.sma("value", 3, "series", "date").alias("mean3"), fx.trend_deviation("value", 12, "series", "date").alias("trend")), 4),
    _M + f" SELECT series, date, round((value / lag(value) {_MW} - 1) * 100, 4) AS mom, round((value / lag(value, 12) {_MW} - 1) * 100, 4) AS yoy, CASE WHEN row_number() {_MW} >= 3 THEN round(avg(value) OVER (PARTITION BY series ORDER BY date ROWS 2 PRECEDING), 4) END AS mean3, CASE WHEN row_number() {_MW} >= 12 THEN round((value - avg(value) OVER t) / avg(value) OVER t * 100, 4) END AS trend FROM m WINDOW t AS (PARTITION BY series ORDER BY date ROWS 11 PRECEDING)")
add("ts17_rebase", lambda s, d: rounded(mc.rebase(macro(s, d), "1996-01-01"), 4), _M + ", b AS (SELECT series, arg_min(value, date) AS b FROM m WHERE date >= DATE '1996-01-01' GROUP BY 1) SELECT series, date, round(value / b * 100, 4) AS rebased FROM m JOIN b USING (series)")
_MZ = _M + ", z AS (SELECT series, date, (value - avg(value) OVER s) / stddev_samp(value) OVER s AS z FROM m WINDOW s AS (PARTITION BY series))"
add("xs06_leading_indicator", lambda s, d: rounded(mc.leading_indicator(macro(s, d)), 5), _MZ + " SELECT date, round(avg(z), 5) AS indicator FROM z GROUP BY 1")
add("xs07_regime", lambda s, d: mc.classify_regime(macro(s, d), "1-URGENT", "2-HIGH", "5-LOW"), _MZ + " SELECT g.date, CASE WHEN g.z > 0 AND i.z < 0.5 THEN 'expansion' WHEN g.z > 0 THEN 'overheating' WHEN i.z >= 0.5 THEN 'stagflation' ELSE 'recession' END AS regime FROM z g JOIN z i ON g.date = i.date AND i.series = '2-HIGH' JOIN z a ON g.date = a.date AND a.series = '5-LOW' WHERE g.series = '1-URGENT'")
add("jn05_align_macro", lambda s, d: rounded(mc.align(macro(s, d), ["1-URGENT", "2-HIGH"]), 4), _M + " SELECT date, round(a.value, 4) AS \"1-URGENT\", round(b.value, 4) AS \"2-HIGH\" FROM (SELECT * FROM m WHERE series = '1-URGENT') a JOIN (SELECT * FROM m WHERE series = '2-HIGH') b USING (date)")
add("fp12_calendar", lambda s, d: mc.calendar_within(table(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"), F.col("o_orderstatus").alias("country")), F.lit("1997-03-01").cast("date"), 7, "F"), "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, o_orderstatus AS country FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-03-01' AND DATE '1997-03-08' AND o_orderstatus = 'F'")

# calendar and joins
add("ts26_trading_days", lambda s, d: cal.neighbours(cal.trading_days(bars_orders(s, d))).withColumn("number", F.col("number").cast("long")), f"WITH {BO}, t AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM bo) SELECT day, lag(day) OVER (ORDER BY day) AS prev_day, lead(day) OVER (ORDER BY day) AS next_day, row_number() OVER (ORDER BY day) AS number FROM t")
add("fp08_market_phase", lambda s, d: table(s, d, "events").select("event_id", cal.market_phase(F.col("ts"), F.dayofweek("ts").between(2, 6)).alias("phase"), cal.within_trading_hours(F.col("ts")).alias("open")), "WITH m AS (SELECT event_id, hour(ts) * 60 + minute(ts) AS m, isodow(ts) <= 5 AS t FROM events) SELECT event_id, CASE WHEN NOT t THEN 'Closed' WHEN m >= 900 THEN 'AfterHours' WHEN m >= 897 THEN 'ClosingAuction' WHEN m >= 780 THEN 'Afternoon' WHEN m >= 690 THEN 'Noon' WHEN m >= 570 THEN 'Morning' WHEN m >= 565 THEN 'PreContinuous' WHEN m >= 555 THEN 'CallAuction' ELSE 'PreOpen' END AS phase, m BETWEEN 570 AND 900 AS open FROM m")
add("jn04_constituents", lambda s, d: jn.constituent_diff(table(s, d, "orders").select(F.year("o_orderdate").cast("string").alias("snapshot"), F.col("o_custkey").alias("code")), "1996", "1997"), "WITH m AS (SELECT DISTINCT year(o_orderdate) AS y, o_custkey AS code FROM orders) SELECT 'added' AS change, code FROM (SELECT code FROM m WHERE y = 1997 EXCEPT SELECT code FROM m WHERE y = 1996) UNION ALL SELECT 'removed', code FROM (SELECT code FROM m WHERE y = 1996 EXCEPT SELECT code FROM m WHERE y = 1997)")
add("jn06_align_calendar", lambda s, d: rounded(jn.dense_calendar(bars_events(s, d).select("symbol", "ts", "close"))), f"WITH {BE} SELECT symbol, ts, round(close, 6) AS close FROM (SELECT DISTINCT ts FROM be) CROSS JOIN (SELECT DISTINCT symbol FROM be) LEFT JOIN be USING (symbol, ts)")


def _overlay(spark, d):
    b = bars_events(spark, d).select("symbol", "ts", "close")
    return rounded(jn.overlay(b, b.filter(F.hour("ts") < 6).withColumn("close", -F.col("close")), ["symbol", "ts"]))


add("jn07_overlay", _overlay, f"WITH {BE} SELECT symbol, ts, round(CASE WHEN hour(ts) < 6 THEN -close ELSE close END, 6) AS close FROM be")
add("jn08_industry", lambda s, d: jn.industry_of(table(s, d, "customer").select(F.col("c_custkey").alias("symbol"), F.col("c_nationkey").alias("level")), table(s, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("symbol"), F.col("c_mktsegment").alias("industry")), table(s, d, "nation").select(F.col("n_nationkey").alias("level"), F.col("n_name").alias("industry"))), "SELECT c_custkey AS symbol, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE n_name END AS industry FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
add("jn09_confirmed", lambda s, d: jn.confirmed(table(s, d, "events").filter("value > 50").select("event_id", "user_id"), table(s, d, "events").filter("event_type = 'purchase'"), ["user_id"]), "SELECT event_id, user_id FROM events WHERE value > 50 AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')")

# sizing
_sized = lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("symbol"), F.col("c_nationkey").alias("g"), F.when(F.col("c_custkey") % 4 != 0, (F.col("c_custkey") % 7 - 3) / 3.0).alias("signal"), (F.col("c_custkey") % 10 / 20.0).alias("vol"), F.greatest("c_acctbal", F.lit(1.0)).alias("price"))


def _sizes(spark, d):
    c, cash = _sized(spark, d), F.lit(1000000.0)
    return rounded(c.select("symbol", ps.equal_weight("g", cash).alias("equal"), ps.risk_parity("g", cash, "vol").alias("parity"), ps.kelly(cash, F.lit(None).cast("double"), F.lit(2.0)).alias("kelly"), ps.target_vol("g", cash, "vol").alias("target"), ps.to_lots(ps.equal_weight("g", cash), F.col("price")).alias("lots")), 4)


add("ps01_position_sizes", _sizes, """WITH c AS (SELECT c_custkey AS symbol, c_nationkey AS g, CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey % 7 - 3) / 3.0::DOUBLE END AS s, c_custkey % 10 / 20.0::DOUBLE AS vol, greatest(c_acctbal, 1) AS price FROM customer),
 a AS (SELECT *, coalesce(s <> 0, false) AS act, least(abs(s), 1) AS st, 1 / greatest(vol, 0.01) AS inv FROM c), n AS (SELECT *, sum(CASE WHEN act THEN 1 ELSE 0 END) OVER (PARTITION BY g) AS n, sum(CASE WHEN act THEN inv END) OVER (PARTITION BY g) AS t FROM a)
 SELECT symbol, round(CASE WHEN act THEN 1e6 / n * st ELSE 0 END, 4) AS equal, round(CASE WHEN act THEN 1e6 * inv / t ELSE 0 END, 4) AS parity, round(CASE WHEN act THEN 1e6 * ((0.55::DOUBLE * 2 - (1 - 0.55::DOUBLE)) / 2) * 0.25 * st ELSE 0 END, 4) AS kelly,
 round(CASE WHEN act THEN 1e6 / n * least(coalesce(0.15 / nullif(vol, 0), 1), 1) * st ELSE 0 END, 4) AS target, CAST(floor(CASE WHEN act THEN 1e6 / n * st ELSE 0 END / price / 100) * 100 AS BIGINT) AS lots FROM n""")


# backtests
def _cross_bars(spark, d):
    b = bars_events(spark, d).withColumns({"f": fx.sma("close", 5), "s": fx.sma("close", 20)})
    return b.withColumn("signal", sg.ma_cross("f", "s"))


add("bt06_backtest_single", lambda s, d: rounded(bt.backtest_single(_cross_bars(s, d), "signal", ["symbol"]), 3), f"""WITH RECURSIVE {BE}, m AS (SELECT symbol, ts, close, {sma_sql('close', 5)} AS f, {sma_sql('close', 20)} AS s FROM be), x AS (SELECT *, lag(f) OVER ({W}) AS pf, lag(s) OVER ({W}) AS p FROM m),
 g AS (SELECT symbol, ts, close, CASE WHEN pf <= p AND f > s THEN 1 WHEN pf >= p AND f < s THEN -1 ELSE 0 END AS sig FROM x), e AS (SELECT *, row_number() OVER ({W}) AS i FROM g WHERE sig <> 0 AND close > 0),
 st AS (SELECT DISTINCT symbol, CAST(0 AS BIGINT) AS i, 1e6::DOUBLE AS cash, 0::BIGINT AS pos FROM be UNION ALL SELECT e.symbol, e.i, CASE WHEN e.sig > 0 THEN st.cash - floor(st.cash * 0.95 / e.close) * e.close ELSE st.cash + st.pos * e.close END, CASE WHEN e.sig > 0 THEN st.pos + CAST(floor(st.cash * 0.95 / e.close) AS BIGINT) ELSE 0 END FROM st JOIN e ON e.symbol = st.symbol AND e.i = st.i + 1),
 n AS (SELECT g.symbol, g.ts, g.close, count(e.i) OVER (PARTITION BY g.symbol ORDER BY g.ts) AS k FROM g LEFT JOIN e ON g.symbol = e.symbol AND g.ts = e.ts)
 SELECT n.symbol, n.ts, round(st.cash, 3) AS cash, st.pos AS position, round(st.cash + st.pos * n.close, 3) AS total_value FROM n JOIN st ON n.symbol = st.symbol AND n.k = st.i""")
add("bt11_backtest_summary", lambda s, d: rounded(perf.performance_report(bt.backtest_single(_cross_bars(s, d), "signal", ["symbol"]).withColumnRenamed("symbol", "strategy"))))


def _portfolio(spark, d):
    b = _cross_bars(spark, d).filter("signal <> 0").withColumn("strategy", F.explode(F.array(F.lit("full"), F.lit("half"))))
    return bt.backtest_portfolio(b.select("strategy", "ts", "symbol", F.when(F.col("signal") > 0, "LONG").otherwise("EXIT").alias("direction"), F.when(F.col("strategy") == "full", 1.0).otherwise(0.5).alias("strength"), "close"))


add("bt07_backtest_portfolio", lambda s, d: rounded(_portfolio(s, d), 4))
add("bt08_mark_to_market", lambda s, d: rounded(bt.mark_to_market(_portfolio(s, d), bars_events(s, d)), 3))


def _bt_orders(spark, d):
    b = bars_orders(spark, d)
    return b.select(F.concat_ws("-", "symbol", F.date_format("ts", "yyyyMMdd")).alias("order_id"), "symbol", "ts", F.when(F.dayofmonth("ts") % 2 == 0, "BUY").otherwise("SELL").alias("side"), (F.col("volume") * 100).alias("quantity"))


add("bt05_make_fills", lambda s, d: rounded(bt.make_fills(_bt_orders(s, d), bars_orders(s, d), cap=0.5), 9), f"""WITH {BO}, b AS (SELECT *, lag(close) OVER ({W}) AS prev FROM bo), o AS (SELECT symbol || '-' || strftime(ts, '%Y%m%d') AS order_id, symbol, ts, CASE WHEN day(ts) % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, volume * 100 AS q, close, volume, (close - coalesce(prev, close)) / coalesce(prev, close) AS ch FROM b),
 p AS (SELECT *, CASE WHEN side = 'BUY' THEN close + close * 0.001 ELSE close - close * 0.001 END AS price FROM o WHERE NOT (side = 'BUY' AND ch >= 0.1) AND NOT (side = 'SELL' AND ch <= -0.1))
 SELECT order_id, symbol, ts, side, CAST(CASE WHEN floor(volume * 0.5) > 0 THEN least(q, floor(volume * 0.5)) ELSE q END AS BIGINT) AS quantity, round(price, 9) AS price, round(greatest(price * q * 0.00025, 5) + CASE WHEN side = 'SELL' THEN price * q * 0.001 ELSE 0 END, 9) AS commission FROM p""")


def _batch(spark, d):
    b = bars_events(spark, d).withColumns({f"m{n}": fx.sma("close", n) for n in (5, 10, 20)})
    b = b.withColumns({"a": sg.ma_cross("m5", "m20"), "b": sg.ma_cross("m10", "m20")})
    long = b.select("symbol", "ts", "close", F.explode(F.create_map(F.lit("cross_5_20"), F.col("a"), F.lit("cross_10_20"), F.col("b"))).alias("strategy", "signal"))
    nav = bt.backtest_single(long, "signal", ["strategy", "symbol"])
    return rounded(nav.groupBy("strategy", "symbol").agg(F.max_by("total_value", "ts").alias("final_value"), F.count("*").alias("n")), 3)


add("bt10_batch_backtest", _batch)


# risk
def _risk(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    x = o.join(c, o.o_custkey == c.c_custkey)
    k = F.col("o_orderkey")
    return x.select(k.alias("order_id"), F.col("c_custkey").alias("account"), F.col("o_orderdate").alias("ts"), F.when(k % 3 == 0, "SELL").otherwise("BUY").alias("side"), (k % 200).alias("quantity"), (F.col("o_totalprice") / 100).alias("price"), (F.col("c_acctbal") * 100).alias("equity"), (k % 17 / 100.0).alias("drawdown"), (F.col("c_acctbal") * 20).alias("largest_position"), (F.col("c_acctbal") * 5).alias("held_value"), (F.col("c_acctbal") * 60).alias("positions_value"), (k % 12000).alias("held_quantity"), (k % 10 / 100.0).alias("volatility"))


_R = """WITH x AS (SELECT o_orderkey AS order_id, c_custkey AS account, CASE WHEN o_orderkey % 3 = 0 THEN 0.0::DOUBLE ELSE (o_orderkey % 200) * (o_totalprice / 100) END AS bv, CASE WHEN o_orderkey % 3 = 0 THEN -abs(o_orderkey % 200) ELSE abs(o_orderkey % 200) END AS ch,
 c_acctbal * 100 AS eq, o_orderkey % 17 / 100.0::DOUBLE AS dd, c_acctbal * 20 AS lp, c_acctbal * 5 AS hv, c_acctbal * 60 AS pv, o_orderkey % 12000 AS hq, o_orderkey % 10 / 100.0::DOUBLE AS vol FROM orders JOIN customer ON o_custkey = c_custkey),
 r AS (SELECT *, dd > 0.1 AS r1, CASE WHEN eq > 0 THEN lp > 0.3 * eq OR hv + bv > 0.3 * eq ELSE false END AS r2, CASE WHEN eq > 0 THEN pv + bv > 0.95 * eq ELSE false END AS r3, bv > 500000 OR pv > 5000000 AS r4, abs(abs(hq) + ch) > 10000 AS r5, coalesce(pv / nullif(eq, 0) * vol * 1.65 > 0.05, false) AS r6 FROM x)"""
add("rk12_check_orders", lambda s, d: rk.check_orders(_risk(s, d), rk.default_rules()).select("order_id", F.array_join("violations", ",").alias("violations"), "approved"), _R + " SELECT order_id, concat_ws(',', CASE WHEN r1 THEN 'MaxDrawdown' END, CASE WHEN r2 THEN 'Concentration' END, CASE WHEN r3 THEN 'Exposure' END, CASE WHEN r4 THEN 'Limit' END, CASE WHEN r5 THEN 'MaxPositionSize' END, CASE WHEN r6 THEN 'PortfolioRisk' END) AS violations, NOT (r1 OR r2 OR r3 OR r4 OR r5 OR r6) AS approved FROM r")
add("rk08_pre_trade", lambda s, d: _risk(s, d).select("order_id", rk.pre_trade_check().alias("failed")), _R + " SELECT order_id, CASE WHEN r1 THEN 'drawdown' WHEN r2 THEN 'concentration' WHEN r3 THEN 'exposure' WHEN bv > 500000 THEN 'order_value' END AS failed FROM r")
add("rk06_order_rate", lambda s, d: table(s, d, "events").select("event_id", F.col("user_id").alias("account"), "ts").select("event_id", rk.order_rate(seconds=86400).alias("orders")), "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts)) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS orders FROM events")
add("rk10_simple_check", lambda s, d: _risk(s, d).select("order_id", F.array_join(rk.simple_order_check(F.col("equity"))[0], ",").alias("violations"), rk.simple_order_check(F.col("equity"))[1].alias("level")), "WITH x AS (SELECT o_orderkey AS order_id, o_orderkey % 3 <> 0 AS buy, o_orderkey % 200 AS q, o_totalprice / 100 AS p, c_acctbal * 100 AS eq FROM orders JOIN customer ON o_custkey = c_custkey), v AS (SELECT order_id, concat_ws(',', CASE WHEN p * q > 500000 THEN 'order_value' END, CASE WHEN buy AND p * q / nullif(eq, 0) > 0.3 THEN 'buy_ratio' END, CASE WHEN p <= 0 OR q <= 0 THEN 'invalid' END) AS violations FROM x) SELECT order_id, violations, CASE WHEN violations <> '' THEN 'HIGH' ELSE 'LOW' END AS level FROM v")
add("rk11_portfolio_check", lambda s, d: rounded(rk.portfolio_check(nav(s, d)).withColumn("severity", rk.alert_severity(F.col("level")))), _NAV + ", l AS (SELECT strategy, -arg_max(dd, ts) AS dd FROM r GROUP BY 1) SELECT strategy, round(dd, 6) AS drawdown, CASE WHEN dd > 0.1 THEN 'HIGH' WHEN dd > 0.08 THEN 'MEDIUM' ELSE 'LOW' END AS level, CASE WHEN dd > 0.1 THEN 'CRITICAL' WHEN dd > 0.08 THEN 'WARNING' ELSE 'INFO' END AS severity FROM l")
add("rk13_circuit_breaker", lambda s, d: rk.circuit_breaker(rk.check_orders(_risk(s, d), rk.default_rules()), cooldown=86400.0 * 30).groupBy("account").agg(F.count_if("broken").alias("broken"), F.count_if("final").alias("approved")))

# orders
add("ox01_validate", lambda s, d: ox.validate_orders(table(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 5 - 1).alias("quantity"), F.when(F.col("o_orderkey") % 7 == 0, "").otherwise("x").alias("symbol"))).select("o_orderkey", "reason"), "SELECT o_orderkey, CASE WHEN o_orderkey % 5 - 1 <= 0 THEN 'quantity' WHEN o_orderkey % 7 = 0 THEN 'symbol' END AS reason FROM orders")
_statuses = ["PENDING_NEW", "NEW", "PARTIAL", "FILLED", "PENDING_CANCEL", "CANCELLED"]
_oe = lambda s, d: table(s, d, "events").select(F.col("user_id").alias("order_id"), F.col("event_id").alias("seq"), F.element_at(F.array(*map(F.lit, _statuses)), ((F.col("event_id") * 7 + F.col("user_id")) % 6 + 1).cast("int")).alias("status"))
_OE = f"WITH e AS (SELECT user_id AS order_id, event_id AS seq, {_statuses!r}[(event_id * 7 + user_id) % 6 + 1] AS status FROM events)"
add("ox02_invalid_transitions", lambda s, d: ox.invalid_transitions(_oe(s, d)).select("order_id", "seq", "before", "status"), _OE + ", b AS (SELECT *, lag(status) OVER (PARTITION BY order_id ORDER BY seq) AS before FROM e) SELECT order_id, seq, before, status FROM b WHERE before IS NOT NULL AND NOT ((before = 'PENDING_NEW' AND status IN ('NEW', 'REJECTED')) OR (before = 'NEW' AND status IN ('PARTIAL', 'FILLED', 'PENDING_CANCEL', 'EXPIRED', 'SUSPENDED')) OR (before = 'PARTIAL' AND status IN ('FILLED', 'CANCELLED', 'PENDING_CANCEL')) OR (before = 'PENDING_CANCEL' AND status = 'CANCELLED') OR (before = 'SUSPENDED' AND status = 'NEW'))")
add("ox03_current_status", lambda s, d: ox.current_status(_oe(s, d)), _OE + " SELECT order_id, arg_max(status, seq) AS status FROM e GROUP BY 1")
_parents = lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderpriority").alias("symbol"), F.round("o_totalprice").cast("long").alias("quantity"), F.col("o_orderdate").cast("timestamp_ntz").alias("start"), (F.col("o_orderkey") % 400).alias("duration"))
_P = "WITH p AS (SELECT o_orderkey AS order_id, o_orderpriority AS symbol, CAST(round(o_totalprice) AS BIGINT) AS q, CAST(o_orderdate AS TIMESTAMP) AS s, o_orderkey % 400 AS d FROM orders)"
add("ox04_twap", lambda s, d: ox.twap_schedule(_parents(s, d)).withColumn("slice", F.col("slice").cast("long")), _P + ", x AS (SELECT *, unnest(generate_series(1, CAST(ceil(d / 30.0) AS BIGINT))) AS slice FROM p WHERE d > 0), t AS (SELECT *, floor(q * least(1.0::DOUBLE, slice * 30 / CAST(d AS DOUBLE))) AS t FROM x) SELECT order_id, slice, s + to_seconds(slice * 30) AS ts, CAST(greatest(t - coalesce(lag(t) OVER (PARTITION BY order_id ORDER BY slice), 0), 0) AS BIGINT) AS quantity FROM t UNION ALL SELECT order_id, 1, s, CAST(greatest(floor(q / 10.0::DOUBLE), 1) AS BIGINT) FROM p WHERE d <= 0")
_prof = lambda s, d: ox.volume_profile(bars_events(s, d), F.hour("ts"))
_PROF = f", {BE}, v AS (SELECT hour(ts) AS bucket, sum(volume) AS v FROM be GROUP BY 1), w AS (SELECT bucket, v / CAST(sum(v) OVER () AS DOUBLE) AS w FROM v)"
add("ox05_vwap", lambda s, d: ox.vwap_schedule(_parents(s, d), _prof(s, d)).withColumn("bucket", F.col("bucket").cast("long")), _P + _PROF + ", x AS (SELECT order_id, bucket, q, greatest(floor(q * w), 1) AS want FROM p, w) SELECT order_id, bucket, CAST(least(want, greatest(q - (sum(want) OVER (PARTITION BY order_id ORDER BY bucket) - want), 0)) AS BIGINT) AS quantity FROM x")
add("ox06_pov", lambda s, d: ox.pov_schedule(_parents(s, d).withColumn("quantity", F.col("quantity") % 50), bars_orders(s, d), 0.5), _P + f", {BO}, x AS (SELECT order_id, ts, q % 50 AS q, greatest(floor(volume * 0.5), 1) AS want FROM p JOIN bo USING (symbol) WHERE ts >= s), y AS (SELECT order_id, ts, least(want, greatest(q - (sum(want) OVER (PARTITION BY order_id ORDER BY ts) - want), 0)) AS take FROM x) SELECT order_id, ts, CAST(take AS BIGINT) AS quantity FROM y WHERE take > 0")


# search
def _grid(spark, b):
    """The bars with the crosses of each pair of periods."""
    grid = op.param_grid(spark, {"fast": op.range_values(3, 7, 2), "slow": op.range_values(values=[10, 20])})
    b = b.withColumns({f"m{n}": fx.sma("close", n) for n in (3, 5, 7, 10, 20)})
    pick = lambda c: F.element_at(F.create_map(*[x for n in (3, 5, 7, 10, 20) for x in (F.lit(float(n)), F.col(f"m{n}"))]), F.col(c))
    x = b.join(F.broadcast(grid), how="cross").withColumns({"f": pick("fast"), "s": pick("slow")})  # parameters are few; each average is computed once
    w = Window.partitionBy("trial", "symbol").orderBy("ts")
    up = F.coalesce((F.lag("f").over(w) <= F.lag("s").over(w)) & (F.col("f") > F.col("s")), F.lit(False))
    down = F.coalesce((F.lag("f").over(w) >= F.lag("s").over(w)) & (F.col("f") < F.col("s")), F.lit(False))
    return x.select("trial", "fast", "slow", "symbol", "ts", "close", F.when(up, 1.0).when(down, -1.0).otherwise(0.0).alias("signal"))


def _walk(spark, d):
    b = bars_orders(spark, d)
    return op.walk_forward_search(_grid(spark, b), cal.trading_days(b), 60, 20, ["fast", "slow"])


add("opt03_grid_search", lambda s, d: rounded(op.best_params(op.grid_search(_grid(s, bars_events(s, d)), ["fast", "slow"])), 3))
add("opt05_walk_forward_search", lambda s, d: rounded(_walk(s, d), 3))
add("opt04_walk_forward", lambda s, d: op.walk_forward(cal.trading_days(bars_orders(s, d)), 60, 20).withColumn("window_id", F.col("window_id").cast("long")), f"WITH {BO}, n AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM bo)) SELECT CAST(a.i // 20 AS BIGINT) AS window_id, a.day AS train_start, b.day AS train_end, c.day AS test_start, e.day AS test_end FROM n a JOIN n b ON b.i = a.i + 59 JOIN n c ON c.i = a.i + 60 JOIN n e ON e.i = a.i + 79 WHERE a.i % 20 = 0")
add("so01_universe_union", lambda s, d: table(s, d, "customer").select(F.col("c_nationkey").alias("code")).union(table(s, d, "supplier").select("s_nationkey")).distinct().orderBy("code"), "SELECT c_nationkey AS code FROM customer UNION SELECT s_nationkey FROM supplier")
add("so03_intersection", lambda s, d: table(s, d, "orders").filter("year(o_orderdate) = 1996").select("o_custkey").intersect(table(s, d, "orders").filter("year(o_orderdate) = 1997").select("o_custkey")), "SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996 INTERSECT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997")
