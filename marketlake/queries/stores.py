"""Queries over news, factor, symbol, statement and snapshot tables, and over combined signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlake.functions import factors as fx
from marketlake.queries.base import BE, BO, Query, bars_events, bars_orders, rounded, sma_sql, table
from marketlake.sources import tables as st

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def add(name: str, fn: Query, sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        ORACLE[name] = sql


def _news(spark, d):
    t = table(spark, d, "orders").select(F.col("o_orderpriority").alias("headline"), F.col("o_orderkey").cast("string").alias("body"), F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")).otherwise("?").alias("datetime"))
    return st.normalize_news(t, "wire").select("title", "content", "source", "published_at", F.length("news_id").cast("long").alias("id_length"))


add("io14_normalize_news", _news, "SELECT o_orderpriority AS title, CAST(o_orderkey AS VARCHAR) AS content, 'wire' AS source, CASE WHEN o_orderkey % 3 < 2 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS published_at, CAST(64 AS BIGINT) AS id_length FROM orders")


def values(spark, d):
    b = bars_orders(spark, d).withColumns({"sma_5": fx.sma("close", 5), "sma_20": fx.sma("close", 20)})
    return b.select("symbol", F.to_date("ts").alias("date"), "sma_5", "sma_20").unpivot(["symbol", "date"], ["sma_5", "sma_20"], "factor", "value").filter("value is not null")


_V = f"WITH {BO}, w AS (SELECT symbol, CAST(ts AS DATE) AS date, {sma_sql('close', 5)} AS a, {sma_sql('close', 20)} AS b FROM bo), v AS (SELECT symbol, date, 'sma_5' AS factor, a AS value FROM w WHERE a IS NOT NULL UNION ALL SELECT symbol, date, 'sma_20', b FROM w WHERE b IS NOT NULL)"
add("io15_write_factor_values", lambda s, d: rounded(st.write_factor_values(values(s, d), values(s, d).filter("factor = 'sma_5'").withColumn("value", -F.col("value"))), 4), _V + " SELECT symbol, date, factor, round(CASE WHEN factor = 'sma_5' THEN -value ELSE value END, 4) AS value FROM v")
add("io16_factor_series", lambda s, d: rounded(st.factor_series(values(s, d), "1-URGENT", "sma_20", "1996-01-01", "1996-12-31"), 4), _V + " SELECT date, round(value, 4) AS value FROM v WHERE symbol = '1-URGENT' AND factor = 'sma_20' AND date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
add("io20_list_symbols", lambda s, d: st.list_symbols(table(s, d, "customer").select(F.concat(F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.when(F.col("c_custkey") % 2 == 0, ".SH").otherwise(".SZ")).alias("symbol"), F.when(F.col("c_acctbal") > 0, "active").otherwise("halted").alias("status")), table(s, d, "customer").select(F.concat(F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.lit(".SH")).alias("symbol"), F.col("c_name").alias("name")), "active"), "SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0') || CASE WHEN c_custkey % 2 = 0 THEN '.SH' ELSE '.SZ' END AS symbol, CASE WHEN c_custkey % 2 = 0 THEN 'SH' ELSE 'SZ' END AS exchange, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name, 'active' AS status FROM customer WHERE c_acctbal > 0")
add("io23_statements", lambda s, d: rounded(st.statements(table(s, d, "orders").select(F.element_at(F.array(F.lit("income"), F.lit("balance"), F.lit("cashflow")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("report_type"), F.to_date("o_orderdate").alias("period"), F.col("o_custkey").alias("symbol"), F.col("o_totalprice").alias("value")), "balance", "1996-01-01", "1996-12-31"), 4), "SELECT 'balance' AS report_type, CAST(o_orderdate AS DATE) AS period, o_custkey AS symbol, round(o_totalprice, 4) AS value FROM orders WHERE o_orderkey % 3 = 1 AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")


def _snapshots(spark, d):
    old = table(spark, d, "orders").filter("year(o_orderdate) = 1996").select(F.lit("1996-12-31").cast("date").alias("snapshot_date"), F.col("o_custkey").alias("code")).distinct()
    new = table(spark, d, "orders").filter("year(o_orderdate) = 1997").select(F.col("o_custkey").alias("code")).distinct()
    return st.add_snapshot(old, new, F.lit("1997-12-31").cast("date"))


add("io24_snapshots", _snapshots, "SELECT DISTINCT CAST(CASE WHEN year(o_orderdate) = 1996 THEN DATE '1996-12-31' ELSE DATE '1997-12-31' END AS DATE) AS snapshot_date, o_custkey AS code FROM orders WHERE year(o_orderdate) IN (1996, 1997)")
add("bars_daily_vwap", lambda s, d: rounded(bars_events(s, d).groupBy("symbol", F.to_date("ts").alias("date")).agg(F.sum("volume").alias("volume"), (F.sum("amount") / F.sum("volume")).alias("vwap"))), f"WITH {BE} SELECT symbol, CAST(ts AS DATE) AS date, CAST(sum(volume) AS BIGINT) AS volume, round(sum(amount) / sum(volume), 6) AS vwap FROM be GROUP BY 1, 2")

#: Oracles of the combined signals in the market module.
_S = "WITH x AS (SELECT user_id AS symbol, CAST(ts AS DATE) AS ts, CAST(length(event_type) % 4 AS INTEGER) AS n, avg(value) AS v0 FROM events GROUP BY 1, 2, 3), s AS (SELECT symbol, ts, n, n + 1.0::DOUBLE AS w, CASE WHEN round(v0, 6) > 40 THEN 'LONG' WHEN round(v0, 6) > 20 THEN 'SHORT' ELSE 'EXIT' END AS d, round(v0, 6) / 100 AS st FROM x)"
ORACLE["sg11_combine_union"] = _S + " SELECT ts, symbol, arg_min(d, n) AS direction, round(arg_min(st, n), 6) AS strength FROM s GROUP BY 1, 2"
ORACLE["sg11_combine_vote"] = _S + " SELECT ts, symbol, arg_min(d, n) AS direction, round(avg(st), 6) AS strength FROM s GROUP BY 1, 2 HAVING count(*) >= 3"
ORACLE["sg11_combine_weighted"] = _S + " SELECT ts, symbol, arg_max(d, n) AS direction, round(sum(st * w) / (SELECT sum(w) FROM (SELECT DISTINCT n, w FROM s)), 9) AS strength FROM s GROUP BY 1, 2"
ORACLE["sg12_combine_layered"] = _S + ", c AS (SELECT *, row_number() OVER (PARTITION BY n, ts ORDER BY symbol) AS rn FROM s a WHERE n < 2 AND d IN ('LONG', 'SHORT') AND EXISTS (SELECT 1 FROM s b WHERE b.ts = a.ts AND b.symbol = a.symbol AND b.n >= 2 AND b.d IN ('LONG', 'SHORT'))) SELECT ts, symbol, n AS strategy_no, d AS direction, round(st, 6) AS strength FROM c WHERE rn = 1"
