"""Queries over files, appended and upserted tables, model versions, totals, alerts, streams with fills, and default dictionaries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marketlake.functions import factors as fx
from marketlake.functions import news as nw
from marketlake.operators import actions as ca
from marketlake.operators import backtest as bt
from marketlake.operators import ml
from marketlake.operators import orders as ox
from marketlake.operators import risk as rk
from marketlake.operators import search as op
from marketlake.plans.graph import handle_signals
from marketlake.queries.base import BE, BO, Query, W, bars_events, bars_orders, rounded, sma_sql, table
from marketlake.queries.checks import _CROSS, _FEATURES, _codes, _counted, _search, nav_sql
from marketlake.queries.more import ORACLE as MORE
from marketlake.queries.portfolio import _ACTS, _NAV, _OE, _R, _cross_bars, _oe, _risk, bars_ship, nav, plans
from marketlake.queries.portfolio import ORACLE as PORTFOLIO
from marketlake.queries.text import _D, CONFIGS, _run, docs, events_stream, shared_root, state_store
from marketlake.sources import bars as src
from marketlake.streaming import live

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def add(name: str, fn: Query, sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        ORACLE[name] = sql


def scratch(spark, name):
    return f"{shared_root(spark)}/marketlake-{uuid.uuid4().hex}/{name}"


# files
def _csv_files(spark, d):
    """Daily bars as csv lines, some of them broken, in a folder of files, read again."""
    b = bars_orders(spark, d)
    volume = F.when(F.col("volume") % 7 == 0, "?").otherwise(F.col("volume").cast("string"))
    lines = b.select(F.concat_ws(",", F.lit("600519"), F.date_format("ts", "yyyy-MM-dd"), "open", "high", "low", "close", volume, "amount").alias("value"))
    path = scratch(spark, "bars")
    lines.union(spark.createDataFrame([("symbol,date,open,high,low,close,volume,amount",)], "value string")).write.text(path)
    return src.load_stats(src.read_bars_csv(spark, path)).agg(F.sum("loaded").alias("loaded"), F.sum("failed").alias("failed"))


add("io03_csv_directory", _csv_files, f"WITH {BO} SELECT CAST(count(*) FILTER (volume % 7 <> 0) AS BIGINT) AS loaded, CAST(count(*) FILTER (volume % 7 = 0) AS BIGINT) AS failed FROM bo")


def _parquet_files(spark, d):
    path = scratch(spark, "bars")
    b = bars_events(spark, d)
    b.select(F.concat(F.col("symbol"), F.lit("_SH.parquet")).alias("file"), "ts", F.col("close").alias("Close")).write.partitionBy("file").parquet(path)
    return rounded(src.read_bars_parquet(spark, path).select("symbol", "ts", "close"))


add("io04_parquet_directory", _parquet_files, f"WITH {BE} SELECT symbol || '.SH' AS symbol, ts, round(close, 6) AS close FROM be")


def _export(spark, d):
    path = scratch(spark, "csv")
    src.export_bars_csv(bars_orders(spark, d), path)
    kinds = "date string, open double, high double, low double, close double, volume long, amount double, symbol string"
    return rounded(spark.read.schema(kinds).option("header", True).csv(path).select("symbol", "date", "open", "close", "volume"), 4)


add("io05_export_csv", _export, f"WITH {BO} SELECT symbol, strftime(ts, '%Y-%m-%d') AS date, round(open, 4) AS open, round(close, 4) AS close, volume FROM bo")


def _archive(spark, d):
    path = scratch(spark, "kline")
    src.write_bars(bars_orders(spark, d).withColumn("freq", F.lit("day")), path)
    kept = spark.read.parquet(path).filter("freq = 'day' AND year = 1996 AND symbol = '2-HIGH'")
    return rounded(kept.select("symbol", "ts", "close", "volume"), 4)


add("io18_archive", _archive, f"WITH {BO} SELECT symbol, ts, round(close, 4) AS close, volume FROM bo WHERE symbol = '2-HIGH' AND year(ts) = 1996")


def _append(spark, d):
    path = scratch(spark, "results")
    rows = bars_orders(spark, d).select(F.col("symbol").alias("strategy"), "ts", F.col("close").alias("final_value"))
    src.append_rows(rows.filter("year(ts) < 1997"), path)
    return rounded(src.latest(src.append_rows(rows.filter("year(ts) >= 1997"), path), "strategy", "ts", 3).withColumn("rn", F.col("rn").cast("long")), 4)


add("io19_append_results", _append, f"WITH {BO} SELECT * FROM (SELECT symbol AS strategy, ts, round(close, 4) AS final_value, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bo) WHERE rn <= 3")


def _counters(spark, d):
    parsed = table(spark, d, "events").select("event_id", "value", (F.col("value") > 50).alias("ok"))
    stored, counts = src.store_counted(parsed, scratch(spark, "events"))
    return stored.agg(F.count("*").alias("in_table")).select("in_table", *[F.lit(counts[c]).cast("long").alias(c) for c in ("received", "stored", "failed")])


add("io22_observed_counters", _counters, "SELECT count(*) FILTER (value > 50) AS in_table, count(*) AS received, count(*) FILTER (value > 50) AS stored, count(*) FILTER (NOT value > 50) AS failed FROM events")

# corporate actions
def _forward(spark, d):
    """Forward-adjusted prices, their mean for each symbol and month."""
    b = bars_ship(spark, d)
    adjusted = ca.adjust_prices(b, ca.derive_actions(plans(spark, d), b).filter("year(action_date) < 1993"), "forward")
    return rounded(adjusted.groupBy("symbol", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.avg("close").alias("close"), F.count("*").alias("n")), 5)


add("ca03_adjust_forward", _forward, _ACTS + ", c AS (SELECT b.symbol, b.ts, b.close * coalesce((SELECT product(f) FROM a WHERE a.symbol = b.symbol AND year(a.action_date) < 1993 AND a.action_date <= CAST(b.ts AS DATE)), 1) AS close FROM bs b) SELECT symbol, strftime(ts, '%Y-%m') AS month, round(avg(close), 5) AS close, count(*) AS n FROM c GROUP BY 1, 2")


def _given(spark, d):
    o = table(spark, d, "orders")
    kind = F.element_at(F.array(F.lit("suspension"), F.lit("rights"), F.lit("dividend")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    rows = o.select(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("action_date"), kind.alias("type"), F.col("o_totalprice").alias("value"), F.when(F.col("o_orderkey") % 2 == 0, F.lit(1.25)).alias("adjust_factor"))
    return rounded(ca.given_actions(rows), 4)


add("ca04_given_actions", _given, "SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS action_date, CASE o_orderkey % 3 WHEN 0 THEN 'suspension' ELSE 'rights' END AS type, round(o_totalprice, 4) AS value, CASE WHEN o_orderkey % 2 = 0 THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END AS adjust_factor FROM orders WHERE o_orderkey % 3 < 2")


# models
def _versions(spark, d):
    path = scratch(spark, "models")
    rows = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("version")).agg(F.max("o_orderdate").cast("timestamp_ntz").alias("created"), F.avg("o_totalprice").alias("mse")).withColumn("production", F.lit(False))
    ml.add_version(rows.filter("version < '3'"), None, path)
    every = ml.promote(ml.add_version(rows.filter("version >= '3'"), None, path), "2-HIGH")
    found = ml.latest_version(every).withColumn("which", F.lit("latest")).unionByName(ml.promoted_version(every).withColumn("which", F.lit("promoted")))
    return rounded(found, 4)


add("ml04_versions", _versions, "WITH v AS (SELECT o_orderpriority AS version, CAST(max(o_orderdate) AS TIMESTAMP) AS created, round(avg(o_totalprice), 4) AS mse, o_orderpriority = '2-HIGH' AS production FROM orders GROUP BY 1) SELECT *, 'latest' AS which FROM (SELECT * FROM v ORDER BY created DESC, version DESC LIMIT 1) UNION ALL SELECT *, 'promoted' FROM v WHERE production")
add("ml05_decile_summary", lambda s, d: rounded(ml.decile_summary(ml.decile_returns(ml.build_features(bars_orders(s, d), CONFIGS), "return_5d", "label")), 4), _FEATURES + ", dt AS (SELECT label, ntile(10) OVER (PARTITION BY date ORDER BY return_5d, label) AS decile FROM ft WHERE return_5d IS NOT NULL AND label IS NOT NULL), m AS (SELECT decile, avg(label) AS r FROM dt GROUP BY 1), u AS (SELECT *, (r > lag(r) OVER (ORDER BY decile))::INT AS up FROM m) SELECT round(arg_max(r, decile), 4) AS top_return, round(arg_max(r, decile) - arg_min(r, decile), 4) AS spread, round(avg(up), 4) AS monotonicity FROM u")


# backtests of strategies of which some are bad
def _errors(spark, d):
    strategies = spark.createDataFrame([("a_5_20", 5, 20), ("b_3_10", 3, 10), ("c_20_5", 20, 5), ("d_0_10", 0, 10), ("e_none", None, 10)], "strategy string, fast int, slow int")
    return rounded(bt.batch_backtest(bars_events(spark, d), strategies), 3)


_TWO = f"""WITH RECURSIVE {BE}, m AS (SELECT symbol, ts, close, {', '.join(f"{sma_sql('close', n)} AS m{n}" for n in (3, 5, 10, 20))} FROM be), l AS (SELECT symbol, ts, close, 'a_5_20' AS strategy, m5 AS f, m20 AS s FROM m UNION ALL SELECT symbol, ts, close, 'b_3_10', m3, m10 FROM m),
 x AS (SELECT *, lag(f) OVER w AS pf, lag(s) OVER w AS p FROM l WINDOW w AS (PARTITION BY strategy, symbol ORDER BY ts)), c AS (SELECT strategy, symbol, ts, close, CASE WHEN pf <= p AND f > s THEN 1 WHEN pf >= p AND f < s THEN -1 ELSE 0 END AS sig FROM x), {nav_sql('c', ['strategy', 'symbol'])}"""
add("bt10_batch_errors", _errors, _TWO + " SELECT strategy, symbol, round(arg_max(total_value, ts), 3) AS final_value, count(*) AS n, NULL::VARCHAR AS error FROM nav GROUP BY 1, 2 UNION ALL SELECT * FROM (VALUES ('c_20_5', NULL, NULL, NULL, 'fast period must be below slow'), ('d_0_10', NULL, NULL, NULL, 'period must be positive'), ('e_none', NULL, NULL, NULL, 'period must be positive'))")

# risk and orders
_RULES = ["MaxDrawdown", "Concentration", "Exposure", "Limit", "MaxPositionSize", "PortfolioRisk"]
_EACH = " UNION ALL ".join(f"SELECT '{n}' AS rule, r{i} AS bad FROM r" for i, n in enumerate(_RULES, 1))
add("rk12_totals", lambda s, d: rk.check_totals(rk.check_orders(_risk(s, d), rk.default_rules())), _R + f", e AS ({_EACH} UNION ALL SELECT 'all', r1 OR r2 OR r3 OR r4 OR r5 OR r6 FROM r) SELECT rule, count(*) AS checks, count(*) FILTER (NOT coalesce(bad, false)) AS passed, count(*) FILTER (coalesce(bad, false)) AS breaks FROM e GROUP BY 1")
add("rk14_alerts", lambda s, d: rk.alerts(rk.portfolio_check(nav(s, d))), _NAV + ", l AS (SELECT strategy, -arg_max(dd, ts) AS dd FROM r GROUP BY 1) SELECT strategy, CASE WHEN dd > 0.1 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, printf('drawdown %.4f', dd) AS message FROM l WHERE dd > 0.08")
add("ox03_status_counts", lambda s, d: ox.status_counts(_oe(s, d).withColumn("symbol", F.col("order_id") % 5)), _OE + ", l AS (SELECT order_id % 5 AS symbol, arg_max(status, seq) AS status FROM e GROUP BY order_id) SELECT symbol, status, count(*) AS orders, count(*) FILTER (status NOT IN ('FILLED', 'CANCELLED')) AS active FROM l GROUP BY 1, 2")
add("g02_signal_handler", lambda s, d: rounded(handle_signals(_cross_bars(s, d).select("symbol", "ts", "close", "signal"), {"orders": lambda x: x.select("symbol", "ts", F.when(F.col("signal") > 0, "BUY").otherwise("SELL").alias("side"), "close")})["orders"]), f"WITH {BE}, {_CROSS} SELECT symbol, ts, CASE WHEN sig > 0 THEN 'BUY' ELSE 'SELL' END AS side, round(close, 6) AS close FROM c WHERE sig <> 0")


# streams
def _into(stream, sink, checkpoint):
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _last_write(spark, d):
    """Hourly marks of two streams, one after the other: the later stream's row wins, within a stream the later event's."""
    path, keys = scratch(spark, "marks"), ["symbol", "ts"]
    sink = live.upsert_sink(path, keys, "seq")
    for number, part in enumerate(("event_id % 3 > 0", "event_id % 3 = 0")):
        marks = events_stream(spark, d).filter(part).select("symbol", F.date_trunc("HOUR", "ts").alias("ts"), "price", "seq")
        _into(marks, lambda batch, i, n=number: sink(batch, 1000 * n + i), f"{path}-checkpoint-{number}")
    return rounded(live.current(spark, path, keys).select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "price"))


add("st02_last_write", _last_write, "SELECT event_type AS symbol, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, round(arg_max(value, (event_id % 3 = 0, event_id)), 6) AS price FROM events GROUP BY 1, 2")


def _stored_bars(spark, d):
    path, keys = scratch(spark, "bars"), ["symbol", "ts"]
    with state_store(spark):
        _into(live.windowed_bars(events_stream(spark, d), "1 hour", "0 seconds"), live.upsert_sink(path, keys), f"{path}-checkpoint")
    live.compact(spark, path, f"{path}-compacted", keys)
    return rounded(live.current(spark, f"{path}-compacted", keys).select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "close", "volume"))


add("st01_stored_bars", _stored_bars, f"WITH {BE} SELECT symbol, ts, round(close, 6) AS close, volume FROM be WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events)")


def _recomputed(spark, d):
    """Factors of all symbols, then those of the symbols that a stream touches, over a corrected history."""
    path, keys, bars = scratch(spark, "factors"), ["symbol", "ts"], bars_events(spark, d)
    sink = live.upsert_sink(path, keys)
    compute = lambda b: b.select("symbol", "ts", fx.sma("close", 5).alias("sma_5"))
    sink(compute(bars), 0)
    run = live.recompute(lambda: bars.withColumn("close", F.col("close") + 1), compute, sink)
    _into(events_stream(spark, d).filter("symbol IN ('purchase', 'click')"), lambda batch, i: run(batch, i + 1), f"{path}-checkpoint")
    return rounded(live.current(spark, path, keys))


add("st06_recompute", _recomputed, f"WITH {BE} SELECT symbol, ts, round({sma_sql('close', 5)} + CASE WHEN symbol IN ('purchase', 'click') THEN 1 ELSE 0 END, 6) AS sma_5 FROM be")


def _lifecycle(spark, d):
    e = events_stream(spark, d).withColumn("order_id", F.col("user_id"))
    pick = F.element_at(F.array(*map(F.lit, ["PENDING_NEW", "NEW", "PARTIAL", "FILLED", "PENDING_CANCEL", "CANCELLED"])), ((F.col("event_id") * 7 + F.col("user_id")) % 6 + 1).cast("int"))
    return _run(live.order_lifecycle(e.withColumn("status", pick))).filter("NOT allowed").drop("allowed")


add("st09_lifecycle", _lifecycle, PORTFOLIO["ox02_invalid_transitions"])


def _fills(spark, d):
    root = scratch(spark, "chain")
    with state_store(spark):
        live.chain(events_stream(spark, d).withColumnRenamed("price", "close"), root, f"{root}-checkpoint", lambda s: s.withColumn("approved", F.col("close") < 100), sequence="seq").awaitTermination()
    fills = live.chain_tables(spark, root, "seq")["fills"]
    return rounded(fills.groupBy("symbol", "side").agg(F.count("*").alias("n"), F.sum("price").alias("price"), F.sum("commission").alias("commission")), 4)


add("st10_live_fills", _fills, MORE["st05_live_signals"].replace("SELECT symbol, ts, ", "SELECT symbol, ts, close, ").replace("SELECT symbol, CASE", ", z AS (SELECT symbol, close, CASE").replace("count(*) AS n FROM x", "FROM x").replace("AS side,", "AS side").replace(" GROUP BY 1, 2", " ) SELECT symbol, side, count(*) AS n, round(sum(p), 4) AS price, round(sum(greatest(p * 0.00025, 5) + CASE WHEN side = 'SELL' THEN p * 0.001 ELSE 0 END), 4) AS commission FROM (SELECT *, CASE side WHEN 'BUY' THEN close + close * 0.001 ELSE close - close * 0.001 END AS p FROM z WHERE close < 100) GROUP BY 1, 2"))

# news with the library's own dictionaries: words of them behind the invented prose
_WORDS = sorted({w for words in nw.KEYWORDS.values() for w in words} | set(nw.NAMES))


def _default_news(spark, d):
    words = F.array(*map(F.lit, _WORDS))
    word = lambda k: F.element_at(words, (F.col("news_id") * k % len(_WORDS) + 1).cast("int"))
    n = docs(spark, d).withColumn("content", F.concat_ws(" ", "content", word(1), word(7), word(31)))
    return rounded(nw.tag_news(n).select("news_id", F.array_join("symbols", ",").alias("symbols"), F.array_join("tags", ",").alias("tags"), "importance"))


_LIST = "[" + ", ".join(f"'{w}'" for w in _WORDS) + "]"
_N = _D + f", n0 AS (SELECT * FROM n), n1 AS (SELECT news_id, title, concat_ws(' ', content, {', '.join(f'{_LIST}[news_id * {k} % {len(_WORDS)} + 1]' for k in (1, 7, 31))}) AS content FROM n0)"
_LOWER = {t: [w.lower() for w in words] for t, words in nw.KEYWORDS.items()}
_CASES = " ".join(f"WHEN '{t}' THEN {v}::DOUBLE" for t, v in nw.IMPORTANCE.items())
_TEXT = "concat_ws(' ', title, content)"
add("nw11_default_dictionaries", _default_news, _N + f", {_counted(_LOWER, _TEXT)}, {_codes(_TEXT, nw.NAMES)}, tg AS (SELECT news_id, coalesce(string_agg(k, ',' ORDER BY c DESC, o) FILTER (c > 0), 'other') AS tags FROM ty GROUP BY 1) SELECT news_id, coalesce(array_to_string(s, ','), '') AS symbols, tags, CASE split_part(tags, chr(44), 1) {_CASES} ELSE 0.3::DOUBLE END AS importance FROM tg JOIN sy USING (news_id)".replace("FROM n)", "FROM n1)").replace("FROM n WHERE", "FROM n1 WHERE").replace("FROM n LEFT", "FROM n1 n LEFT").replace("FROM n),", "FROM n1),"))


def _codes_in_texts(spark, d):
    t = F.concat_ws(" ", "text", F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit("600519.SH"), F.concat(F.lit("4"), F.lpad(F.col("n_chars").cast("string"), 5, "0")), F.lit("777777"))
    return table(spark, d, "documents").select("doc_id", F.array_join(nw.extract_codes(t), ",").alias("codes"))


add("nw07_codes", _codes_in_texts, f"WITH n AS (SELECT doc_id AS news_id, concat_ws(' ', text, lpad(CAST(doc_id AS VARCHAR), 6, '0'), '600519.SH', '4' || lpad(CAST(n_chars AS VARCHAR), 5, '0'), '777777') AS content FROM documents), {_codes('content', {'\\x00': '?'})} SELECT news_id AS doc_id, array_to_string(s, ',') AS codes FROM sy")

# search
_WALK = """sp AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM bo)), wi AS (SELECT CAST(a.i // 20 AS INT) AS window_id, a.day AS train_start, b.day AS train_end, c.day AS test_start, e.day AS test_end FROM sp a JOIN sp b ON b.i = a.i + 59 JOIN sp c ON c.i = a.i + 60 JOIN sp e ON e.i = a.i + 79 WHERE a.i % 20 = 0),
 cu AS (SELECT *, train_start + CAST(floor((train_end - train_start) * 0.8::DOUBLE) AS INT) AS t FROM wi), parts AS (SELECT window_id, 'train' AS part, train_start AS pb, t AS pe FROM cu UNION ALL SELECT window_id, 'validation', CAST(t + 1 AS DATE), train_end FROM cu UNION ALL SELECT window_id, 'test', test_start, test_end FROM cu)"""
ORACLE["opt05_walk_forward_search"] = f"WITH RECURSIVE {BO}, {_search('bo', _WALK)}, rk AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY round(train_score, 9) DESC, trial) AS q FROM sc WHERE train_score IS NOT NULL) SELECT window_id, train_start, train_end, test_start, test_end, CAST(trial AS INTEGER) AS trial, fast, slow, round(train_score, 3) AS train_score, round(validation_score, 3) AS validation_score, round(test_score, 3) AS test_score FROM rk JOIN pv USING (trial) JOIN wi USING (window_id) WHERE q = 1"


def _sampled(spark, d):
    """A trial for each nation, and whether its values are of the ranges."""
    ranges = {"fast": [3.0, 5.0], "slow": [10.0, 20.0]}
    trials = op.param_sample(spark, ranges, table(spark, d, "nation").count())
    return trials.select("trial", *[F.col(n).isin(v).alias(n) for n, v in ranges.items()])


add("opt02_param_sample", _sampled, "SELECT row_number() OVER () - 1 AS trial, true AS fast, true AS slow FROM nation")


def _grid_of_tables(spark, d):
    keys = [float(r[0]) for r in table(spark, d, "region").select("r_regionkey").distinct().collect()]  # a handful
    lines = [float(r[0]) for r in table(spark, d, "lineitem").select("l_linenumber").distinct().collect()]  # a handful
    return op.param_grid(spark, {"a": op.range_values(values=sorted(keys)), "b": op.range_values(values=sorted(lines))}).withColumn("trial", F.col("trial").cast("long"))


add("opt01_param_grid", _grid_of_tables, "SELECT a, b, row_number() OVER (ORDER BY a, b) - 1 AS trial FROM (SELECT DISTINCT CAST(r_regionkey AS DOUBLE) AS a FROM region) CROSS JOIN (SELECT DISTINCT CAST(l_linenumber AS DOUBLE) AS b FROM lineitem)")
