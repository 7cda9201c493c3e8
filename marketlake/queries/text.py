"""Queries over news-like documents, machine learning, factor graphs and streams."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import functions as F

from marketlake.functions import factors as fx
from marketlake.functions import news as nw
from marketlake.operators import ml
from marketlake.plans.graph import apply_factor_graph
from marketlake.queries.base import BE, Query, W, bars_events, bars_orders, rounded, sma_sql, table
from marketlake.streaming import live

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def add(name: str, fn: Query, sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        ORACLE[name] = sql


#: Dictionaries for the invented prose of the documents.
POS, NEG, STRONG, NOT = ["the", "thing"], ["rest", "or"], {"and": 1.5, "of": 0.5}, ["to"]
TOPICS = {"alpha": ["the", "and", "ing"], "beta": ["für", "und", "der"], "gamma": ["que", "los"], "delta": ["eau", "tion"]}


def docs(spark, d):
    t = table(spark, d, "documents")
    return t.select(F.col("doc_id").alias("news_id"), F.substring("text", 1, 60).alias("title"), F.col("text").alias("content"), "source", F.timestamp_add("HOUR", F.col("doc_id") % 720, F.lit("2024-01-01").cast("timestamp_ntz")).alias("published_at"))


_D = "WITH n AS (SELECT doc_id AS news_id, left(text, 60) AS title, text AS content, source, TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 720 AS BIGINT)) AS published_at FROM documents)"
add("nw05_event_types", lambda s, d: docs(s, d).select("news_id", F.array_join(nw.event_types(F.concat_ws(" ", "title", "content"), TOPICS), ",").alias("types")),
    _D + ", l AS (SELECT news_id, lower(title || ' ' || content) AS t FROM n), c AS (SELECT news_id, " + ", ".join("(" + " + ".join(f"contains(t, '{k}')::INT" for k in ks) + f") AS {n}" for n, ks in TOPICS.items()) + " FROM l), u AS (SELECT news_id, 'alpha' AS k, 0 AS o, alpha AS c FROM c UNION ALL SELECT news_id, 'beta', 1, beta FROM c UNION ALL SELECT news_id, 'gamma', 2, gamma FROM c UNION ALL SELECT news_id, 'delta', 3, delta FROM c) SELECT news_id, coalesce(string_agg(k, ',' ORDER BY c DESC, o) FILTER (c > 0), 'other') AS types FROM u GROUP BY 1")
add("nw01_tokenize", lambda s, d: docs(s, d).select("news_id", F.size(nw.tokenize(F.col("content"), [*POS, *NEG])).cast("long").alias("n"), F.array_join(nw.tokenize(F.col("content"), [*POS, *NEG]), "|").alias("tokens")),
    _D + " SELECT news_id, len(t) AS n, array_to_string(t, '|') AS tokens FROM (SELECT news_id, regexp_extract_all(lower(content), 'thing|rest|the|or|.', 0, 's') AS t FROM n)")


def _sentiment(spark, d):
    return nw.with_sentiment(docs(spark, d), F.col("content"), POS, NEG, STRONG, NOT).select("news_id", "source", "published_at", "score", "magnitude", "labels")


add("nw02_sentiment", lambda s, d: rounded(_sentiment(s, d).select("news_id", "score", "magnitude", F.array_join("labels", ",").alias("labels"))), _D + """,
 k AS (SELECT news_id, regexp_extract_all(lower(content), 'thing|rest|the|and|or|of|to|.', 0, 's') AS t FROM n), u AS (SELECT news_id, len(t) AS n, t, unnest(generate_series(1, len(t))) AS i FROM k),
 w AS (SELECT news_id, n, t[i] AS w, CASE WHEN i > 1 THEN t[i - 1] ELSE '' END AS b, CASE WHEN i > 2 THEN t[i - 2] ELSE '' END AS bb FROM u),
 s AS (SELECT news_id, n, w, CASE b WHEN 'and' THEN 1.5::DOUBLE WHEN 'of' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN b = 'to' OR (b IN ('and', 'of') AND bb = 'to') THEN -0.5::DOUBLE ELSE 1.0::DOUBLE END AS x FROM w),
 a AS (SELECT news_id, n, sum(CASE WHEN w IN ('the', 'thing') THEN x WHEN w IN ('rest', 'or') THEN -x ELSE 0 END) AS r, sum(CASE WHEN w IN ('the', 'thing', 'rest', 'or') THEN abs(x) ELSE 0 END) AS tot FROM s GROUP BY 1, 2),
 f AS (SELECT news_id, CASE WHEN tot > 0 THEN least(greatest(r / tot, -1), 1) ELSE 0 END AS score, least(1, tot / greatest(n, 1) * 2) AS m FROM a)
 SELECT news_id, round(score, 6) AS score, round(m, 6) AS magnitude, CASE WHEN score > 0.2 THEN 'positive' WHEN score < -0.2 THEN 'negative' ELSE 'neutral' END || CASE WHEN m > 0.6 AND score > 0.3 THEN ',greed' WHEN m > 0.6 AND score < -0.3 THEN ',fear' ELSE '' END AS labels FROM f""")


def _daily(spark, d):
    days = spark.range(31).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day")).filter(F.dayofweek("day").between(2, 6))
    scored = _sentiment(spark, d).withColumn("symbols", F.array("source"))
    return rounded(nw.daily_sentiment(scored, days), 5)


add("nw04_daily_sentiment", _daily)
add("nw08_names", lambda s, d: docs(s, d).select("news_id", F.array_join(nw.extract_symbols(F.col("content"), {"the": "600001.SH", "und": "000002.SZ", "que": ""}), ",").alias("symbols")))
add("nw10_tagged", lambda s, d: rounded(nw.tag_news(docs(s, d), keywords=TOPICS, names={"the": "600001.SH"}).select("news_id", F.size("symbols").cast("long").alias("n_symbols"), F.array_join("tags", ",").alias("tags"), "importance")))
add("fp04_news_range", lambda s, d: nw.news_filter(docs(s, d), F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-12").cast("timestamp_ntz"), ["Thing", "que"]).select("news_id", "published_at"), _D + " SELECT news_id, published_at FROM n WHERE published_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12' AND (contains(lower(title || chr(10) || content), 'thing') OR contains(lower(title || chr(10) || content), 'que'))")
add("fp06_latest_news", lambda s, d: nw.latest_news(docs(s, d), 20), _D + " SELECT news_id, title, left(content, 200) AS content, source, published_at FROM n ORDER BY published_at DESC, news_id LIMIT 20")

# machine learning
CONFIGS = [{"name": "return_1d"}, {"name": "return_5d"}, {"name": "volatility", "lookback": 20}, {"name": "turnover_ratio", "lookback": 20}, {"name": "ma_ratio", "lookback": 20, "transform": "zscore"}, {"name": "volume_price_corr", "lookback": 20}]
add("ml01_features", lambda s, d: rounded(ml.build_features(bars_orders(s, d), CONFIGS), 5))
add("ml02_split", lambda s, d: ml.split_by_date(ml.build_features(bars_orders(s, d), CONFIGS)).groupBy("split").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last")))
add("ml04_train", lambda s, d: rounded(ml.train(bars_orders(s, d), CONFIGS, "v1", trees=10, depth=3)[1], 5))
add("ml05_deciles", lambda s, d: rounded(ml.decile_returns(ml.build_features(bars_orders(s, d), CONFIGS), "return_5d", "label"), 5))

# graph
SPEC = [
    {"id": "fast", "op": "SMA", "inputs": ["close"], "params": {"period": 5}}, {"id": "slow", "op": "SMA", "inputs": ["close"], "params": {"period": 20}},
    {"id": "up", "op": "CROSS_ABOVE", "inputs": ["fast", "slow"]}, {"id": "down", "op": "CROSS_BELOW", "inputs": ["fast", "slow"]},
    {"id": "strong", "op": "THRESHOLD", "inputs": ["gap"], "params": {"value": 5}}, {"id": "gap", "op": "ABOVE", "inputs": ["fast", "slow"]}, {"id": "both", "op": "AND", "inputs": ["up", "strong"]},
]
add("g01_factor_graph", lambda s, d: rounded(apply_factor_graph(bars_events(s, d), SPEC).select("symbol", "ts", "fast", "slow", "up", "down", "strong", "both")), f"""WITH {BE}, m AS (SELECT symbol, ts, {sma_sql('close', 5)} AS fast, {sma_sql('close', 20)} AS slow FROM be), x AS (SELECT *, lag(fast) OVER ({W}) AS pf, lag(slow) OVER ({W}) AS p FROM m),
 y AS (SELECT symbol, ts, fast, slow, CASE WHEN pf <= p AND fast > slow THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS up, CASE WHEN pf >= p AND fast < slow THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS down, CASE WHEN fast - slow > 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS strong FROM x)
 SELECT symbol, ts, round(fast, 6) AS fast, round(slow, 6) AS slow, up, down, strong, CASE WHEN up > 0 AND strong > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS both FROM y""")
add("g02_user_operation", lambda s, d: rounded(apply_factor_graph(bars_events(s, d), [{"id": "mid", "op": "MID", "inputs": ["high", "low"]}], {"MID": lambda df, i, p, out: df.withColumn(out, (F.col(i[0]) + F.col(i[1])) / 2)}).select("symbol", "ts", "mid")), f"WITH {BE} SELECT symbol, ts, round((high + low) / 2, 6) AS mid FROM be")


# streams, run to the end of what is there
def shared_root(spark):
    """The cluster's shared folder; only a local master may go without one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if where is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return where or "file://" + tempfile.mkdtemp(prefix="marketlake-")


@contextlib.contextmanager
def state_store(spark) -> Iterator[None]:
    """The state store of stateful streams, for as long as one runs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, live.STATE_STORE)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _run(df, mode="append"):
    spark = df.sparkSession
    out = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    with state_store(spark):
        if mode == "append":
            q = df.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/c").trigger(availableNow=True).start()
        else:
            q = df.writeStream.outputMode(mode).foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/data")).option("checkpointLocation", f"{out}/c").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/data")


def table_stream(spark, d, name):
    """A table as a stream, be it one file or a folder of files; the name is a pattern, since a path that is a file is no source of streams."""
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def events_stream(spark, d):
    s = table_stream(spark, d, "events")
    return s.select("event_id", "user_id", F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.col("event_id").alias("seq"))


def _closed(spark, d):
    b = _run(live.windowed_bars(events_stream(spark, d), "1 hour", "0 seconds"))
    return rounded(b.withColumn("ts", F.col("ts").cast("timestamp_ntz")))


add("st01_windowed_bars", _closed, f"WITH {BE} SELECT symbol, ts, round(open,6) AS open, round(high,6) AS high, round(low,6) AS low, round(close,6) AS close, volume FROM be WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events)")
add("st03_subscribe", lambda s, d: _run(live.subscribe(events_stream(s, d).withColumn("type", F.lit("tick")), ["purchase"], ["tick"])).select("event_id", "symbol"), "SELECT event_id, event_type AS symbol FROM events WHERE event_type = 'purchase'")
add("st04_live_factors", lambda s, d: rounded(_run(live.live_factors(events_stream(s, d).withColumnRenamed("price", "close"), "seq")).select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "sma_5", "sma_20", "cross"), 5), "WITH e AS (SELECT event_type AS symbol, ts, value AS close FROM events), m AS (SELECT symbol, ts, " + sma_sql("close", 5) + " AS f, " + sma_sql("close", 20) + f" AS s FROM e), x AS (SELECT *, lag(f) OVER ({W}) AS pf, lag(s) OVER ({W}) AS p FROM m) SELECT symbol, ts, round(f, 5) AS sma_5, round(s, 5) AS sma_20, CASE WHEN pf <= p AND f > s THEN 1.0::DOUBLE WHEN pf >= p AND f < s THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"cross\" FROM x")
add("st07_order_rates", lambda s, d: _run(live.order_rates(events_stream(s, d).withColumn("account", F.lit(1)), 1)).withColumn("start", F.col("start").cast("timestamp_ntz")))
add("st08_circuit_breaker", lambda s, d: _run(live.circuit_breaker(events_stream(s, d).select(F.col("event_id").alias("order_id"), F.col("user_id").alias("account"), "ts", (F.col("price") < 60).alias("approved")), 3, 86400.0)).groupBy("account").agg(F.count_if("broken").alias("broken"), F.count_if("final").alias("approved")))
add("st09_order_status", lambda s, d: _run(live.order_status(events_stream(s, d).select(F.col("user_id").alias("order_id"), F.col("symbol").alias("status"), "seq")), "complete").select("order_id", "status"), "SELECT user_id AS order_id, arg_max(event_type, event_id) AS status FROM events GROUP BY 1")
add("st11_envelope", lambda s, d: _run(live.envelope(events_stream(s, d).select("symbol", "price", "ts"), F.lit("tick"))).select(F.get_json_object("value", "$.channel").alias("channel"), F.get_json_object("value", "$.data.symbol").alias("symbol")).groupBy("channel", "symbol").agg(F.count("*").alias("n")), "SELECT 'tick' AS channel, event_type AS symbol, count(*) AS n FROM events GROUP BY 2")


def _news_stream(spark, d):
    s = table_stream(spark, d, "documents").select("doc_id", F.substring("text", 1, 60).alias("title"), F.col("text").alias("content"))
    return _run(live.news_stream(s, keywords=TOPICS, names={"the": "600001.SH"})).select("doc_id", F.array_join("tags", ",").alias("tags"))


add("st12_news_stream", _news_stream, ORACLE["nw05_event_types"].replace("SELECT news_id, coalesce", "SELECT news_id AS doc_id, coalesce").replace("AS types FROM u", "AS tags FROM u"))
