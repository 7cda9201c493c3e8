"""Progress of loads, counts of a stream, timers and limits, and the order of a chain's signals."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from marketlake.functions import news as nw
from marketlake.operators import backtest as bt
from marketlake.operators import joins as jn
from marketlake.operators import orders as ox
from marketlake.operators import perf
from marketlake.operators import xsection as xs
from marketlake.queries.text import state_store
from marketlake.sources.bars import write_bucketed
from marketlake.sources.merge_table import MergeTable
from marketlake.sources.progress import Loader
from marketlake.streaming import live
from marketlake.streaming.counters import IngestCounters, ingest_bars

START = datetime.datetime(2024, 1, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def test_a_batch_that_was_lost_between_data_and_progress(spark, tmp_path):
    days = spark.createDataFrame([(s, START.date() + datetime.timedelta(days=i), float(i)) for s in "ab" for i in range(10)], "symbol string, date date, close double")
    loader = Loader(spark, f"file://{tmp_path}/l")
    loader.load(days, days, "2024-01-01", "2024-01-04")
    before = loader.progress
    loader.progress = None  # the driver is lost after the data
    with pytest.raises(AttributeError):
        loader.load(days, days, "2024-01-01", "2024-01-08", batch=1)
    loader.progress = before
    rows = days.filter("date BETWEEN '2024-01-05' AND '2024-01-08'")
    loader.data.merge(rows, "load", 1)
    assert loader.next_batch() == 1
    loader.load(days.withColumn("close", F.lit(-1.0)), days, "2024-01-01", "2024-01-08")
    assert loader.data.read().filter("close < 0").count() == 0 and loader.data.read().count() == 16
    assert {str(r["last_date"]) for r in loader.progress_table().collect()} == {"2024-01-08"}
    loader.clear(days.filter("symbol = 'a'"))
    loader.load(days.withColumn("close", F.lit(-1.0)), days, "2024-01-01", "2024-01-08")
    assert {r["symbol"] for r in loader.data.read().filter("close < 0").collect()} == {"a"}


def test_counts_of_a_stream(spark, tmp_path):
    good = '{"symbol": "a", "ts": %d, "open": "1.0", "high": "1.0", "low": "1.0", "close": "1.0", "volume": 1}'
    path = f"{tmp_path}/in"
    counters = IngestCounters()
    table = MergeTable(spark, f"file://{tmp_path}/bars", ["symbol", "ts_us"])
    spark.streams.addListener(counters)
    try:
        for lines in ([good % 1, good % 2, "{broken", ""], [good % 2, '{"symbol": "a"}', "7", "null"]):
            spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(path)
            query = ingest_bars(spark.readStream.text(path), table, f"{tmp_path}/c")
            query.awaitTermination()
            assert counters.wait(query)
    finally:
        spark.streams.removeListener(counters)
    assert table.read().count() == 2
    got = counters.totals("ingest")
    assert (got["received"], got["stored"], got["failed"] + got["parse_errors"]) == (8, 3, 5) and got["failed"] == 1


def run(spark, path, make, batches, schema):
    """All that a stream gives over micro-batches that come one after the other."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        with state_store(spark):
            out = make(spark.readStream.schema(schema).parquet(f"{path}/in"))
            out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


def test_a_breaker_closes_without_another_order(spark, tmp_path):
    schema = "order_id long, account long, ts timestamp, approved boolean"
    first = [(1, 1, at(0), False), (2, 1, at(1), False), (3, 1, at(2), False), (4, 1, at(10), True)]
    other = [(5, 2, at(1000), True)]  # only moves the watermark
    got = run(spark, str(tmp_path), lambda s: live.timed_breaker(s, 3, 60.0), [first, other, [(6, 1, at(1001), True)]], schema)
    rows = sorted((r["account"], r["ts"], r["order_id"], r["broken"], r["final"], r["reset"]) for r in got.collect() if r["account"] == 1 or not r["reset"])
    assert [r[1:] for r in rows if r[0] == 1] == [
        (at(0), 1, False, False, False), (at(1), 2, False, False, False), (at(2), 3, False, False, False), (at(10), 4, True, False, False), (at(62), None, False, None, True), (at(1001), 6, False, True, False),
    ]


def test_each_order_has_its_own_minute(spark, tmp_path):
    schema = "order_id long, account long, ts timestamp"
    times = [0, 5, 5, 59, 60, 61, 119, 120, 181]
    rows = [(i, 1, at(t)) for i, t in enumerate(times)]
    got = run(spark, str(tmp_path), lambda s: live.order_rate_limit(s, 3), [rows[:4], rows[4:7], rows[7:]], schema)
    assert {r["order_id"]: (r["orders"], r["passed"]) for r in got.collect()} == {i: (n, n <= 3) for i, n in enumerate(sum(t - 60 <= u <= t for u in times) for t in times)}


def test_the_first_signal_that_is_not_zero_counts(spark, tmp_path):
    schema = "symbol string, ts timestamp, close double"
    spec = [{"id": "strong", "op": "THRESHOLD", "inputs": ["close"], "params": {"value": 10}}, {"id": "weak", "op": "THRESHOLD", "inputs": ["close"], "params": {"value": 1}}, {"id": "against", "op": "NOT", "inputs": ["weak"]}]
    spark.createDataFrame([("a", at(i), x) for i, x in enumerate((0.5, 5.0, 20.0, -5.0))], schema).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds its batch in the tables
        with state_store(spark):
            live.chain(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"file://{tmp_path}/t", f"{tmp_path}/c{_}", lambda s: s.withColumn("approved", F.col("close") < 10), spec=spec, signals=("strong", "against")).awaitTermination()
    tables = live.chain_tables(spark, f"file://{tmp_path}/t")
    assert {(r["close"], r["side"], r["approved"]) for r in tables["orders"].collect()} == {(5.0, "SELL", True), (20.0, "BUY", False), (-5.0, "BUY", True)}
    assert tables["factors"].count() == 4 and tables["fills"].count() == 2


def test_participation_by_brute_force(spark):
    bars = [(s, at(60 * i), (i * 7) % 11) for s in "ab" for i in range(40)]
    parents = [(i, "abc"[i % 3], at(60 * (i % 50) - 30 * (i % 2)), (i * 13) % 40) for i in range(90)] + [(90, "a", None, 5), (91, "a", at(0), None)]
    want = set()
    for order, s, start, q in parents:
        left = q or 0
        for symbol, ts, v in bars:
            if symbol == s and start is not None and ts >= start and left > 0:
                take = min(left, max(1, int(v * 0.5)))
                want.add((order, ts, take))
                left -= take
    got = ox.pov_schedule(spark.createDataFrame(parents, "order_id long, symbol string, start timestamp, quantity long"), spark.createDataFrame(bars, "symbol string, ts timestamp, volume long"), 0.5)
    assert {tuple(r) for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ">= start" not in plan


def test_ranks_and_areas_by_slices(spark):
    rows = [((i * 7919) % 1009 / 10, i % 2 if i % 5 else 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "score double, label int")
    wins = sum((a > b) + 0.5 * (a == b) for a, y in rows if y == 1 for b, z in rows if z == 0)
    n = sum(y for _, y in rows)
    found = perf.classification_metrics(df, "score", "label")
    assert found.first()["auc"] == pytest.approx(wins / (n * (len(rows) - n)))
    assert "SinglePartition" not in "".join(x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "score" in x and "Window" in x)
    pairs = spark.range(5000).selectExpr("cast(id as double) as a", "cast(id % 4999 as double) as b")
    assert xs.rank_ic(pairs, "a", "b").first()[0] == pytest.approx(pairs.agg(F.corr("a", "b")).first()[0], abs=1e-2)


def test_calendars(spark):
    bars = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0), ("a", 3, 3.0)], "symbol string, ts int, close double")
    calendar = spark.createDataFrame([(1,), (2,), (2,), (3,)], "ts int")
    assert {tuple(r) for r in jn.align_calendar(bars, calendar).collect()} == {(1, "a", 1.0), (1, "b", 2.0), (2, None, None), (3, "a", 3.0)}
    assert jn.align_calendar(bars).count() == 3 and jn.dense_calendar(bars).count() == 4 and jn.dense_calendar(bars, few=0).count() == 4


def test_batches_of_none_and_of_bad_strategies(spark):
    bars = spark.createDataFrame([("a", at(i), float(10 + i % 3)) for i in range(30)], "symbol string, ts timestamp, close double")
    schema = "strategy string, fast int, slow int"
    assert bt.batch_backtest(bars, spark.createDataFrame([], schema)).count() == 0
    assert {r["error"] for r in bt.batch_backtest(bars, spark.createDataFrame([("x", 5, 2), ("y", None, 2)], schema)).collect()} == {"fast period must be below slow", "period must be positive"}


def test_buckets_join_without_a_shuffle(spark, tmp_path):
    rows = spark.range(400).selectExpr("cast(id % 7 as string) AS symbol", "id AS ts", "id * 1.0 AS x")
    a, b = (write_bucketed(rows.withColumnRenamed("x", n), f"bucketed_{n}", 4, path=f"{tmp_path}/{n}") for n in ("xa", "xb"))
    options = ("spark.sql.adaptive.enabled", "spark.sql.requireAllClusterKeysForCoPartition")
    for name in options:
        spark.conf.set(name, "false")
    try:
        out = a.join(b.hint("merge"), ["symbol", "ts"]).groupBy("symbol").agg(F.sum(F.col("xa") - F.col("xb")).alias("d"), F.count("*").alias("n"))
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        assert {(r["d"], r["n"] // 57) for r in out.collect()} == {(0.0, 1)}
    finally:
        for name in options:
            spark.conf.unset(name)


def test_words_and_their_bounds(spark):
    df = spark.createDataFrame([("best 1600519 600519 x600036 600036.SH.", "kept", "own")], "text string, __t string, __s string")
    row = df.select(nw.extract_codes(F.col("text"), True).alias("c"), nw.extract_codes(F.col("text")).alias("all"), nw.event_types(F.col("text"), {"bad": ["ST"]}, True).alias("t"), nw.event_types(F.col("text"), {"bad": ["ST"]}).alias("u")).first()
    assert (row["c"], row["t"], row["u"]) == (["600036.SH", "600519.SH"], ["other"], ["bad"]) and len(row["all"]) == 2
    scored = nw.with_sentiment(df, F.col("text"))
    assert scored.columns == ["text", "__t", "__s", "score", "magnitude", "labels"] and scored.first()["__t"] == "kept"
