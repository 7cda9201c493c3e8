from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketlake.functions import news as nw
from marketlake.operators import actions as ca
from marketlake.operators import backtest as bt
from marketlake.operators import ml
from marketlake.operators import perf
from marketlake.operators import quality as dq
from marketlake.operators import risk as rk
from marketlake.operators import search as op
from marketlake.operators import xsection as xs
from marketlake.sources import bars as src
from marketlake.streaming import live

DAY = dt.date(2024, 1, 1)


def daily(spark, rows):
    return spark.createDataFrame([(s, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), *[float(p) for _ in range(4)], 1000) for s, i, p in rows], "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long")


def test_adjustment_divides_by_later_factors(spark):
    b = daily(spark, [("a", 0, 10.0), ("a", 31, 9.0), ("a", 60, 9.8)])
    acts = spark.createDataFrame([("a", dt.date(2024, 2, 1), 0.98), ("a", dt.date(2024, 8, 1), 0.90)], "symbol string, action_date date, adjust_factor double")
    got = [r["close"] for r in ca.adjust_prices(b, acts).orderBy("ts").collect()]
    # the bar of the action's own day is not adjusted by it
    assert got == pytest.approx([10 / (0.98 * 0.90), 9 / 0.90, 9.8 / 0.90])
    assert [r["close"] for r in ca.adjust_prices(b, acts.limit(0)).orderBy("ts").collect()] == [10.0, 9.0, 9.8]
    assert [r["close"] for r in ca.adjust_prices(b, acts, "none").orderBy("ts").collect()] == [10.0, 9.0, 9.8]


def test_quality_levels(spark):
    b = daily(spark, [("a", i, 10.0) for i in range(10)] + [("b", i, 10.0) for i in range(10)])
    bad = b.withColumn("high", F.when(F.col("symbol") == "b", 9.5).otherwise(F.col("high")))
    report = {r["symbol"]: r["level"] for r in dq.quality_report(bad, ["open", "close"]).collect()}
    assert report == {"a": "PASS", "b": "ERROR"}
    assert dq.gate(bad, dq.quality_report(bad, ["open"])).select("symbol").distinct().collect()[0][0] == "a"


def test_performance_of_steady_growth(spark):
    nav = spark.createDataFrame([("s", i, 1e6 * 1.001**i) for i in range(253)], "strategy string, ts long, total_value double")
    r = perf.performance_report(nav).first()
    assert r["n"] == 252 and r["annual_return"] == pytest.approx(1.001**252 - 1) and r["max_drawdown"] == 0 and r["calmar"] == 0 and r["sharpe"] == 0 and r["win_rate"] == 1
    assert perf.performance_report(nav.limit(2)).count() == 0


def test_backtest_conserves_cash(spark):
    b = spark.createDataFrame([("a", i, float(p), float(s)) for i, (p, s) in enumerate([(100, 0), (100, 1), (110, 0), (120, -1), (90, 0)])], "symbol string, ts long, close double, signal double")
    got = [(r["cash"], r["position"], r["total_value"]) for r in bt.backtest_single(b, "signal", ["symbol"], cash=1000.0).orderBy("ts").collect()]
    assert got == [(1000, 0, 1000), (100, 9, 1000), (100, 9, 1090), (1180, 0, 1180), (1180, 0, 1180)]


def test_circuit_breaker(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, 1, t + dt.timedelta(seconds=60 * i), ok) for i, ok in enumerate([False, False, False, True, True, True, True, True, True])]
    df = spark.createDataFrame(rows, "order_id long, account long, ts timestamp, approved boolean")
    got = [(r["broken"], r["final"]) for r in rk.circuit_breaker(df).orderBy("order_id").collect()]
    assert got == [(False, False)] * 3 + [(True, False)] * 4 + [(False, True)] * 2


def test_news_rules(spark):
    df = spark.createDataFrame([("业绩大幅增长",), ("未增长",), ("没有大幅增长",), ("下跌下跌",), ("",)], "t string")
    got = [(round(r["score"], 3), round(r["magnitude"], 3), r["labels"]) for r in nw.with_sentiment(df, F.col("t")).collect()]
    assert got[0] == (1.0, 0.75, ["positive", "greed"])
    assert got[1][0] == -1.0 and got[2][0] == -1.0 and got[3][2] == ["negative", "fear"] and got[4] == (0.0, 0.0, ["neutral"])
    row = spark.createDataFrame([("央行降准，贵州茅台600519.SH与000858涨停",)], "t string")
    out = row.select(nw.event_types(F.col("t")).alias("e"), nw.extract_symbols(F.col("t")).alias("s")).first()
    assert out["e"] == ["policy", "company"] and out["s"] == ["000858.SZ", "600519.SH"]


def test_sources(spark, tmp_path):
    (tmp_path / "x_5min.csv").write_text("symbol,date,open,high,low,close,volume,amount\n000002,2026-04-20,1,2,0.5,1.5,100,0\n000002,bad,1,2,0.5,1.5,100\nshort,2026-04-20\n000002,2026-04-21,1,2,x,1.5,100\n")
    df = src.read_bars_csv(spark, str(tmp_path))
    assert [tuple(r) for r in src.load_stats(df).collect()] == [("x_5min.csv", 1, 3)]
    assert {r["freq"] for r in df.collect()} == {"5min"}
    b = daily(spark, [("a", 0, 1.0), ("a", 1, 2.0)]).withColumn("freq", F.lit("day")).withColumn("amount", F.lit(1.0))
    src.write_bars(b, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("freq = 'day' and year = 2024").count() == 2
    src.export_bars_csv(b, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns[:3] == ["date", "open", "high"]
    with pytest.raises(ValueError):
        src.normalize_columns(b, {}, {"nothing"})
    msg = spark.createDataFrame([('{"symbol":"a","ts":1,"open":"1.5","high":"20000","low":"1","close":"2.00005","volume":3}',), ("{}",)], "value string")
    got = src.parse_bar_json(msg).collect()
    assert (got[0]["open"], got[0]["high"], got[0]["close"], got[0]["ts_us"], got[0]["ok"]) == (15000, 20000, 20001, 1000, True) and not got[1]["ok"]


def test_search(spark):
    assert op.range_values(1, 2, 0.5) == [1, 1.5, 2] and op.range_values(2, 4) == [3] and op.range_values(values=[7]) == [7]
    grid = op.param_grid(spark, {"a": [1, 2], "b": [3, 4]}).orderBy("trial").collect()
    assert [(r["a"], r["b"], r["trial"]) for r in grid] == [(1, 3, 0), (1, 4, 1), (2, 3, 2), (2, 4, 3)]
    res = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 3.0), (3, None)], "trial long, train_score double")
    assert op.best_params(res).first()["trial"] == 1
    assert op.param_sample(spark, {"a": [1.0, 2.0]}, 5).count() == 5


def test_ranks_and_features(spark):
    df = spark.createDataFrame([("d", v) for v in (1.0, 2.0, 2.0, None)], "date string, v double")
    assert [r[0] for r in df.orderBy("v").select(xs.cs_rank_pct("v")).collect()] == pytest.approx([None, 1 / 3, 2.5 / 3, 2.5 / 3], nan_ok=True)
    perfect = spark.createDataFrame([(float(i), float(i) * 3) for i in range(50)], "a double, b double")
    assert xs.rank_ic(perfect, "a", "b").first()[0] == pytest.approx(1.0)
    b = daily(spark, [("a", i, 100 + (i * 7) % 13) for i in range(60)])
    f = ml.build_features(b, [{"name": "return_1d"}, {"name": "ma_ratio", "lookback": 5, "transform": "rank"}, {"name": "?"}])
    assert {"return_1d", "ma_ratio_5", "label"} < set(f.columns) and f.filter("return_1d is null").count() == 0
    assert {r["split"] for r in ml.split_by_date(f).collect()} == {"train", "valid", "test"}


def test_upserts_survive_a_replay(spark, tmp_path):
    """A batch that runs twice adds nothing; the last batch wins, within a batch the greatest sequence; a compacted table reads alike."""
    path, keys = f"file://{tmp_path}/t", ["k"]
    rows = lambda *x: spark.createDataFrame(list(x), "k long, seq long, v string")
    sink = live.upsert_sink(path, keys, "seq")
    sink(rows((1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, "x")), 0)
    sink(rows((1, 1, "late")), 0)
    sink(rows((2, 0, "y"), (3, 0, "z")), 1)
    want = {(1, 3, "c"), (2, 0, "y"), (3, 0, "z")}
    assert {tuple(r) for r in live.current(spark, path, keys).collect()} == want
    live.compact(spark, path, f"{path}2", keys)
    assert {tuple(r) for r in live.current(spark, f"{path}2", keys).collect()} == want
