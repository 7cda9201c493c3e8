from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketlake.functions import factors as fx
from marketlake.functions import signals as sg
from marketlake.functions.scan import linear_scan
from marketlake.plans.graph import apply_factor_graph


def bars(spark, closes, symbol="a"):
    return spark.createDataFrame([(symbol, i, float(c) if c is not None else None) for i, c in enumerate(closes)], "symbol string, ts long, close double")


def column(df, name):
    return [r[name] for r in df.orderBy("symbol", "ts").collect()]


def test_sma_of_a_ramp(spark):
    got = column(bars(spark, range(1, 11)).withColumn("y", fx.sma("close", 3)), "y")
    assert got[:2] == [None, None] and got[2] == 2.0 and got[9] == 9.0
    with pytest.raises(ValueError):
        fx.sma("close", 0)


def test_ema_matches_pandas(spark):
    x = np.random.default_rng(1).normal(100, 5, 700)
    for n in (1, 3, 20, 200):
        got = column(fx.ema(bars(spark, x), "close", n, "y"), "y")
        want = pd.Series(x).ewm(span=n, adjust=False).mean()
        assert np.allclose(got, want, rtol=1e-12)


def test_scan_is_exact_for_many_keys(spark):
    rng = np.random.default_rng(2)
    rows = [(k, i, float(rng.normal())) for k in ("a", "b", "c") for i in range(150)]
    got = linear_scan(spark.createDataFrame(rows, "k string, i long, u double"), "k", "i", "u", 0.5, "y").orderBy("k", "i").collect()
    y, last = 0.0, None
    for r in got:
        y = r["u"] if r["k"] != last else 0.5 * y + r["u"]
        last = r["k"]
        assert abs(r["y"] - y) < 1e-12


def test_rsi_rises(spark):
    got = column(fx.rsi(bars(spark, range(100, 120)), 5), "rsi")
    assert got[:5] == [None] * 5 and got[5] == 100.0 and got[-1] > 90


def test_macd_of_a_constant_is_zero(spark):
    last = fx.macd(bars(spark, [100.0] * 50)).orderBy(F.desc("ts")).first()
    assert last["macd"] == pytest.approx(0) and last["macd_signal"] == pytest.approx(0) and last["macd_hist"] == pytest.approx(0)


def test_crosses(spark):
    df = spark.createDataFrame([("a", i, float(f), 2.0) for i, f in enumerate([1, 2, 3, 2, 1])], "symbol string, ts long, f double, s double")
    assert column(df.withColumn("y", sg.cross_above("f", "s")), "y") == [0, 0, 1, 0, 0]
    df = spark.createDataFrame([("a", i, float(f), 2.0) for i, f in enumerate([3, 2, 1, 2, 3])], "symbol string, ts long, f double, s double")
    assert column(df.withColumn("y", sg.cross_below("f", "s")), "y") == [0, 0, -1, 0, 0]


def test_threshold(spark):
    df = bars(spark, [50, 60, 75, 80, 65])
    assert column(df.withColumn("y", sg.threshold_sign(F.col("close"), 70)), "y") == [0, 0, 1, 1, 0]


def test_interpolation_and_fills(spark):
    df = bars(spark, [None, 1.0, None, None, 4.0, None])
    assert column(fx.interpolate(df, "close", "y"), "y") == [None, 1.0, 2.0, 3.0, 4.0, 4.0]
    assert column(df.withColumn("y", fx.ffill("close", 1)), "y") == [None, 1.0, 1.0, None, 4.0, 4.0]
    assert column(df.withColumn("y", fx.bfill("close")), "y") == [1.0, 1.0, 4.0, 4.0, 4.0, None]


def test_rolling_correlation_without_variance_is_null(spark):
    df = spark.createDataFrame([("a", i, 1.0, float(i)) for i in range(10)], "symbol string, ts long, x double, y double")
    assert set(column(df.withColumn("c", fx.rolling_corr("x", "y", 5)), "c")) == {None}


def test_graph_checks_its_nodes(spark):
    df = bars(spark, range(30))
    node = {"id": "m", "op": "SMA", "inputs": ["close"], "params": {"period": 3}}
    assert column(apply_factor_graph(df, [node]), "m")[5] == 4.0
    for bad in ([node, node], [{**node, "op": "?"}], [{**node, "inputs": ["nothing"]}], [{"id": "a", "op": "NOT", "inputs": ["b"]}, {"id": "b", "op": "NOT", "inputs": ["a"]}]):
        with pytest.raises(ValueError):
            apply_factor_graph(df, bad)


def test_combinations(spark):
    rows = [(1, "x", 0, 1.0, "LONG", 0.5), (1, "x", 1, 3.0, "SHORT", 0.7), (1, "y", 1, 3.0, "SHORT", 0.2), (1, "x", 2, 1.0, "LONG", 0.9)]
    s = spark.createDataFrame(rows, "ts long, symbol string, strategy_no int, weight double, direction string, strength double")
    assert {(r["symbol"], r["direction"], r["strength"]) for r in sg.combine(s, "union", 3).collect()} == {("x", "LONG", 0.5), ("y", "SHORT", 0.2)}
    vote = sg.combine(s, "vote", 3).collect()
    assert [(r["symbol"], r["direction"], round(r["strength"], 6)) for r in vote] == [("x", "LONG", 0.7)]
    weighted = {r["symbol"]: (r["direction"], round(r["strength"], 6)) for r in sg.combine(s, "weighted", 3).collect()}
    assert weighted == {"x": ("SHORT", round((0.5 + 2.1 + 0.9) / 5, 6)), "y": ("SHORT", 0.12)}
    layered = sg.combine_layered(s, 3).collect()
    assert [(r["symbol"], r["strategy_no"]) for r in layered] == [("x", 0)]
