"""One factor graph three ways: as columns, recomputed where bars change, and as stream state."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from marketlake.functions import factors as fx
from marketlake.plans.graph import apply_factor_graph
from marketlake.plans.incremental import KEYS, changes, factor_rows, keep_factors, reached, recompute_rows
from marketlake.plans.spec import dependents, lookback, node_order, reaches
from marketlake.queries.keyed import SPEC
from marketlake.queries.text import state_store
from marketlake.sources.merge_table import MergeTable
from marketlake.streaming.spec_factors import STEPS, live_spec_factors

START = datetime.datetime(2024, 1, 1)
BARS = "symbol string, ts timestamp, close double, volume double"


def walk(symbols, n, seed=1):
    rng = random.Random(seed)
    out = []
    for s in symbols:
        x = 100.0
        for i in range(n):
            x += rng.choice((-1.5, -0.5, 0.0, 0.5, 1.5))
            out.append((s, START + datetime.timedelta(hours=i), x, float(rng.randint(1, 9))))
    return out


def values(df):
    return {(r["factor"], r["symbol"], r["ts"]): r["value"] for r in df.collect()}


def alike(a, b):
    assert a.keys() == b.keys()
    assert [k for k in a if a[k] != pytest.approx(b[k], abs=1e-9)] == []


def test_what_a_graph_says_of_itself():
    assert dependents(SPEC, {"volume"}) == ["busy"] and set(dependents(SPEC, {"close"})) == {n["id"] for n in SPEC} - {"busy"}
    assert dependents(SPEC, {"slow"}) == ["slow", "up", "down"] or set(dependents(SPEC, {"slow"})) >= {"up", "down"}
    far = reaches(SPEC, {"close"})
    assert (far["fast"], far["slow"], far["up"], far["top"]) == (4, 19, 20, 19) and 300 < far["rsi"] < 600 and "busy" not in far
    assert lookback(SPEC, {"up"}) == 20 and lookback(SPEC, {"up"}, {"fast", "slow"}) == 1
    with pytest.raises(ValueError):
        node_order([{"id": "a", "op": "NOT", "inputs": ["b"]}, {"id": "b", "op": "NOT", "inputs": ["a"]}])
    with pytest.raises(ValueError):
        node_order([{"id": "a", "op": "NOT", "inputs": ["x"]}] * 2)


def test_reached_rows(spark):
    bars = spark.createDataFrame([("a", i) for i in range(20)] + [("b", i) for i in range(5)], "symbol string, ts int")
    changed = spark.createDataFrame([("a", 10), ("a", 3)], "symbol string, ts int")
    got = {r["ts"]: (r["segment"], r["distance"]) for r in reached(bars, changed, 2, 1).collect() if r["symbol"] == "a"}
    assert got == {2: (1, None), 3: (1, 0), 4: (1, 1), 5: (1, 2), 9: (2, None), 10: (2, 0), 11: (2, 1), 12: (2, 2)}
    assert reached(bars, changed, 2, 1).filter("symbol = 'b'").count() == 0


def test_changes_by_field(spark):
    old = spark.createDataFrame([("a", 1, 1.0, 2.0), ("a", 2, 1.0, None), ("a", 3, 1.0, 1.0)], "symbol string, ts int, close double, volume double")
    new = spark.createDataFrame([("a", 1, 1.0, 3.0), ("a", 2, 1.0, None), ("a", 3, 1.0, None), ("a", 4, 5.0, 5.0)], "symbol string, ts int, close double, volume double")
    got = {r["ts"]: (r["changed_close"], r["changed_volume"]) for r in changes(old, new, ["close", "volume"]).collect()}
    assert got == {1: (False, True), 3: (False, True), 4: (True, True)}


def test_recomputed_rows_equal_a_full_recompute(spark):
    rows = walk("ab", 1500)
    before = spark.createDataFrame(rows, BARS)
    at = {rows[i][:2] for i in (5, 700, 702, 1499)}
    after = spark.createDataFrame([(*r[:2], r[2] + 5 * (r[:2] in at), r[3]) for r in rows], BARS)
    full, old = values(factor_rows(after, SPEC)), values(factor_rows(before, SPEC))
    got = values(recompute_rows(after, spark.createDataFrame(list(at), "symbol string, ts timestamp"), SPEC, {"close"}))
    assert {k for k in full if full[k] != pytest.approx(old[k], abs=1e-9)} <= got.keys()
    alike({k: full[k] for k in got}, got)
    assert not any(f == "busy" or s == "b" for f, s, _ in got)
    assert {t for f, _, t in got if f == "fast"} == {START + datetime.timedelta(hours=h) for i in (5, 700, 702, 1499) for h in range(i, min(i + 5, 1500))}


def test_nodes_that_do_not_change_are_read(spark):
    spec = [{"id": "mean", "op": "SMA", "inputs": ["close"], "params": {"period": 3}}, {"id": "gap", "op": "ABOVE", "inputs": ["volume", "mean"]}]
    bars = spark.createDataFrame(walk("a", 30), BARS)
    stored = factor_rows(bars, spec).withColumn("value", F.when(F.col("factor") == "mean", -1000.0).otherwise(F.col("value")))
    changed = bars.filter(F.col("ts") == F.lit(START + datetime.timedelta(hours=9))).select(*KEYS)
    (row,) = recompute_rows(bars, changed, spec, {"volume"}, stored).collect()
    assert row["factor"] == "gap" and row["value"] > 1000  # from the stored mean
    with pytest.raises(ValueError):
        recompute_rows(bars, changed, spec, {"volume"})


def test_kept_factors(spark, tmp_path):
    """Batches with corrections, a late bar, bars as they were, and a replay after one of the two merges."""
    spec = [n for n in SPEC if n["id"] in ("fast", "slow", "up", "rsi", "busy")]
    rows = walk("ab", 900)
    bars = MergeTable(spark, f"file://{tmp_path}/bars", KEYS)
    factors = MergeTable(spark, f"file://{tmp_path}/factors", ["factor", *KEYS], F.col("factor"))
    run = keep_factors(bars, factors, spec, ["close", "volume"])
    frame = lambda r: spark.createDataFrame(r, BARS)
    late = rows.pop(450)
    run(frame(rows), 0)
    run(frame([late]), 1)
    run(frame(rows[100:110]), 2)  # nothing new
    assert factors.version() == 2
    volumes = [(*r[:3], r[3] + 1) for r in rows[20:22]]
    layers = {k: len(x) for k, x in factors._version().parts.items()}
    run(frame(volumes), 3)
    grown = {k for k, x in factors._version().parts.items() if len(x) != layers[k]}
    assert grown == {"busy"}
    prices = [(*r[:2], r[2] * 2, r[3]) for r in rows[600:601]]
    bars.merge(frame(prices), "bars", 4)  # the batch got so far, then its driver was lost
    run(frame(prices), 4)
    run(frame(prices), 4)
    want = {r[:2]: r for r in [*rows, late]} | {r[:2]: r for r in volumes} | {r[:2]: r for r in prices}
    alike(values(factor_rows(frame(list(want.values())), spec)), values(factors.read()))


def stream(spark, path, batches, spec, name="out"):
    schema = "symbol string, ts timestamp, close double, volume double"
    for batch in batches:
        spark.createDataFrame(batch, BARS).coalesce(1).write.mode("append").parquet(f"{path}/in")
        with state_store(spark):
            out = live_spec_factors(spark.readStream.schema(schema).parquet(f"{path}/in"), spec)
            out.writeStream.format("parquet").option("path", f"{path}/{name}").option("checkpointLocation", f"{path}/{name}-c").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/{name}")


def test_stream_state_equals_columns(spark, tmp_path):
    spec = [*SPEC, {"id": "loud", "op": "THRESHOLD", "inputs": ["hist"], "params": {"value": 0.4}}, {"id": "both", "op": "AND", "inputs": ["loud", "gap"]}, {"id": "gap", "op": "ABOVE", "inputs": ["fast", "slow"]},
            {"id": "under", "op": "BELOW", "inputs": ["fast", "slow"]}, {"id": "either", "op": "OR", "inputs": ["loud", "up"]}, {"id": "no", "op": "NOT", "inputs": ["mean"]}, {"id": "first", "op": "EMA", "inputs": ["fast"], "params": {"period": 7}}]
    rows = sorted(walk("ab", 120), key=lambda r: r[1])
    rows[50] = (*rows[50][:2], None, 1.0)
    late = (*rows[10][:2], 1e9, 1.0)
    got = stream(spark, f"file://{tmp_path}", [rows[:90], [late, *rows[90:150]], rows[150:]], spec)
    assert [tuple(r)[:3] for r in got.filter("late").collect()] == [(late[0], late[1], True)] and got.filter("late AND fast IS NOT NULL").count() == 0
    names = [n["id"] for n in spec]
    want = {(r["symbol"], r["ts"]): r for r in apply_factor_graph(spark.createDataFrame(rows, BARS), spec).collect()}
    found = {(r["symbol"], r["ts"]): r for r in got.filter("NOT late").collect()}
    assert want.keys() == found.keys()
    bad = [(k, n, want[k][n], found[k][n]) for k in want for n in names if want[k][n] != pytest.approx(found[k][n], abs=1e-9)]
    assert bad == []


def test_state_does_not_grow():
    for op, n, ins in (("SMA", 5, 1), ("BOLL", 5, 1), ("EMA", 5, 1), ("RSI", 5, 1), ("MACD", 5, 1), ("CROSS_ABOVE", 5, 2)):
        state, sizes = [], []
        for i in range(200):
            STEPS[op](state, tuple([float(i % 7)] * ins), {"period": n})
            sizes.append(len(repr(state)))
        assert max(sizes[100:]) <= max(sizes[:100]) + 40


@pytest.mark.parametrize("width", [7, 10_000])
def test_slices_of_a_symbol_give_the_same(spark, width):
    rows = [("a", i, None if i % 17 == 3 or 300 < i < 340 else float((i * 37) % 101)) for i in range(1200)] + [("b", i, 1.0) for i in range(3)] + [("c", 1, None)]
    df = spark.createDataFrame(rows, "symbol string, ts int, close double").withColumn("slice", F.floor(F.col("ts") / width))
    for one, many in (
        (fx.ema(df, "close", 9, "y"), fx.ema(df, "close", 9, "y", slices="slice")),
        (fx.ema(df, "close", 300, "y", "sma"), fx.ema(df, "close", 300, "y", "sma", slices="slice")),
        (fx.rsi(df, out="y"), fx.rsi(df, out="y", slices="slice")),
        (fx.macd(df).withColumnRenamed("macd_hist", "y"), fx.macd(df, slices="slice").withColumnRenamed("macd_hist", "y")),
    ):
        a, b = ({(r["symbol"], r["ts"]): r["y"] for r in x.collect()} for x in (one, many))
        assert a.keys() == b.keys() and any(v is not None for v in a.values())
        assert [(k, a[k], b[k]) for k in a if a[k] != pytest.approx(b[k], abs=1e-9)] == []


def test_a_missing_value_does_not_move_a_mean(spark):
    rows = [("a", i, None if i in (0, 5, 6) else float(i)) for i in range(30)]
    got = fx.ema(spark.createDataFrame(rows, "symbol string, ts int, close double"), "close", 4, "e").orderBy("ts").collect()
    y, want = None, []
    for _, _, x in rows:
        if x is not None:
            y = x if y is None else y + (x - y) * 2 / 5
        want.append(None if x is None else pytest.approx(y))
    assert [r["e"] for r in got] == want


def test_one_symbol_is_spread_over_tasks(spark):
    df = spark.range(200_000).selectExpr("'a' AS symbol", "id AS ts", "cast(id % 97 AS double) AS close", "id div 10000 AS slice")
    out = fx.ema(df, "close", 20, "e", slices="slice")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(parts) > 1 and max(r["count"] for r in parts) < 200_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert out.agg(F.count("e")).first()[0] == 200_000
