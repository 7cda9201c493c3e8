"""Times, means and decimals as the SQL has them: cases that the given tables are too small to hold."""

from __future__ import annotations

import datetime
import random

import duckdb
import numpy as np

from marketlake import registry
from marketlake.queries.base import rounded
from marketlake.queries.keyed import _stream_counts
from marketlake.streaming.moving import window_means, window_sum

START = datetime.datetime(2024, 1, 1)


def _events(spark, folder, rows):
    """Events (event_id, microseconds, value) of one type as a table in a folder, and the rows that a query's SQL gives on it."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    events = [(i, START + datetime.timedelta(microseconds=t), 1, "x", v, None) for i, t, v in rows]
    spark.createDataFrame(events, schema).coalesce(1).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    return lambda name: con.execute(registry.ORACLE[name]).fetchall()


def test_messages_have_the_nearest_millisecond(spark, tmp_path):
    times = [172_425, 172_625, 173_100, 173_499, 173_500, 174_400, 174_500, 999_999]
    sql = _events(spark, str(tmp_path), [(10 * i + 5, t, 1.0) for i, t in enumerate(times)])
    found = _stream_counts(spark, str(tmp_path))
    assert [tuple(found.first()[c] for c in ("in_table", "received", "stored", "failed", "parse_errors"))] == sql("io22_stream_counters") == [(5, 8, 8, 0, 0)]


def _near_ties(n, seconds):
    """Values that are so few that means of 5 and of 20 are often equal but for rounding, one every so many seconds."""
    rng = random.Random(11)
    return [(i, i * seconds * 1_000_000, rng.randint(1, 9) / 100) for i in range(n)]


def _rows(df, names):
    return sorted(tuple(r[c] for c in names) for r in df.collect())


def test_live_means_that_are_equal_but_for_rounding_cross_as_in_the_sql(spark, tmp_path):
    sql = _events(spark, str(tmp_path), _near_ties(3000, 60))
    for name, names in (("st05_live_signals", ["symbol", "side", "n"]), ("st04_live_factors", ["ts", "cross"]), ("st10_live_chain", ["symbol", "side", "approved", "n"])):
        want = sorted((r[1], r[4]) if name == "st04_live_factors" else tuple(r[i] for i in ((0, 2, 1, 3) if len(names) == 4 else (0, 1, 2))) for r in sql(name))
        assert _rows(registry.QUERIES[name](spark, str(tmp_path)), names) == want


def test_means_by_windows_are_those_of_each_window():
    values = np.random.default_rng(1).random(200).round(2)
    for n in (1, 5, 16, 20, 50):
        for first in (0, 7, 16, 29):
            each = [window_sum(values[i - n + 1 : i + 1].tolist(), first + i - n + 1) / n for i in range(n - 1, 200)]
            assert window_means(values, n, first).tolist()[n - 1 :] == each
    con = duckdb.connect()
    con.execute("create table v as select unnest(range(200)) as i, unnest(?::double[]) as x", [values.tolist()])
    for n in (5, 20, 50):
        sql = con.execute(f"select avg(x) over (order by i rows between {n - 1} preceding and current row) from v order by i").fetchall()
        assert window_means(values, n, 0).tolist()[n - 1 :] == [x for (x,) in sql[n - 1 :]]


def test_nodes_of_a_graph_as_state_cross_as_in_the_sql(spark, tmp_path):
    sql = _events(spark, str(tmp_path), _near_ties(1500, 3600))  # a bar each
    names = ["ts", "fast", "slow", "up", "down"]
    want = sorted((r[1], r[2], r[3], r[4], r[5]) for r in sql("st04_spec_factors"))
    found = registry.QUERIES["st04_spec_factors"](spark, str(tmp_path)).fillna(-1.0, ["fast", "slow"])
    assert _rows(found, names) == [tuple(-1.0 if x is None else x for x in r) for r in want]


def test_doubles_are_rounded_as_in_the_sql(spark):
    rng = random.Random(2)
    halves = [(10 * rng.randrange(10**6) + 5) / 10**7 for _ in range(3000)]
    others = [rng.uniform(-1, 1) * 10 ** rng.randint(-8, 9) for _ in range(1000)]
    values = [0.0640625, -0.0640625, 0.0, *halves, *[-x for x in halves], *others, None, 1e300, float("inf")]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    for digits in (2, 4, 5, 6):
        sql = duckdb.sql(f"select round(unnest({values!r}::double[]), {digits})".replace("None", "null").replace("inf]", "'inf'::double]")).fetchall()
        assert [r["x"] for r in rounded(df, digits).orderBy("i").collect()] == [x for (x,) in sql]


def test_ranks_of_a_day_are_rounded_as_in_the_sql(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame([(i, START, i, "x", float(i), None) for i in range(640)], schema).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    sql = con.execute("select symbol, rank from (" + registry.ORACLE["xs01_zscore_rank"] + ") order by 1").fetchall()
    assert _rows(registry.QUERIES["xs01_zscore_rank"](spark, str(tmp_path)), ["symbol", "rank"]) == sql
