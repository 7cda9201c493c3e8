"""Tables as streams, and ticks of one time."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from marketlake.queries.text import _news_stream, events_stream, state_store
from marketlake.streaming import live


def _events(spark, rows):
    """Events of one type: (event_id, second, value)."""
    start = datetime.datetime(2024, 1, 1)
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.createDataFrame([(i, start + datetime.timedelta(seconds=t), 1, "x", v, None) for i, t, v in rows], schema)


def test_a_table_in_a_folder_of_files_is_a_stream_too(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"the {i}") for i in range(6)], "doc_id long, text string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs.coalesce(1).write.parquet(f"{tmp_path}/once")
    assert _news_stream(spark, str(tmp_path)).count() == 6
    (tmp_path / "single").mkdir()
    next((tmp_path / "once").glob("*.parquet")).rename(tmp_path / "single" / "documents.parquet")
    assert _news_stream(spark, str(tmp_path / "single")).count() == 6
    _events(spark, [(i, i, 1.0) for i in range(5)]).repartition(2).write.parquet(f"{tmp_path}/events.parquet")
    query = events_stream(spark, str(tmp_path)).writeStream.format("memory").queryName("in_a_folder").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("in_a_folder").count() == 5


def test_ticks_of_one_time_follow_their_numbers_and_none_is_lost(spark, tmp_path):
    values = [(i * 37 % 101) / 4 for i in range(60)]
    rows = [(i, i // 3, v) for i, v in enumerate(values)]  # three of each second
    _events(spark, rows[::-1]).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    ticks = lambda: events_stream(spark, str(tmp_path)).withColumnRenamed("price", "close")
    with state_store(spark):
        live.live_factors(ticks(), "seq").writeStream.format("memory").queryName("of_one_time").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        live.chain(ticks(), f"{tmp_path}/t", f"{tmp_path}/cc", lambda s: s.withColumn("approved", F.lit(True)), sequence="seq").awaitTermination()
    found = spark.table("of_one_time").orderBy("seq").collect()
    assert [r["close"] for r in found] == values
    assert [r["sma_5"] for r in found] == [None] * 4 + [sum(values[i - 4 : i + 1]) / 5 for i in range(4, 60)]
    crosses = [r["seq"] for r in found if r["cross"]]
    tables = live.chain_tables(spark, f"{tmp_path}/t", "seq")
    assert tables["factors"].count() == 60 and len(crosses) > 9
    for name in ("signals", "orders", "fills"):
        assert sorted(r["seq"] for r in tables[name].collect()) == crosses
