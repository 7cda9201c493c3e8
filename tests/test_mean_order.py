"""Means that do not depend on how rows are dealt."""

from __future__ import annotations

import datetime
import random

from marketlake.queries.market import users


def test_means_of_a_day_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    rng, start = random.Random(5), datetime.datetime(2024, 1, 1)
    rows = [(i, start, i % 50, rng.randint(0, 50_000) / 100) for i in range(1000)]
    sums = dict.fromkeys(range(50), 0.0)
    for _, _, user, value in rows:
        sums[user] += value
    for name, dealt in (("a", rows), ("b", rows[::-1]), ("c", rng.sample(rows, len(rows)))):
        (tmp_path / name).mkdir()
        spark.createDataFrame(dealt, "event_id long, ts timestamp_ntz, user_id long, value double").repartition(3).write.parquet(f"{tmp_path}/{name}/events.parquet")
        assert {r["symbol"]: r["v"] for r in users(spark, f"{tmp_path}/{name}").collect()} == {u: x / 20 for u, x in sums.items()}
