"""Parameter search against plain backtests."""

from __future__ import annotations

import datetime
import random

import pytest

from marketlake.operators import search as op


def final(rows):
    """Last total value of a plain fold over (close, signal)."""
    money, held = 1_000_000.0, 0
    for p, s in rows:
        if s > 0:
            q = int(money * 0.95 / p)
            money, held = money - q * p, held + q
        elif s < 0:
            money, held = money + held * p, 0
    return money + held * rows[-1][0]


def bars(n):
    rng, first = random.Random(3), datetime.date(2031, 5, 1)
    out = []
    for symbol in "ab":
        for i in range(n):
            close = 50 + 20 * rng.random()
            out += [(t, float(t), symbol, first + datetime.timedelta(days=i), close, float(rng.choice([-1, 0, 1]))) for t in range(3)]
    return first, out


def score(rows, trial, begin, end):
    each = [[(r[4], r[5]) for r in rows if r[0] == trial and r[2] == s and begin <= r[3] <= end] for s in "ab"]
    return sum(map(final, each)) / 2


def frame(spark, rows):
    return spark.createDataFrame([(*r[:3], datetime.datetime.combine(r[3], datetime.time()), *r[4:]) for r in rows], "trial long, fast double, symbol string, ts timestamp_ntz, close double, signal double")


def test_grid_search_splits_by_the_days_of_the_data(spark):
    first, rows = bars(41)
    cut = first + datetime.timedelta(days=28)  # int(40 * 0.7)
    got = {r["trial"]: r for r in op.grid_search(frame(spark, rows), ["fast"], metric="final_value").collect()}
    assert set(got) == {0, 1, 2}
    for t, r in got.items():
        assert r["train_score"] == pytest.approx(score(rows, t, first, cut))
        assert r["test_score"] == pytest.approx(score(rows, t, cut + datetime.timedelta(days=1), datetime.date(2099, 1, 1)))
    assert all(r["train_score"] is not None for r in op.grid_search(frame(spark, rows), ["fast"]).collect())


def test_walk_forward_fits_each_window(spark):
    first, rows = bars(50)
    days = spark.createDataFrame([(first + datetime.timedelta(days=i),) for i in range(50)], "day date")
    at = lambda i: first + datetime.timedelta(days=i)
    got = sorted(op.walk_forward_search(frame(spark, rows), days, 21, 10, ["fast"], metric="final_value").collect(), key=lambda r: r["window_id"])
    assert [r["train_start"] for r in got] == [at(0), at(10)]
    for r, a in zip(got, (0, 10), strict=True):
        train = [score(rows, t, at(a), at(a + 16)) for t in range(3)]  # int(20 * 0.8)
        best = train.index(max(train))
        assert r["trial"] == best and r["fast"] == best and r["train_score"] == pytest.approx(train[best])
        assert r["validation_score"] == pytest.approx(score(rows, best, at(a + 17), at(a + 20)))
        assert r["test_score"] == pytest.approx(score(rows, best, at(a + 21), at(a + 30)))
