"""Rows of one key in order, more of them than are held at once."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd

from marketlake.streaming.live import LiveFactors
from marketlake.streaming.ordered import in_order


class Kept:
    """A value state as Spark gives it to a processor."""

    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def _ticks(n, seed=4):
    r = np.random.default_rng(seed)
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(r.integers(0, n // 3, n), "s")
    return pd.DataFrame({"ts": ts, "seq": r.permutation(n), "close": r.integers(1, 9, n) / 100})


def _cut(df, size):
    return iter([df.iloc[i : i + size] for i in range(0, len(df), size)])


def test_more_rows_than_are_held_come_in_order_and_leave_nothing_behind(tmp_path, monkeypatch):
    monkeypatch.setattr("tempfile.tempdir", str(tmp_path))
    df = _ticks(5000)
    for by in (["ts", "seq"], ["ts"]):
        found = list(in_order(_cut(df, 70), by, most=300))
        assert len(found) > 5 and max(map(len, found)) <= 700
        pd.testing.assert_frame_equal(pd.concat(found, ignore_index=True), df.sort_values(by, kind="stable", ignore_index=True))
    same = df.assign(ts=df["ts"].iloc[0])  # all of one time
    assert max(len(x) for x in in_order(_cut(same, 70), ["ts", "seq"], most=300)) <= 700
    assert list(in_order(iter([]), ["ts"])) == [] and os.listdir(tmp_path) == []


def test_factors_of_one_batch_pass_in_bounded_frames(monkeypatch):
    df = _ticks(4000)
    whole = LiveFactors("seq")
    whole.state = Kept()
    want = pd.concat(whole.handleInputRows(("x",), iter([df]), None), ignore_index=True)
    monkeypatch.setattr("marketlake.streaming.live.in_order", lambda rows, by: in_order(rows, by, most=250))
    parts = LiveFactors("seq")
    parts.state = Kept()
    found = list(parts.handleInputRows(("x",), _cut(df, 90), None))
    assert max(map(len, found)) <= 600
    pd.testing.assert_frame_equal(pd.concat(found, ignore_index=True), want)
    assert parts.state.value == whole.state.value
