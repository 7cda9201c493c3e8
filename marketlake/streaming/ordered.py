"""A key's rows in order, in frames of bounded size."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa


def _upto(columns: list[np.ndarray], key: tuple) -> int:
    """The number of rows of a sorted run that are not behind the key."""
    low, high = 0, len(columns[0])
    for c, x in zip(columns, key, strict=True):
        low, high = low + np.searchsorted(c[low:high], x, "left"), low + np.searchsorted(c[low:high], x, "right")
    return int(high)


def in_order(frames: Iterator[pd.DataFrame], by: list[str], most: int = 200_000) -> Iterator[pd.DataFrame]:
    """The rows of some frames sorted by ``by``, in frames of at most about twice ``most`` rows. More rows than ``most`` wait as sorted runs in
    the task's own temp folder; each frame takes from every run what comes up to a bound. Rows that are equal in all of ``by`` come together, in the order they came in."""
    with tempfile.TemporaryDirectory() as folder:
        runs, held, n = [], [], 0

        def keep() -> None:
            run = pa.RecordBatch.from_pandas(pd.concat(held, ignore_index=True).sort_values(by, kind="stable"), preserve_index=False)
            with pa.OSFile(f"{folder}/{len(runs)}", "wb") as file, pa.ipc.new_file(file, run.schema) as writer:
                writer.write_batch(run)
            runs.append(pa.ipc.open_file(pa.memory_map(f"{folder}/{len(runs)}")).get_batch(0))

        for frame in frames:
            if n and n + len(frame) > most:
                keep()
                held, n = [], 0
            held.append(frame)
            n += len(frame)
        if not runs:
            if held:
                yield pd.concat(held, ignore_index=True).sort_values(by, kind="stable", ignore_index=True)
            return
        keep()
        held = []
        keys = [[run.column(c).to_numpy(zero_copy_only=False) for c in by] for run in runs]
        every = max(1, most // len(runs))
        marks = sorted(tuple(c[i] for c in k) for k in keys for i in range(every - 1, len(k[0]), every))
        at = [0] * len(runs)
        for bound in [*marks[len(runs) - 1 :: len(runs)], None]:
            ends = [run.num_rows if bound is None else _upto(k, bound) for run, k in zip(runs, keys, strict=True)]
            parts = [run.slice(a, e - a).to_pandas() for run, a, e in zip(runs, at, ends, strict=True) if e > a]
            at = ends
            if parts:
                yield pd.concat(parts, ignore_index=True).sort_values(by, kind="stable", ignore_index=True)
