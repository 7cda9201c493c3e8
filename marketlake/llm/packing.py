"""Harmonic packing of tokenised documents into sequences of at most ``capacity`` tokens."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.llm.encode import encoder
from marketlake.llm.shared import spread



class Bins:
    """The bins of one worker, by harmonic classes.

    A document gives whole capacities, each a full sequence, and a tail of r tokens. Class j holds the tails with
    capacity/(j+1) < r <= capacity/j, and a bin of it takes exactly j of them, so which bin a tail goes to depends on its
    length alone. The gap that j tails leave is less than capacity/(j+1): the next tail is cut once to fill it
    (or goes in whole), and only its remainder is classed. So at most one bin waits to be filled, and j + 1 documents make a
    full sequence. At the end the open bins, less than one for each class, are put together the same way; the last
    tokens, less than a capacity, make sequences whose lengths are powers of two. Nothing is padded.

    Pieces are (document, start, ids, tokens of the document).
    """

    def __init__(self, capacity: int, base: int) -> None:
        self.capacity, self.next = capacity, base
        self.open: dict[int, list[tuple]] = {}
        self.waiting: list[tuple] = []
        self.gap = 0

    def _sequence(self, pieces: list[tuple]) -> list[tuple]:
        out, at = [], 0
        for doc, start, ids, n in pieces:
            out.append((doc, start, len(ids), zlib.crc32(ids), n, self.next, at, ids))
            at += len(ids)
        self.next += 1
        return out

    def add(self, doc: int | None, ids: np.ndarray) -> list[tuple]:
        n, start, out = len(ids), 0, []
        while n - start >= self.capacity:
            out += self._sequence([(doc, start, ids[start : start + self.capacity], n)])
            start += self.capacity
        if start == n:
            return out
        if self.gap:
            own = min(self.gap, n - start)
            self.waiting.append((doc, start, ids[start : start + own], n))
            self.gap -= own
            start += own
            if not self.gap:
                out += self._sequence(self.waiting)
        if start < n:
            out += self._class(doc, start, ids, n)
        return out

    def _class(self, doc: int | None, start: int, ids: np.ndarray, n: int) -> list[tuple]:
        j = self.capacity // (n - start)
        own = self.open.setdefault(j, [])
        own.append((doc, start, ids[start:], n))
        if len(own) < j:
            return []
        del self.open[j]
        self.gap = self.capacity - sum(len(p[2]) for p in own)
        if self.gap:
            self.waiting = own
            return []
        return self._sequence(own)

    def close(self) -> list[tuple]:
        left = self.waiting if self.gap else []
        left = left + [p for j in sorted(self.open) for p in self.open[j]]
        total, out, at = sum(len(p[2]) for p in left), [], 0
        while total:
            size = room = min(self.capacity, 1 << (total.bit_length() - 1))
            total, own = total - size, []
            while room:
                doc, start, ids, n = left[at]
                own.append((doc, start, ids[:room], n))
                if len(ids) > room:
                    left[at] = doc, start + room, ids[room:], n
                else:
                    at += 1
                room -= len(own[-1][2])
            out += self._sequence(own)
        self.open, self.waiting, self.gap = {}, [], 0
        return out


def pack(
    docs: DataFrame,
    tokenizer: str,
    split: str | None,
    end_id: int = 0,
    capacity: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of all documents.

    A document is its token ids and ``end_id``. It is cut into whole capacities, and its tail goes to the bins of its
    harmonic class (``Bins``), at most cut once more to fill a bin's gap; ``capacity`` has to be a power of two. Every partition
    of the input fills bins of its own, with no shuffle and with state of under a bin a class; sequence ids carry the
    partition's number.

    A null or empty text is the end id alone. A null id stays null; equal rows are packed one by one. Other
    columns are ignored; an empty table gives no piece. A text of any length is streamed piece by piece.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def rows(found: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*found, strict=True))
        arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=False)]
        if with_ids:
            lengths = np.fromiter(map(len, cols[7]), dtype=np.int64, count=len(found))
            ends = np.append(0, np.cumsum(lengths)).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(cols[7]).astype(np.int32))))
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(capacity, TaskContext.get().partitionId() << 40)
        tool, found = encoder(tokenizer, split), []
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for at in range(0, len(texts), 64):
                some = batch.column(0).slice(at, 64).to_pylist()
                for doc, ids in zip(some, tool.encode(texts[at : at + 64]), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    found += bins.add(doc, ids)
                if len(found) > 8192:
                    yield rows(found)
                    found = []
        found += bins.close()
        if found:
            yield rows(found)

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return spread(picked, "id").mapInArrow(run, schema + (", ids array<int>" if with_ids else "")).withColumnRenamed("doc_id", id_col)
