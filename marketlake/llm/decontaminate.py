"""Benchmark passages in documents, by a prefix-filtered join of word windows.

A window of an item is found where all its words stand in a row. Its shingles (three words each) are ordered by how
often all documents together hold them; a document that contains the window contains its rarest shingle, so that one is
the prefix on which windows and documents are joined. A match fixes where the window would start; it is dropped if
the window would not fit into the document there, and else every word is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.llm.shared import hash_windows, hash_words, materialize, spread

#: All ASCII characters but 0-9 and a-z become spaces; A-Z are lower-cased before.
_TABLE = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def item_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class Windows:
    """The windows of a block of items: hashes of their words and, after ``order``, their prefix shingles."""

    def __init__(self, items: list[tuple[int, str | None]], window: int, shingle: int) -> None:
        self.words: list[list[bytes]] = []
        self.ids: list[int] = []
        self.shingle = shingle
        spans, shingles = [], []
        for item, text in items:
            words = item_words(text)
            if not words:
                continue
            at, size = len(self.words), min(window, len(words))
            self.words.append(words)
            self.ids.append(item)
            k = min(shingle, size)
            hashes = hash_windows(hash_words(words), k)
            for start in range(len(words) - size + 1):
                spans.append((at, start, size, k))
                shingles.append(hashes[start : start + size - k + 1])
        self.spans, self._shingles = spans, shingles
        self.sizes = sorted({s[3] for s in spans})

    def vocabulary(self) -> np.ndarray:
        return np.unique(np.concatenate(self._shingles)) if self._shingles else np.empty(0, dtype=np.uint64)

    def order(self, counts: dict[int, int]) -> None:
        """Choose each window's rarest shingle (the first of equals) as its prefix."""
        by: dict[int, list[tuple[int, int, int, int]]] = {}
        for (item, start, size, _), hashes in zip(self.spans, self._shingles, strict=True):
            offset = min(range(len(hashes)), key=lambda i: (counts.get(int(hashes[i]), 0), i))
            by.setdefault(int(hashes[offset]), []).append((item, start, size, offset))
        self.prefix = np.array(sorted(by), dtype=np.uint64)
        self.at = [by[int(h)] for h in self.prefix]

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[int]]:
        """Disjoint (start, end) of the words inside occurrences, and the items that occur."""
        hashes, n = hash_words(words), len(words)
        hits, items = set(), set()
        for k in self.sizes:
            own = hash_windows(hashes, k)
            where = np.minimum(np.searchsorted(self.prefix, own), len(self.prefix) - 1)
            for pos in np.flatnonzero(self.prefix[where] == own):
                for item, start, size, offset in self.at[where[pos]]:
                    lo = int(pos) - offset
                    if lo < 0 or lo + size > n or (lo, size, item) in hits:
                        continue
                    if words[lo : lo + size] == self.words[item][start : start + size]:
                        hits.add((lo, size, item))
                        items.add(self.ids[item])
        spans: list[tuple[int, int]] = []
        for lo, size, _ in sorted(hits):
            if spans and lo <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(spans[-1][1], lo + size))
            else:
                spans.append((lo, lo + size))
        return spans, sorted(items)


def _count(docs: DataFrame, blocks: list, sizes: list[int]) -> DataFrame:
    """(shingle, count) over all documents, of the shingles that the items of a block hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = blocks[0].value.vocabulary()
        total = np.zeros(len(vocabulary), dtype=np.int64)
        for batch in batches:
            for text in batch.column(1).to_pylist():
                hashes = hash_words(item_words(text))
                for k in sizes:
                    own = hash_windows(hashes, k)
                    if len(own):
                        at = np.minimum(np.searchsorted(vocabulary, own), len(vocabulary) - 1)
                        np.add.at(total, at[vocabulary[at] == own], 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(vocabulary[some].view(np.int64)), pa.array(total[some])], names=["shingle", "count"])

    return docs.mapInArrow(run, "shingle long, count long").groupBy("shingle").agg(F.sum("count").alias("count"))


def _blocks(picked: DataFrame, benchmark: DataFrame, item_col: str, item_text: str, window: int, shingle: int, block_chars: int) -> tuple[int, Iterator]:
    """How many blocks of items there are, and of each its windows, ordered and broadcast. picked: (id, text)."""
    spark = picked.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).filter("item is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // block_chars))

    def each() -> Iterator:
        for number in range(n_blocks):
            own = items.filter(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == number)
            windows = Windows(sorted((r[0], r[1] or "") for r in own.collect()), window, shingle)
            if windows.spans:
                whole = spark.sparkContext.broadcast(windows)
                windows.order({r[0] % 2**64: r[1] for r in _count(picked, [whole], windows.sizes).collect()})
            yield spark.sparkContext.broadcast(windows)

    return n_blocks, each()


def remove(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    shingle: int = 3,
    block_chars: int = 16_000_000,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window of an item occurs; judged in place."""
    picked = docs.select(F.lit(None).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    at = docs.columns.index(text_col)
    for ordered in _blocks(picked, benchmark, item_col, item_text, window, shingle, block_chars)[1]:

        def run(batches: Iterator[pa.RecordBatch], ordered=ordered) -> Iterator[pa.RecordBatch]:
            w = ordered.value
            for batch in batches:
                words = map(item_words, batch.column(at).cast(pa.string()).to_pylist())
                yield batch.filter(pa.array([not (x and w.spans and w.find(x)[0]) for x in words], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    shingle: int = 3,
    block_chars: int = 16_000_000,
) -> DataFrame:
    """One row for each row of ``docs``: (id, n_words, n_hit, items, spans).

    spans are the disjoint [start, end) word positions inside any occurrence of a window of an item, n_hit the words in
    them, items the ids of the items with occurring windows in ascending order. Items of fewer words than a
    window are one window. Null and empty texts have no words, hit nothing and contain nothing; items without an id
    are left out, equal items are one. Rows without an id and equal rows are judged one by one. Other columns
    are ignored. An empty benchmark gives no hits.

    Items are broadcast in blocks of at most about ``block_chars`` characters; the usual benchmark is one block.
    With more blocks every block passes over the documents, and a document's rows meet by a row key.
    """
    picked = spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), "id")
    n_blocks, blocks = _blocks(picked, benchmark, item_col, item_text, window, shingle, block_chars)
    if n_blocks > 1:
        picked = materialize(picked.withColumn("row", F.monotonically_increasing_id()), "rows").select("id", "text", "row")
    found = None
    for ordered in blocks:

        def run(batches: Iterator[pa.RecordBatch], ordered=ordered) -> Iterator[pa.RecordBatch]:
            w = ordered.value
            for batch in batches:
                n, spans, hit = [], [], []
                for text in batch.column(1).to_pylist():
                    words = item_words(text)
                    s, i = w.find(words) if words and w.spans else ([], [])
                    n.append(len(words))
                    spans.append([{"start": a, "end": b} for a, b in s])
                    hit.append(i)
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(hit, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*arrays, *batch.columns[2:]], names=["id", "n_words", "spans", "items", *batch.schema.names[2:]])

        schema = "id long, n_words long, spans array<struct<start:long,end:long>>, items array<long>" + ", row long" * (n_blocks > 1)
        part = picked.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    assert found is not None
    if n_blocks > 1:
        found = found.groupBy("row").agg(
            F.first("id").alias("id"), F.first("n_words").alias("n_words"),
            F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        ).drop("row").withColumn("spans", F.expr(
            "aggregate(spans, cast(array() as array<struct<start:bigint,end:bigint>>), (a, s) -> if(size(a) > 0 and s.start <= element_at(a, -1).end, "
            "concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, s.end)))), concat(a, array(s))))"
        ))
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(F.col("id").alias(id_col), "n_words", hits.alias("n_hit"), "items", "spans")
