"""Token ids of documents in raw shard files, addressed by key through minimal perfect hash functions.

Layout of a store, all in one folder that every executor can reach:

    ids-00007.bin    the ids of a shard's documents one after the other, little-endian uint16 or uint32
    ends-00007.bin   uint64: where each document of the shard ends, counted in ids
    index-00003.npz  of the keys of a bucket: a minimal perfect hash and, by its value, the key's entry
    manifest.json    width of an id, number of ids of each shard, number of buckets
"""

from __future__ import annotations

import io
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.llm.encode import encoder
from marketlake.llm.shared import mix64

_SEED = 0x9E3779B97F4A7C15


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"file://{path}")


def _put(path: str, data: bytes) -> None:
    """Write a file at once or not at all: a task that is lost or runs twice leaves no half of it."""
    where, name = _open(path)
    own = f"{name}.{uuid.uuid4().hex}"
    with where.open_output_stream(own) as f:
        f.write(data)
    where.move(own, name)


def _get(path: str) -> bytes:
    where, name = _open(path)
    with where.open_input_file(name) as f:
        return f.read()


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: a cascade of bit arrays.

    A key sits at the first level where no other key of that level meets its slot; its value is the number
    of bits set before that slot, so the n keys get 0..n-1. Slots take about 3.5 bits a key and a
    look-up reads one bit a level, 1.6 levels on average. Keys beyond the last level, none in practice, are listed.
    """

    GAMMA, LEVELS = 2.0, 48

    def __init__(self, sizes: np.ndarray, words: np.ndarray, rest: np.ndarray) -> None:
        self.sizes, self.words, self.rest = sizes, words, rest
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])

    @staticmethod
    def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(keys + np.uint64(_SEED * (level + 1) % 2**64)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, parts, left = [], [], keys
        while len(left) and len(sizes) < cls.LEVELS:
            size = (int(len(left) * cls.GAMMA) // 64 + 1) * 64
            slot = cls._slot(left, len(sizes), size)
            alone = np.bincount(slot, minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[slot]]
        words = np.concatenate(parts) if parts else np.empty(0, dtype="<u8")
        return cls(np.array(sizes, dtype=np.int64), words, np.sort(left))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """0..n-1 for the keys it was built from; any value, or -1, for others."""
        out = np.full(len(keys), -1, dtype=np.int64)
        open_, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            slot = self._slot(keys[open_], level, int(size)) + base
            word, bit = slot >> 6, (slot & 63).astype(np.uint64)
            hit = (self.words[word] >> bit & np.uint64(1)).astype(bool)
            low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            rank = self.before[word] + np.bitwise_count(low).astype(np.int64)
            out[open_[hit]] = rank[hit]
            open_, base = open_[~hit], base + int(size)
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            found = self.rest[at] == keys[open_]
            out[open_[found]] = self.before[-1] + at[found]
        return out


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


def write_store(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    split: str | None,
    end_id: int,
    width: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    keys_per_bucket: int = 250_000,
) -> TokenStore:
    """Encode whole texts and write them in ascending order of id, then index every id.

    A null or empty text is ``end_id`` alone. A row without an id has no address and is left out. Rows that share an id
    stand together and are addressed together. Other columns are ignored; an empty table gives a store
    without entries. Texts are streamed one at a time, so a shard of any size needs memory for its longest text only.
    """
    spark = docs.sparkSession
    kind = {2: "<u2", 4: "<u4"}[width]
    picked = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    ordered = picked.filter("key is not null").repartitionByRange("key").sortWithinPartitions("key", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tool, size, ordinal, ends = TaskContext.get().partitionId(), encoder(tokenizer, split), 0, 0, []
        where, name = _open(f"{path}/ids-{shard:05d}.bin")
        own = f"{name}.{uuid.uuid4().hex}"
        with where.open_output_stream(own) as out:
            for batch in batches:
                texts = [t or "" for t in batch.column(1).to_pylist()]
                for at in range(0, len(texts), 64):
                    for ids in tool.encode(texts[at : at + 64]):
                        if len(ids) and int(ids.max()) >> 8 * width:
                            raise ValueError(f"an id needs more than {width} bytes")
                        out.write(np.append(ids, np.uint32(end_id)).astype(kind).tobytes())
                        size += len(ids) + 1
                        ends.append(size)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(n, shard)), pa.array(np.arange(ordinal, ordinal + n)), pa.array(np.array(ends[ordinal:], dtype=np.int64))],
                    names=["key", "shard", "ordinal", "until"],
                )
                ordinal += n
        where.move(own, name)
        _put(f"{path}/ends-{shard:05d}.bin", np.array(ends, dtype="<u8").tobytes())

    where, name = _open(path)
    where.create_dir(name, recursive=True)
    spark_path = f"{path}/directory"
    ordered.mapInArrow(write, "key long, shard long, ordinal long, until long").write.parquet(spark_path)
    directory = spark.read.schema("key long, shard long, ordinal long, until long").parquet(spark_path)
    shards = {r[0]: r[1] for r in directory.groupBy("shard").agg(F.max("until")).collect()}  # a row for each shard
    entries = directory.groupBy("key").agg(F.min("shard").alias("shard"), F.min("ordinal").alias("ordinal"), F.count("*").alias("rows"))
    buckets = max(1, -(-directory.count() // keys_per_bucket))
    entries = entries.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))

    def index(group: pa.Table) -> pa.Table:
        keys = group.column("key").to_numpy().view(np.uint64)
        func = PerfectHash.build(keys)
        at, cols = func.find(keys), {}
        for column, dtype in (("shard", np.uint32), ("ordinal", np.uint32), ("rows", np.uint32)):
            cols[column] = np.empty(len(keys), dtype=dtype)
            cols[column][at] = group.column(column).to_numpy()
        prints = np.empty(len(keys), dtype=np.uint32)
        prints[at] = _fingerprint(keys)
        data = io.BytesIO()
        np.savez(data, sizes=func.sizes, words=func.words, rest=func.rest, prints=prints, **cols)
        bucket = group.column("bucket")[0].as_py()
        _put(f"{path}/index-{bucket:05d}.npz", data.getvalue())
        return pa.table({"bucket": [bucket], "keys": [len(keys)]})

    indexed = entries.groupBy("bucket").applyInArrow(index, "bucket long, keys long").agg(F.sum("keys")).first()[0]
    manifest = {"width": width, "buckets": buckets, "keys": indexed or 0, "shards": sorted(shards.items())}
    _put(f"{path}/manifest.json", json.dumps(manifest).encode())
    return TokenStore(spark, path)


class TokenStore:
    """A store that was written: keyed access to the ids of documents."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.manifest = json.loads(_get(f"{path}/manifest.json"))

    def find(self, keys: DataFrame, key_col: str) -> DataFrame:
        """(key, shard, ordinal, rows) of those distinct keys that the store has, by its perfect hashes.

        A key that was never stored passes its fingerprint with a probability of 2^-32.
        """
        path, buckets = self.path, self.manifest["buckets"]
        if not self.manifest["keys"]:
            return keys.select(F.col(key_col).cast("long").alias("key")).limit(0).selectExpr("key", "0L shard", "0L ordinal", "0L `rows`")
        asked = keys.select(F.col(key_col).cast("long").alias("key")).filter("key is not null").distinct()
        asked = asked.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))

        def look(group: pa.Table) -> pa.Table:
            with np.load(io.BytesIO(_get(f"{path}/index-{group.column('bucket')[0].as_py():05d}.npz"))) as f:
                func, prints = PerfectHash(f["sizes"], f["words"], f["rest"]), f["prints"]
                own = {c: f[c] for c in ("shard", "ordinal", "rows")}
            keys = group.column("key").to_numpy().view(np.uint64)
            at = func.find(keys)
            here = at >= 0
            here[here] = prints[at[here]] == _fingerprint(keys[here])
            cols = {c: own[c][at[here]].astype(np.int64) for c in own}
            return pa.table({"key": keys[here].view(np.int64), **cols})

        return asked.groupBy("bucket").applyInArrow(look, "key long, shard long, ordinal long, rows long")

    def read(self, keys: DataFrame, key_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
        """One row for each stored document of the keys: (key, start, n_tokens, ids_crc32[, ids]).

        start counts the ids of all documents before it in the whole store; ids_crc32 is of the ids as
        little-endian unsigned 32-bit integers.
        """
        path, width = self.path, self.manifest["width"]
        base, total = {}, 0
        for shard, size in self.manifest["shards"]:
            base[shard], total = total, total + size
        names = [key_col, "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

        def fetch(table: pd.DataFrame) -> Iterator[tuple]:
            for shard, own in table.groupby("shard", sort=True):
                ends = np.frombuffer(_get(f"{path}/ends-{shard:05d}.bin"), dtype="<u8").astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                where, name = _open(f"{path}/ids-{shard:05d}.bin")
                with where.open_input_file(name) as f:
                    for key, first, rows in zip(own["key"], own["ordinal"], own["rows"], strict=True):
                        for o in range(first, first + rows):
                            n = int(ends[o] - starts[o])
                            ids = np.frombuffer(f.read_at(n * width, int(starts[o]) * width), dtype=f"<u{width}").astype("<u4")
                            yield key, base[shard] + int(starts[o]), n, zlib.crc32(ids), ids

        def run(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for table in tables:
                found = []
                for row in fetch(table):
                    found.append(row)
                    if len(found) == 4096:
                        yield pd.DataFrame(found, columns=[*names[:4], "ids"])[names]
                        found = []
                if found:
                    yield pd.DataFrame(found, columns=[*names[:4], "ids"])[names]

        at = self.find(keys, key_col).repartitionByRange("shard", "ordinal").sortWithinPartitions("shard", "ordinal")
        schema = f"`{key_col}` long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
        return at.mapInPandas(run, schema)
