"""Document quality by votes of the nearest labelled documents in a latent-semantic space.

Terms are hashed words, character trigrams and shapes of words, with shares of repeated words and lines as terms too.
Inverse document frequencies come from all documents. A bounded sample of the labelled documents gives the latent
space (a truncated singular value decomposition) and the voters; both are broadcast, their size being set by
parameters. Every document is compared with every voter by exact cosines, a block of documents at a time, and
the nearest vote with weights that grow with similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.llm.shared import spread

TERMS = 2048
_SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))


def terms(text: str | None) -> np.ndarray:
    """Counts of the TERMS hashed terms of one text."""
    out = np.zeros(TERMS, dtype=np.float32)
    if not text:
        out[0] = 1
        return out
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if n:
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=n)
        np.add.at(out, 1 + (hashes % np.uint64(TERMS // 2)).astype(np.int64), 1)
        shapes: dict[bytes, int] = {}
        for w in words:
            s = w.translate(_SHAPE)
            # a word's shape: its first kind of character, its last, and whether it is long
            key = s[:1] + s[-1:] + (b"+" if len(s) > 14 else b"")
            shapes[key] = shapes.get(key, 0) + 1
        for key, c in shapes.items():
            out[TERMS // 2 + 1 + xxhash.xxh3_64_intdigest(key) % (TERMS // 4)] += 4 * c
        distinct = len(np.unique(hashes))
        lines = [x for x in raw.split(b"\n") if x.strip()]
        again = np.unique(hashes[1:] ^ (hashes[:-1] << np.uint64(1))) if n > 1 else hashes
        upper = n - sum(w.islower() for w in words)
        shares = (1 - distinct / n, 1 - len(set(lines)) / max(1, len(lines)), 1 - len(again) / max(1, n - 1), upper / n)
        base = TERMS // 2 + 1 + TERMS // 4
        for i, share in enumerate(shares):
            # steps of a share, as terms that a text has all its words' worth of
            out[base + 16 * i + min(15, int(share * 16))] += 2 * n
        out[base + 80 + min(20, n.bit_length())] += n
    return out


def matrix(texts: list[str | None], idf: np.ndarray) -> np.ndarray:
    """Unit rows of weighted terms."""
    rows = np.stack([terms(t) for t in texts])
    rows = np.sqrt(rows) * idf
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """Over all documents, how many have each term; and how many documents there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(TERMS, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += terms(text) > 0
                n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1)), pa.array(np.append(total, n))], names=["term", "n"])

    found = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(TERMS + 1, dtype=np.int64)
    for term, n in found.collect():  # TERMS + 1 rows
        out[term] = n
    return out[:-1], int(out[-1])


def fit(labelled: DataFrame, idf: np.ndarray, text_col: str, label_col: str, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(projection, voters, labels) from a bounded sample of labelled documents."""
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("int").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = matrix(batch.column(0).to_pylist(), idf).astype(np.float16)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in vectors], pa.binary()), batch.column(1)], names=["v", "label"])

    got = rows.mapInArrow(run, "v binary, label int").toArrow()
    if not got.num_rows:
        return np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32)
    x = np.frombuffer(b"".join(got.column("v").to_pylist()), dtype=np.float16).reshape(-1, TERMS).astype(np.float32)
    y = got.column("label").to_numpy().astype(np.float32)
    values, vectors = np.linalg.eigh(x.T @ x)
    space = vectors[:, np.argsort(values)[::-1][:dims]].astype(np.float32)
    voters = x @ space
    return space, voters / np.maximum(np.linalg.norm(voters, axis=1, keepdims=True), 1e-9), y


def vote(texts: list[str | None], idf: np.ndarray, space: np.ndarray, voters: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    """Weighted share of label 1 among each text's k nearest voters; 0.5 where there are no voters."""
    if not len(voters):
        return np.full(len(texts), 0.5)
    own = matrix(texts, idf) @ space
    own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
    cosines = own @ voters.T
    k = min(k, len(voters))
    near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cosines, near, axis=1), 0.0) ** 8 + 1e-6
    return np.clip((weight * labels[near]).sum(axis=1) / weight.sum(axis=1), 0.0, 1.0)


def held_out(id_col: Column) -> Column:
    """Rows that labels are never learned from: crc32 of the id as text, modulo 4, is 2. False for a null id."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id: str = "doc_id",
    label_col: str = "quality",
    sample: int = 4000,
    dims: int = 64,
    k: int = 15,
    cutoff: float = 0.7,
) -> DataFrame:
    """One row for each row of ``docs``: (id, held_out, score, predicted).

    score is between 0 and 1, higher where label 1 is likelier; predicted is 1 from ``cutoff`` on. Labels are learned from
    at most ``sample`` labelled documents that are not held out, half of them of each label where there are as many: those
    whose ids have the least hashes. Null and empty texts have one term of their own and are scored like
    others. Rows without an id are scored but teach nothing; equal rows score alike; an id with labels of both kinds
    teaches the lower. Columns besides id and text are never read. Without labels every score is 0.5.
    """
    picked = spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), "id")
    counts, n = document_frequencies(picked, "text")
    idf = (np.log((1 + n) / (1 + counts)) + 0.1).astype(np.float32)
    marks = labels.select(F.col(label_id).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    marks = marks.filter("id is not null and label is not null").filter(~held_out(F.col("id"))).groupBy("id").agg(F.min("label").alias("label"))
    hashed = marks.withColumn("h", F.xxhash64("id"))
    half = [hashed.filter(F.col("label") == v).orderBy("h").limit(sample // 2) for v in (0, 1)]
    chosen = F.broadcast(half[0].unionByName(half[1]).drop("h"))  # at most ``sample`` rows of two numbers
    learned = picked.join(chosen, "id").dropDuplicates(["id"])
    space, voters, y = fit(learned, idf, "text", "label", dims)
    model = docs.sparkSession.sparkContext.broadcast((idf, space, voters, y))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            scores = np.concatenate([vote(texts[at : at + 256], *own, k) for at in range(0, len(texts), 256)]) if texts else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores.astype(np.float64))], names=["id", "score"])

    out = picked.mapInArrow(run, "id long, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))
