"""What the corpus operators share: scratch tables in the cluster's shared folder and word splitting."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master may go without it (tests); a cluster without a shared folder is an error,
    because scratch tables on one machine's disk would be lost with that machine.
    """
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="marketlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/marketlake-{uuid.uuid4().hex}/{name}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over all cores where it lies in so few files that most of them would idle; otherwise as it is. Rows move by ``key``."""
    cores, files = df.sparkSession.sparkContext.defaultParallelism, len(df.inputFiles())
    return df.repartition(cores, F.col(f"`{key}`")) if 0 < 2 * files <= cores else df


def spread_rows(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over all cores where its scan has so few splits that most of them would idle; otherwise as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < 2 * df.rdd.getNumPartitions() <= cores else df


_made: contextvars.ContextVar[list[DataFrame] | None] = contextvars.ContextVar("made", default=None)


@contextlib.contextmanager
def passing_tables() -> Iterator[None]:
    """Scratch tables that are made inside are deleted at the end, but for those to keep."""
    token = _made.set([])
    try:
        yield
    finally:
        discard(*(_made.get() or []))
        _made.reset(token)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to a scratch table in the shared folder and read it back: the lineage ends there, and the shuffle files that
    made the table are removed. Inside ``passing_tables`` the table goes at the end unless it is to ``keep``."""
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    if not keep and (made := _made.get()) is not None:
        made.append(table)
    return table


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing will read again; a folder that the driver can't reach stays."""
    for table in tables:
        for file in table.inputFiles()[:1]:
            folder = file.rsplit("/", 2)[0]  # one folder is one table
            with contextlib.suppress(OSError, pa.ArrowInvalid):
                where, name = fs.FileSystem.from_uri(folder)
                where.delete_dir(name)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``number``, from 0 in the order of the columns: ranges of it are sorted for themselves and start where earlier ones end."""
    parts = materialize(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), name)
    ends = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    starts = ends.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1  # one row a part is broadcast
    return parts.join(F.broadcast(starts), "__part").withColumn("number", F.col("__start") + inside).drop("__part", "__start")


def ascii_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) maximal runs of anything but space and \\x09-\\x0d, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, one for each."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (the finaliser constants of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit hash for each window of ``k`` consecutive values; order in the window matters."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n])
    return out
