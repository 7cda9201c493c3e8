"""Keyed tables that are merged into by batches: layers of Parquet files, and a log whose entries name the files of each version."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import StructType


class ConcurrentMerge(RuntimeError):
    """Another writer has taken the version; read the table again and merge anew."""


@dataclass
class _Version:
    version: int = 0
    parent: int = 0
    schema: str = ""
    #: By part the layers of files, oldest first; in the first one keys are distinct, in the others over each alone.
    parts: dict[str, list[list[str]]] = field(default_factory=dict)
    #: The last batch of each stream that is in the table.
    batches: dict[str, int] = field(default_factory=dict)
    batch: list = field(default_factory=list)


class MergeTable:
    """A table of rows by ``keys``; ``part`` is a function of the keys, a text such as frequency and year.

    A merge writes one more layer for the parts that its rows touch and nothing else; a part that would have more than ``fold`` layers is
    written anew instead. Of a key the row of the last merge counts, within one merge that of the greatest ``sequence``. A version is a
    list of files: a reader keeps the files of its version while others write, a job that fails or is repeated leaves files that no version
    names, and a batch of a stream is merged once however often it comes. A version number is claimed by a file that only one writer can make, and the
    entry of the log appears under its name when it is complete, so only single files are created or renamed and object stores will do.
    Files go through Spark's own file systems. The driver holds names of parts and files only.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], part: Column | None = None, sequence: str | None = None, fold: int = 8) -> None:
        self.spark, self.path, self.keys, self.sequence, self.fold = spark, path.rstrip("/"), keys, sequence, fold
        self.part = F.lit("all") if part is None else part
        self._jvm = spark.sparkContext._jvm
        self._fs = self._name("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # files
    def _name(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._name(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _create(self, name: str, text: str) -> None:
        stream = self._fs.create(self._name(name), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def _names(self, folder: str) -> list[str]:
        if not self._fs.exists(self._name(folder)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._name(folder)))

    # versions
    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names("log") if n.endswith(".json")]

    def _version(self, number: int | None = None) -> _Version:
        if number is None:
            number = max(self.versions(), default=0)
        return _Version(**json.loads(self._text(f"log/{number:012}.json"))) if number else _Version()

    def version(self) -> int:
        return max(self.versions(), default=0)

    def version_before(self, stream: str, batch: int) -> int:
        """The version that a batch was or would be merged into; so a repeated batch sees what it saw first."""
        now = self._version()
        if now.batches.get(stream, -1) < batch:
            return now.version
        while now.batch != [stream, batch]:
            if not now.parent:
                raise ValueError(f"batch {batch} of {stream} is in no version that is kept")
            now = self._version(now.parent)
        return now.parent

    def last_batch(self, stream: str) -> int:
        """The number of the last batch of a stream that is in the table; -1 if none is."""
        return self._version().batches.get(stream, -1)

    def version_with(self, stream: str, batch: int) -> int:
        """The last version with batches of the stream up to this one only."""
        now = self._version()
        while now.batches.get(stream, -1) > batch:
            now = self._version(now.parent)
        return now.version

    def _claim(self, number: int, owner: str) -> None:
        name = f"claims/{number:012}"
        try:
            self._create(name, owner)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            if self._text(name) != owner:
                raise ConcurrentMerge(f"version {number} is taken by {self._text(name)}") from e

    def release(self, number: int) -> None:
        """Give up the claim of a writer that is known to have ended without its version."""
        if number not in self.versions():
            self._fs.delete(self._name(f"claims/{number:012}"), False)

    def _commit(self, v: _Version) -> int:
        waiting = f"log/.{v.version:012}-{uuid.uuid4().hex}"
        self._create(waiting, json.dumps(asdict(v)))
        if v.version in self.versions() or not self._fs.rename(self._name(waiting), self._name(f"log/{v.version:012}.json")):
            self._fs.delete(self._name(waiting), False)
            if v.version not in self.versions():
                raise ConcurrentMerge(f"version {v.version} could not be put into the log")
        return v.version

    # rows
    def _layers(self, v: _Version, layers: dict[str, list[list[str]]]) -> DataFrame:
        """The rows of some parts with their merges' numbers; parts of one layer are read as they are."""
        schema = StructType.fromJson(json.loads(v.schema)).add("__merge", "long")
        read = lambda files: self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)
        single = read([f for own in layers.values() if len(own) == 1 for f in own[0]])
        several = [f for own in layers.values() if len(own) > 1 for layer in own for f in layer]
        if not several:
            return single
        w = Window.partitionBy(*self.keys).orderBy(F.col("__merge").desc())
        return single.unionByName(read(several).withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn"))

    def read(self, version: int | None = None, parts: list[str] | None = None) -> DataFrame:
        """The rows of a version, the last one if none is given, or of some of its parts."""
        v = self._version(version)
        if not v.schema:
            raise ValueError(f"no table at {self.path}")
        return self._layers(v, {k: x for k, x in v.parts.items() if parts is None or k in parts}).drop("__merge")

    def _write(self, rows: DataFrame) -> dict[str, list[str]]:
        """Write rows by part; AQE splits large parts and joins small ones. The files by part."""
        out = f"data/{uuid.uuid4().hex}"
        rows.withColumn("__part", self.part.cast("string")).hint("rebalance", F.col("__part")).write.partitionBy("__part").parquet(f"{self.path}/{out}")
        found, files = {}, self._fs.listFiles(self._name(out), True)
        while files.hasNext():
            file = files.next().getPath()
            if file.getName().endswith(".parquet"):
                found.setdefault(unquote(file.getParent().getName().removeprefix("__part=")), []).append(file.toString())
        return {k: sorted(x) for k, x in found.items()}

    def merge(self, changes: DataFrame, stream: str | None = None, batch: int = 0) -> int:
        """Merge rows in, as batch number ``batch`` of a stream if that is named; the version that has them."""
        now = self._version()
        if stream is not None and now.batches.get(stream, -1) >= batch:
            return now.version
        number = now.version + 1
        self._claim(number, f"{stream}:{batch}" if stream is not None else uuid.uuid4().hex)
        w = Window.partitionBy(*self.keys).orderBy(*([F.col(self.sequence).desc()] if self.sequence else [F.lit(1)]))
        last = changes.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn").withColumn("__merge", F.lit(number).cast("long"))
        layers = {k: [*now.parts.get(k, []), files] for k, files in self._write(last).items()}
        after = _Version(number, now.version, json.dumps(changes.schema.jsonValue()), now.parts | layers, now.batches, [])
        if stream is not None:
            after.batches, after.batch = now.batches | {stream: batch}, [stream, batch]
        self._fold(after, {k: x for k, x in layers.items() if len(x) > self.fold})
        return self._commit(after)

    def _fold(self, v: _Version, layers: dict[str, list[list[str]]]) -> None:
        if layers:
            v.parts = v.parts | {k: [files] for k, files in self._write(self._layers(v, layers)).items()}

    def compact(self) -> int:
        """A version of the same rows in which each part has one layer."""
        now = self._version()
        layers = {k: x for k, x in now.parts.items() if len(x) > 1}
        if not layers:
            return now.version
        self._claim(now.version + 1, uuid.uuid4().hex)
        after = _Version(now.version + 1, now.version, now.schema, now.parts, now.batches, [])
        self._fold(after, layers)
        return self._commit(after)

    def vacuum(self, keep: int = 10, hours: float = 24.0) -> int:
        """Delete what none of the last ``keep`` versions names and no merge of the last hours can be writing; readers of older versions
        lose their files. The number of folders deleted."""
        every = self.versions()
        held = {f.rsplit("/", 3)[-3] for n in every[-keep:] for layers in self._version(n).parts.values() for layer in layers for f in layer}
        for n in every[:-keep]:
            self._fs.delete(self._name(f"log/{n:012}.json"), False)
        before = (time.time() - 3600 * hours) * 1000
        gone = [n for n in self._names("data") if n not in held and self._fs.getFileStatus(self._name(f"data/{n}")).getModificationTime() < before] if every else []
        for n in gone:
            self._fs.delete(self._name(f"data/{n}"), True)
        return len(gone)
