"""Loading what is not loaded yet: each symbol's last day as a table beside the data, moved on by the same batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.sources.bars import incremental_window
from marketlake.sources.merge_table import MergeTable

SCHEMA = "symbol string, last_date date, batch long"


class Loader:
    """Bars of a source (symbol, date, ...) into a table by symbol and date, range by range.

    A batch loads, of each symbol asked for, the days after its last one. The data are merged before the progress, both under the number
    of the batch: a batch that was lost between the two comes again from the progress it first saw, adds nothing to the data and then moves the
    progress on, so each day is loaded once.
    """

    def __init__(self, spark: SparkSession, path: str, stream: str = "load") -> None:
        self.spark, self.stream = spark, stream
        self.data = MergeTable(spark, f"{path}/data", ["symbol", "date"], F.concat_ws("/", F.lit("day"), F.year("date")))
        self.progress = MergeTable(spark, f"{path}/progress", ["symbol"])

    def progress_table(self, version: int | None = None) -> DataFrame:
        """(symbol, last_date) so far."""
        if version == 0 or not self.progress.version():
            return self.spark.createDataFrame([], SCHEMA).select("symbol", "last_date")
        return self.progress.read(version).select("symbol", "last_date")

    def next_batch(self) -> int:
        return self.progress.last_batch(self.stream) + 1

    def load(self, source: DataFrame, symbols: DataFrame, start: str, end: str, batch: int | None = None) -> int:
        """Load the days of a range that the symbols do not have yet; the number of the batch."""
        number = self.next_batch() if batch is None else batch
        if number <= self.progress.last_batch(self.stream):
            return number
        windows = incremental_window(self.progress_table(), symbols.select("symbol").distinct(), start, end)
        rows = source.join(windows.select("symbol", F.col("start").alias("__from"), F.col("end").alias("__to")), "symbol")
        rows = rows.filter("date BETWEEN __from AND __to").drop("__from", "__to")
        self.data.merge(rows, self.stream, number)
        moved = rows.groupBy("symbol").agg(F.max("date").alias("last_date")).withColumn("batch", F.lit(number).cast("long"))
        self.progress.merge(moved, self.stream, number)
        return number

    def clear(self, symbols: DataFrame) -> int:
        """Forget the progress of symbols, so that the next batch loads them from its start."""
        number = self.next_batch()
        return self.progress.merge(symbols.select("symbol").distinct().select("symbol", F.lit(None).cast("date").alias("last_date"), F.lit(number).cast("long").alias("batch")), self.stream, number)
