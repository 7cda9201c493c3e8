"""Ingest of JSON bars as a stream, with its counts."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

from marketlake.sources.bars import parse_bar_json
from marketlake.sources.merge_table import MergeTable

COUNTS = ("received", "stored", "failed", "parse_errors")


class IngestCounters(StreamingQueryListener):
    """The counts that observed streams report, by name and batch; a batch that is run again counts once."""

    def __init__(self) -> None:
        self.batches: dict[tuple[str, int], dict[str, int]] = {}
        self.ended: set[str] = set()
        self.changed = threading.Condition()

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        for name, row in event.progress.observedMetrics.items():
            found = row.asDict()
            if set(COUNTS) <= found.keys():
                with self.changed:
                    self.batches[name, event.progress.batchId] = {c: found[c] or 0 for c in COUNTS}
                    self.changed.notify_all()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        with self.changed:
            self.ended.add(str(event.runId))
            self.changed.notify_all()

    def totals(self, name: str) -> dict[str, int]:
        with self.changed:
            return {c: sum(x[c] for (n, _), x in self.batches.items() if n == name) for c in COUNTS}

    def wait(self, query: StreamingQuery, seconds: float = 30.0) -> bool:
        """Wait until the end of a query has been told, and with it all its counts."""
        with self.changed:
            return self.changed.wait_for(lambda: str(query.runId) in self.ended, seconds)


def ingest_bars(lines: DataFrame, table: MergeTable, checkpoint: str, name: str = "ingest", trigger: dict | None = None) -> StreamingQuery:
    """A stream of JSON messages (value) merged into a table of bars by symbol and time. Messages that are no JSON are parse errors, JSON
    without a complete bar has failed; each micro-batch reports how many it received, stored, and did not, under ``name``."""
    parsed = parse_bar_json(lines)
    broken = F.from_json("value", "map<string,string>").isNull() | (F.size(F.from_json("value", "map<string,string>")) <= 0)
    parsed = parsed.withColumn("__broken", F.coalesce(broken, F.lit(True)))
    counts = [F.count("*"), F.count_if(F.expr("ok AND NOT __broken")), F.count_if(F.expr("NOT ok AND NOT __broken")), F.count_if("__broken")]
    seen = parsed.observe(name, *[c.alias(n) for c, n in zip(counts, COUNTS, strict=True)])

    def write(batch: DataFrame, number: int) -> None:
        table.merge(batch.filter("ok AND NOT __broken").drop("ok", "__broken", "value"), name, number)

    return seen.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
