"""Recomputing only what a change of bars touches: the dependent nodes of a factor graph, over the rows that the change reaches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from marketlake.plans.graph import apply_factor_graph
from marketlake.plans.spec import dependents, lookback, reaches
from marketlake.sources.merge_table import MergeTable

KEYS = ["symbol", "ts"]


def factor_rows(bars: DataFrame, spec: list[dict], nodes: list[str] | None = None, extra: dict | None = None) -> DataFrame:
    """(factor, symbol, ts, value) of all rows of bars."""
    names = [n["id"] for n in spec if nodes is None or n["id"] in nodes]
    return apply_factor_graph(bars, spec, extra).select(*KEYS, *[F.col(n).cast("double").alias(n) for n in names]).unpivot(KEYS, names, "factor", "value").select("factor", *KEYS, "value")


def changes(old: DataFrame, new: DataFrame, fields: list[str]) -> DataFrame:
    """The rows of ``new`` that differ from ``old``, with a flag ``changed_<field>`` for each field; a row that is not in old differs in all."""
    before = old.select(*KEYS, F.lit(True).alias("__old"), *[F.col(f).alias(f"__old_{f}") for f in fields])
    both = new.join(before, KEYS, "left")
    flags = {f"changed_{f}": F.col("__old").isNull() | ~F.col(f).eqNullSafe(F.col(f"__old_{f}")) for f in fields}
    both = both.withColumns(flags).drop("__old", *[f"__old_{f}" for f in fields])
    return both.filter(" OR ".join(f"`changed_{f}`" for f in fields))


def reached(bars: DataFrame, changed: DataFrame, ahead: int, back: int) -> DataFrame:
    """(symbol, ts, segment, distance): the rows up to ``ahead`` rows behind a changed one, with their distance from the last such, and
    those up to ``back`` rows before these, without. Rows that follow each other share a segment. Only keys of symbols that changed are sorted."""
    keys = bars.select(*KEYS).join(changed.select("symbol").distinct(), "symbol", "left_semi").withColumn("__c", F.lit(False))
    keys = keys.unionByName(changed.select(*KEYS, F.lit(True).alias("__c"))).groupBy(*KEYS).agg(F.max("__c").alias("__c"))
    w = Window.partitionBy("symbol").orderBy("ts")
    rows = keys.withColumn("__i", F.row_number().over(w))
    rows = rows.withColumn("distance", F.col("__i") - F.last(F.when(F.col("__c"), F.col("__i")), True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("distance", F.when(F.col("distance") <= ahead, F.col("distance")))
    next_one = F.first(F.when(F.col("distance").isNotNull(), F.col("__i")), True).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("__need", F.coalesce(next_one - F.col("__i") <= back, F.lit(False)))
    begins = F.col("__need") & ~F.coalesce(F.lag("__need").over(w), F.lit(False))
    rows = rows.withColumn("segment", F.sum(begins.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter("__need").select(*KEYS, "segment", "distance")


def recompute_rows(bars: DataFrame, changed: DataFrame, spec: list[dict], fields: set[str], stored: DataFrame | None = None, extra: dict | None = None, extra_reach: dict | None = None) -> DataFrame:
    """(factor, symbol, ts, value) of the nodes that depend on the changed fields, for the rows that the changed rows reach.

    Each node is written as far as its own windows reach; means with a memory without end count as far as a double tells. Nodes that do not depend on
    the fields are read from ``stored`` where others need them. Bars are read over the reached rows and the lookback before them, each such
    stretch computed for itself, with the same node functions as the whole graph. Inputs are taken to have no nulls inside a stretch.
    """
    nodes, far = set(dependents(spec, fields)), reaches(spec, fields, extra_reach)
    mine = [n for n in spec if n["id"] in nodes]
    ids = {n["id"] for n in spec}
    inputs = sorted({i for n in mine for i in n["inputs"]} & ids - nodes)
    if inputs and stored is None:
        raise ValueError(f"stored values of {inputs} are needed")
    where = reached(bars, changed, max(far.values()), lookback(spec, nodes, set(inputs), extra_reach))
    raw = sorted({i for n in mine for i in n["inputs"]} - ids)
    rows = bars.select(*KEYS, *raw).join(where, KEYS)
    if inputs:
        known = stored.filter(F.col("factor").isin(inputs)).join(where.select(*KEYS), KEYS, "left_semi")
        rows = rows.join(known.groupBy(*KEYS).pivot("factor", inputs).agg(F.first("value")), KEYS, "left")
    rows = rows.withColumn("symbol", F.struct("symbol", "segment"))
    out = apply_factor_graph(rows, mine, extra).filter("distance IS NOT NULL").withColumn("symbol", F.col("symbol.symbol"))
    out = out.select(*KEYS, "distance", *[F.col(n["id"]).cast("double").alias(n["id"]) for n in mine])
    out = out.unpivot([*KEYS, "distance"], [n["id"] for n in mine], "factor", "value")
    own = F.create_map(*[F.lit(x) for n in mine for x in (n["id"], far[n["id"]])])
    return out.filter(F.col("distance") <= F.element_at(own, F.col("factor"))).select("factor", *KEYS, "value")


def keep_factors(bars: MergeTable, factors: MergeTable, spec: list[dict], fields: list[str], stream: str = "bars", extra: dict | None = None, extra_reach: dict | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: merges a batch of bars, then the factor rows that its changes touch.

    A batch is held against the bars as they were before it, also when it comes again after one of the two merges: each of them counts once. Which
    fields changed is the only thing that the driver looks at; bars that come as they are change nothing.
    """

    def run(batch: DataFrame, number: int) -> None:
        before = bars.version_before(stream, number)
        version = bars.merge(batch, stream, number)
        if factors.version_before(stream, number) != factors.version():
            return
        now = bars.read(version)
        new = now.join(batch.select(*KEYS).distinct(), KEYS, "left_semi").select(*KEYS, *fields)  # as it was stored
        old = bars.read(before) if before else new.limit(0)
        found = changes(old.join(new.select(*KEYS), KEYS, "left_semi"), new, fields)
        flags = found.agg(*[F.coalesce(F.max(f"changed_{f}"), F.lit(False)).alias(f) for f in fields]).first()
        changed = {f for f in fields if flags[f]}
        if not dependents(spec, changed):
            return
        stored = factors.read() if factors.version() else None
        factors.merge(recompute_rows(now, found.select(*KEYS), spec, changed, stored, extra, extra_reach), stream, number)

    return run
