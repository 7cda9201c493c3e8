"""Mixing sources to target weights by weighted fair queueing: documents get virtual finish times, are sorted by them over all sources and cut at the total."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from marketlake.llm.shared import materialize, numbered, passing_tables, spread_rows

WORDS = r"[^\x20\x09-\x0D]+"
_KEY_BITS = 60


def _targets(sizes: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    """(none, source, source_size, target, quota) for each source: shares of the total by weight, at most ``most`` times a source's size.

    What sources have above that is dealt again by weight until none is above: each round is one sum over the table of sources, so two
    numbers are all that the driver holds.
    """
    every = numbered(sizes.groupBy("none", "source").agg(F.sum("size").alias("source_size")), ["none", "source"], "sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    every = materialize(every.select("none", "source", "source_size", (most * F.col("source_size")).alias("cap"), weight.alias("weight")), "weighted")
    total, open_weight = every.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    left = total
    exact = lambda x: F.lit(x).cast("decimal(28,0)") if isinstance(x, int) else F.lit(float(x))
    capped = F.lit(False)
    while open_weight:
        capped = F.col("cap").cast("decimal(20,0)") * exact(open_weight).cast("decimal(18,6)") < exact(left).cast("decimal(20,0)") * F.col("weight").cast("decimal(18,6)")
        held, rest = every.agg(F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0))).first()
        if (total - held, rest) == (left, open_weight):
            break
        left, open_weight = total - held, rest
    share = F.col("weight").cast("double") * float(left) / float(open_weight or 1)
    target = F.when(capped, F.col("cap").cast("double")).otherwise(share)
    return every.select("none", "source", "source_size", target.alias("target"), F.when(capped, F.col("cap")).otherwise(F.ceil(share)).cast("long").alias("quota"), F.lit(total).cast("long").alias("total"))


def mixture(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), most: int = 3, seed: int = 13, unit: str = WORDS, rows: int = 100_000
) -> tuple[DataFrame, DataFrame]:
    """Two tables: (id, size, source_size, target, taken) of each row of ``docs``, and the mix (position, id, source, epoch, words) with the words before each.

    Sources in the order of their code points, null last, weigh ``weights`` in turn and share the sum of all sizes; no document is
    taken more than ``most`` times. Each source's documents are shuffled by a hash of seed and id and run through again and again; the
    one at which a source reaches its target is cut there. A document's virtual finish time is the source's words so far by its target,
    so in any stretch of the sorted mix sources have shares like their targets. The mix ends where its total is the sum of
    all sizes. Running sums have two levels: slices of the hash (of equal length, so of like size even where one source has most of
    the rows) and, over all sources, slices of virtual time (of equal words); a slice is to hold about ``rows`` documents. Only ids, sources
    and sizes are shuffled. Null or empty texts have size 0 and are not taken; rows without an id are shuffled as one; of equal rows each is
    a document; an empty table gives empty tables. Nothing depends on partitions, so reruns agree. Other columns, whatever their names, are not carried.
    """
    if not weights or min(weights) <= 0 or most < 1:
        raise ValueError("weights must be positive and documents taken once at least")
    with passing_tables():
        own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
        hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
        sizes = spread_rows(own).select(
            "id", F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("source"), F.regexp_count("text", F.lit(unit)).cast("long").alias("size"),
            F.conv(F.substring(hashed, 1, _KEY_BITS // 4), 16, 10).cast("long").alias("key"),
        )
        sizes = materialize(sizes, "sizes")
        bits = max(8, (sizes.count() // rows).bit_length())
        sizes = sizes.withColumn("slice", F.shiftright("key", _KEY_BITS - bits))
        slices = materialize(sizes.groupBy("none", "source", "slice").agg(F.sum("size").alias("size")), "slices")
        targets = _targets(slices, weights, most)
        earlier = Window.partitionBy("none", "source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        starts = slices.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0))).drop("size").join(targets, ["none", "source"])
        w = Window.partitionBy("none", "source", "slice").orderBy("key", "id", "size")
        placed = sizes.join(starts, ["none", "source", "slice"]).withColumn("row", F.row_number().over(w))
        placed = placed.withColumn("start", F.col("before") + F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).drop("before")
        placed = materialize(placed, "placed", keep=True)

        copies = placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("epoch"))
        begin = F.col("epoch") * F.col("source_size") + F.col("start")
        copies = copies.withColumn("words", F.least("size", F.col("quota") - begin)).filter("words > 0").withColumn("finish", (begin + F.col("words")) / F.col("target"))
        copies = copies.withColumn("time", F.least(F.floor(F.col("finish") * 2**bits), F.lit(2**bits)))  # slices of virtual time
        times = copies.groupBy("time").agg(F.sum("words").alias("words"))
        offsets = times.select("time", F.coalesce(F.sum("words").over(Window.orderBy("time").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("position"))  # one row a slice
        t = Window.partitionBy("time").orderBy("finish", "none", "source", "epoch", "key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
        order = copies.join(offsets, "time").withColumn("position", F.col("position") + F.sum("words").over(t) - F.col("words"))
        order = order.withColumn("words", F.least("words", F.col("total") - F.col("position"))).filter("words > 0")
        order = materialize(order.select("none", "source", "slice", "row", "id", "epoch", "position", "words"), "mix", keep=True)
    mine = ["none", "source", "slice", "row"]
    taken = placed.select(*mine, "id", "size", "source_size", "target", F.lit(0).cast("long").alias("words")).unionByName(order.select(*mine, "words"), allowMissingColumns=True)
    per_row = taken.groupBy(*mine).agg(*[F.max(c).alias(c) for c in ("id", "size", "source_size", "target")], F.sum("words").alias("taken"))
    mix = order.select("position", F.col("id").alias(id_col), F.when(~F.col("none"), F.col("source")).alias("source"), "epoch", "words")
    return per_row.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken"), mix
