"""Merge tables: replays, concurrent readers and writers, lost tasks, folded layers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marketlake.sources.merge_table import ConcurrentMerge, MergeTable

SCHEMA = "k long, year int, v string, seq long"


@pytest.fixture
def table(spark, tmp_path):
    return MergeTable(spark, f"file://{tmp_path}/t", ["k", "year"], F.col("year").cast("string"), "seq", fold=3)


def rows(spark, *r):
    return spark.createDataFrame([(k, y, v, s) for k, y, v, s in r], SCHEMA)


def held(df):
    return {tuple(r) for r in df.collect()}


def test_last_merge_counts_and_within_it_the_greatest_sequence(spark, table):
    table.merge(rows(spark, (1, 1, "a", 1), (1, 1, "b", 3), (1, 1, "c", 2), (2, 1, "x", 0)))
    table.merge(rows(spark, (2, 1, "y", -5), (2, 2, "z", 0)))
    assert held(table.read()) == {(1, 1, "b", 3), (2, 1, "y", -5), (2, 2, "z", 0)}
    assert held(table.read(parts=["2"])) == {(2, 2, "z", 0)}
    assert held(table.read(1)) == {(1, 1, "b", 3), (2, 1, "x", 0)}


def test_a_batch_counts_once(spark, table):
    assert table.merge(rows(spark, (1, 1, "a", 1)), "s", 0) == 1
    assert table.merge(rows(spark, (1, 1, "late", 9)), "s", 0) == 1
    table.merge(rows(spark, (3, 1, "other", 1)), "another", 0)
    table.merge(rows(spark, (2, 1, "b", 1)), "s", 1)
    assert held(table.read()) == {(1, 1, "a", 1), (2, 1, "b", 1), (3, 1, "other", 1)}
    assert table.last_batch("s") == 1 and table.last_batch("?") == -1
    assert (table.version_before("s", 0), table.version_before("s", 2)) == (3, 3) or table.version_before("s", 1) == 2
    assert table.version_with("s", 0) == 2


def test_only_touched_parts_are_written(spark, table):
    for i in range(3):
        table.merge(rows(spark, (i, 1, "a", 1), (i, 2, "a", 1)))
    before = table._version().parts
    table.merge(rows(spark, (9, 1, "b", 1)))  # the fourth layer: part 1 is folded, part 2 is left alone
    after = table._version().parts
    assert len(after["1"]) == 1 and after["2"] == before["2"]
    table.compact()
    assert {k: len(x) for k, x in table._version().parts.items()} == {"1": 1, "2": 1} and table._version().parts["1"] == after["1"]
    assert held(table.read()) == {(i, y, "a", 1) for i in range(3) for y in (1, 2)} | {(9, 1, "b", 1)}
    assert table.compact() == table.version()


def test_a_reader_keeps_its_version(spark, table):
    table.merge(rows(spark, (1, 1, "a", 1)))
    reader = table.read()
    table.merge(rows(spark, (1, 1, "b", 1)))
    table.compact()
    assert held(reader) == {(1, 1, "a", 1)} and held(table.read()) == {(1, 1, "b", 1)}
    assert table.vacuum(keep=1) == 0  # young files may be those of a merge that is under way
    assert table.vacuum(keep=1, hours=-1) == 2 and table.versions() == [3]
    assert held(table.read()) == {(1, 1, "b", 1)}


def test_a_failed_merge_leaves_no_trace_and_can_come_again(spark, table):
    table.merge(rows(spark, (1, 1, "a", 1)), "s", 0)
    bad = rows(spark, (2, 1, "b", 1)).withColumn("v", F.when(F.col("k") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        table.merge(bad, "s", 1)
    assert held(table.read()) == {(1, 1, "a", 1)} and table.versions() == [1]
    with pytest.raises(ConcurrentMerge):  # the version is claimed by the batch that failed
        table.merge(rows(spark, (5, 1, "e", 1)))
    table.merge(rows(spark, (2, 1, "b", 1)), "s", 1)
    table.merge(rows(spark, (5, 1, "e", 1)))
    assert held(table.read()) == {(1, 1, "a", 1), (2, 1, "b", 1), (5, 1, "e", 1)}


def test_a_claim_can_be_released(spark, table):
    table.merge(rows(spark, (1, 1, "a", 1)))
    table._claim(2, "a writer that is gone")
    with pytest.raises(ConcurrentMerge):
        table.merge(rows(spark, (2, 1, "b", 1)))
    table.release(2)
    table.release(1)  # a version that is there stays
    assert table.merge(rows(spark, (2, 1, "b", 1))) == 2 and table.versions() == [1, 2]


def test_odd_parts_columns_and_nothing(spark, tmp_path):
    t = MergeTable(spark, f"file://{tmp_path}/odd", ["k"], F.concat(F.lit("a/b=c %"), F.col("k")))
    with pytest.raises(ValueError):
        t.read()
    t.merge(spark.createDataFrame([], "k string"))
    assert t.read().collect() == []
    t.merge(spark.createDataFrame([("x",), ("é",)], "k string"))
    t.merge(spark.createDataFrame([("x", 1)], "k string, more int"))
    assert held(t.read()) == {("x", 1), ("é", None)}
