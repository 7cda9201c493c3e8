"""The pipeline on a small corpus whose result is known."""

from __future__ import annotations

import collections
import random

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from marketlake.llm import near_dedup
from marketlake.llm.encode import default_path

SYLLABLES = "the of and thing er ion est ha re on in at ble ou wh".split()


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(2, 4))) for _ in range(n))


def test_run_packs_what_the_stages_leave(spark, tmp_path):
    rng = random.Random(6)
    passage = prose(rng, 20)
    docs = {i: prose(rng, 80 + 40 * i) for i in range(12)}
    want = dict(docs)
    docs |= {20: docs[1], 21: "too short", 22: prose(rng, 60) + " " + passage + " " + prose(rng, 60)}
    secret = prose(rng, 70)
    docs[23], want[23] = secret + " password=hunter22 end", secret + " [SECRET] end"
    spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(5)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    library = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    got = collections.defaultdict(list)
    for r in sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: r["start"]):
        got[r["doc_id"]] += r["ids"]
    assert got == {i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in want.items()}


def write(spark, path, docs, labels, items, extra="k int"):
    spark.createDataFrame(docs, f"doc_id long, text string, lang string, source string, n_chars long, {extra}").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing column names: each stage gives the columns it got."""
    rng = random.Random(7)
    long, plain = prose(rng, 20_000), prose(rng, 90)
    rows = [(1, plain, "en", None, 5, 1, 2), (1, plain, "en", None, 5, 1, 2), (2, None, "en", "a", None, 1, 2), (3, "", None, "a", 0, 1, 2), (4, long, None, "a", 1, 1, 2), (None, prose(rng, 80), "de", "a", 1, None, 2), (5, " \n ", "de", "b", 3, 1, 2), (6, plain.upper(), "xx", "b", 3, 1, 2)]
    write(spark, tmp_path, rows, [(1, 1, 0), (None, 0, None), (2, None, 0)], [(1, None), (2, "")], "rep int, __quality_n_words int")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in docs.collect())
    assert seen["quality_rules"] == sorted([(1, len(plain)), (1, len(plain)), (4, len(long)), (0, len(rows[5][1])), (6, len(plain))])
    assert seen["near_dedup"] == sorted([(1, len(plain)), (4, len(long)), (0, len(rows[5][1]))]) == seen["decontamination"] == seen["secret_scan"]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {1, 4, None}


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_deduplicate_keeps_all_texts_of_an_id_and_columns_of_any_name(spark):
    words = [f"w{i}" for i in range(40)]
    first, other = " ".join(words), " ".join(reversed(words))
    rows = [(1, first, 7), (1, other, 7), (1, other, 7), (2, first + " more", 8), (None, first, 9), (None, first, 9), (3, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __kept int").withColumn("__kept_", F.lit("x"))
    got = near_dedup.deduplicate(docs)
    assert got.columns == docs.columns
    found = sorted(((r["doc_id"], r["text"], r["__kept"]) for r in got.collect()), key=str)
    kept = [r for r in found if r[0] == 1]
    assert kept == sorted([(1, first, 7), (1, other, 7)], key=str)
    assert [r for r in found if r[0] is None] == [(None, first, 9)] * 2 and (3, None, 1) in found
