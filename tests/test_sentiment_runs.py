"""Sentiment from runs of terms, held against the rule token by token."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from marketlake.functions import news as nw

POS, NEG, STRONG, NOT = ["the", "thing"], ["rest", "or"], {"and": 1.5, "of": 0.5}, ["to"]


def plain(text):
    tokens = re.findall("thing|rest|the|and|or|of|to|.", (text or "").lower(), re.DOTALL)
    r = t = 0.0
    for i, w in enumerate(tokens):
        b, bb = tokens[i - 1] if i else "", tokens[i - 2] if i > 1 else ""
        x = STRONG.get(b, 1.0) * (-0.5 if b in NOT or (b in STRONG and bb in NOT) else 1.0)
        p, n = (x if w in POS else 0.0), (x if w in NEG else 0.0)
        r, t = r + p - n, t + abs(p) + abs(n)
    return (max(-1.0, min(1.0, r / t)) if t > 0 else 0.0), min(1.0, t / max(len(tokens), 1) * 2)


def test_runs_of_terms_give_what_tokens_give(spark):
    rng = random.Random(3)
    parts = ["the", "thing", "rest", "or", "and", "of", "to", "t", "THE", " ", "\n", "é", "😀"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(400)] + [None, "", "toandthe" * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    found = nw.with_sentiment(df, F.col("x"), POS, NEG, STRONG, NOT)
    assert [(r["score"], r["magnitude"]) for r in found.orderBy("i").collect()] == [plain(x) for x in texts]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_zip" not in plan and "|.)" not in plan  # no array with an entry for each character
