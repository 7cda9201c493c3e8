"""URL verdicts by rules and, where no rule speaks, by character language models of accepted and rejected URLs.

Column expressions only. The rules label the URLs they match; of these, four fifths train a Markov model for
each verdict and the rest calibrate it. A model's order varies with what it has seen: the probability of a character after
its last ``order`` characters is mixed with the one after fewer characters by Witten-Bell weights, down to a uniform
alphabet. A URL's score is the mean log ratio of the two models over its characters, and the threshold is
the one that separates the calibration URLs best.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from marketlake.llm.shared import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALPHABET = 256.0
_BEFORE, _AFTER = "\x02", "\x03"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or a URL without ``://``."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), _UPPER, _LOWER), F.regexp_extract(url, pattern, 2)


def match(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(verdict, rule) of the longest rule that fits, the first of equals; null where none does.

    A rule is (verdict, "host/path"); it fits its host and all subdomains where the path starts with the rule's.
    """
    verdict, rule = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(reversed(rules), key=lambda x: len(x[1])):
        h, slash, p = r.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(slash + p))
        verdict, rule = F.when(fits, v).otherwise(verdict), F.when(fits, r).otherwise(rule)
    return verdict, rule


def _grams(key: Column, order: int) -> Column:
    """For each character of the key and its end mark, the character behind its ``order`` predecessors."""
    padded = F.concat(F.lit(_BEFORE * order), key, F.lit(_AFTER))
    return F.transform(F.sequence(F.lit(1), F.length(key) + 1), lambda i: F.substring(padded, i, F.lit(order + 1)))


def log_ratios(counts: DataFrame, order: int) -> DataFrame:
    """(gram, ratio): log10 of the probability of a gram's last character under the allowed URLs' model against the
    blocked ones'. counts: (gram, allow, block) of all grams that are to be scored, unseen ones with zeros."""
    lower = None
    for k in range(order + 1):
        own = counts.groupBy(F.expr(f"right(gram, {k + 1})").alias("gram")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        w = Window.partitionBy(F.expr(f"left(gram, {k})"))
        for side in ("allow", "block"):
            own = own.withColumn(f"n_{side}", F.sum(side).over(w)).withColumn(f"t_{side}", F.count_if(F.col(side) > 0).over(w))
        if lower is None:
            own = own.withColumn("q_allow", F.lit(1 / _ALPHABET)).withColumn("q_block", F.lit(1 / _ALPHABET))
        else:
            own = own.withColumn("tail", F.expr(f"right(gram, {k})"))
            own = own.join(lower.select(F.col("gram").alias("tail"), F.col("p_allow").alias("q_allow"), F.col("p_block").alias("q_block")), "tail")
        for side in ("allow", "block"):
            n, t = F.col(f"n_{side}"), F.col(f"t_{side}")
            seen = (F.col(side) + t * F.col(f"q_{side}")) / F.nullif(n + t, F.lit(0))
            own = own.withColumn(f"p_{side}", F.coalesce(seen, F.col(f"q_{side}")))
        lower = materialize(own.select("gram", "p_allow", "p_block"), f"order{k}")
    assert lower is not None
    return materialize(lower.select("gram", (F.log10("p_allow") - F.log10("p_block")).alias("ratio")), "ratios")


def _threshold(scores: DataFrame, step: float = 0.01, reach: float = 4.0) -> float:
    """The score at or above which calibration URLs are best called allowed (mean of the two rates); 0 if a side is missing."""
    binned = scores.withColumn("bin", F.floor(F.least(F.greatest("score", F.lit(-reach)), F.lit(reach)) / step))
    rows = binned.groupBy("bin").agg(F.count_if(F.col("label") == "allow").alias("a"), F.count_if(F.col("label") == "block").alias("b")).orderBy("bin").collect()
    a, b = sum(r["a"] for r in rows), sum(r["b"] for r in rows)
    if not a or not b:
        return 0.0
    below_a = below_b = 0
    found: list[tuple[float, float]] = []
    for before, r in zip([None, *rows[:-1]], rows, strict=True):
        # any threshold between the two bins does the same; the middle is farthest from both
        edge = (before["bin"] + 1) * step if before else r["bin"] * step
        found.append(((a - below_a) / a + below_b / b, (edge + r["bin"] * step) / 2))
        below_a, below_b = below_a + r["a"], below_b + r["b"]
    best = max(x for x, _ in found)
    good = [t for x, t in found if x == best]
    return good[len(good) // 2]


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", order: int = 3, broadcast_rows: int = 200_000) -> DataFrame:
    """One row for each row of ``pages``: id, host, path, rule (null where none fits), verdict, score, matched.

    verdict is the longest fitting rule's, or else by the language models: allow where the score reaches the calibrated
    threshold. Null URLs and URLs without ``://`` have an empty host and path and are judged by the models like any other.
    score is null where a rule decides. Without matched URLs on one side the models say nothing and the
    threshold is 0. Equal rows are judged alike; other columns are ignored; an empty table gives an empty result.
    Up to ``broadcast_rows`` grams of the models are broadcast, so that the characters of URLs are not shuffled; more are joined.
    """
    host, path = parts(F.col(url_col))
    verdict, rule = match(F.col("host"), F.col("path"), rules)
    read = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    read = read.withColumn("said", verdict).withColumn("rule", rule).withColumn("key", F.concat("host", "path"))
    read = materialize(read, "urls")
    keys = read.groupBy("key", F.col("said").alias("label")).agg(F.count("*").alias("n"))
    keys = keys.withColumn("held", F.pmod(F.crc32(F.encode("key", "utf-8")), F.lit(5)) == 0)
    rows = keys.withColumn("gram", F.explode(_grams(F.col("key"), order)))
    train = ~F.col("held")
    counts = rows.groupBy("gram").agg(
        *[F.sum(F.when(train & (F.col("label") == s), F.col("n")).otherwise(0)).alias(s) for s in ("allow", "block")]
    )
    ratios = log_ratios(materialize(counts, "grams"), order)
    asked = rows.filter(F.col("label").isNull() | F.col("held")).select("key", "label", "gram")
    if ratios.count() <= broadcast_rows:
        ratios = F.broadcast(ratios)
    scores = asked.join(ratios, "gram").groupBy("key", "label").agg(F.avg("ratio").alias("score"))
    scores = materialize(scores, "scores")
    threshold = _threshold(scores.filter("label is not null"))
    known = scores.filter("label is null").select("key", "score")
    out = read.join(known, "key", "left").withColumn("score", F.when(F.col("said").isNull(), F.col("score")))
    by_model = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return out.select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("said", by_model).alias("verdict"), "score", F.col("said").isNotNull().alias("matched")
    )
