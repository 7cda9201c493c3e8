"""Quality rules whose cutoffs are certified on labelled documents.

Each rule rejects documents whose measure exceeds a cutoff. In every stratum half of its labelled documents choose: for each
rule the cutoff with the best balance of bad and good documents rejected, and the order of the rules by that balance. The other
half certifies: the sets of the first rule, the first two and so on are tested in turn. A set passes while the exact
(Clopper-Pearson) upper bound of the share of good documents that any of its rules rejects, at a confidence shared
out over the strata (Bonferroni), stays within the allowed risk; testing stops at the first failure, so the sequence needs no
further correction. A stratum is judged by what was certified on its own documents alone: where nothing could be,
or without labels, it rejects nothing beyond the base rules.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marketlake.llm.shared import hash_windows, hash_words, materialize, spread

SYMBOLS = b"#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_distinct")

#: A rule's measure, and its cutoffs from the mildest to the strictest.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / n_words", [2.0, 1.5, 1.0, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03]),
    "upper": ("n_upper / word_chars", [0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15]),
    "marks": ("n_marks / n_words", [2.0, 1.5, 1.0, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05]),
    "dup_lines": ("n_dup_lines / n_lines", [0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5, 0.45, 0.4, 0.35, 0.3]),
    "repeats": ("n_repeat_words / n_words", [0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2]),
    "few_distinct": ("1 - n_distinct / n_words", [0.99, 0.97, 0.95, 0.92, 0.9, 0.87, 0.85, 0.82, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55]),
}


def measure(text: str | None) -> tuple[int, ...]:
    """The counts of _METRICS for one text; all 0 for null."""
    if not text:
        return (0,) * len(_METRICS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    spaces = sum(map(text.count, "\x20\x09\x0a\x0b\x0c\x0d"))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    hashes = hash_words(words)
    repeats = 0
    if n >= 3:
        windows = hash_windows(hashes, 3)
        _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
        again = np.flatnonzero(counts[which] > 1)
        if len(again):
            hit = np.zeros(n, dtype=bool)
            for i in range(3):
                hit[again + i] = True
            repeats = int(hit.sum())
    return (
        n,
        len(text) - spaces,
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeats,
        len(lines),
        len(raw) - len(raw.translate(None, UPPER)),
        raw.count(b"!") + raw.count(b"?"),
        len(np.unique(hashes)),
    )


def metrics(docs: DataFrame, text_col: str, prefix: str = "") -> DataFrame:
    """``docs`` with the counts of each text, in columns named by ``prefix`` and the count."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([measure(t) for t in batch.column(at).cast(pa.string()).to_pylist()], dtype=np.int64).reshape(-1, len(_METRICS))
            arrays = [*batch.columns, *[pa.array(np.ascontiguousarray(c)) for c in rows.T]]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *[prefix + m for m in _METRICS]])

    schema = StructType(list(docs.schema.fields))
    for m in _METRICS:
        schema = schema.add(prefix + m, "long")
    return docs.mapInArrow(run, schema)


def _table(docs: DataFrame, id_col: str, text_col: str, strata: str | None) -> DataFrame:
    stratum = F.coalesce(F.col(strata).cast("string"), F.lit("")) if strata else F.lit("")
    picked = docs.select(F.col(id_col).cast("long").alias("id"), stratum.alias("stratum"), F.col(text_col).cast("string").alias("text"))
    return metrics(spread(picked, "id"), "text").drop("text")


def binomial_upper(k: int, n: int, delta: float) -> float:
    """The exact upper confidence bound of a rate, k events in n trials, at confidence 1 - delta."""
    if k >= n:
        return 1.0

    def below(p: float) -> float:
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
        top = max(logs)
        return math.exp(top) * sum(math.exp(x - top) for x in logs)

    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mid > 0 and below(mid) > delta else (lo, mid)
        if lo == 0 and mid == 0:
            break
    return hi


def choose(good: list[int], bad: list[int], n_good: int, risk: float, cost: float) -> tuple[float, int] | None:
    """The best balance and the cutoff that has it, given how many good and bad documents each rejects; None: no cutoff is of use."""
    best = None
    for i, (g, b) in enumerate(zip(good, bad, strict=True)):
        if g <= risk * n_good and b - cost * g > (best[0] if best else 0.0):
            best = b - cost * g, i
    return best


Cutoffs = dict[str, dict[str, float]]


def fit_cutoffs(table: DataFrame, labels: DataFrame, label_id: str, label_col: str, risk: float, delta: float, cost: float) -> Cutoffs:
    """rule -> stratum -> cutoff, from the measures of all labelled documents."""
    marks = labels.select(F.col(label_id).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label is not null")
    marks = marks.groupBy("id").agg(F.min("label").alias("label"))
    half = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    seen = table.filter("n_words > 0").join(marks, "id").withColumn("certify", half)
    above = [
        sum((F.coalesce(_ratio(m) > c, F.lit(False)).cast("int") for c in cuts), F.lit(0)).alias(rule)
        for rule, (m, cuts) in RULES.items()
    ]
    # rows that share an id are one document, rejected where one of them is
    least_of = [F.min(c).alias(c) for c in ("stratum", "label", "certify")]
    seen = seen.select("id", "stratum", "label", "certify", *above).groupBy("id").agg(*least_of, *[F.max(rule).alias(rule) for rule in RULES])
    # strata too small for the bound to hold even if no good document is rejected stay out: at most labels / that number reach the driver
    least = math.log(1 / delta) / risk
    sizes = seen.filter("label = 1 and certify").groupBy("stratum").count().filter(F.col("count") >= least)
    certifying = {r["stratum"]: r["count"] for r in sizes.collect()}
    seen = seen.filter(F.col("stratum").isin(list(certifying)))
    counts = seen.filter("not certify").unpivot(["stratum", "label"], list(RULES), "rule", "passed").groupBy("stratum", "rule", "passed", "label").count().collect()
    by: dict[tuple[str, str], list] = {}
    for r in counts:
        by.setdefault((r["stratum"], r["rule"]), []).append(r)
    ranked: dict[str, list[tuple[str, int]]] = {}
    for stratum in certifying:
        found = []
        for rule, (_, cuts) in RULES.items():
            own = by.get((stratum, rule), [])
            # cutoffs fall, so a document that exceeds j of them exceeds the last j
            rejects = lambda i, label: sum(r["count"] for r in own if r["label"] == label and r["passed"] >= len(cuts) - i)  # noqa: E731, B023
            good, bad = ([rejects(i, label) for i in range(len(cuts))] for label in (1, 0))
            at = choose(good, bad, sum(r["count"] for r in own if r["label"] == 1), risk, cost)
            if at is not None:
                found.append((-at[0], rule, at[1]))
        ranked[stratum] = [(rule, i) for _, rule, i in sorted(found)]
    out: Cutoffs = {rule: {} for rule in RULES}
    if not any(ranked.values()):
        return out
    # for each good document of the certifying half the place of the first rule that rejects it
    places = []
    for rule, (_, cuts) in RULES.items():
        own = {stratum: (len(cuts) - i, at) for stratum, rules in ranked.items() for at, (r, i) in enumerate(rules) if r == rule}
        if own:
            need, at = (F.create_map(*[F.lit(x) for stratum, pair in own.items() for x in (stratum, pair[k])]) for k in (0, 1))
            places.append(F.when(F.col(rule) >= F.try_element_at(need, F.col("stratum")), F.try_element_at(at, F.col("stratum"))))
    first = F.array_min(F.array(*places, F.lit(len(RULES))))
    hits = seen.filter("certify and label = 1").groupBy("stratum", first.alias("first")).count().collect()
    for stratum, rules in ranked.items():
        for at, (rule, i) in enumerate(rules):
            rejected = sum(r["count"] for r in hits if r["stratum"] == stratum and r["first"] <= at)
            if binomial_upper(rejected, certifying[stratum], delta / len(certifying)) > risk:
                break
            out[rule][stratum] = RULES[rule][1][i]
    return out


def _ratio(measured: str, at: Callable[[str], str] = str) -> Column:
    head, _, tail = measured.partition(" / ")
    share = F.try_divide(F.col(at(head.removeprefix("1 - "))), F.col(at(tail)))
    return 1 - share if head.startswith("1 - ") else share


def _verdict(cutoffs: Cutoffs, stratum: Column, at: Callable[[str], str], min_words: int, repeat_percent: int) -> tuple[Column, Column]:
    """(base_failed, rules that fail); ``at`` gives the column that holds a count."""
    failed = []
    for rule, by in cutoffs.items():
        if by:
            lookup = F.create_map(*[F.lit(x) for pair in sorted(by.items()) for x in pair])
            cutoff = F.coalesce(F.try_element_at(lookup, stratum), F.lit(float("inf")))
            failed.append(F.when(_ratio(RULES[rule][0], at) > cutoff, F.lit(rule)))
    rules = F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")
    words, repeats = F.col(at("n_words")), F.col(at("n_repeat_words"))
    return (words < min_words) | (100 * repeats > repeat_percent * words), rules


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    strata: str | None = "lang",
    label_id: str = "doc_id",
    label_col: str = "quality",
    risk: float = 0.05,
    delta: float = 0.05,
    cost: float = 5.0,
    min_words: int = 50,
    repeat_percent: int = 50,
) -> DataFrame:
    """One row for each row of ``docs``: id, stratum, all counts, base_failed, rules (those that fail), kept.

    Over all rules together at most a share ``risk`` of a stratum's good documents is rejected, with confidence
    1 - delta over all strata; strata without enough labels for that fail by the base rules alone. Null and empty texts have no words and fail the base. Rows without an id or
    a label are judged like others but teach nothing; an id labelled twice counts once, as bad if any label is 0, and so
    does an id of several rows, as rejected if any of them is. Equal rows are judged alike. Other columns are ignored; empty tables give an empty result or no rules.
    """
    table = materialize(_table(docs, id_col, text_col, strata), "metrics")
    cutoffs = fit_cutoffs(table, labels, label_id, label_col, risk, delta, cost)
    base, rules = _verdict(cutoffs, F.col("stratum"), str, min_words, repeat_percent)
    out = table.withColumn("base_failed", base).withColumn("rules", rules)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rules") == 0)).withColumnRenamed("id", id_col)


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    strata: str | None = "lang",
    label_id: str = "doc_id",
    label_col: str = "quality",
    risk: float = 0.05,
    delta: float = 0.05,
    cost: float = 5.0,
    min_words: int = 50,
    repeat_percent: int = 50,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, whatever their names, that ``quality_rules`` keeps; judged in place, without a shuffle."""
    cutoffs = fit_cutoffs(materialize(_table(docs, id_col, text_col, strata), "metrics"), labels, label_id, label_col, risk, delta, cost)
    stratum = F.coalesce(F.col(strata).cast("string"), F.lit("")) if strata else F.lit("")
    prefix = "_" * (1 + max(map(len, docs.columns)))  # no column of the input starts like that
    base, rules = _verdict(cutoffs, stratum, lambda m: prefix + m, min_words, repeat_percent)
    return metrics(docs, text_col, prefix).filter(~base & (F.size(rules) == 0)).select(*[F.col(f"`{c}`") for c in docs.columns])
