"""Secrets in texts: known patterns, and tokens that look generated and not written.

All of it is column expressions. A token that is no plain word must pass two tests. The battery takes it in the alphabet of
its inferred encoding: chi-squared distance from uniform use of the alphabet, runs above and below its middle, and serial
correlation, each as a normal deviate. The sum of their squares must lie within what uniform strings of the alphabet and
length reach; their quantiles are simulated. Then it must be too unlikely as language: how characters follow each
other in the plain words of the corpus at hand, with a price for each change between small and capital letters, digits and
signs, gives the probability of the token as something written. The ratio of that to its probability as a uniform string bounds the
p-value (Markov's inequality, so it holds at any length), and the corpus's own long words of like length, the
controls, raise it where the model is too sure. Benjamini-Hochberg within each length class then holds the share of false discoveries.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.llm.shared import materialize, spread

#: The base patterns, in the order in which equal starts are listed, and the least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"
#: Plain words: letters of one case, perhaps after a capital.
_PLAIN = "^([A-Z]?[a-z]+|[A-Z]+)$"
_CLASSES = [16, 20, 24, 32, 48, 64]
#: Bins of the p-value are tenths of its decimal logarithm.
_STEP, _BINS = 0.1, 400
_DIGITS, _LOWER, _UPPER, _SIGNS = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "+/_=-"
_ALL = _LOWER + _UPPER + _DIGITS + _SIGNS
#: What a token is made of, with the alphabet that it is tested in; padding at its end is not counted.
_ENCODINGS = [
    ("^[0-9]+$", _DIGITS),
    ("^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("^[A-Z2-7]+$", _UPPER + "234567"),
    ("^[0-9a-z]+$", _DIGITS + _LOWER),
    ("^[0-9A-Z]+$", _DIGITS + _UPPER),
    ("^[0-9A-Za-z]+$", _DIGITS + _UPPER + _LOWER),
    ("^[0-9A-Za-z+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("^[0-9A-Za-z_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
    ("", _UPPER + _LOWER + _DIGITS + _SIGNS),
]
_ONE_KIND = "^([a-z]+|[A-Z]+|[0-9]+|[^0-9A-Za-z]+)$"
#: Probability that the next character is of the same kind (small, capital, digit, sign), and of each other kind.
_STAY, _SWITCH = 0.85, 0.05
#: The share of uniform strings that the battery accepts.
_ACCEPT = 0.999
_OPEN, _SHUT, _OTHER = "\ue000", "\ue001", "\ue002"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _found(text: Column, pattern: str) -> Column:
    """(s, e, m) of the leftmost non-overlapping matches, s and e in code points."""
    none = F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)")
    marked = F.regexp_replace(text, F.lit(pattern), F.lit(f"{_OPEN}$0{_SHUT}"))
    start = F.struct(F.lit(0).alias("p"), none.alias("a"))

    def run(parts: Column) -> Column:
        """Places of the matches in some parts, counted from the first of them: what stands before a match and the match in turn."""

        def step(x: Column, i: Column) -> Column:
            begin = x["p"] + F.length(F.element_at(parts, 2 * i + 1))
            match = F.element_at(parts, 2 * i + 2)
            end = begin + F.length(match)
            return F.struct(end.alias("p"), F.concat(x["a"], F.array(F.struct(begin.alias("s"), end.alias("e"), match.alias("m")))).alias("a"))

        return F.aggregate(F.sequence(F.lit(0), F.floor(F.size(parts) / 2).cast("int") - 1), start, step)

    def all_runs(parts: Column) -> Column:
        # runs of about the square root of their number, so that no long array grows match by match
        many = F.floor(F.size(parts) / 2).cast("int")
        stride = F.ceil(F.sqrt(many)).cast("int")
        cuts = F.sequence(F.lit(0), F.ceil(many / stride).cast("int") - 1)
        return F.transform(cuts, lambda r: _let(F.slice(parts, 2 * r * stride + 1, F.least(2 * stride, 2 * (many - r * stride))), run))

    def joined(runs: Column) -> Column:
        begin = F.struct(F.lit(0).alias("p"), F.expr("cast(array() as array<int>)").alias("a"))
        offsets = F.aggregate(runs, begin, lambda x, r: F.struct((x["p"] + r["p"]).alias("p"), F.concat(x["a"], F.array(x["p"])).alias("a")), lambda x: x["a"])

        def moved(x: Column) -> Column:
            return F.transform(x["run"]["a"], lambda m: F.struct((m["s"] + x["offset"]).alias("s"), (m["e"] + x["offset"]).alias("e"), m["m"].alias("m")))

        return F.flatten(F.transform(F.arrays_zip(runs.alias("run"), offsets.alias("offset")), moved))

    found = _let(F.split(marked, f"[{_OPEN}{_SHUT}]", -1), lambda parts: _let(all_runs(parts), joined))
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(none)


def _language(docs: DataFrame, text_col: str) -> list[float]:
    """Natural logarithms of the probability of each character of _ALL, or of ones that follow the start (the last), after each character:
    a flat table. Small and capital letters share their statistics, a capital after a small letter starts a word."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    words = F.filter(F.split(text, "[^A-Za-z0-9+/_=-]+"), lambda w: F.rlike(w, F.lit(_PLAIN)))
    distinct = docs.select(F.explode(words).alias("w")).groupBy(F.lower("w").alias("w")).agg(F.count("*").alias("n"))
    pairs = F.transform(F.sequence(F.lit(0), F.length("w") - 1), lambda i: F.substring(F.concat(F.lit("^"), F.col("w")), i + 1, F.lit(2)))
    rows = distinct.select("n", F.explode(pairs).alias("pair")).groupBy("pair").agg(F.sum("n").alias("n")).collect()  # 27 * 26 at most
    counts = np.full((27, 26), 0.5)
    for r in rows:
        counts[_LOWER.find(r["pair"][0]) % 27, _LOWER.index(r["pair"][1])] += r["n"]
    letters = counts / counts.sum(axis=1, keepdims=True)
    kind = [0] * 26 + [1] * 26 + [2] * 10 + [3] * len(_SIGNS)
    out = []
    for before in range(len(_ALL) + 1):
        for now in range(len(_ALL)):
            switch = 0.25 if before == len(_ALL) else _STAY if kind[before] == kind[now] else _SWITCH
            if kind[now] >= 2:
                own = 1 / (10 if kind[now] == 2 else len(_SIGNS))
            else:
                word = before < 52 and not (before < 26 <= now)
                own = letters[before % 26 if word else 26, now % 26]
            out.append(math.log(switch * own))
    return out


@functools.cache
def _accepted(seed: int = 7, draws: int = 4000) -> list[float]:
    """For each encoding and length class the quantile of the battery's statistic on uniform strings, the greater one of the class's ends."""
    rng, out = np.random.default_rng(seed), []
    for _, alphabet in _ENCODINGS:
        a = len(alphabet)
        for i, low in enumerate(_CLASSES):
            ends = [low, _CLASSES[i + 1] - 1] if i + 1 < len(_CLASSES) else [low, 2 * low, 4 * low]
            out.append(max(float(np.quantile(_statistic(rng.integers(0, a, (draws, n)), a), _ACCEPT)) for n in ends))
    return out


def _statistic(places: np.ndarray, a: int) -> np.ndarray:
    """The battery on rows of character places, as in ``_tested``."""
    rows, n = places.shape
    uses = np.bincount((np.arange(rows)[:, None] * a + places).ravel(), minlength=rows * a).reshape(rows, a)
    chi = ((uses**2).sum(axis=1) * a / n - n - (a - 1)) / math.sqrt(2 * (a - 1) * (n - 1) / n)
    up = places >= a / 2
    high = up.sum(axis=1)
    expected = 2 * high * (n - high) / n + 1
    spread = np.sqrt(np.maximum((expected - 1) * (expected - 2) / (n - 1), 0))
    runs = (up[:, 1:] != up[:, :-1]).sum(axis=1) + 1
    run = np.divide(runs - expected, spread, out=np.full(rows, math.sqrt(n)), where=spread > 0)
    off = places - places.mean(axis=1, keepdims=True)
    var = (off**2).sum(axis=1)
    serial = np.divide((off[:, 1:] * off[:, :-1]).sum(axis=1), var, out=np.ones(rows), where=var > 0) * math.sqrt(n - 1)
    return chi**2 + run**2 + serial**2


def _literal(values: list[float]) -> Column:
    """An array constant made of one string, so that a long one is one call to the JVM."""
    return F.split(F.lit(",".join(map(repr, map(float, values)))), ",").cast("array<double>")


def _tested(tokens: Column, language: list[float]) -> Column:
    """Each token as (s, e, control, class, bin), bin being the binned bound of its p-value as language; 0 for tokens that the battery does not
    take for uniform. Step by step, so that nothing is worked out again for every character."""
    table, accepted = _literal(language), _literal(_accepted())

    def encoded(x: Column) -> Column:
        body = F.regexp_replace(x["m"], F.lit("(?<=[^=])=+$"), F.lit(""))
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), F.rlike(x["m"], F.lit(_PLAIN)).alias("control"), body.alias("m"))

    def spelled(x: Column) -> Column:
        number, alphabet = F.lit(len(_ENCODINGS) - 1), F.lit(_ENCODINGS[-1][1])
        for i, (pattern, letters) in reversed(list(enumerate(_ENCODINGS[:-1]))):
            is_ = F.rlike(x["m"], F.lit(pattern))
            number, alphabet = F.when(is_, F.lit(i)).otherwise(number), F.when(is_, F.lit(letters)).otherwise(alphabet)
        one = F.rlike(x["m"], F.lit(_ONE_KIND))
        return F.struct(*[x[c].alias(c) for c in ("s", "e", "control")], number.alias("number"), alphabet.alias("alphabet"), one.alias("one"), F.split(x["m"], "").alias("chars"))

    def placed(x: Column) -> Column:
        places = F.transform(x["chars"], lambda c: (F.instr(x["alphabet"], c) - 1).cast("double"))
        uses = F.transform(F.array_distinct(x["chars"]), lambda c: F.size(F.filter(x["chars"], lambda y: y == c)).cast("double"))
        squares = F.aggregate(uses, F.lit(0.0), lambda t, o: t + o * o)
        start = F.struct(F.lit(len(_ALL)).alias("p"), F.lit(0.0).alias("t"))

        def follow(t: Column, c: Column) -> Column:
            at = F.instr(F.lit(_ALL), c) - 1
            return F.struct(at.alias("p"), (t["t"] + F.element_at(table, t["p"] * len(_ALL) + at + 1)).alias("t"))

        size = F.size(x["chars"]).cast("double")
        chain = F.aggregate(x["chars"], start, follow, lambda t: t["t"])
        # a token of one kind of characters does not pay for staying in it, at the price of a prior of 1/4 for each kind
        chain = chain - F.when(x["one"], (size - 1) * math.log(_STAY)).otherwise(F.lit(0.0))
        carried = [x[c].alias(c) for c in ("s", "e", "control", "number")]
        return F.struct(*carried, F.length(x["alphabet"]).cast("double").alias("a"), size.alias("n"), places.alias("places"), squares.alias("squares"), chain.alias("chain"))

    def centred(x: Column) -> Column:
        mean = F.aggregate(x["places"], F.lit(0.0), lambda t, y: t + y) / x["n"]
        size = F.size(x["places"])
        pairs = F.arrays_zip(F.slice(x["places"], F.lit(1), size - 1).alias("x"), F.slice(x["places"], F.lit(2), size - 1).alias("y"))
        high = F.size(F.filter(x["places"], lambda y: y >= x["a"] / 2)).cast("double")
        return F.struct(*[x[c].alias(c) for c in ("s", "e", "control", "number", "a", "n", "chain", "places", "squares")], mean.alias("mean"), pairs.alias("pairs"), high.alias("high"))

    def summed(x: Column) -> Column:
        half, mean = x["a"] / 2, x["mean"]
        runs = F.size(F.filter(x["pairs"], lambda p: (p["x"] >= half) != (p["y"] >= half))).cast("double") + 1
        var = F.aggregate(x["places"], F.lit(0.0), lambda t, y: t + (y - mean) * (y - mean))
        lag = F.aggregate(x["pairs"], F.lit(0.0), lambda t, p: t + (p["x"] - mean) * (p["y"] - mean))
        return F.struct(*[x[c].alias(c) for c in ("s", "e", "control", "number", "a", "n", "chain", "squares", "high")], runs.alias("runs"), var.alias("var"), lag.alias("lag"))

    def judged(x: Column) -> Column:
        a, n = x["a"], x["n"]
        chi = (x["squares"] * a / n - n - (a - 1)) / F.sqrt(2 * (a - 1) * (n - 1) / n)
        expected = 2 * x["high"] * (n - x["high"]) / n + 1
        run = F.coalesce(F.try_divide(x["runs"] - expected, F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(0.0)))), F.sqrt(n))
        serial = F.coalesce(F.try_divide(x["lag"], x["var"]), F.lit(1.0)) * F.sqrt(n - 1)
        group = _length_class(x["e"] - x["s"])
        fits = chi * chi + run * run + serial * serial <= F.element_at(accepted, x["number"] * len(_CLASSES) + group + 1)
        # the alphabet was picked among several, which a uniform string pays for
        ratio = -n * F.log(a) - math.log(len(_ENCODINGS)) - x["chain"]
        number = F.greatest(F.least(F.floor(ratio / (math.log(10) * _STEP)), F.lit(_BINS)), F.lit(0)).cast("int")
        # the battery is of the alphabet, which is not that of controls
        number = F.when(x["control"] | (fits & (n > 1)), number).otherwise(F.lit(0))
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["control"].alias("control"), group.alias("class"), number.alias("bin"))

    for step in (encoded, spelled, placed, centred, summed, judged):
        tokens = F.transform(tokens, step)
    return tokens


def _length_class(n: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(_CLASSES[1:], 1):
        out = F.when(n >= least, F.lit(i)).otherwise(out)
    return out


def _cutoffs(tokens: DataFrame, rate: float, least_controls: int = 20) -> list[int]:
    """For each length class the least bin that counts as a discovery; beyond the last bin if none does. The bins are few.

    10 ** (-bin * step) bounds the p-value. Of a class's controls, or of all where it has few, the upper twentieth must be as rare as
    its bound says; where they are not, the bound is multiplied by what is missing."""
    rows = tokens.groupBy("class", "bin", "control").count().collect()
    every = [r for r in rows if r["control"]]
    out = []
    for own in range(len(_CLASSES)):
        like = [r for r in every if r["class"] == own]
        if sum(r["count"] for r in like) < least_controls:
            like = every
        above, excess = 0, 0.0
        for r in sorted(like, key=lambda r: -r["bin"]):
            above += r["count"]
            if 20 * above >= sum(x["count"] for x in like):
                excess = max(0.0, r["bin"] * _STEP + math.log10(0.05))
                break
        tested = {b: 0 for b in range(_BINS + 1)}
        for r in rows:
            if not r["control"] and r["class"] == own:
                tested[r["bin"]] += r["count"]
        m, seen, best = sum(tested.values()), 0, _BINS + 1
        for b in range(_BINS, 0, -1):
            seen += tested[b]
            # Benjamini-Hochberg: the largest p-value not above rate * rank / m, on bins
            if seen and 10 ** (excess - b * _STEP) <= rate * seen / m:
                best = b
        out.append(best)
    return out


def _matches(docs: DataFrame, text_col: str, carry: list[Column], language: list[float]) -> DataFrame:
    """The carried columns, the counts of each kind, base spans, and tested tokens with their bins."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    marked = F.contains(text, F.lit(_OPEN)) | F.contains(text, F.lit(_SHUT))
    text = F.when(marked, F.translate(text, _OPEN + _SHUT, _OTHER + _OTHER)).otherwise(text)
    read = docs.select(F.struct(*carry).alias("row"), text.alias("t"))
    found = read.select(
        "row",
        F.filter(_found(F.col("t"), ASSIGN), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6).alias("assign"),
        _found(F.col("t"), ACCESS).alias("access"),
        _found(F.col("t"), HEX).alias("hex"),
        _found(F.col("t"), TOKEN).alias("token"),
    )

    def named(kind: str, order: int) -> Column:
        return F.transform(kind, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("o"), x["e"].alias("e"), F.lit(kind).alias("kind")))

    found = found.withColumn("base", F.array_sort(F.concat(named("assign", 0), named("access", 1), named("hex", 2))))
    free = F.filter("token", lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return found.select("row", *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")], "base", _tested(free, language).alias("tested"))


def _random(kept: DataFrame, rate: float, least: int) -> Column:
    """The spans of tested tokens that count as generated, with cutoffs from all of them."""
    tokens = kept.filter(F.size("tested") > 0).select(F.explode("tested").alias("x")).select("x.*")
    cuts = F.array(*map(F.lit, _cutoffs(tokens.filter(F.col("control") | (F.col("e") - F.col("s") >= least)), rate)))
    found = F.filter("tested", lambda x: ~x["control"] & (x["e"] - x["s"] >= least) & (x["bin"] >= F.element_at(cuts, x["class"] + 1)))
    return F.transform(found, lambda x: F.struct(F.lit("random").alias("kind"), x["s"].alias("s"), x["e"].alias("e")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.01, least: int = 20) -> DataFrame:
    """One row for each row of ``docs``: id, n_assign, n_access, n_hex, base, random, each span a (kind, s, e).

    base are the spans of the known patterns by start and then kind; random are tokens of ``least`` characters or
    more that overlap no base span and that the tests take for generated, at a false discovery rate of ``rate``; positions are
    code points, ends exclusive. Null and empty texts have no spans. Rows without an id and equal rows are
    scanned one by one. Other columns are ignored. An empty table gives an empty result. Whole texts are read twice, for the
    statistics of language and for matches; after that only the matches are used.
    """
    docs = spread(docs, id_col)
    kept = materialize(_matches(docs, text_col, [F.col(f"`{id_col}`").cast("long").alias("id")], _language(docs, text_col)), "matches")
    base = F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    return kept.select(F.col("row.id").alias(id_col), "n_assign", "n_access", "n_hex", base.alias("base"), _random(kept, rate, least).alias("random"))


def mask(docs: DataFrame, text_col: str = "text", rate: float = 0.01, least: int = 20, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret of the text replaced by a mark; texts without secrets and other columns stay as they are."""
    language = _language(docs, text_col)
    random = _random(materialize(_matches(docs, text_col, [F.lit(0).alias("none")], language).select("tested"), "tested"), rate, least)
    found = _matches(docs, text_col, [F.col(f"`{c}`") for c in docs.columns], language)
    spans = by_start(F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))), random)
    clean = redact(F.col("row")[text_col], F.col("spans"), mark)
    return found.withColumn("spans", spans).select(*[clean.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def by_start(base: Column, random: Column) -> Column:
    """All spans by start; random ones never overlap base ones, so starts differ between the two."""
    order = F.transform(F.concat(base, random), lambda x: F.struct(x["s"].alias("s"), F.array_position(F.array(*map(F.lit, ("assign", "access", "hex", "random"))), x["kind"]).alias("o"), x["e"].alias("e"), x["kind"].alias("kind")))
    return F.transform(F.array_sort(order), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by a mark. Spans are in order of start."""
    state = F.struct(F.lit(0).alias("p"), F.lit("").alias("out"))

    def step(x: Column, s: Column) -> Column:
        fresh = F.concat(x["out"], F.substring(text, x["p"] + 1, s["s"] - x["p"]), F.lit(mark))
        return F.struct(F.greatest(x["p"], s["e"]).alias("p"), F.when(s["s"] >= x["p"], fresh).otherwise(x["out"]).alias("out"))

    done = F.aggregate(spans, state, step, lambda x: F.concat(x["out"], F.substring(text, x["p"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
