"""Phrases, fill-in-middle and mixing against plain versions, with odd rows."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketlake.llm import fill_middle, mixing, phrases
from marketlake.llm import quotient_filter as qf

SCHEMA = "doc_id long, text string, lang string, source string, n long, form string, `key` string, __part int, block string, taken long"


def table(spark, rows):
    """Documents (id, text, lang, source) with more columns whose names clash with those of the operators."""
    return spark.createDataFrame([(*r, 7, "x", "k", 3, "b", 9) for r in rows], SCHEMA)


# quotient filters
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=50), st.sampled_from([32, 40, 56, 64, 72, 80, 128, 136, 160]), st.integers(0, 2**32))
@settings(max_examples=60, deadline=None)
def test_permutation_is_undone(xs, size, salt):
    limbs = [np.array([(x * (i + 3) + salt) % 2 ** min(64, size - 64 * i) for x in xs], np.uint64) for i in range(-(-size // 64))]
    limbs = [limbs[0] << np.uint64(64 - size)] if size < 64 else limbs
    back = qf.restore(qf.permute(limbs, size), size)
    assert all((a == b).all() for a, b in zip(limbs, back, strict=True))
    assert len({tuple(map(int, r)) for r in zip(*limbs, strict=True)}) == len({tuple(map(int, r)) for r in zip(*qf.permute(limbs, size), strict=True)})


@pytest.mark.parametrize("words", [2, 3, 5])
@pytest.mark.parametrize("bits,n", [(3, 0), (3, 1), (3, 500), (13, 400), (16, 40_000), (26, 3000), (32, 300)])
def test_filters_lose_nothing(bits, n, words):
    rng = np.random.default_rng(bits)
    size = qf.key_bits(words, bits)
    ids = [rng.integers(0, min(2**bits, 400), n).astype(np.uint64) if n > 1000 else rng.integers(0, 2**bits, n).astype(np.uint64) for _ in range(words)]
    want = collections.Counter(zip(*[x.tolist() for x in ids], strict=True))
    weights = rng.integers(1, 600, n)
    weighed = collections.Counter()
    for row, w in zip(zip(*[x.tolist() for x in ids], strict=True), weights.tolist(), strict=True):
        weighed[row] += w
    half = n // 2
    blobs = collections.defaultdict(list)
    for part in (slice(0, half), slice(half, n)):
        limbs, counts = qf.combine(qf.permute(qf.pack([x[part] for x in ids], bits, size), size), weights[part])
        assert [a.tolist() for a in qf.decode(qf.encode(limbs, counts, size))[0]] == [a.tolist() for a in limbs]
        for where, blob in qf.split(limbs, counts, size, 0, 4):
            for deeper, inner in qf.split(*qf.decode(blob), size, 4, 4):
                assert deeper >> 4 == where
                blobs[deeper].append(inner)
    got = collections.Counter()
    for found in blobs.values():
        limbs, counts = qf.merge(found)
        rows = zip(*[x.tolist() for x in qf.unpack(qf.restore(limbs, size), bits, words, size)], strict=True)
        got.update(dict(zip(rows, counts.tolist(), strict=True)))
    assert got == weighed and set(got) == set(want)


def test_equal_first_limbs_are_told_apart():
    limbs, counts = qf.combine([np.array([5, 5, 5, 1], np.uint64), np.array([2, 1, 2, 0], np.uint64)], np.ones(4, np.int64))
    assert [x.tolist() for x in limbs] == [[1, 5, 5], [0, 1, 2]] and counts.tolist() == [1, 1, 2]


# phrases
def plain_phrases(rows, least, longest, top):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang, _ in rows:
        lang = lang or "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    gone = {(p[0], *p[i:j]) for p, a in found.items() for i in range(1, len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) - 1 and a >= f[(p[0], *p[i:j])]}
    out = collections.defaultdict(list)
    for p, a in found.items():
        if p not in gone:
            cuts = [(1000 * a * n[p[0]] // (f[p[: k + 1]] * f[(p[0], *p[k + 1 :])]), k) for k in range(1, len(p) - 1)]
            score, k = min(cuts)
            out[p[0]].append((-score, -a, " ".join(p[1:]).encode(), f[p[: k + 1]], f[(p[0], *p[k + 1 :])], n[p[0]]))
    return {(lang, i, x[2].decode(), -x[1], x[3], x[4], x[5], -x[0]) for lang, xs in out.items() for i, x in enumerate(sorted(xs)[:top], 1)}


def odd_texts(rng, n):
    words = ["the", "The", "a", "new", "york", "é", "zürich", "x\x00y", "b", "c\x1cd", "q"]
    for i in range(n):
        text = "".join(rng.choice([*words, "new york city"]) + rng.choice([" ", " ", " ", "\t", ". ", "\n", "?", "  "]) for _ in range(rng.randint(0, 60)))
        yield (i if i % 7 else None, rng.choice([text, text, text, None, ""]), rng.choice(["en", "en", "en", "de", None, ""]), "s")


@pytest.mark.parametrize("fan_bits,size", [(1, 1500), (2, 300), (8, 1 << 20)])
def test_phrases(spark, fan_bits, size):
    rows = list(odd_texts(random.Random(3), 300))
    rows += rows[:50]
    got = phrases.phrases(table(spark, rows), least=4, top=30, block_tokens=size, fan_bits=fan_bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain_phrases(rows, 4, 5, 30)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 60


def test_phrases_of_little(spark):
    assert phrases.phrases(table(spark, [])).collect() == []
    assert phrases.phrases(table(spark, [(1, None, None, None), (2, "...", "en", None), (3, "one", "en", None)]), least=1).collect() == []
    one = phrases.phrases(table(spark, [(1, "a b", None, None)]), least=1).collect()
    assert [tuple(r) for r in one] == [("und", 1, "a b", 1, 1, 1, 2, 2000)]


def test_a_long_text_is_cut_and_nothing_is_lost(spark, monkeypatch):
    monkeypatch.setattr(phrases, "_CHUNK", 1000)
    text = "alpha beta gamma delta epsilon " * 40_000  # 5 piece-less megabytes hold phrases across all blocks
    got = {r.phrase: r.a for r in phrases.phrases(table(spark, [(1, text, "en", None)]), block_tokens=1 << 14).collect()}
    n = 40_000
    assert got == {"alpha beta gamma delta epsilon": n} | {p: n - 1 for p in ("beta gamma delta epsilon alpha", "gamma delta epsilon alpha beta", "delta epsilon alpha beta gamma", "epsilon alpha beta gamma delta")}


def test_exact_products(spark):
    a = 9_007_199_254_740_993  # above 2^53; the product passes 64 bits
    row = spark.range(1).selectExpr(f"{a}L AS a", "800000000000000003L AS n", f"{a + 2}L AS l", f"{a + 4}L AS r")
    big = lambda c: f"CAST({c} AS DECIMAL(18,0))"
    got = row.selectExpr(f"(CAST(1000 AS DECIMAL(4,0)) * ({big('a')} * {big('n')})) div ({big('l')} * {big('r')})").first()[0]
    assert got == 1000 * a * 800000000000000003 // ((a + 2) * (a + 4))


# fill-in-middle
def plain_middle(i, text, marks=("<P>", "<S>", "<M>"), rate=100, spm=50, seed=7):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(lines)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in marks) or h3 % 100 >= rate:
        return i, n, "plain", None, None, text
    x, y, z = ("".join(p) for p in (lines[:a], lines[a:b], lines[b:]))
    p, s, m = marks
    if h4 % 100 < spm:
        return i, n, "spm", len(x), len(y), s + z + p + x + m + y
    return i, n, "psm", len(x), len(y), p + x + s + z + m + y


@pytest.mark.parametrize("options", [{}, {"rate": 60, "spm": 20, "seed": 1}, {"marks": ("$1\\", "(.*)", "[^a]")}])
def test_fill_in_middle(spark, options):
    rng = random.Random(5)
    parts = ["a", "bb", "\n", "\n\n", "é", "𝒳", "\r\n", "<", "P>", "<S", "$1", "\\", " ", "{2}", "\x00", " ", "<<"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 30))), "en", "s") for i in range(400)]
    rows += [(400, None, "en", "s"), (401, "", None, None), (None, "x\ny\nz", None, None), (402, "has <P> in it\n", "en", "s"), (402, "same id\nother\ntext", "en", "s"), (403, "\n" * 50, "en", "s"), *rows[:5]]
    got = fill_middle.fill_in_middle(table(spark, rows), **options)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    marks = options.get("marks", fill_middle.MARKS)
    found = got.withColumn("back", fill_middle.restore(F.col("output"), F.col("form"), marks)).collect()
    want = [(*plain_middle(i, t, **options), t or "") for i, t, _, _ in rows]
    assert collections.Counter(map(tuple, found)) == collections.Counter(want)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_middle_of_little_and_of_much(spark):
    assert fill_middle.fill_in_middle(table(spark, [])).collect() == []
    long = [(i, "a line of some words, and é\n" * 200_000 + "end" * i, "en", "s") for i in range(3)]  # 5 MB, 200,000 lines; and one line below
    long.append((9, "word " * 1_000_000, "en", "s"))
    for r, (i, t, _, _) in zip(fill_middle.fill_in_middle(table(spark, long)).collect(), long, strict=True):
        assert tuple(r) == plain_middle(i, t)


def test_marks_must_not_overlap():
    for marks in (("<P>", "<P>", "<M>"), ("", "a", "b"), ("ab", "bc", "x"), ("aba", "x", "y"), ("abc", "b", "y")):
        with pytest.raises(ValueError):
            fill_middle._checked(marks)


def test_middle_is_native(spark):
    plan = fill_middle.fill_in_middle(table(spark, [(1, "a\nb", "en", "s")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# mixing
def plain_targets(sizes, weights, most):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left, free = total - sum(most * sizes[s] for s in capped), sum(w[s] for s in sizes if s not in capped)
        above = {s for s in sizes if s not in capped and most * sizes[s] * free < left * w[s]}
        if not above:
            return {s: most * sizes[s] if s in capped else w[s] * left / free for s in sizes}
        capped |= above


def plain_mix(rows, weights=(1, 2, 3), most=3, seed=13):
    words = [len(re.findall("[^\x20\x09-\x0d]+", t or "")) for _, t, _, _ in rows]
    sizes = collections.Counter()
    for (_, _, _, s), k in zip(rows, words, strict=True):
        sizes[s] += k
    targets, total = plain_targets(sizes, weights, most), sum(words)
    pieces = []
    for s in sizes:
        mine = sorted((int(hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:15], 16), r[0] is not None, r[0] or 0, k, i) for i, (r, k) in enumerate(zip(rows, words, strict=True)) if r[3] == s)
        at, quota = 0, -(-targets[s] // 1)
        for epoch in range(most):
            for key, _, doc, k, i in mine:
                take = min(k, quota - at)
                if take > 0:
                    pieces.append(((at + take) / targets[s], s is None, (s or "").encode(), epoch, key, doc, k, i, int(take)))
                at += k
    taken, done, order = collections.Counter(), 0, []
    for p in sorted(pieces):
        take = min(p[-1], total - done)
        if take > 0:
            taken[p[-2]] += take
            order.append((done, rows[p[-2]][0], rows[p[-2]][3], p[3], take))
            done += take
    return [(r[0], k, sizes[r[3]], float(targets[r[3]]), taken[i]) for i, (r, k) in enumerate(zip(rows, words, strict=True))], order


@pytest.mark.parametrize("options", [{}, {"weights": (5, 1), "most": 2, "seed": 3}, {"most": 1}])
def test_mixture(spark, options):
    rng = random.Random(11)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 30, 300])) + rng.choice(["", " \t", "\n"]), "en", rng.choice(["a", "a", "a", "a", "b", "ç", None, "Z"])) for i in range(500)]
    rows += [(500, None, None, "empty"), (501, "", None, "empty"), (502, "word " * 3000, "en", "small"), (None, "no id", "en", "a"), *rows[:20]]
    docs, mix = mixing.mixture(table(spark, rows), rows=20, **options)
    assert docs.columns == ["doc_id", "size", "source_size", "target", "taken"] and mix.columns == ["position", "doc_id", "source", "epoch", "words"]
    want, order = plain_mix(rows, **options)
    found = docs.collect()
    assert collections.Counter(map(tuple, found)) == collections.Counter(want)
    assert [tuple(r) for r in mix.orderBy("position").collect()] == order
    most, total = options.get("most", 3), sum(r.size for r in found)
    assert sum(r.taken for r in found) == total and all(r.taken <= most * r.size for r in found)
    again = mixing.mixture(table(spark, rows[::-1]).repartition(7), rows=20, **options)[0]
    assert collections.Counter(map(tuple, again.collect())) == collections.Counter(want)


def test_any_stretch_of_the_mix_has_the_shares(spark):
    rows = [(i, "w " * 10, "en", "abc"[i % 3]) for i in range(3000)]
    _, mix = mixing.mixture(table(spark, rows))
    for begin in (0, 9000, 20_000):
        part = collections.Counter()
        for r in mix.filter(f"position >= {begin} AND position < {begin + 6000}").collect():
            part[r.source] += r.words
        assert part == {"a": pytest.approx(1000, abs=20), "b": pytest.approx(2000, abs=20), "c": pytest.approx(3000, abs=20)}


def test_mixture_of_little_and_of_one(spark):
    assert mixing.mixture(table(spark, []))[0].collect() == []
    assert [tuple(r) for r in mixing.mixture(table(spark, [(1, None, None, None), (2, " ", None, "a")]))[0].orderBy("doc_id").collect()] == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert [tuple(r) for r in mixing.mixture(table(spark, [(1, "word " * 2_000_000, None, None)]))[0].collect()] == [(1, 2_000_000, 2_000_000, 2e6, 2_000_000)]
