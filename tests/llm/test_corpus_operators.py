"""Each corpus operator against a plain version on small tables with nulls, empty and long texts, repeated rows and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketlake.llm import decontaminate, html_extract, lm_score, near_dedup, packing, quality_classifier, quality_rules, secret_scan, token_store, url_filter
from marketlake.llm.components import connected_components
from marketlake.llm.elias_fano import EliasFano, dump, load
from marketlake.llm.encode import Encoder, default_path
from marketlake.llm.shared import scratch_path

WORDS = "the of and thing er ion est ha re on in at ble ou wh".split()
CLASH = "doc_id long, text string, lang string, id long, row long, rep long, node long, n_words long, kept boolean"


def prose(rng, n):
    return " ".join("".join(rng.choices(WORDS, k=rng.randint(1, 3))) for _ in range(n))


def table(spark, rows):
    """Rows (doc_id, text, lang) with more columns whose names clash with those that operators use."""
    return spark.createDataFrame([(i, t, g, 1, 2, 3, 4, 5, False) for i, t, g in rows], CLASH)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [prose(rng, 120) for _ in range(12)]
    out = [(i, t, "en") for i, t in enumerate(base)]
    for i in range(60):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        out.append((100 + i, " ".join(w), "en"))
    out += [(300, None, None), (301, "", "en"), (302, " \n\t ", "de"), (303, "One", "de"), (304, "oNE", "de"), (305, prose(rng, 9000), "fr"), (306, "a b", None), (307, "A  b\x0b", "")]
    return [*out, out[0], out[0], out[-1]]


def brute_components(rows, k, percent):
    sets = {}
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < k else zip(*[w[j:] for j in range(k)], strict=False))
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("sizes", [{}, {"leaf": 3, "block": 4, "depth": 3, "cluster_rows": 4, "group_rows": 3}, {"cluster_rows": 20, "group_rows": 4}])
def test_near_duplicates(spark, rows, sizes):
    got = near_dedup.near_duplicates(table(spark, rows), shingle=2, **sizes).collect()
    want = brute_components(rows, 2, 80)
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    assert near_dedup.near_duplicates(table(spark, rows).limit(0)).count() == 0
    one = near_dedup.near_duplicates(table(spark, [(None, "a b c", "en"), (1, "a b c", "en")])).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in one} == {(None, None, True), (1, 1, True)}


def test_deduplicate_keeps_columns(spark, rows):
    out = near_dedup.deduplicate(table(spark, rows), shingle=2)
    want = brute_components(rows, 2, 80)
    assert out.columns == table(spark, rows).columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted({i for i, (_, c) in want.items() if i == c})


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (200, 200)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize(("name", "split"), [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "spaces")])
def test_encoder_equals_the_library(name, split):
    rng = random.Random(3)
    signs = [*"  \n\t.,!?;:'\"ÀéüßñѲ漢\u0301\u00a0\u2003\x1c\x85<|", "don't", "it's.", "123", "Ab", "ab,", "<|endoftext|>"]
    texts = ["", " ", "a", *["".join(rng.choices([*signs, *WORDS], k=rng.randint(1, 60))) for _ in range(400)]]
    own = Encoder(default_path(name), split, keep=50)
    want = Tokenizer.from_file(default_path(name)).encode_batch(texts, add_special_tokens=False)
    assert all(list(a) == b.ids for a, b in zip(own.encode(texts), want, strict=True))


def test_token_store(spark, rows):
    docs = table(spark, [*rows, (None, "lost", "en")])
    store = token_store.write_store(docs, scratch_path(spark, "t"), default_path("word_bpe_49k.json"), "words", 1, keys_per_bucket=20)
    got = sorted(store.read(docs).select("doc_id", "start", "n_tokens", "ids_crc32").collect(), key=lambda r: r["start"])
    library, start = Tokenizer.from_file(default_path("word_bpe_49k.json")), 0
    want = sorted(((i, t or "") for i, t, _ in rows), key=lambda x: x[0])
    assert len(got) == len(want)
    for r, (i, t) in zip(got, want, strict=True):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], dtype="<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    absent = spark.createDataFrame([(i,) for i in range(10_000, 12_000)], "doc_id long")
    assert store.read(absent).count() == 0
    empty = token_store.write_store(docs.limit(0), scratch_path(spark, "t"), default_path("word_bpe_49k.json"), "words", 1)
    assert empty.read(docs).count() == 0


def test_perfect_hash_is_minimal():
    for n in (0, 1, 2, 1000, 20_000):
        keys = np.arange(n, dtype=np.uint64) * np.uint64(7919)
        assert sorted(token_store.PerfectHash.build(keys).find(keys).tolist()) == list(range(n))


def test_packing(spark, rows):
    docs = table(spark, [*rows, (None, "no id", "en")]).repartition(3)
    got = packing.pack(docs, default_path("byte_bpe_50k.json"), "spaces").collect()
    library = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t, _ in [*rows, (None, "no id", "en")]}
    copies = collections.Counter([i for i, _, _ in rows] + [None])
    tokens = collections.Counter()
    sequences = collections.defaultdict(list)
    for r in got:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert list(r["ids"]) == own and r["doc_tokens"] == len(ids[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(np.array(own, dtype="<u4").tobytes())
        tokens[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert tokens == {i: copies[i] * len(x) for i, x in ids.items()}
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0  # nothing is padded
    assert packing.pack(docs.limit(0), default_path("byte_bpe_50k.json"), "spaces").count() == 0


def test_packing_by_harmonic_classes():
    """Bins of class j hold j tails of that class, and no document has more than one cut beyond its whole capacities."""
    rng, capacity = random.Random(4), 64
    bins, docs = packing.Bins(capacity, 0), [np.arange(rng.choice([1, 5, rng.randint(1, 200), 64, 33, 31])).astype("<u4") for _ in range(900)]
    early = [p for doc, ids in enumerate(docs) for p in bins.add(doc, ids)]
    late = bins.close()
    bins_of, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for doc, start, length, _, n, sequence, offset, ids in early + late:
        assert n == len(docs[doc]) and list(ids) == list(docs[doc][start : start + length])
        bins_of[sequence].append((offset, doc, start, length))
        pieces[doc].append((start, length))
    for doc, own in pieces.items():
        at = 0
        for start, length in sorted(own):
            assert start == at
            at += length
        assert at == len(docs[doc])
    last = {p[5] for p in late}
    for sequence, own in bins_of.items():
        total = sum(length for *_, length in sorted(own))
        assert total == capacity if sequence not in last else total <= capacity and total & (total - 1) == 0
        if sequence in last or own[0][3] == capacity:
            continue
        # tails that end their documents, all of one class, then the pieces that fill the gap
        j = capacity // min(length for *_, length in sorted(own)[:1])
        tails = [x for x in sorted(own)[:j]]
        assert all(capacity // length == j and start + length == len(docs[doc]) for _, doc, start, length in tails)
    cuts = [sum(1 for start, _ in own if start % capacity) for doc, own in pieces.items() if not any(p[0] == doc for p in late)]
    assert max(cuts) <= 1 and sum(cuts) < len(docs)


def brute_measure(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {j + k for j, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if grams[g] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(spark, rows):
    rng = random.Random(9)
    good = [(1000 + i, prose(rng, 80), "en" if i % 3 else "xx") for i in range(1500)]
    bad = [(3000 + i, " ".join(w + "%%%" for w in prose(rng, 80).split()), "en") for i in range(200)]
    odd = [(5000, "same line é\nsame line é\n\nsame line é\r\n a a a a a | # <", "en")]
    docs = table(spark, [*rows, *good, *bad, *odd])
    labels = spark.createDataFrame([(i, int(i < 3000), 9) for i, _, _ in [*good, *bad][::2]] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, kept int")
    out = {r["doc_id"]: r for r in quality_rules.quality_rules(docs, labels).collect()}
    for i, t, _ in [*rows, *odd, *good[:50], *bad[:50]]:
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_measure(t)
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
    assert all(out[i]["kept"] for i, _, _ in good if not out[i]["base_failed"]) and not any(out[i]["kept"] for i, _, _ in bad)
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in out.items() if r["kept"]}
    assert quality_rules.quality_rules(docs.limit(0), labels).count() == 0
    assert not any(r["rules"] for r in quality_rules.quality_rules(docs, labels.limit(0)).collect())


def test_quality_rules_of_each_stratum_alone(spark):
    """Small strata certify their own cutoffs; strata without labels, or with too few, lose nothing to what others taught."""
    rng = random.Random(12)
    docs, labels = [], []
    for g in ("aa", "bb", "cc", "dd"):
        for i in range(360):
            docs.append((len(docs), prose(rng, 60) if i < 300 else prose(rng, 60).upper(), g))
            labels.append((docs[-1][0], int(i < 300)))
    for i in range(60):
        docs.append((len(docs), prose(rng, 60).upper(), "few" if i % 3 == 0 else "none" if i % 3 == 1 else None))
        if i % 3 == 0:
            labels.append((docs[-1][0], 1))
    out = quality_rules.quality_rules(table(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    kept = {r["doc_id"]: not r["rules"] for r in out}
    assert all(kept[i] == (t.islower() or g not in ("aa", "bb", "cc", "dd")) for i, t, g in docs)


def test_binomial_bound():
    assert quality_rules.binomial_upper(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100))
    assert quality_rules.binomial_upper(5, 5, 0.05) == 1.0
    p = quality_rules.binomial_upper(3, 200, 0.01)
    assert sum(math.comb(200, i) * p**i * (1 - p) ** (200 - i) for i in range(4)) == pytest.approx(0.01)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body><header><p>Site</p></header><nav><ul><li><a href="/a">A</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site, and many more words to make it long.</div><article><h1>Caf&eacute; &amp; Co</h1><p><b>First  part,<br>it goes   on<p>Second &#8364; one</p>
<div class="ad">Buy now</div><p>x</p><form><p>Mail</p></form></article><aside>Side</aside><section id="comments"><p>Nice post, thank you very much for all of it, really.</p></section><footer>&copy; me</footer>"""


def test_html(spark):
    assert html_extract.main_text(PAGE) == "Café & Co\nFirst part, it goes on\nSecond € one\nx"
    long = "<article>" + "<p>word word word</p>" * 5000 + "</article>"
    pages = spark.createDataFrame([(1, "u", PAGE, "old", 0), (2, None, None, None, None), (3, "u", "", "", 1), (None, "u", "no tags at all", "", 1), (5, "u", long, "", 1), (5, "u", long, "", 1)], "page_id long, url string, html string, text string, n_chars int")
    out = html_extract.extract(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = out.collect()
    assert [r["text"] for r in got[1:4]] == ["", "", "no tags at all"] and got[4]["text"].count("\n") == 4999 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extract(pages.limit(0)).count() == 0
    plain = "<body><div class='menu'><a>a</a><a>b</a></div><div><p>" + "long text " * 30 + "</p><p>" + "more text " * 30 + "</p></div><div><a>c</a> <a>d</a></div></body>"
    assert html_extract.main_text(plain).startswith("long text") and "c d" not in html_extract.main_text(plain)


def test_html_keeps_every_content_region():
    part = lambda word, n: f"<p>{(word + ' text ') * n}</p>" * 4
    both = lambda page: [html_extract.main_text(page).count(w) for w in ("first", "second")]
    nav = "<nav><a>a</a></nav><div class='menu'><a>m</a> <a>n</a></div>"
    for tag in ("div", "section", "article"):
        for body in ("body", "main"):
            assert both(f"<html>{nav}<{body}><{tag}>{part('first', 30)}</{tag}><{tag}>{part('second', 20)}</{tag}></{body}><footer>f</footer>") == [120, 80]
    for name in ("with-sidebar", "has-footer"):
        page = f"<body><div class='{name}'><div>{part('first', 30)}</div><div class='sidebar'>{part('side', 5)}</div></div><div>x</div></body>"
        got = html_extract.main_text(page)
        assert got.count("first") == 120 and "side" not in got
    # comments longer than a marked article stay out
    page = f"<body><article>{part('first', 10)}</article><div id='comments'>{part('second', 40)}</div></body>"
    assert both(page) == [40, 0]


def plain_text(html, sigma=1.0, share=0.5, rest=0.05):
    """The content regions of a page from the parser's lines, by definition: every line looks at all elements around it."""
    parser = html_extract.Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    sections, tag = parser.sections, lambda s: parser.sections[s][0]

    def around(s):
        return [s, *around(sections[s][1])] if s >= 0 else []

    def marks(m):
        return [m, *marks(parser.marks[m])] if m >= 0 else []

    named = lambda line: any(tag(s) in ("article", "main") for s in around(line[2]))
    free = [line for line in parser.lines if not line[3]]
    size = lambda lines: sum(len(line[0]) for line in lines)
    void = {m for m in range(len(parser.marks)) for own in [[x for x in free if m in marks(x[4])]] if 2 * size(own) > size(free) and [x for x in own if named(x)] == [x for x in free if named(x)]}
    out = [bool(line[3] or set(marks(line[4])) - void) for line in parser.lines]
    ratio = np.array([0.0 if o else len(line[0]) / max(1, line[1]) for line, o in zip(parser.lines, out, strict=True)])
    reach = math.ceil(2 * sigma)
    even = []
    for at in range(len(ratio)):
        near = np.arange(max(0, at - reach), min(len(ratio), at + reach + 1))
        k = np.exp(-((near - at) ** 2) / (2 * sigma**2))
        even.append((k * ratio[near]).sum() / k.sum())
    kept = [i for i in range(len(out)) if not out[i]]
    lines = parser.lines
    high = [i for i in kept if even[i] >= share * np.std(even)] or kept
    inner = [i for i in high if named(lines[i])]
    if inner and 2 * size(lines[i] for i in inner) >= size(lines[i] for i in high):
        high, kept = inner, [i for i in kept if named(lines[i])]

    def home(s):
        while tag(s) == "td" and any(tag(x) in ("article", "main") for x in around(sections[s][1])):
            s = sections[s][1]
        return s

    judge = lambda i: 2 * size(lines[j] for j in high if home(lines[j][2]) == home(lines[i][2])) >= size(lines[j] for j in kept if home(lines[j][2]) == home(lines[i][2]))
    content = [i for i in high if judge(i)]
    weight = {s: size(lines[i] for i in content if s in around(lines[i][2])) for s in range(len(sections))}
    covers = [s for s in weight if weight[s] >= (1 - rest) * weight[0]] if kept else []
    best = max([s for s in covers if tag(s) in ("article", "main")] or covers, default=0)
    return "\n".join(lines[i][0] for i in kept if judge(i) and best in around(lines[i][2]))


def test_html_regions_by_definition():
    rng, links = random.Random(8), 0
    for _ in range(150):
        def part(depth):
            kind = rng.randrange(9)
            if kind < 4 or depth > 3:
                return f"<p>{prose(rng, rng.choice([1, 4, 30, 80]))}"
            if kind == 4:
                return "<ul>" + "".join(f"<li><a href=x>{prose(rng, 1)}</a>" for _ in range(rng.randint(2, 8))) + "</ul>"
            if kind == 5:
                return "<table><tr>" + "".join(f"<td>{prose(rng, 2)}" for _ in range(3)) + "</table>"
            tag = rng.choice(["div", "section", "div class=sidebar", "div", "article", "nav", "main"])
            return f"<{tag}>" + "".join(part(depth + 1) for _ in range(rng.randint(1, 5))) + f"</{tag.split()[0]}>"

        page = "<body>" + "".join(part(0) for _ in range(rng.randint(1, 7)))
        assert html_extract.main_text(page) == plain_text(page)
        links += html_extract.main_text(page) != html_extract.main_text(page, share=0.0)
    assert links > 20  # without its threshold the operator gives other texts


def test_html_threshold_drops_unmarked_links():
    long = "<p>" + "the of and thing " * 30
    page = f"<body><article><h1>One</h1>{long}<p>Short.{long}<table><tr><td>1<td>2</table><div>{'<p><a href=x>on</a> <a href=y>in</a>' * 8}</div>{long}</article>"
    got = html_extract.main_text(page)
    assert "Short." in got and got.startswith("One") and "\n1\n2" in got and "on in" not in got
    assert "on in" in html_extract.main_text(page, share=0.0)


@pytest.mark.parametrize("piece", ["<div>x ", "<span>", "</b><i>x", "<div class=ad>x ", "<p>a b<p>", "<li><div>"])
def test_html_takes_deep_nesting(piece):
    """A page of 100,000 open elements is read in a time that grows with its length only."""
    began = time.process_time()
    html_extract.main_text(piece * 20_000)
    small = time.process_time() - began
    html_extract.main_text(piece * 100_000)
    assert time.process_time() - began - small < 15 * small + 1


def test_html_keeps_other_columns(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a b", "old", 9, 1)], "page_id long, url string, html string, text string, n_chars long, __html long")
    got = html_extract.extract(pages).collect()[0]
    assert (got["page_id"], got["url"], got["text"], got["n_chars"], got["__html"]) == (1, "u", "a b", 3, 1)


def brute_hits(t, items):
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")
    cut = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(s))
    words, hit, found = cut(t), set(), set()
    for i, s in items:
        w = cut(s)
        k = min(10, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            for p in range(len(words) - k + 1):
                if words[p : p + k] == w[j : j + k]:
                    hit.update(range(p, p + k))
                    found.add(i)
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_chars", [16_000_000, 200])
def test_contamination(spark, rows, block_chars):
    rng = random.Random(4)
    items = [(i, prose(rng, n)) for i, n in enumerate((30, 25, 10, 9, 3, 2, 1, 14))] + [(20, ""), (21, None), (None, "x y")]
    text = lambda i: items[i][1]
    mixed = [(900, "Start, " + text(0).upper() + "! end", "en"), (901, text(1)[5:] + " " + text(2), "en"), (902, text(3) + " zzz " + text(3), "en"), (903, " ".join(text(7).split()[:9]), "en"), (None, text(2), "en")]
    docs, bench = table(spark, [*rows, *mixed]), spark.createDataFrame([*items, items[0]], "item_id long, text string")
    got = decontaminate.contamination(docs, bench, block_chars=block_chars).collect()
    want = collections.Counter()
    for i, t, _ in [*rows, *mixed]:
        n, h, f = brute_hits(t, [x for x in items if x[0] is not None])
        want[i, n, h, tuple(f)] += 1
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == want
    clean = decontaminate.remove(docs, bench, block_chars=block_chars)
    assert clean.columns == docs.columns and sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(k[0]) for k, c in want.items() for _ in range(c) if not k[2])
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0 and decontaminate.contamination(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.ORG/es/x?y#z", "https://example.org/en/12", "https://notexample.org/es/1", "http://x.com/fr/a", "http://com/de/", "http://x.net/a#b", "http://h?q=/p", "http://org", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, "k", 1) for i, u in enumerate(urls)] + [(3, urls[3], "k", 1)], "page_id long, url string, key string, said int")
    got = {r["page_id"]: r for r in url_filter.judge(pages, RULES).collect()}
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(v, r) for v, r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        best = max(fit, key=lambda x: len(x[1])) if fit else None
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[1])
        assert r["verdict"] == best[0] if best else r["verdict"] in ("allow", "block")
    assert url_filter.judge(pages.limit(0), RULES).count() == 0


def test_url_model_separates(spark):
    rng = random.Random(1)
    good = [f"http://news{rng.randint(0, 99)}.org/en/story-{rng.randint(0, 999)}" for _ in range(150)]
    bad = [f"http://pills{rng.randint(0, 99)}.com/de/cheap-{rng.randint(0, 999)}" for _ in range(150)]
    asked = ["http://news5.net/en/story-77", "http://pills7.net/xx/cheap-12"]
    pages = spark.createDataFrame(list(enumerate([*good, *bad, *asked])), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, RULES).collect()}
    assert (got[300], got[301]) == ("allow", "block")


def test_classifier(spark, rows):
    rng = random.Random(2)
    good = [(1000 + i, prose(rng, 60), "en") for i in range(150)]
    bad = [(2000 + i, " ".join([rng.choice(WORDS) + "!!"] * 60).upper(), "en") for i in range(150)]
    docs = table(spark, [*rows, *good, *bad, (None, "x", "en")])
    labels = spark.createDataFrame([(i, int(i < 2000)) for i, _, _ in [*good, *bad]] + [(None, 1), (1000, None)], "doc_id long, quality int")
    got = quality_classifier.classify(docs, labels, sample=200).collect()
    assert len(got) == len(rows) + 301 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] >= 1000]
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert len(held) > 40 and sum(r["predicted"] == int(r["doc_id"] < 2000) for r in held) >= 0.98 * len(held)
    assert {r["score"] for r in quality_classifier.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.classify(docs.limit(0), labels).count() == 0


def brute_secrets(t):
    out = []
    for o, (kind, p, ok) in enumerate((("assign", r"((?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6), ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24))):
        out += [(m.start(), o, m.end(), kind) for m in re.finditer(p, t, re.I | re.A if kind == "assign" else 0) if ok(m)]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(out)]


def test_secrets(spark, rows):
    rng = random.Random(8)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n: "".join(rng.choices(alnum, k=n))
    planted = [(700 + i, f"é\ue000 see {k} here", "en", k) for i, k in enumerate(key(n) for n in (40, 44, 48, 56, 60))]
    some = [
        (800, 'API_KEY = "abcdef" password:x token=secret=abcdefgh secret=token = "abcdefgh"', "en"), (801, "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + "0123456789abcdef" * 3, "en"),
        (802, "é\ue001 Token: " + "ab" * 20, "en"), (803, "deadbeef" * 2 + "g" + "0" * 24, "en"), (804, "passwd='" + "q" * 3000 + "'", "en"),
    ]
    natural = [(10_000 + i, " ".join("".join(rng.choices(WORDS, k=9)) for _ in range(40)), "en") for i in range(60)]
    docs = table(spark, [*rows, *[p[:3] for p in planted], *some, *natural, (None, "token=abcdef", "en")])
    got = secret_scan.scan(docs).select("doc_id", "n_assign", "n_access", "n_hex", secret_scan.listed(F.col("base")).alias("base"), secret_scan.listed(F.col("random")).alias("random"), secret_scan.listed(secret_scan.by_start(F.col("base"), F.col("random"))).alias("all")).collect()
    texts = {i: t or "" for i, t, *_ in [*rows, *planted, *some, *natural]} | {None: "token=abcdef"}
    assert len(got) == docs.count()
    for r in got:
        want = brute_secrets(texts[r["doc_id"]])
        assert r["base"] == ",".join(want) and (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x.startswith(k) for x in want) for k in ("assign", "access", "hex"))
        assert not r["random"] or (r["doc_id"] or 0) in range(700, 705)
    found = {r["doc_id"]: r["random"] for r in got if r["random"]}
    assert found == {i: f"random:{t.index(k)}:{t.index(k) + len(k)}" for i, t, _, k in planted}
    masked = {r["doc_id"]: r["text"] for r in secret_scan.mask(docs).collect()}
    assert masked[700] == "é\ue000 see [SECRET] here" and masked[300] is None and masked[305] == texts[305] and masked[None] == "[SECRET]"
    assert secret_scan.scan(docs.limit(0)).count() == 0 and secret_scan.mask(docs).columns == docs.columns


def test_secrets_among_natural_tokens(spark):
    """Short generated tokens are found in every alphabet; identifiers, numbers, ruled lines and dates are not."""
    rng = random.Random(21)
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    kinds = {"alnum": low + up + dig, "base64": low + up + dig + "+/", "base36": low + dig, "base32": up + "234567", "hex": dig + "ABCDEF"}
    word = lambda: "".join(rng.choices(WORDS, k=rng.randint(2, 4)))
    forms = [
        lambda: "_".join(word() for _ in range(4)), lambda: "".join(word().capitalize() for _ in range(4)), lambda: "/".join(word() for _ in range(4)) + "/2024",
        lambda: "-".join(word() for _ in range(4)) + f"-{rng.randint(0, 99)}", lambda: "".join(rng.choices(dig, k=24)), lambda: "=" * 40, lambda: "2024-01-22-10-33-44-" + "".join(rng.choices(dig, k=6)),
    ]
    natural = [(i, prose(rng, 60) + " " + forms[i % len(forms)]() + " " + "".join(rng.choices(WORDS, k=9)), "en") for i in range(420)]
    planted = []
    for n in (16, 20, 24, 32, 40, 48, 64):
        for alphabet in kinds.values():
            for _ in range(4):
                key = "".join(rng.choices(alphabet, k=n))
                planted.append((10_000 + len(planted), f"see {key} here", "en", n))
    docs = table(spark, [*natural, *[p[:3] for p in planted]])
    plain = re.compile(r"see ([A-Z]?[a-z]+|[A-Z]+) here")
    for least in (16, 20):
        got = {r["doc_id"]: r["random"] for r in secret_scan.scan(docs, least=least).select("doc_id", secret_scan.listed(F.col("random")).alias("random")).collect()}
        asked = [p for p in planted if p[3] >= least and not plain.fullmatch(p[1])]
        hit = [p for p in asked if got[p[0]] == f"random:4:{4 + p[3]}"]
        assert len(hit) >= 0.97 * len(asked)
        assert sum(bool(v) for i, v in got.items() if i < 10_000) <= 0.01 * len(hit) + 1


def brute_scores(every, held, order, single):
    """(base, score) of each text by counting whole n-grams in dictionaries."""
    cut = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()), "end"]
    counts = [collections.Counter() for _ in range(order)]
    for i, t in every:
        if not held(i):
            w = ["begin", *cut(t)]
            for at in range(1, len(w)):
                for d in range(min(order, at + 1)):
                    counts[d][tuple(w[at - d : at + 1])] += 1
    total, after, mass = sum(counts[0].values()), collections.Counter(), collections.Counter()
    for d in range(1, order):
        for gram, c in counts[d].items():
            after[gram[:-1]] += c
            mass[gram[:-1]] += c - 1 if c > 1 else single if d == 1 else 0
    out = []
    for _, t in every:
        w, base, score = ["begin", *cut(t)], 0.0, 0.0
        for at in range(1, len(w)):
            p = (counts[0][w[at],] + 1) / (total + len(counts[0]) + 1)
            base += math.log10(p)
            for d in range(1, min(order, at + 1)):
                gram = tuple(w[at - d : at + 1])
                n, c = after[gram[:-1]], counts[d][gram]
                if n:
                    p = (c - 1 if c > 1 else c * (single if d == 1 else 0)) / n + (1 - mass[gram[:-1]] / n) * p
            score += math.log10(p)
        out.append((len(w) - 1, sum(counts[0][x,] > 0 for x in w[1:]), total, base, score))
    return out


@pytest.mark.parametrize(("order", "shard_tokens", "limit"), [(2, 4_000_000, 500_000), (3, 4_000_000, 500_000), (3, 1500, 700), (4, 3000, 2000)])
def test_lm_scores(spark, rows, order, shard_tokens, limit):
    docs = table(spark, [*rows, (None, "the the", "en")])
    every = [(i, t or "") for i, t, _ in rows] + [(None, "the the")]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    got = lm_score.lm_scores(docs, order=order, shard_tokens=shard_tokens, limit=limit).collect()
    assert len(got) == len(every)
    by = {r["doc_id"]: r for r in got}
    for (i, _), (n, known, total, base, exact) in zip(every, brute_scores(every, held, order, 0.01), strict=True):
        r = by[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), n, known, total)
        assert r["base_score"] == pytest.approx(base)
        assert r["score"] == pytest.approx(exact, abs=0.016 * n + 0.02)  # half a step of the quantisation
    assert lm_score.lm_scores(docs.limit(0)).count() == 0


def test_lm_model_scores_other_texts(spark, rows):
    """Training and scoring apart, over many shards, equal training and scoring at once; scores do not depend on shards and blocks."""
    docs = table(spark, rows)
    held = lm_score.train_part(F.col("doc_id"))
    model = lm_score.train(docs.filter(~held), scratch_path(spark, "model"), shard_tokens=2000)
    apart = sorted(map(tuple, lm_score.score(docs, model).select("doc_id", "n_known", "base_score", "score").collect()))
    once = sorted(map(tuple, lm_score.lm_scores(docs).select("doc_id", "n_known", "base_score", "score").collect()))
    assert model.shards > 1 and model.hot and len(apart) == len(once)
    assert all(a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-3) for a, b in zip(apart, once, strict=True))


def test_lm_tells_repeated_texts(spark):
    """Texts that occur twice in training score above texts that occur once, trained on or not."""
    rng = random.Random(9)
    texts = [prose(rng, 150) for _ in range(300)]
    docs = table(spark, [(i, t, "en") for i, t in enumerate(texts)] + [(1000 + i, texts[i], "en") for i in range(60)])
    got = {r["doc_id"]: r for r in lm_score.lm_scores(docs).collect()}
    twice = [got[i]["score"] / got[i]["n_tokens"] for i in range(60) if not got[i]["held_out"] and not got[1000 + i]["held_out"]]
    once = [got[i]["score"] / got[i]["n_tokens"] for i in range(60, 300)]
    assert len(twice) > 30 and min(twice) > max(once)


def test_elias_fano():
    rng = np.random.default_rng(3)
    for n, universe in ((0, 1), (1, 1), (5, 2**64), (1000, 5000), (3000, 2**40), (2000, 2**64)):
        values = np.sort(rng.integers(0, universe, n, dtype=np.uint64)) if n else np.empty(0, dtype=np.uint64)
        ef = EliasFano.of(load(np.frombuffer(dump(EliasFano.build(values, universe).arrays("x")), dtype=np.uint8)), "x")
        assert (ef.get(np.arange(n)) == values).all()
        asked = np.concatenate([values, rng.integers(0, universe, 500, dtype=np.uint64)])
        assert (ef.successor(asked) == np.searchsorted(values, asked)).all()
        assert ((ef.find(asked) >= 0) == np.isin(asked, values)).all()
