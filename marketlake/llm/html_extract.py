"""Main text of web pages from parser events, by text-to-tag ratios of lines.

The standard library's parser streams over a page. Every block element makes a line, with its text, the
number of tags met in it and the section it stands in. The ratio of characters to tags is smoothed over
neighbouring lines with a Gaussian; lines above a threshold (a share of the standard deviation) form clusters, the
content regions. A section is content if most of its own text lies in clusters: then all of its lines are blocks, short ones too, and
else none, such as a list of links that nothing marks. Where <article> and <main> hold most of the clusters' text, only they count,
and of what is left the smallest section that covers all clusters but a small share of their text. Lines that are
marked as menu, header, footer, sidebar, notice, advert, form or comment are never content. A mark by a class or id does not
count on an element that holds most of the page's text, such as a wrapper named with-sidebar.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.llm.shared import spread

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_SECTION = frozenset("article main section div td body".split())
_DROP_TAG = frozenset("nav footer aside form script style noscript template select button textarea iframe svg dialog head title menu".split())
_DROP_NAME = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer header masthead "
    "cookie cookies consent notice notices popup modal alert comment comments disqus respond share social related newsletter subscribe login search".split()
)
_DROP_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert form menu".split())
#: A start tag of these ends an open element of the same group, as HTML allows to leave out end tags.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_CLOSES |= {t: {"p"} for t in _BLOCK if t not in _CLOSES and t not in ("td", "th", "tr", "html", "body")}


class Lines(HTMLParser):
    """Collects (text, tags, section, dropped, mark) for each block. Sections are numbered, with their parents kept, and so are marks, the
    elements that a class or id marks as no content; a line has the innermost of each, -1 for no mark. Every step takes a time that
    does not depend on the depth of nesting."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool, int]] = []
        self.sections: list[tuple[str, int]] = [("", -1)]
        self.marks: list[int] = []
        self.stack: list[tuple[str, bool, int, int]] = []
        self.blocks: list[int] = []
        self.open: Counter[str] = Counter()
        self.text: list[str] = []
        self.tags = 0

    def _at(self) -> tuple[bool, int, int]:
        return self.stack[-1][1:] if self.stack else (False, 0, -1)

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers are not needed."""
        return j

    def flush(self) -> None:
        if not self.text:
            self.tags = 0
            return
        words = " ".join("".join(self.text).split())
        if words:
            dropped, section, mark = self._at()
            self.lines.append((words, self.tags, section, dropped, mark))
        self.text, self.tags = [], 0

    def _pop(self, at: int) -> None:
        if self.blocks and self.blocks[-1] >= at:
            self.flush()
        while self.blocks and self.blocks[-1] >= at:
            self.blocks.pop()
        for element in self.stack[at:]:
            self.open[element[0]] -= 1
        del self.stack[at:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCK:
            self.flush()
        # end tags that are left out are those of the innermost open block
        if (closes := _CLOSES.get(tag)) and self.blocks and self.stack[self.blocks[-1]][0] in closes:
            self._pop(self.blocks[-1])
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in _VOID:
            return
        dropped, section, mark = before = self._at()
        if not dropped:
            dropped = tag in _DROP_TAG or self._hidden(tag, attrs)
        if not dropped and self._named(tag, attrs):
            self.marks.append(mark)
            mark = len(self.marks) - 1
        if tag in _SECTION:
            self.sections.append((tag, section))
            section = len(self.sections) - 1
        if dropped != before[0] or mark != before[2]:
            self.flush()
        if tag in _BLOCK:
            self.blocks.append(len(self.stack))
        self.open[tag] += 1
        self.stack.append((tag, dropped, section, mark))

    def _named(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in ("article", "main", "body", "html", "header"):
            return False
        return any(name in ("class", "id") and value and _DROP_NAME & set(re.split(r"[^a-z]+", value.lower())) for name, value in attrs)

    def _hidden(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in ("article", "main", "body", "html"):
            return False
        if tag == "header":
            return not self.open["article"]
        for name, value in attrs:
            if name == "role" and value and value.lower() in _DROP_ROLE:
                return True
            if name in ("hidden", "aria-hidden") and value in (None, "", "true", "hidden"):
                return True
        return False

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if not self.open[tag]:
            return
        at = len(self.stack) - 1
        while self.stack[at][0] != tag:
            at -= 1
        if self.stack[at][1] or self.stack[at][3] >= 0:
            self.flush()
        self._pop(at)

    def handle_data(self, data: str) -> None:
        self.text.append(data)


def smooth(values: list[float], sigma: float) -> list[float]:
    """Gaussian smoothing with a window of two sigma on either side; ends use what there is."""
    reach = math.ceil(2 * sigma)
    kernel = [math.exp(-(i**2) / (2 * sigma**2)) for i in range(-reach, reach + 1)]
    out = []
    for at in range(len(values)):
        pairs = [(kernel[i + reach], values[at + i]) for i in range(-reach, reach + 1) if 0 <= at + i < len(values)]
        out.append(sum(k * v for k, v in pairs) / sum(k for k, _ in pairs))
    return out


def _unmarked(parser: Lines, named: set[int]) -> list[tuple[str, int, int, bool]]:
    """Lines with marks settled: one counts unless its element holds most of the text that nothing else rules out, and no
    other text stands in an article or main (``named`` sections)."""
    total, in_named = 0, 0
    own, own_named = [0] * len(parser.marks), [0] * len(parser.marks)
    for text, _, section, dropped, mark in parser.lines:
        if not dropped:
            total += len(text)
            in_named += section in named
            if mark >= 0:
                own[mark] += len(text)
                own_named[mark] += section in named
    for m in range(len(own) - 1, -1, -1):  # outer marks come first
        if (outer := parser.marks[m]) >= 0:
            own[outer] += own[m]
            own_named[outer] += own_named[m]
    counts: list[bool] = []
    for m, outer in enumerate(parser.marks):
        counts.append(not (2 * own[m] > total and own_named[m] == in_named) or outer >= 0 and counts[outer])
    return [(text, tags, section, dropped or mark >= 0 and counts[mark]) for text, tags, section, dropped, mark in parser.lines]


def _below(sections: list[tuple[str, int]], tops: set[int]) -> set[int]:
    """The given sections and all inside of them."""
    inside = set(tops)
    for s, (_, parent) in enumerate(sections):  # parents come first
        if parent in inside:
            inside.add(s)
    return inside


def _home(sections: list[tuple[str, int]], named: set[int]) -> list[int]:
    """The section by which a section's lines are judged: itself, but for cells of a table in an article or main what the table stands in."""
    out: list[int] = []
    for s, (tag, parent) in enumerate(sections):
        out.append(out[parent] if tag == "td" and parent in named else s)
    return out


def main_text(html: str | None, sigma: float = 1.0, share: float = 0.5, rest: float = 0.05) -> str:
    """The blocks of the article, joined by newlines; empty where there is none."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    sections = parser.sections
    named = _below(sections, {s for s, (tag, _) in enumerate(sections) if tag in ("article", "main")})
    lines, home = _unmarked(parser, named), _home(sections, named)
    kept = [i for i, line in enumerate(lines) if not line[3]]
    if not kept:
        return ""
    even = smooth([0.0 if dropped else len(text) / max(1, tags) for text, tags, _, dropped in lines], sigma)
    mean = sum(even) / len(even)
    threshold = share * math.sqrt(sum((x - mean) ** 2 for x in even) / len(even))
    clusters = [i for i in kept if even[i] >= threshold] or kept
    total = sum(len(lines[i][0]) for i in clusters)
    inner = [i for i in clusters if lines[i][2] in named]
    if inner and 2 * sum(len(lines[i][0]) for i in inner) >= total:
        # what stands outside of article and main is no content where they hold most of it
        clusters, kept = inner, [i for i in kept if lines[i][2] in named]
    balance, weight = Counter(), [0] * len(sections)
    for i in kept:
        balance[home[lines[i][2]]] -= len(lines[i][0])
    for i in clusters:
        balance[home[lines[i][2]]] += 2 * len(lines[i][0])
    for i in clusters:
        if balance[home[lines[i][2]]] >= 0:
            weight[lines[i][2]] += len(lines[i][0])
    for s in range(len(sections) - 1, 0, -1):
        weight[sections[s][1]] += weight[s]
    # the deepest named section, or else the deepest of any kind, that covers all content but a small share
    covers = [s for s, w in enumerate(weight) if w >= (1 - rest) * weight[0]]
    best = max([s for s in covers if sections[s][0] in ("article", "main")] or covers)
    inside = _below(sections, {best})
    return "\n".join(lines[i][0] for i in kept if lines[i][2] in inside and balance[home[lines[i][2]]] >= 0)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", sigma: float = 1.0, share: float = 0.5) -> DataFrame:
    """``pages`` without the html but with the main text of each page and n_chars, its code points.

    Null and empty html, and pages without an article, give an empty text. Character references are decoded, white
    space inside a block becomes one space, blocks are joined by one newline; no block is dropped for its
    length. Equal rows are treated alike; columns named like the two new ones are replaced. Pages of any length
    are streamed through the parser one at a time.
    """
    rest = [c for c in pages.columns if c not in (html_col, text_col, "n_chars")]
    own = "html" + "_" * max(map(len, pages.columns))  # longer than any column of the input
    picked = pages.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{html_col}`").cast("string").alias(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, sigma, share) for h in batch.column(batch.num_columns - 1).to_pylist()]
            arrays = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], text_col, "n_chars"])

    schema = picked.drop(own).schema.add(text_col, "string").add("n_chars", "long")
    return spread(picked, own).mapInArrow(run, schema)
