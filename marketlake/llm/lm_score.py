"""Log probabilities of texts under an n-gram model in Elias-Fano tries, trained on the corpus itself.

Texts are encoded once into blocks: the distinct words of some hundred thousand tokens and a code for each token. The model is learnt
depth by depth. At depth 1 every block asks for its words and its distinct (word before, word), with how often its training texts
have them. A shuffle by shard, a hash of the nearest word of the context, brings the questions to the model's shards. A shard adds up
the counts, writes its trie, and answers from it; the answers of a block are one file. At depth d only contexts and words are
asked for whose shorter n-grams were seen twice or more, since no others can repeat, so few tokens are left. One shuffle a depth both trains
and looks up, counts are added up before it, and very frequent words are spread over shards by the word that follows (depth 1) or stands
before them, so no task holds more than a shard.

The trie of a shard and depth starts with the monotone sequence of its words' hashes. A monotone sequence of pointers gives, for each
context, the range of the next level that holds the words before it, and another one the range of the words seen behind it. A search goes from
the word to the word before it and so on, each time by a successor search inside the range that the context before gave, and
then for the next word inside the last range. Next words carry their smoothed probability and contexts the weight
of the shorter context, quantised to eight bits. Levels are files in the shared folder, memory-mapped where that is a file system.

Smoothing is interpolated absolute discounting with a discount of one: p(w|h) = a(h, w) + g(h) * p(w|shorter h), a = (c(h, w) - 1) / c(h),
g the mass that is left, down to the add-one unigram. So one occurrence, such as a training text's own, vouches for nothing; only
behind single words it keeps ``single`` of its count. Higher levels hold repeated n-grams only, which keeps them small. The
beginning of a text is a word before its first one; contexts do not reach beyond it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.llm.elias_fano import EliasFano, dump, load
from marketlake.llm.shared import ascii_words, discard, hash_words, materialize, mix64, scratch_path, spread
from marketlake.llm.token_store import _get, _open, _put

#: A word cannot hold a space, so these are no words.
END = xxhash.xxh3_64_intdigest(b" end")
BEGIN = xxhash.xxh3_64_intdigest(b" begin")
#: Steps of the decimal logarithm between two codes, of probabilities and of weights.
_STEP, _WEIGHT_STEP = 0.03, 0.02
_32 = np.uint64(32)


def _short(hashes: np.ndarray) -> np.ndarray:
    """Words inside a context's range are told apart by 32 bits."""
    return (mix64(hashes) >> _32).astype(np.uint32)


def _quantise(p: np.ndarray, step: float) -> np.ndarray:
    """Codes 1 to 255 for probabilities up to 1; 0 means none."""
    return np.clip(255 + np.rint(np.log10(p) / step), 1, 255).astype(np.uint8)


def _values(codes: np.ndarray, step: float, none: float) -> np.ndarray:
    """The probabilities of codes, ``none`` for 0."""
    table = 10.0 ** ((np.arange(256) - 255) * step)
    table[0] = none
    return table[codes]


def _pack(columns: list[np.ndarray]) -> bytes:
    """Columns of numbers below 2^32 as one compressed string; bytes of one significance stand together."""
    head = np.array([len(columns), *map(len, columns)], dtype="<u4")
    planes = [np.ascontiguousarray(c, dtype="<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(planes))


def _unpack(raw: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n = int.from_bytes(raw[:4], "little")
    out, at = [], 4 * (n + 1)
    for size in np.frombuffer(raw, dtype="<u4", count=n, offset=4).tolist():
        planes = np.frombuffer(raw, dtype=np.uint8, count=4 * size, offset=at).reshape(4, size)
        out.append(np.ascontiguousarray(planes.T).view("<u4").ravel())
        at += 4 * size
    return out


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words of a text and of its end."""
    return np.append(hash_words(ascii_words(text)), np.uint64(END))


def encode_blocks(docs: DataFrame, id_col: str, text_col: str, learn: Column, limit: int = 800_000) -> DataFrame:
    """Blocks of about ``limit`` tokens, a text never cut: ids, which texts to learn from, tokens of each text, distinct words from the most
    frequent on, how often the block and its texts to learn from have each, and the place of each token's word."""

    def block(number: int, ids: list, learned: list[bool], parts: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(x) for x in parts], dtype="<u4")
        words, codes, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        place = np.empty(len(words), dtype=np.int64)
        place[order] = np.arange(len(words))
        words, codes, counts, flags = words[order], place[codes], counts[order], np.array(learned, dtype=bool)
        seen = np.bincount(codes[np.repeat(flags, sizes)], minlength=len(words))
        numbers = [number, len(codes), int(seen.sum()), int(flags.sum())]
        return pa.RecordBatch.from_arrays(
            [*[pa.array([x], pa.int64()) for x in numbers], pa.array([ids], pa.list_(pa.int64())), *[pa.array([x], pa.binary()) for x in (words.tobytes(), _pack([counts, seen]), _pack([flags, sizes, codes]))]],
            names=["block", "n", "learned", "texts", "ids", "words", "counts", "codes"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = TaskContext.get().partitionId() << 32, 0
        ids, learned, parts = [], [], []
        for batch in batches:
            for i, text, own in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                ids.append(i)
                learned.append(own)
                parts.append(tokens(text))
                total += len(parts[-1])
                if total >= limit:
                    yield block(number, ids, learned, parts)
                    number, total, ids, learned, parts = number + 1, 0, [], [], []
        if ids:
            yield block(number, ids, learned, parts)

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    schema = "block long, n long, learned long, texts long, ids array<long>, words binary, counts binary, codes binary"
    return spread(picked, "id").mapInArrow(run, schema)


class Depth:
    """What a block asks for at one depth: contexts in order of their nearest word (``root``), the words before that (``path``), and the
    (context, next word) entries in order of their contexts. ``at`` is the entry of each token, -1 for none."""

    def __init__(self, root: np.ndarray, path: list[np.ndarray], count: np.ndarray, owner: np.ndarray, word: np.ndarray, seen: np.ndarray, context: np.ndarray, at: np.ndarray) -> None:
        self.root, self.path, self.count, self.owner, self.word, self.seen, self.context, self.at = root, path, count, owner, word, seen, context, at
        self.weights, self.codes = np.zeros(len(root), dtype=np.uint8), np.zeros(len(owner), dtype=np.uint8)
        self.repeated = np.zeros(len(owner), dtype=bool)


class Block:
    """A block's words in order of their hashes, its tokens, and what it asks for at each depth."""

    def __init__(self, row: dict, shards: int, hot: np.ndarray) -> None:
        words, (_, seen), (flags, sizes, codes) = np.frombuffer(row["words"], dtype="<u8"), _unpack(row["counts"]), _unpack(row["codes"])
        n, rank = len(words), np.argsort(words)
        place = np.empty(n, dtype=np.int64)
        place[rank] = np.arange(n)
        self.number, self.shards, self.n, self.words, self.seen, self.codes = row["block"], shards, n, words[rank], seen[rank], place[codes]
        self.rank, self.of_rank, self.sizes = np.append(rank, n), np.append(place, n), sizes.astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.learned = np.repeat(flags.astype(bool), self.sizes)
        self.every = np.append(self.words, np.uint64(BEGIN))  # the last place is the beginning of a text
        self.key, self.short, self.hot = mix64(self.every), _short(self.every), np.isin(self.every, hot)
        self.counts = np.zeros(n + 1, dtype=np.int64)
        self.depths: list[Depth] = []

    def next_depth(self) -> None:
        n, codes, high = self.n, self.codes, lambda x: x.astype(np.uint64) << _32
        if not self.depths:
            before = np.append(n, codes[:-1])
            before[self.starts] = n
            root, path, count, raw, some = np.arange(n + 1), [], np.zeros(n + 1, dtype=np.int64), before, np.arange(len(codes))
        else:
            last = self.depths[-1]
            # a context of this depth is an entry of the last one, ending in the word before
            again = np.append(last.repeated, False)[last.at]
            raw = np.append(-1, np.where(again, last.at, -1)[:-1])
            raw[self.starts] = -1
            held = np.flatnonzero(raw >= 0)
            distinct, inverse = np.unique(raw[held], return_inverse=True)
            order = np.argsort(last.word[distinct], kind="stable")
            place = np.empty(len(distinct), dtype=np.int64)
            place[order] = np.arange(len(distinct))
            distinct, raw[held] = distinct[order], place[inverse]
            owner = last.owner[distinct]
            root, path = last.word[distinct], [last.root[owner], *[p[owner] for p in last.path]]
            count = np.bincount(raw[held][self.learned[held]], minlength=len(distinct))
            some = np.flatnonzero((raw >= 0) & again)
        entries, inverse = np.unique(high(raw[some]) | codes[some].astype(np.uint64), return_inverse=True)
        at = np.full(len(codes), -1, dtype=np.int64)
        at[some] = inverse
        seen = np.bincount(inverse[self.learned[some]], minlength=len(entries))
        self.depths.append(Depth(root, path, count, (entries >> _32).astype(np.int64), (entries & np.uint64(2**32 - 1)).astype(np.int64), seen, raw, at))

    def parts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(shard, words, which of them are at home there, contexts, entries of each context, entries) of the last depth, for each shard that is asked."""
        d, first = self.depths[-1], len(self.depths) == 1
        key = self.key[d.root]
        if first:
            by, split = key[d.owner], self.hot[d.root[d.owner]]
            by[split] ^= mix64(self.short[d.word[split]].astype(np.uint64))
            shard, home = (by % np.uint64(self.shards)).astype(np.int64), (self.key[: self.n] % np.uint64(self.shards)).astype(np.int64)
        else:
            split = self.hot[d.root]
            key[split] ^= mix64(self.short[d.path[0][split]].astype(np.uint64))
            home = (key % np.uint64(self.shards)).astype(np.int64)
            shard = home[d.owner]
        small = np.uint16 if self.shards < 1 << 16 else np.int64
        order, homes = np.argsort(shard.astype(small), kind="stable"), np.argsort(home.astype(small), kind="stable")
        marked = np.zeros(self.n + 1, dtype=bool)
        cuts, home_cuts = (np.searchsorted(x, np.arange(self.shards + 1)) for x in (shard[order], home[homes]))
        for s in range(self.shards):
            entries, own = order[cuts[s] : cuts[s + 1]], homes[home_cuts[s] : home_cuts[s + 1]]
            if not len(entries) and not len(own):
                continue
            owner = d.owner[entries]
            if first:
                contexts = owner[np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))] if len(owner) else owner
                marked[own] = True
                marked[contexts] = True
                words = np.flatnonzero(marked)
                marked[contexts] = False
                marked[own] = True
                at_home = marked[words]
                marked[own] = False
            else:
                contexts, roots = own, d.root[own]
                words = roots[np.flatnonzero(np.append(True, roots[1:] != roots[:-1]))] if len(roots) else roots
                at_home = np.zeros(len(words), dtype=bool)
            yield s, words, at_home, contexts, np.bincount(np.searchsorted(contexts, owner), minlength=len(contexts)), entries

    def requests(self) -> Iterator[tuple[int, bytes]]:
        """(shard, its part as a string): its words, their counts and, by place in a list of the 32-bit words it uses, its contexts and next words."""
        d = self.depths[-1]
        place, every_seen, marked = np.empty(self.n + 1, dtype=np.int64), np.append(self.seen, 0), np.zeros(self.n + 1, dtype=bool)
        for s, words, at_home, contexts, degree, entries in self.parts():
            columns = [*[p[contexts] for p in d.path], d.word[entries]]
            for c in columns:
                marked[self.rank[c]] = True
            ranks = np.flatnonzero(marked)
            marked[ranks] = False
            used = self.of_rank[ranks]  # frequent words have small places
            place[used] = np.arange(len(used))
            per_word = np.bincount(np.searchsorted(words, d.root[contexts]), minlength=len(words))
            halves = self.every[words].view("<u4").reshape(-1, 2)
            yield s, _pack([halves[:, 0], halves[:, 1], np.where(at_home, every_seen[words], 0), self.short[used], per_word, d.count[contexts], degree, d.seen[entries], *[place[c] for c in columns]])

    def take(self, answers: dict[str, np.ndarray], texts: int) -> None:
        """Fill in the last depth from the shards' answers; ``texts`` is how often the model has seen the beginning of a text."""
        d, first = self.depths[-1], len(self.depths) == 1
        for s, words, at_home, contexts, _, entries in self.parts():
            if str(s) not in answers:
                continue
            raw = zstandard.ZstdDecompressor().decompress(answers[str(s)].tobytes())
            own = contexts
            if first:
                self.counts[words[at_home]] = np.frombuffer(raw, dtype="<u8", count=len(words))[at_home]
                own = words
            codes = np.frombuffer(raw, dtype=np.uint8, offset=8 * len(words) * first)
            d.weights[own] = np.maximum(d.weights[own], codes[: len(own)])
            d.codes[entries] = codes[len(own) :]
        if first:
            self.counts[self.n] = texts
            # a word seen once keeps much less than one of its context's count
            d.repeated = _values(d.codes, _STEP, 0.0) * self.counts[d.root[d.owner]] > 0.5
        else:
            d.repeated = d.codes > 0


class Request:
    """A part as a shard reads it."""

    def __init__(self, raw: bytes) -> None:
        low, high, self.seen, used, per_word, self.total, degree, self.count, *columns = _unpack(raw)
        self.words, self.per_word, self.degree = high.astype(np.uint64) << _32 | low, per_word.astype(np.int64), degree.astype(np.int64)
        *self.path, self.next = [used[c] for c in columns]


def build_trie(requests: list[Request], depth: int, single: float, hot: np.ndarray, hot_counts: np.ndarray) -> dict[str, np.ndarray]:
    """The levels of a shard for one depth from all requests for it. The weight of a frequent word needs other shards; here its mass is kept."""
    words = np.unique(np.concatenate([r.words for r in requests]))
    places = [np.searchsorted(words, r.words) for r in requests]
    parent = np.concatenate([np.repeat(p, r.per_word) for p, r in zip(places, requests, strict=True)])
    out = EliasFano.build(words, 2**64).arrays("words")
    keys, which = np.arange(len(words), dtype=np.uint64), parent
    if depth == 1:
        totals = np.bincount(np.concatenate(places), weights=np.concatenate([r.seen for r in requests]), minlength=len(words)).astype(np.int64)
        out["totals"] = totals.astype("<u4" if totals.max() < 2**32 else "<u8")
    for j in range(depth - 1):
        above = len(keys)
        keys, which = np.unique(which.astype(np.uint64) << _32 | np.concatenate([r.path[j] for r in requests]), return_inverse=True)
        parents = np.searchsorted((keys >> _32).astype(np.int64), np.arange(above + 1)).astype(np.uint64)
        out |= EliasFano.build(parents, len(keys) + 1).arrays(f"contexts{j + 2}")
        out[f"before{j + 2}"] = (keys & np.uint64(2**32 - 1)).astype("<u4")
    degree, next_, count = (np.concatenate([getattr(r, x) for r in requests]) for x in ("degree", "next", "count"))
    seen = count > 0
    entry, at = np.unique(np.repeat(which, degree)[seen].astype(np.uint64) << _32 | next_[seen], return_inverse=True)
    c = np.bincount(at, weights=count[seen], minlength=len(entry))
    context, next_ = (entry >> _32).astype(np.int64), (entry & np.uint64(2**32 - 1)).astype("<u4")
    total = np.bincount(context, weights=c, minlength=len(keys)) if depth == 1 else np.bincount(which, weights=np.concatenate([r.total for r in requests]), minlength=len(keys))
    split = np.zeros(len(words), dtype=bool)
    if depth == 1 and len(hot):
        frequent = np.minimum(np.searchsorted(hot, words), len(hot) - 1)
        split = hot[frequent] == words
        total = np.where(split, hot_counts[frequent], total)
    share = np.where(c > 1, c - 1, single if depth == 1 else 0.0) / total[context]
    mass = np.bincount(context, weights=share, minlength=len(keys))
    weight = np.where(total > 0, _quantise(np.maximum(1 - mass, 1e-9), _WEIGHT_STEP), 0).astype(np.uint8)
    if depth == 1:
        weight[split] = 0
        out["hot"], out["hot_mass"] = words[split], mass[split]
    stay = share > 0
    ends = np.searchsorted(context[stay], np.arange(len(keys) + 1)).astype(np.uint64)
    codes = _quantise(share[stay], _STEP) if stay.any() else np.empty(0, np.uint8)
    return out | EliasFano.build(ends, int(stay.sum()) + 1).arrays("ranges") | {"next": next_[stay], "codes": codes, "weights": weight}


def _inside(values: np.ndarray, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The place of each x in its own range [low, high) of values, which is sorted there; -1 where it is not."""
    low, end = low.copy(), high.copy()
    open_ = np.flatnonzero(low < end)
    while len(open_):
        middle = (low[open_] + end[open_]) // 2
        less = values[middle] < x[open_]
        low[open_] = np.where(less, middle + 1, low[open_])
        end[open_] = np.where(less, end[open_], middle)
        open_ = open_[low[open_] < end[open_]]
    out = np.full(len(x), -1, dtype=np.int64)
    some = np.flatnonzero(low < high)
    some = some[values[low[some]] == x[some]]
    out[some] = low[some]
    return out


class Trie:
    """One shard of the model, of one depth."""

    def __init__(self, path: str, depth: int) -> None:
        where, name = _open(path)
        local = isinstance(where, fs.LocalFileSystem)
        self.depth, self.arrays = depth, load(np.memmap(name, dtype=np.uint8, mode="r") if local else np.frombuffer(_get(path), dtype=np.uint8))
        self.words, self.ranges = EliasFano.of(self.arrays, "words"), EliasFano.of(self.arrays, "ranges")
        self.contexts = [EliasFano.of(self.arrays, f"contexts{d}") for d in range(2, depth + 1)]

    @staticmethod
    def _range(pointers: EliasFano, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range that belongs to each place, empty for -1."""
        low, high = np.zeros((2, len(at)), dtype=np.int64)
        some = np.flatnonzero(at >= 0)
        low[some] = pointers.get(at[some])
        high[some] = pointers.get(at[some] + 1)
        return low, high

    def answer(self, request: Request) -> bytes:
        """At depth 1 the counts of the words; then the weights of the contexts (at depth 1 of all words) and the codes of the next words."""
        a, out = self.arrays, []
        picked = lambda values, at: np.where(at >= 0, values[np.maximum(at, 0)], 0) if len(values) else np.zeros(len(at), dtype=np.uint8)
        place = self.words.find(request.words)
        at = np.repeat(place, request.per_word)
        if self.depth == 1:
            out.append(picked(a["totals"], place).astype("<u8").tobytes())
        for d, (pointers, before) in enumerate(zip(self.contexts, request.path, strict=True), 2):
            if d == 2:
                low, high = (np.repeat(x, request.per_word) for x in self._range(pointers, place))
            else:
                low, high = self._range(pointers, at)
            at = _inside(a[f"before{d}"], low, high, before)
        out.append(picked(a["weights"], place if self.depth == 1 else at).astype(np.uint8).tobytes())
        low, high = self._range(self.ranges, at)
        found = _inside(a["next"], np.repeat(low, request.degree), np.repeat(high, request.degree), request.next)
        out.append(picked(a["codes"], found).astype(np.uint8).tobytes())
        return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


class Model:
    """A trained model: a folder of tries, and what all shards need to know. ``hot`` are frequent words with their weights."""

    def __init__(self, path: str, order: int, shards: int, tokens: int, words: int, texts: int, hot: dict[int, float]) -> None:
        self.path, self.order, self.shards, self.tokens, self.words, self.texts, self.hot = path, order, shards, tokens, words, texts, hot


def _hot_words(blocks: DataFrame, shards: int, tokens_n: int) -> dict[int, int]:
    """Words (and the beginning of a text) with about an eighth of a shard's tokens or more, with their counts in the texts to learn
    from: fewer than 8 * shards. Where a word's lists are kept depends on this, results do not."""

    def local(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        (counts, seen), (flags, *_) = _unpack(row["counts"]), _unpack(row["codes"])
        words = np.append(np.frombuffer(row["words"], dtype="<u8"), np.uint64(BEGIN))
        return words, np.append(counts, len(flags)).astype(np.int64), np.append(seen, flags.sum()).astype(np.int64)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, counts, _ = local(row)
                many = counts * 8 * shards > counts.sum()
                yield pa.RecordBatch.from_arrays([pa.array(words[many].view(np.int64)), pa.array(counts[many])], names=["word", "n"])

    picked = blocks.select("words", "counts", "codes")
    rows = picked.mapInArrow(frequent, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") * 8 * shards > tokens_n).select("word").collect()
    hot = np.sort(np.array([r[0] % 2**64 for r in rows], dtype=np.uint64))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, _, seen = local(row)
                own = np.isin(words, hot)
                yield pa.RecordBatch.from_arrays([pa.array(words[own].view(np.int64)), pa.array(seen[own])], names=["word", "n"])

    if not len(hot):
        return {}
    return {r["word"] % 2**64: r["n"] for r in picked.mapInArrow(exact, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}


def _read_block(row: dict, depth: int, answers: str, shards: int, hot: np.ndarray, texts: int) -> Block:
    """A block with the answers to all depths below ``depth``, ready for that one."""
    block = Block(row, shards, hot)
    for d in range(1, depth):
        block.next_depth()
        file = f"{answers}/{d}-{block.number}.bin"
        where, name = _open(file)
        block.take(load(np.frombuffer(_get(file), dtype=np.uint8)) if where.get_file_info(name).is_file else {}, texts)
    return block


_STATS = "n_words long, hot array<long>, mass array<double>"


def _ask(blocks: DataFrame, depth: int, path: str, answers: str, shards: int, texts: int, single: float | None, hot: dict[int, int]) -> DataFrame:
    """Ask the shards for one depth; the answers to a block are written as a file. With ``single`` tries are built from the questions
    first. Gives, for each shard, what it built: its number of words, and the masses of its part of frequent words."""
    names = np.sort(np.array(list(hot), dtype=np.uint64))
    counts = np.array([hot[int(w)] for w in names], dtype=np.int64)

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _read_block(row, depth, answers, shards, names, texts)
                block.next_depth()
                rows = [(s, block.number, raw) for s, raw in block.requests()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["shard", "block", "request"])

    def answer(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        file = f"{path}/trie-{depth}-{shard:05d}.bin"
        asked, rows = [Request(x.as_buffer()) for x in group.column("request")], []
        if single is not None:
            arrays = build_trie(asked, depth, single, names, counts)
            held, mass = (arrays.pop(n, np.empty(0)) for n in ("hot", "hot_mass"))
            _put(file, dump(arrays))
            rows.append((None, shard, None, int((arrays["totals"] > 0).sum()) if depth == 1 else 0, held.astype(np.uint64).view(np.int64).tolist(), mass.tolist()))
            del arrays
        where, name = _open(file)
        if where.get_file_info(name).is_file:
            trie = Trie(file, depth)
            rows += [(block, shard, trie.answer(r), None, None, None) for block, r in zip(group.column("block").to_pylist(), asked, strict=True)]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())]
        columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("block", "shard", "answer", "n_words", "hot", "mass"), columns, kinds, strict=True)})

    def keep(group: pa.Table) -> pa.Table:
        block = group.column("block")[0].as_py()
        if block is None:
            return group.select(["n_words", "hot", "mass"])
        _put(f"{answers}/{depth}-{block}.bin", dump({str(s): np.frombuffer(x.as_buffer(), dtype=np.uint8) for s, x in zip(group.column("shard").to_pylist(), group.column("answer"), strict=True)}))
        return group.select(["n_words", "hot", "mass"]).slice(0, 0)

    def answer_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a partition is one shard
        if whole := [b for b in batches if b.num_rows]:
            yield from answer(pa.Table.from_batches(whole)).to_batches()

    asked = blocks.select("block", "words", "counts", "codes").mapInArrow(requests, "shard int, block long, request binary")
    said = asked.repartitionById(shards, "shard").mapInArrow(answer_all, f"block long, shard long, answer binary, {_STATS}")
    return materialize(said.groupBy("block").applyInArrow(keep, _STATS), "shards")


def learn_and_ask(blocks: DataFrame, path: str, answers: str, order: int, single: float, shard_tokens: int) -> Model:
    """A model of the blocks' texts to learn from; its answers to all blocks are written on the way."""
    n, learned, texts = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "learned", "texts")]).first()
    shards = max(1, -(-n // shard_tokens), min(blocks.sparkSession.sparkContext.defaultParallelism, n // 200_000))
    hot = _hot_words(blocks, shards, n) if shards > 1 else {}
    for folder in (path, answers):
        where, name = _open(folder)
        where.create_dir(name, recursive=True)
    model = Model(path, order, shards, learned, 0, texts, {})
    for depth in range(1, order):
        built = _ask(blocks, depth, path, answers, shards, texts, single, hot)
        if depth == 1:
            model.words = built.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
            masses = built.select(F.explode(F.arrays_zip("hot", "mass")).alias("x")).groupBy("x.hot").agg(F.sum("x.mass").alias("mass")).collect() if hot else []
            # quantised as in a trie, so that it makes no difference which words are frequent
            own = {r["hot"] % 2**64: float(_values(_quantise(np.maximum(1 - r["mass"], 1e-9), _WEIGHT_STEP), _WEIGHT_STEP, 1.0)) for r in masses}
            model.hot = {w: own.get(w, 1.0) if c else 1.0 for w, c in hot.items()}
        discard(built)
    return model


def score_blocks(blocks: DataFrame, answers: str, model: Model) -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) for each text of the blocks, from the shards' answers to them."""
    order, shards, texts, z = model.order, model.shards, model.texts, model.tokens + model.words + 1
    hot = np.sort(np.array(list(model.hot), dtype=np.uint64))
    hot_weights = np.array([model.hot[int(w)] for w in hot])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _read_block(row, order, answers, shards, hot, texts)
                counts = block.counts[: block.n]
                first = (counts + 1) / z
                p = first[block.codes]
                for depth, d in enumerate(block.depths):
                    weight = _values(d.weights, _WEIGHT_STEP, 1.0)
                    if depth == 0 and len(hot):
                        at = np.minimum(np.searchsorted(hot, block.every), len(hot) - 1)
                        weight = np.where(block.hot, hot_weights[at], weight)
                    p = np.append(_values(d.codes, _STEP, 0.0), 0.0)[d.at] + np.append(weight, 1.0)[d.context] * p
                sums = [np.add.reduceat(x, block.starts) for x in ((counts > 0)[block.codes].astype(np.int64), np.log10(first)[block.codes], np.log10(p))]
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), *map(pa.array, (block.sizes, *sums))], names=["id", "n_tokens", "n_known", "base_score", "score"])

    return blocks.select("block", "ids", "words", "counts", "codes").mapInArrow(run, "id long, n_tokens long, n_known long, base_score double, score double")


def train(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", order: int = 3, single: float = 0.01, shard_tokens: int = 3_000_000) -> Model:
    """Train on all given documents and write the tries to ``path``."""
    blocks = materialize(encode_blocks(docs, id_col, text_col, F.lit(True)), "blocks")
    return learn_and_ask(blocks, path, scratch_path(docs.sparkSession, "asked"), order, single, shard_tokens)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) for each row of ``docs``, by a model that was trained before."""
    answers = scratch_path(docs.sparkSession, "asked")
    where, name = _open(answers)
    where.create_dir(name, recursive=True)
    blocks = materialize(encode_blocks(docs, id_col, text_col, F.lit(False)), "blocks")
    for depth in range(1, model.order):
        _ask(blocks, depth, model.path, answers, model.shards, model.texts, None, dict.fromkeys(model.hot, 0))
    return score_blocks(blocks, answers, model).withColumnRenamed("id", id_col)


def train_part(id_col: Column, folds: int = 7, out: int = 2) -> Column:
    """Whether a row is held out of training: crc32 of its id as text modulo ``folds`` is ``out``. False for a null id."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds)) == out, F.lit(False))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, single: float = 0.01, shard_tokens: int = 3_000_000, limit: int = 800_000) -> DataFrame:
    """One row for each row of ``docs``: (id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    The model is trained on the documents that are not held out and scores all of them. base_score is of the
    add-one unigram model, score of the smoothed model of ``order`` words (2 or more), both log10. Null and empty texts are their end alone. Rows without an
    id are trained on and scored; equal rows count and are scored one by one. Other columns are ignored. Without
    training documents all words are unknown. An empty table gives an empty result.

    single: share of a count that a word seen once behind a word keeps; shard_tokens: tokens of the corpus for each shard of the model;
    limit: tokens of a block. Scores do not depend on the last two.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    held = train_part(F.col(id_col))
    blocks, answers = materialize(encode_blocks(docs, id_col, text_col, ~held, limit), "blocks"), scratch_path(docs.sparkSession, "asked")
    model = learn_and_ask(blocks, scratch_path(docs.sparkSession, "ngrams"), answers, order, single, shard_tokens)
    out = score_blocks(blocks, answers, model).withColumnRenamed("id", id_col)
    return out.withColumn("held_out", held).withColumn("train_tokens", F.lit(model.tokens).cast("long")).select(
        id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
