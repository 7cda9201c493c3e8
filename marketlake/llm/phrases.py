"""Phrases: contiguous words that occur together more often than their parts would by chance, counted in counting quotient filters."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from marketlake.llm import quotient_filter as qf
from marketlake.llm.shared import materialize, passing_tables, spread_rows

_BREAK = b"\xff"  # no byte of UTF-8
_BYTES = bytes(0xFF if x in b".,;:!?\n\x0b\x0c\r" else 0x20 if x == 9 else x + 32 if 65 <= x <= 90 else x for x in range(256))
_GAP = re.compile(rb"[ \xff]")
_CHUNK = 1 << 20


def pieces(text: str) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lower-cased, with a break between pieces; some at a time, so that a long text is never one list."""
    raw, at = text.encode("utf-8", "surrogatepass").translate(_BYTES), 0
    while at < len(raw):
        gap = _GAP.search(raw, at + _CHUNK) if at + _CHUNK < len(raw) else None
        end = gap.end() if gap else len(raw)
        yield raw[at:end].replace(_BREAK, b" \xff ").split()
        at = end


class _Block:
    """Texts as local word ids, 0 between pieces, with the words and how often they occur; ``skip`` ids are repeated from the block before."""

    def __init__(self, carried: list[tuple[str, bytes]]) -> None:
        self.words: list[tuple[str, bytes]] = []
        self.by_lang: dict[str, dict[bytes, int]] = {}
        self.parts = [np.array([self.ids(lang)[w] for lang, w in carried], np.uint32)]
        self.skip, self.size = len(carried), len(carried)

    def ids(self, lang: str) -> dict[bytes, int]:
        if lang not in self.by_lang:
            words = self.words

            class Ids(dict):
                def __missing__(self, word: bytes) -> int:
                    words.append((lang, word))
                    self[word] = len(words)
                    return len(words)

            self.by_lang[lang] = Ids({_BREAK: 0})
        return self.by_lang[lang]

    def add(self, lang: str, words: list[bytes]) -> None:
        own = self.ids(lang)
        self.parts.append(np.fromiter(map(own.__getitem__, words), np.uint32, len(words)))
        self.size += len(words)

    def row(self, number: int) -> pa.RecordBatch:
        ids, langs = np.concatenate(self.parts), list(self.by_lang)
        counts = np.bincount(ids[self.skip :], minlength=len(self.words) + 1)[1:]
        words = pa.array([w for _, w in self.words], pa.binary()).cast(pa.string())
        at = {lang: i for i, lang in enumerate(langs)}
        one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
        tokens = zstandard.ZstdCompressor().compress(ids.tobytes())
        columns = [pa.array([number], pa.int64()), pa.array([self.skip], pa.int32()), pa.array([tokens], pa.binary()), one(langs, pa.string()), one([at[x] for x, _ in self.words], pa.int32()), one(words, pa.string()), one(counts, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["block", "skip", "tokens", "langs", "lang_at", "words", "counts"])

    def tail(self, n: int) -> list[tuple[str, bytes]]:
        """The last words of an open piece, fewer than n of them."""
        ids = np.concatenate(self.parts)[-n:] if n else np.zeros(0, np.uint32)
        stop = np.flatnonzero(ids == 0)
        return [self.words[i - 1] for i in ids[stop[-1] + 1 if len(stop) else 0 :]]


def _blocks(docs: DataFrame, longest: int, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = (TaskContext.get().partitionId() << 32), _Block([])
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for words in pieces(text.as_py()):
                    block.add(lang, words)
                    if block.size >= size:
                        yield block.row(number)
                        number, block = number + 1, _Block(block.tail(longest - 1))
                block.add(lang, [_BREAK])
        if block.words:
            yield block.row(number)

    return docs.mapInArrow(run, "block long, skip int, tokens binary, langs array<string>, lang_at array<int>, words array<string>, counts array<long>")


def _known(words: DataFrame, blocks: DataFrame, least: int) -> DataFrame:
    """(block, local, id, lang, word, count): the id of each block's frequent words; language, word and count stand in one row of each word only.

    Words are dealt into buckets by hash and sorted there once: that gives their counts, ids without gaps in a bucket, and each block's share.
    """
    rows = blocks.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    buckets = max(64, int(rows // 200_000))
    own = Window.partitionBy("bucket", "lang", "word")
    found = words.withColumn("bucket", F.pmod(F.xxhash64("lang", "word"), F.lit(buckets))).repartition("bucket").withColumn("count", F.sum("count").over(own)).filter(F.col("count") >= least)
    found = found.withColumn("rank", F.dense_rank().over(Window.partitionBy("bucket").orderBy("lang", "word"))).withColumn("first", F.row_number().over(own.orderBy("block")) == 1)
    shown = [F.when(F.col("first"), F.col(c)).alias(c) for c in ("lang", "word", "count")]
    return found.select("block", "local", ((F.col("rank") - 1) * buckets + F.col("bucket") + 1).alias("id"), *shown)


def _send(found: dict[int, tuple], lengths: dict[int, int], shared: int, step: int, sender: int) -> pd.DataFrame:
    """A row for each range, with the filter of each length."""
    out: dict[int, dict[int, bytes]] = {}
    for n, (limbs, counts) in found.items():
        for part, blob in qf.split(limbs, counts, lengths[n], shared, step):
            out.setdefault(part, {})[n] = blob
    return pd.DataFrame({"part": list(out), "sender": [sender] * len(out), "filters": pd.Series([[x.get(n, b"") for n in lengths] for x in out.values()], dtype=object)})


def _merged(rows: pd.DataFrame, lengths: dict[int, int]) -> dict[int, tuple]:
    found = {n: [x[i] for x in rows["filters"] if len(x[i])] for i, n in enumerate(lengths)}
    return {n: qf.merge(blobs) for n, blobs in found.items() if blobs}


def _answers(rows: pd.DataFrame, kept: np.ndarray, size: int) -> list[tuple]:
    """(part, sender, filter) of those of each sender's pairs that are among the sorted keys."""
    out = []
    for part, sender, filters in zip(rows["part"], rows["sender"], rows["filters"], strict=True):
        (mine,), _ = qf.decode(filters[0])
        mine = mine[_among(mine, kept)]
        if len(mine):
            out.append((part, sender, qf.encode([mine], np.ones(len(mine), np.int64), size)))
    return out


def _among(x: np.ndarray, kept: np.ndarray) -> np.ndarray:
    at = np.searchsorted(kept, x)
    return (at < len(kept)) & (kept[np.minimum(at, max(0, len(kept) - 1))] == x) if len(kept) else np.zeros(len(x), bool)


_MESSAGE = "part long, sender long, filters array<binary>"


def _tally(sent: DataFrame, lengths: dict[int, int], bits: int, groups: int, least: int, fan_bits: int, answer: bool) -> tuple[DataFrame, DataFrame]:
    """(key, f) of what occurs ``least`` times or more over all messages (part, sender, filters), and the answers (sender, filter) with each block's
    pairs among it.

    While several groups hold a range, each merges its filters and splits the range further; then these are merged in turn, so the messages of a
    round grow with the input and the rounds with its logarithm. Answers go back the same way.
    """
    fan, shared, levels = 1 << fan_bits, fan_bits, []

    def merge_at(shared: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
        return lambda key, rows: _send(_merged(rows, lengths), lengths, shared, fan_bits, key[1])

    def finish(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys, counts, answers = [], [], []
        for n, (limbs, f) in _merged(rows, lengths).items():
            kept = [x[f >= least] for x in limbs]
            keys += list(np.stack(qf.unpack(qf.restore(kept, lengths[n]), bits, n, lengths[n]), axis=1).astype(np.int64))
            counts += f[f >= least].tolist()
            if answer:
                answers = _answers(rows, kept[0], lengths[n])
        none = [None] * len(answers)
        return pd.DataFrame({
            "key": pd.Series(keys + none, dtype=object), "f": pd.array(counts + none, "Int64"), "part": pd.array([None] * len(keys) + [x[0] for x in answers], "Int64"),
            "sender": pd.array([None] * len(keys) + [x[1] for x in answers], "Int64"), "filter": pd.Series([None] * len(keys) + [x[2] for x in answers], dtype=object),
        })

    def narrow(key: tuple, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        kept = np.sort(np.concatenate([np.zeros(0, np.uint64), *[qf.decode(x)[0][0] for x in above["filter"]]]))
        out = _answers(rows, kept, lengths[2])
        return pd.DataFrame({"part": [x[0] for x in out], "sender": [x[1] for x in out], "filter": pd.Series([x[2] for x in out], dtype=object)})

    rows = sent.withColumn("group", F.pmod(F.xxhash64("sender"), F.lit(groups)))
    while groups > 1:
        if answer:
            rows = materialize(rows, "messages")
            levels.append(rows)
        rows = rows.groupBy("part", "group").applyInPandas(merge_at(shared), _MESSAGE).withColumn("group", F.floor(F.col("sender") / fan))
        shared, groups = shared + fan_bits, -(-groups // fan)
    done = materialize(rows.groupBy("part", "group").applyInPandas(finish, "key array<long>, f long, part long, sender long, filter binary"), "tallied")
    answers = done.filter("key IS NULL").select("part", "sender", "filter")
    for rows in reversed(levels):
        above = answers.select(F.floor(F.col("part") / fan).alias("p"), F.col("sender").alias("g"), "filter")
        down = rows.groupBy("part", "group").cogroup(above.groupBy("p", "g")).applyInPandas(narrow, "part long, sender long, filter binary")
        answers = materialize(down, "answers")
    return done.filter("key IS NOT NULL").select("key", "f"), answers.select("sender", "filter")


def count_phrases(known: DataFrame, blocks: DataFrame, least: int, longest: int, fan_bits: int) -> DataFrame:
    """(key, f): arrays of the ids of 2 to ``longest`` words that occur ``least`` times or more.

    Each block makes one filter of its pairs of words and sends each range of it to its own group, where the sorted filters of up to
    2^fan_bits blocks are merged. Each block is told which of its pairs are frequent; only longer n-grams all of whose pairs are so can be,
    and only these are sent in the second turn. The permutation makes ranges alike, whatever words are frequent.
    """
    bits = max(1, int(known.agg(F.max("id")).first()[0] or 0).bit_length())
    if bits > 31:
        raise ValueError("more than 2^31 frequent words")
    groups = -(-max(1, blocks.count()) // (1 << fan_bits))
    lengths = {n: qf.key_bits(n, bits) for n in range(2, longest + 1)}  # each length has filters of its own, as wide as its ids

    def sender(mine: dict[int, int]) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
        def send(key: tuple, block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            grams, own = {}, asked["word"].to_numpy(np.int64)
            own = own[own >= 0]
            if len(block) and len(own):
                at, own = own >> 32, (own & 0xFFFFFFFF).astype(np.uint64)
                one = block.iloc[0]
                local = np.frombuffer(zstandard.ZstdDecompressor().decompress(one["tokens"]), np.uint32)
                ids = np.zeros(max(int(local.max()), int(at.max())) + 1, np.uint64)
                ids[at] = own
                ids = ids[local]
                pair = (ids[:-1] > 0) & (ids[1:] > 0)
                if 2 not in mine:  # the second turn
                    frequent = np.sort(np.concatenate([np.zeros(0, np.uint64), *[qf.decode(x)[0][0] for x in asked["filter"] if x is not None]]))
                    at = np.flatnonzero(pair)
                    (packed,) = qf.permute(qf.pack([ids[at], ids[at + 1]], bits, lengths[2]), lengths[2])
                    pair[at] = _among(packed, frequent) | (at < int(one["skip"]) - 1)  # pairs of the block before were not asked for here
                for n, size in mine.items():
                    if len(ids) >= n:
                        whole = np.logical_and.reduce([pair[i : len(pair) - n + 2 + i] for i in range(n - 1)])
                        whole[: max(0, int(one["skip"]) - n + 1)] = False  # these end in the block before
                        at = np.flatnonzero(whole)
                        if len(at):
                            limbs = qf.permute(qf.pack([ids[at + i] for i in range(n)], bits, size), size)
                            grams[n] = qf.combine(limbs, np.ones(len(at), np.int64))
            return _send(grams, mine, 0, fan_bits, key[0])

        return send

    texts = blocks.select("block", "skip", "tokens").groupBy("block")
    asked = known.select(F.col("block").alias("of"), F.shiftleft(F.col("local").cast("long"), 32).bitwiseOR(F.col("id")).alias("word"))  # both in one number
    pairs = {2: lengths[2]}
    found, answers = _tally(texts.cogroup(asked.groupBy("of")).applyInPandas(sender(pairs), _MESSAGE), pairs, bits, groups, least, fan_bits, longest > 2)
    if longest == 2:
        return found
    # answers have -1, not null: a column of numbers with nulls would come as doubles, which are too short
    told = asked.unionByName(answers.select(F.col("sender").alias("of"), F.lit(-1).cast("long").alias("word"), "filter"), allowMissingColumns=True)
    longer = {n: size for n, size in lengths.items() if n > 2}
    return found.unionByName(_tally(texts.cogroup(told.groupBy("of")).applyInPandas(sender(longer), _MESSAGE), longer, bits, groups, least, fan_bits, False)[0])


def phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, longest: int = 5, inside: int = 100, top: int = 2000, block_tokens: int = 1 << 20, fan_bits: int = 8, salts: int = 8
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the ``top`` phrases of each language, null being ``und``.

    A phrase is 2 to ``longest`` words within a piece that occur a >= ``least`` times. Of its cuts into l and r occurrences the one with the least
    floor(1000 a n / (l r)) counts, n being all words of the language; the products are exact decimals. A phrase inside a longer one of at
    least ``inside`` per cent of its occurrences goes; that one of one more word will do, since no longer phrase occurs more often.
    Words below ``least`` are in no phrase, so only others get ids; blocks of about ``block_tokens`` words ask for the ids of
    their distinct words. Look-ups of single words are salted, tops are taken among 64 parts of a language first. Null and empty texts
    have no words, repeated rows count each time, an empty table has no phrases; no other columns are read. Long texts are cut into blocks
    that overlap by the words a phrase may span.
    """
    with passing_tables():
        picked = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
        blocks = materialize(_blocks(spread_rows(picked.filter("text <> ''")), longest, block_tokens), "blocks")
        words = blocks.select("block", "langs", F.posexplode(F.arrays_zip("lang_at", "words", "counts")).alias("at", "w"))
        words = words.select("block", (F.col("at") + 1).alias("local"), F.element_at("langs", F.col("w.lang_at") + 1).alias("lang"), F.col("w.words").alias("word"), F.col("w.counts").alias("count"))
        totals = materialize(words.groupBy("lang").agg(F.sum("count").alias("n")), "totals")
        known = materialize(_known(words, blocks, least), "known")
        vocabulary = known.filter("word IS NOT NULL").select("id", "lang", "word", "count")
        found = materialize(count_phrases(known, blocks, least, longest, fan_bits), "found")
        # words of phrases: a frequent word is asked for by many, so each asks one of its copies
        copies = vocabulary.select("id", "lang", "word", "count", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        asked = found.select("key", "f", F.posexplode("key").alias("at", "id")).withColumn("salt", F.pmod(F.xxhash64("key", "at"), F.lit(salts)).cast("int"))
        spelled = asked.join(copies, ["id", "salt"]).groupBy("key").agg(F.first("f").alias("a"), F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word", "count"))).alias("w"))
        spelled = spelled.select("key", "a", "lang", F.array_join("w.word", " ").alias("phrase"), F.element_at("w.count", 1).alias("first"), F.element_at("w.count", -1).alias("last"))
        longer = found.filter(F.size("key") > 2).select(F.explode(F.array(F.expr("slice(key, 1, size(key) - 1)"), F.expr("slice(key, 2, size(key) - 1)"))).alias("key"), "f")
        longer = longer.groupBy("key").agg(F.max("f").alias("longer"))
        spelled = materialize(spelled.join(longer, "key", "left").filter(f"longer IS NULL OR 100 * longer < {inside} * a").drop("longer"), "spelled")
        few = totals.count() <= 10_000
        spelled = spelled.join(F.broadcast(totals) if few else totals, "lang")
        # cuts: single words are known, others are looked up; a part that is a word asks for its own phrase, so no key is asked for by all
        cuts = spelled.select("*", F.explode(F.expr("sequence(1, size(key) - 1)")).alias("k"))
        cuts = cuts.withColumn("left", F.when(F.col("k") == 1, F.col("key")).otherwise(F.expr("slice(key, 1, k)")))
        cuts = cuts.withColumn("right", F.when(F.col("k") == F.size("key") - 1, F.col("key")).otherwise(F.expr("slice(key, k + 1, size(key) - k)")))
        cuts = cuts.join(found.select(F.col("key").alias("left"), F.col("f").alias("fl")), "left").join(found.select(F.col("key").alias("right"), F.col("f").alias("fr")), "right")
        cuts = cuts.withColumn("l", F.when(F.col("k") == 1, F.col("first")).otherwise(F.col("fl"))).withColumn("r", F.when(F.col("k") == F.size("key") - 1, F.col("last")).otherwise(F.col("fr")))
        big = lambda c: f"CAST({c} AS DECIMAL(18,0))"
        cuts = cuts.withColumn("score", F.expr(f"(CAST(1000 AS DECIMAL(4,0)) * ({big('a')} * {big('n')})) div ({big('l')} * {big('r')})"))
        best = cuts.groupBy("key").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"), *[F.first(c).alias(c) for c in ("lang", "phrase", "a", "n")])
        order = [F.desc("b.score"), F.desc("a"), F.asc("phrase")]
        near = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
        best = best.withColumn("near", F.row_number().over(near)).filter(F.col("near") <= top)
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
        return materialize(best.select("lang", "rank", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score")), "phrases", keep=True)
