"""Near-duplicate documents by a chosen-path set similarity join.

Documents are sets of word shingles. Documents with one and the same set form a class, and only one
representative of a class takes part in the join. A representative walks down ``trees`` independent trees: at
every node it follows ``branches`` branches, each chosen by a minwise token of its set, so two sets of
similarity s share a given branch with probability s. Nodes with few documents are compared exhaustively;
only larger ones are branched further. With two branches a level a tree loses a pair of similarity 0.8
with a probability of 0.063 at most, however deep it grows, and four trees lose it with 0.000015.

Sketches of the sets come first: each document of a node is compared with two pivots of the node (the most copied
document and a random one), then, in small nodes, with every document that is not in its component yet. What
sketches cannot tell apart makes clusters. Then every cluster is compared on the full sets, best candidates first,
skipping pairs that are connected already; clusters too large for one task are cut into parts of which every two meet, and still
larger ones walk down the trees again with what their confirmed pivots connect. So large groups of near copies cost linear work, and no step emits all pairs of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.llm.components import connected_components
from marketlake.llm.shared import ascii_words, hash_windows, hash_words, materialize, passing_tables, spread

HASHES = 64
_EVEN = 0x5555555555555555


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words make one shingle, no words none."""
    words = ascii_words(text)
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    return np.unique(hash_windows(hash_words(words), k))


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The least value of the set under each of HASHES hash functions (uint32)."""
    rng = np.random.default_rng(20240229)
    flip = rng.integers(0, 2**32, HASHES, dtype=np.uint32)
    times = rng.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
    out = np.full(HASHES, 2**32 - 1, dtype=np.uint32)
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(high), 2048):
        x = (high[at : at + 2048, None] ^ flip) * times
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        out = np.minimum(out, x.min(axis=0))
    return out


def sketch(sig: np.ndarray) -> tuple[int, int]:
    """Two bits of each minwise value, in two signed 64-bit words."""
    lanes = (sig & np.uint32(3)).astype(np.uint64) << (np.arange(HASHES, dtype=np.uint64) % np.uint64(32) * np.uint64(2))
    words = np.array([np.bitwise_or.reduce(lanes[:32]), np.bitwise_or.reduce(lanes[32:])]).astype(np.int64)
    return int(words[0]), int(words[1])


def agreement_needed(threshold: float) -> int:
    """Equal lanes of two sketches that a pair at the threshold has but for five standard deviations."""
    p = threshold + (1 - threshold) / 4
    return int(HASHES * p - 5 * (HASHES * p * (1 - p)) ** 0.5)


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, n_shingles, set_key, sig, sk1, sk2); set_key is a 128-bit hash of the whole set, null if empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, sigs, one, two = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, k)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig = minwise(s)
                a, b = sketch(sig)
                sigs.append(sig.astype(np.int32) if len(s) else None)
                one.append(a)
                two.append(b)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int32())), pa.array(one, pa.int64()), pa.array(two, pa.int64())],
                names=["id", "n_shingles", "set_key", "sig", "sk1", "sk2"],
            )

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return spread(picked, "id").mapInArrow(run, "id long, n_shingles long, set_key binary, sig array<int>, sk1 long, sk2 long")


def _lanes_equal(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    def differ(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        return F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseAND(F.lit(_EVEN)))

    return F.lit(HASHES) - differ(a1, b1) - differ(a2, b2)


def _branches(level: int, trees: int, branches: int) -> list[list[int]]:
    """For each tree, the minwise tokens that its nodes of this level branch by; no token is used twice."""
    at = level * trees * branches
    return [[(at + t * branches + j) % HASHES for j in range(branches)] for t in range(trees)]


def _first_level(reps: DataFrame, trees: int, branches: int) -> DataFrame:
    paths = [
        F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), F.lit(c), F.col("sig")[c]).alias("node"))
        for t, tokens in enumerate(_branches(0, trees, branches))
        for c in tokens
    ]
    return reps.withColumn("path", F.explode(F.array(*paths))).select("*", "path.*").drop("path")


def _next_level(rows: DataFrame, level: int, trees: int, branches: int) -> DataFrame:
    tokens = F.array(*[F.array(*[F.lit(c) for c in x]) for x in _branches(level, trees, branches)])
    rows = rows.withColumn("token", F.explode(tokens[F.col("tree")]))
    return rows.withColumn("node", F.xxhash64("node", "token", F.element_at("sig", F.col("token") + 1))).drop("token")


def _alike(threshold: float, p: str) -> Column:
    """Whether a row and the pivot in column p may reach the threshold, by sizes and sketches."""
    small, large = F.least("n", f"{p}.n"), F.greatest("n", f"{p}.n")
    return (small >= F.floor(large * (threshold - 1e-9))) & (
        _lanes_equal(F.col("sk1"), F.col("sk2"), F.col(f"{p}.sk1"), F.col(f"{p}.sk2")) >= agreement_needed(threshold)
    )


def _with_pivots(reps: DataFrame, threshold: float, trees: int, branches: int) -> DataFrame:
    """(rep, o, p) for each node in which rep may be similar to the node's pivot p, o being the pivot's rank: the most copied
    document comes first, then the one with the least hash, so ranks lead from every document to better ones only."""
    rows = _first_level(reps, trees, branches)
    rank = F.struct((-F.col("copies")).alias("c"), F.xxhash64("rep").alias("h"))
    pivots = rows.groupBy("node").agg(F.count("*").alias("members"), F.min(F.struct(rank.alias("o"), *[F.col(x) for x in ("rep", "n", "sk1", "sk2")])).alias("p"))
    pivots = materialize(pivots.filter("members > 1").drop("members"), "pivots")
    rows = rows.select("node", "rep", "n", "sk1", "sk2").join(pivots, "node")
    return rows.filter((F.col("rep") != F.col("p.rep")) & _alike(threshold, "p")).select("rep", "p.o", F.col("p.rep").alias("p"))


def _follow(best: DataFrame) -> DataFrame:
    """(rep, comp) from (rep, p): the pivot, or the pivot's pivot."""
    return best.join(best.select(F.col("rep").alias("p"), F.col("p").alias("q")), "p", "left").select("rep", F.coalesce("q", "p").alias("comp"))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of rows that agree in the first ``keys`` columns; the input is sorted by them."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        change = np.zeros(table.num_rows - 1, dtype=bool)
        for c in range(keys):
            change |= np.diff(table.column(c).to_numpy()) != 0
        cuts = [0, *(np.flatnonzero(change) + 1)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield table.slice(lo, hi - lo)
        rest = table.slice(cuts[-1])
    if rest is not None:
        yield rest


class Sets:
    """Disjoint sets of any keys."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.root(x)] = self.root(y)


def _alike_pairs(t: dict[str, np.ndarray], probes: np.ndarray, members: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(probe, member, equal lanes) of different components that sizes and sketches let pass, in slices of the probes."""
    need, even = agreement_needed(threshold), np.uint64(_EVEN)
    sk = [t[x].view(np.uint64) for x in ("sk1", "sk2")]
    n, comp = t["n"], t["comp"]
    for at in range(0, len(probes), 256):
        p = probes[at : at + 256]
        same = np.full((len(p), len(members)), HASHES, dtype=np.int16)
        for s in sk:
            z = s[p][:, None] ^ s[members][None, :]
            same -= np.bitwise_count((z | (z >> np.uint64(1))) & even).astype(np.int16)
        i, j = np.nonzero((same >= need) & (comp[p][:, None] != comp[members][None, :]))
        x, y = p[i], members[j]
        fits = np.minimum(n[x], n[y]) >= np.floor(np.maximum(n[x], n[y]) * (threshold - 1e-9))
        if fits.any():
            yield x[fits], y[fits], same[i, j][fits]


def _compare_blocks(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b) components to join, because a probe and a member of a (node, block) may be similar; a spanning forest only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for table in _groups(batches, 2):
            if table.num_rows < 2:
                continue
            t = {x: table.column(x).to_numpy() for x in ("comp", "n", "sk1", "sk2", "probe", "member")}
            sets = Sets()
            for x, y, _ in _alike_pairs(t, np.flatnonzero(t["probe"]), np.flatnonzero(t["member"]), threshold):
                for a, b in zip(t["comp"][x].tolist(), t["comp"][y].tolist(), strict=True):
                    if sets.root(a) != sets.root(b):
                        sets.join(a, b)
                        out.append((a, b))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    rows = rows.select("node", "block", "rep", "comp", "n", "sk1", "sk2", "probe", "member")
    rows = rows.repartition("node", "block").sortWithinPartitions("node", "block")
    return rows.mapInArrow(run, "a long, b long")


def _verify_groups(rows: DataFrame, k: int, threshold: float, whole: bool) -> DataFrame:
    """(a, b) links of documents of one group (node, block) that reach the threshold on their full sets and belong to different
    components so far: a spanning forest only. With ``whole`` groups are closed and b is the least document of a's component.
    rows: node, block, rep, comp, n, sk1, sk2, text."""
    percent = round(threshold * 100)

    def links(table: pa.Table) -> list[tuple[int, int]]:
        t = {x: table.column(x).to_numpy().copy() for x in ("rep", "comp", "n", "sk1", "sk2")}
        everyone, texts = np.arange(table.num_rows), table.column("text")
        first, sets, full, out = t["comp"].tolist(), Sets(), {}, []
        for x, y, same in _alike_pairs(t, everyone, everyone, threshold):
            best = np.argsort(-same[x < y], kind="stable")
            before = len(out)
            for a, b in zip(x[x < y][best].tolist(), y[x < y][best].tolist(), strict=True):
                if sets.root(first[a]) == sets.root(first[b]):
                    continue
                for d in (a, b):
                    if d not in full:
                        full[d] = shingle_set(texts[d].as_py(), k)
                one, two = full[a], full[b]
                at = np.minimum(np.searchsorted(one, two), len(one) - 1)
                common = int((one[at] == two).sum())
                if 100 * common >= percent * (len(one) + len(two) - common):
                    sets.join(first[a], first[b])
                    out.append((int(t["rep"][a]), int(t["rep"][b])))
            if len(out) > before:  # what is connected now is skipped from here on
                t["comp"][:] = [sets.root(c) for c in first]
        if not whole or not out:
            return out
        least: dict[int, int] = {}
        for r, c in zip(t["rep"].tolist(), first, strict=True):
            root = sets.root(c)
            least[root] = min(least.get(root, r), r)
        return [(r, least[sets.root(c)]) for r, c in zip(t["rep"].tolist(), first, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 2):
            if table.num_rows > 1 and (out := links(table)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    rows = rows.select("node", "block", "rep", "comp", "n", "sk1", "sk2", "text")
    rows = rows.repartition("node", "block").sortWithinPartitions("node", "block")
    return rows.mapInArrow(run, "a long, b long")


def _leaves(reps: DataFrame, trees: int, branches: int, leaf: int, block: int, depth: int) -> DataFrame:
    """The rows of all leaves of all trees, in blocks; reps has a column comp, and only different components meet.

    A node is a leaf once at most ``leaf`` of its documents are outside its largest component, or at the last level. In a leaf of many
    rows each has a home block, and those outside the largest component, in parts of ``leaf`` where they are more, are probes in every block: no
    task holds more than a block and a part.
    """
    cols = ["rep", "comp", "n", "sk1", "sk2"]
    rows, found = _first_level(reps, trees, branches).select("node", "tree", *cols), None
    for level in range(depth):
        by_comp = rows.groupBy("node", "comp").agg(F.count("*").alias("c"))
        nodes = by_comp.groupBy("node").agg(F.sum("c").alias("m"), F.max(F.struct("c", "comp")).alias("most"))
        nodes = nodes.select("node", "m", F.col("most.c").alias("c"), F.col("most.comp").alias("major")).filter("m > c")
        last = level == depth - 1
        nodes = materialize(nodes.withColumn("leaf", F.lit(last) | (F.col("m") - F.col("c") <= leaf)), "nodes")
        at = rows.join(nodes, "node")
        blocks, parts = F.ceil(F.col("m") / block).cast("int"), F.ceil((F.col("m") - F.col("c")) / leaf).cast("int")
        mine = at.filter("leaf").select("node", "rep", "comp", "n", "sk1", "sk2", (F.col("comp") != F.col("major")).alias("probe"), blocks.alias("blocks"), parts.alias("parts"))
        mine = mine.withColumn("home", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("part", F.pmod(F.xxhash64("node", "rep"), F.col("parts")).cast("int"))
        # block b of part p has number b + p * blocks: a member is in its home block of every part, a probe in every block of its part
        homes = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.col("home") + p * F.col("blocks"))
        every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b + F.col("part") * F.col("blocks"))
        mine = mine.withColumn("block", F.explode(F.when(F.col("probe"), F.array_union(homes, every)).otherwise(homes)))
        mine = mine.withColumn("member", F.col("block") % F.col("blocks") == F.col("home")).withColumn("probe", F.col("probe") & (F.floor(F.col("block") / F.col("blocks")) == F.col("part")))
        found = mine if found is None else found.unionByName(mine)
        if last or nodes.filter("not leaf").limit(1).count() == 0:
            break
        below = at.filter("not leaf").select("node", "tree", *cols).join(reps.select("rep", "sig"), "rep")
        rows = materialize(_next_level(below, level + 1, trees, branches).select("node", "tree", *cols), "rows")
    assert found is not None
    return found


def confirm(docs: DataFrame, pairs: DataFrame, k: int, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) whose full shingle sets reach the threshold. docs: (id, text)."""
    pairs = materialize(pairs, "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = materialize(docs.join(ids, "id", "left_semi").dropDuplicates(["id"]), "texts")
    a, b = texts.toDF("a", "text_a"), texts.toDF("b", "text_b")
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
    percent = round(threshold * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, x = [], None, np.empty(0, dtype=np.uint64)
            left = batch.column(0).to_pylist()
            for who, one, two in zip(left, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if who != last:
                    x, last = shingle_set(one, k), who
                y = shingle_set(two, k)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return materialize(both.mapInArrow(run, "a long, b long"), "links")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    threshold: float = 0.8,
    trees: int = 4,
    branches: int = 2,
    leaf: int = 1024,
    block: int = 2048,
    depth: int = 8,
    cluster_rows: int = 4096,
    group_rows: int = 256,
) -> DataFrame:
    """One row for each row of ``docs``: (doc id, n_shingles, component_id, kept).

    Two documents are linked when their shingle sets have a Jaccard similarity of at least ``threshold``;
    component_id is the smallest id reachable over links and kept marks that document. An empty or null text has
    no shingles and is linked with nothing. Equal rows share an id, so each of them is kept if the id is. A
    row without an id has a null component and is kept. An id with several texts takes part with one of them, that of
    the least hash, and all its texts are in its component. Other columns,
    whatever their names, are ignored. An empty table gives an empty result.

    leaf: documents outside a node's largest component up to which the node is compared exhaustively;
    block: rows of a node that one comparison holds in memory; depth: levels after which any node is compared;
    group_rows: documents of a cluster up to which one task compares their texts; larger clusters are cut into parts of as many, and every
    two parts meet; cluster_rows: size of a cluster from which on not parts, but the trees say which documents meet.
    """
    sigs = materialize(signatures(docs, id_col, text_col, shingle), "signatures", keep=True)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    with passing_tables():
        label = materialize(_labels(sigs, texts, shingle, threshold, trees, branches, leaf, block, depth, cluster_rows, group_rows), "labels", keep=True)
    out = sigs.select("id", "n_shingles", "set_key").join(label, "set_key", "left")
    component = F.coalesce("component_id", "id")
    out = out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.col(id_col).isNull() | (F.col(id_col) == F.col("component_id")))


def _labels(sigs: DataFrame, texts: DataFrame, k: int, threshold: float, trees: int, branches: int, leaf: int, block: int, depth: int, cluster_rows: int, group_rows: int) -> DataFrame:
    """(set_key, component_id) of every set."""
    classes = sigs.filter("set_key is not null").groupBy("set_key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = materialize(classes.filter("rep is not null"), "classes")
    first = classes.groupBy("rep").agg(F.min(F.struct("set_key", "copies")).alias("x")).select("rep", "x.*")
    own = sigs.select(F.col("id").alias("rep"), "set_key", F.col("n_shingles").alias("n"), "sig", "sk1", "sk2")
    reps = materialize(own.join(first, ["rep", "set_key"]).dropDuplicates(["rep"]).drop("set_key"), "reps")

    # clusters of documents that sketches cannot tell apart: every link is inside one
    best = _with_pivots(reps, threshold, trees, branches).groupBy("rep").agg(F.min(F.struct("o", "p")).alias("b"))
    near = materialize(_follow(materialize(best.select("rep", "b.p"), "best")), "near")
    marked = reps.join(near, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    across = _compare_blocks(_leaves(marked, trees, branches, leaf, block, depth), threshold)
    clusters = connected_components(near.toDF("a", "b").unionByName(across)).toDF("rep", "cluster")
    sizes = materialize(clusters.groupBy("cluster").agg(F.count("*").alias("size")), "sizes")
    known = reps.select("rep", "n", "sk1", "sk2").join(clusters.join(sizes, "cluster"), "rep")
    own = materialize(texts.withColumnRenamed("id", "rep").join(known, "rep"), "texts")

    size = F.col("size")
    small = own.filter(size <= group_rows).select("*", F.col("cluster").alias("node"), F.lit(0).alias("block"), F.col("rep").alias("comp"))
    label = _verify_groups(small, k, threshold, whole=True)
    largest = sizes.agg(F.max("size")).first()[0] or 0
    if largest > group_rows:
        # every two parts of a cluster meet in one group, so a document is in as many groups as its cluster has parts
        parts = F.ceil(size / group_rows).cast("int")
        mid = own.filter((size > group_rows) & (size <= cluster_rows)).withColumn("home", F.pmod(F.xxhash64("rep"), parts).cast("int"))
        mid = mid.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        pair = F.least("home", "other") * parts + F.greatest("home", "other")
        links = _verify_groups(mid.select("*", F.col("cluster").alias("node"), pair.alias("block"), F.col("rep").alias("comp")), k, threshold, whole=False)
        if largest > cluster_rows:
            large = own.filter(size > cluster_rows)
            big = materialize(reps.join(large.select("rep"), "rep", "left_semi"), "big")
            pairs = _with_pivots(big, threshold, trees, branches).select(F.least("rep", "p").alias("a"), F.greatest("rep", "p").alias("b")).distinct()
            close = confirm(large.select(F.col("rep").alias("id"), "text"), pairs, k, threshold)
            comps = materialize(connected_components(close).toDF("rep", "comp"), "comps")
            big = big.join(comps, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
            rows = _leaves(big, trees, branches, min(leaf, group_rows), min(block, group_rows), depth).select("node", "block", "rep", "comp", "n", "sk1", "sk2")
            rows = rows.join(large.select("rep", "text"), "rep")
            links = links.unionByName(close).unionByName(_verify_groups(rows, k, threshold, whole=False))
        label = label.unionByName(connected_components(links).toDF("a", "b"))
    label = label.toDF("rep", "component_id").groupBy("rep").agg(F.min("component_id").alias("component_id"))
    label = classes.join(label, "rep", "left").withColumn("component_id", F.coalesce("component_id", "rep"))
    return label.select("set_key", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, the one with the smallest id; equal rows are one.

    Rows without an id and rows without words are kept as they are. Of an id with several texts all rows stay or go together, as the
    id does. Columns of any name are carried.
    """
    found = near_duplicates(docs, id_col, text_col, shingle, threshold)
    mark = "__kept"
    while mark in docs.columns:
        mark += "_"
    kept = materialize(found.filter(F.col(id_col).isNotNull() & F.col("kept")).select(F.col(id_col).alias(mark)).distinct(), "kept")
    rows = docs.join(kept, F.col(f"`{id_col}`").cast("long") == F.col(mark), "left_semi").dropDuplicates()
    return rows.unionByName(docs.filter(F.col(id_col).isNull()))
