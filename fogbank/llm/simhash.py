"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints. A bit of a text's fingerprint is 1 if it is set in over half of the XXH64 hashes (seed 42) of its word
shingles, repeats included.

Links. Two fingerprints with at most ``most`` = 3 differing bits agree in one of four 16-bit blocks at least, so every
distinct fingerprint goes to the four groups named by its blocks. A group is sorted by Gray rank, which puts similar
patterns side by side. Runs of ``FAN`` entries get a node that holds the bits all of them share; bits already held by the
node above are factored out, so that the differences found on the way down only add up. A search drops a whole node as
soon as its accumulated differences pass ``most``, or when all its entries are known to be of the query's class. A group above
``limit`` entries is dealt again by a block of its other bits, and again; what is still large (close variants of one text) is
cut into tiles, and pairs of tiles are searched. Within a task a union of the links found keeps one row per fingerprint, so no
group emits its pairs.

Classes. The rows of all tasks form a graph over distinct fingerprints, contracted by alternating star steps with
aggregates and joins; each step is written to the shared folder. Exact copies meet before any search: they share one
fingerprint row, aggregated map-side.

Defined cases: a null or word-less text has fingerprint zero and is linked like any other; texts of one or two words are
one shingle; repeated rows share a class; a null id never names a class unless all ids of the class are null; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fogbank.llm.common import map_rows, map_texts, replaced, texts_of
from fogbank.session import materialise

MOST = 3
FAN = 8
GROUP = 8192
#: Bits per block and level: 4 x 16 of all 64, 4 x 12 of the other 48, 4 x 9 of the other 36.
LEVELS = (16, 12, 9)
BITS_AT_ONCE = 1 << 15


def text_fingerprints(texts: list[str], width: int = 3) -> np.ndarray:
    """SimHash of every text, as uint64."""
    from xxhash import xxh64_intdigest as h

    hashes, sizes = [], []
    for text in texts:
        words = text.encode().lower().split()  # only A-Z change, only ASCII white space splits
        if len(words) > width:
            shingles = map(b" ".join, zip(*[words[k:] for k in range(width)]))
            found = [h(s, 42) for s in shingles]
        else:
            found = [h(b" ".join(words), 42)] if words else []
        hashes.append(np.array(found, dtype=np.uint64))
        sizes.append(len(found))
    out = np.zeros(len(texts), dtype=np.uint64)
    for i, found in enumerate(hashes):
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(found), BITS_AT_ONCE):
            raw = found[at: at + BITS_AT_ONCE].astype(">u8").view(np.uint8)
            ones += np.unpackbits(raw.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
        if len(found):
            out[i] = np.packbits(2 * ones > len(found)).view(">u8")[0]
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long)."""

    def make():
        def apply(chunk: pa.RecordBatch) -> dict:
            texts = [t or "" for t in chunk.column("text").to_pylist()]
            return {"doc_id": chunk.column("doc_id"), "fp": text_fingerprints(texts, width).view(np.int64)}

        return apply

    return map_texts(texts_of(docs, key, text), "doc_id bigint, fp bigint", make)


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each pattern in the Gray sequence: neighbours in it differ in one bit."""
    out = fp.copy()
    for k in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(k)
    return out


class GrayIndex:
    """Levels of nodes over fingerprints in Gray order, group by group; ``group`` must be sorted."""

    def __init__(self, fp: np.ndarray, group: np.ndarray):
        self.levels, self.children = [], []  # from the leaves up: own bits and their values; first child and number
        mask, value, owner = np.full(len(fp), ~np.uint64(0)), fp, group
        while True:
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
            if len(starts) == len(owner):
                self.levels.append((mask, value))
                break
            sizes = np.diff(np.append(starts, len(owner)))
            first = np.flatnonzero((np.arange(len(owner)) - np.repeat(starts, sizes)) % FAN == 0)
            n = np.diff(np.append(first, len(owner)))
            ones, zeros = np.bitwise_and.reduceat(value, first), np.bitwise_and.reduceat(mask & ~value, first)
            shared = ones | zeros
            self.levels.append((mask & ~np.repeat(shared, n), value))  # shared bits are factored out
            self.children.append((first, n))
            mask, value, owner = shared, ones, owner[first]
        self.roots = owner

    def classes(self, label: np.ndarray) -> list[np.ndarray]:
        """For the nodes of every level the class that all their entries have, or -1."""
        out = [label]
        for first, _ in self.children:
            low, high = np.minimum.reduceat(out[-1], first), np.maximum.reduceat(out[-1], first)
            out.append(np.where(low == high, low, -1))
        return out

    def ends(self) -> list[np.ndarray]:
        """For the nodes of every level the position of their last entry."""
        out = [np.arange(len(self.levels[0][0]))]
        for first, n in self.children:
            out.append(out[-1][first + n - 1])
        return out

    def search(self, fp: np.ndarray, some: np.ndarray, root: np.ndarray, most: int, known: list[np.ndarray], ends: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, later entry) with at most ``most`` differing bits, for the entries ``some``, each below its own root.

        A node whose entries all are of the query's class (``known``) is left out: it holds no new link.
        """
        queries, own = fp[some], known[0][some]
        who, node = np.arange(len(some)), root
        spent = np.zeros(len(some), dtype=np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            mask, value = self.levels[level]
            spent = spent + np.bitwise_count((queries[who] ^ value[node]) & mask[node])
            keep = (spent <= most) & (known[level][node] != own[who]) & (ends[level][node] > some[who])
            who, node, spent = who[keep], node[keep], spent[keep]
            if level:
                first, n = self.children[level - 1]
                each = n[node]
                step = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                node = np.repeat(first[node], each) + step
                who, spent = np.repeat(who, each), np.repeat(spent, each)
        return some[who], node


def merged(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Smallest member per class of ``n`` entries after joining a[i] with b[i]; ``label`` holds the classes so far."""
    while True:
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        if (la == lb).all():
            return label
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def linked(fp: np.ndarray, group: np.ndarray, most: int = MOST, first: int = 1 << 6, at_once: int = 1 << 12) -> np.ndarray:
    """For every entry the smallest entry (by position) of its class within its group.

    Queries go in batches that grow from ``first`` to ``at_once``: what the early ones join, the later ones need not visit, so that
    a family of close fingerprints costs about its size and not the number of its pairs.
    """
    order = np.lexsort((gray_rank(fp), group))
    f, g = fp[order], group[order]
    index = GrayIndex(f, g)
    root, ends = np.searchsorted(index.roots, g), index.ends()
    label, at = np.arange(len(f)), 0
    while at < len(f):
        some = np.arange(at, min(at + first, len(f)))
        a, b = index.search(f, some, root[some], most, index.classes(label), ends)
        label = merged(len(f), a, b, label)
        at, first = at + first, min(2 * first, at_once)
    out = np.empty(len(f), dtype=np.int64)
    out[order] = order[label]
    return out


def spread(values: DataFrame, level: int) -> DataFrame:
    """The groups of the next level for ``fp, g, rest``: one per block of ``rest``, the bits not yet used."""
    width, free = LEVELS[level], 64 - sum(LEVELS[:level])
    blocks = []
    for k in range(4):
        at, end = k * width, (k + 1) * width
        below = F.col("rest").bitwiseAND(F.lit((1 << at) - 1))
        above = F.shiftleft(F.shiftrightunsigned("rest", end), at) if end < free else F.lit(0).cast("long")
        value = F.shiftrightunsigned("rest", at).bitwiseAND(F.lit((1 << width) - 1))
        blocks.append(F.struct(F.xxhash64("g", F.lit(level), F.lit(k), value).alias("g"), below.bitwiseOR(above).alias("rest")))
    return values.select("fp", F.explode(F.array(*blocks)).alias("b")).select("fp", "b.g", "b.rest")


def groups(distinct: DataFrame, limit: int = GROUP) -> DataFrame:
    """``fp, g``: the groups to search. Groups above ``limit`` are dealt by finer keys, the rest of them by tiles."""
    level_in = distinct.select("fp", F.lit(0).cast("long").alias("g"), F.col("fp").alias("rest"))
    done = None
    for level in range(len(LEVELS)):
        dealt = materialise(spread(level_in, level), "simhash-groups")
        large = dealt.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > limit)
        large = materialise(large, "simhash-large")
        if large.isEmpty():
            return dealt.select("fp", "g") if done is None else done.unionByName(dealt.select("fp", "g"))
        small = dealt.join(large, "g", "left_anti").select("fp", "g")
        done = small if done is None else done.unionByName(small)
        level_in = dealt.join(large, "g", "left_semi")
    # Tiles: every pair of tiles of a group meets once.
    tiles = F.ceil(F.col("n") / F.lit(limit / 2)).cast("int")
    own = level_in.join(large, "g").withColumn("tiles", tiles).withColumn("t", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    met = own.select("fp", "g", "t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("u"))
    return done.unionByName(met.select("fp", F.xxhash64("g", F.least("t", "u"), F.greatest("t", "u")).alias("g")))


def links(distinct: DataFrame, most: int = MOST, limit: int = GROUP) -> DataFrame:
    """``a, b`` (b below a): enough links to connect all fingerprints within ``most`` bits of each other."""

    def search(frames):
        held = [f for f in frames if len(f)]
        if not held:
            return
        frame = pd.concat(held)
        fp, g = frame["fp"].to_numpy(), frame["g"].to_numpy()
        order = np.argsort(fp, kind="stable")
        fp, g = fp[order], g[order]
        root = linked(fp.view(np.uint64), g, most)
        move = fp[root] != fp
        yield pd.DataFrame({"a": fp[move], "b": fp[root][move]})

    dealt = groups(distinct, limit)
    spark = distinct.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return dealt.repartition(parts, "g").mapInPandas(search, "a bigint, b bigint")


def classes(edges: DataFrame) -> DataFrame:
    """``a, root``: the smallest fingerprint of the class of every linked fingerprint, by alternating star steps."""

    def state(df: DataFrame) -> tuple:
        # Whole numbers only: sums of doubles depend on the order of the partitions and would differ for equal tables.
        return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(xxhash64(b, a))")).first())

    edges = materialise(edges.where("a <> b").distinct(), "simhash-edges")
    before = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        edges = materialise(small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
                            .where("a <> b").distinct(), "simhash-edges")
        after = state(edges)
        if after == before:
            return edges.select("a", F.col("b").alias("root"))
        before = after


def classed(docs: DataFrame, key: str, text: str, width: int, most: int, limit: int) -> DataFrame:
    """``doc_id, fp, root, component_id`` of every row; ``root`` names the class also where all its ids are null."""
    marked = materialise(fingerprints(docs, key, text, width), "simhash-fingerprints")
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = classes(links(distinct, most, limit))
    named = distinct.join(roots, distinct["fp"] == roots["a"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(named.join(ids, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, most: int = MOST,
                    limit: int = GROUP) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row."""
    return classed(docs, key, text, width, most, limit).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, most: int = MOST,
                limit: int = GROUP) -> DataFrame:
    """The rows with the smallest id of their class, with all their columns.

    Of repeated rows (one id several times) one stays. A row without an id stays if no row of its class has one, and then
    one per class.
    """
    return first_of_each(docs, classed(docs, key, text, width, most, limit), key, text,
                         lambda texts: text_fingerprints([t or "" for t in texts], width).view(np.int64))


def first_of_each(docs: DataFrame, rows: DataFrame, key: str, text: str, marks: Callable[[list], np.ndarray]) -> DataFrame:
    """``one_of_each`` for given classes (``doc_id, fp, root, component_id``); ``marks`` gives the ``fp`` of texts."""
    rows = materialise(rows, "near-classes")
    out_ids = rows.where("doc_id <> component_id").select("doc_id").distinct()
    again = materialise(rows.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
                        .select("doc_id"), "near-repeated")
    kept = docs.where(F.col(key).isNotNull()).join(out_ids.withColumnRenamed("doc_id", "_out_id"), F.col(key) == F.col("_out_id"), "left_anti")
    if not again.isEmpty():
        other = again.withColumnRenamed("doc_id", "_again_id")
        twice = kept.join(other, F.col(key) == F.col("_again_id"), "left_semi").dropDuplicates([key])
        kept = kept.join(other, F.col(key) == F.col("_again_id"), "left_anti").unionByName(twice)
    nameless = (rows.where("doc_id IS NULL AND component_id IS NULL")
                .select(F.col("fp").alias("_of_fp"), F.col("root").alias("_root")).distinct())
    if not nameless.isEmpty():
        some = docs.where(F.col(key).isNull())
        full = some.select(*[F.col(c) for c in docs.columns], F.lit(0).cast("long").alias("_fp"))

        def make():
            def apply(chunk: pa.RecordBatch) -> pa.RecordBatch:
                return replaced(chunk, "_fp", pa.array(marks(chunk.column(text).to_pylist())))

            return apply

        marked = map_rows(full, make, text).join(nameless, F.col("_fp") == F.col("_of_fp"))
        kept = kept.unionByName(marked.dropDuplicates(["_root"]).select(*docs.columns))
    return kept
