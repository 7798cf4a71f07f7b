"""Ranked lexical search with hashed max-sketches.

Index. Texts become shards of distinct terms with their counts (``matrix``), written once. A term's impact in a document is a
whole number; a document's impacts fold into a sketch: ``HASHES`` rows of cells, as many cells as the next power of two above
``SPARE`` times its distinct terms, every cell the largest impact of the terms that fall into it, rounded up to 1/256 of the
largest impact there is. No document's sketch is cut: its size follows the document.

Search. A query term's impact is at most the least of its ``HASHES`` cells. The distinct terms of a whole block of queries are
looked up at once, for many sketches at a time, which bounds the score of every document for every query. Per query the documents
are scored exactly in the order of falling bounds until the next bound is below the score of rank ``top`` found so far in the
task; a tie goes on, as the smaller id wins. The tasks' best are merged in two steps, so the result is exact whatever the bounds.

Queries travel in blocks of at most ``BLOCK`` distinct terms (one query at least) to all tasks; a block is a pass over the index.

Defined cases: a text without terms (null, empty) is in no result and not counted; items without terms have no rows. Repeated
rows are documents of their own; ids that tie are in no further order, null ids come last. Of items with equal ids the least
text counts; a null item id is an id. Terms are told apart by 64-bit hashes. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fogbank.llm.common import texts_of
from fogbank.llm.katz import unpack
from fogbank.llm.matrix import hashes, shards, split_at_spaces
from fogbank.session import materialise

TOP = 10
HASHES, SPARE = 2, 2
STEP = 4096  # impacts are below 10^6, so steps fit a byte
BLOCK = 1 << 17
CELLS = 1 << 21
RESCORED = 32
SALTS = 64
#: Everything but 0-9, A-Z, a-z and bytes of other code points becomes a space, A-Z become small.
TERMS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()
RESULT = "item_id bigint, doc_id bigint, score bigint"


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERMS).split()


def split_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    spaced = [t.translate(TERMS) for t in texts.cast(pa.binary()).to_pylist()]
    return split_at_spaces(pa.array(spaced, pa.binary()).cast(pa.string()))


def index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored shards of all documents."""
    return materialise(shards(texts_of(docs, key, text, part=F.lit("")), split_terms), "search-index")


class Totals:
    """What impacts depend on: documents with a term, and terms of all of them."""

    def __init__(self, docs: int, words: int):
        self.docs, self.words = docs, max(words, 1)

    def spread(self, n: np.ndarray) -> np.ndarray:
        """m of documents with n terms."""
        if self.docs * int(n.max(initial=0)) >= (1 << 62) // 75:
            return np.array([25 + 75 * int(x) * self.docs // self.words for x in n], dtype=np.int64)
        return 25 + 75 * n * self.docs // self.words

    @staticmethod
    def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        return 1_000_000_000 * tf // (1000 * tf + 8 * m)

    def weight(self, df: int) -> int:
        return floor(1000 * log((2 * self.docs + 2) / (2 * df + 1)))


class Queries:
    """A block of items: the distinct terms, and per item its terms with how often it has them."""

    def __init__(self, items: list[tuple]):
        self.ids = [i for i, _ in items]
        found = [terms((t or "").encode()) for _, t in items]
        known = sorted({w for words in found for w in words})
        key = hashes(known)
        self.hash = np.unique(key)
        place = dict(zip(known, np.searchsorted(self.hash, key)))
        self.term, self.times, self.size = [], [], []
        for words in found:
            at, n = np.unique(np.array([place[w] for w in words], dtype=np.int64), return_counts=True)
            self.term.append(at)
            self.times.append(n)
            self.size.append(len(at))
        self.weight = np.zeros(len(self.hash), dtype=np.int64)


class Shard:
    """A stored shard's documents with terms, sorted by their number of sketch cells."""

    def __init__(self, row: dict):
        words = unpack(row["words"], np.uint32).astype(np.int64)
        self.some = np.flatnonzero(words)
        self.n = words[self.some]
        self.doc_id = unpack(row["doc_id"], np.int64)[self.some]
        self.null_id = unpack(row["null_id"], np.uint8)[self.some] > 0
        self.distinct = unpack(row["distinct"], np.uint32).astype(np.int64)[self.some]
        self.code = unpack(row["codes"], np.uint32).astype(np.int64)
        self.tf = unpack(row["counts"], np.uint32).astype(np.int64)
        self.hash = np.cumsum(unpack(row["hashes"], np.uint64), dtype=np.uint64)
        self.of = np.repeat(np.arange(len(self.some)), self.distinct)

    def places(self, wanted: np.ndarray) -> np.ndarray:
        """Word numbers of sorted hashes here, -1 for those the shard lacks."""
        if not len(self.hash):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(self.hash, wanted), len(self.hash) - 1)
        return np.where(self.hash[at] == wanted, at, -1)


def frequencies(stored: DataFrame, wanted: np.ndarray) -> dict[int, int]:
    """Documents that hold each of the wanted terms (places in the sorted hashes)."""

    def run(frames):
        df = np.zeros(len(wanted), dtype=np.int64)
        for frame in frames:
            for row in frame.to_dict("records"):
                shard = Shard(row)
                at = shard.places(wanted)
                df[at >= 0] += np.bincount(shard.code, minlength=len(shard.hash))[at[at >= 0]]
        held = np.flatnonzero(df)
        yield pd.DataFrame({"term": held, "n": df[held]})

    return {r["term"]: r["n"] for r in stored.mapInPandas(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}


def cells_of(hash: np.ndarray, k: int, width) -> np.ndarray:
    """Cell of terms in row ``k`` of a sketch of ``width`` cells (a power of two)."""
    mixed = (hash ^ (hash >> np.uint64(32))) * np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[k])
    return ((mixed >> np.uint64(32)) & (np.asarray(width, dtype=np.uint64) - np.uint64(1))).astype(np.int64)


def widths(distinct: np.ndarray) -> np.ndarray:
    return 1 << np.ceil(np.log2(SPARE * np.maximum(distinct, 1))).astype(np.int64)


def sketches(shard: Shard, impact: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Documents of equal width, a bounded number of cells at a time: their places and sketches (document, row, cell)."""
    width = widths(shard.distinct)
    starts = np.append(0, np.cumsum(shard.distinct))
    steps = (impact + STEP - 1) // STEP
    for w in np.unique(width):
        same = np.flatnonzero(width == w)
        each = max(1, CELLS // int(HASHES * w))
        for at in range(0, len(same), each):
            some = same[at:at + each]
            n = shard.distinct[some]
            at_cell = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[some], n)
            owner, hash = np.repeat(np.arange(len(some)), n), shard.hash[shard.code[at_cell]]
            out = np.zeros((len(some), HASHES, int(w)), dtype=np.uint8)
            for k in range(HASHES):
                np.maximum.at(out, (owner, k, cells_of(hash, k, w)), steps[at_cell].astype(np.uint8))
            yield some, out


class Best:
    """The best documents of every query so far."""

    def __init__(self, queries: int, top: int):
        self.top = top
        self.rows: list[list[tuple]] = [[] for _ in range(queries)]

    def least(self, q: int) -> int:
        """Bounds below this cannot matter."""
        return self.rows[q][-1][0] if len(self.rows[q]) == self.top else 1

    def add(self, q: int, score: np.ndarray, null_id: np.ndarray, doc_id: np.ndarray) -> None:
        new = [(int(s), bool(x), int(d)) for s, x, d in zip(score, null_id, doc_id) if s >= self.least(q)]
        if new:
            self.rows[q] = sorted(self.rows[q] + new, key=lambda r: (-r[0], r[1], r[2]))[:self.top]


def search_shard(shard: Shard, queries: Queries, totals: Totals, best: Best) -> None:
    if not len(shard.some):
        return
    m = totals.spread(shard.n)
    impact = totals.impact(shard.tf, m[shard.of])
    here = shard.places(queries.hash)
    v = len(shard.hash)
    cell = shard.of * v + shard.code  # sorted
    term = np.concatenate(queries.term) if queries.term else np.zeros(0, np.int64)
    worth = np.concatenate(queries.times) * queries.weight[term] if len(term) else term
    heads = np.append(0, np.cumsum(queries.size))[:-1]
    live = np.flatnonzero(queries.size)

    def exact(q: int, docs: np.ndarray) -> np.ndarray:
        """Scores of documents for one query."""
        of = here[queries.term[q]]
        known = of >= 0
        asked = docs[:, None] * v + of[known]
        at = np.minimum(np.searchsorted(cell, asked), len(cell) - 1)
        return (np.where(cell[at] == asked, impact[at], 0) * (queries.times[q] * queries.weight[queries.term[q]])[known]).sum(axis=1)

    for docs, sketch in sketches(shard, impact):
        each = max(1, CELLS // max(len(term), 1))
        looked = [cells_of(queries.hash, k, sketch.shape[2]) for k in range(HASHES)]
        for at in range(0, len(docs), each):
            part = sketch[at:at + each]
            most = part[:, 0, looked[0]]
            for k in range(1, HASHES):
                most = np.minimum(most, part[:, k, looked[k]])
            bound = np.add.reduceat(most[:, term] * (worth * STEP), heads[live], axis=1)
            for column, q in zip(bound.T, live):
                order = np.flatnonzero(column >= best.least(q))
                order = order[np.argsort(-column[order], kind="stable")]
                for a in range(0, len(order), RESCORED):
                    some = order[a:a + RESCORED]
                    if column[some[0]] < best.least(q):
                        break
                    who = docs[at:at + each][some]
                    best.add(q, exact(q, who), shard.null_id[who], shard.doc_id[who])


def best_of_tasks(stored: DataFrame, queries: Queries, totals: Totals, top: int) -> DataFrame:
    """The best documents that each task found (``item, null_id, doc_id, score, task``)."""

    def run(frames):
        from pyspark import TaskContext

        best = Best(len(queries.ids), top)
        for frame in frames:
            for row in frame.to_dict("records"):
                search_shard(Shard(row), queries, totals, best)
        rows = [(q, x, None if x else d, s, TaskContext.get().partitionId()) for q, found in enumerate(best.rows) for s, x, d in found]
        yield pd.DataFrame(rows, columns=["item", "null_id", "doc_id", "score", "task"]).astype({"doc_id": "Int64"})

    return stored.mapInPandas(run, "item bigint, null_id boolean, doc_id bigint, score bigint, task bigint")


def first(rows: DataFrame, keys: list, top: int) -> DataFrame:
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)


def blocks(items: DataFrame, key: str, text: str, limit: int) -> Iterator[Queries]:
    """The items in blocks of at most ``limit`` terms, one item at least, one block at a time on the driver."""
    held, used = [], 0
    least = items.groupBy(F.col(key).alias("item_id")).agg(F.min(F.col(text).cast("string")).alias("text"))
    for row in least.orderBy("item_id").toLocalIterator():
        n = len(terms((row["text"] or "").encode()))
        if held and used + n > limit:
            yield Queries(held)
            held, used = [], 0
        held.append((row["item_id"], row["text"]))
        used += n
    if held:
        yield Queries(held)


def search(stored: DataFrame, items: DataFrame, key: str = "item_id", text: str = "text", top: int = TOP, block: int = BLOCK) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best documents of every item with a score above 0."""
    spark = stored.sparkSession
    docs, words = (x or 0 for x in stored.agg(F.sum("n_docs"), F.sum("n_words")).first())
    totals, parts = Totals(docs, words), []
    for queries in blocks(items, key, text, block):
        if docs and len(queries.hash):
            found = frequencies(stored, queries.hash)
            queries.weight = np.array([totals.weight(found.get(i, 0)) for i in range(len(queries.hash))], dtype=np.int64)
            some = best_of_tasks(stored, queries, totals, top)
            some = first(some.withColumn("salt", F.col("task") % SALTS), ["item", "salt"], top).drop("rank")
            ids = spark.createDataFrame(list(enumerate(queries.ids)), "item bigint, item_id bigint")
            ranked = first(some, ["item"], top).join(F.broadcast(ids), "item")
            parts.append(materialise(ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "search-best"))
    out = parts[0] if parts else spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def ranked_search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return search(index(docs, key, text), items)
