"""Interaction of quality filters, from a sparse document-term matrix.

The texts become CSR shards whose columns are words, numbered over the whole table (``matrix``). Row sums (words) and counts of
nonzero entries (distinct words) decide the filters A and B; the share of capitals (C) and forbidden characters (D) are flags of
the rows, and so is a digest of the text, by which copies of a text with a smaller id (E) are found.

Nothing is computed per order of the filters until the documents are counts: copies collapse to one row per text, part and
label before they meet, and each part ends as at most 32 counts, one per set of filters failed, from which every order and
step is read off.

Defined cases: a null text is empty, a null part the empty text. A null id is larger than every other: such a row is a copy if
any row with an id has its text. Rows with equal ids are not smaller than each other. Of several labels of a document any
counts; labels without an id belong to no document. An empty table gives an empty result. Texts are told apart by 128-bit
digests, words by themselves.
"""

from __future__ import annotations

from hashlib import blake2b
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fogbank.llm.common import texts_of
from fogbank.llm.katz import unpack
from fogbank.llm.matrix import numbered, shards, split_at_spaces
from fogbank.session import materialise

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 200, 50, 2
CAPITALS, FORBIDDEN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
IS_C, IS_D = 1, 2


def marks(texts: list) -> tuple[np.ndarray, bytes]:
    """The flags C and D, and the digests."""
    flags = np.zeros(len(texts), dtype=np.uint8)
    for i, t in enumerate(texts):
        capitals = len(t) - len(t.translate(None, CAPITALS))
        if capitals and 100 * capitals > CAPITALS_PERCENT * len(t.decode()):
            flags[i] |= IS_C
        if len(t.translate(None, FORBIDDEN)) < len(t):
            flags[i] |= IS_D
    return flags, b"".join(blake2b(t, digest_size=16).digest() for t in texts)


def matrix(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """CSR shards over the words of all texts (``matrix.CSR``), with parts, flags and digests of the rows."""
    need = texts_of(docs, key, text, part=F.col(part).cast("string"))
    return numbered(materialise(shards(need, split_at_spaces, words=True, mark=marks), "audit-shards"))


def facts(csr: DataFrame) -> DataFrame:
    """``doc_id, part, digest, fails``: the filters of A to D that each row fails."""

    def run(frames):
        for frame in frames:
            for row in frame.to_dict("records"):
                starts, counts = unpack(row["starts"], np.int64), unpack(row["counts"], np.uint32).astype(np.int64)
                words = np.diff(np.append(0, np.cumsum(counts))[starts])
                distinct = np.diff(starts)
                flags = unpack(row["flags"], np.uint8)
                fail = [words < LEAST_WORDS, 100 * distinct < DISTINCT_PERCENT * words, flags & IS_C > 0, flags & IS_D > 0]
                fails = np.full(len(words), "", dtype=object)
                for letter, where in zip(FILTERS, fail):
                    fails[where] += letter
                parts = np.array(row["parts"], dtype=object)
                yield pd.DataFrame({
                    "doc_id": pd.arrays.IntegerArray(unpack(row["doc_id"], np.int64), unpack(row["null_id"], np.uint8) > 0),
                    "part": parts[unpack(row["part"], np.uint32)], "fails": fails,
                    "digest": [row["digest"][i:i + 16] for i in range(0, len(row["digest"]), 16)]})

    return csr.mapInPandas(run, "doc_id bigint, part string, fails string, digest binary")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``good`` and ``toxic`` (0 or 1) of every row; rows without an id have no label and stay out of the join."""
    known = (labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
                  F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic")).where("good + toxic > 0"))
    named = rows.where("doc_id IS NOT NULL").join(known, "doc_id", "left").fillna(0, ["good", "toxic"])
    return named.unionByName(rows.where("doc_id IS NULL").withColumn("good", F.lit(0)).withColumn("toxic", F.lit(0)))


def outcomes(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, fails, n, good, toxic``: documents by the set of filters they fail, E included."""
    same = rows.groupBy("doc_id", "digest", "part", "fails").agg(F.count("*").alias("n"))
    low = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("low")
    copies = labelled(same, labels).groupBy("digest", "part", "fails", "good", "toxic").agg(F.sum("n").alias("n"), low)
    first = F.min("low.doc_id").over(Window.partitionBy("digest"))
    kept = F.when(first.isNull(), F.col("n")).when(F.col("low.doc_id") == first, F.col("low.n")).otherwise(0)
    split = copies.withColumn("kept", kept).select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("fails"), F.col("kept").alias("n")),
        F.struct(F.concat("fails", F.lit("E")).alias("fails"), (F.col("n") - F.col("kept")).alias("n")))).alias("o"))
    return split.where("o.n > 0").groupBy("part", F.col("o.fails").alias("fails")).agg(
        F.sum("o.n").alias("n"), F.sum(F.col("o.n") * F.col("good")).alias("good"), F.sum(F.col("o.n") * F.col("toxic")).alias("toxic"))


def interactions(counts: DataFrame) -> DataFrame:
    """One row per part, order and step, from ``part, fails, n, good, toxic``."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    per_part = counts.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("cells"))
    steps = (per_part.select("part", "cells", F.explode(F.array(*map(F.lit, orders))).alias("filter_order"))
             .select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
             .withColumn("own", F.expr("substring(filter_order, step, 1)"))
             .withColumn("before", F.expr("substring(filter_order, 1, step - 1)")))

    def fails(c: Column) -> Column:
        return F.contains(c["fails"], F.col("own"))

    def earlier(c: Column) -> Column:
        return F.call_function("translate", F.col("before"), c["fails"], F.lit("")) != F.col("before")

    def total(of: str, where) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(where(c), c[of]).otherwise(0))

    removed = lambda c: fails(c) & ~earlier(c)
    # Over all orders a filter removes a document that fails k filters in 1/k of the orders.
    share = F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(
        fails(c), c["n"] * (F.lit(factorial(len(FILTERS))) / F.length(c["fails"])).cast("long")).otherwise(0))
    return steps.select(
        "part", "filter_order", "step", total("n", lambda c: ~fails(c) & ~earlier(c)).alias("kept"), total("n", removed).alias("removed"),
        total("n", lambda c: fails(c) & earlier(c)).alias("redundant"), total("n", lambda c: c["fails"] == F.col("own")).alias("unique_fails"),
        total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"), share.alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step."""
    return interactions(outcomes(facts(matrix(docs, key, text, part)), labels))
