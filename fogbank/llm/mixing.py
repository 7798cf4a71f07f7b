"""Mixing of sources to target weights by a low-discrepancy schedule of equal-token blocks.

The documents of a source are laid out end to end in a shuffled order (by a hash of the id), pass after pass. The
layout is cut into blocks of ``block`` tokens; a block may end in the next pass, so all blocks are equal but the last one of a
source, which ends at its target. Slot i of the mix has the point frac(i * golden ratio); the source whose stretch of the
cumulative targets holds the point gets the slot, and the r-th slot of a source takes its r-th block. Counts of slots differ from
the targets by a few blocks only: slots beyond a source's last block stay empty, and blocks that no slot has taken follow at the
end, by source. Every source so takes its target, rounded down, however small it is.

Scale: positions in a layout and ranks of slots are prefix sums over (source, hash bucket) and (source, chunk of
slots), so a hot source is never one task. Only one row per source reaches the driver; sources are names of data sets.

Defined cases: a null source is a source of its own, the last in order; a null text or one without words has size 0
and takes nothing; repeated rows are rows of their own; equal ids lie beside each other; an empty table gives an empty
result. No source takes more than ``most`` times its size, nor any document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fogbank.llm.common import WORD

#: Frac(i * golden ratio) times 2**64, as a step of a wrapping counter.
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 1 << 16
BUCKET_ROWS = 512


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Shares of the sum of ``sizes`` by weight; what a source cannot take is shared again among the others."""
    out, open_, rest = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s], float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if rest * weights[i] / total > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = rest * weights[i] / total
            break
        for i in full:
            out[i] = float(most * sizes[i])
            rest -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def by_code_point(names: list[str | None]) -> list[str | None]:
    return sorted((n for n in names if n is not None)) + [n for n in names if n is None]


def slots(spark, n: int, cumulative: np.ndarray, limits: np.ndarray) -> DataFrame:
    """``slot, s, block``: the source of every slot and the rank among that source's slots, below its limit.

    Blocks below the limit for which the sequence has no slot get slots from ``n`` on: a few per source, as the points of
    the golden ratio leave no stretch short by more.
    """
    upper = cumulative  # exclusive upper ends, as parts of 1

    def dealt(chunk: int) -> np.ndarray:
        i = np.arange(chunk * CHUNK, min(n, (chunk + 1) * CHUNK), dtype=np.uint64)
        point = (i * GOLDEN >> np.uint64(11)).astype(np.float64) / 2.0 ** 53
        return np.minimum(np.searchsorted(upper, point, side="right"), len(upper) - 1)

    def counted(frames):
        for frame in frames:
            for chunk in frame["id"]:
                s, c = np.unique(dealt(chunk), return_counts=True)
                yield pd.DataFrame({"chunk": chunk, "s": s.astype("int32"), "n": c})

    def ranked(frames):
        for frame in frames:
            for chunk, firsts in zip(frame["chunk"], frame["firsts"]):
                s = dealt(chunk)
                before = np.zeros(len(upper), dtype=np.int64)
                for row in firsts:
                    before[row["s"]] = row["first"]
                order = np.argsort(s, kind="stable")
                sizes = np.bincount(s, minlength=len(upper))
                rank = np.empty(len(s), dtype=np.int64)
                rank[order] = np.arange(len(s)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                block = before[s] + rank
                keep = block < limits[s]
                yield pd.DataFrame({"slot": chunk * CHUNK + np.flatnonzero(keep), "s": s[keep].astype("int32"),
                                    "block": block[keep]})

    n_chunks = -(-n // CHUNK)
    pieces = max(1, min(n_chunks, 4 * spark.sparkContext.defaultParallelism))
    counts = spark.range(0, n_chunks, 1, pieces).mapInPandas(counted, "chunk long, s int, n long")
    got = {r["s"]: r["n"] for r in counts.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    short = [(s, k) for s, limit in enumerate(limits.tolist()) for k in range(got.get(s, 0), limit)]
    last = spark.createDataFrame([(n + i, s, k) for i, (s, k) in enumerate(short)], "slot long, s int, block long")
    before = Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
              .groupBy("chunk").agg(F.collect_list(F.struct("s", "first")).alias("firsts")))
    return firsts.mapInPandas(ranked, "slot long, s int, block long").unionByName(last)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", cycle: tuple = (1, 2, 3),
        most: int = 3, block: int = 64, seed: int = 10) -> tuple[DataFrame, DataFrame]:
    """The laid-out documents and the schedule.

    The first has a row per document: ``doc_id, source, s, size, source_size, target, start`` (its first token's place in
    the layout of its source). The second has a row per piece of the mix: ``slot, s, doc_start, n``: slot numbers give
    the order of training, ``n`` the number of tokens that the slot takes from the document that starts there.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(text).alias("size"))
    per = {r["source"]: (r["size"], r["n"]) for r in
           sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
    names = by_code_point(list(per))
    sizes = [per[n][0] for n in names]
    goal = targets(sizes, [cycle[i % len(cycle)] for i in range(len(names))], most)
    total = sum(sizes)
    ends = [min(int(g + 1e-6), most * x) for g, x in zip(goal, sizes)]
    known = spark.createDataFrame([(i, n, sizes[i], goal[i], ends[i]) for i, n in enumerate(names)],
                                  "s int, source string, source_size long, target double, whole long")
    buckets = max(1, -(-max((per[n][1] for n in names), default=1) // BUCKET_ROWS))

    # The place of a document: what lies in buckets before its own, then what lies before it inside.
    hashed = (sized.join(F.broadcast(known), sized["source"].eqNullSafe(known["source"])).drop(known["source"])
              .withColumn("h", F.xxhash64(F.lit(seed), F.col("doc_id")))
              .withColumn("bucket", F.floor((F.shiftright("h", 11) / F.lit(float(1 << 53)) + 0.5) * buckets)))
    before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (hashed.groupBy("s", "bucket").agg(F.sum("size").alias("held"))
               .select("s", "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset")))
    inside = Window.partitionBy("s", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (hashed.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
              .join(offsets, ["s", "bucket"])
              .withColumn("start", F.col("offset") + F.col("inner")))
    laid = placed.select("doc_id", "source", "s", "size", "source_size", "target", "whole", "start")

    n_slots = -(-total // block)
    cumulative = np.cumsum(np.array(goal) / max(total, 1)) if names else np.array([1.0])
    limits = np.array([-(-x // block) for x in ends], dtype=np.int64) if names else np.zeros(1, np.int64)
    used = slots(spark, n_slots, cumulative, limits)
    # Each document is cut at block borders, in as many passes over its source as the mix may need.
    passes = F.sequence(F.lit(0), F.least(F.lit(most - 1), F.floor(F.col("target") / F.col("source_size")) + 1).cast("int"))
    cut = (laid.where("size > 0").select("s", "start", "size", "source_size", "whole", F.explode(passes).alias("pass"))
           .withColumn("from", F.col("start") + F.col("pass").cast("long") * F.col("source_size"))
           .withColumn("to", F.least(F.col("from") + F.col("size"), F.col("whole"))).where("from < to")
           .withColumn("block", F.explode(F.expr(f"sequence(from div {block}, (to - 1) div {block})")))
           .select("s", "block", F.col("start").alias("doc_start"),
                   (F.least("to", (F.col("block") + 1) * block) - F.greatest("from", F.col("block") * block)).alias("n")))
    # The planner takes the slots for small, as they come from a short range; they grow with the tokens.
    return laid, cut.join(used.hint("merge"), ["s", "block"]).select("slot", "s", "doc_start", "n")


def mixed_counts(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document."""
    laid, schedule = mix(docs, **options)
    taken = schedule.groupBy("s", F.col("doc_start").alias("start")).agg(F.sum("n").alias("got"))
    # Documents of size 0 share their place with the next one and take nothing.
    return (laid.join(taken, ["s", "start"], "left")
            .select("doc_id", "size", "source_size", "target",
                    F.when(F.col("size") > 0, F.coalesce("got", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("taken"),
                    "source"))
