"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

Texts become arrays of token hashes (lower-cased runs of letters and digits). Each mask selects some positions of a short
window and ignores the others, so a substituted word between selected ones does no harm. The hashes of the selected
tokens of every window of the benchmark meet those of every window of the documents in a join. A hit names a document, an
item and a diagonal (place in the document less place in the item). Along each diagonal the item is then compared token by
token: the overlap is accepted if ``span`` consecutive item tokens (the whole item, if shorter) agree up to the tolerated
share of substitutions.

The benchmark's seed hashes are broadcast only if their counted size is below ``broadcast_bytes``; a larger benchmark is
joined by shuffle.

Items of fewer than ``least`` tokens have no room for the masks: they are looked for as a whole, without substitutions, by one
seed of all their tokens.

Defined cases: null and empty texts have no tokens and give no rows; repeated documents or items give one row per (doc_id, item_id) with the best
overlap; documents with a null id are checked and reported under null; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fogbank.session import materialise

#: Selected places of each mask. Whatever substitutions ``AGREE`` accepts in ``SPAN`` tokens, or in a whole item of ``least``
#: tokens or more, at least one window of one mask meets none of them.
MASKS = ((0, 1, 2, 4), (0, 2, 5, 6), (0, 1, 4, 6))
SPAN = 13
AGREE = 0.75
TOKEN = r"[^\p{L}\p{N}]+"


def token_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), TOKEN), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seed_hashes(tokens: str, mask: tuple, m: int) -> Column:
    """Hash of the masked window at every place that has a full one."""
    reach = max(mask)
    picked = ", ".join(f"element_at({tokens}, i + {1 + k})" for k in mask)
    return F.expr(f"CASE WHEN size({tokens}) > {reach} THEN transform(sequence(0, size({tokens}) - {reach + 1}), "
                  f"i -> xxhash64({m}, {picked})) ELSE array() END")


def seeds_of(tokens: DataFrame, keep: list[str], masks: dict[int, tuple]) -> DataFrame:
    """``keep, m, at, seed``: one row per place and mask; ``masks`` by their numbers."""
    return tokens.select(*keep, F.explode(F.array(*[F.struct(F.lit(m).alias("m"), seed_hashes("tokens", mask, m).alias("s"))
                                                     for m, mask in masks.items()])).alias("e")) \
                 .select(*keep, F.posexplode("e.s").alias("at", "seed"))


def whole(n: int) -> tuple[int, tuple]:
    """Number and mask of all tokens of items of length ``n``."""
    return len(MASKS) + n, tuple(range(n))


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
             item_text: str = "text", span: int = SPAN, agree: float = AGREE, least: int = 8,
             broadcast_bytes: int = 64 << 20) -> DataFrame:
    """``doc_id, item_id, n_matched, n_compared``: documents that hold (part of) a benchmark item.

    The two numbers are of the best stretch of ``span`` item tokens.
    """
    items = (benchmark.select(F.col(item).alias("item_id"), token_hashes(F.col(item_text).cast("string")).alias("tokens"))
             .withColumn("n", F.size("tokens")).where("n > 0"))
    masks = dict(enumerate(MASKS))
    wanted = seeds_of(items.where(F.col("n") >= least), ["item_id", "n"], masks)
    # At most ``least`` - 1 lengths.
    for r in items.where(F.col("n") < least).select("n").distinct().collect():
        m, mask = whole(r["n"])
        masks[m] = mask
        wanted = wanted.unionByName(seeds_of(items.where(F.col("n") == r["n"]), ["item_id", "n"], {m: mask}))
    # The place in the item goes along as a number; the join itself needs one row per seed and item place.
    wanted = materialise(wanted.select("item_id", "n", F.col("at").alias("item_at"), "seed").distinct(), "benchmark-seeds")
    small = 32 * wanted.count() <= broadcast_bytes
    near = F.broadcast if small else (lambda df: df)
    tokens = docs.select(F.col(key).alias("doc_id"), token_hashes(F.col(text).cast("string")).alias("tokens"))
    hits = (seeds_of(tokens, ["doc_id"], masks).join(near(wanted), "seed")
            .select("doc_id", "item_id", "n", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct())
    hits = materialise(hits, "benchmark-hits")

    # Only documents with a hit are read again; null ids meet null ids.
    again = tokens.join(hits.select(F.col("doc_id").alias("hit_id")).distinct(), F.col("doc_id").eqNullSafe(F.col("hit_id")), "left_semi")
    # A hit goes on with the piece of the document that the item would cover, never with the whole text.
    piece = F.expr("slice(tokens, greatest(diagonal, 0) + 1, n)")
    found = (again.join(hits.withColumnRenamed("doc_id", "hit_id"), F.col("doc_id").eqNullSafe(F.col("hit_id")))
             .select("doc_id", "item_id", "n", F.least("diagonal", F.lit(0)).alias("shift"), piece.alias("piece")))
    both = found.join(items.select(F.col("item_id").alias("of"), F.col("n").alias("of_n"), F.col("tokens").alias("item")),
                      F.col("item_id").eqNullSafe(F.col("of")) & (F.col("n") == F.col("of_n")))
    same = F.expr("transform(item, (t, j) -> CASE WHEN shift + j >= 0 AND shift + j < size(piece) "
                  "AND element_at(piece, CAST(shift + j + 1 AS INT)) = t THEN 1 ELSE 0 END)")
    wide = F.expr(f"least(size(same), {span})")
    best = F.expr("array_max(transform(sequence(0, size(same) - wide), i -> aggregate(slice(same, i + 1, wide), 0, (s, x) -> s + x)))")
    return (both.select("doc_id", "item_id", same.alias("same")).withColumn("wide", wide)
            .select("doc_id", "item_id", F.col("wide").alias("n_compared"), best.alias("n_matched"))
            .where(F.col("n_matched") >= F.when(F.col("n_compared") < least, F.col("n_compared")).otherwise(F.ceil(F.lit(agree) * F.col("n_compared"))))
            .groupBy("doc_id", "item_id").agg(F.max("n_matched").cast("long").alias("n_matched"), F.max("n_compared").cast("long").alias("n_compared")))


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The documents without an overlap, with all their columns. Rows without an id are judged together."""
    bad = overlaps(docs, benchmark, key=key, **options).select(F.col("doc_id").alias("_bad_id")).distinct()
    return docs.join(materialise(bad, "benchmark-leaks"), F.col(key).eqNullSafe(F.col("_bad_id")), "left_anti")
