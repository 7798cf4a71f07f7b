"""Temporal splits, folds, eligibility and class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fogbank import constants as K
from fogbank.functions.dates import micros
from fogbank.operators.segments import WIDTH_US, join_on, ordered_rank, time_segment


def train_rows(n: Column, test_ratio: float = 0.2) -> Column:
    """Rows of the leading part: at least one, and at least one left for the test part."""
    head = F.greatest(F.lit(1), F.floor(n * (1 - test_ratio)))
    return F.when(head >= n, n - 1).otherwise(head)


def temporal_split(df: DataFrame, keys: Sequence[str], ts: str = "ts", ties: Sequence[str] = (),
                   width_us: int = WIDTH_US) -> DataFrame:
    """Add rank, n, and the parts ``train``/``test`` and, inside train, ``fit``/``val``.

    ``ts`` plus ``ties`` must be unique in a key.
    """
    ranked = ordered_rank(df, keys, [ts, *ties], time_segment(ts, width_us), "rank", "n")
    n_train = train_rows(F.col("n"))
    n_fit = train_rows(n_train)
    return (ranked.withColumn("n_train", n_train).withColumn("n_fit", n_fit)
            .withColumn("split", F.when(F.col("rank") <= F.col("n_train"), "train").otherwise("test"))
            .withColumn("part", F.when(F.col("rank") <= F.col("n_fit"), "fit")
                        .when(F.col("rank") <= F.col("n_train"), "val").otherwise("test")))


#: Bits a pass of a selection settles: the driver gets 2^8 numbers at most.
DIGIT = 8


def select_rank(df: DataFrame, value: Column, position: int) -> tuple[int, int]:
    """The value at a 1-based position of the order of ``value`` (whole numbers, not null), and the position among its equals.

    A radix selection: counts by the highest digit say which digit the value has, then counts by the next one among those.
    """
    low, high = df.agg(F.min(value), F.max(value)).first()
    rest = df.select((value - F.lit(low)).alias("_v"))
    found, shift = 0, max(0, (high - low).bit_length() - 1) // DIGIT * DIGIT
    while shift >= 0:
        digit = F.shiftright("_v", shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
        counts = {r["d"]: r["n"] for r in rest.groupBy(digit.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for d in sorted(counts):
            if position <= counts[d]:
                break
            position -= counts[d]
        found += d << shift
        rest = rest.filter(F.shiftright("_v", shift) == F.lit(found >> shift))
        shift -= DIGIT
    return low + found, position


def tie_order(ties: Sequence[str]) -> Column:
    """Place of a row among those of its time: by a hash of the tie columns, as a number of 62 bits."""
    return F.shiftrightunsigned(F.xxhash64(*ties), 2)


def row_at(df: DataFrame, position: int, ts: str, ties: Sequence[str] = ()) -> dict:
    """What ``up_to`` needs of the row at a 1-based position of the order (ts, hash of the ties).

    Two selections by digits: the driver never sees more than 256 numbers at once, whatever the times and however many share one.
    """
    at, left = select_rank(df, micros(ts), position)
    if not ties:
        return {"ts": ts, "at": at}
    return {"ts": ts, "at": at, "ties": list(ties), "tie": select_rank(df.filter(micros(ts) == F.lit(at)), tie_order(ties), left)[0]}


def up_to(end: dict) -> Column:
    """Rows that are not after the row that ``row_at`` found."""
    t = micros(end["ts"])
    if "tie" not in end:
        return t <= F.lit(end["at"])
    return (t < F.lit(end["at"])) | ((t == F.lit(end["at"])) & (tie_order(end["ties"]) <= F.lit(end["tie"])))


def fold_count(n: Column) -> Column:
    return F.least(F.lit(3), F.greatest(F.lit(2), F.floor(n / 100)))


def forward_folds(rank: Column, n: Column) -> Column:
    """Number of the forward-chaining fold that tests the row; 0 before the first test block.

    Fold f trains on the rows of all lower numbers. The blocks are equal and end at the last row.
    """
    k = fold_count(n)
    size = F.floor(n / (k + 1))
    from_end = F.floor((n - rank) / F.greatest(size, F.lit(1)))
    return F.when((from_end < k) & (size > 0), k - from_end).otherwise(0).cast("int")


def class_list(df: DataFrame, keys: Sequence[str], code: str = "code") -> DataFrame:
    """Sorted distinct codes per key; there are eleven codes."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(code)).alias("classes"))


def eligibility(split: DataFrame, keys: Sequence[str], code: str = "code",
                min_rows: int = K.MIN_ROWS, min_classes: int = K.MIN_CLASSES) -> DataFrame:
    """Counts that decide whether a location gets its own model, and the reason if not."""
    train = F.when(F.col("split") == "train", F.col(code))
    counts = split.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.size(F.collect_set(code)).alias("n_classes"),
        F.size(F.collect_set(train)).alias("n_train_classes"),
        F.size(F.collect_set(F.when(F.col("split") == "test", F.col(code)))).alias("n_test_classes"))
    return counts.withColumn("reason", rejection(min_rows, min_classes))


def rejection(min_rows: int = K.MIN_ROWS, min_classes: int = K.MIN_CLASSES) -> Column:
    return (F.when(F.col("n") == 0, K.REASON_ALL_DUMMY)
            .when(F.col("n") < min_rows, K.REASON_TOO_FEW_ROWS)
            .when(F.col("n_classes") < min_classes, K.REASON_TOO_FEW_CLASSES)
            .when(F.col("n_train_classes") < 2, K.REASON_SPLIT_CLASSES))


def with_lost_locations(eligible: DataFrame, locations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the locations of which no row is left, with their reason."""
    filled = locations.select(*keys).join(eligible, list(keys), "left").fillna(
        0, subset=["n", "n_classes", "n_train_classes", "n_test_classes"])
    return filled.withColumn("reason", F.when(F.col("n") == 0, K.REASON_ALL_DUMMY).otherwise(F.col("reason")))


def skipped_by_reason(eligible: DataFrame, key: str) -> DataFrame:
    """Skipped locations beside the size of their reason group, one row per location."""
    skipped = eligible.filter(F.col("reason").isNotNull()).select("reason", key, "n")
    sizes = skipped.groupBy("reason").agg(F.count(F.lit(1)).alias("n_locations"))
    return join_on(skipped, sizes, ["reason"])


def code_counts(df: DataFrame, code: str = "code") -> dict:
    """Rows per code: at most eleven numbers."""
    return {r[code]: r["count"] for r in df.groupBy(code).count().collect()}


def class_weights(df: DataFrame, keys: Sequence[str], code: str = "code",
                  name: str = "weight", counts: dict | None = None) -> DataFrame:
    """Balanced weights n / (classes * n_class) from counts of at most 11 rows per key.

    Without keys the counts are at most eleven numbers (``counts``, if they are known), which become part of the expression:
    no row is shuffled.
    """
    if not keys:
        counts = code_counts(df, code) if counts is None else counts
        n = sum(counts.values())
        weight = F.lit(None).cast("double")
        for value, size in counts.items():
            weight = F.when(F.col(code) == F.lit(value), F.lit(n / (len(counts) * size))).otherwise(weight)
        return df.withColumn(name, weight)
    per_class = df.groupBy(*keys, code).agg(F.count(F.lit(1)).alias("_nc"))
    of_key = Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)])
    balanced = F.sum("_nc").over(of_key) / (F.count(F.lit(1)).over(of_key) * F.col("_nc"))
    table = per_class.withColumn(name, balanced).drop("_nc")
    return join_on(df, table, [*keys, code])
