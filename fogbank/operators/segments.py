"""Ordered computations that never need one whole key in one task.

A window over ``partitionBy(key)`` sends a key to one task, however large it is. The
operators here cut every key into segments of consecutive order values. Rows are sorted
inside their segment only, and what has to cross a segment border travels either as
copies of the rows near the border (``with_halo``, for frames of limited reach) or in one
summary row per segment (``ordered_rank`` and the operators built like it, for unlimited
reach).

The segment width is an argument of every operator. Observation tables hold one row per
key and timestamp, so a segment holds at most width / grain rows: with the default of
``WIDTH_US`` and the minute grain of station clocks that is 46,080 rows, whatever share of
the table the key owns. For denser rows ``fitting_width`` chooses the width from counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fogbank.functions.dates import DAY_US, HOUR_US, micros

WIDTH_US = 32 * DAY_US
MINUTE_US = HOUR_US // 60
ROWS_PER_SEGMENT = 50_000


def time_segment(t: Column | str, width_us: int = WIDTH_US) -> Column:
    return F.floor(micros(t) / width_us).cast("bigint")


def fitting_width(df: DataFrame, keys: Sequence[str], t: str, rows: int = ROWS_PER_SEGMENT,
                  widest: int = WIDTH_US, least: int = MINUTE_US) -> int:
    """The widest of ``widest``, its half, quarter ... (not below ``least``) with no segment of more than ``rows`` rows.

    One aggregate per width tried: the fullest segment tells how many halvings are needed at least, as a half of a segment
    holds half of its rows or more. The driver gets one number. Where even the finest is too full, the finest is returned: that
    many rows lie that close.
    """
    halvings, k = max(0, (widest // least).bit_length() - 1), 0
    while True:
        slot = F.floor(micros(t) / (widest >> k)).cast("bigint").alias("_slot")
        fullest = df.groupBy(*keys, slot).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
        if fullest <= rows or k == halvings:
            return widest >> k
        k = min(halvings, k + (-(-fullest // rows) - 1).bit_length())


def row_segment(position: Column | str, width: int = ROWS_PER_SEGMENT) -> Column:
    c = F.col(position) if isinstance(position, str) else position
    return F.floor(c / width).cast("bigint")


def with_halo(df: DataFrame, t: str, reach_us: int, width_us: int = WIDTH_US) -> DataFrame:
    """Give each row its segment, and copy rows that later segments look back at.

    Adds ``_seg`` and ``_own``. A frame that reaches back at most ``reach_us`` and is
    partitioned by key and ``_seg`` sees everything it needs for rows with ``_own``.
    """
    us = micros(t)
    own = guarded([], F.floor(us / width_us).cast("bigint"))
    last = F.floor((us + reach_us) / width_us).cast("bigint")
    # Only rows within reach of the border are copied: reach / width of the table.
    return (df.withColumn("_seg", F.explode(F.sequence(own, last)))
            .withColumn("_own", F.col("_seg") == own))


#: Segments whose sizes are added up in one task when there is no key.
SEGMENTS_PER_GROUP = 4096


def _starts(sizes: DataFrame, total: str | None) -> DataFrame:
    """Rows before each segment of a table without keys, in two levels: groups of segments first, then segments in their group.

    The driver adds up one number per group of segments, so no task sees all segments.
    """
    grouped = sizes.withColumn("_group", F.floor(F.col("_seg") / SEGMENTS_PER_GROUP).cast("bigint"))
    held = sorted((r["_group"], r["n"]) for r in grouped.groupBy("_group").agg(F.sum("_n").alias("n")).collect())
    before, rows = 0, []
    for group, n in held:
        rows.append((group, before))
        before += n
    offsets = sizes.sparkSession.createDataFrame(rows, "_group bigint, _offset bigint")
    inside = F.sum("_n").over(Window.partitionBy("_group").orderBy("_seg")) - F.col("_n")
    starts = grouped.withColumn("_start", inside).join(offsets, "_group").withColumn("_start", F.col("_start") + F.col("_offset"))
    return (starts.withColumn(total, F.lit(before).cast("bigint")) if total else starts).drop("_group", "_offset")


def ordered_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], segment: Column,
                 rank: str = "rank", total: str | None = None,
                 at_most: int | None = None) -> DataFrame:
    """1-based position of each row in its key, and optionally the key's row count.

    ``order`` must be unique within a key and ``segment`` must not decrease along it. With
    ``at_most`` only the first rows are kept, and segments that start later are dropped
    before anything is sorted.
    """
    cut = df.withColumn("_seg", guarded(keys, segment))
    sizes = cut.groupBy(*keys, "_seg").agg(F.count(F.lit(1)).alias("_n"))
    starts = _starts(sizes, total) if not keys else sizes.withColumn(
        "_start", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_seg")) - F.col("_n"))
    if total and keys:
        starts = starts.withColumn(total, F.sum("_n").over(Window.partitionBy(*keys)))
    if at_most is not None:
        starts = starts.filter(F.col("_start") < at_most)
    inside = Window.partitionBy(*keys, "_seg").orderBy(*order)
    ranked = (join_on(cut, starts.drop("_n"), [*keys, "_seg"])
              .withColumn(rank, F.col("_start") + F.row_number().over(inside))
              .drop("_start", "_seg"))
    return ranked if at_most is None else ranked.filter(F.col(rank) <= at_most)


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Plain equi-join without a hint. When ``left`` is already partitioned by the keys for a
    window, a shuffled join reuses that partitioning; a small ``right`` is broadcast by size."""
    return left.join(right, list(keys), how)


def guarded(keys: Sequence[str], segment: Column) -> Column:
    """``segment``, or an error for a null key or order value: an equi-join would drop the row silently."""
    segment = F.when(segment.isNull(), F.raise_error(F.lit("null in order column"))).otherwise(segment)
    for k in keys:
        segment = F.when(F.col(k).isNull(), F.raise_error(F.lit(f"null in key column {k}"))).otherwise(segment)
    return segment
