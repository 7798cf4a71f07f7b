"""Datetime resolution and row-level cleaning of loaded observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fogbank.functions import dates
from fogbank.functions.text import cell_text
from fogbank.operators.segments import ROWS_PER_SEGMENT, guarded, join_on, ordered_rank, row_segment
from fogbank.session import materialise


def resolve_datetimes(df: DataFrame, keys: Sequence[str], row: str, cell: str,
                      out: str = "ts", rows_per_segment: int = ROWS_PER_SEGMENT,
                      fallback_year: int | None = None) -> DataFrame:
    """Datetimes of a column of cells in sheet order, filling in years that were left out.

    A year-less cell takes the year of the last row that has a datetime, plus one when its
    month and day are earlier and at least six months back. That chain is rewritten without
    recursion: month and day alone tell where the year turns, so the year of a row is the
    year of the last dated row plus the turns since then.

    A 29 February that falls in a common year has no datetime and must not take part in the chain. Which ones do depends on
    the years before them, so series with year-less leap days are carried again until no leap day changes sides: every pass
    settles one more leap day of a run, as the years up to it no longer change. All other series are carried once.
    """
    parsed = df.withColumn("_p", dates.datetime_parts(cell))
    p = F.col("_p")
    parsed = parsed.withColumn(
        "_own", F.when(p.isNotNull(), dates.from_parts(p, p["y"])).otherwise(dates.free_datetime(cell)))
    year_less = p.isNotNull() & p["y"].isNull() & dates.in_range(p)
    # 2000 was a leap year: the date exists in some year.
    parsed = parsed.withColumn(
        "_open", F.coalesce(year_less & dates.from_parts(p, F.lit(2000)).isNotNull(), F.lit(False)))
    leap_day = F.col("_open") & (p["mo"] == 2) & (p["d"] == 29)
    exists = F.coalesce(dates.from_parts(p, F.col("_year")).isNotNull(), F.lit(False))
    segment = row_segment(row, rows_per_segment)

    def carried(rows: DataFrame) -> DataFrame:
        return _carry_years(rows, keys, row, segment, fallback_year)

    def finished(rows: DataFrame) -> DataFrame:
        return (rows.withColumn(out, F.coalesce("_own", F.when(F.col("_live"), dates.from_parts(p, F.col("_year")))))
                .drop("_p", "_own", "_open", "_live", "_year"))

    first = parsed.withColumn("_live", F.col("_open") & ~leap_day)
    # A list of series, written once.
    held = materialise(parsed.filter(leap_day).select(*(keys or [F.lit(0).alias("_none")])).distinct(), "leap-day-series")
    if held.isEmpty():
        return finished(carried(first))
    plain = join_on(first, held, keys, "left_anti") if keys else first.limit(0)
    rows = join_on(first, held, keys, "left_semi") if keys else first
    while True:
        tried = materialise(carried(rows).withColumn("_next", F.col("_open") & (~leap_day | exists)), "leap-days-carried")
        if tried.filter(F.col("_next") != F.col("_live")).isEmpty():
            return finished(carried(plain)).unionByName(finished(tried.drop("_next")))
        rows = tried.withColumn("_live", F.col("_next")).drop("_next", "_year")


def _year_turn(month: Column, day: Column, prev: Column) -> Column:
    """Years between a row's written year and that of ``prev``, the row it follows."""
    back = (F.floor(prev["md"] / 100) - month) >= 6
    return (F.when((month * 100 + day < prev["md"]) & back, 1).otherwise(0)
            + F.when(prev["crossed"], 1).otherwise(0))


def _carry_years(df: DataFrame, keys: Sequence[str], row: str, segment: Column,
                 fallback_year: int | None) -> DataFrame:
    """Add ``_year``: the written year of every year-less row under the carry rule.

    ``_own`` holds datetimes that need no carrying, ``_live`` marks the year-less rows other
    rows may follow. A year-less row that is not live gets the year it would have.
    """
    key_columns = [F.col(k) for k in keys] or [F.lit(0)]
    inside = Window.partitionBy(*key_columns, "_seg").orderBy(row)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    p, own, live = F.col("_p"), F.col("_own"), F.col("_live")

    # Month and day after the row's own hour-24 shift. The year is unknown here, and only
    # decides between 29 February and 1 March, neither of which can be six months ahead.
    shifted = dates.from_parts(p, F.lit(2000))
    link = F.when(own.isNotNull(), F.struct(
        (F.month(own) * 100 + F.dayofmonth(own)).alias("md"), F.lit(False).alias("crossed"))
    ).when(live, F.struct(
        (F.month(shifted) * 100 + F.dayofmonth(shifted)).alias("md"),
        ((p["mo"] == 12) & (p["d"] == 31) & (p["h"] == 24)).alias("crossed")))

    local = df.withColumn("_seg", guarded(keys, segment)).withColumn("_link", link)
    local = local.withColumn("_prev", F.last("_link", ignorenulls=True).over(before))
    own_step = F.when(own.isNull() & F.col("_prev").isNotNull(),
                      _year_turn(p["mo"], p["d"], F.col("_prev"))).otherwise(0)
    local = local.withColumn("_step", own_step)
    local = local.withColumn("_turns", F.sum(F.when(live, F.col("_step")).otherwise(0)).over(upto))
    local = local.withColumn("_anchor", F.last(F.when(own.isNotNull(), F.struct(
        F.year(own).alias("y"), F.col("_turns").alias("turns"))), ignorenulls=True).over(upto))

    # One row per segment: what it needs from, and hands to, its neighbours.
    linked = F.when(F.col("_link").isNotNull(), F.col(row))
    dated = F.when(own.isNotNull(), F.col(row))
    summary = local.groupBy(*keys, "_seg").agg(
        F.min_by(F.struct(own.isNull().alias("open"), p["mo"].alias("mo"), p["d"].alias("d")),
                 linked).alias("head"),
        F.max_by("_link", linked).alias("tail"),
        F.max_by("_turns", row).alias("turns"),
        F.max_by("_anchor", row).alias("anchor"),
        F.min_by(F.year(own), dated).alias("first_year"))
    along = Window.partitionBy(*key_columns).orderBy("_seg")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumn("prev", F.last("tail", ignorenulls=True).over(earlier))
    summary = summary.withColumn("head_step", F.when(
        F.col("head.open") & F.col("prev").isNotNull(),
        _year_turn(F.col("head.mo"), F.col("head.d"), F.col("prev"))).otherwise(0))
    summary = summary.withColumn("turns_before", F.coalesce(
        F.sum(F.col("turns") + F.col("head_step")).over(earlier), F.lit(0)))
    summary = summary.withColumn("given_anchor", F.last(F.when(
        F.col("anchor").isNotNull(),
        F.struct(F.col("anchor.y").alias("y"), (F.col("turns_before") + F.col("head_step")
                                                + F.col("anchor.turns")).alias("turns"))),
        ignorenulls=True).over(earlier))
    first_year = (F.first("first_year", ignorenulls=True).over(
        along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        if fallback_year is None else F.lit(fallback_year))
    summary = summary.select(*keys, "_seg", F.col("prev").alias("_given"),
                             F.col("head_step").alias("_head_step"),
                             F.col("turns_before").alias("_before"),
                             F.col("given_anchor").alias("_given_anchor"),
                             first_year.alias("_first_year"))

    joined = join_on(local, summary, [*keys, "_seg"])
    # A row with no live row before it in its segment follows the segment's predecessor.
    heads = F.col("_prev").isNull()
    outside = F.when(own.isNull() & F.col("_given").isNotNull(),
                     _year_turn(p["mo"], p["d"], F.col("_given"))).otherwise(0)
    turns = (F.col("_turns")
             + F.when(heads, outside).otherwise(
                 F.col("_head_step") + F.when(live, 0).otherwise(F.col("_step"))))
    year = F.coalesce(
        F.col("_anchor.y") + F.col("_turns") - F.col("_anchor.turns")
        + F.when(live, 0).otherwise(F.col("_step")),
        F.col("_given_anchor.y") + F.col("_before") + turns - F.col("_given_anchor.turns"),
        F.col("_first_year") + F.col("_before") + turns)
    return (joined.withColumn("_year", year.cast("int"))
            .drop("_seg", "_link", "_prev", "_step", "_turns", "_anchor", "_given",
                  "_head_step", "_before", "_given_anchor", "_first_year"))


def unparsed_report(df: DataFrame, keys: Sequence[str], row: str, cell: str, ts: str,
                    samples: int = 5) -> DataFrame:
    """Rows without a datetime: how many, and the distinct texts among the first few."""
    text = cell_text(cell)
    dropped = df.filter(F.col(ts).isNull()).withColumn("_text", text)
    counts = dropped.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_dropped"),
        F.count_if(F.col("_text") != "").alias("n_with_text"))
    first = (first_rows(dropped.filter(F.col("_text") != ""), keys, row, samples)
             .groupBy(*keys)
             .agg(F.array_distinct(F.transform(
                 F.sort_array(F.collect_list(F.struct(F.col(row).alias("r"), F.col("_text").alias("t")))),
                 lambda x: x["t"])).alias("samples")))
    return (join_on(counts, first, keys, "left")
            .withColumn("samples", F.coalesce("samples", F.array().cast("array<string>"))))


def first_rows(df: DataFrame, keys: Sequence[str], row: str, n: int) -> DataFrame:
    """The ``n`` first rows of each key. Each segment offers its own first ``n``."""
    return ordered_rank(df, keys, [row], row_segment(row), rank="_k", at_most=n).drop("_k")


def valid_rows(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.filter(F.col(ts).isNotNull())


def one_per_timestamp(df: DataFrame, keys: Sequence[str], row: str, keep: str = "last") -> DataFrame:
    """One row per key (which includes the timestamp): the last or first in sheet order.

    An aggregate, not a window: copies collapse before the shuffle, so a timestamp that was
    recorded a billion times still sends one row per task.
    """
    pick = F.max_by if keep == "last" else F.min_by
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[pick(F.col(c), F.col(row)).alias(c) for c in rest])


def duplicate_count(df: DataFrame, keys: Sequence[str], group: Sequence[str]) -> DataFrame:
    """How many rows ``one_per_timestamp`` removes, per ``group``."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.groupBy(*group).agg(
        F.sum("_n").alias("n_rows"), F.sum(F.col("_n") - 1).alias("n_duplicates"))


def drop_incomplete(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(features))


def incomplete_report(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    missing = None
    for f in features:
        is_null = F.col(f).isNull()
        missing = is_null if missing is None else missing | is_null
    return df.groupBy(*keys).agg(F.count_if(missing).alias("n_dropped"),
                                 F.count(F.lit(1)).alias("n_rows"))
