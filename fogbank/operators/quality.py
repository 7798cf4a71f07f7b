"""Load and recording reports, and detection of suspicious recording blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fogbank import constants as K
from fogbank.functions.dates import micros
from fogbank.operators.segments import WIDTH_US, guarded, join_on, time_segment


def load_report(obs: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Rows, period and coverage of every measure; optional ones say whether they are used."""
    names = [m for m in [*K.MEASURES, K.WIND_DIRECTION] if m in obs.columns]
    totals = obs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        *[F.count(m).alias(m) for m in names])
    long = totals.unpivot([*keys, "n_rows", "first_ts", "last_ts"], names, "measure", "n_valid")
    coverage = F.try_divide("n_valid", "n_rows")
    optional = F.col("measure").isin(*K.OPTIONAL_MEASURES)
    return (long.withColumn("coverage", coverage)
            .withColumn("used", F.when(optional, F.col("coverage") >= K.OPTIONAL_COVERAGE)))


def recording_quality(labels: DataFrame, keys: Sequence[str], ts: str = "ts",
                      code: str = "code") -> DataFrame:
    """Recorded, "/", event and blank counts per location; warns when "/" was never recorded."""
    c = F.col(code)
    counted = labels.groupBy(*keys).agg(
        F.count(c).alias("n_recorded"), F.count_if(c == 0).alias("n_slash"),
        F.count_if(c > 0).alias("n_event"), F.count_if(c.isNull()).alias("n_blank"),
        F.max(F.when(c.isNotNull(), F.col(ts))).alias("last_recorded"))
    return counted.withColumn("no_slash_warning", (F.col("n_recorded") > 0) & (F.col("n_slash") == 0))


def last_observed(labels: DataFrame, keys: Sequence[str], ts: str = "ts",
                  code: str = "code") -> DataFrame:
    """Last recorded time per location, or the last row's time when nothing is recorded."""
    return labels.groupBy(*keys).agg(F.coalesce(
        F.max(F.when(F.col(code).isNotNull(), F.col(ts))), F.max(ts)).alias("last_observed"))


def recorded_blocks(labels: DataFrame, keys: Sequence[str], ts: str = "ts", code: str = "code",
                    gap_hours: float = K.BLOCK_GAP_HOURS, width_us: int = WIDTH_US) -> DataFrame:
    """Recorded rows with the gap to the previous one and a running block number.

    A block ends where the gap is longer than ``gap_hours``. Gaps and breaks are found inside
    segments; one row per segment links it to the last row before it.
    """
    us = micros(ts)
    gap_us = int(gap_hours * 3.6e9)
    recorded = (labels.filter(F.col(code).isNotNull())
                .withColumn("_seg", guarded(keys, time_segment(ts, width_us))).withColumn("_us", us))
    inside = Window.partitionBy(*keys, "_seg").orderBy("_us")
    local = recorded.withColumn("_gap", F.col("_us") - F.lag("_us").over(inside))
    local = local.withColumn("_breaks", F.sum(
        F.when(F.col("_gap") > gap_us, 1).otherwise(0)).over(inside))
    along = Window.partitionBy(*keys).orderBy("_seg")
    links = local.groupBy(*keys, "_seg").agg(
        F.min("_us").alias("_first"), F.max("_us").alias("_last"), F.max("_breaks").alias("_n"))
    links = links.withColumn("_given", F.lag("_last").over(along))
    links = links.withColumn("_cut", F.when(F.col("_first") - F.col("_given") > gap_us, 1).otherwise(0))
    links = links.withColumn("_before", F.sum(F.col("_n") + F.col("_cut")).over(along) - F.col("_n"))
    joined = join_on(local, links.select(*keys, "_seg", "_given", "_before"), [*keys, "_seg"])
    gap = F.coalesce(F.col("_gap"), F.col("_us") - F.col("_given"))
    return (joined.withColumn("gap_hours", gap / 3.6e9)
            .withColumn("block_id", F.col("_before") + F.col("_breaks"))
            .drop("_seg", "_us", "_gap", "_breaks", "_given", "_before"))


def suspicious_blocks(labels: DataFrame, keys: Sequence[str], ts: str = "ts", code: str = "code",
                      min_rows: int = K.BLOCK_MIN_ROWS, gap_hours: float = K.BLOCK_GAP_HOURS,
                      max_slash_ratio: float = K.BLOCK_MAX_SLASH_RATIO,
                      width_us: int = WIDTH_US) -> DataFrame:
    """Blocks of recorded rows in which "/" hardly occurs: (keys, start, end, slash_ratio, n).

    Blocks are first summed inside segments, where at most width / gap of them fit, and the
    parts are then merged per location. No row is joined back.
    """
    gap_us = int(gap_hours * 3.6e9)
    recorded = (labels.filter(F.col(code).isNotNull())
                .select(*keys, F.col(ts).cast("timestamp").alias("_t"), F.col(code).alias("_code"))
                .withColumn("_us", F.unix_micros("_t"))
                .withColumn("_seg", guarded(keys, time_segment("_t", width_us))))
    inside = Window.partitionBy(*keys, "_seg").orderBy("_us")
    part = F.sum(F.when(F.col("_gap") > gap_us, 1).otherwise(0)).over(inside)
    parts = (recorded.withColumn("_gap", F.col("_us") - F.lag("_us").over(inside))
             .withColumn("_part", part).groupBy(*keys, "_seg", "_part")
             .agg(F.min("_us").alias("_from"), F.max("_us").alias("_to"),
                  F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_code") == 0).alias("_slash")))
    along = Window.partitionBy(*keys).orderBy("_from")
    merged = (parts.withColumn("_gap", F.col("_from") - F.lag("_to").over(along))
              .withColumn("_block", F.sum(F.when(F.col("_gap") > gap_us, 1).otherwise(0)).over(along))
              .groupBy(*keys, "_block")
              .agg(F.timestamp_micros(F.min("_from")).alias("start"),
                   F.timestamp_micros(F.max("_to")).alias("end"),
                   (F.sum("_slash") / F.sum("_n")).alias("slash_ratio"), F.sum("_n").alias("n")))
    return merged.filter((F.col("n") >= min_rows) & (F.col("slash_ratio") <= max_slash_ratio)).drop("_block")


def block_index(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Blocks under the nodes of a dyadic tree of times: (keys, _from, _to, _level, _node), two rows a block at most.

    A node of level l covers 2^l microseconds. A block is listed on the level whose nodes are just longer than the block, so it lies
    in one node or reaches into the next one, however long it is.
    """
    bounds = blocks.select(*keys, micros("start").alias("_from"), micros("end").alias("_to")).filter(F.col("_from") <= F.col("_to"))
    levelled = bounds.withColumn("_level", F.length(F.bin(F.col("_to") - F.col("_from"))))
    ends = F.array_distinct(F.array(F.expr("shiftright(_from, _level)"), F.expr("shiftright(_to, _level)")))
    return levelled.withColumn("_node", F.explode(ends))


def drop_blocks(df: DataFrame, blocks: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Rows outside every block of their location; both ends of a block belong to it.

    A time looks up the nodes above it on the levels that hold blocks in one equi-join by location, level and node, so the times
    of a large location stay spread out. The times found are few, and their rows go.
    """
    listed = block_index(blocks, keys)
    # At most 63 levels.
    levels = sorted(r["_level"] for r in listed.select("_level").distinct().collect())
    if not levels:
        return df
    nodes = F.explode(F.array(*[F.struct(F.lit(n).alias("_level"), F.shiftright("_t", n).alias("_node")) for n in levels]))
    times = df.select(*keys, micros(ts).alias("_t")).select(*keys, "_t", nodes.alias("_n")).select(*keys, "_t", "_n.*")
    inside = (times.join(listed, [*keys, "_level", "_node"]).filter(F.col("_t").between(F.col("_from"), F.col("_to")))
              .select(*keys, "_t").distinct())
    return df.withColumn("_t", micros(ts)).join(inside, [*keys, "_t"], "left_anti").select(*df.columns)


def gap_report(last: DataFrame, forecast_start: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Days between the last record and the forecast, with the warning and panel-break flags."""
    days = (micros("forecast_start") - micros("last_observed")) / 8.64e10
    return (join_on(last, forecast_start, keys).withColumn("gap_days", days)
            .withColumn("warn", F.col("gap_days") > K.GAP_WARNING_DAYS)
            .withColumn("panel_break", F.col("gap_days") > K.PANEL_BREAK_DAYS))
