"""Tables behind the published panels and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fogbank import constants as K
from fogbank.functions.classes import code_name, is_fog, percent, verdict
from fogbank.functions.dates import DAY_US, micros, minute_text, month_key
from fogbank.operators.quality import last_observed
from fogbank.operators.segments import join_on, ordered_rank, row_segment


def panel_months(obs: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Months with at least two distinct timestamps, which is when the extremes differ."""
    per_month = obs.groupBy(*keys, month_key(ts).alias("ym")).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    return per_month.filter(F.col("_a") < F.col("_b")).select(*keys, "ym")


def months_present(obs: DataFrame, labels: DataFrame, ts: str = "ts") -> DataFrame:
    """Months of either table."""
    return (obs.select(month_key(ts).alias("ym")).distinct()
            .union(labels.select(month_key(ts).alias("ym")).distinct()).distinct())


def recorded_locations(labels: DataFrame, keys: Sequence[str], ts: str = "ts", code: str = "code") -> DataFrame:
    """Locations with at least one record in the month; "/" counts."""
    return (labels.groupBy(*keys, month_key(ts).alias("ym")).agg(F.count(code).alias("n_recorded"))
            .filter(F.col("n_recorded") > 0))


def pages(labels: DataFrame, sheet: Sequence[str], locations: DataFrame, key: str = "location_id",
          ts: str = "ts", code: str = "code", size: int = K.PAGE_SIZE) -> DataFrame:
    """Page number and page count of every recorded location of a month, in column order."""
    recorded = recorded_locations(labels, [*sheet, key], ts, code)
    listed = recorded.join(locations.select(*sheet, key, "ordinal"), [*sheet, key])
    ranked = ordered_rank(listed, [*sheet, "ym"], ["ordinal"], row_segment("ordinal"), "_i", "_total")
    return (ranked.withColumn("page", (F.floor((F.col("_i") - 1) / size) + 1).cast("int"))
            .withColumn("n_pages", F.ceil(F.col("_total") / size).cast("int"))
            .drop("_i", "_total", "n_recorded"))


def monthly_panel(obs: DataFrame, labels: DataFrame, locations: DataFrame, sheet: Sequence[str],
                  measures: Sequence[str], key: str = "location_id", ts: str = "ts",
                  code: str = "code") -> DataFrame:
    """Measures beside the codes of every location on a page of the month."""
    numbered = pages(labels, sheet, locations, key, ts, code).join(
        panel_months(obs, sheet, ts), [*sheet, "ym"], "left_semi")
    series = obs.select(*sheet, ts, *measures).join(labels.select(*sheet, ts, key, code), [*sheet, ts])
    return (series.withColumn("ym", month_key(ts))
            .join(numbered.select(*sheet, "ym", key, "page", "n_pages"), [*sheet, "ym", key]))


def daily_summary(predictions: DataFrame, key: str = "location_id", ts: str = "ts") -> DataFrame:
    """Per day: locations with any fog code, and the mean fog probability in percent."""
    per_location = (predictions.groupBy(F.to_date(ts).alias("day"), key)
                    .agg(F.max(is_fog("code")).alias("_fog"), F.sum("fog_prob").alias("_p"),
                         F.count("fog_prob").alias("_n")))
    return per_location.groupBy("day").agg(
        F.count_if("_fog").alias("n_fog_locations"),
        (F.try_divide(F.sum("_p"), F.sum("_n")) * 100).alias("mean_prob_pct"))


def probability_grid(predictions: DataFrame, key: str = "location_id", ts: str = "ts") -> DataFrame:
    """Largest fog probability in percent per location and day; labelled from 50 on."""
    grid = (predictions.groupBy(key, F.to_date(ts).alias("day"))
            .agg((F.max("fog_prob") * 100).alias("max_prob_pct")))
    return grid.withColumn("label_shown", F.coalesce(F.col("max_prob_pct") >= K.HEAT_LABEL_FROM, F.lit(False)))


def wide_grid(grid: DataFrame, days: Sequence, key: str = "location_id") -> DataFrame:
    """Location by day matrix; the forecast horizon bounds the days, which are listed."""
    return grid.groupBy(key).pivot("day", list(days)).agg(F.first("max_prob_pct"))


def breakdown(predictions: DataFrame, key: str = "location_id") -> DataFrame:
    """Hours per predicted code, with the location's largest fog probability."""
    per_code = predictions.groupBy(key, "code").agg(F.count(F.lit(1)).alias("hours"), F.max("fog_prob").alias("_m"))
    peak = per_code.groupBy(key).agg(F.max("_m").alias("max_fog_prob"))
    return join_on(per_code.drop("_m"), peak, [key])


def named_predictions(predictions: DataFrame, locations: DataFrame, thresholds: DataFrame,
                      key: str = "location_id") -> DataFrame:
    """Names and thresholds beside predictions; unknown locations keep their id and the default."""
    return (predictions.join(locations.select(key, "name"), key, "left")
            .join(thresholds.select(key, "threshold"), key, "left")
            .withColumn("name", F.coalesce("name", key))
            .withColumn("threshold", F.coalesce("threshold", F.lit(K.DEFAULT_THRESHOLD))))


def long_export(named: DataFrame, ts: str = "ts") -> DataFrame:
    return named.select(minute_text(ts).alias("日時"), F.col("name").alias("地点"),
                        F.col("code").cast("int").alias("予測コード"), code_name("code").alias("現象名"),
                        percent("fog_prob").alias("霧確率(%)"), verdict("fog_prob", "threshold").alias("判定"))


def wide_export(named: DataFrame, names: Sequence[str], ts: str = "ts") -> DataFrame:
    """One row per time and two columns per location. The names are listed, so this is one aggregate."""
    wide = (named.groupBy(F.col(ts)).pivot("name", list(names))
            .agg(F.first(F.col("code").cast("int")).alias("c"), F.first(percent("fog_prob")).alias("p")))
    columns = [x for n in names for x in (F.col(f"`{n}_c`").alias(f"{n}_予測コード"),
                                          F.col(f"`{n}_p`").alias(f"{n}_霧確率(%)"))]
    return wide.orderBy(ts).select(minute_text(ts).alias("日時"), *columns)


def recent_history(obs: DataFrame, labels: DataFrame, days: int = 5, sheet: Sequence[str] = (),
                   key: str = "location_id", ts: str = "ts", code: str = "code") -> DataFrame:
    """Observations and codes of each location's last ``days`` before its last record."""
    last = last_observed(labels, [*sheet, key], ts, code)
    recent = (labels.join(last, [*sheet, key])
              .filter((F.col(ts) <= F.col("last_observed"))
                      & (micros(ts) >= micros("last_observed") - days * DAY_US)))
    return recent.join(obs, [*sheet, ts])


def forecast_panel(history: DataFrame, forecast: DataFrame, thresholds: DataFrame,
                   measures: Sequence[str] = ("temp", "dew", "rh"), key: str = "location_id",
                   ts: str = "ts") -> DataFrame:
    """History and forecast of each location as one series.

    ``segment`` is 0 until the axis is broken, which happens when the forecast starts more
    than two days after the history ends; the forecast is segment 1 then.
    """
    ends = history.groupBy(key).agg(F.max(ts).alias("_end"))
    starts = forecast.groupBy(key).agg(F.min(ts).alias("_start"))
    gap = (micros("_start") - micros("_end")) / DAY_US
    broken = starts.join(ends, key, "left").select(
        key, F.coalesce(gap > K.PANEL_BREAK_DAYS, F.lit(False)).alias("_broken"))
    past = history.select(key, ts, *measures, F.col("code").cast("int").alias("code"),
                          F.lit(None).cast("double").alias("prob_pct"), F.lit("history").alias("kind"))
    ahead = forecast.select(key, ts, *measures, F.col("code").cast("int").alias("code"),
                            (F.col("fog_prob") * 100).alias("prob_pct"), F.lit("forecast").alias("kind"))
    limits = broken.join(thresholds.select(key, "threshold"), key, "left").select(
        key, "_broken", (F.coalesce("threshold", F.lit(K.DEFAULT_THRESHOLD)) * 100).alias("threshold_pct"))
    return (past.unionByName(ahead).join(limits, key)
            .withColumn("segment", F.when(F.col("_broken") & (F.col("kind") == "forecast"), 1).otherwise(0))
            .drop("_broken"))


def wide_to_long(wide: DataFrame, ids: Sequence[str], columns: Sequence[str], key: str = "location_id",
                 value: str = "cell") -> DataFrame:
    return wide.unpivot(list(ids), list(columns), key, value)


def partition_by_month(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Add the month column that writers partition by."""
    return df.withColumn("ym", month_key(ts))


def write_months(df: DataFrame, path: str, ts: str = "ts") -> None:
    """A folder per month, its rows sorted by time within and across files.

    Rows are dealt out by ranges of (month, time), so a large month is several files of their own span of time.
    """
    (partition_by_month(df, ts).repartitionByRange("ym", ts).sortWithinPartitions("ym", ts).write.partitionBy("ym").parquet(path))


def read_months(spark: SparkSession, path: str, months: Sequence[str]) -> DataFrame:
    """The rows of the given months (2025-03); other folders are not opened."""
    stored = spark.read.option("basePath", path).parquet(path)
    return stored.filter(F.col("ym").cast("string").isin(*months))
