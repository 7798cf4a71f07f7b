"""Feature assembly: calendar, exact-time lags, rolling frames, fills."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fogbank import constants as K
from fogbank.functions import calendar
from fogbank.functions.dates import HOUR_US, micros
from fogbank.operators.segments import WIDTH_US, join_on, with_halo


def calendar_features(df: DataFrame, ts: str = "ts", lat: float = K.DEFAULT_LAT,
                      lon: float = K.DEFAULT_LON) -> DataFrame:
    sin, cos = calendar.hour_cycle(ts)
    added = {"month": F.month(ts), "dew_gap": F.col("temp") - F.col("dew"),
             "hour_sin": sin, "hour_cos": cos,
             K.SUN_FEATURE: calendar.hours_to_sunrise(ts, lat, lon)}
    if K.WIND_DIRECTION in df.columns:
        added["wind_sin"], added["wind_cos"] = calendar.wind_vector(K.WIND_DIRECTION)
    return df.withColumns(added)


def _frame(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys, "_seg").orderBy("_us")


def exact_lag(value: str, hours: int, window: Window) -> Column:
    """Value at exactly ``hours`` before the row; null without a row at that time."""
    return F.max(value).over(window.rangeBetween(-hours * HOUR_US, -hours * HOUR_US))


def trailing(agg: Column, hours: int, window: Window) -> Column:
    """Aggregate over (t - hours, t]: the row exactly ``hours`` back is outside."""
    return agg.over(window.rangeBetween(-(hours * HOUR_US - 1), 0))


def history_features(df: DataFrame, keys: Sequence[str], ts: str = "ts",
                     width_us: int = WIDTH_US) -> DataFrame:
    """Temperature changes, 3 h wind mean and 24 h rain sum of each row.

    One row per key and timestamp is expected (``cleaning.one_per_timestamp``). All four
    features share one shuffle and one sort: the frames reach back a day at most, so a key
    is cut into segments and only rows within a day of a border are copied.
    """
    w = _frame(keys)
    cut = with_halo(df, ts, 24 * HOUR_US, width_us).withColumn("_us", micros(ts))
    return (cut.withColumns({
        "temp_change_1h": F.col("temp") - exact_lag("temp", 1, w),
        "temp_change_3h": F.col("temp") - exact_lag("temp", 3, w),
        "wind_mean_3h": trailing(F.avg("wind"), 3, w),
        "rain_sum_24h": trailing(F.sum(F.coalesce("rain", F.lit(0.0))), 24, w)})
        .filter("_own").drop("_seg", "_own", "_us"))


def lagged(df: DataFrame, keys: Sequence[str], value: str, hours: Sequence[int], ts: str = "ts",
           width_us: int = WIDTH_US) -> DataFrame:
    w = _frame(keys)
    cut = with_halo(df, ts, max(hours) * HOUR_US, width_us).withColumn("_us", micros(ts))
    return (cut.withColumns({f"{value}_{h}h_ago": exact_lag(value, h, w) for h in hours})
            .filter("_own").drop("_seg", "_own", "_us"))


def rolling(df: DataFrame, keys: Sequence[str], aggs: dict[str, tuple[Column, int]], ts: str = "ts",
            width_us: int = WIDTH_US) -> DataFrame:
    """Trailing aggregates; ``aggs`` maps new names to (aggregate, hours)."""
    w = _frame(keys)
    reach = max(hours for _, hours in aggs.values()) * HOUR_US
    cut = with_halo(df, ts, reach, width_us).withColumn("_us", micros(ts))
    return (cut.withColumns({n: trailing(a, hours, w) for n, (a, hours) in aggs.items()})
            .filter("_own").drop("_seg", "_own", "_us"))


def fill_history(df: DataFrame, rain_zero: bool = True) -> DataFrame:
    """Defaults for rows without history, after the history itself has been computed."""
    zero = F.lit(0.0)
    filled = df.withColumns({
        "temp_change_1h": F.coalesce("temp_change_1h", zero),
        "temp_change_3h": F.coalesce("temp_change_3h", zero),
        "wind_mean_3h": F.coalesce("wind_mean_3h", "wind"),
        "rain_sum_24h": F.coalesce("rain_sum_24h", zero)})
    return filled.withColumn("rain", F.coalesce("rain", zero)) if rain_zero else filled


def exact_medians(df: DataFrame, keys: Sequence[str], columns: Sequence[str], accuracy: int = 10_000) -> DataFrame:
    """Exact median of each column per key, as rows (keys, measure, n_rows, n, median).

    ``percentile`` would keep every distinct value of a key in one task. Here a first pass brackets the middle ranks: an
    approximate percentile is off by at most 1 / ``accuracy`` of the ranks, however the values lie, so values four times
    as far to both sides hold the middle. A second pass counts the distinct values inside the bracket and, as one number,
    what lies below it. Both passes combine partial results before the shuffle; at most some 8 / ``accuracy`` of a key's
    values are ever put in order. A bracket that misses a middle rank is an error, never a wrong value.
    """
    rows = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("x")) for c in columns])).alias("_e"))
    rows = rows.select(*keys, "_e.measure", "_e.x")
    by = [*keys, "measure"]
    off = 4 / accuracy
    stats = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("x").alias("n"),
        F.percentile_approx("x", [0.5 - off, 0.5 + off], accuracy).alias("_near"))
    bracket = stats.filter("n > 0").select(*by, F.col("n").alias("_n_all"), F.col("_near")[0].alias("_lo"), F.col("_near")[1].alias("_hi"))
    # Values below the bracket count as one null, which sorts first.
    values = (join_on(rows.filter(F.col("x").isNotNull()), bracket, by).filter(F.col("x") <= F.col("_hi"))
              .groupBy(*by, "_n_all", F.when(F.col("x") >= F.col("_lo"), F.col("x")).alias("_x")).agg(F.count(F.lit(1)).alias("_n")))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy(F.asc_nulls_first("_x")))
    # Middle ranks: one for odd counts, two for even counts.
    first, last = F.floor((F.col("_n_all") + 1) / 2), F.floor(F.col("_n_all") / 2) + 1
    holds = lambda k: (F.col("_upto") >= k) & (F.col("_upto") - F.col("_n") < k)
    picked = values.withColumn("_upto", upto).groupBy(*by).agg(
        F.max(F.when(holds(first), F.col("_x"))).alias("_a"), F.max(F.when(holds(last), F.col("_x"))).alias("_b"))
    middle = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("no middle rank in its bracket"))).otherwise(
        (F.col("_a") + F.col("_b")) / 2)
    medians = picked.select(*by, middle.alias("median"))
    return join_on(stats.drop("_near"), medians, by, "left")


def fill_optional(df: DataFrame, keys: Sequence[str], medians: DataFrame | None = None,
                  floor: float = K.OPTIONAL_COVERAGE) -> DataFrame:
    """Optional measures: the key's median where missing, or all null below the coverage floor."""
    present = [m for m in K.OPTIONAL_MEASURES if m in df.columns]
    if not present:
        return df
    if medians is None:
        medians = exact_medians(df, keys, present)
    used = medians.withColumn("_used", F.col("n") >= floor * F.col("n_rows"))
    wide = used.groupBy(*keys).agg(*[x for m in present for x in (
        F.max(F.when(F.col("measure") == m, F.col("median"))).alias(f"_m_{m}"),
        F.max(F.when(F.col("measure") == m, F.col("_used"))).alias(f"_u_{m}"))])
    joined = join_on(df, wide, keys, "left")
    return joined.withColumns({
        m: F.when(F.col(f"_u_{m}"), F.coalesce(F.col(m), F.col(f"_m_{m}"))) for m in present}
    ).drop(*[c for m in present for c in (f"_m_{m}", f"_u_{m}")])


def choose_features(df: DataFrame) -> list[str]:
    """Names of the features this table can use; one aggregate decides on optional measures."""
    names = list(K.BASE_FEATURES)
    if all(f in df.columns for f in K.WIND_FEATURES):
        names += K.WIND_FEATURES
    optional = [m for m in K.OPTIONAL_MEASURES if m in df.columns]
    if optional:
        counts = df.agg(*[F.count(m).alias(m) for m in optional]).first()
        names += [m for m in optional if counts[m] > 0]
    names += [f for f in K.LAG_FEATURES if f in df.columns]
    if K.SUN_FEATURE in df.columns:
        names.append(K.SUN_FEATURE)
    return names


def with_columns_for(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add features the table lacks as null columns."""
    return df.withColumns({f: F.lit(None).cast("double") for f in features if f not in df.columns})


def complete_optional(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Optional measures that only a part of the rows has, made usable for all rows.

    After ``fill_optional`` such a measure is null in the files that lack it. It takes the middle value of the others
    there, and ``has_<measure>`` (1 or 0) tells both apart, so no file loses its rows for a measure it does not record.
    Inside one file both are constant and no tree splits on them. Returns the names of the added columns as well.
    """
    optional = [m for m in K.OPTIONAL_MEASURES if m in df.columns]
    if not optional:
        return df, []
    stats = df.agg(F.count(F.lit(1)).alias("n"), *[x for m in optional for x in (
        F.count(m).alias(m), F.percentile_approx(m, 0.5).alias(f"mid_{m}"))]).first()
    partial = {m: stats[f"mid_{m}"] for m in optional if 0 < stats[m] < stats["n"]}
    marked = df.withColumns({f"has_{m}": F.col(m).isNotNull().cast("double") for m in partial})
    return marked.withColumns({m: F.coalesce(F.col(m), F.lit(float(v))) for m, v in partial.items()}), [
        f"has_{m}" for m in partial]


def prepare(df: DataFrame, keys: Sequence[str], ts: str = "ts", lat: float = K.DEFAULT_LAT,
            lon: float = K.DEFAULT_LON, rain_zero: bool = True, width_us: int = WIDTH_US) -> DataFrame:
    """Every feature of a table with one row per key and timestamp."""
    full = history_features(calendar_features(df, ts, lat, lon), keys, ts, width_us)
    return fill_history(fill_optional(full, keys), rain_zero)
