"""Hourly forecasts: payload rows, units, interpolation, choice per location."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fogbank import constants as K
from fogbank.operators.segments import WIDTH_US, guarded, join_on, time_segment


def payload_rows(payloads: DataFrame, keys: Sequence[str], hourly: str = "hourly") -> DataFrame:
    """One row per hour from a struct of parallel arrays; absent variables become null columns."""
    fields = {f.name for f in payloads.schema[hourly].dataType.fields}
    known = [v for v in K.FORECAST_VARIABLES if v in fields]
    present = payloads.filter(F.col(f"{hourly}.time").isNotNull())
    # arrays_zip of a null array is null and would lose the payload, so null becomes empty.
    arrays = [F.col(f"{hourly}.time").alias("time")] + [
        F.coalesce(F.col(f"{hourly}.{v}").cast("array<double>"), F.array().cast("array<double>")).alias(v)
        for v in known]
    narrow = present.select(*keys, *arrays)
    rows = narrow.select(*keys, F.inline(F.arrays_zip("time", *known))).filter(F.col("time").isNotNull())
    return rows.select(*keys, F.col("time").cast("timestamp").alias("ts"), *[
        F.col(v).alias(K.FORECAST_VARIABLES[v][0]) for v in known])


def to_observation_units(rows: DataFrame) -> DataFrame:
    """Forecast units to observation units; no rain forecast means no rain."""
    changes = {}
    for column, rule in K.FORECAST_VARIABLES.values():
        if rule and column in rows.columns:
            op, factor = rule
            changes[column] = F.col(column) / factor if op == "/" else F.col(column) * factor
    if "rain" in rows.columns:
        changes["rain"] = F.coalesce(F.col("rain"), F.lit(0.0))
    return rows.withColumns(changes)


def interpolate(df: DataFrame, keys: Sequence[str], columns: Sequence[str], ts: str = "ts",
                width_us: int = WIDTH_US) -> DataFrame:
    """Linear interpolation by row position; the ends take the nearest value.

    Neighbouring values are looked up inside a segment; one row per segment carries the
    nearest values and the row count across its borders. Only columns with both nulls and
    values have anything to fill: one aggregate over the rows tells which they are.
    """
    if not columns:
        return df
    held = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in columns]).first()
    whole, columns = columns, [c for c in columns if 0 < held[c] < held["_n"]]
    df = df.withColumns({c: F.col(c).cast("double") for c in whole})
    if not columns:
        return df
    cut = df.withColumn("_seg", guarded(keys, time_segment(ts, width_us)))
    inside = Window.partitionBy(*keys, "_seg").orderBy(ts)
    back = inside.rowsBetween(Window.unboundedPreceding, 0)
    # Looking ahead in reversed order keeps the frame growing instead of rescanning it per row.
    ahead = (Window.partitionBy(*keys, "_seg").orderBy(F.desc(ts))
             .rowsBetween(Window.unboundedPreceding, 0))
    local = cut.withColumn("_i", F.row_number().over(inside).cast("bigint"))

    def known(c):
        return F.when(F.col(c).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(c).cast("double").alias("v")))

    local = local.withColumns({f"_k_{c}": known(c) for c in columns})
    local = local.withColumns({
        **{f"_p_{c}": F.last(f"_k_{c}", ignorenulls=True).over(back) for c in columns},
        **{f"_n_{c}": F.last(f"_k_{c}", ignorenulls=True).over(ahead) for c in columns}})
    edges = local.groupBy(*keys, "_seg").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.max_by(f"_k_{c}", F.col(f"_k_{c}.i")).alias(f"_l_{c}") for c in columns],
        *[F.min_by(f"_k_{c}", F.col(f"_k_{c}.i")).alias(f"_f_{c}") for c in columns])
    along = Window.partitionBy(*keys).orderBy("_seg")
    edges = edges.withColumn("_start", F.sum("_n").over(along) - F.col("_n"))

    def placed(name):
        return F.when(F.col(name).isNotNull(), F.struct(
            (F.col("_start") + F.col(f"{name}.i")).alias("i"), F.col(f"{name}.v").alias("v")))

    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.desc("_seg")).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(*keys, "_seg", "_start", *[
        F.last(placed(f"_l_{c}"), ignorenulls=True).over(earlier).alias(f"_gp_{c}") for c in columns], *[
        F.last(placed(f"_f_{c}"), ignorenulls=True).over(later).alias(f"_gn_{c}") for c in columns])
    joined = join_on(local, edges, [*keys, "_seg"])
    at = F.col("_start") + F.col("_i")
    filled = {}
    for c in columns:
        prev, next_ = F.coalesce(placed(f"_p_{c}"), f"_gp_{c}"), F.coalesce(placed(f"_n_{c}"), f"_gn_{c}")
        between = prev["v"] + (next_["v"] - prev["v"]) * (at - prev["i"]) / (next_["i"] - prev["i"])
        filled[c] = (F.when(F.col(c).isNotNull(), F.col(c).cast("double"))
                     .when(prev.isNotNull() & next_.isNotNull(), between)
                     .otherwise(F.coalesce(prev["v"], next_["v"])))
    return joined.withColumns(filled).select(*df.columns)


def usable_rows(rows: DataFrame) -> DataFrame:
    """Rows with every measure a model cannot do without."""
    return rows.na.drop(subset=list(K.FORECAST_REQUIRED))


def shape_forecast(payloads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Payload structs to complete hourly rows in observation units."""
    rows = to_observation_units(payload_rows(payloads, keys))
    numeric = [c for c in rows.columns if c not in (*keys, "ts")]
    return usable_rows(interpolate(rows, keys, numeric))


def locate(locations: DataFrame, coords: DataFrame, name: str = "name") -> DataFrame:
    """Locations that have coordinates under the same name."""
    return locations.join(coords, name)


def match_report(locations: DataFrame, coords: DataFrame, name: str = "name") -> DataFrame:
    found = locations.join(coords.select(name).distinct().withColumn("_hit", F.lit(True)), name, "left")
    return found.agg(F.count("_hit").alias("n_matched"), F.count(F.lit(1)).alias("n_locations"))


def choose_source(locations: DataFrame, own: DataFrame, default: DataFrame, key: str = "location_id",
                  ts: str = "ts") -> DataFrame:
    """Per location: its own forecast when it covers exactly the default's times, else the default.

    The sets are compared by counting: equal sizes and every time found in the other set.
    """
    wanted = default.select(ts).distinct()
    size = wanted.agg(F.count(F.lit(1)).alias("_size")).scalar()
    times = own.select(key, ts).distinct()
    compared = (times.join(wanted.withColumn("_hit", F.lit(1)), ts, "left")
                .groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.count("_hit").alias("_hits")))
    compared = compared.withColumn("_same", (F.col("_n") == size) & (F.col("_hits") == F.col("_n")))
    chosen = locations.join(compared.select(key, "_same"), key, "left")
    return (chosen.withColumn("mismatched", F.coalesce(~F.col("_same"), F.lit(False)))
            .withColumn("source", F.when(F.col("_same"), F.col(key)).otherwise(F.lit("default")))
            .drop("_same"))


def forecast_for_each(chosen: DataFrame, own: DataFrame, default: DataFrame,
                      key: str = "location_id") -> DataFrame:
    """Every location with the rows of its forecast.

    Locations with their own forecast meet it by id. The others all share the default.
    """
    theirs = chosen.filter(F.col("source") != "default").join(own, key)
    shared = with_horizon(chosen.filter(F.col("source") == "default"), default)
    return theirs.unionByName(shared, allowMissingColumns=True)


def with_horizon(locations: DataFrame, horizon: DataFrame, at_most: int = K.HORIZON_ROWS) -> DataFrame:
    """Every location with every row of one forecast horizon; that many rows are the result.

    The horizon is counted, broadcast, and met in place, so no location moves. More than ``at_most`` rows are an error:
    that is no forecast.
    """
    n = horizon.limit(at_most + 1).count()
    if n > at_most:
        raise ValueError(f"a forecast has at most {at_most} rows, this one has more")
    return locations.withColumn("source", F.lit("default")).join(
        F.broadcast(horizon.withColumn("source", F.lit("default"))), "source")
