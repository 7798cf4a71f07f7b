"""From observations, labels and a forecast to the published tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fogbank import constants as K
from fogbank.functions.dates import DAY_US
from fogbank.models.fleet import Fleet, load_fleet, save_fleet, train_fleet
from fogbank.models.training import Plan, Trained, load_or_train, train_locations
from fogbank.operators import features as feat
from fogbank.operators import metrics, panels, quality, splits
from fogbank.operators.forecast import choose_source, forecast_for_each, locate, with_horizon
from fogbank.operators.segments import fitting_width
from fogbank.sources.forecast_json import read_forecasts


def training_rows(obs: DataFrame, labels: DataFrame, sheet: Sequence[str] = ("file",),
                  lat: float = K.DEFAULT_LAT, lon: float = K.DEFAULT_LON) -> tuple[DataFrame, list[str]]:
    """Complete feature rows of recorded hours outside suspicious blocks, and the feature names.

    Features belong to a sheet and are computed before labels multiply the rows. A row is dropped for a required
    measure it lacks, never for an optional one that its sheet does not record.
    """
    width = fitting_width(obs, sheet, "ts", least=DAY_US)
    prepared, marks = feat.complete_optional(feat.prepare(obs, sheet, lat=lat, lon=lon, width_us=width))
    names = feat.choose_features(prepared) + marks
    recorded = labels.filter(F.col("code").isNotNull()).select(*sheet, "ts", "location_id", "code")
    width = fitting_width(labels, ["location_id"], "ts")
    blocks = quality.suspicious_blocks(labels, ["location_id"], width_us=width)
    kept = quality.drop_blocks(recorded, blocks, ["location_id"])
    joined = kept.join(prepared.select(*sheet, "ts", *names), [*sheet, "ts"])
    return joined.na.drop(subset=names).select("location_id", "ts", "code", *names), names


def _prepared_forecast(forecast: DataFrame) -> DataFrame:
    """Features of forecast hours. Interpolation leaves a wind direction null only where the forecast has none at all:
    that is unknown, not calm, and models fill it like any feature a forecast lacks."""
    rows = feat.prepare(forecast, ["location_id"])
    if K.WIND_DIRECTION in rows.columns:
        rows = rows.withColumns({f: F.when(F.col(K.WIND_DIRECTION).isNotNull(), F.col(f)) for f in K.WIND_FEATURES})
    return rows.withColumns({f"has_{m}": F.when(F.col(m).isNotNull(), F.lit(1.0))
                             for m in K.OPTIONAL_MEASURES if m in rows.columns})


def forecast_rows(locations: DataFrame, default: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """Prepared forecast rows of each location, from its own forecast where that fits.

    Features are computed per forecast, on the forecast hours alone, before they are given to
    the locations that share it.
    """
    base = _prepared_forecast(default.withColumn("location_id", F.lit("default")))
    if own is None:
        return with_horizon(locations.select("location_id"), base.drop("location_id")).drop("source")
    mine = _prepared_forecast(own)
    chosen = choose_source(locations.select("location_id"), own, default)
    return forecast_for_each(chosen, mine, base.drop("location_id")).drop("source", "mismatched")


def request_manifest(locations: DataFrame, coords: DataFrame, per_batch: int = 50) -> DataFrame:
    """(batch, position, name, lat, lon): the points to ask for, a request per batch.

    Located names, each once. A request asks for the points of its batch in the order of their positions; its response is landed
    under the batch's name (``batch``.json) and this table beside it.
    """
    named = locate(locations.select("location_id", "name"), coords).select("name", "lat", "lon").dropDuplicates(["name"])
    batches = max(1, -(-named.count() // per_batch))
    dealt = named.withColumn("batch", F.format_string("batch-%06d", F.pmod(F.xxhash64("name"), F.lit(batches))))
    position = F.row_number().over(Window.partitionBy("batch").orderBy("name")) - 1
    return dealt.select("batch", position.cast("int").alias("position"), "name", "lat", "lon")


def own_forecasts(spark: SparkSession, path: str, locations: DataFrame, manifest: DataFrame) -> DataFrame:
    """Forecasts of the locations that were asked for, by ``location_id``, from landed responses and their ``manifest``."""
    rows = read_forecasts(spark, path, manifest.select("batch", "position", "name"))
    return rows.join(locations.select("location_id", "name"), "name").drop("name")


def publish(obs: DataFrame, labels: DataFrame, locations: DataFrame, forecast: DataFrame,
            own_forecasts: DataFrame | None = None, sheet: Sequence[str] = ("file",), plan: Plan = Plan(),
            model_path: str | None = None, history_days: int = 5, lat: float = K.DEFAULT_LAT,
            lon: float = K.DEFAULT_LON) -> dict[str, DataFrame]:
    """Every published table by name. Without any model only the quality tables are there.

    ``locations`` holds (file, location_id, ordinal, name); ``location_id`` must be unique over all sheets. ``forecast`` is the default forecast,
    ``own_forecasts`` optionally holds others by location.
    """
    key = ["location_id"]
    again = [r["location_id"] for r in locations.groupBy(*key).count().where("count > 1").limit(5).collect()]
    if again:
        raise ValueError(f"location_id must be unique over all files, repeated: {', '.join(map(str, again))}")
    out = {"quality": quality.recording_quality(labels, key),
           "blocks": quality.suspicious_blocks(labels, key),
           "load_report": quality.load_report(obs, sheet),
           "monthly_temperature": panels.monthly_panel(obs, labels, locations, sheet, ("temp", "dew", "rh")),
           "monthly_wind_rain": panels.monthly_panel(obs, labels, locations, sheet, ("wind", "rain"))}

    rows, names = training_rows(obs, labels, sheet, lat, lon)
    if plan.learner == "grouped":
        trained = load_or_train(obs.sparkSession, model_path, lambda: train_fleet(rows, names, plan, locations), load_fleet, save_fleet, names)
    else:
        trained = load_or_train(obs.sparkSession, model_path, lambda: train_locations(rows, names, plan, locations), features=names)
    out["eligible"] = trained.eligible
    out["skipped"] = splits.skipped_by_reason(trained.eligible, "location_id")
    if not trained.has_models:
        return out
    modelled = trained.registry.select("location_id", "threshold")
    prepared = forecast_rows(modelled, forecast, own_forecasts)
    predictions = trained.predict(prepared)
    named = panels.named_predictions(predictions, locations, modelled)
    history = panels.recent_history(obs, labels, history_days, sheet)
    ahead = predictions.join(prepared.select("location_id", "ts", "temp", "dew", "rh"), ["location_id", "ts"])
    starts = predictions.groupBy("location_id").agg(F.min("ts").alias("forecast_start"))
    out |= {
        "registry": trained.registry, "predictions": predictions,
        "run_means": metrics.run_means(trained.registry),
        "top_features": trained.importances(),
        "wide": panels.wide_export(*_wide_names(named, trained, locations)),
        "gaps": quality.gap_report(quality.last_observed(labels, key), starts, key),
        "panel": panels.forecast_panel(history.join(modelled, "location_id", "left_semi"), ahead, modelled),
        "breakdown": panels.breakdown(predictions), "daily": panels.daily_summary(predictions),
        "grid": panels.probability_grid(predictions), "long": panels.long_export(named)}
    return out


def _wide_names(named: DataFrame, trained: Trained | Fleet, locations: DataFrame) -> tuple[DataFrame, list[str]]:
    """Predictions and the column names of the wide table: a place's name, or its id where others share the name."""
    # One row per model location, as the driver already holds.
    rows = locations.join(trained.registry.select("location_id"), "location_id").orderBy("file", "ordinal").select(
        "location_id", "name").collect()
    known = [r.name for r in rows]
    shared = sorted({n for n in known if known.count(n) > 1})
    title = F.when(F.col("name").isin(shared), F.col("location_id")).otherwise(F.col("name")) if shared else F.col("name")
    return named.withColumn("name", title), [r.location_id if r.name in shared else r.name for r in rows]
