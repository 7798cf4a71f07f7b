"""Station files to typed observations, labels and locations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fogbank import constants as K
from fogbank.functions.dates import datetime_parts, parse_datetime
from fogbank.functions.text import number, phenomenon_code, wind_degrees
from fogbank.operators.cleaning import resolve_datetimes
from fogbank.operators.layout import Layout, detect
from fogbank.session import materialise
from fogbank.sources.grid import broken_files, output_prefix, read_lines, rows_from_lines


@dataclass
class Loaded:
    """``obs``: (file, ts, measures); ``labels``: (file, ts, location_id, letter, ordinal, name, cell, code);
    ``locations``: (file, location_id, letter, c, ordinal, name). A column letter says nothing outside its file, so
    ``location_id`` is the file and the letter. ``dated``: every data row with its parsed datetime, for the reports on what was dropped.
    ``broken``: (file) those that end inside a quoted cell, which have no rows in the other tables."""

    obs: DataFrame
    labels: DataFrame
    locations: DataFrame
    layout: Layout
    dated: DataFrame
    broken: DataFrame | None = None


def field(index: str) -> Column:
    """Field at a 0-based column number; null when the row is shorter or there is no column."""
    return F.get("fields", F.col(index))


def dated_rows(rows: DataFrame, layout: Layout) -> DataFrame:
    """Data rows with their datetime. Most cells stand alone; only files in which some year is
    left out go through the ordered resolution, with nothing but the datetime cell."""
    columns = [f"c_{m}" for m in [*K.MEASURES, K.WIND_DIRECTION]]
    data = (rows.join(layout.files.select("file", "dt_col", "data_start", *columns), "file")
            .filter(F.col("r") >= F.col("data_start")).withColumn("dt_cell", field("dt_col")))
    parts = datetime_parts("dt_cell")
    # A list of files, written once: known to be small, it is broadcast in the joins below, and
    # files that always give the year are not shuffled at all.
    year_less = materialise(data.filter(parts.isNotNull() & parts["y"].isNull()).select("file").distinct(),
                            "year-less-files")
    own = data.withColumn("ts", parse_datetime("dt_cell"))
    complete = own.join(year_less, "file", "left_anti")
    partial = data.join(year_less, "file", "left_semi")
    carried = resolve_datetimes(partial.select("file", "r", "dt_cell"), ["file"], "r", "dt_cell").drop("dt_cell")
    return complete.unionByName(partial.join(carried, ["file", "r"])).drop("dt_col", "data_start")


def load_rows(rows: DataFrame, layout: str = "auto") -> Loaded:
    """Rows (file, r, fields) to observations and labels. Only the layout is found right away."""
    found = detect(rows, layout)
    dated = dated_rows(rows, found)
    # The last row of a timestamp wins; both tables come from this one shuffle.
    columns = [f"c_{m}" for m in [*K.MEASURES, K.WIND_DIRECTION]]
    kept = (dated.filter(F.col("ts").isNotNull()).groupBy("file", "ts")
            .agg(F.max_by(F.struct("fields", *columns), "r").alias("_row"))
            .select("file", "ts", "_row.*"))
    obs = kept.select("file", "ts", *[number(field(f"c_{m}")).alias(m) for m in K.MEASURES],
                      wind_degrees(field(f"c_{K.WIND_DIRECTION}")).alias(K.WIND_DIRECTION))
    # The sheet's location columns travel as one array per file, so no row is shuffled for them.
    locations = found.locations.select(
        "file", F.concat_ws("!", "file", "location_id").alias("location_id"), F.col("location_id").alias("letter"),
        "c", "ordinal", "name")
    places = locations.groupBy("file").agg(
        F.collect_list(F.struct("location_id", "letter", "ordinal", "name", "c")).alias("_places"))
    labels = (kept.join(places, "file").select("file", "ts", "fields", F.explode("_places").alias("_p"))
              .select("file", "ts", "_p.location_id", "_p.letter", "_p.ordinal", "_p.name",
                      F.get("fields", F.col("_p.c")).alias("cell"))
              .withColumn("code", phenomenon_code("cell")))
    return Loaded(obs, labels, locations, found, dated)


def load_station_files(spark: SparkSession, paths: str | Sequence[str], layout: str = "auto",
                       check: bool = True) -> Loaded:
    """Read, infer and type a fleet of files. With ``check`` a fleet in which some file has no
    valid datetime or no location column is an error that names one such file. A broken file stops no other."""
    lines = read_lines(spark, paths)
    loaded = load_rows(rows_from_lines(lines), layout)
    loaded.broken = broken_files(lines)
    if check:
        files = loaded.layout.files.select("file")
        undated = files.join(loaded.obs.select("file"), "file", "left_anti").limit(1).collect()
        if undated:
            raise ValueError(f"no row with a valid datetime in {undated[0].file}")
        unplaced = files.join(loaded.locations.select("file"), "file", "left_anti").limit(1).collect()
        if unplaced:
            raise ValueError(f"no location column in {unplaced[0].file}")
    return loaded


def station_name(file: str = "file") -> Column:
    return output_prefix(file)
