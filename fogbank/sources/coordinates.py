"""Coordinates of observation points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fogbank.functions.text import number


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """(name, lat, lon) from a CSV file with a header.

    Columns are found by 地点/name, 緯度/lat and 経度/lon in their titles; without a name
    column the first one is taken.
    """
    raw = spark.read.option("header", True).csv(path)
    titles = {c: c.strip() for c in raw.columns}

    def find(word: str, latin: str) -> str | None:
        return next((c for c, t in titles.items() if word in t or latin in t.lower()), None)

    name = find("地点", "name") or raw.columns[0]
    lat, lon = find("緯度", "lat"), find("経度", "lon")
    if lat is None or lon is None:
        raise ValueError("no latitude or longitude column: titles must contain 緯度/lat and 経度/lon")
    # Rows of one split keep their order, and splits are ordered by their place in the file.
    order = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return last_valid(raw.select(F.col(f"`{name}`").alias("name"), F.col(f"`{lat}`").alias("lat"),
                                 F.col(f"`{lon}`").alias("lon"), order.alias("row_no")))


def last_valid(raw: DataFrame) -> DataFrame:
    """Last row per trimmed name whose coordinates are numbers; blank ones do not count."""
    typed = raw.select(F.trim("name").alias("name"), number("lat").alias("lat"), number("lon").alias("lon"), "row_no")
    return (typed.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).groupBy("name")
            .agg(F.max_by("lat", "row_no").alias("lat"), F.max_by("lon", "row_no").alias("lon")))
