"""Landed hourly forecasts: JSON objects of parallel arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fogbank import constants as K
from fogbank.operators.forecast import shape_forecast

HOURLY = T.StructType([T.StructField("time", T.ArrayType(T.StringType()))] + [
    T.StructField(v, T.ArrayType(T.DoubleType())) for v in K.FORECAST_VARIABLES])
ITEM = T.StructType([T.StructField("hourly", HOURLY)])
LINE = "file string, response string"


def land_lines(responses: DataFrame, path: str) -> None:
    """Write responses (file, response: the text as it came) as lines of few files, for readers with ``lines``.

    A file of its own costs a small response far more than its hours do: to create, to commit, to list and to open.
    """
    responses.select("file", "response").write.json(path)


def _given(column: str) -> Column:
    missing = F.raise_error(F.lit(f"a landed line has no {column}"))
    return F.when(F.col(column).isNull(), missing).otherwise(F.col(column)).alias(column)


def read_payloads(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Items (file, position, hourly) of landed responses, one response per file or, with ``lines``, one per line.

    A response is one object for a single point or an array of objects for several. It is read whole,
    as the hours of one request are few. A broken response is an error, not an empty one. A line names the
    file its response stands for, each file once.
    """
    if lines:
        stored = spark.read.schema(LINE).json(path, mode="FAILFAST")
        raw = stored.select(_given("file"), _given("response").alias("value"))
    else:
        raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    several = F.from_json("value", T.ArrayType(ITEM), {"mode": "FAILFAST"})
    single = F.array(F.from_json("value", ITEM, {"mode": "FAILFAST"}))
    items = F.when(F.ltrim("value").startswith("["), several).otherwise(single)
    return raw.select("file", F.posexplode(items).alias("position", "item")).select("file", "position", "item.hourly")


def with_batch(items: DataFrame) -> DataFrame:
    """``batch``: the name of the response's file without folder and extension."""
    return items.withColumn("batch", F.regexp_extract("file", r"([^/]*?)(?:\.[^./]*)?$", 1))


def match_points(items: DataFrame, manifest: DataFrame) -> DataFrame:
    """Items (batch, position, hourly) beside the names that the manifest (batch, position, name) gives them.

    An item the manifest does not know (a response nobody asked for, or more items than points) is an error: names would shift.
    Items without hours drop out.
    """
    asked = manifest.select("batch", "position", F.struct("name").alias("_asked"))
    matched = items.join(asked, ["batch", "position"], "left")
    known = F.when(F.col("_asked").isNull(), F.raise_error(F.concat_ws(
        " ", F.lit("no point was asked for at position"), "position", F.lit("of response"), "batch"))).otherwise(F.col("_asked.name"))
    return matched.withColumn("name", known).drop("_asked").filter(F.col("name").isNotNull() & F.col("hourly").isNotNull())


def read_forecast(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Hourly rows of single-point responses, landed one per file or (``lines``) one per line."""
    return _not_empty(shape_forecast(read_payloads(spark, path, lines), ["file"]), path)


def read_forecasts(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Hourly rows of responses for several points each; ``manifest`` holds (batch, position, name)."""
    return _not_empty(shape_forecast(match_points(with_batch(read_payloads(spark, path)), manifest), ["name"]), path)


def _not_empty(rows: DataFrame, path: str) -> DataFrame:
    if rows.isEmpty():
        raise ValueError(f"no usable forecast hour in {path}")
    return rows
