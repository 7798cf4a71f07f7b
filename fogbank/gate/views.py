"""Station views of the driver tables, in Spark and as SQL for the oracle.

events: a user is an observation point, 32 consecutive users share a sheet, and the number in
``props`` decides what was written into the hour's cell. orders: datetime texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fogbank import constants as K
from fogbank.session import materialise, prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stamp(c: Column | str) -> Column:
    """Timestamps leave a query as text, which both engines print alike."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def fine_stamp(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def r6(c: Column | str) -> Column:
    # Adding zero turns -0.0 into 0.0.
    return F.round(c, 6) + F.lit(0.0)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    return e.select(
        "event_id", ts.alias("ts"), "user_id", "event_type", "value",
        F.regexp_extract("props", r"(\d+)", 1).cast("int").alias("k"),
        F.date_trunc("hour", ts).alias("hour"),
        F.concat(F.lit("L"), F.col("user_id")).alias("location_id"),
        (F.col("user_id") % 32 + 1).cast("int").alias("ordinal"),
        F.concat(F.lit("S"), F.floor(F.col("user_id") / 32)).alias("sheet"))


EV = """ev AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, date_trunc('hour', ts) AS hour,
         'L' || user_id AS location_id, CAST(user_id % 32 + 1 AS INT) AS ordinal,
         'S' || (user_id // 32) AS sheet
  FROM events)"""


def cell_of(k: str = "k") -> Column:
    v = F.col(k)
    return (F.when(v < 50, "/").when(v < 60, "").when(v < 70, "／")
            .when(v < 80, (v - 69).cast("string")).when(v < 85, "1 8").when(v < 90, "１０")
            .when(v < 95, "99").otherwise("x"))


# Meaning of each cell, written down independently of the cell text.
CODE = """CASE WHEN k < 50 THEN 0 WHEN k < 60 THEN NULL WHEN k < 70 THEN 0 WHEN k < 80 THEN k - 69
          WHEN k < 85 THEN 8 WHEN k < 90 THEN 10 ELSE NULL END"""


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sheet, location_id, ordinal, ts, k, cell): the last event of the hour."""
    return (events(spark, sf_dir).groupBy("sheet", "location_id", "ordinal", F.col("hour").alias("ts"))
            .agg(F.max_by("k", "event_id").alias("k")).withColumn("cell", cell_of()))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fogbank.functions.text import phenomenon_code
    return recordings(spark, sf_dir).withColumn("code", phenomenon_code("cell"))


LB = f"""rec AS (SELECT sheet, location_id, ordinal, hour AS ts, arg_max(k, event_id) AS k
  FROM ev GROUP BY ALL), lb AS (SELECT *, CAST({CODE} AS INT) AS code FROM rec)"""

WORDS = (*K.COMPASS, "静穏")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sheet, ts, temp, dew, rain, wind, rh, wind_word) per sheet and hour."""
    n = F.count(F.lit(1))
    words = F.array(*[F.lit(w) for w in WORDS])
    return (events(spark, sf_dir).groupBy("sheet", F.col("hour").alias("ts")).agg(
        F.avg("value").alias("temp"), F.min("value").alias("dew"),
        F.when(n % 3 != 0, n.cast("double")).alias("rain"), (F.max("value") / 10).alias("wind"),
        F.least(F.lit(100.0), (50 + n).cast("double")).alias("rh"),
        F.get(words, (F.max("event_id") % 17).cast("int")).alias("wind_word"),
        F.when(F.max("event_id") % 4 != 0, 1000 + F.max("event_id") % 23 + F.lit(0.5)).alias("pressure"),
        F.when(F.max("event_id") % 40 == 0, F.max("value")).alias("visibility")))


OB = """ob AS (SELECT sheet, hour AS ts, avg(value) AS temp, min(value) AS dew,
         CASE WHEN count(*) %% 3 <> 0 THEN CAST(count(*) AS DOUBLE) END AS rain, max(value) / 10 AS wind,
         least(100.0, CAST(50 + count(*) AS DOUBLE)) AS rh,
         list_extract([%s], CAST(max(event_id) %% 17 AS INT) + 1) AS wind_word,
         CASE WHEN max(event_id) %% 4 <> 0 THEN 1000 + max(event_id) %% 23 + 0.5::DOUBLE END AS pressure,
         CASE WHEN max(event_id) %% 40 = 0 THEN max(value) END AS visibility
  FROM ev GROUP BY ALL)""" % ", ".join(f"'{w}'" for w in WORDS)

DEGREES = "CASE wind_word " + " ".join(
    f"WHEN '{w}' THEN {22.5 * i}" for i, w in enumerate(K.COMPASS)) + " END"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, predictions and probabilities for the score operators; a location is user % 32."""
    e = events(spark, sf_dir)

    def slots(a: int, b: int, m: int) -> Column:
        raw = [((F.col("k") * (i + a) + F.col("user_id") * (i + b)) % m + 1).cast("double") for i in range(11)]
        total = raw[0]
        for x in raw[1:]:
            total = total + x
        return F.array(*[x / total for x in raw])

    return e.select(
        "event_id", "ts", "k", "user_id", F.concat(F.lit("P"), F.col("user_id") % 32).alias("location_id"),
        (F.col("k") % 11).cast("int").alias("code"),
        ((F.col("k") * 7 + F.col("user_id")) % 11).cast("int").alias("pred"),
        (((F.col("k") * 37 + F.col("user_id")) % 101) / 100.0).alias("fog_prob"),
        slots(3, 1, 17).alias("forest"), slots(5, 2, 13).alias("boosted"))


def _sql_slots(a: int, b: int, m: int) -> str:
    raw = [f"CAST((k * {i + a} + user_id * {i + b}) % {m} + 1 AS DOUBLE)" for i in range(11)]
    total = " + ".join(raw)
    return "[" + ", ".join(f"{x} / ({total})" for x in raw) + "]"


SC = f"""sc AS (SELECT event_id, ts, k, user_id, 'P' || (user_id % 32) AS location_id, CAST(k % 11 AS INT) AS code,
    CAST((k * 7 + user_id) % 11 AS INT) AS pred, CAST((k * 37 + user_id) % 101 AS DOUBLE) / 100.0 AS fog_prob,
    {_sql_slots(3, 1, 17)} AS forest, {_sql_slots(5, 2, 13)} AS boosted FROM ev)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prediction per location (user % 32) and hour."""
    s = scored(spark, sf_dir)
    return (s.groupBy("location_id", F.date_trunc("hour", "ts").alias("ts"))
            .agg(F.max_by("pred", "event_id").alias("code"), F.max_by("fog_prob", "event_id").alias("fog_prob")))


PR = """pr AS (SELECT location_id, date_trunc('hour', ts) AS ts, arg_max(pred, event_id) AS code,
    arg_max(fog_prob, event_id) AS fog_prob FROM sc GROUP BY ALL)"""


def place_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of some of the prediction locations, from the nations."""
    n = table(spark, sf_dir, "nation")
    return n.select(F.concat(F.lit("P"), F.col("n_nationkey")).alias("location_id"), F.col("n_name").alias("name"))


def limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds of the locations whose nation is in an even region."""
    n = table(spark, sf_dir, "nation").filter("n_regionkey % 2 = 0")
    return n.select(F.concat(F.lit("P"), F.col("n_nationkey")).alias("location_id"),
                    (F.lit(0.25) + F.col("n_regionkey") / 10).alias("threshold"))


NM = """nm AS (SELECT 'P' || n_nationkey AS location_id, n_name AS name FROM nation),
    th AS (SELECT 'P' || n_nationkey AS location_id, 0.25::DOUBLE + CAST(n_regionkey AS DOUBLE) / 10 AS threshold
           FROM nation WHERE n_regionkey % 2 = 0)"""


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast payloads: a struct of arrays per user and day, with gaps.

    Events are reduced to one per hour first, so an array holds 24 values at most.
    """
    hourly = (events(spark, sf_dir).groupBy("location_id", "hour")
              .agg(F.max_by("value", "event_id").alias("value"), F.max_by("k", "event_id").alias("k")))
    item = F.struct(
        F.date_format("hour", "yyyy-MM-dd'T'HH:mm").alias("time"),
        F.when(F.col("k") % 5 != 0, F.col("value")).alias("temperature_2m"),
        F.when(F.col("k") % 7 != 0, F.col("k").cast("double")).alias("precipitation"),
        F.when(F.col("k") % 3 != 0, F.col("k") + 1.0).alias("relative_humidity_2m"),
        (F.col("value") - 2).alias("dew_point_2m"), (F.col("value") / 4).alias("wind_speed_10m"),
        (F.col("k") * 36.0).alias("sunshine_duration"))
    arrays = (hourly.groupBy("location_id", F.to_date("hour").alias("day"))
              .agg(F.sort_array(F.collect_list(item)).alias("_a")))
    return arrays.select("location_id", "day", F.struct(*[
        F.col(f"_a.{c}").alias(c) for c in ("time", "temperature_2m", "precipitation", "relative_humidity_2m",
                                            "dew_point_2m", "wind_speed_10m", "sunshine_duration")]).alias("hourly"))


FC = """fc AS (SELECT location_id, CAST(hour AS DATE) AS day, hour AS ts,
      CASE WHEN k % 5 <> 0 THEN value END AS temp, coalesce(CASE WHEN k % 7 <> 0 THEN k::DOUBLE END, 0) AS rain,
      CASE WHEN k % 3 <> 0 THEN k + 1.0::DOUBLE END AS rh, value - 2 AS dew, value / 4 AS wind,
      k * 36.0::DOUBLE / 3600.0 AS sunshine
    FROM (SELECT location_id, hour, arg_max(value, event_id) AS value, arg_max(k, event_id) AS k
          FROM ev GROUP BY ALL))"""


def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station files (file, r, fields) built from the events, one per sheet.

    Sheets differ in how many title rows come first. Columns: datetime, measures with a
    metadata column between, then 32 locations, then columns that must be turned away.
    """
    from fogbank.operators.segments import ordered_rank, time_segment
    obs = observations(spark, sf_dir)
    lanes = [F.max(F.when(F.col("ordinal") == i, F.col("cell"))).alias(f"l{i}") for i in range(1, 33)]
    cells = recordings(spark, sf_dir).groupBy("sheet", "ts").agg(*lanes)
    titles = (F.substring("sheet", 2, 9).cast("int") % 3).alias("titles")
    data = ordered_rank(obs.join(cells, ["sheet", "ts"]), ["sheet"], ["ts"], time_segment("ts"), "i")
    data = data.withColumn("titles", titles)
    midnight = F.hour("ts") == 0
    day = F.when(midnight, F.date_sub(F.to_date("ts"), 1)).otherwise(F.to_date("ts"))
    dt = F.concat(F.date_format(day, "yyyy年M月d日"), F.when(midnight, 24).otherwise(F.hour("ts")), F.lit("時"))

    def text(c: str) -> Column:
        return F.col(c).cast("string")

    rows = data.select(
        F.col("sheet").alias("file"), (F.col("titles") + F.col("i") + 2).cast("int").alias("r"),
        F.array(dt, text("temp"), F.lit("8"), text("rain"), text("wind"), F.col("wind_word"), text("dew"),
                F.col("rh").cast("int").cast("string"),
                *[F.nullif(F.col(f"l{i}"), F.lit("")) for i in range(1, 33)],
                F.round("temp", 1).cast("string"), F.concat(F.round("dew", 1).cast("string"), F.lit("5"))
                ).alias("fields"))
    sheets = obs.select("sheet").distinct().withColumn("titles", titles)
    none = F.lit(None).cast("string")
    head = sheets.select(F.col("sheet").alias("file"), F.explode(F.concat(
        F.filter(F.array(*[F.struct(F.lit(t).alias("r"), F.array(F.concat(
            F.lit("観測データ "), "sheet")).alias("fields")) for t in range(2)]), lambda x: x["r"] < F.col("titles")),
        F.array(
            F.struct(F.col("titles").alias("r"), F.array(
                F.lit("年月日時"), F.lit("気温(℃)"), F.lit("品質情報"), F.lit("降水量（ｍｍ）"), F.lit("風速(m/s)"), none,
                F.lit("露点温度(℃)"), F.lit("相対湿度(％)"),
                *[F.concat(F.lit("地点"), F.lit(f"{i}")) for i in range(1, 32)], F.lit("地点1"),
                F.lit("水温"), F.lit("取水口")).alias("fields")),
            F.struct((F.col("titles") + 1).alias("r"), F.array(none, none, none, none, none, F.lit("風向")).alias("fields")),
            F.struct((F.col("titles") + 2).alias("r"), F.array(none, none, F.lit("品質")).alias("fields"))))).alias("_h"))
    return head.select("file", "_h.r", "_h.fields").unionByName(rows)


def landed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The station files as a stored table, which is how a loader meets them."""
    return materialise(sheet_rows(spark, sf_dir), "station-files")
