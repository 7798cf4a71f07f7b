"""Queries on cell functions, cleaning and file layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from fogbank import constants as K
from fogbank.functions import calendar, classes, dates, text
from fogbank.gate.catalog import query
from fogbank.gate.views import (DEGREES, events, labels, landed_rows, observations, r6,
                                scored, sheet_rows, stamp, table)
from fogbank.operators import cleaning, layout, panels
from fogbank.plans.load import load_rows
from fogbank.session import new_table_path
from fogbank.sources import grid

# --- scalar functions ----------------------------------------------------------------------

CELL = """CASE WHEN k < 50 THEN '/' WHEN k < 60 THEN '' WHEN k < 70 THEN '／' WHEN k < 80 THEN CAST(k - 69 AS VARCHAR)
  WHEN k < 85 THEN '1 8' WHEN k < 90 THEN '１０' WHEN k < 95 THEN '99' ELSE 'x' END"""


@query("f1_cell_text", "", """SELECT o_orderkey, lower(replace(o_orderpriority, '-', '')) || ' 1２' AS raw,
  trim(replace(lower(replace(o_orderpriority, '-', '')) || ' 12', '２', '2')) AS folded FROM orders""")
def _(spark, d):
    o = table(spark, d, "orders")
    plain = F.lower(F.replace("o_orderpriority", F.lit("-"), F.lit("")))
    wide = F.concat(F.lit("　"), F.translate(plain, "abcdefghij0123456789", "ａｂｃｄｅｆｇｈｉｊ０１２３４５６７８９"),
                    F.lit("\n　１２ "))
    return o.select("o_orderkey", F.concat(plain, F.lit(" 1２")).alias("raw"), text.cell_text(wide).alias("folded"))


DT_TEXT = """dtx AS (SELECT o_orderkey, CAST(o_orderkey % 25 AS INT) AS h,
    CAST(o_orderdate AS DATE) AS d, CAST(o_orderkey % 4 AS INT) AS form FROM orders)"""


@query("f2_datetimes", "", f"""WITH {DT_TEXT} SELECT o_orderkey,
  CASE WHEN form = 3 AND h = 24 THEN NULL ELSE
    strftime(CAST(d AS TIMESTAMP) + to_hours(h), '%Y-%m-%d %H:%M:%S') END AS ts FROM dtx""")
def _(spark, d):
    o = table(spark, d, "orders")
    h, day = (F.col("o_orderkey") % 25).cast("int"), F.to_date("o_orderdate")
    form = F.col("o_orderkey") % 4
    cell = (F.when(form == 0, F.concat(F.date_format(day, "yyyy年M月d日"), h, F.lit("時")))
            .when(form == 1, F.concat(F.date_format(day, "yyyy/M/d"), F.lit(" "), h, F.lit(":00")))
            .when(form == 2, F.concat(F.date_format(day, "yyyy.MM.dd"), F.lit("　"), h, F.lit("：００：３０")))
            .otherwise(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), F.lpad(h.cast("string"), 2, "0"),
                                F.lit(":00:00.000"))))
    return o.select("o_orderkey", stamp(dates.parse_datetime(cell)).alias("ts"))


@query("f3_numbers", "ev", """SELECT event_id,
  CASE WHEN k % 4 = 0 THEN value WHEN k % 4 = 1 THEN CAST(k AS DOUBLE) ELSE NULL END AS n FROM ev""")
def _(spark, d):
    k = F.col("k")
    cell = (F.when(k % 4 == 0, F.col("value").cast("string")).when(k % 4 == 1, F.concat(F.lit(" "), k, F.lit(" ")))
            .when(k % 4 == 2, F.lit("NaN")).otherwise(F.concat(k, F.lit("×"))))
    return events(spark, d).select("event_id", text.number(cell).alias("n"))


@query("f4_phenomenon_codes", "lb", """SELECT location_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, code FROM lb""")
def _(spark, d):
    return labels(spark, d).select("location_id", stamp("ts").alias("ts"), "code")


# Cells of characters that fold to several, and what the codes in them mean.
ENCLOSED = (("3⑪", None), ("⒈", 1), ("⑴ ⑸", 5), ("⑩", 10), ("Ⅷ", None), ("２／３", 3), ("⒈⑵", 2), ("ｶﾞ7", 7))


@query("f4_enclosed_codes", "", "SELECT o_orderkey, CAST(CASE o_orderkey % 8 "
       + " ".join(f"WHEN {i} THEN {'NULL' if c is None else c}" for i, (_, c) in enumerate(ENCLOSED))
       + " END AS INT) AS code, CASE o_orderkey % 8 WHEN 4 THEN 'VIII' WHEN 7 THEN 'ガ7' END AS folded FROM orders")
def _(spark, d):
    which = (F.col("o_orderkey") % 8).cast("int")
    cell = F.get(F.array(*[F.lit(t) for t, _ in ENCLOSED]), which)
    return table(spark, d, "orders").select("o_orderkey", text.phenomenon_code(cell).alias("code"),
                                            F.when(which.isin(4, 7), text.cell_text(cell)).alias("folded"))


@query("f2_free_datetimes", "", """SELECT o_orderkey, strftime(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)
    + CASE WHEN o_orderkey % 6 IN (0, 4) THEN INTERVAL 0 HOUR ELSE to_hours(CAST(o_orderkey % 24 AS INT)) END, '%Y-%m-%d %H:%M:%S') AS ts
  FROM orders""")
def _(spark, d):
    t = F.timestamp_seconds(F.unix_timestamp(F.to_date("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") % 24) * 3600)
    forms = ("yyyyMMdd", "MMMM d, yyyy H:mm", "yyyyMMdd HH:mm", "yyyy/MM/dd hh:mm:ss a", "d-MMM-yyyy", "d MMMM yyyy H:mm:ss")
    cell = F.get(F.array(*[F.date_format(t, f) for f in forms]), (F.col("o_orderkey") % 6).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", stamp(dates.parse_datetime(cell)).alias("ts"))


@query("f2_serial_datetimes", "", """SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0
    THEN strftime(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') END AS ts FROM orders""")
def _(spark, d):
    days = F.datediff(F.to_date("o_orderdate"), F.lit(K.SERIAL_EPOCH).cast("date")) + F.lit(0.25)
    cell = F.when(F.col("o_orderkey") % 7 != 0, days).otherwise(F.lit(K.SERIAL_MAX) + days)
    return table(spark, d, "orders").select("o_orderkey", stamp(dates.parse_serial(cell)).alias("ts"))


@query("f4_number_codes", "ev", """SELECT event_id, CASE WHEN k < 22 THEN CAST(k // 2 AS INT) END AS code,
  k % 2 = 0 AND k < 22 AS plausible FROM ev""")
def _(spark, d):
    half = F.col("k") / 2
    return events(spark, d).select("event_id", text.phenomenon_code_number(half).alias("code"),
                                   text.is_phenomenon_number(half).alias("plausible"))


@query("f5_plausible_codes", "ev", f"""SELECT event_id, k < 90 AND NOT (k >= 50 AND k < 60) AS plausible FROM ev""")
def _(spark, d):
    from fogbank.gate.views import cell_of
    return events(spark, d).select("event_id", text.is_phenomenon_value(cell_of()).alias("plausible"))


@query("f6_wind_degrees", "ob", f"""SELECT sheet, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts,
  CAST({DEGREES} AS DOUBLE) AS degrees, CASE WHEN rh <= 360 THEN rh % 360 END AS numeric_degrees FROM ob""")
def _(spark, d):
    return observations(spark, d).select("sheet", stamp("ts").alias("ts"), text.wind_degrees("wind_word").alias("degrees"),
                                         text.wind_degrees(F.col("rh").cast("string")).alias("numeric_degrees"))


@query("f7_time_features", "ob", """SELECT sheet, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts,
  CAST(month(ts) AS INT) AS month, CAST(hour(ts) AS INT) AS hour, round(sin(2 * pi() * hour(ts) / 24), 6) + 0.0 AS hour_sin,
  round(cos(2 * pi() * hour(ts) / 24), 6) + 0.0 AS hour_cos, round(temp - dew, 6) + 0.0 AS dew_gap FROM ob""")
def _(spark, d):
    sin, cos = calendar.hour_cycle("ts")
    return observations(spark, d).select(
        "sheet", stamp("ts").alias("ts"), F.month("ts").alias("month"), F.hour("ts").alias("hour"),
        r6(sin).alias("hour_sin"), r6(cos).alias("hour_cos"), r6(F.col("temp") - F.col("dew")).alias("dew_gap"))


@query("f8_wind_vector", "ob", f"""SELECT sheet, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts,
  coalesce(round(sin(radians({DEGREES})), 6) + 0.0, 0.0) AS wind_sin,
  coalesce(round(cos(radians({DEGREES})), 6) + 0.0, 0.0) AS wind_cos FROM ob""")
def _(spark, d):
    sin, cos = calendar.wind_vector(text.wind_degrees("wind_word"))
    return observations(spark, d).select("sheet", stamp("ts").alias("ts"), r6(sin).alias("wind_sin"),
                                         r6(cos).alias("wind_cos"))


SUNRISE = f"""(12.0 - {K.DEFAULT_LON} / 15.0 + 9.0 - degrees(acos(greatest(-1.0, least(1.0,
   -tan(radians({K.DEFAULT_LAT})) * tan(radians(23.44) * sin(radians(360.0 / 365.0 * (dayofyear(%s) - 81)))))))) / 15.0)"""


@query("f9_sunrise_hour", "", f"""SELECT o_orderkey, round(CAST({SUNRISE % 'o_orderdate'} AS DOUBLE), 6) AS sunrise FROM orders""")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", r6(calendar.sunrise_hour("o_orderdate")).alias("sunrise"))


@query("f10_hours_to_sunrise", "ev", f"""+ s AS (SELECT event_id, CAST({SUNRISE % 'ts'} AS DOUBLE)
   - epoch_us(ts - date_trunc('day', ts)::TIMESTAMP + TIMESTAMP '1970-01-01') / 3.6e9 AS x FROM ev)
  SELECT event_id, CASE WHEN x < 0 OR x > 12 THEN 0.0 ELSE round(x, 6) END AS hours_left FROM s""")
def _(spark, d):
    return events(spark, d).select("event_id", r6(calendar.hours_to_sunrise("ts")).alias("hours_left"))


@query("f13_code_names", "sc", "SELECT event_id, CASE CAST(code AS INT) "
       + " ".join(f"WHEN {c} THEN '{n}'" for c, n in {0: K.NO_PHENOMENON, **K.CODE_NAMES}.items())
       + " END AS name, CASE WHEN k % 20 > 10 THEN 'コード' || (k % 20) END AS unknown FROM sc")
def _(spark, d):
    return scored(spark, d).select("event_id", classes.code_name("code").alias("name"), F.when(
        F.col("k") % 20 > 10, classes.code_name(F.col("k") % 20)).alias("unknown"))


@query("f14_percent", "sc", "SELECT event_id, round_even(fog_prob / 7 * 100, 1) AS pct FROM sc")
def _(spark, d):
    return scored(spark, d).select("event_id", classes.percent(F.col("fog_prob") / 7).alias("pct"))


@query("f15_verdict", "sc", """SELECT event_id, CASE WHEN k % 9 <> 0 AND fog_prob >= (k % 4) * 0.25::DOUBLE
  THEN '霧' ELSE '-' END AS verdict FROM sc""")
def _(spark, d):
    p = F.when(F.col("k") % 9 != 0, F.col("fog_prob"))
    return scored(spark, d).select("event_id", classes.verdict(p, (F.col("k") % 4) * F.lit(0.25)).alias("verdict"))


@query("f16_date_formats", "ev", """SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M') AS minute, strftime(ts, '%Y-%m') AS ym,
  strftime(ts, '%Y%m%d') AS day FROM ev""")
def _(spark, d):
    return events(spark, d).select("event_id", dates.minute_text("ts").alias("minute"), dates.month_key("ts").alias("ym"),
                                   dates.day_stamp("ts").alias("day"))


@query("f17_sheet_letters", "", """SELECT p_partkey, CASE WHEN c < 26 THEN chr(65 + c)
    ELSE chr(65 + (c - 26) // 26) || chr(65 + (c - 26) % 26) END AS letter
  FROM (SELECT p_partkey, CAST(p_partkey % 702 AS INT) AS c FROM part)""")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", text.sheet_letter(F.col("p_partkey") % 702).alias("letter"))


# --- cleaning ------------------------------------------------------------------------------

@query("p1_unparsed_datetimes", "ev", """SELECT sheet, count(*) AS n_dropped, count(*) FILTER (k % 2 = 1) AS n_with_text
  FROM ev WHERE k >= 80 GROUP BY sheet""")
def _(spark, d):
    k = F.col("k")
    cell = F.when(k < 80, F.date_format("ts", "yyyy年M月d日H時")).when(k % 2 == 1, F.concat(F.lit("合計"), k)).otherwise(" ")
    e = events(spark, d).withColumn("cell", cell)
    e = e.withColumn("parsed", dates.parse_datetime("cell"))
    return cleaning.unparsed_report(e, ["sheet"], "event_id", "cell", "parsed").drop("samples")


@query("t2_unparsed_samples", "ev", """+ f AS (SELECT sheet, event_id, k, row_number() OVER (PARTITION BY sheet ORDER BY event_id) AS i
    FROM ev WHERE k >= 80 AND k % 2 = 1),
  g AS (SELECT sheet, k, min(i) AS i FROM f WHERE i <= 5 GROUP BY sheet, k)
  SELECT sheet, string_agg('合計' || k, ',' ORDER BY i) AS samples FROM g GROUP BY sheet""")
def _(spark, d):
    k = F.col("k")
    cell = F.when(k < 80, F.date_format("ts", "yyyy年M月d日H時")).when(k % 2 == 1, F.concat(F.lit("合計"), k)).otherwise(" ")
    e = events(spark, d).withColumn("cell", cell).withColumn("parsed", dates.parse_datetime("cell"))
    return cleaning.unparsed_report(e, ["sheet"], "event_id", "cell", "parsed").select(
        "sheet", F.array_join("samples", ",").alias("samples"))


@query("p2_incomplete_rows", "ob", """SELECT sheet, count(*) FILTER (rain IS NULL OR pressure IS NULL) AS n_dropped,
  count(*) AS n_rows FROM ob GROUP BY sheet""")
def _(spark, d):
    return cleaning.incomplete_report(observations(spark, d), ["temp", "rain", "pressure"], ["sheet"])


@query("p2_complete_rows", "ob", """SELECT sheet, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, rain, pressure FROM ob
  WHERE rain IS NOT NULL AND pressure IS NOT NULL""")
def _(spark, d):
    return cleaning.drop_incomplete(observations(spark, d), ["temp", "rain", "pressure"]).select(
        "sheet", stamp("ts").alias("ts"), "rain", "pressure")


@query("w1_last_row_per_time", "ev", """SELECT location_id, strftime(hour, '%Y-%m-%d %H:%M:%S') AS ts, max(event_id) AS event_id,
  arg_max(value, event_id) AS value FROM ev GROUP BY location_id, hour""")
def _(spark, d):
    e = events(spark, d).select("location_id", F.col("hour").alias("h"), "event_id", "value")
    out = cleaning.one_per_timestamp(e, ["location_id", "h"], "event_id")
    return out.select("location_id", stamp("h").alias("ts"), "event_id", "value")


@query("w1_duplicates", "ev", """SELECT location_id, count(*) AS n_rows, count(*) - count(DISTINCT hour) AS n_duplicates
  FROM ev GROUP BY location_id""")
def _(spark, d):
    return cleaning.duplicate_count(events(spark, d), ["location_id", "hour"], ["location_id"])


@query("w3_first_row_per_time", "ev", """SELECT location_id, strftime(hour, '%Y-%m-%d %H:%M:%S') AS ts, min(event_id) AS event_id,
  arg_min(value, event_id) AS value FROM ev GROUP BY location_id, hour""")
def _(spark, d):
    e = events(spark, d).select("location_id", F.col("hour").alias("h"), "event_id", "value")
    out = cleaning.one_per_timestamp(e, ["location_id", "h"], "event_id", keep="first")
    return out.select("location_id", stamp("h").alias("ts"), "event_id", "value")


# Every customer's orders form one sheet in date order; most leave the year out. A year is
# written on the first order, after long gaps, on leap days, and on 31 December, whose hour 24
# already belongs to the next year.
CARRY = """g AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS d,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r,
    lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders),
  y AS (SELECT *, p IS NULL OR d - p > 150 OR (month(d) = 2 AND day(d) = 29) OR (month(d) = 12 AND day(d) = 31) AS dated FROM g)"""


@query("w2_year_carry", "", f"""WITH {CARRY} SELECT o_custkey, CAST(r AS BIGINT) AS r,
  strftime(CAST(d AS TIMESTAMP) + INTERVAL 24 HOUR, '%Y-%m-%d %H:%M:%S') AS ts FROM y""")
def _(spark, d):
    from pyspark.sql import Window
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("d"))
    # A customer's orders are the sheet; numbering them is part of building the input.
    w = Window.partitionBy("o_custkey").orderBy("d", "o_orderkey")
    s = o.withColumn("r", F.row_number().over(w).cast("bigint")).withColumn("p", F.lag("d").over(w))
    dated = F.col("p").isNull() | (F.datediff("d", "p") > 150) | ((F.month("d") == 2) & (F.dayofmonth("d") == 29))
    dated |= (F.month("d") == 12) & (F.dayofmonth("d") == 31)
    cell = F.concat(F.when(dated, F.date_format("d", "yyyy年M月d日")).otherwise(F.date_format("d", "M月d日")), F.lit("24時"))
    out = cleaning.resolve_datetimes(s.select("o_custkey", "r", cell.alias("cell")), ["o_custkey"], "r", "cell")
    return out.select("o_custkey", "r", stamp("ts").alias("ts"))


# --- files ---------------------------------------------------------------------------------

@query("s1_csv_fields", "", """SELECT p_brand AS file, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS BIGINT) AS r,
  CAST(p_partkey AS VARCHAR) AS a, p_name || '"q", x' || chr(10) || p_type AS b, CASE WHEN p_size % 5 <> 0 THEN CAST(p_size AS VARCHAR) END AS c,
  CAST(p_size AS VARCHAR) || '" wide "' || p_name AS e, p_type || 'tail"' AS f FROM part""")
def _(spark, d):
    p = table(spark, d, "part")
    quote = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    size = F.when(F.col("p_size") % 5 != 0, F.col("p_size").cast("string")).otherwise("")
    cells = [F.col("p_partkey").cast("string"), quote(F.concat("p_name", F.lit('"q", x\n'), "p_type")), size,
             # Quotes inside a cell that does not begin with one, and text behind a closing quote.
             F.concat(F.col("p_size").cast("string"), F.lit('" wide "'), "p_name"), F.concat(quote(F.col("p_type")), F.lit('tail"'))]
    # A file per brand, with a blank line after every part; the writer of texts writes line breaks as they are.
    sheets = p.select("p_brand", "p_partkey", F.concat(F.array_join(F.array(*cells), ","), F.lit("\n")).alias("value"))
    path = new_table_path(spark, "csv-files")
    sheets.repartition("p_brand").sortWithinPartitions("p_brand", "p_partkey").select("p_brand", "value").write.partitionBy("p_brand").text(path)
    rows = grid.read_rows(spark, path, "*.txt")
    name = F.url_decode(F.url_decode(F.regexp_extract("file", "p_brand=([^/]*)/", 1)))  # once for the folder, once for the path
    return rows.select(name.alias("file"), F.col("r").cast("bigint").alias("r"), *[
        F.get("fields", F.lit(i)).alias(c) for i, c in enumerate("abcef")])


@query("s2_file_types", "", """SELECT p_type AS file, count(*) AS n, true AS refused FROM part GROUP BY ALL""")
def _(spark, d):
    # A sheet per type is read; a workbook beside them is refused by its name.
    p = table(spark, d, "part")
    path = new_table_path(spark, "file-types")
    for name, rows in ((f"{path}/sheets", p), (f"{path}/book.xlsx", p.limit(1))):
        rows.select("p_type", F.concat_ws(",", "p_partkey", "p_name").alias("value")).repartition("p_type").write.partitionBy("p_type").text(name)
    try:
        grid.read_rows(spark, f"{path}/book.xlsx")
        refused = False
    except ValueError:
        refused = True
    rows = grid.read_rows(spark, f"{path}/sheets", "*.txt").withColumn("file", F.url_decode(F.url_decode(F.regexp_extract("file", "p_type=([^/]*)/", 1))))
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("n")).withColumn("refused", F.lit(refused))


@query("s10_output_prefix", "", """SELECT p_partkey, split_part(split_part(replace(p_name, ' ', '_'), '_', 1), ' ', 1) AS a,
  split_part(p_name, ' ', 1) AS b FROM part""")
def _(spark, d):
    p = table(spark, d, "part")
    under = F.concat(F.lit("s3://x/y/"), F.translate("p_name", " ", "_"), F.lit(".csv"))
    return p.select("p_partkey", grid.output_prefix(under).alias("a"),
                    grid.output_prefix(F.concat(F.lit("/data/"), "p_name", F.lit(".csv"))).alias("b"))


SHEETS = """sh AS (SELECT DISTINCT sheet AS file, CAST(substr(sheet, 2) AS INT) % 3 AS t FROM ev)"""


@query("g1_header_rows", "ev", f"+ {SHEETS} SELECT file, CAST(t AS INT) AS header_row FROM sh")
def _(spark, d):
    return layout.with_shapes(layout.head_table(sheet_rows(spark, d))).select("file", "header_row")


@query("g2_data_starts", "ev", f"""+ {SHEETS} SELECT file, CAST(t AS INT) AS header_row, CAST(0 AS INT) AS dt_col,
  CAST(t + 3 AS INT) AS data_start, CAST(42 AS INT) AS width FROM sh""")
def _(spark, d):
    shapes = layout.with_shapes(layout.head_table(sheet_rows(spark, d)))
    return shapes.select("file", "header_row", "dt_col", "data_start", "width")


@query("g3_header_texts", "ev", f"""+ {SHEETS} SELECT file, CAST(c AS INT) AS c, CASE WHEN c = 0 THEN CASE WHEN t = 2 THEN '観測データ ' || file
     || '|観測データ ' || file || '|' WHEN t = 1 THEN '観測データ ' || file || '|' ELSE '' END || '年月日時'
   WHEN c < 8 THEN list_extract(['気温(°C)', '品質情報|品質', '降水量(mm)', '風速(m/s)', '風向', '露点温度(°C)', '相対湿度(%)'], CAST(c AS INT))
   WHEN c < 39 THEN '地点' || (c - 7) ELSE list_extract(['地点1', '水温', '取水口'], CAST(c - 38 AS INT)) END AS texts
   FROM sh, range(0, 42) r(c)""")
def _(spark, d):
    headers = layout.with_headers(layout.with_shapes(layout.head_table(sheet_rows(spark, d))))
    return headers.select("file", F.inline("columns")).select("file", "c", F.array_join("texts", "|").alias("texts"))


@query("g4_column_roles", "ev", f"""+ {SHEETS} SELECT file, CAST(1 AS INT) AS c_temp, CAST(3 AS INT) AS c_rain, CAST(4 AS INT) AS c_wind,
  CAST(6 AS INT) AS c_dew, CAST(7 AS INT) AS c_rh, CAST(NULL AS INT) AS c_pressure, CAST(5 AS INT) AS c_wind_deg FROM sh""")
def _(spark, d):
    roles = layout.described_files(sheet_rows(spark, d))
    return roles.select("file", "c_temp", "c_rain", "c_wind", "c_dew", "c_rh", "c_pressure", "c_wind_deg")


@query("g5_header_kinds", "", """SELECT o_orderkey, m % 5 = 0 AS metadata, m % 5 IN (0, 1, 2) AS measure
  FROM (SELECT o_orderkey, o_orderkey % 5 AS m FROM orders)""")
def _(spark, d):
    o = table(spark, d, "orders")
    words = F.array(*[F.lit(w) for w in ("水温(℃)", "積算値(mm)", "気温", "(川口橋)", "蒲生水道橋")])
    head = o.select("o_orderkey", F.array(F.lit("只見"), F.get(words, (F.col("o_orderkey") % 5).cast("int"))).alias("texts"))
    return head.select("o_orderkey", layout.is_metadata("texts").alias("metadata"), layout.is_measure("texts").alias("measure"))


# Values of a location column in row order; '99' and 'x' do not look like codes.
CHECKS = """v AS (SELECT sheet AS file, ordinal, k >= 90 AS bad, row_number() OVER (PARTITION BY sheet, ordinal ORDER BY ts) AS i
    FROM lb WHERE NOT (k >= 50 AND k < 60)),
  chk AS (SELECT file, ordinal, count(*) AS n_values, count(*) FILTER (bad) AS n_bad FROM v GROUP BY ALL),
  allcol AS (SELECT DISTINCT sheet AS file, o AS ordinal FROM ev, range(1, 33) r(o)),
  cols AS (SELECT a.file, a.ordinal, coalesce(n_values, 0) AS n_values, coalesce(n_bad, 0) AS n_bad,
     coalesce(n_bad, 0) <= coalesce(n_values, 0) * 0.1::DOUBLE AS ok FROM allcol a LEFT JOIN chk USING (file, ordinal)),
  lt AS (SELECT *, CAST(ordinal + 7 AS INT) AS c, CASE WHEN ordinal + 7 < 26 THEN chr(CAST(65 + ordinal + 7 AS INT))
     ELSE 'A' || chr(CAST(65 + ordinal + 7 - 26 AS INT)) END AS letter,
     '地点' || CASE WHEN ordinal = 32 THEN 1 ELSE ordinal END AS header FROM cols)"""


@query("a4_column_check", "lb", f"+ {CHECKS} SELECT file, c, n_values, n_bad, ok FROM lt")
def _(spark, d):
    rows = sheet_rows(spark, d)
    starts = layout.with_shapes(layout.head_table(rows)).select(
        "file", F.col("data_start").alias("start"), F.lit("auto").alias("mode"),
        F.explode(F.sequence(F.lit(8), F.lit(39))).alias("c"))
    return layout.check_columns(rows, starts).select("file", "c", "n_values", "n_bad", "ok")


@query("g6_location_columns", "lb", f"""+ {CHECKS} SELECT file, letter AS location_id, c,
  CAST(row_number() OVER (PARTITION BY file ORDER BY c) AS INT) AS ordinal,
  header || CASE WHEN row_number() OVER (PARTITION BY file, header ORDER BY c) > 1 THEN '(' || letter || ')' ELSE '' END AS name
  FROM lt WHERE ok""")
def _(spark, d):
    return layout.detect(landed_rows(spark, d)).locations


@query("g6_excluded_columns", "lb", f"""+ {CHECKS} SELECT file, letter, header FROM lt WHERE NOT ok
  UNION ALL SELECT DISTINCT file, 'AO', '水温' FROM lt UNION ALL SELECT DISTINCT file, 'AP', '取水口' FROM lt""")
def _(spark, d):
    return layout.detect(landed_rows(spark, d)).excluded.select("file", "letter", "header")


@query("w12_duplicate_names", "", """SELECT n_nationkey AS c, CASE WHEN row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) > 1
  THEN 'R' || n_regionkey || '(' || chr(CAST(65 + n_nationkey AS INT)) || ')' ELSE 'R' || n_regionkey END AS name FROM nation""")
def _(spark, d):
    n = table(spark, d, "nation").select(F.lit("sheet").alias("file"), F.col("n_nationkey").alias("c"), F.concat(F.lit("R"), "n_regionkey").alias("name"))
    return layout.unique_names(n).select("c", "name")


@query("s3_load_observations", "ob", f"""SELECT sheet AS file, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(temp, 6) AS temp, rain,
  round(wind, 6) AS wind, dew, rh, CAST({DEGREES} AS DOUBLE) AS wind_deg FROM ob""")
def _(spark, d):
    obs = load_rows(landed_rows(spark, d)).obs
    return obs.select("file", stamp("ts").alias("ts"), r6("temp").alias("temp"), "rain", r6("wind").alias("wind"),
                      "dew", "rh", "wind_deg")


@query("s3_load_labels", "lb", f"""+ {CHECKS}, hours AS (SELECT DISTINCT sheet AS file, ts FROM lb)
  SELECT h.file, strftime(h.ts, '%Y-%m-%d %H:%M:%S') AS ts, h.file || '!' || letter AS location_id, letter, code
  FROM hours h JOIN lt ON lt.file = h.file AND lt.ok
  LEFT JOIN lb ON lb.sheet = h.file AND lb.ts = h.ts AND lb.ordinal = lt.ordinal""")
def _(spark, d):
    return load_rows(landed_rows(spark, d)).labels.select("file", stamp("ts").alias("ts"), "location_id", "letter", "code")


@query("j7_two_sheets", "lb", f"""+ {CHECKS}, hours AS (SELECT DISTINCT sheet AS file, ts FROM lb)
  SELECT lt.file, letter, lt.file || '!' || letter AS location_id, count(*) AS n, 0.5::DOUBLE AS threshold
  FROM hours h JOIN lt ON lt.file = h.file AND lt.ok GROUP BY ALL""")
def _(spark, d):
    # Every sheet has a column I: names and thresholds must find the one of their own sheet.
    loaded = load_rows(landed_rows(spark, d))
    scored_rows = loaded.labels.select("location_id", "ts", "code", F.lit(0.1).alias("fog_prob"))
    limits = loaded.locations.select("location_id", F.lit(0.5).alias("threshold"))
    named = panels.named_predictions(scored_rows, loaded.locations, limits)
    return (named.join(loaded.locations.select("location_id", "file", "letter"), "location_id")
            .groupBy("file", "letter", "location_id").agg(F.count(F.lit(1)).alias("n"), F.max("threshold").alias("threshold")))
