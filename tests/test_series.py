"""Series operators, forecasts, plan shapes, and queries against their oracle."""

import datetime as dt
import glob
import json
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from fogbank.gate import ORACLES, QUERIES
from fogbank.operators import features, metrics, quality, splits
from fogbank.plans.prediction import forecast_rows, own_forecasts, request_manifest
from fogbank.session import shared_dir
from fogbank.sources.forecast_json import land_lines, read_forecast, read_forecasts

DATA = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 6, 1)


def test_lag_looks_at_the_clock_not_the_row(spark):
    df = spark.createDataFrame([("s", T0, 10.0), ("s", T0 + dt.timedelta(hours=1), 12.0),
                                ("s", T0 + dt.timedelta(hours=3), 20.0)], "s string, ts timestamp, v double")
    out = [r.v_1h_ago for r in features.lagged(df, ["s"], "v", [1]).orderBy("ts").collect()]
    assert out == [None, 10.0, None]


def blocks(spark, cells, width=quality.WIDTH_US):
    df = spark.createDataFrame([("X", T0 + dt.timedelta(hours=i), c) for i, c in enumerate(cells)],
                               "location_id string, ts timestamp, code int")
    return [(r.n, r.slash_ratio) for r in quality.suspicious_blocks(df, ["location_id"], width_us=width).collect()]


def test_suspicious_blocks(spark):
    assert blocks(spark, [1] * 100) == [(100, 0.0)]
    assert blocks(spark, [1] * 100, width=10 * 3_600_000_000) == [(100, 0.0)]
    assert blocks(spark, ([0] * 9 + [2]) * 20) == []
    assert blocks(spark, [1] * 10) == []


def test_a_key_with_most_rows_is_cut_and_stays_exact(spark):
    from pyspark.sql import Window

    from fogbank.operators.segments import ordered_rank, time_segment
    minutes = spark.range(30_000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"),
        F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.col("id").cast("double").alias("v"))
    cut = minutes.groupBy("k", time_segment("ts", 86_400_000_000)).count().agg(F.max("count")).first()[0]
    assert cut <= 1440
    ranked = ordered_rank(minutes, ["k"], ["ts"], time_segment("ts", 86_400_000_000), "r", "n")
    plain = minutes.withColumn("w", F.row_number().over(Window.partitionBy("k").orderBy("ts")))
    joined = ranked.join(plain.select("k", "ts", "w"), ["k", "ts"])
    assert joined.count() == 30_000 and joined.filter("r <> w").isEmpty()
    rolled = features.rolling(minutes, ["k"], {"n": (F.count("v"), 3)}, width_us=86_400_000_000)
    assert rolled.count() == 30_000 and rolled.filter("k = 'hot'").agg(F.max("n")).first()[0] == 120


def test_widths_follow_the_counts(spark):
    """One key holds a third of the rows inside a few hours: its segments are cut until none holds too many."""
    from fogbank.operators.segments import fitting_width, time_segment
    rows = spark.range(12_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 97)).alias("k"),
        F.timestamp_micros(F.when(F.col("id") % 3 == 0, F.col("id") * 1_000_000).otherwise(F.col("id") * 200_000_000)).alias("ts"))
    assert fitting_width(rows, ["k"], "ts", rows=12_000) == 32 * 86_400_000_000
    width = fitting_width(rows, ["k"], "ts", rows=500)
    most = lambda w: rows.groupBy("k", time_segment("ts", w)).count().agg(F.max("count")).first()[0]
    assert most(width) <= 500 < most(2 * width)
    assert fitting_width(rows, [], "ts", rows=1) == 32 * 86_400_000_000 >> 15


def test_a_horizon_is_counted_before_it_is_shared(spark):
    from fogbank.operators.forecast import with_horizon
    places = spark.createDataFrame([("a",), ("b",)], "location_id string")
    assert with_horizon(places, spark.range(5).toDF("h"), at_most=5).count() == 10
    with pytest.raises(ValueError, match="at most 4 rows"):
        with_horizon(places, spark.range(5).toDF("h"), at_most=4)


def test_null_key_is_an_error(spark):
    df = spark.createDataFrame([(None, T0, 1)], "location_id string, ts timestamp, code int")
    with pytest.raises(Exception, match="null in key column"):
        quality.suspicious_blocks(df, ["location_id"]).collect()


def test_optional_coverage(spark):
    base = [("s", T0 + dt.timedelta(hours=i), 1013.0 if i < 2 else None, 5.0 if i else None) for i in range(120)]
    df = spark.createDataFrame(base, "file string, ts timestamp, pressure double, visibility double")
    r = features.fill_optional(df, ["file"]).agg(F.count("pressure").alias("p"), F.count("visibility").alias("v")).first()
    assert (r.p, r.v) == (0, 120)


def test_medians_with_outliers(spark):
    values = [1e12, -1e12] + [i / 7 for i in range(1001)] + [3.0] * 500
    df = spark.createDataFrame([("k", v) for v in values], "k string, x double")
    values.sort()
    n = len(values)
    expected = (values[(n - 1) // 2] + values[n // 2]) / 2
    for accuracy in (100, 10_000):
        assert features.exact_medians(df, ["k"], ["x"], accuracy=accuracy).first()["median"] == pytest.approx(expected, abs=0)
    crowded = spark.range(20_001).select(F.lit("k").alias("k"), F.when(F.col("id") == 0, 1e12).otherwise(F.col("id") / 20_001).alias("x"))
    assert features.exact_medians(crowded, ["k"], ["x"], accuracy=200).first()["median"] == 10_001 / 20_001
    assert features.exact_medians(crowded.withColumn("x", F.lit(None).cast("double")), ["k"], ["x"]).first()["median"] is None


def test_thresholds(spark):
    split = spark.createDataFrame([("a", 0, .1)] * 5 + [("a", 2, .9)] * 5 + [("b", 0, .1)] * 5,
                                  "location_id string, code int, fog_prob double")
    t = {r.location_id: r.threshold for r in metrics.best_threshold(split, ["location_id"]).collect()}
    assert .1 < t["a"] < .9 and t["b"] == .5


def test_small_splits(spark):
    n = spark.createDataFrame([(i,) for i in (1, 2, 5, 10, 35)], "n long")
    assert [r.t for r in n.select(splits.train_rows(F.col("n")).alias("t")).collect()] == [0, 1, 4, 8, 28]


def response(hours, **changes):
    """A made-up response: a cold, windy spell whose values all differ by the hour."""
    start = dt.datetime(2025, 1, 20)
    hourly = {
        "time": [f"{start + dt.timedelta(hours=h):%Y-%m-%dT%H:%M}" for h in range(hours)],
        "temperature_2m": [-4.0 + h for h in range(hours)], "dew_point_2m": [-6.0 + h for h in range(hours)],
        "relative_humidity_2m": [60 + h for h in range(hours)], "wind_speed_10m": [7.0 - h / 10 for h in range(hours)],
        "wind_direction_10m": [350] * hours, "precipitation": [h / 4 for h in range(hours)]}
    return {"hourly": {**hourly, **changes}}


def landed(path, content):
    path.write_text(json.dumps(content))
    return str(path)


def test_forecast_of_one_point(spark, tmp_path):
    item = response(9, sunshine_duration=[900.0] * 9, shortwave_radiation=[250.0] * 9, visibility=[12500.0] * 9,
                    surface_pressure=[987.5] * 9)
    item["hourly"]["temperature_2m"][3] = None
    item["hourly"]["precipitation"][7] = None
    rows = read_forecast(spark, landed(tmp_path / "f.json", item)).orderBy("ts").collect()
    assert len(rows) == 9 and (rows[3].temp, rows[7].rain, rows[6].rain) == (-1.0, 0.0, 1.5)
    assert (rows[0].sunshine, rows[0].visibility, rows[0].pressure, rows[0].radiation) == (.25, 12.5, 987.5, pytest.approx(.9))


def test_forecasts_of_several_points_in_two_responses(spark, tmp_path):
    landed(tmp_path / "batch-1.json", [response(4), {"error": True}, response(4, temperature_2m=[31.5] * 4)])
    landed(tmp_path / "batch-2.json", [response(4, temperature_2m=[7.0] * 4), response(4, temperature_2m=[8.0] * 4)])
    manifest = spark.createDataFrame([("batch-1", 0, "峠"), ("batch-1", 1, "沼"), ("batch-1", 2, "港"), ("batch-2", 0, "原"), ("batch-2", 1, "沢")],
                                     "batch string, position int, name string")
    rows = read_forecasts(spark, str(tmp_path), manifest).groupBy("name").agg(F.max("temp").alias("t"), F.count("*").alias("n")).collect()
    assert {r.name: (r.t, r.n) for r in rows} == {"峠": (-1.0, 4), "港": (31.5, 4), "原": (7.0, 4), "沢": (8.0, 4)}
    for fewer in ("batch = 'batch-1'", "name <> '沢'"):
        # A response nobody asked for, and one item too many.
        with pytest.raises(Exception, match="no point was asked for"):
            read_forecasts(spark, str(tmp_path), manifest.filter(fewer)).collect()


def test_own_forecasts_meet_locations_by_coordinates(spark, tmp_path):
    locations = spark.createDataFrame([("a!J", "沼"), ("b!J", "峠"), ("b!K", "沼"), ("b!L", "原")], "location_id string, name string")
    coords = spark.createDataFrame([("沼", 1.0, 2.0), ("峠", 3.0, 4.0)], "name string, lat double, lon double")
    manifest = request_manifest(locations, coords)
    asked = manifest.orderBy("position").collect()
    assert [(r.batch, r.position, r.name, r.lat) for r in asked] == [("batch-000000", 0, "峠", 3.0), ("batch-000000", 1, "沼", 1.0)]
    landed(tmp_path / "batch-000000.json", [response(4), response(4, temperature_2m=[31.5] * 4)])
    rows = own_forecasts(spark, str(tmp_path), locations, manifest).groupBy("location_id").agg(F.max("temp").alias("t")).collect()
    assert {r.location_id: r.t for r in rows} == {"b!J": -1.0, "a!J": 31.5, "b!K": 31.5}
    many = request_manifest(spark.range(500).select(F.lit("x").alias("location_id"), F.concat(F.lit("n"), "id").alias("name")),
                            spark.range(500).select(F.concat(F.lit("n"), "id").alias("name"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon")), 50)
    per = many.groupBy("batch").agg(F.count("*").alias("n"), F.max("position").alias("last"), F.count_distinct("position").alias("d")).collect()
    assert sum(r.n for r in per) == 500 and len(per) == 10 and all(r.n == r.d == r.last + 1 for r in per)


def test_absent_wind_direction_is_not_calm(spark, tmp_path):
    item = response(5)
    del item["hourly"]["wind_direction_10m"]
    places = spark.createDataFrame([("a!J",)], "location_id string")
    without = forecast_rows(places, read_forecast(spark, landed(tmp_path / "n.json", item)).drop("file"))
    assert without.count() == 5 and without.filter("wind_sin is not null or wind_cos is not null").isEmpty()
    given = forecast_rows(places, read_forecast(spark, landed(tmp_path / "y.json", response(5))).drop("file"))
    assert given.filter("wind_sin is null or wind_cos is null").isEmpty()


def test_empty_forecast_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError):
        read_forecast(spark, landed(tmp_path / "f.json", response(5, wind_speed_10m=[None] * 5)))


def test_forecasts_landed_as_lines_are_those_landed_as_files(spark, tmp_path):
    gaps = response(30, temperature_2m=[None, 4.0, None, 7.0, *[1.0] * 25, None])
    responses = {"é 1/2": response(6), "b": [response(4)], "c": gaps, "d": {"error": True}, "e": json.dumps(response(3), indent=1)}
    texts = {name: r if isinstance(r, str) else json.dumps(r) for name, r in responses.items()}
    whole = tmp_path / "whole"
    whole.mkdir()
    for i, t in enumerate(texts.values()):
        (whole / f"{i}.json").write_text(t)
    land_lines(spark.createDataFrame([*texts.items()], "file string, response string").coalesce(1), str(tmp_path / "lines"))
    names = {f"{i}.json": name for i, name in enumerate(texts)}
    want = sorted((names[r.file.split("/")[-1]], *map(plain, r[1:])) for r in read_forecast(spark, str(whole)).collect())
    got = sorted((r.file, *map(plain, r[1:])) for r in read_forecast(spark, str(tmp_path / "lines"), lines=True).collect())
    assert got == want and len(got) == 6 + 4 + 30 + 3


@pytest.mark.parametrize("line", ['{"file":"a","response":"{\\"hourly\\":"}', '{"file":"a"', '{"response":"{}"}', '{"file":"a"}'])
def test_broken_line_is_an_error(spark, tmp_path, line):
    good = json.dumps({"file": "b", "response": json.dumps(response(4))})
    (tmp_path / "lines.json").write_text(f"{good}\n{line}\n")
    with pytest.raises(Exception, match="MALFORMED_RECORD|a landed line has no"):
        read_forecast(spark, str(tmp_path / "lines.json"), lines=True).collect()


def test_points_share_landed_files(spark, tmp_path):
    """More points are more lines, not more files; the rows are those of the SQL."""
    at = dt.datetime(2024, 1, 1)
    rows = [(7 * h + u * 1000, at + dt.timedelta(hours=5 * h, minutes=u), u, "view", h * 1.5 - u, f'{{"k": {(h * 7 + u) % 100}}}')
            for u in range(60) for h in range(12)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    landings = f"{shared_dir(spark).removeprefix('file:')}/forecasts-*"
    before = set(glob.glob(landings))
    got = sorted(tuple(map(plain, r)) for r in QUERIES["s4_landed_forecast"](spark, str(tmp_path)).collect())
    path, = set(glob.glob(landings)) - before
    assert 1 <= len([f for f in glob.glob(f"{path}/**", recursive=True) if os.path.isfile(f)]) <= 4 + 1
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(tuple(map(plain, r)) for r in con.execute(ORACLES["s4_landed_forecast"]).fetchall())
    assert len({r[0] for r in got}) == 60


def test_rows_at_positions(spark, monkeypatch):
    """Times with ties, some a microsecond apart; the driver gets at most 256 rows at once."""
    micro = F.timestamp_micros(F.floor(F.col("id") / 4) * F.when(F.col("id") < 200, 1).otherwise(3_600_000_007))
    rows = spark.range(500).select(micro.alias("ts"), F.concat(F.lit("p"), F.col("id") % 4).alias("p"))
    collect, seen = type(rows).collect, []

    def counted(self):
        got = collect(self)
        seen.append(len(got))
        return got

    monkeypatch.setattr(type(rows), "collect", counted)
    for position in (1, 4, 97, 98, 201, 500):
        end = splits.row_at(rows, position, "ts", ["p"])
        assert rows.filter(splits.up_to(end)).count() == position
    assert max(seen) <= 256
    assert splits.select_rank(rows, F.unix_micros("ts"), 7)[1] == 3


def test_a_long_block_has_few_entries(spark):
    year = spark.createDataFrame([("L", "2023-01-01 00:00:00", "2023-12-31 23:59:00"), ("L", "2024-03-01 00:00:00", "2024-03-01 00:00:00"), ("M", "2024-01-01 00:00:00", "2024-01-02 00:00:00")],
                                 "k string, start string, end string").select("k", F.col("start").cast("timestamp").alias("start"), F.col("end").cast("timestamp").alias("end"))
    assert quality.block_index(year, ["k"]).count() <= 2 * 3
    hours = spark.range(0, 24 * 500).select((F.timestamp_seconds(F.lit(1_672_444_800) + F.col("id") * 3600)).alias("ts")).withColumn("k", F.explode(F.array(F.lit("L"), F.lit("M"))))
    want = hours.join(year, "k").filter(F.col("ts").between(F.col("start"), F.col("end"))).select("k", "ts")
    kept = quality.drop_blocks(hours, year, ["k"])
    assert kept.columns == ["ts", "k"] and kept.count() == hours.count() - want.distinct().count()
    assert kept.join(want, ["k", "ts"], "left_semi").isEmpty()
    assert quality.drop_blocks(hours, year.limit(0), ["k"]).count() == hours.count()


def test_ranks_without_keys_see_segments_in_groups(spark, monkeypatch):
    from fogbank.operators import segments

    monkeypatch.setattr(segments, "SEGMENTS_PER_GROUP", 3)
    rows = spark.range(1000).select(F.timestamp_seconds(F.col("id") * 977 % 86_400).alias("ts"), "id")
    ranked = segments.ordered_rank(rows, [], ["ts", "id"], segments.time_segment("ts", 3_600_000_000), "r", "n")
    want = {i: r for r, (_, i) in enumerate(sorted((i * 977 % 86_400, i) for i in range(1000)), 1)}
    assert {x.id: x.r for x in ranked.collect()} == want and {x.n for x in ranked.select("n").distinct().collect()} == {1000}


def test_keyless_weights_shuffle_no_row(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(3,)] * 2, "code int")
    out = splits.class_weights(df, [])
    assert {(r.code, r.weight) for r in out.collect()} == {(0, 8 / 12), (3, 2.0)}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["m1_features", "w4_rolling_mean", "w8_suspicious_blocks", "p6_outside_blocks",
                                  "w10_temporal_split", "w10_pooled_split", "w9_interpolation", "a16_best_threshold", "p12_monthly_panel"])
def test_plan_shape(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "None"
    return repr(v) if isinstance(v, float) else str(v)


CHECKED = ["a2_recording_quality", "m1_features", "j2_exact_lags", "w4_rolling_mean", "w5_rolling_sum", "a5_exact_medians",
           "w7_block_ids", "w8_suspicious_blocks", "p6_outside_blocks", "w9_interpolation", "j4_forecast_choice",
           "w10_temporal_split", "w10_pooled_split", "w11_forward_folds", "a13_weighted_f1", "a16_best_threshold",
           "a17_best_weight", "a18_class_weights", "p9_pages", "a6_daily_summary", "s7_long_export", "s8_wide_export",
           "s1_csv_fields", "w2_year_carry", "m10_forecast_panel", "f4_enclosed_codes", "f2_free_datetimes", "f2_serial_datetimes",
           "f4_number_codes", "j7_two_sheets", "m1_training_rows"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
@pytest.mark.parametrize("name", CHECKED)
def test_against_oracle(spark, name):
    con = duckdb.connect()
    for t in ("nation", "orders", "events", "part", "customer"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    expected = con.execute(ORACLES[name])
    columns = [c[0] for c in expected.description]
    want = sorted(tuple(plain(v) for v in row) for row in expected.fetchall())
    got = sorted(tuple(plain(r[c]) for c in columns) for r in QUERIES[name](spark, DATA).collect())
    assert got == want


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
