"""Station files end to end: encodings, quoting, layout, loading."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from fogbank.operators import layout, panels
from fogbank.plans.load import load_rows, load_station_files
from fogbank.sources import exports, grid
from fogbank.sources.coordinates import read_coordinates

LINE = ["年月日時", "相対湿度(％)", "品質情報", "露点温度(℃)", "気温(℃)", "風向", "風速(m/s)", "備考", "降水量(mm)", None, None, None]


def valley():
    """36 hours of November, dated with the hours 1 to 24; titles and place names stand above the header line."""
    rows = [["谷の記録"], ["2023年度"], [None] * 9 + ["北谷", "南谷", "東谷"], LINE]
    for hour in range(36):
        rows.append([f"2023年11月{5 + hour // 24}日{hour % 24 + 1}時", str(70 + hour % 20), "5", "6.5", str(12.5 - hour / 4), "東", "0.8",
                     None, None if hour % 6 else "0.5", "4" if hour % 9 == 0 else "/", None, "7"])
    return rows


def plain_sheet(*extra):
    """120 hours of March below a header with a line of remarks; ``extra`` are (header, value of the hour) pairs."""
    rows = [["年月日時", "風速(m/s)", None, "気温(℃)", "湿度(%)", "露点(℃)", "雨と降水(mm)", "沢口", *[h for h, _ in extra]],
            [None, None, "風向", None, None, None, "均質番号"]]
    for hour in range(120):
        t = dt.datetime(2025, 3, 9) + dt.timedelta(hours=hour)
        rows.append([t.strftime("%Y/%m/%d %H:%M"), "2.4", "西北西", "3.0", "64", "-1.5", "0", "5" if hour % 4 == 1 else "／",
                     *[v(hour) for _, v in extra]])
    return rows


def as_rows(spark, tables):
    data = [(name, r, fields) for name, rows in tables.items() for r, fields in enumerate(rows)]
    return spark.createDataFrame(data, "file string, r int, fields array<string>")


@pytest.fixture(scope="module")
def found(spark):
    return load_rows(as_rows(spark, {"v": valley(), "w": plain_sheet(
        ("水位", lambda h: "2"), ("堰", lambda h: f"{3 + h / 10:.1f}5"), ("岸", lambda h: None))}))


def test_measure_columns(found):
    files = {r.file: r for r in found.layout.files.collect()}
    v, w = files["v"], files["w"]
    assert (v.header_row, v.dt_col, v.data_start, v.source) == (3, 0, 4, "auto")
    assert (v.c_rh, v.c_dew, v.c_temp, v.c_wind_deg, v.c_wind, v.c_rain) == (1, 3, 4, 5, 6, 8)
    # The remark in the second line makes the rain column metadata; the wind direction is named there only.
    assert (w.header_row, w.data_start, w.c_wind, w.c_wind_deg, w.c_temp, w.c_rh, w.c_dew, w.c_rain) == (0, 2, 1, 2, 3, 4, 5, None)


def test_location_columns(found):
    rows = found.locations.orderBy("file", "ordinal").collect()
    assert [(r.location_id, r.letter, r.name) for r in rows if r.file == "v"] == [
        ("v!J", "J", "北谷"), ("v!K", "K", "南谷"), ("v!L", "L", "東谷")]
    assert [r.name for r in rows if r.file == "w"] == ["沢口", "岸"]


def test_turned_away_columns(found):
    rows = {r.header: r.reason for r in found.layout.excluded.filter("file = 'w'").collect()}
    assert rows["水位"] == "header-not-a-location"
    assert rows["堰"] == "values-not-codes: 3.05, 3.15, 3.25, 3.35, 3.45"
    assert found.layout.excluded.filter("file = 'v'").isEmpty()


def test_loaded_tables(found):
    obs = found.obs.filter("file = 'v'").orderBy("ts").collect()
    assert len(obs) == 36 and obs[0].ts == dt.datetime(2023, 11, 5, 1) and obs[23].ts == dt.datetime(2023, 11, 6)
    assert (obs[2].temp, obs[0].rain, obs[1].rain, obs[0].wind_deg, obs[0].pressure) == (12.0, 0.5, None, 90.0, None)
    codes = {r.location_id: (r.n, r.codes) for r in found.labels.groupBy("location_id").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_set("code")).alias("codes")).collect()}
    assert codes == {"v!J": (36, [0, 4]), "v!K": (36, []), "v!L": (36, [7]), "w!H": (120, [0, 5]), "w!K": (120, [])}


def test_the_same_letter_in_two_files_is_two_locations(spark):
    loaded = load_rows(as_rows(spark, {"n": valley(), "m": valley()}))
    ids = [r.location_id for r in loaded.locations.filter("letter = 'J'").collect()]
    assert sorted(ids) == ["m!J", "n!J"]
    named = panels.named_predictions(loaded.labels.select("location_id", "ts", "code", F.lit(0.2).alias("fog_prob")),
                                     loaded.locations, loaded.locations.select("location_id", F.lit(0.4).alias("threshold")))
    assert named.count() == loaded.labels.count() == 2 * 3 * 36


def test_left_out_years(spark):
    bare = valley()
    for row in bare[5:]:
        row[0] = row[0].removeprefix("2023年")
    obs = load_rows(as_rows(spark, {"bare": bare, "full": valley()})).obs
    ends = obs.groupBy("file").agg(F.min("ts").alias("a"), F.max("ts").alias("z"), F.count("*").alias("n")).collect()
    assert {(r.file, r.a, r.z, r.n) for r in ends} == {
        (f, dt.datetime(2023, 11, 5, 1), dt.datetime(2023, 11, 6, 12), 36) for f in ("bare", "full")}


def test_fixed_layout(spark):
    found = layout.detect(as_rows(spark, {"v": valley()}), "fixed")
    f = found.files.first()
    assert (f.source, f.c_temp, f.c_rain, f.c_wind, f.data_start) == ("fixed", 1, 4, 7, 4)
    assert found.locations.count() == 0
    with pytest.raises(ValueError):
        layout.detect(as_rows(spark, {"v": valley()}), "guess")


def csv_text(rows):
    def cell(v):
        v = v or ""
        return '"' + v.replace('"', '""') + '"' if any(x in v for x in ',"\n') else v
    return "\n".join(",".join(cell(v) for v in row) for row in rows) + "\n"


def test_csv_in_three_encodings(spark, tmp_path):
    width = len(LINE)
    rows = [row + [None] * (width - len(row)) for row in valley()]
    rows[2][9] = '北\n"奥"谷'
    text = csv_text(rows) + "\n  \n"
    for name, encoding in (("甲 x_1", "utf-8"), ("b", "utf-8-sig"), ("c", "cp932")):
        (tmp_path / f"{name}.csv").write_bytes(text.encode(encoding))
    (tmp_path / "note.txt").write_text("not a station file")
    read = grid.read_rows(spark, str(tmp_path)).orderBy("r").collect()
    for name in ("b", "c"):
        fields = [r.fields for r in read if r.file.endswith(f"/{name}.csv")]
        assert fields == rows
    loaded = load_station_files(spark, str(tmp_path))
    assert loaded.obs.count() == 3 * 36 and loaded.labels.count() == 3 * 3 * 36
    assert [r.name for r in loaded.locations.filter("letter = 'J'").select("name").distinct().collect()] == ['北"奥"谷']
    prefix = loaded.layout.files.select(grid.output_prefix("file").alias("p")).collect()
    assert "b" in {r.p for r in prefix}


def test_small_splits_read_the_same_rows(spark, tmp_path):
    rows = [[str(i), f'line\nbreak "{i}"', None, "x" * (i % 50)] for i in range(2000)]
    path = tmp_path / "big.csv"
    path.write_text(csv_text(rows), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        read = grid.read_rows(spark, str(path)).orderBy("r").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.r for r in read] == list(range(2000))
    assert [[f or None for f in r.fields] for r in read] == [[f or None for f in row] for row in rows]


def test_bad_inputs(spark, tmp_path):
    with pytest.raises(ValueError):
        grid.read_rows(spark, "book.xlsx")
    (tmp_path / "x.csv").write_text(csv_text([["年月日時", "気温(℃)", "A橋"], ["合計", "1", "/"]]), encoding="utf-8")
    with pytest.raises(ValueError, match="no row with a valid datetime"):
        load_station_files(spark, str(tmp_path / "x.csv"))


def test_coordinates(spark, tmp_path):
    p = tmp_path / "coords.csv"
    p.write_text("地点名,緯度,経度\n北谷,0,0\n 北谷 ,36.8,138.7\n東谷,36.9,138.6\n無,,138\n文,n,138\n", encoding="utf-8")
    rows = {r.name: (r.lat, r.lon) for r in read_coordinates(spark, str(p)).collect()}
    assert rows == {"北谷": (36.8, 138.7), "東谷": (36.9, 138.6)}
    q = tmp_path / "xy.csv"
    q.write_text("x,y\n1,2\n")
    with pytest.raises(ValueError):
        read_coordinates(spark, str(q))


def test_export_starts_with_a_byte_order_mark(spark, tmp_path):
    exports.write_csv(spark.range(3).select(F.col("id").alias("日時")).coalesce(1), str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("part-*"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbf" + "日時".encode())


def test_a_column_that_turns_bad_late_is_rejected(spark):
    """All values of a column decide, not the first thousands."""
    from fogbank.operators.layout import check_columns

    rows = spark.range(8000).select(
        F.lit("f").alias("file"), F.col("id").cast("int").alias("r"),
        F.array(F.lit("2"), F.when(F.col("id") < 4000, "1").otherwise(F.concat(F.lit("8."), (F.col("id") % 7).cast("string")))).alias("fields"))
    columns = spark.createDataFrame([("f", 0, "auto", 0), ("f", 1, "auto", 0)], "file string, c int, mode string, start int")
    got = {r["c"]: r for r in check_columns(rows, columns).collect()}
    assert got[0]["ok"] and (got[0]["n_values"], got[0]["n_bad"]) == (8000, 0)
    assert not got[1]["ok"] and got[1]["n_bad"] == 4000 and got[1]["samples"] == ["8.3", "8.4", "8.5", "8.6", "8.0"]


def test_published_months_are_pruned_and_sorted(spark, tmp_path):
    days = spark.range(0, 400).select(F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id as int))").alias("ts"), "id").orderBy(F.rand(3))
    path = str(tmp_path / "months")
    panels.write_months(days, path)
    some = panels.read_months(spark, path, ["2024-02", "2025-01"])
    assert some.count() == 29 + 31 and {r.ym for r in some.select("ym").distinct().collect()} == {"2024-02", "2025-01"}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "ym" in plan.split("PartitionFilters: [")[1].split("]")[0]
    for part in (tmp_path / "months").glob("ym=2024-03/*.parquet"):
        times = [r.ts for r in spark.read.parquet(str(part)).collect()]
        assert times == sorted(times)


def test_headers_of_a_wide_sheet_in_time(spark):
    # Header row and first data row were worked out again for every column, row and row below.
    wide = 400
    head = [("w", 0, ["年月日時", *[f"気温{i}(℃)" for i in range(1, wide)]]), ("w", 1, [None, *["品質"] * (wide - 1)])]
    data = [("w", 2 + i, [f"2023/11/5 {i}:00", *["1"] * (wide - 1)]) for i in range(13)]
    rows = spark.createDataFrame(head + data, "file string, r int, fields array<string>").repartition(1)
    began = time.monotonic()
    headers = layout.with_headers(layout.with_shapes(layout.head_table(rows)))
    found = headers.select("file", F.inline("columns")).collect()
    assert time.monotonic() - began < 15
    assert {r.c: r.texts for r in found} == {0: ["年月日時"], **{i: [f"気温{i}(°C)", "品質"] for i in range(1, wide)}}
