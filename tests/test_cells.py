"""Cell functions: the literal cases every station file format test pins."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fogbank.functions import calendar, classes, dates, text
from fogbank.operators import cleaning


def column(spark, values, expr, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, cell {type_}")
    return [r.out for r in df.withColumn("out", expr).orderBy("i").collect()]


def test_phenomenon_codes(spark):
    cells = ["/", "／", None, "", "   ", "3", "10", "１０", "0", "99", "あ", "1 8", "8.2", "-1", "1 99",
             "3 99999999999", "①"]
    assert column(spark, cells, text.phenomenon_code("cell")) == [
        0, 0, None, None, None, 3, 10, 10, 0, None, None, 8, 8, 1, None, None, 1]


def test_numeric_phenomenon_codes(spark):
    assert column(spark, [3.0, 8.9, -0.5, 99.0, -1.0, None], text.phenomenon_code_number("cell"),
                  "double") == [3, 8, 0, None, None, None]


def test_wind_words(spark):
    cells = ["南", "北北西", "静穏", "90", "360", "400", "９０", "x", None]
    assert column(spark, cells, text.wind_degrees("cell")) == [
        180.0, 337.5, None, 90.0, 0.0, None, 90.0, None, None]


def test_plausible_codes(spark):
    good, bad = ["/", "2", "10", "1 8", "3、4", " 7 "], ["8.2", "15", "12.5", "晴", "-1", "//", "010"]
    assert column(spark, good, text.is_phenomenon_value("cell")) == [True] * len(good)
    assert column(spark, bad, text.is_phenomenon_value("cell")) == [False] * len(bad)
    assert column(spark, [0.0, 7.0, 10.0, 8.2, 15.0, -1.0], text.is_phenomenon_number("cell"),
                  "double") == [True, True, True, False, False, False]


def test_numbers(spark):
    assert column(spark, ["1.5", " 2 ", "abc", "", None, "nan", "1.5d"], text.number("cell")) == [
        1.5, 2.0, None, None, None, None, None]


def test_full_folding(spark):
    assert column(spark, ["ｶﾞ", "㌔"], text.cell_text("cell", full=True)) == ["ガ", "キロ"]


def test_sheet_letters(spark):
    assert column(spark, [0, 25, 26, 28, 59, 701, 702], text.sheet_letter("cell"), "int") == [
        "A", "Z", "AA", "AC", "BH", "ZZ", "AAA"]


def test_datetimes(spark):
    cells = ["2024年6月28日1時", "2024年9月25日24時", "2024/9/25 24:00", "2024/6/28 1:00",
             "2024-06-28 01:00:00", "2024年2月30日1時", "合計", None, "2024.6.28", "2024年6月28日1時30分",
             "2024-06-28T01:00:00.5", "20240628", "2024/13/1", "12:30"]
    d = dt.datetime
    assert column(spark, cells, dates.parse_datetime("cell")) == [
        d(2024, 6, 28, 1), d(2024, 9, 26), d(2024, 9, 26), d(2024, 6, 28, 1), d(2024, 6, 28, 1),
        None, None, None, d(2024, 6, 28), d(2024, 6, 28, 1, 30), d(2024, 6, 28, 1, 0, 0, 500000),
        d(2024, 6, 28), None, None]


def test_serial_dates(spark):
    assert column(spark, [45471.0, 45471.5, 10.0], dates.parse_serial("cell"), "double") == [
        dt.datetime(2024, 6, 28), dt.datetime(2024, 6, 28, 12), None]


def resolve_one_by_one(cells):
    """The carry rule as plain recursion, for (year, month, day, hour) tuples."""
    def make(year, month, day, hour):
        try:
            return dt.datetime(year, month, day) + dt.timedelta(hours=hour)
        except ValueError:
            return None

    first = next((t.year for t in (make(*c) if c and c[0] else None for c in cells) if t), None)
    prev, out = None, []
    for c in cells:
        t = None
        if c:
            year, month, day, hour = c
            if year is None and prev is not None:
                year = prev.year + (1 if (month, day) < (prev.month, prev.day)
                                    and prev.month - month >= 6 else 0)
            elif year is None:
                year = first
            t = make(year, month, day, hour) if year else None
        prev = t or prev
        out.append(t)
    return out


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_year_carry(spark, width):
    import random
    rng = random.Random(5)
    rows, expected = [], []
    for f in range(60):
        cells = []
        start = dt.datetime(rng.choice([2022, 2023, 2024]), rng.randint(1, 12), rng.randint(1, 28))
        for i in range(25):
            start += dt.timedelta(days=rng.choice([0, 1, 1, 30, 60]), hours=rng.choice([1, 5]))
            kind = rng.random()
            day, hour = (start, start.hour) if start.hour else (start - dt.timedelta(days=1), 24)
            year = day.year if kind < 0.2 else None
            cells.append(None if kind > 0.95 else (year, day.month, day.day, hour))
        expected += resolve_one_by_one(cells)
        rows += [(f, i, None if c is None else
                  (f"{c[0]}年" if c[0] else "") + f"{c[1]}月{c[2]}日{c[3]}時")
                 for i, c in enumerate(cells)]
    df = spark.createDataFrame(rows, "file int, r int, cell string")
    out = cleaning.resolve_datetimes(df, ["file"], "r", "cell", rows_per_segment=width)
    assert [x.ts for x in out.orderBy("file", "r").collect()] == expected


def test_year_carry_literal_cases(spark):
    d = dt.datetime

    def run(cells):
        df = spark.createDataFrame([(0, i, c) for i, c in enumerate(cells)], "file int, r int, cell string")
        return [x.ts for x in cleaning.resolve_datetimes(df, ["file"], "r", "cell").orderBy("r").collect()]

    assert run(["2024年12月31日23時", "1月1日1時", "1月1日2時"]) == [
        d(2024, 12, 31, 23), d(2025, 1, 1, 1), d(2025, 1, 1, 2)]
    assert run(["6月28日1時", "2024年6月28日2時"])[0] == d(2024, 6, 28, 1)
    assert run(["12月31日24時", "1月1日1時", "2023年5月1日1時"]) == [
        d(2024, 1, 1), d(2024, 1, 1, 1), d(2023, 5, 1, 1)]
    assert run(["2023年2月28日1時", "2月29日1時", "3月1日1時"]) == [
        d(2023, 2, 28, 1), None, d(2023, 3, 1, 1)]
    assert run(["2024年2月28日1時", "2月29日1時", "3月1日1時"])[1] == d(2024, 2, 29, 1)
    assert run(["1月1日1時"]) == [None]


def test_unparsed_rows_are_reported(spark):
    cells = ["2024年6月28日1時", "合計", None, "", "平均", "合計"]
    df = spark.createDataFrame([("f", i, c) for i, c in enumerate(cells)], "file string, r int, cell string")
    df = df.withColumn("ts", dates.parse_datetime("cell"))
    r = cleaning.unparsed_report(df, ["file"], "r", "cell", "ts").first()
    assert (r.n_dropped, r.n_with_text, r.samples) == (5, 3, ["合計", "平均"])


def test_wind_vector_and_sunrise(spark):
    df = spark.createDataFrame([(0.0, dt.datetime(2026, 5, 1, 12)), (None, dt.datetime(2026, 5, 1, 3))],
                               "deg double, ts timestamp")
    sin, cos = calendar.wind_vector("deg")
    rows = df.select(sin.alias("s"), cos.alias("c"), calendar.hours_to_sunrise("ts").alias("h")).collect()
    assert (rows[0].s, rows[0].c, rows[0].h) == (0.0, 1.0, 0.0)
    assert (rows[1].s, rows[1].c) == (0.0, 0.0) and 0 < rows[1].h < 3


def test_blend_arithmetic(spark):
    def slots(pairs):
        return F.array(*[F.lit(float(pairs.get(i, 0.0))) for i in range(11)])

    df = spark.range(1).select(slots({0: .8, 2: .2}).alias("rf"), slots({0: .2, 2: .8}).alias("gb"),
                               slots({0: .5, 1: .3, 2: .2}).alias("a"), slots({0: .4, 2: .6}).alias("b"))
    r = df.select(classes.blend("rf", "gb", 0.5).alias("half"), classes.blend("rf", "gb", 0.75).alias("heavy"),
                  classes.blend("a", "b", 0.5).alias("aligned"),
                  classes.best_code(classes.blend("rf", "gb", 0.0)).alias("gb_code"),
                  classes.best_code(classes.blend("rf", "gb", 1.0)).alias("rf_code"),
                  classes.fog_probability(classes.blend("rf", "gb", 0.5)).alias("fog")).first()
    assert r.half[0] == pytest.approx(.5) and r.heavy[0] == pytest.approx(.65)
    assert r.aligned[:3] == pytest.approx([.45, .15, .40])
    assert (r.gb_code, r.rf_code) == (2, 0) and r.fog == pytest.approx(.5)


def test_names_and_verdicts(spark):
    assert column(spark, [0, 2, 11], classes.code_name("cell"), "int") == ["現象なし", "川霧", "コード11"]
    assert column(spark, [.5, .49, None], classes.verdict("cell", F.lit(.5)), "double") == ["霧", "-", "-"]
    assert column(spark, [.0025, .1234], classes.percent("cell"), "double") == [0.2, 12.3]
