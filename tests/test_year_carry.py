"""Year-less cells against a replay row by row, with several leap days in one undated run."""

import datetime as dt
import random

from pyspark.sql import functions as F

from fogbank.operators.cleaning import resolve_datetimes


def replay(cells):
    """The rule as it is told: the year of the row before, turned at New Year; a date that does not exist is no row before."""
    first = next((t for t in (stamp(c, None) for c in cells) if t), None)
    before, out = None, []
    for cell in cells:
        t = stamp(cell, None)
        if t is None and cell[0] is None and (before or first):
            _, m, d, _ = cell
            year = (before or first).year
            if before and (m, d) < (before.month, before.day) and before.month - m >= 6:
                year += 1
            t = stamp((year, *cell[1:]), None)
        out.append(t)
        before = t or before
    return out


def stamp(cell, _):
    y, m, d, h = cell
    try:
        return dt.datetime(y, m, d) + dt.timedelta(hours=h) if y else None
    except ValueError:
        return None


def text(cell):
    y, m, d, h = cell
    return (f"{y}年" if y else "") + f"{m}月{d}日{h}時"


def test_several_leap_days_by_replay(spark):
    rng = random.Random(7)
    series = {"two": [(2019, 1, 5, 1), (None, 2, 29, 1), (None, 9, 1, 1), (None, 2, 29, 2), (None, 2, 28, 3), (None, 10, 1, 1), (None, 2, 29, 4), (None, 12, 31, 24), (None, 2, 29, 5)],
              "none": [(2023, 12, 30, 1), (None, 12, 31, 24), (None, 1, 2, 3), (None, 8, 2, 3), (None, 1, 5, 0)]}
    for k in range(40):
        cells = [(2020 + rng.randrange(5), rng.randrange(1, 13), rng.randrange(1, 28), 3)] if rng.random() < .8 else []
        for _ in range(rng.randrange(3, 30)):
            m, d = rng.choice([(2, 29), (2, 28), (3, 1), (9, 10), (12, 31), (1, 1), (7, 4), (10, 2)])
            cells.append((rng.choice([None] * 9 + [2021]), m, d, rng.choice([0, 5, 24])))
        series[f"s{k}"] = cells
    rows = [(k, r, text(c)) for k, cells in series.items() for r, c in enumerate(cells)]
    df = spark.createDataFrame(rows, "k string, r long, cell string")
    for width in (4, 50_000):
        got = {(x.k, x.r): x.ts for x in resolve_datetimes(df, ["k"], "r", "cell", rows_per_segment=width).collect()}
        assert len(got) == len(rows)
        for k, cells in series.items():
            assert [got[k, r] for r in range(len(cells))] == replay(cells), (k, width)
    assert resolve_datetimes(df.filter("k = 'none'"), ["k"], "r", "cell").filter(F.col("ts").isNull()).isEmpty()
