"""Datetime cells and date formats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from fogbank import constants as K
from fogbank.functions.text import ColumnLike, cell_text, col

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US

# Fixed format of the station clocks, which results depend on: year (may be left out), month, day, then optionally
# hour and minute; a trailing :seconds is read and dropped.
_DATE = r"(?:(\d{4})\s*[年/.-]\s*)?(\d{1,2})\s*[月/.-]\s*(\d{1,2})\s*日?"
_TIME = r"(?:[\sT]*(\d{1,2})\s*[時:]\s*(\d{1,2})?\s*分?(?::\d{1,2})?)?"
_MARK = "\x01"
_CLOCK = r"( \d{1,2}:\d{2}(:\d{2})?)?$"
# Other forms that are read, each with the pattern that the whole text must match.
_FREE_FORMS = (
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{8}" + _CLOCK, "yyyyMMdd H:mm[:ss]"),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}(:\d{2})? [APap][Mm]$", "yyyy/M/d h:mm[:ss] a"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}(:\d{2})? [APap][Mm]$", "yyyy-M-d h:mm[:ss] a"),
    (r"^[A-Za-z]{3,9} \d{1,2} \d{4}" + _CLOCK, "MMM d yyyy[ H:mm[:ss]]"),
    (r"^\d{1,2} [A-Za-z]{3,9} \d{4}" + _CLOCK, "d MMM yyyy[ H:mm[:ss]]"))
# Texts outside that shape are accepted when they are ISO-like.
_ISO_DATE = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}(:\d{2}){1,2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def micros(t: ColumnLike) -> Column:
    """Microseconds since the epoch; the driver tables carry zone-less timestamps."""
    return F.unix_micros(col(t).cast("timestamp"))


def _split_date(text: Column) -> Column:
    marked = F.regexp_replace(text, f"^{_DATE}{_TIME}$", _MARK.join(["", "$1", "$2", "$3", "$4", "$5"]))
    return F.split(marked, _MARK)


def _parts(field: Column) -> Column:
    def part(i: int) -> Column:
        # Digits or empty; an empty text would make the cast build an error per row.
        return F.nullif(F.get(field, F.lit(i)), F.lit("")).cast("int")

    return F.when(
        F.size(field) == 6,
        F.struct(part(1).alias("y"), part(2).alias("mo"), part(3).alias("d"),
                 F.coalesce(part(4), F.lit(0)).alias("h"),
                 F.coalesce(part(5), F.lit(0)).alias("mi")))


def datetime_parts(cell: ColumnLike) -> Column:
    """Struct of year (null when the cell leaves it out), month, day, hour, minute.

    Null unless the text has the station date shape. The pattern runs once per cell: it
    rewrites the text into marked fields which are then split.
    """
    return let(_split_date(cell_text(cell)), _parts)


def in_range(p: Column) -> Column:
    return (p["mo"].between(1, 12) & p["d"].between(1, 31)
            & p["h"].between(0, 24) & p["mi"].between(0, 59))


def from_parts(p: Column, year: Column) -> Column:
    """Timestamp of parsed parts in a given year; hour 24 is the next day's midnight."""
    midnight = F.try_make_timestamp(year, p["mo"], p["d"], F.lit(0), F.lit(0), F.lit(0))
    return F.when(in_range(p), F.timestamp_micros(
        F.unix_micros(midnight) + (p["h"] * 60 + p["mi"]) * F.lit(60_000_000).cast("bigint")))


def _free(text: Column) -> Column:
    # Commas and hyphens beside a month name, and all but its first three letters, are no part of the form.
    named = F.regexp_replace(F.regexp_replace(text, r"(?<=[A-Za-z0-9]), *| *-(?=[A-Za-z])|(?<=[A-Za-z])-", " "),
                             r"\b([A-Za-z]{3})[A-Za-z]+\b", "$1")
    plain = F.when(text.rlike(r"[A-Za-z]{3}"), F.initcap(named)).otherwise(F.upper(text))
    found = F.when(text.rlike(_ISO_DATE), text.try_cast("timestamp"))
    for shape, form in _FREE_FORMS:
        found = found.when(plain.rlike(shape), F.try_to_timestamp(plain, F.lit(form)))
    return found


def free_datetime(cell: ColumnLike) -> Column:
    """Datetimes that do not have the station date shape: ISO text, yyyymmdd, 12-hour clocks and month names."""
    return let(cell_text(cell), _free)


def parse_datetime(cell: ColumnLike, fallback_year: Column | None = None) -> Column:
    """Datetime of one text cell on its own; a year-less cell needs ``fallback_year``."""
    def year(p: Column) -> Column:
        return p["y"] if fallback_year is None else F.coalesce(p["y"], fallback_year.cast("int"))

    return let(cell_text(cell), lambda text: let(let(_split_date(text), _parts), lambda p: F.when(
        p.isNotNull(), from_parts(p, year(p))).otherwise(_free(text))))


def parse_serial(value: ColumnLike) -> Column:
    """Datetime of a numeric spreadsheet cell counted in days."""
    v = col(value).cast("double")
    days = F.when(v.between(K.SERIAL_MIN, K.SERIAL_MAX), v)
    epoch = F.unix_micros(F.lit(K.SERIAL_EPOCH).cast("timestamp"))
    return F.timestamp_micros(epoch + F.round(days * DAY_US).cast("bigint"))


def month_key(t: ColumnLike) -> Column:
    return F.date_format(col(t), "yyyy-MM")


def minute_text(t: ColumnLike) -> Column:
    return F.date_format(col(t), "yyyy/MM/dd HH:mm")


def day_stamp(t: ColumnLike) -> Column:
    return F.date_format(col(t), "yyyyMMdd")
