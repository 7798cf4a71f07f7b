"""Feature expressions that need a single row: cycles, wind vector, sunrise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from fogbank import constants as K
from fogbank.functions.text import ColumnLike, col


def hour_cycle(t: ColumnLike) -> tuple[Column, Column]:
    angle = F.hour(col(t)) * (2 * math.pi) / 24
    return F.sin(angle), F.cos(angle)


def wind_vector(degrees: ColumnLike) -> tuple[Column, Column]:
    """Sine and cosine of the wind direction; calm is the origin."""
    angle = F.radians(col(degrees))
    zero = F.lit(0.0)
    return F.coalesce(F.sin(angle), zero), F.coalesce(F.cos(angle), zero)


def sunrise_hour(t: ColumnLike, lat: float = K.DEFAULT_LAT, lon: float = K.DEFAULT_LON) -> Column:
    """Approximate sunrise of the row's day, in hours after local midnight."""
    tilt = math.radians(23.44)
    declination = tilt * F.sin(F.radians(360.0 / 365.0 * (F.dayofyear(col(t)) - 81)))
    cosine = -math.tan(math.radians(lat)) * F.tan(declination)
    clamped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))
    noon = 12.0 - lon / 15.0 + K.ZONE_OFFSET_HOURS
    return noon - F.degrees(F.acos(clamped)) / 15.0


def hour_of_day(t: ColumnLike) -> Column:
    c = col(t).cast("timestamp")
    return (F.unix_micros(c) - F.unix_micros(F.date_trunc("day", c))) / 3.6e9


def hours_to_sunrise(t: ColumnLike, lat: float = K.DEFAULT_LAT, lon: float = K.DEFAULT_LON) -> Column:
    left = sunrise_hour(t, lat, lon) - hour_of_day(t)
    return F.when((left < 0) | (left > 12), 0.0).otherwise(left)
