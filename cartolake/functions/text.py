"""Column functions that the operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def blank_to_null(column: Column) -> Column:
    trimmed = F.trim(column)
    return F.when(trimmed != "", trimmed)


def first_truthy(*columns: Column) -> Column:
    """The first column that is neither null nor blank."""
    return F.coalesce(*(blank_to_null(c) for c in columns))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row, however often use mentions it: a plain expression is computed at each mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def extract(column: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, or null."""
    return F.nullif(F.regexp_extract(column, pattern, group), F.lit(""))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), F.lit(2.0))
    a = F.greatest(F.lit(0.0), F.least(F.lit(1.0), a))
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))
