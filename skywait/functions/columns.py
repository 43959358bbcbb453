"""Column-returning functions that the operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000.0
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def computed_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: as a lambda's variable it is not planned into every place that reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def days_between(a: Column, b: Column) -> Column:
    """Days from a to b, with their fraction, exact to the microsecond."""
    return F.timestamp_diff("MICROSECOND", a, b) / F.lit(DAY_MICROS)


def safe_ratio(n: Column, d: Column) -> Column:
    """n / d; 0.0 where d is 0 or either is null."""
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))


def at_most(value: Column, limit) -> Column:
    """value <= limit; null and NaN are not."""
    return F.coalesce(value <= limit, F.lit(False))


def is_usable(covered: Column, clear: Column, min_coverage, min_clear) -> Column:
    return F.coalesce((covered >= min_coverage) & (clear >= min_clear), F.lit(False))


def status(complete: Column, usable: Column) -> Column:
    """incomplete wins over usable and unusable."""
    return F.when(~complete, "incomplete").when(usable, "usable").otherwise("unusable")


def month_name(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTHS]), month.cast("int"))


def utm_epsg(lat: Column, lon: Column) -> Column:
    """EPSG code of the UTM zone; null outside of its domain (80 S .. 84 N)."""
    zone = F.least(F.lit(60), F.floor((lon + 180) / 6) + 1)
    code = zone + F.when(lat >= 0, 32600).otherwise(32700)
    return F.when(lat.between(-80, 84) & lon.between(-180, 180), code).cast("long")


def relative_orbit(text: Column) -> Column:
    """The number in _Rnnn_; null without one."""
    return F.nullif(F.regexp_extract(text, r"_R(\d{3})_", 1), F.lit("")).cast("long")


def strip_prefix(text: Column, prefix: str) -> Column:
    return F.when(text.startswith(prefix), F.substring(text, F.lit(len(prefix) + 1), F.length(text))).otherwise(text)


def title_label(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("-"), F.lit(" ")))


def percent(value: Column) -> Column:
    return F.format_string("%.1f%%", 100 * value)


def first_by(value: Column, *order: Column) -> Column:
    """The first non-null value in an order (an aggregate)."""
    return F.min_by(value, F.when(value.isNotNull(), F.struct(*order)))
