"""Scalar functions: missing values, rounding, units, bands, labels. All are built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sentinels of the sources; null is the only missing value inside.
SENTINELS = (-99.0, -9999.0)


def missing_to_null(value: Column, *sentinels: float) -> Column:
    """Null for NaN and for the sentinels."""
    bad = F.isnan(value) | value.isin(*(sentinels or SENTINELS))
    return F.when(~bad, value)


def finite(value: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def round1(value: Column, mode: str) -> Column:
    """One decimal. np64: half even on doubles as printed; np32: in single precision; py: half even on the value that the
    double holds, as Python rounds (below 2^49); js: half up."""
    if mode == "np64":
        return F.bround(value, 1)
    if mode == "np32":
        return (F.rint(value.cast("float") * F.lit(10.0).cast("float")).cast("float") / F.lit(10.0).cast("float")).cast("float")
    if mode == "py":
        return _round_binary(value.cast("double"))
    if mode == "js":
        return F.floor(value * 10 + 0.5).cast("double") / 10
    raise ValueError(f"unknown rounding {mode!r}")


def _round_binary(value: Column) -> Column:
    """Ten times the value is the sum of its exact multiples by 8 and 2. Where that sum, rounded to a double, ends in one half,
    its rounding error (exact by the usual two-sum) tells on which side of the tie the value lies."""
    a, b = value * 8.0, value * 2.0
    total = a + b
    back = total - a
    error = (a - (total - back)) + (b - back)
    whole = F.rint(total)
    beyond = total - whole
    step = F.when((beyond == 0.5) & (error > 0), 1.0).when((beyond == -0.5) & (error < 0), -1.0)
    return F.when(step.isNull(), whole).otherwise(whole + step) / 10.0


def one_decimal_text(value: Column) -> Column:
    """Python's one decimal of a double; a negative value keeps its sign when it is rounded to zero."""
    return F.format_string("%.1f", round1(value, "py"))


def percentage(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 when there is nothing."""
    return F.coalesce(F.try_divide(F.lit(100.0) * part, whole), F.lit(0.0))


def steps(value: Column, bands: list[tuple[str, float, str]], otherwise: str) -> Column:
    """The label of the first band whose comparison holds: (operator, bound, label)."""
    tests = {"<=": Column.__le__, "<": Column.__lt__, ">=": Column.__ge__, ">": Column.__gt__}
    chain = None
    for op, bound, label in bands:
        test = tests[op](value, F.lit(bound))
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    return F.when(value.isNotNull(), chain.otherwise(otherwise))


# Bands of the classifications, in the order in which they are tested.
RAIN_CLASSES = ["no measurable rain", "light rain", "moderate rain", "heavy rain", "violent rain"]
RAIN_RATES = [("<=", 0.0, "no measurable rain"), ("<=", 2.5, "light rain"), ("<=", 7.6, "moderate rain"), ("<=", 50.0, "heavy rain")]
TEMPERATURE = [
    ("<=", 0.0, "freezing/icy"),
    ("<=", 10.0, "very cold"),
    ("<=", 15.0, "cold"),
    ("<=", 20.0, "cool"),
    ("<=", 25.0, "normal/warm"),
    ("<=", 35.0, "hot"),
    ("<=", 40.0, "very hot"),
    (">=", 50.0, "extreme heat"),
]
DEW_POINT = [("<=", 55.0, "dry and comfortable"), ("<", 65.0, "becoming sticky")]
WIND = [
    (">=", 58.0, "high wind warning-level threshold met"),
    (">=", 40.0, "high wind watch/warning threshold met"),
    (">=", 30.0, "wind advisory-level threshold met"),
    (">=", 20.0, "windy conditions"),
]
SOLAR = [("<", 2.6, "low"), ("<", 3.0, "moderate"), ("<=", 4.0, "high")]
HUMIDITY = [("<", 30.0, "dry"), ("<", 60.0, "moderate"), ("<", 80.0, "humid")]
PRECIPITATION = [("<", 1.0, "dry"), ("<", 5.0, "light"), ("<", 20.0, "moderate"), ("<", 50.0, "heavy")]
HOURS = {"daily": 24.0, "weekly": 168.0, "monthly": 730.5, "yearly": 8766.0}
UNIT_LABELS = {"daily": "day", "weekly": "week", "monthly": "month", "yearly": "year"}


def rain_class(value: Column, aggregation: str = "daily") -> Column:
    """Class of the mean rate in mm/h over the aggregation's bin."""
    return steps(value / HOURS.get(aggregation, 24.0), RAIN_RATES, "violent rain")


def temperature_band(celsius: Column) -> Column:
    return steps(celsius, TEMPERATURE, "very warm")


def dew_point_comfort(fahrenheit: Column) -> Column:
    return steps(fahrenheit, DEW_POINT, "oppressive moisture")


def wind_hazard(mph: Column) -> Column:
    return steps(mph, WIND, "below advisory thresholds")


def solar_band(kwh: Column) -> Column:
    return steps(kwh, SOLAR, "very high")


def humidity_state(percent: Column) -> Column:
    return steps(percent, HUMIDITY, "very humid")


def by_unit(value: Column, units: Column, factors: list[tuple[list[str], Column]]) -> Column:
    """The conversion of the first list of which the unit's text contains a member; else the value."""
    low = F.lower(units)
    chain = None
    for parts, converted in factors:
        test = reduce(lambda a, b: a | b, [low.contains(p) for p in parts])
        chain = F.when(test, converted) if chain is None else chain.when(test, converted)
    return chain.otherwise(value)


def to_mph(value: Column, units: Column) -> Column:
    return by_unit(value, units, [(["mph"], value), (["m/s", "mps"], value * 2.2369362921), (["km/h", "kph"], value * 0.621371), (["knot", "kt"], value * 1.150779)])


def to_celsius(value: Column, units: Column) -> Column:
    return by_unit(value, units, [(["f"], (value - 32) * 5 / 9)])


def to_fahrenheit(value: Column, units: Column) -> Column:
    return by_unit(value, units, [(["c"], value * 9 / 5 + 32)])


def to_kwh(value: Column, units: Column) -> Column:
    return by_unit(value, units, [(["kwh"], value), (["mj"], value / 3.6), (["wh"], value / 1000)])


def number_text(value: Column) -> Column:
    """Whole numbers as they are, others with one decimal."""
    return F.when(value == F.floor(value), F.format_string("%d", F.floor(value))).otherwise(F.format_string("%.1f", value))


def fixed_text(value: Column, digits: int = 3) -> Column:
    """Fixed digits, NA for null or non-finite."""
    return F.coalesce(F.format_string(f"%.{digits}f", finite(value)), F.lit("NA")) if digits >= 0 else value


def day_of_year(day: Column) -> Column:
    return F.date_format(day, "yyyyDDD")


def date_label(day: Column, aggregation: Column) -> Column:
    return F.when(aggregation == "yearly", F.date_format(day, "yyyy")).when(aggregation == "monthly", F.date_format(day, "MMM yyyy")).otherwise(F.date_format(day, "MMM d"))


def iso_day(text: Column) -> Column:
    """The day of an ISO text, with or without a time after T or a space."""
    return F.to_date(F.substring_index(F.translate(text, " ", "T"), "T", 1))
