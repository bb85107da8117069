"""Date and time functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def from_offset(seconds: str | Column, start: str) -> Column:
    """A timestamp without zone from an offset in seconds."""
    return F.timestamp_seconds(F.unix_timestamp(F.to_timestamp(F.lit(start))) + _col(seconds)).cast("timestamp_ntz")


def parts(x: str | Column) -> dict[str, Column]:
    """Calendar parts; Monday is day 0, weeks are ISO weeks."""
    c = _col(x)
    return {"minute": F.minute(c), "hour": F.hour(c), "day": F.day(c), "month": F.month(c), "year": F.year(c), "day_of_year": F.dayofyear(c), "week": F.weekofyear(c), "weekday": F.weekday(c)}


def running_month(x: str | Column, first_year: int) -> Column:
    return (F.year(_col(x)) - first_year) * 12 + F.month(_col(x))


def boundaries(x: str | Column) -> dict[str, Column]:
    """Whether a day starts or ends its month, quarter or year."""
    day = F.to_date(_col(x))
    after = F.date_add(day, 1)
    out = {}
    for unit in ("month", "quarter", "year"):
        out[f"{unit}_start"] = day == F.to_date(F.date_trunc(unit, day))
        out[f"{unit}_end"] = after == F.to_date(F.date_trunc(unit, after))
    return out


def day_fraction(a: str | Column, b: str | Column) -> Column:
    """a - b in days with a fraction."""
    micros = lambda x: F.unix_micros(_col(x).cast("timestamp"))
    return (micros(a) - micros(b)) / 86_400e6


def hour_band(x: str | Column) -> Column:
    """morning 5-11, afternoon 12-16, evening 17-20, else night."""
    h = F.hour(_col(x))
    return F.when(h.between(5, 11), "morning").when(h.between(12, 16), "afternoon").when(h.between(17, 20), "evening").otherwise("night")


def hhmm(x: str | Column) -> tuple[Column, Column]:
    """Hour and minute of a number like 1730."""
    return F.floor(_col(x) / 100).cast("int"), F.pmod(_col(x), F.lit(100)).cast("int")
