"""Dates as written in study documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from studylake.functions.fixed import MONTHS
from studylake.functions.text import strip


def _month(name: Column) -> Column:
    """Month number of an English month name or its three-letter form, any case."""
    short = [m[:3].lower() for m in MONTHS.split("|")]
    low = F.lower(name)
    full = [m.lower() for m in MONTHS.split("|")]
    at = F.array_position(F.array(*[F.lit(m) for m in full]), low)
    return F.when(at > 0, at).otherwise(F.nullif(F.array_position(F.array(*[F.lit(m) for m in short]), low), F.lit(0)))


def _date(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0"))
    return F.when(month.isNotNull(), F.try_to_date(text, "yyyy-MM-dd"))


def parse_date_any(text: Column) -> Column:
    """``1-Jan-2026``, ``1 January 2026``, ``2026-01-01``, ``Jan-2026`` or ``January 2026`` (the
    first of the month); null for anything else, impossible days included."""
    s = strip(text)
    day_first, iso, month_first = r"^(\d{1,2})([- ])([A-Za-z]+)\2(\d{4})$", r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^([A-Za-z]+)[- ](\d{4})$"
    part = lambda p, i: F.regexp_extract(s, p, i)
    return (
        F.when(s.rlike(day_first), _date(part(day_first, 4), _month(part(day_first, 3)), part(day_first, 1)))
        .when(s.rlike(iso), _date(part(iso, 1), part(iso, 2).cast("int"), part(iso, 3)))
        .when(s.rlike(month_first), _date(part(month_first, 2), _month(part(month_first, 1)), F.lit("1")))
    )


def normalize_written_date(text: Column) -> Column:
    """The first date in a text as ``D-Mon-YYYY`` or ``Mon-YYYY``."""
    full = rf"(?i)(\d{{1,2}})\s*[- ]\s*({MONTHS})\s*[- ]\s*(\d{{4}})"
    short = rf"(?i)({MONTHS})\s*[- ]\s*(\d{{4}})"
    get = lambda p, i: F.regexp_extract(text, p, i)
    return F.when(text.rlike(full), F.concat_ws("-", get(full, 1), F.substring(get(full, 2), 1, 3), get(full, 3))).when(
        text.rlike(short), F.concat_ws("-", F.substring(get(short, 1), 1, 3), get(short, 2))
    )


def months_exact(start: Column, end: Column) -> Column:
    """Months of mean length, to one decimal, halves to even."""
    return F.bround(F.datediff(end, start) / F.lit(30.4375), 1)


def months_calendar(start: Column, end: Column) -> Column:
    """Calendar months, both ends counted, and one more for closing the database."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start) + 2


def add_business_days(start: Column, n: int) -> Column:
    """The ``n``-th day after ``start`` that is no Saturday or Sunday, in closed form."""
    weeks, rest = divmod(n, 5)
    monday0 = F.weekday(start)
    # From a weekend, counting starts as if from the Friday before it.
    back = F.greatest(monday0 - 4, F.lit(0))
    base = F.least(monday0, F.lit(4))
    over = F.when(base + rest > 4, 2).otherwise(0)
    if n <= 0:
        return start
    return F.date_add(start, (F.lit(weeks * 7 + rest) + over - back).cast("int"))


def long_date(day: Column) -> Column:
    """``1-January-2026``."""
    return F.date_format(day, "d-MMMM-yyyy")
