"""Dates and moments in free text, by a small grammar: forms are tried in turn, and one that names no real day falls
through to the next."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: forms of dates, names of months, the offset of a moment without one ----------------------------------
DATE_PATTERNS = (
    r"(20\d{2})[.\-/년\s]+(\d{1,2})[.\-/월\s]+(\d{1,2})",
    r"(\d{2})[.\-/](\d{1,2})[.\-/](\d{1,2})",
)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
OWN_OFFSET_HOURS = 9
# -------------------------------------------------------------------------------------------------------------------
_MONTH = "(" + "|".join(MONTHS) + r")[a-z]*\.?"
_DAY, _YEAR = r"(\d{1,2})(?:st|nd|rd|th)?", r"(\d{4}|'?\d{2})"
#: Looser forms and the groups of their year, month and day; (0, ...) takes the day as the run's.
FUZZY = (
    (rf"\b{_DAY}[\s,.\-]+(?:of\s+)?{_MONTH}[\s,.\-]+{_YEAR}\b", (3, 2, 1)),
    (rf"\b{_MONTH}[\s,.\-]+{_DAY}[\s,.\-]+{_YEAR}\b", (3, 1, 2)),
    (rf"\b(\d{{4}})[\s,.\-]+{_MONTH}[\s,.\-]+{_DAY}\b", (1, 2, 3)),
    (r"(?<!\d)(\d{4})(\d{2})(\d{2})(?!\d)", (1, 2, 3)),
    (r"(?<!\d)(\d{4})[.\-/](\d{1,2})[.\-/](\d{1,2})(?!\d)", (1, 2, 3)),
    (r"(?<!\d)(\d{1,2})[.\-/](\d{1,2})[.\-/](\d{4})(?!\d)", (3, 1, 2)),
    (r"(?<!\d)(\d{1,2})[.\-/](\d{1,2})[.\-/](\d{4})(?!\d)", (3, 2, 1)),
    (rf"\b{_MONTH}[\s,.\-]+(\d{{4}})\b", (2, 1, 0)),
)


def _group(text: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(text, f"(?iU){pattern}", i)


def _year(text: Column, today: Column) -> Column:
    """A year; one of two digits lies within fifty years of the run."""
    n = F.regexp_replace(text, "'", "").try_cast("int")
    near = n + F.floor(F.year(today) / 100).cast("int") * 100
    near = F.when(near >= F.year(today) + 50, near - 100).when(near < F.year(today) - 50, near + 100).otherwise(near)
    return F.when(F.length(F.regexp_replace(text, "'", "")) <= 2, near).otherwise(n)


def _month(text: Column) -> Column:
    named = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(text, 1, 3))).cast("int")
    return F.coalesce(text.try_cast("int"), F.nullif(named, F.lit(0)))


def _day(year: Column, month: Column, day: Column) -> Column:
    """The date, or null where there is no such day."""
    return F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), month.cast("string"), day.cast("string")), "yyyy-M-d")


def any_date(text: Column, today: Column) -> Column:
    """The date that a text names; the run's date if it names none."""
    text = F.coalesce(text, F.lit(""))
    found = []
    for pattern in DATE_PATTERNS:
        year = _group(text, pattern, 1).try_cast("int")
        found.append(_day(F.when(year < 100, year + 2000).otherwise(year), _group(text, pattern, 2).try_cast("int"), _group(text, pattern, 3).try_cast("int")))
    for pattern, (y, m, d) in FUZZY:
        day = _group(text, pattern, d).try_cast("int") if d else F.when(_group(text, pattern, 1) != "", F.day(today))
        found.append(_day(_year(_group(text, pattern, y), today), _month(_group(text, pattern, m)), day))
    return F.coalesce(*found, today)


_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d{1,6})?))?"
_ZONE = r"(Z|UTC|GMT|[+-]\d{2}:?\d{2}|[A-Z]{3,4})?"
_ISO = rf"\A\s*(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:[T\s]+{_CLOCK}\s*{_ZONE})?\s*\z"
_MAIL = rf"\A\s*(?:[a-z]{{3,9}},?\s+)?(\d{{1,2}})\s+{_MONTH}\s+(\d{{4}})(?:\s+{_CLOCK}\s*{_ZONE})?\s*\z"
_DOTTED = rf"\A\s*(\d{{4}})[./](\d{{1,2}})[./](\d{{1,2}})\.?(?:\s+{_CLOCK}\s*{_ZONE})?\s*\z"


def moment(value: Column) -> Column:
    """The moment that a value states: ISO, dotted or as in mail, midnight where it has no time, in our own zone where it
    has none or an unknown one. Null for anything else. It doesn't depend on the session's time zone."""

    def read(pattern: str, y: int, m: int, d: int) -> Column:
        g = lambda i: _group(value, pattern, i)
        day = _day(g(y).try_cast("int"), _month(g(m)), g(d).try_cast("int"))
        hour, minute, second = (F.coalesce(g(i).try_cast("double"), F.lit(0.0)) for i in (4, 5, 6))
        zone = F.upper(g(7))
        signed = F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1) * (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, -2, 2).try_cast("int"))
        minutes = F.when(zone.isin("Z", "UTC", "GMT"), 0).when(F.rlike(zone, F.lit(r"\A[+-]\d")), signed).otherwise(OWN_OFFSET_HOURS * 60)
        real = (hour < 24) & (minute < 60) & (second < 60)
        micros = F.unix_date(day).cast("long") * 86_400_000_000 + F.round((hour * 3600 + (minute - minutes) * 60 + second) * 1_000_000).cast("long")
        return F.when(real, F.timestamp_micros(micros))

    return F.coalesce(read(_ISO, 1, 2, 3), read(_DOTTED, 1, 2, 3), read(_MAIL, 3, 2, 1))
