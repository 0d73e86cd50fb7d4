"""Instants from text, as Column expressions. What can't be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names of date-time groups, fixed values
MONTHS = {
    "JAN": 1, "FEV": 2, "MAR": 3, "ABR": 4, "MAI": 5, "JUN": 6, "JUL": 7, "AGO": 8, "SET": 9, "OUT": 10, "NOV": 11, "DEZ": 12,
    "FEB": 2, "APR": 4, "MAY": 5, "AUG": 8, "SEP": 9, "OCT": 10, "DEC": 12,
}


def iso(text: Column, utc: bool = False) -> Column:
    """ISO 8601; with utc, the first 16 characters read as UTC."""
    if utc:
        return F.try_to_timestamp(F.concat(F.substring(text, 1, 16), F.lit("+00:00")), F.lit("yyyy-MM-dd'T'HH:mmXXX"))
    return text.try_cast("timestamp")


def day_first(text: Column, pattern: str = "dd/MM/yyyy HH:mm:ss", zone: str | None = None) -> Column:
    """Text in the given pattern, written in the given zone offset."""
    if zone:
        return F.try_to_timestamp(F.concat(text, F.lit(" " + zone)), F.lit(pattern + " XXX"))
    return F.try_to_timestamp(text, F.lit(pattern))


def date_time_group(text: Column, zone: str = "+00:00") -> Column:
    """The one military date-time group of a text, `250539 NOV 24`; null if there is none, or more than one, or it is out of range."""
    pattern = r"\b(\d{2})(\d{2})(\d{2})\s*(" + "|".join(MONTHS) + r")\s*(\d{2})\b"
    upper = F.upper(F.coalesce(text, F.lit("")))
    part = lambda g: F.get(F.regexp_extract_all(upper, F.lit(pattern), F.lit(g)), F.lit(0))
    months = F.create_map(*[F.lit(x) for k, v in MONTHS.items() for x in (k, f"{v:02d}")])
    written = F.concat(F.lit("20"), part(5), F.lit("-"), F.try_element_at(months, part(4)), F.lit("-"), part(1), F.lit("T"), part(2), F.lit(":"), part(3), F.lit(":00" + zone))
    single = F.size(F.regexp_extract_all(upper, F.lit(pattern), F.lit(0))) == 1
    return F.when(single, F.try_to_timestamp(written, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))


def local(instant: Column, zone: str) -> Column:
    """An instant's wall-clock time in an explicit zone, whatever the session's."""
    return F.from_utc_timestamp(F.to_utc_timestamp(instant, F.current_timezone()), zone)


def day_period(hour: Column, periods: list[tuple[int, str]]) -> Column:
    """The name of the first period whose end lies after the hour."""
    out = None
    for end, name in periods:
        out = F.when(hour < end, F.lit(name)) if out is None else out.when(hour < end, F.lit(name))
    return out
