"""Freshness of an advert.  ``now`` is always a parameter, so results repeat."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# An advert is stale after a day and a half, or when its text
# names one of these units, or two and more days.
MAX_AGE_HOURS = 36
STALE_UNITS = r"(?U)\b(week|month|year|semana|mês|mes|ano)s?\b"
STALE_DAYS = r"(?U)\b(?:[2-9]|[1-9]\d+)\s+(day|dia)s?\b"

# The shape nearly all adverts use; a cast reads it, dropping the offset.
_USUAL = (r"^\d{4}-\d{2}-\d{2}"
          r"(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:[+-](?:[01]\d|2[0-3]):[0-5]\d)?)?$")

# ISO 8601 in full: calendar date (basic or extended) or week date, then perhaps any
# one character, a time, and an offset.
_DAY = r"(?:\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-W\d{2}(?:-\d)?|\d{4}W\d{2}\d?)"
_CLOCK = r"(?:\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?)?|\d{4}(?:\d{2}(?:[.,]\d+)?)?)"
_OFFSET = r"(?:[+-](?:[01]\d|2[0-3])(?::[0-5]\d(?::[0-5]\d(?:[.,]\d+)?)?|[0-5]\d(?:[0-5]\d(?:[.,]\d+)?)?)?)"
_ISO = rf"(?s)^({_DAY})(?:.({_CLOCK})({_OFFSET})?)?$"


def now_column(now: datetime | str | Column) -> Column:
    return now if isinstance(now, Column) else F.lit(str(now)).cast("timestamp_ntz")


def _calendar_day(day: Column) -> Column:
    digits = F.replace(day, F.lit("-"), F.lit(""))
    plain = F.concat(F.substring(digits, 1, 4), F.lit("-"), F.substring(digits, 5, 2),
                     F.lit("-"), F.substring(digits, 7, 2)).try_cast("date")
    year = F.substring(digits, 1, 4).try_cast("int")
    week = F.substring(digits, 6, 2).try_cast("int")
    weekday = F.when(F.length(digits) > 7, F.substring(digits, 8, 1).try_cast("int")).otherwise(1)
    monday = F.date_trunc("week", F.concat(year.cast("string"), F.lit("-01-04")).try_cast("date")).cast("date")
    in_week = F.date_add(monday, (week - 1) * 7 + weekday - 1)
    valid = (week >= 1) & (weekday >= 1) & (weekday <= 7) & (F.weekofyear(in_week) == week)
    return F.when(digits.contains("W"), F.when(valid, in_week)).otherwise(plain)


def iso_moment(text: Column, convert_offset: bool = False) -> Column:
    """ISO text as local date-time, NULL where it is none.

    The offset is dropped, not applied; ``convert_offset`` applies it instead.
    """
    text = F.replace(text, F.lit("Z"), F.lit("+00:00"))
    # the long way is taken only by text the cast cannot read; inside transform()
    # it stays one call, where inlined it would outgrow a generated method
    full = F.get(F.transform(F.array(text), lambda t: _full_iso(t, convert_offset)), F.lit(0))
    if convert_offset:
        return full
    return F.coalesce(F.when(text.rlike(_USUAL), text.try_cast("timestamp_ntz")),
                      F.when(text != "", full))


def _full_iso(text: Column, convert_offset: bool) -> Column:
    day = F.regexp_extract(text, _ISO, 1)
    clock = F.replace(F.translate(F.regexp_extract(text, _ISO, 2), ",", "."), F.lit(":"), F.lit(""))
    offset = F.replace(F.regexp_extract(text, _ISO, 3), F.lit(":"), F.lit(""))
    padded = F.rpad(F.substring_index(clock, ".", 1), 6, "0")
    fraction = F.when(clock.contains("."), F.concat(F.lit("."), F.left(F.substring_index(clock, ".", -1), F.lit(6)))).otherwise("")
    moment = F.concat(_calendar_day(day).cast("string"), F.lit(" "),
                      F.substring(padded, 1, 2), F.lit(":"), F.substring(padded, 3, 2), F.lit(":"),
                      F.substring(padded, 5, 2), fraction).try_cast("timestamp_ntz")
    # hour 24 and second 60 are no valid clock, whatever the cast would make of them
    valid = (day != "") & (F.substring(padded, 1, 2) < "24") & (F.substring(padded, 5, 2) < "60")
    moment = F.when(valid, moment)
    if convert_offset:
        minutes = F.coalesce(F.substring(offset, 2, 2).try_cast("int") * 60, F.lit(0)) \
            + F.coalesce(F.substring(offset, 4, 2).try_cast("int"), F.lit(0))
        signed = F.when(offset.startswith("-"), -minutes).otherwise(minutes)
        moment = moment - F.make_dt_interval(mins=signed)
    return moment


def is_recent_moment(moment: Column, now: Column) -> Column:
    """Exactly 36 hours is fresh, and so is the future."""
    return moment >= now - F.make_dt_interval(hours=F.lit(MAX_AGE_HOURS))


def is_recent_text(text: Column, extra_stale: str | None = None) -> Column:
    """Fresh unless the text tells otherwise; ``extra_stale`` adds a pattern of the caller's."""
    low = F.lower(F.coalesce(text, F.lit("")))
    stale = low.rlike(STALE_UNITS) | low.rlike(STALE_DAYS)
    if extra_stale:
        stale = stale | low.rlike(extra_stale)
    return ~stale


def is_recent(has_time: Column, attribute: Column, text: Column, now: datetime | str | Column,
              convert_offset: bool = False, extra_stale: str | None = None) -> Column:
    """The whole rule: no time tag passes, a readable attribute decides, else the text."""
    # NULL, and so left to the text, exactly where there is no moment
    by_moment = is_recent_moment(iso_moment(attribute, convert_offset), now_column(now))
    return F.when(~has_time, F.lit(True)).otherwise(F.coalesce(by_moment, is_recent_text(text, extra_stale)))
