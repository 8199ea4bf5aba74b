"""Times: text patterns, base times and offsets, calendar rules and output splits."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp of either kind."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(t: Column) -> Column:
    return F.timestamp_micros(t).cast("timestamp_ntz")


def units_text(base: Column) -> Column:
    """'seconds since ...' of an epoch second."""
    return F.concat(F.lit("seconds since "), F.date_format(F.timestamp_seconds(base), "yyyy-MM-dd HH:mm:ss"), F.lit(" 0:00"))


def base_of(units: Column) -> Column:
    """Epoch second of a 'seconds since ...' text; null if it isn't one."""
    found = F.regexp_extract(units, r"since\s+(\d{4}-\d{1,2}-\d{1,2}(?:[ T]\d{1,2}:\d{2}:\d{2})?)", 1)
    return F.unix_timestamp(F.try_to_timestamp(F.nullif(found, F.lit(""))))


def offset_to_micros(base: Column, offset: Column) -> Column:
    """Base second plus an offset in seconds, rounded to microseconds."""
    return base * MICROS + F.round(offset * MICROS).cast("long")


def midnight(t: Column) -> Column:
    """The start of the UTC day of an epoch second."""
    return F.floor(t / 86400) * 86400


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd.HHmmss")


def month_and_day(year: Column, yday: Column) -> Column:
    """The date of a day of the year (from 1)."""
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (yday - 1).cast("int"))


def days_in_month(year: Column, month: Column) -> Column:
    return F.day(F.last_day(F.make_date(year, month, F.lit(1))))


def four_digit_year(year: Column) -> Column:
    """Below 90: of this century; below 1990: years since 1900; else as it is."""
    return F.when(year < 90, year + 2000).when(year < 1990, year + 1900).otherwise(year)


def timezone_offset(longitude: Column) -> Column:
    """Hours from UTC by the longitude, west counted negative down to -23."""
    west = F.when(longitude > 0, longitude - 360).otherwise(longitude)
    hours = F.when(west / 15 < 0, F.ceil(west / 15)).otherwise(F.floor(west / 15)).cast("int")
    return F.when(west < -180, hours + 24).otherwise(hours)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# What each directive of a time pattern matches.
DIRECTIVES = {
    "Y": r"\d{4}", "y": r"\d{1,2}", "C": r"\d{1,2}", "m": r"\d{1,2}", "d": r"\d{1,2}", "e": r"\d{1,2}", "j": r"\d{1,3}", "H": r"\d{1,2}", "M": r"\d{1,2}", "S": r"\d{1,2}(?:\.\d+)?",
    "h": r"\d{1,4}", "b": r"[A-Za-z]{3,9}", "B": r"[A-Za-z]{3,9}", "s": r"\d+", "o": r"\d+", "p": r"[AaPp]\.?[Mm]\.?", "q": r"\d{1,6}",
}
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


class TimePattern:
    """A regular expression with time directives (%Y %m %d %H %M %S ...; %0x wants all digits), compiled to column expressions."""

    def __init__(self, pattern: str):
        self.fields: list[str] = []

        def group(m: re.Match) -> str:
            zero, name = m[1], m[2]
            if name == "%":
                return "%"
            if name in "nt":
                return r"\s+"
            self.fields.append(name)
            return "(" + (DIRECTIVES[name].replace("{1,2}", "{2}").replace("{1,3}", "{3}").replace("{1,4}", "{4}") if zero else DIRECTIVES[name]) + ")"

        self.regex = re.sub(r"%(0?)([A-Za-z%])", group, re.sub(r"\((?!\?)", "(?:", pattern))
        for kind, java in (("[:alpha:]", r"\p{Alpha}"), ("[:digit:]", r"\d"), ("[:alnum:]", r"\p{Alnum}"), ("[:space:]", r"\s")):
            self.regex = self.regex.replace(kind, java)

    def matches(self, text: Column) -> Column:
        return text.rlike(self.regex)

    def part(self, text: Column, *names: str) -> Column:
        """The text of the first of the directives that the pattern has; null without a match."""
        for name in names:
            if name in self.fields:
                # no directive matches an empty text
                return F.nullif(F.regexp_extract(text, self.regex, self.fields.index(name) + 1), F.lit(""))
        return F.lit(None).cast("string")

    def parse(self, text: Column, *, year: Column | None = None, month: Column | None = None, day: Column | None = None) -> Column:
        """Microseconds since 1970; null without a match or for impossible values. Parts that the pattern lacks come from the arguments."""
        if "s" in self.fields or "o" in self.fields:
            return (self.part(text, "s", "o").cast("double") * MICROS).cast("long")
        # each expression is long and needed often: the text, its parts and their numbers are evaluated once for a row
        found = lambda x: F.struct(*[F.regexp_extract(x, self.regex, k + 1).alias(f"_{k}") for k in range(len(self.fields))], *[v.alias(k) for k, v in (("year", year), ("month", month), ("day", day)) if v is not None])
        return once(text, lambda x: once(found(x), lambda p: once(self._numbers(p, year is not None, month is not None, day is not None), self._micros)))

    def _numbers(self, p: Column, has_year: bool, has_month: bool, has_day: bool) -> Column:
        """struct(right, years, months, days, hour, minute, second) of the texts of the directives, and of the parts given besides; right: whether the pattern matched."""

        def text(*names: str) -> Column:
            # no directive matches an empty text
            return next((F.nullif(p[f"_{self.fields.index(n)}"], F.lit("")) for n in names if n in self.fields), F.lit(None).cast("string"))

        number = lambda *names: text(*names).cast("double")
        none = F.lit(None).cast("int")
        years = F.coalesce(number("Y").cast("int"), (number("C") * 100 + F.coalesce(number("y"), F.lit(0))).cast("int") if "C" in self.fields else four_digit_year(number("y").cast("int")), p["year"] if has_year else none)
        name = F.lower(F.substring(text("b", "B"), 1, 3))
        months = F.coalesce(number("m").cast("int"), F.nullif(F.array_position(F.array(*map(F.lit, _MONTHS)), name).cast("int"), F.lit(0)), p["month"] if has_month else none)
        days = F.coalesce(number("d", "e").cast("int"), p["day"] if has_day else none)
        if "j" in self.fields:
            whole = month_and_day(years, number("j").cast("int"))
            months, days = F.month(whole), F.day(whole)
        hour = F.coalesce(number("H"), F.floor(number("h") / 100), F.lit(0.0))
        if "p" in self.fields:
            late = F.lower(F.substring(text("p"), 1, 1)) == "p"
            hour = hour % 12 + F.when(late, 12).otherwise(0)
        minute = F.coalesce(number("M"), number("h") % 100, F.lit(0.0))
        second = F.coalesce(number("S"), F.lit(0.0)) + F.coalesce(number("q"), F.lit(0.0)) / MICROS
        values = {"right": text(*self.fields).isNotNull(), "years": years, "months": months, "days": days, "hour": hour, "minute": minute, "second": second}
        return F.struct(*[v.alias(k) for k, v in values.items()])

    @staticmethod
    def _micros(n: Column) -> Column:
        years, months, days, hour, minute, second = (n[k] for k in ("years", "months", "days", "hour", "minute", "second"))
        right = n["right"] & (months.between(1, 12)) & days.between(1, days_in_month(years, F.least(F.greatest(months, F.lit(1)), F.lit(12)))) & hour.between(0, 23) & minute.between(0, 59) & (second < 61)
        # evaluated for right parts only
        day_number = F.datediff(F.make_date(years, months, days), F.lit("1970-01-01").cast("date")).cast("long")
        return F.when(right, day_number * (86400 * MICROS) + F.round((hour * 3600 + minute * 60 + second) * MICROS).cast("long"))


def first_match(patterns: list[str], text: Column, **parts: Column) -> Column:
    """The time by the first pattern that matches."""
    return F.coalesce(*[TimePattern(p).parse(text, **parts) for p in patterns])


def split_key(t: Column, mode: str, interval: int = 1, start: int = 0, tz_hours: float = 0.0) -> Column:
    """Start (microseconds) of the output file that a time belongs to.

    mode: hours (counted from hour ``start`` of each day), days (from day ``start`` + 1 of each year), months (from month
    ``start`` + 1 of each year) or years. Counting begins anew in each day or year. tz_hours shifts the boundaries to local time.
    """
    shift = int(tz_hours * 3600 * MICROS)
    local = t + F.lit(shift)
    day = F.floor(local / F.lit(86400 * MICROS))
    date = F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int"))
    count = lambda d: F.datediff(d, F.lit("1970-01-01").cast("date")).cast("long") * F.lit(86400 * MICROS)
    if mode == "hours":
        hour = F.floor((local - day * 86400 * MICROS) / F.lit(3600 * MICROS))
        at = day * 86400 * MICROS + (F.floor((hour - start) / interval) * interval + start) * 3600 * MICROS
    elif mode == "days":
        yday = F.dayofyear(date) - 1
        at = count(F.date_add(F.trunc(date, "year"), (F.floor((yday - start) / interval) * interval + start).cast("int")))
    elif mode == "months":
        month = F.month(date) - 1
        at = count(F.add_months(F.trunc(date, "year"), (F.floor((month - start) / interval) * interval + start).cast("int")))
    elif mode == "years":
        at = count(F.trunc(date, "year"))
    else:
        raise ValueError("mode must be hours, days, months or years")
    return (at - F.lit(shift)).cast("long")


def parse_split(text: str) -> tuple[str, int]:
    """(mode, interval) of hourly, daily, monthly, yearly, or a number and a unit such as '6 hours'."""
    names = {"hourly": ("hours", 1), "daily": ("days", 1), "monthly": ("months", 1), "yearly": ("years", 1)}
    text = text.strip().lower()
    if text in names:
        return names[text]
    m = re.fullmatch(r"(\d+)\s*(hour|day|month|year)s?", text)
    if not m:
        raise ValueError(f"{text!r} is no output interval")
    return f"{m[2]}s", int(m[1])


def name_stamp(micros: int) -> str:
    """A time as yyyymmdd.hhmmss, for names of files."""
    return (dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=micros)).strftime("%Y%m%d.%H%M%S")
