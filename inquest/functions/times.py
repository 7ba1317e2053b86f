"""Time stamps as the evidence graph holds them: text, point or interval, with or without an offset."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The time zone of stamps without an offset.
DEFAULT_ZONE = "Asia/Kolkata"
START_KEYS = ("timestamp_start", "start_time", "start")
STOP_KEYS = ("timestamp_end", "end_time", "end")
POINT_KEYS = ("timestamp", "datetime", "occurred_at")

_DAY = r"(\d{4})-?(\d{2})-?(\d{2})"
_STAMP = rf"^{_DAY}(?:[T ](\d{{2}})(?::?(\d{{2}}))?(?::?(\d{{2}})(?:[.,](\d{{1,9}}))?)?)?(Z|[+-]\d{{2}}(?::?\d{{2}})?)?$"


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def iso_instant(text: Column, zone: str = DEFAULT_ZONE) -> Column:
    """An ISO 8601 stamp, extended or basic, as an instant; null for other forms. A date alone is local midnight.

    Stamps without an offset are in `zone`. The session must run in UTC, as all sessions of this library do.
    """

    def of(p: Column) -> Column:
        two = lambda i: F.rpad(p[i], 2, "0")
        plain = F.concat(p[1], F.lit("-"), p[2], F.lit("-"), p[3], F.lit(" "), two(4), F.lit(":"), two(5), F.lit(":"), two(6), F.lit("."), F.rpad(F.substring(p[7], 1, 6), 6, "0"))
        return F.struct(F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("local"), p[8].alias("offset"), F.regexp_replace(p[8], "[^0-9]", "").alias("digits"))

    def shifted(x: Column) -> Column:
        minutes = F.substring(x["digits"], 1, 2).try_cast("int") * 60 + F.coalesce(F.substring(x["digits"], 3, 2).try_cast("int"), F.lit(0))
        signed = F.when(F.substring(x["offset"], 1, 1) == "-", -minutes).otherwise(minutes)
        aware = F.timestamp_micros(F.unix_micros(x["local"]) - signed.cast("long") * 60_000_000)
        return F.when(x["offset"] == "Z", x["local"]).when(x["offset"] == "", F.to_utc_timestamp(x["local"], zone)).otherwise(aware)

    s = F.trim(text)
    parts = F.array(*(F.regexp_extract(s, _STAMP, i) for i in range(9)))
    return F.when(s.rlike(_STAMP), _bound(_bound(parts, of), shifted))


def first_value(attributes: Column, keys: tuple[str, ...]) -> Column:
    """The first of these keys of a map whose value is neither null nor empty."""
    return F.coalesce(*(F.nullif(F.try_element_at(attributes, F.lit(k)), F.lit("")) for k in keys))


def interval(attributes: Column, zone: str = DEFAULT_ZONE) -> Column:
    """A struct of start, stop, dated and problem from a map of attributes.

    A start or an end outranks a point; a missing side takes the other's value. Text that is no stamp, and a start
    behind its end, are problems, and leave start and stop null.
    """

    def texts(m: Column) -> Column:
        start, stop, point = (first_value(m, k) for k in (START_KEYS, STOP_KEYS, POINT_KEYS))
        return F.struct(F.coalesce(start, stop, point).alias("low"), F.when(start.isNotNull() | stop.isNotNull(), F.coalesce(stop, start)).otherwise(point).alias("high"))

    def instants(t: Column) -> Column:
        return F.struct(iso_instant(t["low"], zone).alias("low"), iso_instant(t["high"], zone).alias("high"), t["low"].isNotNull().alias("dated"))

    def judged(x: Column) -> Column:
        bad = F.coalesce(x["dated"] & (x["low"].isNull() | x["high"].isNull() | (x["low"] > x["high"])), F.lit(True))
        return F.struct(F.when(~bad, x["low"]).alias("start"), F.when(~bad, x["high"]).alias("stop"), x["dated"].alias("dated"), bad.alias("problem"))

    return _bound(_bound(_bound(attributes, texts), instants), judged)


def bucket(at: Column, minutes: int) -> Column:
    """The start of the epoch-aligned bucket of so many minutes that holds an instant."""
    if not 1 <= minutes <= 7200:
        raise ValueError("a bucket has 1 to 7200 minutes")
    size = minutes * 60
    seconds = F.unix_seconds(at)
    return F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(size)))


def _day(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_timestamp(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")


def _full_year(year: Column) -> Column:
    """Two-digit years from 69 on are of the 1900s."""
    return F.when(F.length(year) == 4, year).otherwise(F.concat(F.when(year.try_cast("int") >= 69, "19").otherwise("20"), year))


def case_date(text: Column) -> Column:
    """The first date in a text, in one of the forms seen in case files: Y-M-D, D-M-Y, M-D-Y, D-M-y, with '-', '/' or '.'. Null for others.

    Day first is tried before month first.
    """
    s = F.regexp_replace(F.regexp_extract(text, r"(\d{1,4})[-/.](\d{1,2})[-/.](\d{1,4})", 0), "[/.]", "-")
    year_first, year_last = r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{1,2})-(\d{1,2})-(\d{4}|\d{2})$"
    of = lambda i, p: F.regexp_extract(s, p, i)
    year = _full_year(of(3, year_last))
    return F.coalesce(
        F.when(s.rlike(year_first), _day(of(1, year_first), of(2, year_first), of(3, year_first))),
        F.when(s.rlike(year_last), _day(year, of(2, year_last), of(1, year_last))),
        F.when(s.rlike(r"-\d{4}$") & s.rlike(year_last), _day(year, of(1, year_last), of(2, year_last))),
    )


def flexible_date(text: Column) -> Column:
    """A date by its digits, '/' and '-' alone, other signs left out: D/M/Y, D-M-Y, the same with two digits of the year, Y-M-D, Y/M/D. Null for others."""
    s = F.regexp_replace(text, "[^0-9/-]", "")
    year_last, year_first = r"^(\d{1,2})([/-])(\d{1,2})\2(\d{4}|\d{2})$", r"^(\d{4})([/-])(\d{1,2})\2(\d{1,2})$"
    of = lambda i, p: F.regexp_extract(s, p, i)
    return F.coalesce(F.when(s.rlike(year_last), _day(_full_year(of(4, year_last)), of(3, year_last), of(1, year_last))), F.when(s.rlike(year_first), _day(of(1, year_first), of(3, year_first), of(4, year_first))))
