"""Date functions as column expressions; all times are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.text import trim_space

# Month names by number.
MONTHS = {"jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12}
_SHAPES = [
    (r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)$", None),
    (r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d[+-]\d{4}$", "yyyy-MM-dd'T'HH:mm:ssXX"),
    (r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d$", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{4}-\d\d-\d\d$", "yyyy-MM-dd"),
    (r"^\d{4}/\d\d/\d\d$", "yyyy/MM/dd"),
]
_HTTP = r"^[A-Z][a-z]{2}, (\d{1,2} [A-Z][a-z]{2} \d{4} \d\d:\d\d:\d\d) "


def parse_date(c: Column) -> Column:
    """A timestamp in one of the layouts that providers use; null if none fits."""
    s = trim_space(c)
    out = F.lit(None).cast("timestamp")
    for shape, layout in _SHAPES:
        out = F.coalesce(out, F.when(s.rlike(shape), F.try_to_timestamp(s, F.lit(layout)) if layout else s.try_cast("timestamp")))
    stamp = F.regexp_extract(s, _HTTP, 1)
    zone = F.regexp_replace(F.regexp_replace(s, _HTTP, ""), "^(?:GMT|UTC|[A-Z]{3,4})$", "+0000")
    return F.coalesce(out, F.when(s.rlike(_HTTP + r"(?:[A-Z]{3,4}|[+-]\d{4})$"), F.try_to_timestamp(F.concat(stamp, F.lit(" "), zone), F.lit("d MMM yyyy HH:mm:ss XX"))))


def _valid(year: Column, month: Column, day: Column) -> Column:
    text = F.format_string("%04d-%02d-%02d", year, month, day)
    return F.when(year.between(2000, 2099) & month.between(1, 12) & day.between(1, 31), text.try_cast("date"))


# Endings of ordinal numbers.
ORDINALS = ("st", "nd", "rd", "th")


def _spelled(before: Column, between: Column, after: Column, day_first: bool) -> Column:
    """The date of three neighbouring words, null if they are none.

    Of the first word its end counts and of the third its beginning; the second has to be a day or a month alone, a day with a comma or a month with a dot at most.
    """
    begin, year = F.regexp_extract(before, "[A-Za-z0-9.]+$", 0), F.regexp_extract(after, "^[A-Za-z0-9]+", 0)
    name, number = (between, begin) if day_first else (begin, F.rtrim(between, F.lit(",")))
    bare = F.when(F.right(number, F.lit(2)).isin(*ORDINALS), F.left(number, F.char_length(number) - 2)).otherwise(number)
    month = F.try_element_at(F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair)), F.lower(F.rtrim(name, F.lit("."))))
    digits = lambda c, most: F.when(F.char_length(c) <= most, F.when(F.translate(c, "0123456789", "") == "", c.try_cast("int")))
    return _valid(digits(year, 4), month, digits(bare, 2))


def _named(head: Column, day_first: bool) -> Column:
    """The first date among the words of a text that reads day, month name, year, or month name, day, year."""
    words = F.split(head, r"\s+", -1)
    ahead = F.zip_with(F.slice(words, 2, 1 << 20), F.slice(words, 3, 1 << 20), lambda b, c: F.struct(b.alias("b"), c.alias("c")))
    dates = F.zip_with(words, ahead, lambda a, x: _spelled(a, x["b"], x["c"], day_first))
    return F.get(F.filter(dates, lambda d: d.isNotNull()), F.lit(0))


def date_from_text(c: Column) -> Column:
    """A date among the first 1500 bytes: an ISO date that stands alone, else "16 Oct 2026", else "Oct 16, 2026"; years 2000 to 2099."""
    head = F.substring(trim_space(c).cast("binary"), 1, 1500).cast("string")
    found = F.regexp_extract_all(head, F.lit(r"(?<![-/._:0-9])\d{4}-\d{2}-\d{2}(?![-/._:0-9])"), F.lit(0))
    good = F.filter(F.transform(found, lambda x: F.when(x.substr(1, 2) == "20", x.try_cast("date"))), lambda x: x.isNotNull())
    return F.coalesce(F.get(good, F.lit(0)), _named(head, True), _named(head, False))


def age(stamp: Column, now: Column) -> Column:
    """How long ago in words; "unknown" without a time, "just now" for one to come."""
    s = F.unix_timestamp(now) - F.unix_timestamp(stamp)

    def words(unit: int, name: str) -> Column:
        return F.concat(F.floor(s / unit).cast("string"), F.lit(f" {name} ago"))

    hour, day = 3600, 86400
    return (
        F.when(stamp.isNull(), "unknown").when(s < 0, "just now").when(s < hour, words(60, "minutes")).when(s < day, words(hour, "hours"))
        .when(s < 30 * day, words(day, "days")).when(s < 365 * day, words(30 * day, "months")).otherwise(words(365 * day, "years"))
    )


def fresh(stamp: Column, now: Column, days: int) -> Column:
    """Not older than so many days; always if days is not positive, never without a time."""
    return F.lit(True) if days <= 0 else F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(stamp) <= days * 86400, F.lit(False))


def ledger_month(path: Column, stamp: Column) -> Column:
    """yyyy-MM of the path's day, else of the time, else "unknown"."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"^(\d{4}-\d{2})-\d{2}(?:/|$)", 1), F.lit("")), F.date_format(stamp, "yyyy-MM"), F.lit("unknown"))


def rfc3339(stamp: Column) -> Column:
    return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ssXXX")


# The buckets of the search services by age in days.
def day_bucket(days: int) -> str:
    """day, week, month or year; empty without a limit."""
    return "" if days <= 0 else "day" if days <= 1 else "week" if days <= 7 else "month" if days <= 31 else "year"


def qdr_bucket(days: int) -> str:
    return {"": "", "day": "qdr:d", "week": "qdr:w", "month": "qdr:m", "year": "qdr:y"}[day_bucket(days)]
