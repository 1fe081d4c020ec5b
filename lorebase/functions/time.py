"""Times and calendar expressions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TTL_DAYS, TTL_MOST = 7, 30


def half_life(age_days: Column, days: float) -> Column:
    return F.pow(F.lit(2.0), -F.greatest(age_days, F.lit(0.0)) / days)


def age_days(at: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(at)) / 86_400_000_000.0


def backoff_seconds(attempt: Column) -> Column:
    """A minute, doubled each attempt, an hour at most."""
    return F.least(F.pow(F.lit(2.0), F.least(attempt, F.lit(20)) - 1) * 60, F.lit(3600.0)).cast("long")


def ttl(days: Column, default: int = TTL_DAYS, most: int = TTL_MOST) -> Column:
    """Days to live: the default for none, null (an error) where negative or too many."""
    return F.when(days.isNull() | (days == 0), default).when((days < 0) | (days > most), F.lit(None).cast("int")).otherwise(days.cast("int"))


def time_range(a: Column, b: Column) -> Column:
    """``date time-time`` within a day, ``date time - date time`` over more."""
    day, hour = "yyyy-MM-dd", "HH:mm"
    same = F.date_format(a, day) == F.date_format(b, day)
    return F.when(same, F.concat(F.date_format(a, f"{day} {hour}"), F.lit("-"), F.date_format(b, hour))).otherwise(
        F.concat(F.date_format(a, f"{day} {hour}"), F.lit(" - "), F.date_format(b, f"{day} {hour}"))
    )


# fixed values: numbers that are spelled out
NUMBERS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")
_NUMBERS = "|".join(NUMBERS)


def calendar_meaning(expression: Column, day: Column) -> Column:
    """(first, last, approximate): the dates a relative expression means when said on ``day``; null where it means none.

    Known: yesterday, today, tomorrow; N days or weeks ago (1 to 3660, up to twelve in words too); last or next week (Monday to Sunday), month, year; last <weekday> (strictly before).
    """
    e = F.lower(F.trim(expression))
    said = F.regexp_extract(e, rf"^(\d{{1,5}}|{_NUMBERS}) (?:day|week)s? ago$", 1)
    n = F.coalesce(*(F.when(said == w, k + 1) for k, w in enumerate(NUMBERS)), said.try_cast("int"))
    ok = (n >= 1) & (n <= 3660)
    weeks = e.rlike("weeks? ago$")
    name = F.regexp_extract(e, r"^last (monday|tuesday|wednesday|thursday|friday|saturday|sunday)$", 1)
    monday = F.to_date(F.date_trunc("week", day))
    month, year = F.trunc(day, "month"), F.trunc(day, "year")
    ago = F.date_sub(day, F.when(weeks, n * 7).otherwise(n))

    def span(a: Column, b: Column, about: Column | None = None) -> Column:
        return F.struct(a.alias("first"), b.alias("last"), (about if about is not None else F.lit(False)).alias("approximate"))

    # the last such day strictly before: seven days back, then the next one
    back = F.coalesce(
        *(F.when(name == w, F.next_day(F.date_sub(day, 8), w[:3])) for w in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"))
    )
    return (
        F.when(e == "yesterday", span(F.date_sub(day, 1), F.date_sub(day, 1)))
        .when(e == "today", span(F.date_sub(day, 0), F.date_sub(day, 0)))
        .when(e == "tomorrow", span(F.date_add(day, 1), F.date_add(day, 1)))
        .when((said != "") & ok, span(ago, ago, weeks))
        .when(e == "last week", span(F.date_sub(monday, 7), F.date_sub(monday, 1)))
        .when(e == "next week", span(F.date_add(monday, 7), F.date_add(monday, 13)))
        .when(e == "last month", span(F.add_months(month, -1), F.date_sub(month, 1)))
        .when(e == "next month", span(F.add_months(month, 1), F.last_day(F.add_months(month, 1))))
        .when(e == "last year", span(F.add_months(year, -12), F.date_sub(year, 1)))
        .when(e == "next year", span(F.add_months(year, 12), F.date_sub(F.add_months(year, 24), 1)))
        .when(name != "", span(back, back))
    )


# fixed values: words that make an expression another one, before it or after it
MODIFIERS = ("about", "around", "roughly", "approximately", "almost", "nearly", "over", "under", "more", "less", "than", "least", "most", "exactly", "maybe", "not", "between", "either", "or", "to", "and")
_MODIFIED = "".join(rf"(?<!\b{w} )" for w in MODIFIERS)
CALENDAR = rf"(?i)(?<![\w\-+/\u2013\u2014]){_MODIFIED}(?<!\d )(yesterday|tomorrow|(?:\d{{1,5}}|{_NUMBERS}) (?:day|week)s? ago|(?:last|next) (?:week|month|year)|last (?:monday|tuesday|wednesday|thursday|friday|saturday|sunday))(?![\w\-+/\u2013\u2014])(?! (?:or|to|and) )"


def calendar_expressions(text: Column, most: int | None = None) -> Column:
    """Distinct relative expressions of a text, lower case, in order of mention; ``most`` keeps a reader's list short. One that a word beside it qualifies is left out:
    what it means then is anyone's guess."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(CALENDAR), F.lit(1)), lambda x: F.lower(x)))
    return found if most is None else F.slice(found, 1, most)


def parse_spoken(c: Column) -> Column:
    """``1:56 pm on 8 May, 2023`` as a timestamp."""
    return F.try_to_timestamp(F.upper(F.trim(c)), F.lit("h:mm a 'ON' d MMMM, yyyy"))


def parse_slashed(c: Column) -> Column:
    """``2023/05/20 (Sat) 02:21`` as a timestamp."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(c), r"\s*\([A-Za-z]{3}\)\s*", " "), F.lit("yyyy/MM/dd HH:mm"))
