"""Due dates of fixed, recurring and event-triggered rules. `today` is always given, never the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _days(year: Column, month: Column) -> Column:
    return F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))


def _date(year: Column, month: Column, day: Column) -> Column:
    """Null for a day that the month doesn't have, a month that the year doesn't have, and years beyond four digits."""
    known = year.between(1, 9999) & month.between(1, 12) & (day >= 1)
    return F.when(known & ((day <= 28) | (day <= _days(year, month))), F.make_date(year, month, day))


def fixed(month: Column, day: Column, today: Column) -> Column:
    """This year's day or, once it has passed, next year's."""
    year = F.year(today)
    passed = (month < F.month(today)) | ((month == F.month(today)) & (day < F.dayofmonth(today)))
    # Where this year lacks the day, there is none, whatever next year has. Every month has the first 28.
    return F.when((day <= 28) | _date(year, month, day).isNotNull(), _date(year + F.when(passed, 1).otherwise(0), month, day))


def recurring(month: Column, day: Column, period: Column, today: Column, months: int = 120) -> Column:
    """The first day from today on, a period after another, from the anchor month of this year. Which step that is follows from the months between;
    of the steps before it, only those of a day that some months lack are looked at."""
    anchor = F.coalesce(F.nullif(month, F.lit(0)), F.lit(1)) - 1
    step = F.when(period > 0, period).otherwise(1)
    year = lambda k: F.year(today) + F.floor((anchor + k) / 12).cast("int")
    at = lambda k: _date(year(k), F.pmod(anchor + k, F.lit(12)) + 1, day)
    least = F.month(today) - 1 + F.when(day < F.dayofmonth(today), 1).otherwise(0)  # the first month whose day is not past
    k = F.greatest(F.ceil((least - anchor) / step).cast("int"), F.lit(0)) * step
    # A day that a month lacks ends the search with no date, as a wrong rule should not skip on.
    whole = F.when(day <= 28, True).otherwise(F.forall(F.sequence(F.lit(0), F.least(k, F.lit(months)), step), lambda i: at(i).isNotNull()))
    # So the month that is found has the day. It is no earlier than today's, and is counted on from January.
    last = (10_000 - F.year(today)) * 12 - 1
    due = F.when((F.year(today) >= 1) & (day >= 1) & (anchor + k <= last), F.date_add(F.add_months(F.trunc(today, "year"), anchor + k), day - 1))
    return F.when((period > 0) & day.isNotNull() & (k <= months) & whole, due)


def after_event(days: Column, event: Column) -> Column:
    return F.when(days.isNotNull() & event.isNotNull(), F.date_add(event, days))


def due_date(kind: Column, month: Column, day: Column, period: Column, days: Column, event: Column, today: Column) -> Column:
    return F.when(kind == "fixed", fixed(month, day, today)).when(kind == "recurring", recurring(month, day, period, today)).when(kind == "event_triggered", after_event(days, event))
