"""Dates: French text to timestamps without zone, clamped distances, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import clean, text

FRENCH = f"(?i){V.FRENCH_DATETIME}"


def french_datetime(value: Column | str, end_of_day: bool = False, cleaned: bool = False) -> Column:
    """A timestamp, or null. Without a time: 23:59 if end_of_day, else 0:00."""
    v = value if cleaned else clean(value)
    part = lambda i: F.regexp_extract(v, FRENCH, i)
    month = F.create_map(*[F.lit(x) for kv in V.MONTHS.items() for x in kv])[F.lower(part(2))]
    timed = part(4) != ""
    hour = F.when(timed, part(4).try_cast("int")).otherwise(F.lit(23 if end_of_day else 0))
    minute = F.when(timed, part(5).try_cast("int")).otherwise(F.lit(59 if end_of_day else 0))
    return F.try_make_timestamp_ntz(part(3).try_cast("int"), month, part(1).try_cast("int"), hour, minute, F.lit(0))


def with_french_datetimes(df: DataFrame, columns: dict[str, tuple[str, bool]]) -> DataFrame:
    """df with a timestamp `out` and a flag `out`_wrong for each out: (text
    column, end of day)."""
    names = {o: f"{o}_parts" for o in columns}
    df = df.withColumns({names[o]: clean(c) for o, (c, _) in columns.items()})
    df = df.withColumns({o: french_datetime(F.col(names[o]), e, cleaned=True) for o, (_, e) in columns.items()})
    known = {f"{o}_wrong": F.col(o).isNull() & F.lower(F.regexp_extract(names[o], FRENCH, 2)).isin(*V.MONTHS) for o in columns}
    return df.withColumns(known).drop(*names.values())


def french_date_is_wrong(value: Column | str) -> Column:
    """A known month with a day or time that the calendar doesn't have."""
    v = clean(value)
    known = F.lower(F.regexp_extract(v, FRENCH, 2)).isin(*V.MONTHS)
    return known & french_datetime(v).isNull()


def local_time(value: Column | str) -> Column:
    """ISO text (or a timestamp) as local time; null if it can't be read. A zone
    in the text is replaced by the local one, not converted."""
    v = F.regexp_replace(text(value), r"(Z|[+-]\d{2}:?\d{2})$", "")
    return v.try_cast("timestamp_ntz")


def days_since(value: Column | str, now: Column) -> Column:
    days = F.datediff(now, local_time(value))
    return F.when(days.isNull(), 99).otherwise(F.greatest(days, F.lit(0)))


def days_until(value: Column | str, now: Column) -> Column:
    return F.coalesce(F.greatest(F.datediff(local_time(value), now), F.lit(0)), F.lit(0))


def freshness(publication: Column | str, deadline: Column | str, now: Column) -> Column:
    """accepted, or why not; a date that is missing or can't be read is a reason."""
    published, until = local_time(publication), local_time(deadline)
    age = F.datediff(now, published)
    return (
        F.when(published.isNull(), "unreadable_publication_date").when(until.isNull(), "unreadable_deadline")
        .when(age < 0, "publication_in_future").when(age > V.MAXIMUM_AGE_DAYS, f"older_than_{V.MAXIMUM_AGE_DAYS}_days").when(until < now, "deadline_expired").otherwise("accepted")
    )
