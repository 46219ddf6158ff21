"""Date functions as Column expressions; what cannot be read is null, in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Layouts in order, after a leading weekday name is taken off.
LAYOUTS = (
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSSXXX",
    "d MMM yyyy HH:mm:ss Z",
    "dd MMM yyyy HH:mm:ss z",
    "dd MMM yy HH:mm Z",
    "dd MMM yy HH:mm z",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
)


def parse_time(c: Column) -> Column:
    """The first layout that fits. A zone other than UTC given by letters has no offset here and counts as UTC."""
    bare = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3,9},?\s+", "")
    zoned = F.regexp_replace(bare, r"\b(?!GMT|UTC|Z)[A-Z]{3,4}$", "UTC")
    return F.coalesce(*[F.try_to_timestamp(zoned, F.lit(x)) for x in LAYOUTS])


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def display_date(ts: Column) -> Column:
    return F.date_format(ts, "d MMM yyyy")


def in_days(ts: Column, first: str | None, last: str | None) -> Column:
    """Inside inclusive UTC days; a row without a date fails any bound."""
    ok = F.lit(True)
    if first:
        ok = ok & (ts >= F.lit(first).cast("timestamp"))
    if last:
        ok = ok & (ts < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp"))
    return F.coalesce(ok, F.lit(False)) if first or last else ok
