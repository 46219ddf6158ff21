"""Client-side filters, facets and keyed histories."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillet.functions import fixed


def is_date(x: str | None) -> bool:
    try:
        return bool(x) and bool(datetime.date.fromisoformat(x))
    except ValueError:
        return False


@dataclass(frozen=True)
class Filters:
    """What a reader chose: any of the tags, the last days (0 for all) or days from first to last, bookmarked or visited rows only."""

    tags: tuple[str, ...] = ()
    days: int = 0
    first: str | None = None
    last: str | None = None
    bookmarked: bool = False
    visited: bool = False

    def dated(self) -> bool:
        return self.days > 0 or is_date(self.first) or is_date(self.last)

    def active(self) -> bool:
        return bool(self.tags) or self.dated() or self.bookmarked or self.visited


def chosen(
    rows: DataFrame, f: Filters, now: str, bookmarks: DataFrame | None = None, visits: DataFrame | None = None, bookmark_key: str = "url", visit_key: str = "url",
    tags: str = "topics", at: str = "published_at",
) -> DataFrame:
    """Rows that pass all of the filters."""
    rows = by_range(by_days(by_any_tag(rows, list(f.tags), tags), f.days, now, at), f.first, f.last, at)
    if f.bookmarked:
        rows = only_known(rows, bookmarks, bookmark_key)
    return only_known(rows, visits, visit_key) if f.visited else rows


def by_days(rows: DataFrame, days: int, now: str, column: str = "published_at") -> DataFrame:
    """The last `days` days; zero means all, and a row without a date fails any window."""
    if days <= 0:
        return rows
    return rows.where(F.col(column) >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


def by_range(rows: DataFrame, first: str | None, last: str | None, column: str = "published_at") -> DataFrame:
    """Inclusive UTC days; a bound that is no date is ignored."""
    day = lambda x: F.to_timestamp(F.lit(x), "yyyy-MM-dd")
    if is_date(first):
        rows = rows.where(F.col(column) >= day(first))
    if is_date(last):
        rows = rows.where(F.col(column) < day(last) + F.expr("INTERVAL 1 DAY"))
    return rows


def by_any_tag(rows: DataFrame, tags: list[str], column: str = "topics") -> DataFrame:
    return rows.where(F.arrays_overlap(F.col(column), F.array(*map(F.lit, tags)))) if tags else rows


def only_known(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in a bookmark or visit table."""
    return rows.join(known.select(key), key, "left_semi")


def lookup(keys: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Each different key that was asked for, once, and whether it is known: one join answers all who ask together."""
    marked = known.select(key).distinct().withColumn("known", F.lit(True))
    return keys.select(key).distinct().join(marked, key, "left").select(key, F.coalesce("known", F.lit(False)).alias("known"))


def not_loaded(rows: DataFrame, loaded: DataFrame, key: str = "url") -> DataFrame:
    """Loaded rows, then incoming ones whose key is not loaded yet."""
    return loaded.unionByName(rows.join(loaded.select(key), key, "left_anti"))


def facet(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.explode(column).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def latest(rows: DataFrame, key: list[str], at: str) -> DataFrame:
    """The last time of each key: an upsert of marks."""
    return rows.groupBy(*key).agg(F.max(at).alias(at))


def newest_first(rows: DataFrame, owner: str, at: str, tie: str) -> DataFrame:
    """All rows, numbered (`place`) from each owner's newest on."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(owner).orderBy(F.desc(at), tie)))


def stored(rows: DataFrame, owner: str) -> DataFrame:
    """How many rows each owner has stored."""
    return rows.groupBy(owner).agg(F.count(F.lit(1)).alias("n"))


def marks(events: DataFrame, clicks: tuple[str, ...] = ("click",)) -> DataFrame:
    """Visit marks of the events that open a page, whichever button did it: user_id and the last time of each url."""
    return events.where(F.col("event_type").isin(*clicks)).groupBy("user_id", "url").agg(F.max("ts").alias("at"))


def trim_history(rows: DataFrame, owner: str, at: str, cap: int = fixed.HISTORY_CAP, keep: int = fixed.HISTORY_KEEP) -> DataFrame:
    """Over `cap` rows an owner's history is cut to its `keep` newest."""
    size = rows.groupBy(owner).agg(F.count(F.lit(1)).alias("__n"))
    rank = F.row_number().over(W.partitionBy(owner).orderBy(F.desc(at), F.desc("event_id")))
    return rows.withColumn("__rank", rank).join(size, owner).where((F.col("__n") <= cap) | (F.col("__rank") <= keep)).drop("__rank", "__n")
