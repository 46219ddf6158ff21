"""The resumable pass over a source list: cursor, circular slice, crawl, summary, store.

A pass keeps all it needs below one folder: the articles, one Parquet folder a pass, and records, of which the newest names
the folders that count and the cursor. It is made whole or not at all, after a pass in which some source worked, so that
a pass that dies is repeated by the next one and neither cursor nor article is lost or taken twice. A store is read by
key, newest pass first; one of many passes is compacted into one by the same rule."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.sources import storage


def resume_position(sources: DataFrame, last: str | None) -> int:
    """The place after the last source done; from the start if it is unknown. sources: id, pos from 0."""
    found = sources.where(F.col("id") == last).select("pos").limit(1).collect() if last else []
    n = sources.count()
    return (found[0]["pos"] + 1) % n if found and n else 0


def circular_slice(sources: DataFrame, start: int, size: int) -> DataFrame:
    """`size` sources from start, around the end; all of them for a size of zero or more than there are."""
    n = sources.count()
    if not n:
        return sources.withColumn("turn", F.lit(0))
    turn = F.pmod(F.col("pos") - start, F.lit(n))
    return sources.withColumn("turn", turn).where(F.col("turn") < (size if 0 < size <= n else n))


def failure_kind(error):
    low = F.lower(error)
    return F.when(error.isNull(), None).when(low.contains("deadline") | low.contains("timeout") | low.contains("timed out"), "timeout").when(low.contains("cancel"), "canceled").otherwise("error")


def summary(results: DataFrame) -> DataFrame:
    """One row: sources, articles, failed, timed out, and whether the cursor may move (not if all failed)."""
    kind = failure_kind(F.col("error"))
    s = results.agg(
        F.count(F.lit(1)).alias("sources"), F.coalesce(F.sum("n"), F.lit(0)).alias("articles"), F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.count_if(F.coalesce(kind == "timeout", F.lit(False))).alias("timed_out"),
    )
    return s.withColumn("advance", ~((F.col("failed") > 0) & (F.col("failed") == F.col("sources"))))


def merged(parts: DataFrame, key: str = "id", always: tuple[str, ...] = ("url", "title", "source_id"), at: str = "pass") -> DataFrame:
    """Rows of several passes by key: a field's newest value that is not empty, or the newest of those that are always sent."""

    def newest(c: str):
        kind = parts.schema[c].dataType.simpleString()
        value = F.col(c) if c in always else F.nullif(F.col(c), F.lit("")) if kind == "string" else F.when(F.size(c) > 0, F.col(c)) if kind.startswith("array") else F.col(c)
        return F.max_by(value, F.col(at) if c in always else F.when(value.isNotNull(), F.col(at))).alias(c)

    fields = [c for c in parts.columns if c not in (key, at)]
    return parts.groupBy(key).agg(*[newest(c) for c in fields]).select(*[c for c in parts.columns if c != at])


class Store:
    """Articles below a folder, one part a pass. The newest record (storage.commit) names the parts and the cursor together:
    a part counts from its record on and never before, so a pass that dies between any two steps changes nothing."""

    def __init__(self, spark: SparkSession, folder: str, empty: DataFrame):
        self.spark, self.folder, self.empty = spark, folder, empty

    def state(self) -> tuple[int, dict]:
        """Number of the newest record, and its parts (pass to folder) and cursor."""
        number, payload = storage.newest(self.spark, f"{self.folder}/records")
        return number, json.loads(payload) if payload else {"parts": {}, "cursor": None}

    def cursor(self) -> str | None:
        return self.state()[1]["cursor"]

    def passes(self) -> list[int]:
        return sorted(map(int, self.state()[1]["parts"]))

    def _parts(self) -> DataFrame:
        folders = self.state()[1]["parts"].values()
        empty = self.empty.withColumn("pass", F.lit(0).cast("long"))
        return self.spark.read.schema(empty.schema).parquet(*[f"{self.folder}/{x}" for x in folders]) if folders else empty

    def articles(self) -> DataFrame:
        return merged(self._parts())

    def write(self, rows: DataFrame, number: int) -> str:
        """The rows as a part of that pass, which no record names yet."""
        name = f"parts/{number}-{uuid.uuid4().hex}"
        rows.select(*self.empty.columns, F.lit(number).cast("long").alias("pass")).write.parquet(f"{self.folder}/{name}")
        return name

    def add(self, rows: DataFrame, number: int) -> None:
        """The rows as one pass; added again, a pass replaces itself."""
        name = self.write(rows, number)
        while True:
            record, state = self.state()
            if storage.commit(self.spark, f"{self.folder}/records", record + 1, json.dumps(state | {"parts": state["parts"] | {str(number): name}})):
                return

    def advance(self, name: str, number: int, before: str | None, after: str) -> bool:
        """Take a pass's part and its cursor in one record; not if another pass has moved the cursor meanwhile."""
        while True:
            record, state = self.state()
            if state["cursor"] != before:
                return False
            if storage.commit(self.spark, f"{self.folder}/records", record + 1, json.dumps({"parts": state["parts"] | {str(number): name}, "cursor": after})):
                return True

    def compact(self, least: int = 50) -> bool:
        """The parts of `least` passes and more become one, under the next number; their files go once a record says so."""
        record, state = self.state()
        done = sorted(map(int, state["parts"]))
        if len(done) < least:
            return False
        name = self.write(self.articles(), done[-1] + 1)
        if not storage.commit(self.spark, f"{self.folder}/records", record + 1, json.dumps(state | {"parts": {str(done[-1] + 1): name}})):
            return False
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for old in state["parts"].values():
            fs.delete(path(f"{self.folder}/{old}"), True)
        return True


@dataclass(frozen=True)
class Pass:
    number: int
    start: int
    last: str | None
    sources: int
    articles: int
    failed: int
    timed_out: int
    advanced: bool


def run_pass(store: Store, sources: DataFrame, size: int, crawl: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> Pass:
    """One pass over the next `size` sources (id, pos). crawl(slice) gives articles, and per source id, n and error.

    A source's error is its own; if all sources of the slice failed, nothing is stored and the cursor stays.
    """
    last = store.cursor()
    start = resume_position(sources, last)
    some = circular_slice(sources, start, size)
    articles, results = crawl(some)
    s = summary(results).first()
    number = (store.passes() or [0])[-1] + 1
    end = some.agg(F.max_by("id", "turn").alias("id")).first()["id"]
    moved = bool(s["advance"] and s["sources"]) and store.advance(store.write(articles, number), number, last, end)
    return Pass(number, start, end, s["sources"], s["articles"], s["failed"], s["timed_out"], moved)
