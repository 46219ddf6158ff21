"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillet.operators import discover
from quillet.sources.storage import shared_folder


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rocks(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB, which processors with timers need; a running query keeps what it began with."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class Buckets(StatefulProcessor):
    """A key's tokens and last time; a timer drops a bucket that is full again."""

    def __init__(self, key: str, per_second: float, burst: float):
        self.key, self.per_second, self.burst = key, per_second, float(burst)
        self.idle_ms = int(burst / per_second * 1000) + 600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("bucket", "tokens double, last long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        tokens, last = self.held.get() if self.held.exists() else (self.burst, None)
        allowed = []
        for now in frame["ts"].astype("datetime64[us]").astype("int64"):
            tokens = min(self.burst, tokens + ((now - last) / 1e6 * self.per_second if last is not None else 0))
            last = now
            allowed.append(tokens >= 1)
            tokens -= tokens >= 1
        self.held.update((float(tokens), int(last)))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(max(last // 1000 + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({self.key: pd.Series([key[0]] * len(frame), dtype=object), "event_id": frame["event_id"].to_numpy(), "allowed": allowed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        self.held.clear()
        yield from ()

    def close(self) -> None:
        pass


class Bursts(StatefulProcessor):
    """A key's rows that a later one may still follow within the gap. Once the watermark is past a row and the gap, it is the last
    of its burst or not, in whatever order the rows came."""

    def __init__(self, key: str, gap_us: int):
        self.key, self.gap_us = key, gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "at long, id long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        first = None
        for frame in rows:
            at = frame["ts"].astype("datetime64[us]").astype("int64")
            self.rows.appendList(list(zip(at.tolist(), frame["event_id"].tolist())))
            first = min(at.min(), first) if first is not None else at.min()
        if first is not None:
            self._wake(int(first), list(self.handle.listTimers()))
        yield from ()

    def _wake(self, at: int, timers: list[int]) -> None:
        """A key has one timer, at the first of its rows that can be settled: one call settles all rows that the watermark has passed."""
        due = (at + self.gap_us) // 1000 + 1
        if not timers or due < min(timers):
            for later in timers:
                self.handle.deleteTimer(later)
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(self.rows.get()) if self.rows.exists() else []
        done = [r for r in held if r[0] + self.gap_us < passed]
        last = [r[1] for i, r in enumerate(held[: len(done)]) if i + 1 == len(held) or held[i + 1][0] > r[0] + self.gap_us]
        if held[len(done) :]:
            if done:
                self.rows.put(held[len(done) :])
            self._wake(held[len(done)][0], [])
        else:
            self.rows.clear()
        if last:
            yield pd.DataFrame({self.key: pd.Series([key[0]] * len(last), dtype=object), "event_id": pd.Series(last, dtype="int64")})

    def close(self) -> None:
        pass


def limited(requests: DataFrame, key: str, per_second: float, burst: float, late: str = "1 day") -> DataFrame:
    """Token buckets as keyed state: tokens and last time, in event time. Rows are sorted inside a micro-batch.

    A key is dropped once the watermark is past the time at which its bucket is full again and ten minutes more; a new
    bucket starts full, so dropping it changes nothing.
    """
    rocks(requests.sparkSession)
    kind = requests.schema[key].dataType.simpleString()
    at = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select(key, "ts", "event_id")
    schema = f"{key} {kind}, event_id long, allowed boolean"
    return at.groupBy(key).transformWithStateInPandas(Buckets(key, per_second, burst), schema, "Append", "EventTime")


def bursts(requests: DataFrame, key: str, gap_seconds: float, late: str = "1 hour") -> DataFrame:
    """The last rows of bursts, as last_of_bursts() gives them, each as soon as the watermark has closed its burst."""
    rocks(requests.sparkSession)
    kind = requests.schema[key].dataType.simpleString()
    at = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select(key, "ts", "event_id")
    return at.groupBy(key).transformWithStateInPandas(Bursts(key, int(gap_seconds * 1_000_000)), f"{key} {kind}, event_id long", "Append", "EventTime")


def _run(stream: DataFrame, name: str, folder: str, out: str | None = None) -> DataFrame:
    """Write what is available as Parquet in the shared folder and read it back; in a folder of its own a query goes on where it was."""
    out = out or f"{folder}/quillet-{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/rows")


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A table's Parquet files as a stream; a single file is a stream of one. A folder is one whatever its name ends with."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    single = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if single else spark.readStream.schema(schema).parquet(path)


def run_limiter(spark: SparkSession, path: str, per_second: float, burst: float) -> DataFrame:
    return _run(limited(stream_of(spark, path), "user_id", per_second, burst), "limiter", shared_folder(spark))


def run_bursts(spark: SparkSession, path: str, gap_seconds: float, late: str = "1 hour", folder: str | None = None) -> DataFrame:
    return _run(bursts(stream_of(spark, path), "user_id", gap_seconds, late), "bursts", shared_folder(spark), folder)


def run_discovery(spark: SparkSession, path: str, row_of, key: str = "id", folder: str | None = None) -> DataFrame:
    """Micro-batches of articles, each added to a store under its number; a replayed batch replaces itself.

    With a folder of its own a stream that was stopped goes on where it was, and its store keeps what it had.
    """
    base = folder or f"{shared_folder(spark)}/quillet-discover-{uuid.uuid4().hex}"
    stream = stream_of(spark, path)
    store = discover.Store(spark, f"{base}/store", spark.createDataFrame([], row_of(spark.createDataFrame([], stream.schema)).schema))

    def add(batch: DataFrame, number: int) -> None:
        store.add(row_of(batch).dropDuplicates([key]), 2 * number)  # a compaction takes the odd number behind the last

    q = stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    store.compact()
    return store.articles()


def run_windows(spark: SparkSession, path: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of the windows that the watermark has closed."""
    return _run(windowed_counts(stream_of(spark, path), width, late), "windows", shared_folder(spark))


def on_timer(stream: DataFrame, each, folder: str, every: str = "1 hour"):
    """Starts a pass over what is new at every interval; a late trigger is told by the query's progress, not skipped."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/state").trigger(processingTime=every).start()


def last_of_bursts(rows: DataFrame, key: str, ts: str, tie: str, gap: str) -> DataFrame:
    """The last row of each burst: of rows of a key that follow one another within the gap, only the newest counts."""
    w = W.partitionBy(key).orderBy(ts, tie)
    nxt = F.lead(ts).over(w)
    return rows.withColumn("__next", nxt).where(F.col("__next").isNull() | (F.col("__next") > F.col(ts) + F.expr(f"INTERVAL {gap}"))).drop("__next")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per window and type, rows later than the watermark left out."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return at.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
