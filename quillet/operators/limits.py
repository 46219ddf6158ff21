"""Token buckets over a batch of requests.

A bucket starts full, refills continuously, and a refused request spends nothing, so the outcome depends on the order.
Requests are dealt by ranges of (key, time), so that the requests of one key, or of a limit on the service as a whole, lie in many tasks.
A task folds the keys that begin in it at once. Of its first key, which may go on from the task before, it does not
know the tokens; it carries all of them along instead: the tokens after some requests as a function of those before is
made of pieces that grow with the tokens before or stay the same (in a flood about as many as the burst has tokens; a
pause that fills the bucket makes them one). The functions of a key, one for each task, are chained in order, which tells every task the tokens it begins with, and the first keys
are folded again with these. Tokens are whole numbers of a unit in which a microsecond refills a whole number, so
that a chain and a single fold agree to the last unit.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.sources import storage

_FUNCTION = "struct<first:bigint,last:bigint,rows:bigint,at:array<bigint>,value:array<bigint>,grows:array<bigint>>"


def units(per_second: float, burst: float) -> tuple[int, int, int]:
    """Units that a microsecond refills, units of a token, and units of a full bucket."""
    rate = Fraction(per_second).limit_denominator(10**6)
    token = rate.denominator * 10**6
    return rate.numerator, token, int(Fraction(burst).limit_denominator(10**6) * token)


class Carried:
    """The tokens after some requests as a function of those before, from 0 to a full bucket: from at[i] on they are value[i],
    and more by what the tokens before are over at[i] where grows[i] is 1."""

    def __init__(self, token: int, full: int):
        self.token, self.full = token, full
        self.at, self.value, self.grows = np.array([0]), np.array([0]), np.array([1])

    def _cut(self, level: int) -> None:
        """Begin a piece wherever a growing one reaches the level."""
        ends = np.append(self.at[1:], self.full + 1)
        inside = np.flatnonzero((self.grows == 1) & (self.value < level) & (self.value + ends - self.at > level))
        if len(inside):
            self.at = np.insert(self.at, inside + 1, self.at[inside] + level - self.value[inside])
            self.value = np.insert(self.value, inside + 1, level)
            self.grows = np.insert(self.grows, inside + 1, 1)

    def request(self, gain: int) -> None:
        if gain >= self.full:  # full whatever was before
            self.at, self.value, self.grows = np.array([0]), np.array([self.full]), np.array([0])
        else:
            self.value = self.value + gain
            self._cut(self.full)
            over = self.value >= self.full
            if over.any():
                self.value[over], self.grows[over] = self.full, 0
        self._cut(self.token)
        self.value = self.value - self.token * (self.value >= self.token)
        self._join()

    def _join(self) -> None:
        """Make one of neighbouring pieces that go on in each other."""
        if len(self.at) > 1:
            same = (self.grows[1:] == self.grows[:-1]) & (self.value[1:] - self.value[:-1] == self.grows[1:] * (self.at[1:] - self.at[:-1]))
            if same.any():
                kept = np.append(True, ~same)
                self.at, self.value, self.grows = self.at[kept], self.value[kept], self.grows[kept]

    def requests(self, gains: np.ndarray) -> None:
        """request() for each gain, of a full bucket at most; stretches in which no bucket fills are taken at once."""
        most = max((1 << 61) // (self.full + self.token), 1)  # sums stay within 64 bits
        at, step = 0, 64
        while at < len(gains):
            if len(self.at) == 1 and not self.grows[0]:  # known tokens
                tokens = int(self.value[0])
                for gain in gains[at:].tolist():
                    tokens = min(self.full, tokens + gain)
                    tokens -= self.token * (tokens >= self.token)
                self.value = np.array([tokens])
                return
            some = gains[at : at + min(step, most)]
            taken = self._stretch(some)
            step = min(2 * step, 1 << 14) if taken == len(some) else 64
            at += taken
            if taken < len(some):
                self.request(int(gains[at]))
                at += 1

    def _stretch(self, gains: np.ndarray) -> int:
        """Take the requests before the first at which a bucket may be full, and tell how many these are.

        Of tokens v, with every request charged, v + low is the least that is left. Where that is below zero, as many requests are
        refused as bring it to zero or more, and no others.
        """
        charged = np.cumsum(gains) - self.token * np.arange(1, len(gains) + 1)
        low = np.minimum.accumulate(charged)
        highest = int((self.value + self.grows * (np.append(self.at[1:], self.full + 1) - self.at - 1)).max())
        # tokens before a request: those of a bucket that refused none, or less than a token after the last refusal and what came since
        before = charged + self.token + np.maximum(highest, self.token - 1 - np.append(0, low[:-1]))
        full = np.flatnonzero(before >= self.full)
        n = int(full[0]) if len(full) else len(gains)
        if n:
            least, change = int(low[n - 1]), int(charged[n - 1])
            first = max(0, -((least + highest) // self.token))
            for level in range(-least - first * self.token, int(self.value.min()), -self.token):
                self._cut(level)
            self.value = self.value + change + self.token * np.maximum(0, -((self.value + least) // self.token))
            self._join()
        return n


def buckets(requests: DataFrame, key: str, per_second: float, burst: float, ts: str = "ts", tie: str = "event_id", number: bool = False) -> DataFrame:
    """All columns of requests, allowed and wait_s, and with `number` nth, the request's place among its key's; a rate or burst
    of zero or less allows all."""
    if not number and (per_second <= 0 or burst <= 0):
        return requests.withColumns({"allowed": F.lit(True), "wait_s": F.lit(0.0)})
    gain, token, full = units(per_second, burst)
    rows = requests.withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp")))
    names = rows.columns
    k, t = names.index(key), names.index("__us")
    added = {"allowed": F.lit(None).cast("boolean"), "wait_s": F.lit(None).cast("double"), "nth": F.lit(None).cast("long"), "__part": F.lit(None).cast("int")}
    judged = rows.withColumns(added)
    schema = judged.withColumn("__function", F.lit(None).cast(_FUNCTION)).schema
    for field in schema:
        field.nullable = True

    def wait(tokens: int) -> float:
        return (token - tokens) / gain / 1e6

    def fold(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        part, arrow = TaskContext.get().partitionId(), to_arrow_schema(schema)
        owner, runs, carried, first, last, n, tokens = None, 0, None, 0, 0, 0, 0
        gains: list[int] = []  # of the first run's requests that are not in its function yet

        def told():
            """A row that tells of the run that ends: its function, or the tokens it ends with."""
            f = carried or Carried(token, full)
            if carried is None:
                f.value, f.grows = np.array([tokens]), np.array([0])
            row = {c: None for c in arrow.names} | {
                key: owner[0], "__part": part, "__function": {"first": first, "last": last, "rows": n, "at": f.at.tolist(), "value": f.value.tolist(), "grows": f.grows.tolist()}
            }
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            allowed, waits, nth = [], [], []
            ended = None
            for name, now in zip(batch.column(k).to_pylist(), batch.column(t).to_pylist()):
                if owner is None or name != owner[0]:
                    if runs == 1:
                        carried.requests(np.array(gains, np.int64))
                        gains.clear()
                        ended = told()
                    owner, runs, first, n, tokens = (name,), runs + 1, now, 0, full
                    carried = Carried(token, full) if runs == 1 else None
                    last = now
                refill = (now - last) * gain
                last, n = now, n + 1
                nth.append(n)
                if carried is not None:
                    gains.append(min(refill, full))
                    allowed.append(None)
                    waits.append(None)
                    continue
                tokens = min(full, tokens + refill)
                ok = tokens >= token
                tokens -= token * ok
                allowed.append(ok)
                waits.append(0.0 if ok else wait(tokens))
            if carried is not None:
                carried.requests(np.array(gains, np.int64))
                gains.clear()
            size = batch.num_rows
            more = [pa.array(allowed, pa.bool_()), pa.array(waits, pa.float64()), pa.array(nth, pa.int64()), pa.array([part] * size, pa.int32()), pa.nulls(size, arrow.field("__function").type)]
            yield pa.RecordBatch.from_arrays([*(c.cast(arrow.field(i).type) for i, c in enumerate(batch.columns)), *more], schema=arrow)
            if ended is not None:
                yield ended
        if owner is not None:
            yield told()

    dealt = rows.repartitionByRange(key, "__us", tie).sortWithinPartitions(key, "__us", tie)
    done = storage.staged(dealt.mapInArrow(fold, schema), "buckets")
    kind = rows.schema[key].dataType.simpleString()

    def chain(batches):
        """The tokens and the number of requests with which a key goes on in each task."""
        owner, tokens, before, last = None, 0, 0, 0
        for batch in batches:
            out = []
            for name, part, f in zip(*(c.to_pylist() for c in batch.columns)):
                if owner is None or name != owner[0]:
                    owner, tokens, before, last = (name,), full, 0, f["first"]
                entry = min(full, tokens + (f["first"] - last) * gain)
                out.append((name, part, entry, before))
                i = int(np.searchsorted(f["at"], entry, "right")) - 1
                tokens = f["value"][i] + f["grows"][i] * (entry - f["at"][i])
                before, last = before + f["rows"], f["last"]
            types = batch.column(0).type, pa.int32(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(list(zip(*out)) or [()] * 4, types)], names=["owner", "part", "entry", "before"])

    told_of = done.where("__function IS NOT NULL").select(key, "__part", "__function")
    entries = told_of.repartition(key).sortWithinPartitions(key, "__part").mapInArrow(chain, f"owner {kind}, part int, entry long, before long")
    open_ = done.where("allowed IS NULL AND __function IS NULL")
    # entries of first runs: a row a task
    joined = open_.join(entries, F.col(key).eqNullSafe(F.col("owner")) & (F.col("__part") == F.col("part"))).select(*judged.columns, "entry", "before")
    again = joined.repartition("__part").sortWithinPartitions("__part", "__us", tie)
    at, kept = {c: i for i, c in enumerate(again.columns)}, judged.columns

    def refold(batches):
        part, tokens, last = None, 0, 0
        for batch in batches:
            allowed, waits, nth = [], [], []
            for p, now, entry, n, before in zip(*(batch.column(at[c]).to_pylist() for c in ("__part", "__us", "entry", "nth", "before"))):
                if p != part:
                    part, tokens, last = p, entry, now
                tokens = min(full, tokens + (now - last) * gain)
                last = now
                ok = tokens >= token
                tokens -= token * ok
                allowed.append(ok)
                waits.append(0.0 if ok else wait(tokens))
                nth.append(n + before)
            mine = {"allowed": pa.array(allowed, pa.bool_()), "wait_s": pa.array(waits, pa.float64()), "nth": pa.array(nth, pa.int64())}
            yield pa.RecordBatch.from_arrays([mine.get(c, batch.column(at[c])) for c in kept], names=kept)

    first_runs = again.mapInArrow(refold, judged.schema)
    every = done.where("allowed IS NOT NULL").drop("__function").unionByName(first_runs)
    return every.drop("__us", "__part", *([] if number else ["nth"]))


def two_level(requests: DataFrame, key: str, own: tuple[float, float], common: tuple[float, float]) -> DataFrame:
    """Requests pass their caller's bucket first; only those spend from the common one. (per minute, burst) pairs."""
    first = buckets(requests, key, own[0] / 60, own[1])
    refused = first.where("NOT allowed")
    passed = first.where("allowed").drop("allowed", "wait_s").withColumn("__all", F.lit(0))
    return buckets(passed, "__all", common[0] / 60, common[1]).drop("__all").unionByName(refused)


def throttle_log(judged: DataFrame, per_second: float, burst: float) -> DataFrame:
    """Log lines of refusals, themselves bounded by a bucket, each with the refusals so far."""
    refused = judged.where("NOT allowed").select("event_id", "ts", "user_id", F.lit(0).alias("__all"))
    lines = buckets(refused, "__all", per_second, burst, number=True)
    return lines.where("allowed").select("event_id", "user_id", F.col("nth").alias("refused_so_far"))
