"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

A text's statistics (shares of byte classes, what words begin and end with, lengths, repetitions of words and lines) are
found once, from the whole text, and stored. Standardised, they go through FEATURES cosines of random directions, whose
inner products approximate a Gaussian kernel of width sqrt(number of statistics). Partitions of the labelled rows sum
their part of the normal equations; Spark adds the parts up, and ridge coefficients come from a system of FEATURES + 1
unknowns. Labelled rows that the regression has not seen give the calibration: adjacent violators are pooled in ranges of
raw scores, the pools once more over all ranges, and a raw score is read off between the pools.

What is bounded: the classifier is fitted on about `label_rows` labelled documents at most, those whose ids have the least
hashes; a third of them, by another hash, calibrate. Statistics, and the scores, cover all rows and whole texts.

Defined results: a null text counts as empty and is scored; a document's label is the mean of its labels; labels that are
null, or of no document, teach nothing; rows of one id and equal statistics teach once; without a row to fit on or to calibrate
with, every score is the mean label known, or 0.5; repeated rows have equal scores; an empty table gives an empty
table; only the id and text columns are read.
"""

from __future__ import annotations

import operator
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.llm.common import crc_of_id, give_back, staged, unstage

LABEL_ROWS, FEATURES, RIDGE, THRESHOLD, SEED = 200_000, 256, 1e-4, 0.7, 7
#: Standardised statistics are cut at so many deviations; bytes of a text that are split at once; tasks that fit.
FAR, CHUNK, TASKS = 5.0, 1 << 20, 32

#: Byte classes: white space, lower case, capitals, digits, sentence signs, exclamation marks, other signs, beyond ASCII, control.
SPACE, LOWER, UPPER, DIGIT, SENTENCE, BANG, SIGN, HIGH, CONTROL = range(9)
KINDS = 9


def _classes() -> np.ndarray:
    out = np.full(256, SIGN, np.uint8)
    out[:32] = CONTROL
    out[127] = CONTROL
    out[128:] = HIGH
    out[[9, 10, 11, 12, 13, 32]] = SPACE
    out[48:58], out[65:91], out[97:123] = DIGIT, UPPER, LOWER
    out[[ord(c) for c in ".,;:?'\"-()"]] = SENTENCE
    out[ord("!")] = BANG
    return out


_CLASS = _classes()


def statistics(text: bytes) -> list[float]:
    """The statistics of a whole text, read in parts that end at white space where they can."""
    pairs = np.zeros(KINDS * KINDS, np.int64)
    words: Counter = Counter()
    again, last, before = 0, None, SPACE
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > CHUNK:
            cut = text.find(b" ", at + CHUNK)
            end = end if cut < 0 else cut
        part = text[at:end]
        kinds = _CLASS[np.frombuffer(part, np.uint8)]
        pairs += np.bincount(np.concatenate([[before], kinds[:-1]]).astype(np.int16) * KINDS + kinds, minlength=KINDS * KINDS)
        found = part.split()
        words.update(found)
        again += sum(map(operator.eq, found, found[1:])) + (bool(found) and found[0] == last)
        last, before = found[-1] if found else last, kinds[-1]
        at = end
    pairs[before * KINDS + SPACE] += 1  # the text's end
    pairs = pairs.reshape(KINDS, KINDS)
    counts, starts, ends = pairs.sum(0), pairs[SPACE], pairs[:, SPACE]
    size, n = max(len(text), 1), sum(words.values())
    lines = [x for x in text.split(b"\n") if x.strip()]
    share = lambda x, of: float(x) / max(of, 1)
    return [
        np.log1p(len(text)), np.log1p(n), np.log1p(len(lines)), np.log1p(share(len(text), n)), np.log1p(share(n, len(lines))),
        *(share(counts[k], size) for k in (LOWER, UPPER, DIGIT, SENTENCE, BANG, SIGN, HIGH, CONTROL)),
        *(share(starts[k], n) for k in (UPPER, DIGIT, SENTENCE, SIGN, HIGH)),
        *(share(ends[k], n) for k in (UPPER, SENTENCE, BANG, SIGN)),
        share(pairs[UPPER, UPPER], size), share(pairs[SIGN, SIGN], size),
        np.log1p(len(words)) / np.log1p(max(n, 1)), share(max(words.values(), default=0), n), share(again, n), share(len(lines) - len(set(lines)), len(lines)),
    ]


SIZE = len(statistics(b""))


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and x, the statistics of the text; stored."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                values = np.array([statistics(t or b"") for t in part.column(1).to_pylist()], np.float32)
                edges = pa.array(np.arange(0, values.size + 1, SIZE, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(edges, pa.array(values.ravel()))], names=["id", "x"])
        give_back()

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return staged(rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, x array<float>"), "statistics")


def matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, SIZE)


class Fourier:
    """Standardised statistics to cosines of random directions, and a constant."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray):
        draw = np.random.default_rng(SEED)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.directions = draw.normal(0, 1 / np.sqrt(SIZE), (SIZE, FEATURES))
        self.phase = draw.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        near = np.clip((x - self.mean) / self.deviation, -FAR, FAR)
        return np.concatenate([np.cos(near @ self.directions + self.phase) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))], 1)


class Model:
    """fourier, ridge coefficients, and the calibration as knots (raw score, share of label 1); without them one score."""

    def __init__(self, fourier: Fourier | None, beta: np.ndarray | None, knots: tuple[np.ndarray, np.ndarray] | None, default: float):
        self.fourier, self.beta, self.knots, self.default = fourier, beta, knots, default

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.knots is None:
            return np.full(len(x), self.default)
        return np.clip(np.interp(self.raw(x), *self.knots), 0.0, 1.0)


def labelled(found: DataFrame, labels: DataFrame, training: Column, id_col: str, label_col: str, label_rows: int) -> DataFrame:
    """x, y and fold of the labelled documents to learn from; stored in a few partitions."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & training)
    known = known.groupBy(F.col(id_col).alias("lid")).agg(F.avg(label_col).alias("y"))
    share = min(1.0, label_rows / max(1, known.count()))
    some = known.where(F.shiftrightunsigned(F.xxhash64("lid"), 11) / float(1 << 53) <= share)
    # some: about label_rows rows at most
    rows = found.join(F.broadcast(some), F.col("id") == F.col("lid")).select("lid", "x", "y").dropDuplicates()
    fold = F.pmod(F.xxhash64("lid", F.lit(1)), F.lit(3))
    return staged(rows.select("x", "y", (fold == 0).alias("calibrates")).repartition(TASKS), "labelled")


def fit(rows: DataFrame) -> Model:
    """The model of labelled rows (x, y, calibrates)."""
    cells = rows.select("calibrates", "y", F.posexplode("x").alias("j", "v"))
    moments = cells.where("NOT calibrates").groupBy("j").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.count(F.lit(1)).alias("n")).orderBy("j").collect()  # SIZE rows
    known = rows.agg(F.avg("y").alias("y"), F.count_if("calibrates").alias("n")).first()
    default = float(known["y"]) if known["y"] is not None else 0.5
    if not moments or not known["n"]:
        return Model(None, None, None, default)
    fourier = Fourier(np.array([r["m"] for r in moments]), np.array([r["s"] for r in moments]))

    def normal(batches):
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            z = fourier(matrix(batch.column(0)))
            total[:, :-1] += z.T @ z
            total[:, -1] += z.T @ batch.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "v"])

    parts = rows.where("NOT calibrates").select("x", "y").mapInArrow(normal, "i int, v array<double>")
    sums = parts.select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()  # FEATURES squared rows
    system = np.zeros((FEATURES + 1, FEATURES + 2))
    system[sums["i"], sums["j"]] = sums["v"]
    ridge = np.eye(FEATURES + 1) * RIDGE * moments[0]["n"]
    ridge[-1, -1] = 0
    beta = np.linalg.lstsq(system[:, :-1] + ridge, system[:, -1], rcond=None)[0]
    model = Model(fourier, beta, None, default)

    def raw(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(matrix(batch.column(0)))), batch.column(1)], names=["raw", "y"])

    scored = rows.where("calibrates").select("x", "y").mapInArrow(raw, "raw double, y double")
    equal = scored.groupBy("raw").agg(F.sum("y").alias("sum"), F.count(F.lit(1)).cast("double").alias("n"))

    def pool(batches):
        pools: list = []
        for batch in batches:
            pools = pooled(pools, zip(*(batch.column(i).to_pylist() for i in (0, 0, 1, 2))))
        if pools:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*pools)], names=["low", "high", "sum", "n"])

    ranges = equal.repartitionByRange(TASKS, "raw").sortWithinPartitions("raw").mapInArrow(pool, "low double, high double, sum double, n double")
    pools = pooled([], (tuple(r) for r in ranges.orderBy("low").collect()))  # no more than the rows that calibrate
    ends = np.array([x for low, high, _, _ in pools for x in (low, high)])
    model.knots = ends, np.repeat([s / n for _, _, s, n in pools], 2)
    return model


def pooled(pools: list, more) -> list:
    """Pools (least and greatest raw score, sum of labels, rows) in ascending order, adjacent violators made one."""
    for low, high, total, n in more:
        while pools and pools[-1][2] * n >= total * pools[-1][3]:
            low, _, s, m = pools.pop()
            total, n = total + s, n + m
        pools.append((low, high, total, n))
    return pools


def apply(found: DataFrame, model: Model) -> DataFrame:
    """id and score of each row of statistics."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(matrix(batch.column(1))))], names=["id", "score"])

    return found.mapInArrow(run, f"id {found.schema['id'].dataType.simpleString()}, score double")


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2."""
    return F.pmod(crc_of_id(id_col), F.lit(4)) == 2


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", label_rows: int = LABEL_ROWS) -> DataFrame:
    """id, held_out, score and predicted of every document; rows that are held out teach nothing."""
    found = measured(docs, id_col, text_col)
    rows = labelled(found, labels, ~held_out(F.col(id_col)), id_col, label_col, label_rows)
    model = fit(rows)
    unstage(rows)
    scored = apply(found, model).withColumnRenamed("id", id_col)
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
