"""Language-model scoring by a weighted backoff automaton.

Tokens are white-space words, ASCII letters lower-cased, and an end token for each text. The states of the
automaton are the root and one state a token, the last one read; its arcs are the n-grams seen in training, and
a failure arc leads from each state to the root. With Dirichlet smoothing of strength `mu` the arc (v, w)
weighs log10((c(vw) + mu P(w)) / (c(v) + mu)), the failure arc of v weighs log10(mu / (c(v) + mu)) and the
root's arc w weighs log10 P(w), P being the add-0.1 unigram estimate; so a text's arcs, read once from left to
right, sum to the log-probability of a proper distribution.

Counts cover all training rows and are exact but for collisions of 64-bit keys, of which a corpus of 1e9 different
n-grams has 0.03. The model is never broadcast: rows are dealt by a hash of the row and its place in its input split,
so that repeated rows part, into groups of bounded bytes; each group sends its distinct n-grams (64-bit keys, sorted blocks) to key buckets,
each bucket adds up the counts and answers every group with the counts it asked for, and the group walks its
part of the automaton. A group is read in slices, so beside its texts it holds its tokens and its distinct n-grams, and
n-grams are counted within it before they are sent. Groups and buckets are as many as each other, and a group's bytes
grow with the root of the input (group_count), so that a block, of one group for one bucket, still holds tens of keys
at 100 TB and the number of blocks stays far under the number of keys.

Defined results: a null text counts as empty, one end token; rows with null ids are scored like any other
(their crc32 is that of the empty text); repeated rows get equal results; with no training rows all counts are
zero; an empty table gives an empty table; only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.llm.common import crc_of_id, shuffle_partitions, staged, text_bytes

ADD = 0.1
MU = 4.0
#: Bytes of texts in a group: at least, at most, and the factor of the input under the root between them.
GROUP_BYTES, MOST_BYTES, ROOT = 16_000_000, 256_000_000, 650
#: Characters of texts that are turned into keys at once.
SLICE_CHARS = 2_000_000
#: Keys of the end token and of the state before a text's first token: no word's hash seed gives them.
END, BEGIN = np.uint64(0xE5D0000000000001), np.uint64(0xBE61000000000002)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def pair_keys(states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """64-bit keys of (state, token) pairs."""
    x = states * _A + tokens * _B
    x = (x ^ (x >> np.uint64(32))) * _A
    return x ^ (x >> np.uint64(29))


def group_count(total_bytes: int, least: int, group_bytes: int | None = None) -> int:
    """Groups, and buckets, for texts of so many bytes; `least` keeps all cores busy."""
    size = group_bytes or min(MOST_BYTES, max(GROUP_BYTES, int((total_bytes * ROOT) ** 0.5)))
    return max(least, -(-total_bytes // size), 1)


def token_keys(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tokens, each text closed by END, and the number of tokens of each text."""
    from itertools import repeat

    import xxhash

    digest = xxhash.xxh64_intdigest
    parts, lengths = [], np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        row = np.empty(len(words) + 1, np.uint64)
        row[:-1] = np.fromiter(map(digest, words, repeat(7)), np.uint64, len(words))
        row[-1] = END
        parts.append(row)
        lengths[i] = len(row)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), lengths


def states_before(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The state before each token: the token before it, BEGIN at a text's start."""
    states = np.empty_like(tokens)
    states[1:] = tokens[:-1]
    states[np.cumsum(lengths) - lengths] = BEGIN
    return states


class Tally:
    """Sorted distinct keys and their counts, added in parts; parts are merged when they outgrow what is merged."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.parts: list = []
        self.waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.waiting += len(keys)
        if self.waiting > 1_000_000 + len(self.keys):
            self.merge()

    def merge(self) -> "Tally":
        if self.parts:
            keys = np.concatenate([self.keys, *(k for k, _ in self.parts)])
            counts = np.concatenate([self.counts, *(c for _, c in self.parts)])
            by = np.argsort(keys, kind="stable")
            keys, counts = keys[by], counts[by]
            first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
            self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
            self.parts, self.waiting = [], 0
        return self


def slices(texts: list[str | None], most: int) -> list[tuple[int, int]]:
    """Ranges of neighbouring texts of about `most` characters; a longer text is a range of its own."""
    out, lo, size = [], 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > most:
            out.append((lo, i))
            lo, size = i, 0
        size += n
    return [*out, (lo, len(texts))] if texts else out


class Automaton:
    """The part of the weighted backoff automaton that one group of texts can reach.

    Unigram and bigram counts are arrays beside sorted key arrays. `weights` gives, for each step of the texts
    read from left to right, the weight of the arc taken, or of the failure arc and the root's arc together.
    """

    def __init__(self, total: int, distinct: int, starts: int, mu: float = MU):
        self.scale = total + ADD * (distinct + 1)
        self.starts, self.mu = starts, mu

    def root(self, count: np.ndarray) -> np.ndarray:
        return (count + ADD) / self.scale

    def weights(self, state_count: np.ndarray, pair_count: np.ndarray, token_count: np.ndarray) -> np.ndarray:
        root = self.root(token_count)
        arc = np.log10((pair_count + self.mu * root) / (state_count + self.mu))
        fail = np.log10(self.mu / (state_count + self.mu)) + np.log10(root)
        return np.where(pair_count > 0, arc, fail)


def _blocks(keys: np.ndarray, counts: np.ndarray, buckets: int):
    """(bucket, keys, counts) blocks; keys are sorted and distinct."""
    of = (keys % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(of, kind="stable")
    edges = np.searchsorted(of[by], np.arange(buckets + 1))
    for b in range(buckets):
        some = by[edges[b] : edges[b + 1]]
        if len(some):
            yield b, keys[some], counts[some]


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as they need: 1, 2, 4 or 8."""
    top = int(counts.max()) if len(counts) else 0
    return counts.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if top <= np.iinfo(t).max)).tobytes()


def _wide(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, f"<u{len(blob) // n}").astype("<i8")


def _tallied(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(at[train], minlength=len(distinct)).astype("<i8")


def totals(df: DataFrame, buckets: int) -> tuple[int, int, int]:
    """Training tokens, distinct training tokens, training texts, over df(train, text)."""

    def send(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4000):
                part = batch.slice(lo, 4000)
                texts = [t for t, use in zip(part.column(1).to_pylist(), part.column(0).to_pylist()) if use]
                tokens, _ = token_keys(texts)
                keys, counts = np.unique(tokens, return_counts=True)
                found = list(_blocks(keys, counts.astype("<i8"), buckets))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1].tobytes() for f in found], pa.binary()), pa.array([int(f[2].sum()) for f in found], pa.int64()), pa.array([int(f[2][f[1] == END].sum()) for f in found], pa.int64())],
                    names=["bucket", "keys", "n", "ends"],
                )

    def count(table: pa.Table) -> pa.Table:
        keys = np.unique(np.frombuffer(b"".join(table["keys"].to_pylist()), "<u8"))
        return pa.table({"n": [sum(table["n"].to_pylist())], "v": [len(keys)], "ends": [sum(table["ends"].to_pylist())]})

    sums = df.select("train", "text").mapInArrow(send, "bucket int, keys binary, n long, ends long").groupBy("bucket").applyInArrow(count, "n long, v long, ends long")
    r = sums.agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.sum("ends").alias("ends")).first()
    return int(r["n"] or 0), int(r["v"] or 0), int(r["ends"] or 0)


def dealt(df: DataFrame, id_col: str, text_col: str, held_out: str, groups: int) -> DataFrame:
    """id, text, held_out and the group of each row; equal rows are dealt apart by their places."""
    return (
        df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), crc_of_id(F.col(id_col)).alias("__crc"))
        .select("id", "text", F.expr(held_out).alias("held_out"), F.pmod(F.xxhash64("id", "__crc", "text", F.monotonically_increasing_id()), F.lit(groups)).cast("int").alias("part"))
    )


def score(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    held_out: str = "pmod(__crc, 10) = 0",
    mu: float = MU,
    group_bytes: int | None = None,
    slice_chars: int = SLICE_CHARS,
) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = df.sparkSession
    id_type = df.schema[id_col].dataType.simpleString()
    groups = group_count(text_bytes(df, text_col), shuffle_partitions(spark), group_bytes)
    rows = dealt(df, id_col, text_col, held_out, groups)
    total, distinct, starts = totals(rows.select((~F.col("held_out")).alias("train"), "text"), groups)
    automaton = Automaton(total, distinct, starts, mu)

    def ask(table: pa.Table) -> pa.Table:
        texts, held = table["text"].to_pylist(), np.array(table["held_out"].to_pylist(), bool)
        part, tallies = table["part"][0].as_py(), (Tally(), Tally())
        for lo, hi in slices(texts, slice_chars):
            tokens, lengths = token_keys(texts[lo:hi])
            train = np.repeat(~held[lo:hi], lengths)
            for tally, keys in zip(tallies, (tokens, pair_keys(states_before(tokens, lengths), tokens))):
                tally.add(*_tallied(keys, train))
        out = []
        for kind, tally in enumerate(tallies, 1):
            tally.merge()
            out += [(b, part, kind, k.tobytes(), _narrow(c)) for b, k, c in _blocks(tally.keys, tally.counts, groups)]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "part", "kind", "keys", "counts"])

    def add_up(table: pa.Table) -> pa.Table:
        parts, kinds, blobs = table["part"].to_pylist(), table["kind"].to_pylist(), table["keys"].to_pylist()
        keys = np.frombuffer(b"".join(blobs), "<u8")
        counts = np.concatenate([_wide(c, len(b) // 8) for c, b in zip(table["counts"].to_pylist(), blobs)])
        _, at = np.unique(keys, return_inverse=True)
        sums = np.bincount(at, counts).astype("<i8")[at]  # for each asked key, its total
        edges = np.cumsum([0, *(len(b) // 8 for b in blobs)])
        answers = [_narrow(sums[lo:hi]) for lo, hi in zip(edges, edges[1:])]
        return pa.table([pa.array(parts, pa.int32()), pa.array(kinds, pa.int32()), table["bucket"].combine_chunks(), pa.array(answers, pa.binary())], names=["part", "kind", "bucket", "totals"])

    names = ["id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def walk(texts: pa.Table, answers: pa.Table) -> pa.Table:
        replies = {(k, b): t for k, b, t in zip(answers["kind"].to_pylist(), answers["bucket"].to_pylist(), answers["totals"].to_pylist())}
        bodies, runs, tallies = texts["text"].to_pylist(), [], (Tally(), Tally())
        for lo, hi in slices(bodies, slice_chars):
            tokens, lengths = token_keys(bodies[lo:hi])
            runs.append((tokens, lengths))
            for tally, keys in zip(tallies, (tokens, pair_keys(states_before(tokens, lengths), tokens))):
                distinct = np.unique(keys)
                tally.add(distinct, np.zeros(len(distinct), np.int64))
        del bodies

        def totals_of(kind: int, known: np.ndarray) -> np.ndarray:
            """The total of each known key: answers lie bucket by bucket, in each in the order of the keys."""
            bucket = (known % np.uint64(groups)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            some, n = np.unique(bucket, return_counts=True)
            of = np.zeros(len(known), np.int64)
            of[by] = np.concatenate([_wide(replies[kind, b], k) for b, k in zip(some.tolist(), n.tolist())])
            return of

        known = [t.merge().keys for t in tallies]
        found = [totals_of(kind, keys) for kind, keys in enumerate(known, 1)]
        columns = []
        for tokens, lengths in runs:
            keys, at = np.unique(tokens, return_inverse=True)
            c = found[0][np.searchsorted(known[0], keys)][at]
            keys, at = np.unique(pair_keys(states_before(tokens, lengths), tokens), return_inverse=True)
            both = found[1][np.searchsorted(known[1], keys)][at]
            before = np.empty_like(c)
            before[1:] = c[:-1]
            starts_at = np.cumsum(lengths) - lengths
            before[starts_at] = automaton.starts
            steps, base = automaton.weights(before, both, c), np.log10(automaton.root(c))
            columns.append((lengths, *(np.add.reduceat(x, starts_at) for x in ((c > 0).astype(np.int64), base, steps))))
        return pa.table([texts["id"], texts["held_out"], *(pa.array(np.concatenate(x)) for x in zip(*columns))], names=names)

    answers = (
        rows.groupBy("part").applyInArrow(ask, "bucket int, part int, kind int, keys binary, counts binary")
        .groupBy("bucket").applyInArrow(add_up, "part int, kind int, bucket int, totals binary")
    )
    scored = rows.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(
        walk, f"id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
