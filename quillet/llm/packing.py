"""Bound-certified best-fit packing of token sequences.

Each document is tokenised once, ended by a separator, and cut into pieces only where it is longer than a
sequence. Pieces are dealt by a stored row number into partitions; each partition packs its pieces best-fit
decreasing and computes dual-feasible-function lower bounds (Martello-Toth, Fekete-Schepers) of its bin count. A
partition whose count equals the best of them is certified: only its emptiest bin leaves it. In partitions with a
gap, every bin is opened that has more than `slack` of a sequence free (0.005: more than ten tokens of 2048; what is fuller
could take in next to nothing). The pieces of open bins are exchanged into fewer partitions and packed again,
as long as a round removes at least LEAST_GAIN of the open sequences; a round that does not is dropped, and the
bins it would have repacked stay. certificate() holds the whole result against the bound of all lengths.

Defined results: a null or empty text is one piece holding the separator alone; repeated rows and rows with
equal or null ids are separate documents, dealt apart; ties fall in the order of (id, piece); an empty table gives
an empty table; only the id and text columns are read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.llm.common import give_back, shuffle_partitions, staged, unstage

#: Pre-tokens, and words in other scripts, whose ids a worker keeps.
KEPT_TOKENS, KEPT_WORDS = 400_000, 100_000
#: Characters of texts that are split before their pre-tokens are looked up together.
RUN_CHARS = 16_000
#: A round must remove this part of the open sequences to be kept.
LEAST_GAIN = 0.001
#: The lower bound tries functions that count in halves to so manieth parts of a sequence.
MOST_PARTS = 64

#: Latin letters whose lower case no neighbour changes, and signs that are neither letters nor numbers; all of them stay as they
#: are when normalised.
_LATIN = "À-ÖØ-öø-įı-ňŊ-ž"
_SIGNS = "¡-©«-±´¶-¸»¿×÷‐-‧‰-⁞€"
_PLAIN = re.compile(rf"[\x00-\x7e{_LATIN}{_SIGNS}]*")
#: Fixed pattern: the tokenizer's pre-tokens in lower-case plain text.
_LETTER = "a-zß-öø-ž"
_PRETOKEN = re.compile(rf"[{_LETTER}]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^ \t-\r0-9{_LETTER}]+")


def _byte_signs() -> dict[int, str]:
    """The sign that byte-level BPE writes for each byte: printable ones stand for themselves, others follow from U+0100 on."""
    own = {b for lo, hi in ((33, 126), (161, 172), (174, 255)) for b in range(lo, hi + 1)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in own else next(rest)) for b in range(256)}


class Tokenizer:
    """ids of a text as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never joins across it or across pre-tokens, so a text's ids are those of its
    pre-tokens in turn; each distinct one is encoded once in many. Words with signs outside plain Latin text go
    through the library whole.
    """

    def __init__(self, path: str | None = None):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path or public_tokenizers.path("word_bpe_49k.json"))
        self.model, self.signs = self.library.model, _byte_signs()
        self.four = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size())]
        self.tokens: dict[str, bytes] = {}
        self.words: dict[bytes, bytes] = {}

    def _plain(self, texts: list[str]) -> list[bytes]:
        split = [_PRETOKEN.findall(t.lower()) for t in texts]
        known, tokenize, signs, four = self.tokens, self.model.tokenize, self.signs, self.four
        distinct = set().union(*split)
        fresh = distinct.difference(known)
        if len(known) + len(fresh) > KEPT_TOKENS:
            known.clear()
            fresh = distinct
        for t in fresh:
            written = t if t.isascii() and t.isalnum() else t.encode().decode("latin-1").translate(signs)
            known[t] = b"".join([four[x.id] for x in tokenize(written)])
        return [b"".join(map(known.__getitem__, tokens)) for tokens in split]

    def _other(self, text: str) -> bytes:
        """Word by word, as ASCII white space splits them."""
        words, known = text.encode("utf-8", "surrogatepass").split(), self.words
        distinct = list(dict.fromkeys(words))
        fresh = [w for w in distinct if w not in known]
        if len(known) + len(fresh) > KEPT_WORDS:
            known.clear()
            fresh = distinct
        whole = []
        for w in fresh:
            t = w.decode("utf-8", "surrogatepass")
            if _PLAIN.fullmatch(t) and "<|" not in t:
                known[w] = self._plain([t])[0]
            else:
                whole.append((w, t))
        for i in range(0, len(whole), 4096):
            part = whole[i : i + 4096]
            for (w, _), e in zip(part, self.library.encode_batch_fast([t for _, t in part], add_special_tokens=False)):
                known[w] = np.array(e.ids, "<u4").tobytes()
        return b"".join(map(known.__getitem__, words))

    def encode(self, texts: list[str]) -> list[bytes]:
        """ids of each text; texts go through in runs of about RUN_CHARS."""
        out, run, size = [b""] * len(texts), [], 0
        for i, t in enumerate(texts):
            # a special token's mark may stand anywhere
            if not _PLAIN.fullmatch(t) or "<|" in t:
                out[i] = self._other(t)
                continue
            run.append(i)
            size += len(t)
            if size > RUN_CHARS:
                self._fill(out, run, texts)
                run, size = [], 0
        self._fill(out, run, texts)
        return out

    def _fill(self, out: list[bytes], run: list[int], texts: list[str]) -> None:
        for i, ids in zip(run, self._plain([texts[i] for i in run])):
            out[i] = ids


_tokenizers: dict = {}


def tokenizer(path: str | None) -> Tokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer(path)
    return _tokenizers[path]


def pieces(df: DataFrame, id_col: str, text_col: str, capacity: int, path: str | None, end_id: int) -> DataFrame:
    """id, piece, start, length and ids_crc32 of every document's pieces."""
    id_type = df.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        t = tokenizer(path)
        width = 4 * capacity
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                of, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(t.encode([x or "" for x in batch.column(1).to_pylist()])):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), width)):
                        part = ids[at : at + width]
                        of.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=[id_col, "piece", "start", "length", "ids_crc32"],
                )
        give_back()

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths, capacity: int) -> int:
    return bound_of(np.bincount(np.asarray(lengths, np.int64), minlength=capacity + 1)[: capacity + 1], capacity)


def bound_of(counts: np.ndarray, capacity: int) -> int:
    """The best dual-feasible-function bound of counts by length: Martello-Toth L2 over thresholds up to half the capacity, and
    the rounding functions u(k), under which a length counts 1/k-ths of a sequence."""
    size = np.arange(capacity + 1)
    n, total = np.cumsum(counts), np.cumsum(counts * size)
    best = -(-int(total[-1]) // capacity)
    half = capacity // 2
    for t in range(0, half + 1):
        large = int(n[capacity] - n[capacity - t])  # each is alone
        middle = int(n[capacity - t] - n[half])  # no two fit together
        middle_size = int(total[capacity - t] - total[half])
        small = int(total[half] - (total[t - 1] if t else 0))
        best = max(best, large + middle + max(0, -(-(small - (middle * capacity - middle_size)) // capacity)))
    for k in range(1, MOST_PARTS + 1):
        parts = np.where((k + 1) * size % capacity == 0, k * size, (k + 1) * size // capacity * capacity)
        best = max(best, -(-int((counts * parts).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each length, and the bins' rooms; the fullest bin with room takes the next longest."""
    lengths = np.asarray(lengths, np.int64)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # rooms that some bin has
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = mask >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                mask ^= 1 << r
        else:
            b, r = len(room), capacity
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - r
        left = r - size
        room[b] = left
        if left:
            by_room[left].append(b)
            mask |= 1 << left
    return bins, offsets, room


_PIECE = ("piece", "start", "length", "ids_crc32")


def _pack_round(src: DataFrame, id_col: str, capacity: int, groups: int, round_no: int, last: bool, slack: float) -> DataFrame:
    """One round over src: rows get sequence_id, offset and their partition's certificate; rows of open bins can go on."""
    id_type = src.schema[id_col].dataType.simpleString()
    names = ["rid", id_col, *_PIECE, "sequence_id", "offset", "part_sequences", "part_lower_bound", "certified", "open"]

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([(id_col, "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = table["length"].to_numpy()
        bins, offsets, room = best_fit_decreasing(lengths, capacity)
        left, bound, n = np.array(room, np.int64), lower_bound(lengths, capacity), len(table)
        sure = len(room) == bound
        take = left > capacity * slack
        if sure:  # the rests of partitions may fit together
            take &= np.arange(len(left)) == left.argmax()
        if last:
            take[:] = False
        number = (np.int64(round_no) << 56) + (np.int64(table["part"][0].as_py()) << 28)
        return pa.Table.from_arrays(
            [
                *(table[c] for c in names[:6]), pa.array(number + bins), pa.array(offsets), pa.array(np.full(n, len(room))), pa.array(np.full(n, bound)),
                pa.array(np.full(n, sure)), pa.array(take[bins]),
            ],
            names=names,
        )

    dealt = src.select("rid", id_col, *_PIECE, F.pmod(F.xxhash64("rid", F.lit(round_no)), F.lit(groups)).alias("part"))
    return dealt.groupBy("part").applyInArrow(
        pack,
        f"rid long, `{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, "
        "part_sequences long, part_lower_bound long, certified boolean, open boolean",
    )


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    tokenizer_path: str | None = None,
    end_id: int = 0,
    group_rows: int = 100_000,
    slack: float = 0.005,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and of the partition that packed it its
    number of sequences, their lower bound and whether the two are equal (certified)."""
    spark = df.sparkSession
    out = [id_col, *_PIECE, "sequence_id", "offset", "part_sequences", "part_lower_bound", "certified"]
    cut = staged(pieces(df, id_col, text_col, capacity, tokenizer_path, end_id).withColumn("rid", F.monotonically_increasing_id()), "pieces")
    one = F.lit(1).cast("long")
    full = cut.where(F.col("length") == capacity).select(
        id_col, *_PIECE, (F.lit(1 << 62) + F.col("rid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        one.alias("part_sequences"), one.alias("part_lower_bound"), F.lit(True).alias("certified"),
    )
    done, todo = [full], cut.where(F.col("length") < capacity)
    rows, sequences, round_no = todo.count(), None, 1
    groups = max(1, -(-rows // group_rows), min(shuffle_partitions(spark), rows // 5_000))
    while rows:
        packed = staged(_pack_round(todo, id_col, capacity, groups, round_no, groups == 1, slack), f"packed{round_no}")
        leads = F.col("offset") == 0
        found = packed.agg(F.count_if(leads).alias("n"), F.count_if(leads & F.col("open")).alias("open"), F.count_if("open").alias("rows")).first()
        if sequences is not None and sequences - found["n"] < max(1, LEAST_GAIN * sequences):
            unstage(packed)
            done.append(todo.select(*out))  # as the round before left them
            break
        done.append(packed.where(~F.col("open")).select(*out))
        todo, rows, sequences, round_no = packed.where("open"), found["rows"], found["open"], round_no + 1
        groups = 1 if rows <= group_rows else max(2, min(groups // 2, -(-rows // group_rows)))
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result


def certificate(packed: DataFrame, capacity: int = 2048) -> tuple[int, int]:
    """Sequences used, and the lower bound of any packing of the same pieces: one row for each length comes to the driver."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in packed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["length"]] = r["n"]
    used = packed.where("offset = 0").count()
    return used, bound_of(counts, capacity)
