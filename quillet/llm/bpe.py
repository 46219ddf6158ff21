"""Byte-level BPE by overlapping chunk encoding.

Texts longer than chunk_chars are cut into overlapping chunks that are pre-tokenised in parallel tasks; the stitched
pre-tokens are dealt out again in runs that are encoded in parallel tasks, and one task per text digests the runs in
order. Pre-tokenisation has no memory to its left, so where two neighbouring chunks share a boundary they
agree from there on: stitching keeps the left chunk up to the first shared boundary and the right one after
it. Boundaries next to a chunk's cut end are not trusted; where an overlap holds no shared boundary (a run
longer than the overlap) the texts are joined and pre-tokenised on from the last sure boundary, each time over at
least twice as much, so results are exact for any chunk size and even a text without boundaries is read a bounded
number of times. Each pre-token is encoded once per worker and kept; decoding concatenates the bytes
of the ids.

Defined results: null counts as empty (no ids, digests of nothing); repeated rows and repeated or null ids
are separate rows, each with its own result; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The white space of the tokenizer's pattern, spelled out, since libraries differ on U+001C to U+001F.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A boundary this near to a chunk's cut end may change with what follows.
MARGIN = 4
CACHE = 400_000


def pattern(source: str) -> str:
    """The published pattern with its white-space classes spelled out."""
    return source.replace(r"[^\s\p{L}\p{N}]", rf"[^{_WHITE}\p{{L}}\p{{N}}]").replace(r"\S", f"[^{_WHITE}]").replace(r"\s", f"[{_WHITE}]")


class Codec:
    """Encoder and decoder over one rank file; pre-tokens are kept with their ids and bytes."""

    def __init__(self, ranks_path: str | None = None, source: str | None = None):
        import public_tokenizers
        import regex
        import tiktoken

        source = source or public_tokenizers.PATTERN
        with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.split = regex.compile(pattern(source))
        self.token_bytes = {i: t for t, i in ranks.items()}
        self.bpe = tiktoken.Encoding("quillet", pat_str=source, mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[str, tuple[int, bytes, bytes]] = {}

    def piece(self, token: str) -> tuple[int, bytes, bytes]:
        """Number of ids, decimal ids joined by a space, decoded bytes."""
        got = self.cache.get(token)
        if got is None:
            ids = self.bpe._encode_single_piece(token)
            got = len(ids), b" ".join(b"%d" % i for i in ids), b"".join(map(self.token_bytes.__getitem__, ids))
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[token] = got
        return got

    def encoded(self, tokens) -> tuple[int, bytes, bytes]:
        """Number of ids, decimal ids joined by a space, decoded bytes."""
        cache, piece = self.cache, self.piece
        found = [cache.get(t) or piece(t) for t in tokens]
        return sum([f[0] for f in found]), b" ".join([f[1] for f in found]), b"".join([f[2] for f in found])

    def digest(self, tokens) -> tuple[int, str, str]:
        """Number of ids, digest of the decimal ids, digest of the decoded bytes."""
        n, ids, raw = self.encoded(tokens)
        return n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw).hexdigest()

    def ends(self, text: str, start: int = 0, last: bool = True) -> list[int]:
        """Pre-token ends, offset by start; without those that the cut end of a chunk may have moved."""
        found, at = [], start
        for token in self.split.findall(text):
            at += len(token)
            found.append(at)
        if not last:
            sure = start + len(text) - MARGIN
            while found and found[-1] > sure:
                found.pop()
        return found

    def stitch(self, chunks: list[tuple[int, str, list[int]]], total: int) -> list[int]:
        """All pre-token ends of a text from (start, chunk, ends) in order; the last chunk reaches the text's end."""
        sure: list[int] = []
        at, tried = 0, 0  # the last sure boundary, and characters read on from it without finding another
        for i, (start, text, ends) in enumerate(chunks):
            end, last = start + len(text), i == len(chunks) - 1
            if i == 0:
                sure = list(ends)
                at = sure[-1] if sure else 0
                continue
            known = set(ends) | {start}
            k = len(sure)  # the first shared boundary at or after this chunk's start
            lo = k
            while lo > 0 and sure[lo - 1] >= start:
                lo -= 1
            shared = next((j for j in range(lo, k) if sure[j] in known), None)
            if shared is not None:
                cut = sure[shared]
                del sure[shared + 1 :]
                sure += [e for e in ends if e > cut]
                at, tried = sure[-1] if sure else 0, 0
            elif last or end - at >= 2 * tried:
                # no resynchronisation in the overlap: go on from the last sure boundary over the joined text
                joined = "".join(
                    t[max(0, at - s) : (chunks[j + 1][0] - s if j < i else len(t))]
                    for j, (s, t, _) in enumerate(chunks[: i + 1])
                    if (chunks[j + 1][0] if j < i else end) > at
                )
                found = self.ends(joined, at, end == total)
                sure += found
                at, tried = (found[-1], 0) if found else (at, end - at)
        return sure


_codecs: dict = {}


def codec(ranks_path: str | None) -> Codec:
    if ranks_path not in _codecs:
        _codecs[ranks_path] = Codec(ranks_path)
    return _codecs[ranks_path]


def encode(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranks_path: str | None = None,
    chunk_chars: int = 65_536,
    overlap: int = 1_024,
) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256."""
    id_type = df.schema[id_col].dataType.simpleString()
    out = f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
    step = chunk_chars - overlap

    def rows(ids, digests):
        n, a, b = zip(*digests) if digests else ((), (), ())
        return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=names)

    def whole(batches):
        c = codec(ranks_path)
        for batch in batches:
            yield rows(batch.column(0), [c.digest(c.split.findall(t or "")) for t in batch.column(1).to_pylist()])

    def chunked(batches):
        """The overlapping chunks of each text, a few at a time; a text is gone through once."""
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py()
                starts = range(0, max(0, len(text) - overlap - 1) + 1, step)
                for some in (starts[j : j + 64] for j in range(0, len(starts), 64)):
                    same = pa.array([i] * len(some), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(same), batch.column(1).take(same), pa.array([len(text)] * len(some), pa.int64()), pa.array(some, pa.int64()), pa.array([text[s : s + chunk_chars] for s in some], pa.string())],
                        names=["rid", id_col, "total", "start", "chunk"],
                    )

    def cut(batches):
        c = codec(ranks_path)
        for batch in batches:
            ends = [
                np.array(c.ends(t, s, s + len(t) == n), "<i8").tobytes()
                for s, t, n in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(2).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends, pa.binary())], names=["rid", id_col, "total", "start", "chunk", "ends"])

    def join(table: pa.Table) -> pa.Table:
        """Runs of whole pre-tokens, of about a chunk each, with the pre-tokens' ends in the run."""
        parts = sorted(zip(table["start"].to_pylist(), table["chunk"].to_pylist(), table["ends"].to_pylist()))
        chunks = [(s, t, np.frombuffer(e, "<i8").tolist()) for s, t, e in parts]
        text = "".join(t[: (chunks[i + 1][0] - s if i + 1 < len(chunks) else len(t))] for i, (s, t, _) in enumerate(chunks))
        ends = np.array(codec(ranks_path).stitch(chunks, table["total"][0].as_py()), "<i8")
        runs, at, first = [], 0, 0
        while first < len(ends):
            last = max(first + 1, int(np.searchsorted(ends, at + chunk_chars, "right")))
            stop = int(ends[last - 1])
            runs.append((text[at:stop], (ends[first:last] - at).tobytes()))
            at, first = stop, last
        n = len(runs)
        return pa.table(
            [table["rid"].combine_chunks()[:1].take(pa.array([0] * n, pa.int64())), table[id_col].combine_chunks()[:1].take(pa.array([0] * n, pa.int64())), pa.array(range(n), pa.int32()),
             pa.array([t for t, _ in runs], pa.string()), pa.array([e for _, e in runs], pa.binary())],
            names=["rid", id_col, "run", "text", "ends"],
        )

    def encoded(batches):
        c = codec(ranks_path)
        for batch in batches:
            found = []
            for text, ends in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                ends = np.frombuffer(ends, "<i8").tolist()
                found.append(c.encoded([text[a:b] for a, b in zip([0, *ends], ends)]))
            n, ids, raw = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(raw, pa.binary())], names=["rid", id_col, "run", "n", "ids", "raw"])

    def finish(table: pa.Table) -> pa.Table:
        table = table.sort_by("run")
        a, b = hashlib.sha256(), hashlib.sha256()
        for i, (ids, raw) in enumerate(zip(table["ids"], table["raw"])):
            a.update((b" " if i else b"") + ids.as_py())
            b.update(raw.as_py())
        n = sum(table["n"].to_pylist())
        return pa.Table.from_batches([rows(table[id_col].combine_chunks()[:1], [(n, a.hexdigest(), b.hexdigest())])])

    src = df.select(F.col(id_col), F.col(text_col).alias("__text"))
    n = F.coalesce(F.char_length("__text"), F.lit(0))
    short = src.where(n <= chunk_chars).mapInArrow(whole, out)
    long = (
        src.where(n > chunk_chars)
        .select(F.monotonically_increasing_id().alias("rid"), id_col, "__text")
        .mapInArrow(chunked, f"rid long, `{id_col}` {id_type}, total long, start long, chunk string")
        .repartition("rid", "start")
        .mapInArrow(cut, f"rid long, `{id_col}` {id_type}, total long, start long, chunk string, ends binary")
        .groupBy("rid")
        .applyInArrow(join, f"rid long, `{id_col}` {id_type}, run int, text string, ends binary")
        .repartition("rid", "run")
        .mapInArrow(encoded, f"rid long, `{id_col}` {id_type}, run int, n long, ids binary, raw binary")
        .groupBy("rid")
        .applyInArrow(finish, out)
    )
    return short.unionByName(long)
