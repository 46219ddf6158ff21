"""The stored search index: immutable segments named by numbered manifests.

A segment holds its documents, each with its terms and their frequencies in every field, and postings: of
each term, documents from the greatest relevance down, packed in blocks of at most BLOCK. A block says how many documents hold
the term in each field, and the greatest saturation that any of them reaches in each field, for some mean lengths. Adding rows writes one new segment
and never an old one: rows whose id an older segment holds are marked dead there, with the frequencies that are to be
taken off its sums, so that statistics are sums over the segments' parts and equal those of an index made at once. Segments
of like size are merged from their stored terms, without reading a text. A manifest is a record of storage.commit: of
two writers one is told and starts anew from the newer manifest.

The relevance is BM25 per field times the field's weight, as in search.matches. The best k documents are found from
prefixes of the postings: with the k-th best score known so far, a block of a term is skipped if its bound and the
greatest bounds of the other terms do not reach that score together. Terms are joined rarest first.
"""

from __future__ import annotations

import json
import math
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.functions import dates, fixed
from quillet.sources import storage

K1, B = 1.2, 0.75
FIELDS = tuple(fixed.FIELD_WEIGHTS)
#: Postings in a block; segments of like size that are merged.
BLOCK, FANOUT = 128, 4
#: Bytes of text whose words are counted in together.
SLICE = 2 << 20
#: Bounds are looked through in levels, so many for a factor of e; postings of a term that are read first.
STEPS, FIRST = 100, 1 << 16
#: A block's greatest saturations are stored for the segment's mean length and for these multiples of it.
GRID = (0.25, 0.5, 1.0, 2.0, 4.0)
#: Scores are rounded to six places, so bounds are taken that much higher.
ROUNDING = 1e-6
#: Postings of a bucket of terms about, and of what is unpacked together about; the logarithm of no less than any relevance.
BUCKET, PORTION, LOUDEST = 1 << 19, 1 << 19, 4
#: Bits by which documents that may be dead are told from the others at most.
MARKS = 1 << 26
#: A row's postings: ids, its different pairs of source and origin, each posting's pair (16 bits) and fields (a bit each), and frequency and length in each of these (32 bits).
PACKED = ("ids", "sources", "origins", "places", "masks", "counts", "lens")


def analysed(rows: DataFrame) -> DataFrame:
    """The rows without their content, with lens (terms of each field), words (the different terms between blanks), masks (a byte a
    term: the fields that hold it) and counts (its frequency in each of these fields, 32-bit integers).

    Expressions lower fields and blank all that is no letter or digit beyond ASCII, and a table the rest, which is most of it; words
    are counted in a slice at a time, which no built-in aggregate does without a shuffle.
    """
    kept = [c for c in rows.columns if c != "content"]
    split = _plain(rows, kept)
    n = len(FIELDS)

    def count(batches):
        for batch in (part for whole in batches for part in _slices(whole, len(kept))):
            size = batch.num_rows
            terms, key, tf, lens = _counted(batch.columns[len(kept) :])
            known = max(len(terms), 1)
            new = np.flatnonzero(np.diff(key // n, prepend=-1))  # a document's term
            term = key[new] // n
            masks = np.bitwise_or.reduceat(1 << (key % n), new).astype(np.uint8) if len(new) else np.zeros(0, np.uint8)
            edges = np.searchsorted(term // known, np.arange(size + 1))
            words = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), terms.take(pa.array(term % known))), " ")
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, size * n + 1, n, dtype=np.int32)), pa.array(lens))
            counts = _binary(tf.astype(np.int32), np.append(new, len(key))[edges])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), lists, words, _binary(masks, edges), counts], names=[*kept, "lens", "words", "masks", "counts"])

    none = lambda kind: F.lit(None).cast(kind)
    schema = split.select(*kept, none("array<int>").alias("lens"), none("string").alias("words"), none("binary").alias("masks"), none("binary").alias("counts")).schema
    return split.mapInArrow(count, schema)


def entries(rows: DataFrame) -> DataFrame:
    """term, field, id and tf of the rows, counted where they lie: a document has its entries to itself, so nothing is shuffled and
    no index is written. Only the entries of ids that several rows share are summed."""
    ids = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    n, shared = ids.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 1)).first()
    if not shared:
        return _entries(rows)
    alone, likely = _parted(rows, ids.where("n > 1"), n)
    return _entries(alone).unionByName(_entries(likely).groupBy("term", "field", "id").agg(F.sum("tf").alias("tf")))


def _entries(rows: DataFrame) -> DataFrame:
    split = _plain(rows, ["id"])
    fields, n = pa.array(FIELDS), len(FIELDS)

    def count(batches):
        for batch in (part for whole in batches for part in _slices(whole, 1)):
            terms, key, tf, _ = _counted(batch.columns[1:])
            at, known = key // n, max(len(terms), 1)
            yield pa.RecordBatch.from_arrays([terms.take(pa.array(at % known)), fields.take(pa.array(key % n)), batch.column(0).take(pa.array(at // known)), pa.array(tf, pa.int64())], names=["term", "field", "id", "tf"])

    return split.mapInArrow(count, f"term string, field string, id {split.schema['id'].dataType.simpleString()}, tf long")


def _plain(rows: DataFrame, kept: list[str]) -> DataFrame:
    """These columns, and the fields lowered, with a blank for what is no letter or digit beyond ASCII."""
    plain = lambda c: F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[\x{80}-\x{10FFFF}&&[^\p{L}\p{N}]]+", " ")
    return rows.select(*kept, *[plain(c).alias(f"__{c}") for c in FIELDS])


def _counted(columns: list[pa.Array]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The different terms of a slice's fields; in rising order (row * terms + term) * fields + field of each entry, its frequency;
    and the terms of each row and field."""
    size, n, docs, tokens = len(columns[0]), len(FIELDS), [], []
    for i, texts in enumerate(columns):
        found, doc = _tokens(_blanked(texts))
        docs.append(doc * n + i)
        tokens.append(found)
    at = np.concatenate(docs)
    coded = pa.chunked_array(tokens).combine_chunks().dictionary_encode()
    codes, known = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(len(coded.dictionary), 1)
    key, tf = np.unique((at // n * known + codes) * n + at % n, return_counts=True)
    return coded.dictionary, key, tf, np.bincount(at, minlength=size * n).astype(np.int32)


def _blanked(texts: pa.Array) -> pa.Array:
    """Texts with a blank for every ASCII character but letters and digits; bytes of others are over 127 and stay."""
    _, offsets, data = texts.buffers()
    if data is None:
        return texts
    blank = np.array([b if b > 127 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)
    return pa.Array.from_buffers(texts.type, len(texts), [None, offsets, pa.py_buffer(blank[np.frombuffer(data, np.uint8)])], offset=texts.offset)


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What stands between blanks, and the row of each."""
    parts = pc.split_pattern(texts, " ")
    flat, row = parts.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    some = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(some), row[some.to_numpy(zero_copy_only=False)]


def _binary(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The values from each edge to the next as bytes."""
    offsets = (np.asarray(edges, np.int64) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _numbers(column: pa.Array, kind) -> np.ndarray:
    """What _binary() was given, of all rows."""
    column = column.cast(pa.binary())
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, kind)
    edges = np.frombuffer(offsets, np.int32)
    first, last = int(edges[column.offset]), int(edges[column.offset + len(column)])
    return np.frombuffer(data, np.uint8)[first:last].view(kind)


def _slices(batch: pa.RecordBatch, first: int, most: int = SLICE):
    """The batch in parts of about SLICE bytes of the texts from that column on, so that a worker's words are bounded whatever a batch holds."""
    sizes = sum(pc.binary_length(batch.column(i)).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(first, batch.num_columns))
    part = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    yield from (batch.slice(a, b - a) for a, b in zip(edges, edges[1:]) if b > a)


def saturation(tf, length, mean: float):
    """The part of a frequency that counts; of columns or of arrays."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B) + K1 * B * length / mean)


class _Flat:
    """Postings side by side: ids, a number for source and origin of each, and pairs (the posting, field, frequency and length)."""

    def __init__(self, ids: pa.Array, pair: np.ndarray, sources: pa.Array, origins: pa.Array, masks: np.ndarray, counts: np.ndarray):
        self.ids, self.pair, self.sources, self.origins, self.masks, self.counts = ids, pair, sources, origins, masks, counts
        self.bits = (masks[:, None] >> np.arange(len(FIELDS)) & 1).astype(bool)
        self.owner, self.field = np.nonzero(self.bits)
        self.lens = np.zeros(0, np.int32)

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> "_Flat":
        """Of rows that packed() made."""
        column = batch.column
        names = batch.schema.names
        col = lambda c: column(names.index(c))
        known = pc.list_value_length(col("sources")).to_numpy(zero_copy_only=False)
        sizes = pc.list_value_length(col("ids")).to_numpy(zero_copy_only=False)
        at = np.repeat(np.cumsum(known) - known, sizes) + _numbers(col("places"), np.uint16)
        pair, sources, origins = _pairs(col("sources").flatten(), col("origins").flatten())
        flat = cls(col("ids").flatten(), pair[at], sources, origins, _numbers(col("masks"), np.uint8), _numbers(col("counts"), np.int32))
        flat.lens = _numbers(col("lens"), np.int32)
        return flat

    def sums(self, by_field, means) -> np.ndarray:
        """For each posting the sum over its fields of a factor times the saturation."""
        parts = np.asarray(by_field)[self.field] * saturation(self.counts, self.lens, np.asarray(means)[self.field])
        return np.bincount(self.owner, weights=parts, minlength=len(self.masks))

    def packed(self, order: np.ndarray, starts: np.ndarray) -> list[pa.Array]:
        """PACKED columns of one row for each start in this order of the postings, at most 65,536 to the next."""
        size, groups = len(order), len(starts)
        edges = np.append(starts, size)
        group = np.repeat(np.arange(groups), np.diff(edges))
        many = max(len(self.sources), 1)
        key, at = np.unique(group * many + self.pair[order], return_inverse=True)
        first = np.searchsorted(key // many, np.arange(groups + 1))
        lists = lambda values, ends: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
        n = self.bits.sum(axis=1)
        before, ends = np.cumsum(n) - n, np.append(0, np.cumsum(n[order]))
        pairs = np.repeat(before[order] - ends[:-1], n[order]) + np.arange(ends[-1])
        which = pa.array(key % many)
        return [
            lists(self.ids.take(pa.array(order)), edges), lists(self.sources.take(which), first), lists(self.origins.take(which), first), _binary((at - first[group]).astype(np.uint16), edges),
            _binary(self.masks[order], edges), _binary(self.counts[pairs], ends[edges]), _binary(self.lens[pairs], ends[edges]),
        ]


def _pairs(sources: pa.Array, origins: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Different pairs of source and origin, and each row's number among them."""
    s, o = (x.dictionary_encode(null_encoding="encode") for x in (sources, origins))
    many = max(len(o.dictionary), 1)
    of = lambda x: x.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    key, at = np.unique(of(s) * many + of(o), return_inverse=True)
    return at, s.dictionary.take(pa.array(key // many)), o.dictionary.take(pa.array(key % many))


def _portions(batch: pa.RecordBatch, sizes: np.ndarray, most: int):
    """The batch in parts of about so many postings."""
    part = (np.cumsum(sizes) - sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    yield from (batch.slice(a, b - a) for a, b in zip(edges, edges[1:]) if b > a)


def _postings(documents: DataFrame, name: str, means: list[float], n: int, postings: int) -> DataFrame:
    """Blocks of postings, numbered by falling relevance, in order of term within a bucket of terms.

    A slice's postings of a bucket's terms go to its task as one compressed record batch of a row a term. A term with more
    documents than a bucket should hold, as the slice lets expect, lies in several.
    """
    kind = documents.schema["id"].dataType.simpleString()
    weights = list(fixed.FIELD_WEIGHTS.values())
    buckets = max(-(-postings // BUCKET), 1)

    def gather(batches):
        turn = TaskContext.get().partitionId()
        for batch in (part for whole in batches for part in _slices(whole, 6, 4 * SLICE)):
            masks = _numbers(batch.column(4), np.uint8)
            if not len(masks):
                continue
            coded = _tokens(batch.column(6))[0].dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(batch.num_rows), pc.binary_length(batch.column(4)).to_numpy(zero_copy_only=False))
            pair, sources, origins = _pairs(batch.column(1), batch.column(2))
            flat = _Flat(batch.column(0).take(pa.array(doc)), pair[doc], sources, origins, masks, _numbers(batch.column(5), np.int32))
            flat.lens = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)[doc[flat.owner], flat.field]
            order = np.argsort(codes, kind="stable")
            held = np.bincount(codes)
            spread = np.ceil(held * (n / batch.num_rows) / BUCKET).astype(np.int64).clip(1)
            hashed = np.array([zlib.crc32(t.encode()) for t in coded.dictionary.to_pylist()], np.int64)
            bucket = (hashed + turn % spread) % buckets
            turn += 1
            order = order[np.argsort(bucket[codes[order]], kind="stable")]
            starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
            term = codes[order][starts]
            rows = pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(term)), *flat.packed(order, starts)], names=["term", *PACKED])
            edges = np.append(np.flatnonzero(np.diff(bucket[term], prepend=-1)), len(term))
            sent = []
            for start, end in zip(edges, edges[1:]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(rows.slice(start, end - start))
                sent.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(bucket[term][edges[:-1]]), pa.array(sent, pa.binary())], names=["bucket", "rows"])

    columns = f"ids array<{kind}>, sources array<string>, origins array<string>, places binary, masks binary, counts binary, lens binary"
    gathered = documents.select("id", "source_id", "origin", "lens", "masks", "counts", "words").mapInArrow(gather, "bucket long, rows binary")
    ordered = gathered.repartition("bucket").sortWithinPartitions("bucket")

    def whole_buckets(batches):
        """The rows of each bucket in order of term; those of one that goes on in the next batch wait for it."""
        held, last = [], None
        for batch in batches:
            for bucket, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
                if bucket != last and held:
                    yield from ordered_rows(held)
                    held = []
                last = bucket
                held.append(pa.ipc.open_stream(rows.as_buffer()).read_all())
        if held:
            yield from ordered_rows(held)

    def ordered_rows(held):
        rows = pa.concat_tables(held).combine_chunks()
        return rows.take(pc.sort_indices(rows.column("term"))).combine_chunks().to_batches()

    def cut(batches):
        part, number = TaskContext.get().partitionId(), 0
        sized = ((whole, pc.list_value_length(whole.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)) for whole in whole_buckets(batches))
        for batch in (piece for whole, sizes in sized for piece in _portions(whole, sizes, 4 * PORTION)):
            terms, flat = batch.column(0), _Flat.of(batch)
            new = np.append(True, pc.not_equal(terms.slice(1), terms.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False))
            run = np.repeat(np.cumsum(new) - 1, pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))
            score = flat.sums(weights, means)
            order = np.lexsort((-score, run))
            held = np.bincount(run)
            within = np.arange(len(order)) - np.repeat(np.cumsum(held) - held, held)
            starts = np.flatnonzero(within % BLOCK == 0)
            best, dense = [], np.zeros(flat.bits.shape)
            for g in GRID:
                dense[flat.owner, flat.field] = saturation(flat.counts, flat.lens, np.array(means)[flat.field] * g)
                best.append(np.maximum.reduceat(dense[order], starts, axis=0))
            holding = np.add.reduceat(flat.bits[order].astype(np.int64), starts, axis=0)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel())) for x in (holding, np.concatenate(best, axis=1))]
            # the greatest relevance of a block comes first in its number, so that a term's blocks of several tasks are in one order
            level = np.floor((LOUDEST - np.log(score[order][starts].clip(ROUNDING))) * STEPS).clip(0).astype(np.int64)
            blocks = (level << 44) | ((part & 0xFFFFF) << 24) | ((number + np.arange(len(starts))) & 0xFFFFFF)
            number += len(starts)
            named = terms.filter(pa.array(new)).take(pa.array(run[order][starts]))
            rows = pa.array(np.diff(np.append(starts, len(order))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(starts)), named, pa.array(blocks), rows, *lists, *flat.packed(order, starts)], names=["segment", "term", "block", "rows", "holding", "best", *PACKED])

    return ordered.mapInArrow(cut, f"segment string, term string, block long, rows int, holding array<long>, best array<double>, {columns}")


def _held(documents: DataFrame) -> DataFrame:
    """segment, term and holding: the documents that hold it in each field, summed within slices."""

    def count(batches):
        for batch in (part for whole in batches for part in _slices(whole, 2)):
            terms, doc = _tokens(batch.column(2))
            if not len(terms):
                continue
            coded, segment = terms.dictionary_encode(), batch.column(0).dictionary_encode()
            known = len(coded.dictionary)
            key, at = np.unique(segment.indices.to_numpy(zero_copy_only=False).astype(np.int64)[doc] * known + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)
            bits = _numbers(batch.column(1), np.uint8)[:, None] >> np.arange(len(FIELDS)) & 1
            holding = np.stack([np.bincount(at, weights=bits[:, i], minlength=len(key)) for i in range(len(FIELDS))], axis=1).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, holding.size + 1, len(FIELDS), dtype=np.int32)), pa.array(holding.ravel()))
            yield pa.RecordBatch.from_arrays([segment.dictionary.take(pa.array(key // known)), coded.dictionary.take(pa.array(key % known)), lists], names=["segment", "term", "holding"])

    return documents.select("segment", "masks", "words").mapInArrow(count, "segment string, term string, holding array<long>")


def _write(rows: DataFrame, path: str) -> None:
    rows.write.option("compression", "zstd").parquet(path)


def _sums(rows: DataFrame) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.array(*[F.coalesce(F.sum(F.col("lens")[i]), F.lit(0)) for i in range(len(FIELDS))]).alias("tokens")]


def _segment(path: str, documents: DataFrame) -> dict:
    """Write analysed documents as a new segment; its entry in a manifest."""
    spark = documents.sparkSession
    name = uuid.uuid4().hex
    _write(documents.withColumn("segment", F.lit(name)), f"{path}/{name}/documents")
    stored = spark.read.parquet(f"{path}/{name}/documents")
    sums = stored.agg(*_sums(stored), F.coalesce(F.sum(F.length("masks")), F.lit(0)).alias("postings")).first()
    means = [max(t / sums["n"], 1e-9) if sums["n"] else 1.0 for t in sums["tokens"]]
    _write(_postings(stored, name, means, sums["n"], sums["postings"]), f"{path}/{name}/postings")
    return {"name": name, "n": sums["n"], "tokens": list(sums["tokens"]), "means": means, "dead_n": 0, "dead_tokens": [0] * len(FIELDS)}


def _bury(spark: SparkSession, path: str, state: dict, ids: DataFrame) -> dict:
    """The state with the older segments' documents of these ids marked dead; what is taken off their sums is stored."""
    if not state["segments"]:
        return state
    name = uuid.uuid4().hex
    # what is found by ids alone is narrow; only documents that die, and some with hashes like theirs, are moved with their words
    _write(_live(spark, path, state).select("segment", "id").join(ids.select("id").distinct(), "id", "left_semi"), f"{path}/{name}/dying")
    dying = spark.read.parquet(f"{path}/{name}/dying")
    if dying.isEmpty():
        return state
    old = _documents(spark, path, state).select("segment", "id", "lens", "masks", "words")
    _, likely = _parted(old, dying, sum(s["n"] for s in state["segments"]))
    _write(likely.join(dying, ["segment", "id"], "left_semi"), f"{path}/{name}/dead")
    dead = spark.read.parquet(f"{path}/{name}/dead")
    taken = _held(dead).groupBy("segment", "term").agg(F.array(*[F.sum(F.col("holding")[i]) for i in range(len(FIELDS))]).alias("holding"))
    taken.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/{name}/taken")
    sums = {r["segment"]: r for r in dead.groupBy("segment").agg(*_sums(dead)).collect()}  # a row a segment
    segments = [
        s | {"dead_n": s["dead_n"] + sums[s["name"]]["n"], "dead_tokens": [a + b for a, b in zip(s["dead_tokens"], sums[s["name"]]["tokens"])]} if s["name"] in sums else s
        for s in state["segments"]
    ]
    return {"segments": segments, "dead": [*state["dead"], {"name": name, "of": sorted(sums)}]}


def state_of(spark: SparkSession, path: str) -> tuple[int, dict]:
    number, payload = storage.newest(spark, f"{path}/manifests")
    return number, json.loads(payload) if payload else {"segments": [], "dead": []}


def add(rows: DataFrame, path: str, deleted: DataFrame | None = None) -> None:
    """Add rows (search documents, ids not null and once each), in place of those of the same ids; and delete ids."""
    spark = rows.sparkSession
    made = _segment(path, analysed(rows))
    ids = spark.read.parquet(f"{path}/{made['name']}/documents").select("id")
    if deleted is not None:
        ids = ids.union(deleted.select("id"))
    while True:
        number, state = state_of(spark, path)
        after = _bury(spark, path, state, ids)
        segments = after["segments"] + ([made] if made["n"] else [])
        if storage.commit(spark, f"{path}/manifests", number + 1, json.dumps({"segments": segments, "dead": after["dead"]})):
            return


def merge(spark: SparkSession, path: str, fanout: int = FANOUT) -> bool:
    """Make one segment of those of a tier (live documents, by powers of the fanout) that has as many as the fanout."""
    number, state = state_of(spark, path)
    tiers: dict[int, list[str]] = {}
    for s in state["segments"]:
        tiers.setdefault(int(math.log(max(s["n"] - s["dead_n"], 1), fanout)), []).append(s["name"])
    full = [names for _, names in sorted(tiers.items()) if len(names) >= fanout]
    if not full:
        return False
    gone = set(full[0])
    merged = [s for s in state["segments"] if s["name"] in gone]
    rows, dead = _documents(spark, path, state | {"segments": merged}), _dead(spark, path, state)
    if dead is not None:
        dead = dead.where(F.col("segment").isin(*gone))
        rest, likely = _parted(rows, dead, sum(s["n"] for s in merged))
        rows = rest.unionByName(_alive(likely, dead))
    made = _segment(path, rows.drop("segment"))
    segments = [s for s in state["segments"] if s["name"] not in gone] + ([made] if made["n"] else [])
    dead = [d for d in state["dead"] if set(d["of"]) - gone]
    return storage.commit(spark, f"{path}/manifests", number + 1, json.dumps({"segments": segments, "dead": dead})) or merge(spark, path, fanout)


def _live(spark: SparkSession, path: str, state: dict) -> DataFrame:
    return _alive(_documents(spark, path, state), _dead(spark, path, state))


def _documents(spark: SparkSession, path: str, state: dict) -> DataFrame:
    return spark.read.parquet(*[f"{path}/{s['name']}/documents" for s in state["segments"]])


def _dead(spark: SparkSession, path: str, state: dict) -> DataFrame | None:
    return spark.read.parquet(*[f"{path}/{d['name']}/dead" for d in state["dead"]]).select("segment", "id") if state["dead"] else None


def _alive(rows: DataFrame, dead: DataFrame | None) -> DataFrame:
    return rows if dead is None else rows.join(dead, ["segment", "id"], "left_anti")


def _parted(rows: DataFrame, ids: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The rows, of n, whose id is none of ids, and the others: all whose id is one, and some more.

    Rows are told by a broadcast bit of their ids' hash, and so are not moved. There are about two bits a row, and no more than MARKS,
    beyond which more rows than need be count as likely.
    """
    size = 1 << min(max(2 * n, 1 << 12).bit_length(), MARKS.bit_length() - 1)
    at = f"pmod(xxhash64(id), {size}L)"
    word, bit = f"CAST(shiftright({at}, 6) AS INT)", f"CAST({at} & 63 AS INT)"
    none = rows.sparkSession.range(size // 64).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = ids.select(F.expr(word).alias("word"), F.expr(f"shiftleft(1L, {bit})").alias("bits")).union(none).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    every = words.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words")).select(F.transform("words", lambda w: w["bits"]).alias("marks"))
    marks = F.broadcast(every)  # a row of at most MARKS bits
    found = F.expr(f"shiftright(get(marks, {word}), {bit}) & 1") == 1
    return rows.join(marks, found, "left_anti"), rows.join(marks, found, "left_semi")


class Index:
    """The index as its newest manifest tells it; `cuts` has the last block that the last top() read of each segment and term."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.number, self.state = state_of(spark, path)
        self.segments = self.state["segments"]
        names = [s["name"] for s in self.segments]
        self.postings = spark.read.parquet(*[f"{path}/{n}/postings" for n in names])
        self.dead = _dead(spark, path, self.state)
        self.taken = spark.read.parquet(*[f"{path}/{d['name']}/taken" for d in self.state["dead"]]).where(F.col("segment").isin(*names)) if self.state["dead"] else None
        self.documents = _live(spark, path, self.state).drop("segment", "lens", "words", "masks", "counts")
        self.n = sum(s["n"] - s["dead_n"] for s in self.segments)
        tokens = [sum(s["tokens"][i] - s["dead_tokens"][i] for s in self.segments) for i in range(len(FIELDS))]
        self.means = [max(t / self.n, 1e-9) if self.n else 1.0 for t in tokens]
        self.cuts: dict[tuple[str, str], int] = {}

    def frequencies(self, terms: tuple[str, ...] | None = None) -> DataFrame:
        """term and holding: the documents that hold it in each field, summed over the segments' parts."""
        parts = self.postings.select("term", "holding")
        if self.taken is not None:
            parts = parts.union(self.taken.select("term", F.transform("holding", lambda x: -x)))
        if terms is not None:
            parts = parts.where(F.col("term").isin(*terms))
        summed = [F.sum(F.col("holding")[i]) for i in range(len(FIELDS))]
        return parts.groupBy("term").agg(F.array(*summed).alias("holding"))

    def weights(self, terms: tuple[str, ...]) -> dict[str, tuple[int, list[float]]]:
        """For each term in the index: its fields in documents, and the fields' weights times its rarity."""
        rows = self.frequencies(terms).where(F.exists("holding", lambda x: x > 0)).collect()  # a row a term of the request
        rarity = lambda df: math.log(1 + (self.n - df + 0.5) / (df + 0.5))
        return {r["term"]: (sum(r["holding"]), [w * rarity(df) for w, df in zip(fixed.FIELD_WEIGHTS.values(), r["holding"])]) for r in rows}

    def _parts(self, term: str, weight: list[float], cuts: dict[str, int] | None) -> DataFrame:
        """id, source_id, origin and the term's part of the score, from all blocks or those up to a number in each segment."""
        mine = self.postings.where(F.col("term") == term)
        if cuts is not None:
            some = F.lit(False)
            for segment, block in cuts.items():
                some = some | ((F.col("segment") == segment) & (F.col("block") <= block))
            mine = mine.where(some)
        means = self.means

        def parts(flat):
            pair = pa.array(flat.pair)
            return [flat.ids, flat.sources.take(pair), flat.origins.take(pair), pa.array(flat.sums(weight, means))]

        rows = self._unpacked(mine, ["segment"], parts, "source_id string, origin string, part double")
        return _alive(rows, self.dead).drop("segment")

    def _unpacked(self, blocks: DataFrame, kept: list[str], of, schema: str) -> DataFrame:
        """A row a posting of the blocks: these columns of its block, its id, and what `of` tells of the postings after their ids."""

        def run(batches):
            for whole in batches:
                sizes = pc.list_value_length(whole.column(len(kept))).to_numpy(zero_copy_only=False).astype(np.int64) if whole.num_rows else np.zeros(0, np.int64)
                for batch in _portions(whole, sizes, PORTION) if len(sizes) else ():
                    at = pa.array(np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(len(kept))).to_numpy(zero_copy_only=False)))
                    told = [*(batch.column(i).take(at) for i in range(len(kept))), *of(_Flat.of(batch))]
                    yield pa.RecordBatch.from_arrays(told, names=names)

        kind = blocks.schema["ids"].dataType.elementType.simpleString()
        names = [*kept, "id", *(c.split()[0] for c in schema.split(", "))]
        return blocks.select(*kept, *PACKED).mapInArrow(run, ", ".join([*(f"{c} string" for c in kept), f"id {kind}", schema]))

    def entries(self) -> DataFrame:
        """term, id and tfs (its frequency in each field) of all stored postings."""

        def tfs(flat):
            dense = np.zeros(flat.bits.shape, np.int32)
            dense[flat.owner, flat.field] = flat.counts
            return [flat.ids, pa.ListArray.from_arrays(pa.array(np.arange(0, dense.size + 1, len(FIELDS), dtype=np.int32)), pa.array(dense.ravel()))]

        return self._unpacked(self.postings, ["term"], tfs, "tfs array<int>")

    def _joined(self, known: dict, cuts: dict[str, dict[str, int]] | None, origin: str = "") -> DataFrame:
        """Documents with all terms, by joins from the rarest term on; small sides are broadcast where Spark finds them small."""
        order = sorted(known, key=lambda t: known[t][0])
        rows = self._parts(order[0], known[order[0]][1], cuts and cuts.get(order[0], {}))
        if origin:
            rows = by_origin(rows, origin)
        for term in order[1:]:
            more = self._parts(term, known[term][1], cuts and cuts.get(term, {})).select("id", F.col("part").alias("more"))
            rows = rows.join(more, "id").withColumn("part", F.col("part") + F.col("more")).drop("more")
        return rows.select("id", "source_id", "origin", F.round("part", 6).alias("score"))

    def _empty(self) -> DataFrame:
        return self.documents.limit(0).select("id", "source_id", "origin", F.lit(0.0).alias("score"))

    def matches(self, terms: tuple[str, ...], origin: str = "") -> DataFrame:
        """id, source_id, origin and relevance of every document that holds all terms."""
        known = self.weights(terms)
        return self._joined(known, None, origin) if terms and len(known) == len(set(terms)) else self._empty()

    def headers(self, known: dict) -> DataFrame:
        """segment, term, block, rows and the greatest part of a score that a document of the block can have."""
        bounds = []
        for s in self.segments:
            shares = [between(now / then) for now, then in zip(self.means, s["means"])]
            bounds += [(s["name"], t, [w * share[g] for g in range(len(GRID)) for w, share in zip(weight, shares)]) for t, (_, weight) in known.items()]
        factors = self.spark.createDataFrame(bounds, "segment string, term string, factors array<double>")
        mine = self.postings.where(F.col("term").isin(*known)).select("segment", "term", "block", "rows", "best")
        bound = F.aggregate(F.zip_with("best", "factors", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        return mine.join(F.broadcast(factors), ["segment", "term"]).select("segment", "term", "block", "rows", bound.alias("bound"))  # segments x terms rows

    def top(self, terms: tuple[str, ...], k: int, origin: str = "", first: int = FIRST) -> DataFrame:
        """The best k of matches() by score and id, found in prefixes of the postings, of `first` entries of each term to
        begin with; k is bounded by a request's checks."""
        known = self.weights(terms)
        self.cuts = {}
        if not terms or len(known) < len(set(terms)):
            return self._empty()
        if all(entries <= first for entries, _ in known.values()):
            return self.spark.createDataFrame(self._best(known, None, k, origin), self._empty().schema)
        steps = self.headers(known).groupBy("segment", "term", F.floor(F.log(F.greatest("bound", F.lit(ROUNDING))) * STEPS).alias("step"))
        levels = steps.agg(F.max("bound").alias("bound"), F.max("block").alias("block"), F.sum("rows").alias("rows")).collect()  # some hundred rows a segment and term
        levels.sort(key=lambda r: -r["bound"])
        last = self._cuts(levels)
        rest = {t: sum(max(r["bound"] for r in levels if r["term"] == x) for x in known if x != t) for t in known}
        while True:
            seen, some = Counter(), []
            for r in levels:
                if seen[r["term"]] < first:
                    some.append(r)
                    seen[r["term"]] += r["rows"]
            cuts = self._cuts(some)
            best = self._best(known, cuts, k, origin)
            if len(best) >= k or cuts == last:
                break
            first *= 8
        if len(best) >= k:
            needed = self._cuts([r for r in levels if r["bound"] + rest[r["term"]] + ROUNDING >= best[-1]["score"]])
            if any(block > cuts.get(key, -1) for key, block in needed.items()):
                cuts = {key: max(cuts.get(key, -1), needed.get(key, -1)) for key in cuts.keys() | needed.keys()}
                best = self._best(known, cuts, k, origin)
        self.cuts = cuts
        return self.spark.createDataFrame(best, self._empty().schema)

    @staticmethod
    def _cuts(levels: list) -> dict[tuple[str, str], int]:
        """For each segment and term the last block of these levels."""
        out: dict[tuple[str, str], int] = {}
        for r in levels:
            key = r["segment"], r["term"]
            out[key] = max(out.get(key, -1), r["block"])
        return out

    def _best(self, known: dict, cuts: dict | None, k: int, origin: str) -> list:
        by_term: dict[str, dict[str, int]] | None = None
        if cuts is not None:
            by_term = {t: {} for t in known}
            for (segment, term), block in cuts.items():
                by_term[term][segment] = block
        return self._joined(known, by_term, origin).orderBy(F.desc("score"), "id").limit(k).collect()  # k rows

    def found(self, request) -> DataFrame:
        return self.matches(request.terms, request.origin)

    def shown(self, window: DataFrame) -> DataFrame:
        """A window's rows with what a result shows; an unreadable time is unknown."""
        rows = self.documents.drop("source_id", "origin").join(F.broadcast(window), "id")  # window: bounded by the request's validation
        return rows.withColumn("published_at", dates.parse_time(F.col("published"))).drop("published")


def between(factor: float) -> list[float]:
    """What to take of the greatest saturations at GRID to bound those at a mean that is the factor times the segment's.

    Over the mean's inverse a saturation falls and is convex, and so is the greatest of several: between two points of the
    grid it lies under their chord, below the grid under its end, and above it under its end times what the mean grows.
    """
    out = [0.0] * len(GRID)
    if factor <= GRID[0]:
        out[0] = 1.0
    elif factor >= GRID[-1]:
        out[-1] = factor / GRID[-1]
    else:
        i = next(i for i in range(1, len(GRID)) if factor <= GRID[i])
        low, high, here = 1 / GRID[i], 1 / GRID[i - 1], 1 / factor
        out[i - 1] = (here - low) / (high - low)
        out[i] = 1 - out[i - 1]
    return out


def by_origin(rows: DataFrame, origin: str) -> DataFrame:
    """A row without an origin came from a feed."""
    if origin == "sitemap":
        return rows.where(F.col("origin") == "sitemap")
    return rows.where((F.col("origin") == "feed") | F.col("origin").isNull()) if origin == "feed" else rows
