"""Ranked lexical search, score at a time over impact-ordered postings.

A posting's impact is an integer of the term's frequency in a document and the document's length; a term's weight is one
of its rarity; a document's score is the sum of weight x impact over an item's terms. Every text is read once, whole, to
a stored vector of its length and its frequencies of the items' terms; document counts, lengths and document
frequencies are summed over all vectors. Then each task turns slices of vectors into postings in groups of exactly equal
impact, in descending order for each term, and for each item adds up whole groups from the greatest contributions down. It
stops only where bounds prove the top: what is left could not lift a document that has nothing so far to the k-th best
score known (of this slice or of earlier ones), and few documents can still reach it; all of these then have their
scores completed from their vectors. If that is never proven, every group is added. The best k of the tasks are merged by
windows, first in salted parts.

Items are a stated query set: they are taken in blocks of at most BLOCK_BYTES of their texts (by a hash), each held by
driver and tasks; a block reads all documents.

Defined results: a null or empty text, and one without a term, is no document of the counts and is never found; an item without a term
has no rows; repeated documents are documents of their own, found by ascending id and, of equal ids, side by side;
null ids come last; repeated items have rows each; with no documents there are no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillet.llm.common import give_back, staged

#: Fixed values of the scores.
TOP, SCALE, SLOPE = 50, 1_000_000_000, 50
#: Bytes of the items' texts that are worked on at once, vectors in a slice, bytes of a text that are split at once.
BLOCK_BYTES, SLICE, CHUNK = 4 << 20, 8192, 1 << 20
#: Scores are completed once at most k documents, or one in OPEN of a slice, can still be among the best.
OPEN = 16
#: Terms are runs of ASCII letters and digits and of all bytes beyond ASCII; only ASCII capitals are lowered.
_KEPT = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_PLAIN = bytes(b for b in range(256)).lower()
_BREAKS = bytes(b for b in range(256) if b not in _KEPT)
_TABLE = _PLAIN.translate(bytes(0x20 if b in _BREAKS else b for b in range(256)))


def count_terms(text: bytes) -> Counter:
    """Terms of a text and how often each occurs; a long text is split in parts that end between terms."""
    plain = text.translate(_TABLE)
    if len(plain) <= CHUNK:
        return Counter(plain.split())
    found: Counter = Counter()
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + CHUNK)
        end = len(plain) if end < 0 else end
        found.update(plain[at:end].split())
        at = end
    return found


def vectors(docs: DataFrame, known: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """id, n (terms of the whole text), and at and tf: numbers and frequencies of the known terms in it; stored."""

    def run(batches):
        for batch in batches:
            lengths, sizes, at, tf = [], [0], [], []
            for text in batch.column(1).to_pylist():
                counts = count_terms(text) if text else {}
                lengths.append(sum(counts.values()))
                for term in counts.keys() & known.keys():
                    at.append(known[term])
                    tf.append(counts[term])
                sizes.append(len(at))
            edges = pa.array(sizes, pa.int32())
            lists = [pa.ListArray.from_arrays(edges, pa.array(at, pa.int32())), pa.ListArray.from_arrays(edges, pa.array(tf, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *lists], names=["id", "n", "at", "tf"])
        give_back()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return staged(rows.mapInArrow(run, f"id {kind}, n long, at array<int>, tf array<long>"), "vectors")


class Slice:
    """Postings of some vectors: for each term, documents by descending impact; groups are its runs of one impact."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, at: np.ndarray, tf: np.ndarray, documents: int, terms: int):
        lift = np.array([100 - SLOPE + SLOPE * x * documents // terms for x in n.tolist()], np.int64)
        self.edges = np.concatenate([[0], np.cumsum(sizes)])
        doc = np.repeat(np.arange(len(n)), sizes)
        self.at, self.impact = at, SCALE * tf // (1000 * tf + 20 * lift[doc])
        by = np.lexsort((-self.impact, at))
        self.doc, self.falling = doc[by], -self.impact[by]  # -impact rises within a term
        sorted_at = at[by]
        heads = np.flatnonzero(np.diff(sorted_at, prepend=-1))
        self.range = dict(zip(sorted_at[heads].tolist(), zip(heads.tolist(), [*heads[1:].tolist(), len(by)])))
        self.read = 0  # postings that were added up

    def best(self, weights: dict[int, int], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may be among the best k over all, and their scores; floor: the k-th best score known so far."""
        lists = [(w, *self.range[t]) for t, w in weights.items() if w > 0 and t in self.range]
        total = np.zeros(len(self.edges) - 1, np.int64)
        if not lists:
            return np.zeros(0, np.int64), total[:0]
        tops = [w * -int(self.falling[lo]) for w, lo, _ in lists]
        level = max(tops) // 2
        if floor and len(lists) * level >= floor:  # the first level that can prove anything
            level = max(1, floor // len(lists))
        places = [lo for _, lo, _ in lists]
        while True:
            rest = 0
            for i, (w, _, hi) in enumerate(lists):
                lo = places[i]
                if lo < hi and w * -int(self.falling[lo]) >= level:
                    cut = lo + int(np.searchsorted(self.falling[lo:hi], -level // w, "right"))  # whole groups only
                    total[self.doc[lo:cut]] += w * -self.falling[lo:cut]
                    self.read += cut - lo
                    places[i] = lo = cut
                if lo < hi:
                    rest += w * -int(self.falling[lo])
            least = floor
            if len(total) > k:
                least = max(least, int(np.partition(total, -k)[-k]))
            if rest == 0:  # all groups were added
                found = np.flatnonzero(total >= max(least, 1))
                return found, total[found]
            if rest < least:
                found = np.flatnonzero(total + rest >= least)
                if len(found) <= max(k, len(total) // OPEN):
                    return found, self.whole(found, weights)
            level = level // 2 if level > 1 else 0

    def whole(self, docs: np.ndarray, weights: dict[int, int]) -> np.ndarray:
        """Scores of some documents by their vectors."""
        of = np.zeros(int(self.at.max(initial=0)) + 1, np.int64)
        for t, w in weights.items():
            if t < len(of):
                of[t] = w
        sizes = self.edges[docs + 1] - self.edges[docs]
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.edges[docs] - ends + sizes, sizes)
        sums = np.concatenate([[0], np.cumsum(of[self.at[places]] * self.impact[places])])
        return sums[ends] - sums[ends - sizes]


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _block(docs: DataFrame, items: list, id_col: str, text_col: str, k: int) -> DataFrame:
    """item number, id and score of the best k documents of each task and item."""
    terms = [sorted(count_terms(text or b"")) for _, text in items]
    known = {t: i for i, t in enumerate(sorted(set().union(*terms)))}
    stored = vectors(docs, known, id_col, text_col)
    counts = stored.where("n > 0").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = counts["documents"], counts["terms"] or 0
    holding = {r["t"]: r["df"] for r in stored.select(F.explode("at").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()}  # a row a term of the block
    weights = [{known[t]: weight(n_docs, holding[known[t]]) for t in own if known[t] in holding} for own in terms]
    kind = stored.schema["id"].dataType.simpleString()

    def run(batches):
        best: list[list] = [[] for _ in weights]  # (-score, id is null, id), ascending

        def look(part: pa.Table):
            sizes = np.diff(np.concatenate([[0], np.cumsum(part.column("at").combine_chunks().value_lengths().to_numpy(zero_copy_only=False))]))
            flat = [part.column(x).combine_chunks().flatten().to_numpy(zero_copy_only=False) for x in ("at", "tf")]
            some = Slice(part.column("n").to_numpy(), sizes.astype(np.int64), flat[0].astype(np.int64), flat[1].astype(np.int64), n_docs, n_terms)
            ids = part.column("id").to_pylist()
            for i, own in enumerate(weights):
                floor = -best[i][-1][0] if len(best[i]) == k else 0
                found, scores = some.best(own, k, floor)
                if len(found):
                    new = [(-s, ids[d] is None, ids[d] if ids[d] is not None else 0) for d, s in zip(found.tolist(), scores.tolist()) if s > 0]
                    best[i] = sorted(best[i] + new)[:k]

        waiting, rows = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                waiting.append(batch.slice(lo, SLICE))
                rows += waiting[-1].num_rows
                if rows >= SLICE:
                    look(pa.Table.from_batches(waiting))
                    waiting, rows = [], 0
        if rows:
            look(pa.Table.from_batches(waiting))
        for i, found in enumerate(best):
            if found:
                ids = pa.array([None if none else x for _, none, x in found], id_type)
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(found), pa.int32()), ids, pa.array([-s for s, _, _ in found], pa.int64())], names=["item", "id", "score"])
        give_back()

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(stored.schema["id"].dataType)
    return stored.where(F.size("at") > 0).mapInArrow(run, f"item int, id {kind}, score long")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item, rank, id and score of the k best documents of each item."""
    queries = items.select(F.col(item_col).alias("item"), F.col(query_col).cast("binary").alias("text"))
    size = queries.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    blocks = -(-size // block_bytes) or 1
    spark = docs.sparkSession
    out = None
    for b in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect() if blocks > 1 else queries.collect()  # about block_bytes
        mine = [(r["item"], bytes(r["text"] or b"")) for r in mine]
        if not mine:
            continue
        found = _block(docs, mine, id_col, text_col, k)
        kind = queries.schema["item"].dataType.simpleString()
        names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(mine)], f"item int, name {kind}")
        order = (F.desc("score"), F.asc_nulls_last("id"))
        parts = found.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
        parts = parts.withColumn("rank", F.row_number().over(W.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= k)
        ranked = parts.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        rows = ranked.join(F.broadcast(names), "item").select(F.col("name").alias(item_col), "rank", F.col("id").alias(id_col), "score")  # names: a row an item of the block
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return docs.select(F.lit(None).cast(items.schema[item_col].dataType).alias(item_col), F.lit(1).alias("rank"), id_col, F.lit(0).cast("long").alias("score")).where("false")
    return out


SEARCH_SQL = r"""
    WITH p AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents WHERE text IS NOT NULL),
    s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM p WHERE len(ts) > 0),
    q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS t FROM benchmark),
    f AS (SELECT r, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(ts)::BIGINT AS n, unnest(ts) AS t FROM p) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
    w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY t, n_docs),
    a AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms)))))::BIGINT AS score
          FROM q JOIN f USING (t) JOIN w USING (t), s GROUP BY item_id, r, doc_id)
    SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM a WHERE score > 0)
    WHERE rank <= 50"""
