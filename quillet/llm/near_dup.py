"""Near-duplicate classes by DartMinHash signatures and a banded join.

A document is the weighted set of its five-word shingles, weights being their counts. Hashed darts are thrown
into each element's weight regions: the region [2^(b-1), 2^b) of an element gets a Poisson stream of darts in
order of rank, at a rate of the region's width; a dart counts if its weight coordinate lies under the
element's weight. Streams depend on the element alone, so two documents share the darts of what they share.
Each dart falls on one of `coords` coordinates, the earliest dart of a coordinate is kept, and two documents
agree in a coordinate with probability equal to their weighted Jaccard similarity. Darts of rank over a
threshold, inversely proportional to the document's weight, are never made, so a signature costs about the
same for any length of shingle list; the threshold grows where a coordinate stayed empty.

Documents with equal shingle sequences are one node. Nodes that share a band of the signature share a bucket.
In each bucket every member is compared with a centre, the member that shares most buckets with others, as a text
that others were edited from does. Where members are still in different classes after that, those outside the
bucket's largest class are its query set and are compared with the bucket's members in blocks, each pair in the
first bucket that it shares. Blocks are read twice: first with signatures alone, which settle the pairs whose share of
agreeing coordinates is far from the threshold and name the members that are left with an unsettled one; then, for
these alone, with whole texts, in blocks of bounded bytes, best agreement first, by exact weighted Jaccard similarity.
Only links that join classes leave a block. So every pair that shares a bucket is compared or already connected, and
no bucket's pairs are emitted. Classes are connected components, found by joins alone. A node's text is found by the
hash of a row's id and text, so null and repeated ids lose none.

Defined results: words are compared in lower case; a text of under five words is one shingle of all its words;
a null text or one without words is a class of its own with all other such texts; the class id is the least id
in it; the row with that id stays (of repeated ids, one); a null id stays only if its class has no other; an
empty table gives an empty table; only the id and text columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillet.llm.common import give_back, staged, unstage

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 28, 5
COORDS = BANDS * ROWS
#: Agreement shares that settle a pair without its texts: over four standard deviations from 0.8.
SURELY, HARDLY = 0.95, 0.65
#: Members, and askers, of a bucket in one block of the second comparison.
BLOCK = 2048
#: Bytes of texts on either side of a block.
BLOCK_BYTES = 12_000_000
#: Shingle sets that a worker keeps while it compares.
KEPT_SETS = 2048

_U = np.uint64
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    x = (x ^ (x >> _U(30))) * _B
    x = (x ^ (x >> _U(27))) * _C
    return x ^ (x >> _U(31))


def _times(n: int, odd: np.uint64) -> np.uint64:
    return _U(n * int(odd) & 0xFFFFFFFFFFFFFFFF)


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1)."""
    return ((x >> _U(11)).astype(np.float64) + 0.5) / float(1 << 53)


class Words:
    """64-bit hashes of words, kept per worker."""

    def __init__(self, limit: int = 250_000):
        import xxhash

        self.digest, self.limit, self.known = xxhash.xxh64_intdigest, limit, {}

    def hashes(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = self.digest(w.encode("utf-8", "surrogatepass"))
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(hashes: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles in order, repeats included."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(width, n)
    out = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        out = out * _A + hashes[i : n - width + 1 + i]
    return mix(out + _U(width))


def darts(elements: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
    """All darts with rank under their element's threshold that hit its weight: the element's place, rank and id.

    Elements of many documents go through together; each step throws the next dart of every stream that is still
    under its threshold.
    """
    places, ranks, ids = [], [], []
    band, lo, hi = 0, 0.0, 1.0
    while True:
        place = np.flatnonzero(weights > lo)
        if not len(place):
            break
        width = hi - lo
        stream = mix(elements[place] + _times(band + 1, _A))
        rank, i = np.zeros(len(place)), 0
        while len(place):
            i += 1
            dart = mix(stream + _times(i, _C))
            rank = rank - np.log(unit(dart)) / width
            alive = rank < thresholds[place]
            place, stream, rank, dart = place[alive], stream[alive], rank[alive], dart[alive]
            hit = slice(None) if band == 0 and (weights[place] >= hi).all() else lo + width * unit(mix(dart ^ _A)) < weights[place]
            places.append(place[hit])
            ranks.append(rank[hit])
            ids.append(mix(dart + _B)[hit])
        band, lo, hi = band + 1, hi, hi * 2
    return (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((places, np.int64), (ranks, float), (ids, np.uint64)))


def signature(sets: list[tuple[np.ndarray, np.ndarray]], coords: int = COORDS) -> np.ndarray:
    """For each weighted set (elements, weights) the earliest dart's id per coordinate; zeros for an empty set."""
    out = np.zeros((len(sets), coords), np.uint64)
    todo = np.array([i for i, (e, _) in enumerate(sets) if len(e)], np.int64)
    aim = coords * (math.log(coords) + 3)
    while len(todo):
        sizes = np.array([len(sets[i][0]) for i in todo])
        elements = np.concatenate([sets[i][0] for i in todo])
        weights = np.concatenate([sets[i][1] for i in todo]).astype(np.float64)
        owner = np.repeat(np.arange(len(todo)), sizes)
        total = np.bincount(owner, weights)
        place, rank, dart = darts(elements, weights, (aim / total)[owner])
        cell = owner[place] * coords + (dart % _U(coords)).astype(np.int64)
        earliest = np.full(len(todo) * coords, np.inf)
        np.minimum.at(earliest, cell, rank)
        kept = rank == earliest[cell]
        ids = np.zeros(len(todo) * coords, np.uint64)
        ids[cell[kept]] = dart[kept]
        out[todo] = ids.reshape(-1, coords)
        todo = todo[np.isinf(earliest.reshape(-1, coords)).any(1)]  # a coordinate stayed empty: throw on
        aim *= 2
    return out


def band_keys(sigs: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One key a band for each signature; the band's number is part of it."""
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * _B, (len(sigs), 1))
    for r in range(rows):
        out = out * _A + sigs.reshape(-1, bands, rows)[:, :, r]
    return mix(out)


def shingle_set(text: str, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingle hashes of a whole text and their counts."""
    return np.unique(shingles(words.hashes(text.lower().split())), return_counts=True)


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact weighted Jaccard similarity of two shingle sets."""
    (x, m), (y, n) = (a, b) if len(a[0]) <= len(b[0]) else (b, a)
    at = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
    both = int(np.minimum(m, n[at])[y[at] == x].sum()) if len(x) else 0
    every = int(m.sum()) + int(n.sum()) - both
    return both / every if every else 1.0


def similarity(a: str, b: str) -> float:
    words = Words()
    return jaccard(shingle_set(a, words), shingle_set(b, words))


def node_of(text: str | None) -> bytes:
    """Digest of the lower-case word sequence."""
    import xxhash

    return xxhash.xxh3_128_digest("\n".join(text.lower().split() if text else []).encode("utf-8", "surrogatepass"))


def share_of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of agreeing coordinates from their low bytes; bytes of different darts agree once in 256."""
    return ((x == y).mean(-1) - 1 / 256) / (1 - 1 / 256)


def signatures(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key of the row, node (digest of the lower-case word sequence), sig (low byte of each coordinate), bands."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        words = Words()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                nodes, fresh, sets = [], {}, []
                for text in part.column(1).to_pylist():
                    node = node_of(text)
                    nodes.append(node)
                    if node not in fresh:
                        fresh[node] = len(sets)
                        sets.append(shingle_set(text or "", words))
                sigs = signature(sets)
                keys = band_keys(sigs).astype(np.int64)
                low = (sigs & _U(0xFF)).astype(np.uint8)
                at = [fresh[n] for n in nodes]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array(nodes, pa.binary()),
                        pa.array([low[i].tobytes() for i in at], pa.binary()),
                        pa.array([keys[i] if len(sets[i][0]) else keys[i][:0] for i in at], pa.list_(pa.int64())),
                    ],
                    names=["id", "key", "node", "sig", "bands"],
                )
        del words
        give_back()

    return df.select(id_col, text_col, _key(id_col, text_col).alias("key")).mapInArrow(run, f"id {id_type}, key long, node binary, sig binary, bands array<bigint>")


def _key(id_col: str, text_col: str) -> Column:
    """A row's key, by which its text is found again; only rows of one text and id share one."""
    return F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))


def _agreement(pairs: DataFrame) -> DataFrame:
    """a, b, share of agreeing coordinates."""

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, COORDS) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share_of(x, y))], names=["a", "b", "share"])

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a binary, b binary, share double")


def _similar(share: float, a: str | None, b: str | None, sets) -> bool:
    """Whether a pair is similar: by its share where that settles it or a text is missing, else exactly."""
    if share >= SURELY or share < HARDLY:
        return share >= SURELY
    return share >= SIMILARITY if a is None or b is None else jaccard(sets(a), sets(b)) >= SIMILARITY - 1e-12


class _Sets:
    """Shingle sets of texts, the last few thousand kept."""

    def __init__(self):
        self.words, self.known = Words(), {}

    def __call__(self, text: str):
        got = self.known.get(text)
        if got is None:
            if len(self.known) >= KEPT_SETS:
                self.known.clear()
            got = self.known[text] = shingle_set(text, self.words)
        return got


def _exact(pairs: DataFrame) -> DataFrame:
    """a, b of the pairs that are similar; columns a, b, share, text_a, text_b."""

    def run(batches):
        sets = _Sets()
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                keep = [_similar(s, x, y, sets) for s, x, y in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
                yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
        del sets
        give_back()

    return pairs.select("a", "b", "share", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def _texts_of(wanted: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """node, text of wanted nodes: the text of the row with the node's least key."""

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                keep = [node_of(t) == n for n, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
                yield batch.filter(pa.array(keep, pa.bool_()))

    found = wanted.join(nodes, "node").join(texts, "key").select("node", "text").mapInArrow(run, "node binary, text string")
    return found.groupBy("node").agg(F.first("text").alias("text"))


def components(edges: DataFrame, round_label: str) -> DataFrame:
    """node, label: the least node of each connected component. Each round's table is written and reread."""
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"links{round_label}")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")), f"labels{round_label}")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("far")), "b").groupBy(F.col("a").alias("node")).agg(F.min("far").alias("far"))
        least = labels.join(near, "node").select("node", "label", F.least("label", "far").alias("next"))
        # hop: the label of the label, as it stood
        hop = labels.select(F.col("node").alias("next"), F.col("label").alias("hop"))
        moved = staged(
            least.join(hop, "next", "left").select("node", F.least("next", F.coalesce("hop", "next")).alias("label"), F.col("label").alias("old")),
            f"labels{round_label}",
        )
        unstage(labels)
        labels = moved.select("node", "label")
        if moved.where("label <> old").isEmpty():
            unstage(both)
            return labels


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, class_id, class_size, kept."""
    rows = staged(signatures(df, id_col, text_col), "darts")
    texts = df.select(_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    # one row for each different word sequence; equal rows are reduced before the shuffle
    nodes = rows.groupBy("node").agg(F.min("key").alias("key"))
    banded = rows.select("node", F.explode("bands").alias("band")).distinct()
    # aggregates are written before they are joined back: then Spark splits a hot key or broadcasts a small table
    shared = staged(banded.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "shared")
    met = staged(banded.join(shared, "band"), "met")
    # how many others a node meets, over all its bands
    fame = met.groupBy("node").agg(F.sum("members").alias("fame"))
    buckets = staged(met.join(fame, "node").select("band", "node", "fame"), "buckets")
    unstage(met)
    marks = rows.join(buckets.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    marks = staged(marks, "marks")
    centres = staged(buckets.groupBy("band").agg(F.max(F.struct("fame", "node"))["node"].alias("centre")), "centres")
    rest = buckets.join(centres, "band").where("node <> centre")
    links = _star(rest.select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct(), marks, nodes, texts)
    labels = components(links, "1")
    more = _within(rest.select("band", "node"), labels, marks, nodes, texts)
    if more is not None:
        links = links.unionByName(more)
        labels = components(links, "2")
    placed = rows.select("id", "node").join(labels, "node", "left").select("id", F.coalesce("label", "node").alias("label"), F.monotonically_increasing_id().alias("rid"))
    placed = staged(placed, "placed")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("rid"))).alias("first")
    groups = staged(placed.groupBy("label").agg(first, F.count(F.lit(1)).alias("class_size")), "classes")
    return placed.join(groups, "label").select(F.col("id").alias(id_col), F.col("first.id").alias("class_id"), "class_size", (F.col("rid") == F.col("first.rid")).alias("kept"))


def _star(pairs: DataFrame, marks: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs a, b of nodes and their buckets' centres that are similar."""
    sig = lambda c: marks.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"))
    shares = staged(_agreement(pairs.join(sig("a"), "a").join(sig("b"), "b")).where(F.col("share") >= HARDLY), "shares")
    unsure = shares.where(F.col("share") < SURELY)
    wanted = unsure.select(F.col("a").alias("node")).unionByName(unsure.select(F.col("b").alias("node"))).distinct()
    bodies = staged(_texts_of(wanted, nodes, texts), "bodies")
    body = lambda c: bodies.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
    exact = _exact(unsure.join(body("a"), "a", "left").join(body("b"), "b", "left"))
    found = staged(shares.where(F.col("share") >= SURELY).select("a", "b").unionByName(exact), "found")
    unstage(bodies)
    unstage(shares)
    return found


def _cells(asked: DataFrame) -> DataFrame:
    """band, row, column, asks, node, label: a grid of member blocks and query blocks for each band.

    asked: band, node, label, member, asks, and of its band the blocks of either side (rows, columns). No cell holds
    more than a block of either, however large the bucket.
    """
    row, column = F.pmod(F.xxhash64("node"), F.col("rows")).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("columns")).cast("int")
    cell = lambda r, c, asks: F.struct(r.alias("row"), c.alias("column"), F.lit(asks).alias("asks"))
    none = F.array().cast("array<struct<row:int,column:int,asks:boolean>>")
    as_member = F.when(F.col("member"), F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda c: cell(row, c, False))).otherwise(none)
    as_query = F.when(F.col("asks"), F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda r: cell(r, column, True))).otherwise(none)
    return asked.select("band", "node", "label", F.explode(F.concat(as_member, as_query)).alias("x")).select("band", "node", "label", "x.*")


def _blocks(n: Column, size: Column | None = None) -> Column:
    blocks = F.ceil(n / BLOCK)
    return F.greatest(F.lit(1), blocks if size is None else F.greatest(blocks, F.ceil(size / BLOCK_BYTES))).cast("int")


class _Cell:
    """One cell's members and askers, and which of them are in one class by now."""

    def __init__(self, table: pa.Table):
        self.table = order = table.sort_by("node")
        self.node = order["node"].to_pylist()
        self.sig = np.frombuffer(b"".join(order["sig"].to_pylist()), np.uint8).reshape(-1, COORDS)
        self.bands = np.array(order["bands"].to_pylist(), np.int64)
        self.before = np.arange(BANDS) < int(np.argmax(self.bands[0] == order["band"][0].as_py()))
        asks = np.array(order["asks"].to_pylist(), bool)
        self.members, self.askers = np.flatnonzero(~asks), np.flatnonzero(asks)
        number: dict = {}
        self.own = np.array([number.setdefault(x, len(number)) for x in order["label"].to_pylist()])
        self.root = np.arange(len(number))

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    def joins(self, q: int, u: int) -> bool:
        """Puts the classes of q and u together; false if they were."""
        x, y = self.find(self.own[q]), self.find(self.own[u])
        self.root[x] = y
        return x != y

    def pairs(self, q: int, least: float, most: float) -> list[tuple[float, int]]:
        """share and member, best first, of q's pairs with a share in [least, most) that no earlier bucket has."""
        m = self.members
        share = share_of(self.sig[m], self.sig[q])
        # pairs that share an earlier bucket are that bucket's
        near = (self.own[m] != self.own[q]) & (share >= least) & (share < most) & ~((self.bands[m] == self.bands[q])[:, self.before].any(1))
        todo = np.flatnonzero(near)
        todo = todo[np.argsort(-share[todo], kind="stable")]
        return list(zip(share[todo].tolist(), m[todo].tolist()))


def _by_signatures(table: pa.Table) -> pa.Table:
    """Links a, b of pairs that signatures settle; and, with b null, each node a that is in an unsettled pair."""
    cell, out = _Cell(table), []
    for q in cell.askers.tolist():
        for _, u in cell.pairs(q, SURELY, 2.0):
            if cell.joins(q, u):
                out.append((cell.node[q], cell.node[u], False, False))
    asking, asked = set(), set()
    for q in cell.askers.tolist():
        own = cell.find(cell.own[q])
        left = [u for _, u in cell.pairs(q, HARDLY, SURELY) if cell.find(cell.own[u]) != own]
        if left:
            asking.add(q)
            asked.update(left)
    out += [(cell.node[i], None, i in asking, i in asked) for i in asking | asked]
    a, b, asks, member = zip(*out) if out else ((), (), (), ())
    band = pa.array([table["band"][0].as_py()] * len(out), pa.int64())
    return pa.table([band, pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(asks, pa.bool_()), pa.array(member, pa.bool_())], names=["band", "a", "b", "asks", "member"])


def _by_texts(table: pa.Table) -> pa.Table:
    """Links a, b of the unsettled pairs that are similar."""
    cell, sets, a, b = _Cell(table), _Sets(), [], []
    text = cell.table["text"].to_pylist()
    for q in cell.askers.tolist():
        for share, u in cell.pairs(q, HARDLY, SURELY):
            if cell.find(cell.own[q]) != cell.find(cell.own[u]) and _similar(share, text[q], text[u], sets):
                cell.joins(q, u)
                a.append(cell.node[q])
                b.append(cell.node[u])
    return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _within(rest: DataFrame, labels: DataFrame, marks: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame | None:
    """Links between classes inside buckets (centres left out) whose members are of several classes."""
    placed = staged(rest.join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label")), "rest")
    sizes = placed.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"))
    top = F.max(F.struct("n", "label"))
    mixed = sizes.groupBy("band").agg(
        top["label"].alias("largest"), _blocks(F.sum("n")).alias("rows"), _blocks(F.sum("n") - top["n"]).alias("columns"), F.count(F.lit(1)).alias("labels")
    ).where("labels > 1")
    asked = placed.join(staged(mixed, "bands"), "band").select("band", "node", "label", F.lit(True).alias("member"), (F.col("label") != F.col("largest")).alias("asks"), "rows", "columns")
    some = staged(asked, "mixed")
    unstage(placed)
    if some.isEmpty():
        return None
    cells = _cells(some).join(marks, "node").groupBy("band", "row", "column")
    signed = staged(cells.applyInArrow(_by_signatures, "band long, a binary, b binary, asks boolean, member boolean"), "signed")
    links = signed.where("b IS NOT NULL").select("a", "b")
    open_ = signed.where("b IS NULL").groupBy("band", F.col("a").alias("node")).agg(F.max("asks").alias("asks"), F.max("member").alias("member"))
    left = staged(open_.join(some.select("band", "node", "label"), ["band", "node"]), "unsettled")
    unstage(some)
    if left.isEmpty():
        return links
    wanted = left.select("node").distinct()
    bodies = staged(marks.join(wanted, "node").join(_texts_of(wanted, nodes, texts), "node", "left"), "bodies")
    sized = left.join(bodies.select("node", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")), "node")
    of = lambda side: _blocks(F.count_if(side), F.sum(F.when(F.col(side), F.col("bytes")).otherwise(0)))
    grid = staged(sized.groupBy("band").agg(of("member").alias("rows"), of("asks").alias("columns")), "grid")
    cells = _cells(left.join(grid, "band")).join(bodies, "node").groupBy("band", "row", "column")
    return links.unionByName(staged(cells.applyInArrow(_by_texts, "a binary, b binary"), "within"))
