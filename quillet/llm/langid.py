"""Language identification by segmentation-marginalised unigram pieces.

The pieces are the lower-case ones of a fixed public vocabulary, of any length. Each language has a probability per
piece; a forward pass over a word sums the probability of every segmentation of it into pieces, and since pieces
never cross white space, a text's likelihood is the product over its words. The pass is rescaled as it goes, so
words of any length stay in range. Piece probabilities are learned by expectation-maximisation: walking back over
the forward pass gives each piece's expected count, in shares that lie between 0 and 1. Distinct words are scored
once per worker and kept.

What is bounded: the model knows the `languages` values of the language column that have most labelled rows (ties by
name), and fits each on at most `language_rows` of its different texts, those with the least hashes, so equal tables
give equal samples, copies add nothing and a rare language keeps its rows. Language shares are counts of all labelled
rows. In training a word is read in stretches of at most STRETCH characters; in prediction it is read whole.

Defined results: a null text, or one without a letter, is `und` with score 0; rows without a language or with
a null text teach nothing; repeated rows get equal results; a tie goes to the first language by name; with no
training rows every text is `und`; an empty table gives an empty table; only the id, text and, for training,
language columns are read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillet.llm.common import crc_of_id, give_back, staged, unstage

UNDETERMINED = "und"
START = "▁"
#: Probability of a character that no piece spells, and the least one of any piece.
UNSEEN = 1e-8
#: Columns between two rescalings (UNSEEN to that power is far from underflow), characters that a table holds of each
#: word, and word x character x language cells that are worked on at once.
RESCALE, STRETCH, CELLS = 24, 4096, 600_000
#: Word x language likelihoods that a worker keeps.
KEPT_CELLS = 1_000_000
_MULTIPLIER, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def has_letter(text: str) -> bool:
    """Whether a character is a letter: number signs such as a half or a Roman four are none."""
    return any(c.isalpha() for c in text)


def vocabulary(path: str | None = None) -> list[str]:
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return sorted({p for p in pieces if p and p == p.lower()})


class Pieces:
    """Finds the vocabulary's pieces in batches of words."""

    def __init__(self, path: str | None = None):
        self.names = vocabulary(path)
        self.longest = max(map(len, self.names))
        self.by_length, self.marked = [], np.zeros(1 << 20, bool)
        order = {p: i for i, p in enumerate(self.names)}
        for n in range(1, self.longest + 1):
            mine = [p for p in self.names if len(p) == n]
            keys = []
            for p in mine:
                k = 0
                for c in p:
                    k = (k * int(_MULTIPLIER) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                keys.append(k)
            keys = np.array(keys, np.uint64)
            by = np.argsort(keys)
            self.by_length.append((keys[by], np.array([order[p] for p in mine], np.int64)[by]))
            self.marked[self._mark(keys)] = True
        self.none = len(self.names)  # no piece
        self.unseen = len(self.names) + 1  # a character without a piece

    @staticmethod
    def _mark(keys: np.ndarray) -> np.ndarray:
        return (keys * _SPREAD >> np.uint64(44)).astype(np.int64)

    def _find(self, n: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in keys, a flat array, where a piece of n characters ends, and the pieces."""
        known, numbers = self.by_length[n - 1]
        at = np.flatnonzero(self.marked[self._mark(keys)]) if len(known) else np.zeros(0, np.int64)
        if not len(at):
            return at, at
        found = np.minimum(np.searchsorted(known, keys[at]), len(known) - 1)
        hit = known[found] == keys[at]
        return at[hit], numbers[found[hit]]

    def table(self, words: list[str], lo: int, hi: int):
        """Pieces that end in columns lo to hi of the words: one row of single characters a column, and for each longer
        length the words and pieces, with the edges of each column's share of them."""
        first = max(0, lo - self.longest + 1)
        width = hi - first
        flat = np.frombuffer("".join([w[first:hi].ljust(width, "\0") for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
        base = np.ascontiguousarray(flat.reshape(len(words), width).T).astype(np.uint64) + np.uint64(1)
        key, n = base, len(words)
        ones = np.full(base[lo - first :].size, self.unseen, np.int64)
        at, piece = self._find(1, base[lo - first :].ravel())
        ones[at] = piece
        longer = []
        for k in range(2, min(self.longest, width) + 1):
            key = key[:-1] * _MULTIPLIER + base[k - 1 :]  # row i: the k characters that end in column first + k - 1 + i
            skip = max(0, lo - first - (k - 1))
            at, piece = self._find(k, key[skip:].ravel())
            if len(at):
                column = at // n + first + k - 1 + skip - lo
                longer.append((k, at % n, piece, np.searchsorted(column, np.arange(hi - lo + 1))))
        return ones.reshape(hi - lo, n), longer

    def sweep(self, words: list[str], probs: np.ndarray, steps: list | None = None) -> np.ndarray:
        """log P(word) over all segmentations, for words that start with the mark of a word's start.

        Into steps go, for each column, shares (k, words, pieces, share): of the probability up to that column, the part
        in which the last piece is that one; words None stands for all.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        width = int(lengths.max())
        scale, out = np.zeros((len(words), probs.shape[1])), np.empty((len(words), probs.shape[1]))
        past = [np.ones_like(scale)]  # probabilities up to the last columns
        ends = set(lengths.tolist())
        for lo in range(0, width, STRETCH):
            ones, longer = self.table(words, lo, min(lo + STRETCH, width))
            for t in range(len(ones)):
                single = past[-1] * probs[ones[t]]
                now, parts = single.copy(), []
                for k, of, piece, edges in longer:
                    i, j = edges[t], edges[t + 1]
                    if j > i and k <= len(past):
                        mass = past[-k][of[i:j]] * probs[piece[i:j]]
                        now[of[i:j]] += mass
                        parts.append((k, of[i:j], piece[i:j], mass))
                if steps is not None:
                    steps.append([(1, None, ones[t], single / now), *((k, of, piece, mass / now[of]) for k, of, piece, mass in parts)])
                place = lo + t + 1
                if place in ends:
                    which = lengths == place
                    out[which] = np.log(now[which]) + scale[which]
                past.append(now)
                if place % RESCALE == 0 and place < width:
                    scale += np.log(now)
                    past = [x / now for x in past[-self.longest :]]
                elif len(past) > 2 * self.longest:
                    past = past[-self.longest :]
        return out

    def log_likelihood(self, words: list[str], probs: np.ndarray) -> np.ndarray:
        """log P(word | language) for each word."""
        marked = [START + w for w in words]
        out = np.empty((len(words), probs.shape[1]))
        for which in self._buckets(marked, probs.shape[1]):
            out[which] = self.sweep([marked[i] for i in which], probs)
        return out

    def expected(self, words: list[str], weights: np.ndarray, probs: np.ndarray) -> np.ndarray:
        """Expected piece counts, (pieces + 2) x languages, of weighted words."""
        out = np.zeros_like(probs)
        marked, own = [], []
        for i, w in enumerate(words):
            whole = START + w
            for at in range(0, len(whole), STRETCH):
                marked.append(whole[at : at + STRETCH])
                own.append(i)
        weights = weights[own]
        for which in self._buckets(marked, probs.shape[1]):
            some = [marked[i] for i in which]
            lengths = np.fromiter(map(len, some), np.int64, len(some))
            steps: list = []
            self.sweep(some, probs, steps)
            reach = np.zeros((len(steps) + 1, len(some), probs.shape[1]))  # expected times that a piece ends there
            reach[lengths, np.arange(len(some))] = weights[which]
            pieces, masses = [], []
            for t in range(len(steps) - 1, -1, -1):
                for k, of, piece, share in steps[t]:
                    mass = share * (reach[t + 1] if of is None else reach[t + 1][of])
                    if of is None:
                        reach[t] += mass
                    else:
                        reach[t + 1 - k][of] += mass
                    pieces.append(piece)
                    masses.append(mass)
            piece, mass = np.concatenate(pieces), np.concatenate(masses)
            for lang in range(probs.shape[1]):
                out[:, lang] += np.bincount(piece, mass[:, lang], len(out))
        return out

    @staticmethod
    def _buckets(words: list[str], languages: int):
        """Words of similar lengths together, as many as CELLS allows."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        by = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(by):
            # up to a quarter longer than the first, and no more cells than allowed
            end = int(np.searchsorted(lengths[by], int(lengths[by[at]]) * 5 // 4 + 1, "right"))
            most = max(1, CELLS // (languages * min(int(lengths[by[end - 1]]), STRETCH)))
            end = min(end, at + most)
            yield by[at:end]
            at = end


_pieces: dict = {}


def pieces(path: str | None) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


class Model:
    """languages, log prior per language, piece probabilities (pieces + 2 rows: no piece, unseen character)."""

    def __init__(self, languages: list[str], prior: np.ndarray, probs: np.ndarray, path: str | None):
        self.languages, self.prior, self.probs, self.path = languages, prior, probs, path


def _smoothed(counts: np.ndarray, strength: float = 0.05) -> np.ndarray:
    n = len(counts) - 2
    out = np.zeros_like(counts)
    out[:n] = np.maximum((counts[:n] + strength) / (counts[:n].sum(0) + strength * n), UNSEEN)
    out[n + 1] = UNSEEN
    return out


def sampled(rows: DataFrame, counts: list, language_rows: int) -> DataFrame:
    """Of rows(text, lang), for each language of counts(lang, n, texts) at most language_rows different texts.

    texts is about how many different ones there are. A share of them by hash is taken, a half too many, and cut to
    the least hashes, so that no window holds more than that.
    """
    shares = [(r["lang"], min(1.0, 1.5 * language_rows / max(1, r["texts"]))) for r in counts]
    bounded = rows.sparkSession.createDataFrame(shares, "lang string, share double")
    hashed = rows.withColumn("h", F.xxhash64("text"))
    drawn = hashed.join(F.broadcast(bounded), "lang").where(F.shiftrightunsigned("h", 11) / float(1 << 53) < F.col("share"))
    different = drawn.groupBy("lang", "h").agg(F.min("text").alias("text"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    return different.withColumn("rank", rank).where(F.col("rank") <= language_rows).select("text", "lang")


def train(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", path: str | None = None, language_rows: int = 5_000, languages: int = 200, rounds: int = 2
) -> Model | None:
    """Fit on labelled rows within the bounds of the module's text; None where there are none."""
    rows = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64("text")).alias("texts"))
    known = counts.orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not known:
        return None

    def tally(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                found: dict[str, Counter] = {}
                for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    found.setdefault(lang, Counter()).update(text.lower().split())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([l for l, c in found.items() for _ in c], pa.string()),
                        pa.array([w for c in found.values() for w in c], pa.string()),
                        pa.array([x for c in found.values() for x in c.values()], pa.int64()),
                    ],
                    names=["lang", "word", "n"],
                )
        give_back()

    words = staged(sampled(rows, known, language_rows).mapInArrow(tally, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "langwords")
    names = sorted(r["lang"] for r in known)
    n = {r["lang"]: r["n"] for r in known}
    prior = np.log(np.array([n[l] for l in names], float) / sum(n.values()))
    number = {l: i for i, l in enumerate(names)}
    size = len(vocabulary(path)) + 2
    probs = np.full((size, len(names)), 1.0 / size)
    probs[-2], probs[-1] = 0, UNSEEN
    for _ in range(rounds):
        current = probs

        def expect(batches):
            finder = pieces(path)
            total = np.zeros_like(current)
            for batch in batches:
                weights = np.zeros((batch.num_rows, len(names)))
                weights[np.arange(batch.num_rows), [number[l] for l in batch.column(0).to_pylist()]] = batch.column(2).to_numpy(zero_copy_only=False)
                total += finder.expected(batch.column(1).to_pylist(), weights, current)
            piece, lang = np.nonzero(total)
            give_back()
            yield pa.RecordBatch.from_arrays(
                [pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(total[piece, lang])], names=["piece", "lang", "n"]
            )

        # at most pieces x languages rows come to the driver
        found = words.repartition("word").mapInArrow(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        counted = np.zeros_like(probs)
        counted[found["piece"].to_numpy(), found["lang"].to_numpy()] = found["n"].to_numpy()
        probs = _smoothed(counted)
    unstage(words)
    return Model(names, prior, probs, path)


class Scorer:
    """Posterior of each text's languages; keeps the likelihood rows of known words."""

    def __init__(self, model: Model):
        self.model, self.finder = model, pieces(model.path)
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.languages)))

    def learn(self, words: list[str]) -> None:
        first = len(self.known)
        self.known.update(zip(words, range(first, first + len(words))))
        need = first + len(words)
        if need > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(need, 1 << 16), self.rows.shape[1]))])
        self.rows[first:need] = self.finder.log_likelihood(words, self.model.probs)

    def classify(self, texts: list[str | None]) -> list[tuple[str, float]]:
        split = [t.lower().split() if t and has_letter(t) else None for t in texts]
        known = self.known
        distinct = set().union(*(words for words in split if words))
        fresh = distinct.difference(known)
        if (len(known) + len(fresh)) * len(self.model.languages) > KEPT_CELLS and known:
            known.clear()
            self.rows = np.zeros((0, self.rows.shape[1]))
            fresh = distinct
        if fresh:
            self.learn(list(fresh))
        out = []
        for words in split:
            if not words:
                out.append((UNDETERMINED, 0.0))
                continue
            at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            post = self.model.prior + self.rows[at].sum(0)
            best = int(post.argmax())
            out.append((self.model.languages[best], float(1 / np.exp(post - post[best]).sum())))
        return out


def predict(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """All columns of df, lang_pred and score; columns of these names are replaced."""
    if model is None:
        return df.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)})
    df = df.drop("lang_pred", "score")
    at = df.columns.index(text_col)
    names = [*df.columns, "lang_pred", "score"]
    schema = df.withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0)}).schema

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 250):
                part = batch.slice(lo, 250)
                found = scorer.classify(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=names
                )
        del scorer
        give_back()

    return df.mapInArrow(run, schema)


def training_rows(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 3, is not 1."""
    return F.pmod(crc_of_id(id_col), F.lit(3)) != 1
