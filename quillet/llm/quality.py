"""Quality rules by distribution divergence, with DataFrame functions only.

Beside the base counts, each document's character-class histogram, in which every character is counted once, and its
histogram over the most common words of its language, of any length, are compared to references of that language by
Jensen-Shannon distance (base 2, 0 to 1). A text
without common words lies at a distance that the reference fixes by its share of other words; a text as far as
BARE of that distance is rejected, so that word salad and texts in another language do not pass, unless chance takes a clean
text of its length that far (few common words in the reference) and it has FEW of their expected number. The
references are sums over all documents of the language and are joined by language. A language with little text
of its own, or none given, has no reference, and its documents are not judged by divergence; nor are documents
under a minimum length, since their histograms are noise.

Defined results: a null text has no words and fails the base rule; repeated rows get equal results; a null
or empty language has no reference; an empty table gives an empty table; only the id, text and language
columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillet.llm.common import SPACE_CLASS, staged, unstage

#: Fixed values of the base rules.
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = r"[#*$%&|<>]"
CLASSES = ("letter", "upper", "digit", "punctuation", "wide letter", "space", "other")
ANY = ""
#: Part of the distance of a text without common words that a text may have.
BARE = 0.95
#: A squared distance up to so many times the mean one of clean texts of that length can be chance.
NOISE = 2.0
#: Part of the expected common words under which a text has too few of them.
FEW = 0.25


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")


#: What is taken out of a text without white space, class by class; what is left at the end is "other" (and white space that was not taken out).
_TAKEN = ("[a-z]+", "[A-Z]+", "[0-9]+", r"[!-/:-@\[-`{-~]+", r"[\p{L}\p{M}]+")


def _class_counts(chars: Column, joined_chars: Column, lefts: Column, spaces: Column | None = None) -> Column:
    """Counts of CLASSES from the characters that are left after each of _TAKEN, and the white space that was joined with them."""
    taken = [F.get(lefts, F.lit(i)) - F.get(lefts, F.lit(i + 1)) for i in range(len(_TAKEN))]
    outside, other = chars - joined_chars, F.get(lefts, F.lit(len(_TAKEN)))
    space, other = (outside, other) if spaces is None else (outside + spaces, other - spaces)
    return F.array(*[x.cast("double") for x in (*taken, space, other)])


def _with_classes(rows: DataFrame, joined: str) -> DataFrame:
    """rows, __lefts and what is left in the end, one projection a step, so that no step is done twice."""
    for i, pattern in enumerate(_TAKEN):
        source = joined if i == 0 else "__left"
        before = F.array(F.char_length(joined)) if i == 0 else F.col("__lefts")
        rows = rows.withColumn("__next", F.regexp_replace(source, pattern, ""))
        rows = rows.withColumn("__lefts", F.concat(before, F.array(F.char_length("__next")))).withColumn("__left", F.col("__next")).drop("__next")
    return rows


def _repeat_words(hashes: Column) -> Column:
    """Words inside windows that occur twice or more, from the windows' hashes in order."""
    # sort_array, unlike array_sort, compares without evaluating a lambda
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

        def step(a, p):
            p = p.cast("long")
            return F.struct((a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n"), (p + WINDOW).alias("end"))

        return F.aggregate(F.sort_array(at), start, step, lambda a: a["n"])

    def repeated(s: Column) -> Column:
        last = F.size(s) - 1
        same = lambda e, k: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
        return F.transform(F.filter(s, lambda e, k: same(e, k - 1) | ((k < last) & same(e, k + 1))), lambda e: e["i"])

    # a one-element transform binds the sorted pairs once
    return F.element_at(F.transform(F.array(pairs), lambda s: covered(repeated(s))), 1)


def _read(df: DataFrame, id_col: str | None, text_col: str, lang_col: str) -> DataFrame:
    kept = [F.col(id_col)] if id_col else []
    return df.select(*kept, F.coalesce(F.col(lang_col), F.lit(ANY)).alias("__lang"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))


def measures(read: DataFrame, id_col: str, common: int, *kept: str) -> DataFrame:
    """id, the base counts, class counts, the number of each common word, and the columns kept.

    __keys of read holds the hashes of the at most `common` common words of the row's language.
    """
    text = F.col("__text")
    split = read.select("*", words_of(text).alias("__words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"))
    n = F.size("__words")
    counted = split.select(
        id_col,
        *kept,
        "__keys",
        F.char_length(text).alias("__chars"),
        n.cast("long").alias("n_words"),
        F.array_join("__words", "").alias("__joined"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__hashes"),
        F.when(F.size("__keys") > 0, F.transform("__words", lambda w: F.xxhash64(F.lower(w)))).alias("__low"),
    )
    h = lambda i: F.get("__hashes", i)
    windows = F.when(
        F.col("n_words") >= WINDOW,
        F.transform(F.slice("__hashes", F.lit(1), F.col("n_words").cast("int") - (WINDOW - 1)), lambda x, i: F.xxhash64(x, *[h(i + k) for k in range(1, WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    ready = _with_classes(counted.withColumn("__windows", windows), "__joined")
    # compiled removals of each key, which find a word faster than a lambda that looks each word up
    hits = F.array(*[F.size("__low") - F.size(F.array_remove("__low", F.get("__keys", F.lit(k)))) for k in range(common)])
    repeats = F.size(F.array_distinct("__windows")) < F.size("__windows")
    word_chars = F.char_length("__joined")
    return ready.select(
        id_col,
        *kept,
        "n_words",
        word_chars.cast("long").alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        F.when(repeats, _repeat_words(F.col("__windows"))).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
        _class_counts(F.col("__chars"), word_chars, F.col("__lefts")).alias("__classes"),
        F.slice(hits, F.lit(1), F.size("__keys")).alias("__hits"),
    )


def references(df: DataFrame, text_col: str, lang_col: str, common: int, least_words: int) -> DataFrame:
    """__lang, class shares, hashes of the common words, their shares and the share of all others, per language with enough text.

    One scan counts all words, another the characters of each class, without cutting texts into words: only blanks are taken out, by
    plain search, so that runs of letters are long and few, and other white space is told apart in the little that is left. A language has a
    reference from least_words words on, whatever its part of the table; nothing comes to the driver.
    """
    text = F.col("__text")
    read = _read(df, None, text_col, lang_col).where("__text <> '' AND __lang <> ''")
    joined = _with_classes(read.select("__lang", F.char_length(text).alias("__chars"), F.replace(text, F.lit(" "), F.lit("")).alias("__joined")), "__joined")
    spaces = F.char_length("__left") - F.char_length(F.regexp_replace("__left", SPACE_CLASS + "+", ""))
    classes = joined.withColumn("__spaces", spaces).select("__lang", _class_counts(F.col("__chars"), F.char_length("__joined"), F.col("__lefts"), F.col("__spaces")).alias("c"))
    sums = classes.groupBy("__lang").agg(F.array(*[F.sum(F.get("c", F.lit(i))) for i in range(len(CLASSES))]).alias("c"))
    words = read.select("__lang", F.explode(words_of(F.lower(text))).alias("word"))
    counts = staged(words.groupBy("__lang", "word").agg(F.count(F.lit(1)).alias("n")), "counts")
    totals = counts.groupBy("__lang").agg(F.sum("n").cast("double").alias("words"))
    rank = F.row_number().over(W.partitionBy("__lang").orderBy(F.desc("n"), "word"))
    top = counts.withColumn("r", rank).where(f"r <= {common}")
    tops = top.groupBy("__lang").agg(F.sort_array(F.collect_list(F.struct("r", "word", "n"))).alias("top"))
    shares = F.coalesce(F.transform("top", lambda x: x["n"] / F.col("words")), F.array().cast("array<double>"))
    rest = 1 - F.aggregate("__shares", F.lit(0.0), lambda a, x: a + x)
    known = sums.join(totals, "__lang", "left").withColumn("words", F.coalesce("words", F.lit(0.0))).where(F.col("words") >= least_words)
    refs = known.join(tops, "__lang", "left").withColumn("__shares", shares).select(
        "__lang",
        _shares(F.col("c")).alias("__class_ref"),
        F.transform(F.coalesce(F.col("top.word"), F.array().cast("array<string>")), lambda w: F.xxhash64(w)).alias("__keys"),
        F.concat("__shares", F.array(F.greatest(F.lit(0.0), rest))).alias("__word_ref"),
    )
    found = staged(refs, "references")
    unstage(counts)
    return found


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance, 0 to 1, of two share arrays of one length."""

    def part(x, m):
        return F.when((x > 0) & (m > 0), x * F.log2(x / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, t: a + t) / 2))


def bare_distance(rest: Column) -> Column:
    """Distance of a text without common words from a reference with this share of other words."""
    m = (1 + rest) / 2
    other = F.when(rest > 0, rest * F.log2(rest / m)).otherwise(F.lit(0.0)) - F.log2(m)
    return F.sqrt(F.greatest(F.lit(0.0), 1 - rest + other) / 2)


def lacks_words(distance: Column, word_ref: Column, n_words: Column, n_common: Column) -> Column:
    """Whether a text of so many words, n_common of them common ones, lies as far as one without any."""
    n, rest = F.greatest(n_words, F.lit(1)), F.element_at(word_ref, -1)
    chance = (F.size(word_ref) - 1) / (8 * math.log(2) * n)
    sure = (n_common < FEW * (1 - rest) * n) | (distance * distance > NOISE * chance)
    return (distance > BARE * bare_distance(rest)) & sure


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    # a one-element transform binds the total once
    return F.element_at(F.transform(F.array(total), lambda t: F.transform(counts, lambda x: F.when(t > 0, x / t).otherwise(F.lit(0.0)))), 1)


def judge(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    common: int = 24,
    min_words: int = 60,
    max_class_distance: float = 0.3,
    min_docs: int = 50,
) -> DataFrame:
    """id, base counts, base_failed, kept, class_distance and word_distance (null where not judged by them)."""
    # the text of min_docs documents of the least length that is judged
    refs = references(df, text_col, lang_col, common, min_docs * min_words)
    read = _read(df, id_col, text_col, lang_col).join(refs, "__lang", "left")
    rows = measures(read, id_col, common, "__class_ref", "__word_ref")
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    n_common = F.aggregate(F.col("__hits"), F.lit(0), lambda a, x: a + x)
    hist = rows.withColumn("__n_common", n_common).withColumn(
        "__hist", F.concat(F.transform("__hits", lambda x: x.cast("double")), F.array((F.col("n_words") - F.col("__n_common")).cast("double")))
    )
    long = (F.col("n_words") >= min_words) & F.col("__class_ref").isNotNull()
    far = hist.select(
        id_col,
        *_BASE,
        base_failed.alias("base_failed"),
        F.when(long, jensen_shannon(_shares(F.col("__classes")), F.col("__class_ref"))).alias("class_distance"),
        F.when(long, jensen_shannon(_shares(F.col("__hist")), F.col("__word_ref"))).alias("word_distance"),
        "__word_ref",
        "__n_common",
    )
    lacks = lacks_words(F.col("word_distance"), F.col("__word_ref"), F.col("n_words"), F.col("__n_common"))
    fits = F.col("class_distance").isNull() | ((F.col("class_distance") <= max_class_distance) & ~lacks)
    return far.select(id_col, *_BASE, "base_failed", (~F.col("base_failed") & fits).alias("kept"), "class_distance", "word_distance")


_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
