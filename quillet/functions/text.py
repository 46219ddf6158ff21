"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillet.functions import fixed

#: Unicode white space, in a form that Java and RE2 read alike.
WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The same class and what is not in it, for Java: printable ASCII, most of any text, is told by its first range alone.
_BLANK, _INK = f"[[^!-~]&&{WS}]", f"[!-~[^{WS[1:]}]"
MARKERS = r"^[#*`~_=-]+$"


def first_non_blank(*columns: Column) -> Column:
    return F.coalesce(*[F.when(normalise_space(c) != "", c) for c in columns])


def normalise_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, _BLANK + "+", " "))


def tokens(c: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(normalise_space(c), " "), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(tokens(c))


def truncate_words(c: Column, n: int) -> Column:
    """The first n words; of a long text only these are looked at, where n is small enough for a pattern."""
    start = F.regexp_extract(c, rf"^{_BLANK}*+(?:{_INK}++{_BLANK}*+){{0,{n}}}+", 0) if 0 < n <= 100 else c
    return F.array_join(F.slice(tokens(start), 1, max(n, 0)), " ") if n > 0 else F.when(c.isNotNull(), F.lit(""))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", "")


def decode_basic_entities(c: Column) -> Column:
    """The five XML entities and the no-break space; `&amp;` last, so decoding is done once."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def clean_short(c: Column) -> Column:
    """Tags go before entities are decoded, so an escaped tag survives as text."""
    return normalise_space(decode_basic_entities(strip_tags(c)))


def clean_prose(c: Column) -> Column:
    return F.array_join(F.filter(tokens(c), lambda w: ~w.rlike(MARKERS)), " ")


def kebab(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def topic_slug(c: Column) -> Column:
    """Empty where the slug says nothing: too short, too long or a filing category."""
    slug = kebab(decode_basic_entities(c))
    return F.when((F.length(slug) < 2) | (F.length(slug) > 40) | slug.isin(*fixed.UNINFORMATIVE_CATEGORIES), "").otherwise(slug)


def article_topics(tags: Column, categories: Column) -> Column:
    """The source's tags, all of them, then at most three new category slugs while under eight in all."""
    own = F.array_distinct(F.filter(tags, lambda t: t != ""))
    new = F.array_except(F.array_distinct(F.filter(F.transform(categories, topic_slug), lambda t: t != "")), own)
    room = F.greatest(F.lit(0), F.least(F.lit(fixed.MAX_CATEGORY_TOPICS), fixed.MAX_TOPICS - F.size(own)))
    return F.concat(own, F.slice(new, F.lit(1), room))


def clean_name(c: Column) -> Column:
    """A display name, or null where it names nothing."""
    edge = r"[ \t\"'*`_|:·–—-]"
    name = F.regexp_replace(F.regexp_replace(decode_basic_entities(c), r"\s+", " "), f"^{edge}+|{edge}+$", "")
    name = F.trim(F.regexp_replace(name, r"^[*\-•0-9.)\s]+", ""))
    bad = (
        (name == "") | (F.char_length(name) > fixed.MAX_NAME_LENGTH) | F.lower(name).isin(*fixed.GENERIC_NAMES)
        | name.rlike(r"^\[.*\]$") | name.contains("http://") | name.contains("https://") | name.startswith("!")
    )
    return F.when(~bad, name)


def sanitise_key(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9_-]", "-")


def article_id(source: Column, url: Column) -> Column:
    return F.concat(sanitise_key(source), F.lit("-"), F.substring(F.sha2(url.cast("binary"), 256), 1, 16))


def log_query(c: Column) -> Column:
    flat = F.regexp_replace(c, r"\p{Cc}", " ")
    return F.when(F.char_length(flat) > 128, F.concat(F.left(flat, F.lit(128)), F.lit("…"))).otherwise(flat)


def clamp_query(c: Column) -> Column:
    return F.left(F.trim(c), F.lit(fixed.MAX_QUERY_CHARS))


def trimmed_text(c: Column, n: int) -> Column:
    return F.nullif(F.left(F.trim(c), F.lit(n)), F.lit(""))


def search_terms(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def seed_tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")
