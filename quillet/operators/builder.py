"""The source list: candidates, merges, ids, overrides, validation and audit."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillet.functions import fixed, text, urls
from quillet.sources import documents as src
from quillet.sources import storage


def unique_ids(rows: DataFrame, base: str, order: list[str], out: str, reserved: DataFrame | None = None) -> DataFrame:
    """base, base-2, base-3 ... in order; ids in `reserved` (column id) are passed over."""
    numbered = storage.numbered(rows, [base], order, "__n")
    if reserved is None:
        return numbered.withColumn(out, F.when(F.col("__n") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), F.col("__n").cast("string")))).drop("__n")
    # numbers of a base that are taken, in order: the k-th free number is k plus the taken ones at or below it
    taken = reserved.select(
        F.regexp_replace("id", "-[0-9]+$", "").alias("__b"), F.coalesce(F.regexp_extract("id", "-([0-9]+)$", 1).try_cast("int"), F.lit(1)).alias("__t")
    ).unionByName(reserved.select(F.col("id").alias("__b"), F.lit(1).alias("__t"))).groupBy("__b").agg(F.array_sort(F.collect_set("__t")).alias("__taken"))
    start = numbered.join(taken, F.col(base) == F.col("__b"), "left")
    n = F.aggregate(F.coalesce("__taken", F.array().cast("array<int>")), F.col("__n"), lambda a, t: F.when(t <= a, a + 1).otherwise(a))
    return start.withColumn("__k", n).withColumn(out, F.when(F.col("__k") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), F.col("__k").cast("string")))).drop("__n", "__k", "__b", "__taken")


def merge_candidates(rows: DataFrame) -> DataFrame:
    """One row a site: the first name and feed that are there, in arrival order, all tags and origins, and the first `ord`."""
    first = lambda c: F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("ord")))
    together = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    return rows.groupBy("site").agg(first("name").alias("name"), first("feed").alias("feed"), together("tags").alias("tags"), together("origins").alias("origins"), F.min("ord").alias("ord"))


#: Ways in which a file names a site, in the order in which their names count.
OUTLINE, ANCHOR, NAMED, BARE = range(4)


def _order(kind, line, k) -> Column:
    """Arrival order: file by file, outlines and anchors before lines, line by line."""
    return F.struct("path", F.when(kind < NAMED, kind).otherwise(NAMED).alias("part"), line.cast("long").alias("line"), kind.alias("kind"), k.cast("long").alias("k"))


def _line_links(lines: DataFrame) -> DataFrame:
    """path, origin, name, url, feed, ord of entry lines (path, origin, line_no, line): named markdown links, then bare URLs."""
    entry = F.col("line").rlike(r"^\s*(?:[-*+]\s|[0-9]+[.)]\s|\||https?://)") | urls.extension(F.col("path")).isin(*fixed.STRUCTURED_EXTENSIONS)
    rows = lines.where(entry)
    link = r"\[([^\]]{1,160})\]\((https?://[^\s)]+)\)"
    pairs = F.arrays_zip(F.regexp_extract_all("line", F.lit(link), F.lit(1)).alias("name"), F.regexp_extract_all("line", F.lit(link), F.lit(2)).alias("url"))
    none = F.lit(None).cast("string")
    named = rows.select("path", "origin", "line_no", F.posexplode(pairs).alias("k", "x")).select(
        "path", "origin", text.clean_name(F.col("x.name")).alias("name"), F.col("x.url").alias("url"), none.alias("feed"), _order(F.lit(NAMED), F.col("line_no"), F.col("k")).alias("ord")
    )
    bare = rows.select("path", "origin", "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(r"(https?://[^\s<>\"'`\]\)\}]+)"), F.lit(1))).alias("k", "url")).select(
        "path", "origin", none.alias("name"), "url", none.alias("feed"), _order(F.lit(BARE), F.col("line_no"), F.col("k")).alias("ord")
    )
    return named.unionByName(bare)


def anchors(files: DataFrame) -> DataFrame:
    """path, origin, name, url, feed, ord of the links of HTML files (path, origin, content).

    A link's text is a name only where the link is a site itself, not one of its pages.
    """
    tag = r"(?is)<a\s[^>]*?href\s*=\s*[\"']?([^\"'\s>]+)[^>]*>(.*?)</a>"
    pairs = F.arrays_zip(F.regexp_extract_all("content", F.lit(tag), F.lit(1)).alias("url"), F.regexp_extract_all("content", F.lit(tag), F.lit(2)).alias("said"))
    rows = files.where(urls.extension(F.col("path")).isin(".html", ".htm")).select("path", "origin", F.posexplode(pairs).alias("k", "x")).where(urls.is_http(F.col("x.url")))
    clean = urls.clean_url(F.col("x.url"))
    root = F.regexp_replace(clean, "/+$", "") == F.regexp_replace(urls.canonical_site(clean), "/+$", "")
    name = F.when(root, text.clean_name(text.clean_short(F.col("x.said"))))
    return rows.select("path", "origin", name.alias("name"), F.col("x.url").alias("url"), F.lit(None).cast("string").alias("feed"), _order(F.lit(ANCHOR), F.lit(0), F.col("k")).alias("ord"))


def _outline_links(files: DataFrame) -> DataFrame:
    found = src.outlines(files.where(urls.extension(F.col("path")).isin(".opml", ".xml")).select("*", F.struct("path", "origin").alias("file")), "file", "content")
    rows = found.select("file.path", "file.origin", text.clean_name(F.col("name")).alias("name"), F.coalesce("site", "feed").alias("url"), "feed", "pos").where("url IS NOT NULL")
    return rows.select("path", "origin", "name", "url", "feed", _order(F.lit(OUTLINE), F.lit(0), F.col("pos")).alias("ord"))


def _sites(links: DataFrame) -> DataFrame:
    """site, name, feed, ord, origin of links that may be sites and are not the list's own domain."""
    every = links.withColumn("clean", urls.clean_url(F.col("url"))).where("clean IS NOT NULL")
    own = urls.registrable_domain(urls.host(F.col("origin")))
    return every.where(urls.registrable_domain(urls.host(F.col("clean"))) != own).select(urls.canonical_site(F.col("clean")).alias("site"), "name", "feed", "ord", "origin")


def harvest(lines: DataFrame) -> DataFrame:
    """Candidates of list lines (path, origin, line_no, line)."""
    return _sites(_line_links(lines)).drop("feed")


def harvest_files(files: DataFrame) -> DataFrame:
    """Candidates of whole list files (path, origin, content): outlines, then anchors of HTML files, then entry lines."""
    lines = files.select("path", "origin", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    outlined = urls.extension(F.col("path")).isin(".opml")
    return _sites(_outline_links(files).unionByName(anchors(files)).unionByName(_line_links(lines.where(~outlined))))


def harvest_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Candidates of fetched pages: each page is a file of its own domain."""
    return harvest_files(pages.select(src.page_path(F.col(url_col)).alias("path"), F.col(url_col).alias("origin"), F.coalesce(html_col, F.lit("")).alias("content")))


def candidate_rows(found: DataFrame) -> DataFrame:
    """Harvested rows as candidates, with the tags that their lists' names give."""
    feed = F.col("feed") if "feed" in found.columns else F.lit(None).cast("string")
    tags = F.array_union(provenance_tags(F.col("origin")), fallback_tags(F.col("origin")))
    return found.select("site", "name", feed.alias("feed"), tags.alias("tags"), F.array("origin").alias("origins"), "ord")


def drop_platform_roots(entries: DataFrame) -> DataFrame:
    """Without a bare host root where the list also holds tenants of that host."""
    p = F.get(urls.segments(urls.path(F.col("site"))), F.lit(0))
    parts = entries.select("*", urls.host_label(F.col("site")).alias("__host"), p.alias("__first"))
    tenants = parts.where(F.col("__first").isNotNull() & (urls.is_multi_tenant(F.col("__host")) | F.col("__first").rlike("^[@~]"))).select("__host").distinct()
    roots = parts.where(F.col("__first").isNull()).join(tenants, "__host", "left_anti")
    return parts.where(F.col("__first").isNotNull()).unionByName(roots.select(parts.columns)).drop("__host", "__first")


OVERRIDABLE = ("name", "feed", "tags")


def apply_overrides(entries: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides by site key: set fields replace, a full override of an unknown site is an entry of its own."""
    e = entries.withColumn("__key", urls.site_key(F.col("site")))
    o = overrides.select(urls.site_key(F.col("site")).alias("__key"), F.col("site").alias("__site"), *[F.col(c).alias(f"__{c}") for c in OVERRIDABLE])
    both = e.join(o, "__key", "full_outer")
    return both.where(F.col("site").isNotNull() | (F.col("__name").isNotNull() & F.col("__tags").isNotNull())).select(
        F.coalesce("site", "__site").alias("site"), *[F.coalesce(f"__{c}", c).alias(c) for c in OVERRIDABLE]
    )


def unmatched_overrides(entries: DataFrame, overrides: DataFrame) -> DataFrame:
    keys = entries.select(urls.site_key(F.col("site")).alias("__key"))
    o = overrides.withColumn("__key", urls.site_key(F.col("site")))
    return o.join(keys, "__key", "left_anti").where(F.col("name").isNull() | F.col("tags").isNull()).select("site")


def checked_entries(entries: DataFrame) -> DataFrame:
    """The entries, unless one of them breaks a rule: then an error that names the first few."""
    found = violations(entries).orderBy("site", "problem").limit(5).collect()
    if found:
        raise ValueError("; ".join(f"{r['site']}: {r['problem']}" for r in found))
    return entries


def violations(entries: DataFrame) -> DataFrame:
    """site and problem of every entry that breaks a rule."""
    per = lambda c: F.count(F.lit(1)).over(W.partitionBy(c))
    checked = entries.select("*", per("id").alias("__ids"), per("site").alias("__sites"))
    kebab = r"^[a-z0-9]+(-[a-z0-9]+)*$"
    problems = F.array_compact(F.array(
        F.when(F.coalesce(F.trim("id"), F.lit("")) == "", "id missing"),
        F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "name missing"),
        F.when(F.col("__ids") > 1, "id repeated"),
        F.when(F.col("__sites") > 1, "site repeated"),
        F.when(F.col("id").isNotNull() & ~F.col("id").rlike(kebab), "id form"),
        F.when(~urls.is_http(F.col("site")), "site form"),
        F.when(F.exists("tags", lambda t: ~t.rlike(kebab)), "tag form"),
    ))
    return checked.select("site", F.explode(problems).alias("problem"))


def audit(candidates: DataFrame, checked: DataFrame) -> DataFrame:
    """Every candidate with its state, tags and origins as text."""
    seen = checked.select("site").distinct().withColumn("__checked", F.lit(True))
    state = F.when(F.col("__checked").isNull(), "unchecked").when(F.col("error").isNull() & (F.col("status_code") < 400), "yes").otherwise("no")
    return candidates.join(seen, "site", "left").select(
        "site", state.alias("reachable"), F.array_join("tags", ",").alias("tags"), F.array_join(F.array_sort("origins"), " | ").alias("origins"), "error"
    )


def _apart(words: list[str]) -> bool:
    """Whether a tag's keywords are words between blanks or other marks and no two of them can overlap in a text."""
    split = [re.findall(r"\w+", w) for w in words]
    shared = any(set(x) & set(y) for i, x in enumerate(split) for y in split[:i] if words[i] != words[split.index(y)])
    return all(re.fullmatch(r"\w(.*\w)?", w, re.DOTALL) for w in words) and not shared


def tag_scores(rows: DataFrame, vocabulary: dict[str, list[str]], text_col: str, id_col: str, categories_col: str | None = None) -> DataFrame:
    """Tags that a text earns: distinct keywords, and two points for a category that names the tag; the best six.

    A text is read once: its different runs of as many words as keywords have are joined to the dictionary of keywords, whatever
    the number of tags. Only tags with keywords that may overlap one another, or that begin or end with other marks
    than letters, are looked for by a pattern each, in which the first of two such matches counts. Tables of the vocabulary,
    a parameter, are broadcast; of a text's rows nothing goes through the driver.
    """
    spark = rows.sparkSession
    place = {tag: i for i, tag in enumerate(vocabulary)}
    plain = {tag: words for tag, words in vocabulary.items() if _apart(words)}
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    bare = F.regexp_replace(low, r"(?U)^\W+", "")
    words, gaps = F.regexp_extract_all(bare, F.lit(r"(?U)(\w+)"), F.lit(1)), F.regexp_extract_all(bare, F.lit(r"(?U)(\W+)"), F.lit(1))
    numbered = rows.select(F.monotonically_increasing_id().alias("__row"), id_col, low.alias("__low"), words.alias("__w"), gaps.alias("__g"), *([categories_col] if categories_col else []))

    def runs(n: int) -> Column:
        def joined(i: Column) -> Column:
            parts = [F.get("__w", i)]
            for j in range(1, n):
                parts += [F.get("__g", i + (j - 1)), F.get("__w", i + j)]
            return F.concat(*parts)

        return F.col("__w") if n == 1 else F.when(F.size("__w") >= n, F.transform(F.sequence(F.lit(0), F.size("__w") - n), joined))

    found = []
    if plain:
        lengths = sorted({len(re.findall(r"\w+", w)) for words_ in plain.values() for w in words_})
        table = spark.createDataFrame([(w, place[t]) for t, ws in plain.items() for w in set(ws)], "__key string, __at int")
        every = F.array_distinct(F.concat(*[F.coalesce(runs(n), F.array().cast("array<string>")) for n in lengths]))
        hits = numbered.select("__row", id_col, F.explode(every).alias("__key")).join(F.broadcast(table), "__key")
        found.append(hits.groupBy("__row", id_col, "__at").agg(F.count(F.lit(1)).alias("points")))
    rest = {tag: words_ for tag, words_ in vocabulary.items() if tag not in plain}
    if rest:
        count = lambda ws: F.size(F.array_distinct(F.regexp_extract_all("__low", F.lit(r"(?U)\b(" + "|".join(map(re.escape, ws)) + r")\b"), F.lit(1)))).cast("long")
        scanned = F.array(*[F.struct(F.lit(place[t]).alias("__at"), count(ws).alias("points")) for t, ws in rest.items()])
        found.append(numbered.select("__row", id_col, F.inline(scanned)).where("points > 0"))
    if categories_col:
        names = {(a, place[t]) for t, ws in vocabulary.items() for a in (t, *(w.replace(" ", "-") for w in ws))}
        table = spark.createDataFrame(sorted(names), "__key string, __at int")
        named = numbered.select("__row", id_col, F.explode(F.transform(categories_col, text.kebab)).alias("__key")).join(F.broadcast(table), "__key")
        found.append(named.select("__row", id_col, "__at").distinct().withColumn("points", F.lit(fixed.CATEGORY_SCORE).cast("long")))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    tags = spark.createDataFrame([(i, t) for t, i in place.items()], "__at int, tag string")
    scored = every.groupBy("__row", id_col, "__at").agg(F.sum("points").alias("score")).where(F.col("score") >= fixed.MIN_TAG_SCORE)
    best = F.row_number().over(W.partitionBy("__row").orderBy(F.desc("score"), "__at"))  # a text's tags
    return scored.withColumn("__r", best).where(F.col("__r") <= fixed.MAX_TAGS).join(F.broadcast(tags), "__at").select(id_col, "tag", F.col("score").cast("int"))


def load_vocabulary(yaml_text: str) -> dict[str, list[str]]:
    """tag -> keywords in lower case, in the file's order; a tag without keywords, or one given twice, is an error."""
    import yaml

    entries = yaml.safe_load(yaml_text) or []
    pairs = entries.items() if isinstance(entries, dict) else [(e.get("tag"), e.get("keywords")) for e in entries]
    found: dict[str, list[str]] = {}
    for tag, words in pairs:
        words = [str(w).strip().lower() for w in words or [] if str(w).strip()]
        if not tag or not words or tag in found:
            raise ValueError(f"tag {tag!r} needs keywords and may be given once")
        found[tag] = words
    return found


def tag_order(vocabulary: dict[str, list[str]], fallback: tuple[str, ...] = (fixed.FALLBACK_TAG,)) -> list[str]:
    """Subjects, then tags of provenance, then those given where nothing else is known."""
    return list(dict.fromkeys([*vocabulary, *fixed.PROVENANCE_TAGS, *fallback]))


def ordered_tags(tags, order: list[str]):
    """Known tags in vocabulary order, others by name, six at most."""
    slugs = F.array_distinct(F.filter(F.transform(tags, text.kebab), lambda t: t != ""))
    known = F.filter(F.array(*[F.lit(t) for t in order]), lambda t: F.array_contains(slugs, t))
    return F.slice(F.concat(known, F.array_sort(F.array_except(slugs, known))), 1, fixed.MAX_TAGS)


def _by_tokens(t: Column, rules) -> Column:
    """The tags of the rules of which a word, or all words of a group, are among an address's words."""
    has = lambda w: F.array_contains(t, w) if isinstance(w, str) else F.size(F.array_except(F.array(*map(F.lit, w)), t)) == 0
    met = lambda words: functools.reduce(operator.or_, map(has, words))
    return F.array_compact(F.array(*[F.when(met(words), tag) for tag, words in rules]))


def _once(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _or_fallback(found: Column) -> Column:
    return _once(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(F.lit(fixed.FALLBACK_TAG))))


def provenance_tags(seed: Column) -> Column:
    return _once(text.seed_tokens(seed), lambda t: _by_tokens(t, fixed.PROVENANCE_RULES))


def fallback_tags(seed: Column) -> Column:
    return _or_fallback(_once(text.seed_tokens(seed), lambda t: _by_tokens(t, fixed.FALLBACK_RULES)))


def repository_tags(seeds: Column) -> Column:
    """The tags of all seeds that lead to a repository; the last resort only where no seed says more."""
    united = lambda tokens, rules: F.array_distinct(F.flatten(F.transform(tokens, lambda t: _by_tokens(t, rules))))
    split = F.transform(seeds, text.seed_tokens)
    return _once(split, lambda tokens: F.array_union(united(tokens, fixed.PROVENANCE_RULES), _or_fallback(united(tokens, fixed.FALLBACK_RULES))))
