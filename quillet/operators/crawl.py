"""Where a site's articles come from: sitemap and feed candidates, candidate checks, politeness. Fetched bodies are tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillet.functions import text, urls
from quillet.functions.addresses import is_public
from quillet.sources import documents as src

#: Guessed sitemap places, in order.
SITEMAP_PATHS = ("sitemap.xml", "sitemap_index.xml", "wp-sitemap.xml", "sitemap-index.xml")
MAX_SITEMAP_CANDIDATES, MAX_SITE_FEEDS = 5, 3


def sitemap_candidates(advertised: Column, site: Column, paths=SITEMAP_PATHS) -> Column:
    """Advertised sitemaps, then guesses that were not advertised."""
    root = F.concat(urls.scheme(site), F.lit("://"), urls.netloc(site), F.lit("/"))
    return F.array_distinct(F.concat(F.coalesce(advertised, F.array().cast("array<string>")), F.transform(F.array(*map(F.lit, paths)), lambda p: F.concat(root, p))))


def first_that_works(probes: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """Of probes (key, ord, url, ok, error) the first success in order, and whether an error came before it."""
    rows = probes.where(F.col("ord") < most) if most else probes
    best = rows.groupBy(key).agg(F.min(F.when(F.col("ok"), F.struct("ord", "url"))).alias("best"), F.min(F.when(F.col("error").isNotNull(), F.col("ord"))).alias("first_error"))
    before = F.col("first_error").isNotNull() & (F.col("best").isNull() | (F.col("first_error") < F.col("best.ord")))
    return best.select(key, F.col("best.url").alias("url"), before.alias("inconclusive"))


def site_feeds(pages: DataFrame) -> DataFrame:
    """The first declared feeds of home pages (site, url, feeds), resolved against the page."""
    rows = pages.select("site", "url", F.posexplode("feeds").alias("ord", "href"))
    full = rows.select("site", "ord", urls.resolve(F.col("url"), F.col("href")).alias("feed")).where(urls.is_http(F.col("feed")))
    # a page's few links are gathered per site
    return full.groupBy("site").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("ord", "feed"))), 1, MAX_SITE_FEEDS), lambda x: x["feed"]).alias("feeds"))


def check_candidates(candidates: DataFrame, probes: DataFrame, known_feeds: DataFrame, feeds: DataFrame) -> DataFrame:
    """What is known of each candidate after its page was probed.

    candidates: site, name, tags, fallback_tags. probes: site, status_code, content_type, final_url, page_title, site_name,
    error. known_feeds: key, feed of the last build. feeds: site, feed_url, feed_title, feed_tags, inconclusive. The feed is
    the one that worked, or the last build's where the search was inconclusive: that of the site as listed, else of the
    site it leads to.
    """
    joined = candidates.join(probes, "site", "left").join(feeds, "site", "left")
    final = F.coalesce(urls.canonical_site(F.col("final_url")), F.col("site"))
    rows = joined.withColumn("final", final).withColumns({"__listed": urls.site_key(F.col("site")), "__moved": urls.site_key(F.col("final"))})
    listed, moved = (known_feeds.select(F.col("key").alias(k), F.col("feed").alias(f"known{k}")) for k in ("__listed", "__moved"))
    page = F.coalesce(F.col("content_type"), F.lit("text/html")).rlike("html|xml|text/plain")
    problem = F.when(F.col("status_code").isNull(), F.coalesce("error", F.lit("no answer"))).when(F.col("status_code") >= 400, F.concat(F.lit("http "), F.col("status_code").cast("string"))).when(~page, F.lit("not a page"))
    return rows.join(listed, "__listed", "left").join(moved, "__moved", "left").select(
        F.col("final").alias("site"),
        F.coalesce(*[text.clean_name(F.col(c)) for c in ("feed_title", "site_name", "page_title", "name")], urls.domain_name(F.col("final"))).alias("name"),
        F.coalesce("feed_url", F.when(F.coalesce("inconclusive", F.lit(True)), F.coalesce("known__listed", "known__moved"))).alias("feed"),
        F.when(F.size(F.coalesce("feed_tags", F.array().cast("array<string>"))) > 0, F.col("feed_tags")).otherwise(F.col("fallback_tags")).alias("tags"),
        problem.alias("error"),
        *[c for c in ("ord", "origins") if c in candidates.columns],
    )


def second_try(first: DataFrame, again: DataFrame) -> DataFrame:
    """Probes in which a site that never answered has the answer of a slower second try, if that has one."""
    silent = F.col("status_code").isNull()
    better = again.where(~silent).join(first.where(silent).select("site"), "site", "left_semi")
    return first.join(better.select("site"), "site", "left_anti").unionByName(better.select(first.columns))


def page_metadata(body: Column) -> Column:
    """site_name, description (400 characters at most) and title (the name in it) of a page's head."""
    head = F.substring_index(F.coalesce(body, F.lit("")), "</head", 1)
    metas = F.transform(F.regexp_extract_all(head, F.lit(r"(?is)(<meta\s[^>]*>)"), F.lit(1)), tag_attributes)
    key = lambda m: F.lower(F.coalesce(m["property"], m["name"]))
    of = lambda k: F.get(F.filter(metas, lambda m: (key(m) == k) & (F.trim(F.coalesce(m["content"], F.lit(""))) != "")), F.lit(0))["content"]
    title = text.normalise_space(text.decode_basic_entities(F.regexp_extract(head, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    return F.struct(
        text.clean_name(F.coalesce(of("og:site_name"), of("application-name"))).alias("site_name"),
        text.trimmed_text(F.coalesce(of("description"), of("og:description")), 400).alias("description"),
        head_name(title).alias("title"),
    )


def feed_facts(probes: DataFrame, id_col: str = "url", entries: int = 15, summary_chars: int = 500) -> DataFrame:
    """What a feed's probe shows: id, ok, title, text of its first entries, categories, number of entries, error.

    probes: id, status, body, error. A feed has an answer under 400, a feed's root element near its start, and a title or
    entries. Transport errors stay errors.
    """
    rows = probes.withColumn("root", F.left(F.coalesce("body", F.lit("")), F.lit(2000)).rlike(r"(?i)<(rss|feed|rdf:rdf)[\s>]") & (F.coalesce("status", F.lit(0)) < 400))
    items = src.feed_items(rows.where("root"), id_col, "body")
    some = items.withColumn("n", F.row_number().over(W.partitionBy(id_col).orderBy("pos")))
    said = F.concat_ws(" ", "title", F.left(F.coalesce("summary", F.lit("")), F.lit(summary_chars)))
    # a feed has few entries, and only the first of them bring text
    read = some.groupBy(id_col).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= entries, F.struct("n", said.alias("x"))))), lambda e: e["x"]), " ").alias("text"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("n") <= entries, F.col("categories")))))).alias("categories"), F.count(F.lit(1)).alias("entries"),
    )
    named = rows.join(read.hint("merge"), id_col, "left").withColumn("title", F.when(F.col("root"), src.feed_title(F.col("body"))))
    ok = F.col("root") & (F.col("entries").isNotNull() | F.col("title").isNotNull())
    error = F.when(~ok, F.coalesce("error", F.when(F.coalesce("status", F.lit(0)) >= 400, F.concat(F.lit("http "), F.col("status").cast("string"))).otherwise("not a feed")))
    return named.select(id_col, ok.alias("ok"), "title", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("categories", F.array().cast("array<string>")).alias("categories"), F.coalesce("entries", F.lit(0)).cast("long").alias("entries"), error.alias("error"))


def by_domain(fetches: DataFrame, url_col: str = "url", slots: int = 2) -> DataFrame:
    """Fetches of one registrable domain in at most `slots` partitions, in order: workers that go through them are polite."""
    rows = urls.with_registered_name(fetches, urls.host(F.col(url_col)), "domain")
    return rows.repartition("domain", F.pmod(F.xxhash64(url_col), F.lit(slots))).sortWithinPartitions("domain", url_col)


def is_public_ip(c: Column) -> Column:
    """IPv4 and IPv6; what is no address is not public."""

    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return s.map(is_public).astype(bool)

    return run(c)


def tag_attributes(tag: Column) -> Column:
    """Attributes of one tag as a map, names in lower case; of repeated names the last counts."""
    pattern = r"([a-zA-Z_:][-a-zA-Z0-9_:.]*)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
    names = F.transform(F.regexp_extract_all(tag, F.lit(pattern), F.lit(1)), lambda n: F.lower(n))
    values = F.transform(F.regexp_extract_all(tag, F.lit(pattern), F.lit(2)), lambda v: text.decode_basic_entities(F.regexp_replace(v, "^[\"']|[\"']$", "")))
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(names, i + 2, F.greatest(F.size(names) - i, F.lit(1))), p["k"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))


def head_name(title: Column) -> Column:
    """The shortest part of a title between separators that is a name."""
    parts = F.filter(F.transform(F.split(title, r"\s+[|–—·•»]\s+|\s+-\s+"), text.clean_name), lambda p: p.isNotNull())
    return F.array_min(F.transform(parts, lambda p: F.struct(F.char_length(p).alias("n"), p.alias("p"))))["p"]
