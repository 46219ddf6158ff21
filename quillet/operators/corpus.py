"""From feed items and pages to articles, and from articles to the index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillet.functions import dates, fixed, text, urls
from quillet.operators import html
from quillet.sources import documents as src
from quillet.sources import storage


def unseen(links: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """Links whose article is not stored yet."""
    return links.join(stored.select(key), key, "left_anti")


def item_articles(items: DataFrame, pages: DataFrame | None, most: int) -> DataFrame:
    """Feed items as articles, the first `most` accepted ones of each source in document order.

    items: source_id, source_name, tags, pos, title, link, author, summary, content, categories, published, base.
    pages: url, main_text, summary, noindex, of pages fetched for short bodies.
    """
    rows = items.where((F.coalesce(F.trim("title"), F.lit("")) != "") & (F.coalesce(F.trim("link"), F.lit("")) != "")).withColumn("url", urls.resolve(F.col("base"), F.col("link")))
    body = text.clean_prose(text.strip_tags(F.coalesce("content", F.lit(""))))
    rows = rows.withColumn("body", body).withColumn("n", text.word_count(F.col("body")))
    if pages is not None:
        p = pages.select(F.col("url").alias("p_url"), "main_text", F.col("summary").alias("p_summary"), "noindex")
        rows = rows.join(p, (rows["url"] == p["p_url"]) & (rows["n"] < fixed.FULL_BODY_WORDS), "left").where(~F.coalesce("noindex", F.lit(False)))
        longer = text.word_count(F.coalesce("main_text", F.lit(""))) > F.col("n")
        rows = rows.withColumn("body", F.when(longer, F.col("main_text")).otherwise(F.col("body")))
    else:
        rows = rows.withColumn("p_summary", F.lit(None).cast("string"))
    enough = lambda c: F.when(text.word_count(c) >= fixed.SUMMARY_FLOOR_WORDS, c)
    summary = F.coalesce(enough(F.col("p_summary")), enough(F.col("body")), F.col("summary"))
    keep = F.row_number().over(W.partitionBy("source_id").orderBy("pos"))
    return rows.withColumn("k", keep).where(F.col("k") <= most).select(
        text.article_id(F.col("source_id"), F.col("url")).alias("id"),
        "url",
        text.truncate_words(F.col("title"), fixed.TITLE_WORDS).alias("title"),
        text.truncate_words(text.first_non_blank(F.col("author"), F.col("source_name")), fixed.AUTHOR_WORDS).alias("author"),
        "source_id",
        F.lit("feed").alias("origin"),
        text.truncate_words(summary, fixed.SUMMARY_WORDS).alias("summary"),
        text.truncate_words(F.col("body"), fixed.CONTENT_WORDS).alias("content"),
        text.article_topics(F.col("tags"), F.col("categories")).alias("topics"),
        dates.parse_time(F.col("published")).alias("published_at"),
    )


def page_articles(pages: DataFrame, last_year: int, min_words: int = fixed.PAGE_MIN_WORDS) -> DataFrame:
    """Whole pages (page_id, url, html; perhaps source_id and tags of their source) as articles; none from pages that are
    short, untitled or not to be indexed. Their topics are the source's tags; a page without a source belongs to its host."""
    own = [c for c in ("source_id", "tags") if c in pages.columns]
    got = html.extract(pages, "page_id", "html").join(pages.select("page_id", "url", *own), "page_id")
    rows = got.where(~F.col("noindex") & (F.col("n_words") >= min_words) & (F.trim("title") != ""))
    source = F.col("source_id") if "source_id" in own else urls.host_label(F.col("url"))
    topics = text.article_topics(F.col("tags"), F.array().cast("array<string>")) if "tags" in own else F.array().cast("array<string>")
    return rows.select(
        text.article_id(source, F.col("url")).alias("id"),
        "url",
        text.truncate_words(F.col("title"), fixed.TITLE_WORDS).alias("title"),
        source.alias("source_id"),
        F.lit("sitemap").alias("origin"),
        "summary",
        text.truncate_words(F.col("main_text"), fixed.CONTENT_WORDS).alias("content"),
        topics.alias("topics"),
        F.coalesce(dates.parse_time(F.col("published")), urls.date_in_path(urls.path(F.col("url")), last_year).cast("timestamp")).alias("published_at"),
    )


def index_rows(articles: DataFrame) -> DataFrame:
    """Articles as rows of the index: when they were fetched stays out, and the time is text or missing."""
    at = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return articles.drop("fetched_at").withColumn("published_at", at)


def feed_bodies(feeds: DataFrame, rules: DataFrame, most_bytes: int = 4_000_000) -> DataFrame:
    """Fetched feeds (source_id, url, body) that robots rules allow, cut to a bound; a forbidden one has no body."""
    rows = feeds.withColumns({"host": urls.host(F.col("url")), "path": urls.path(F.col("url"))})
    may = src.robots_allowed(rows, rules, ["source_id", "url"])
    kept = F.when(F.octet_length("body") <= most_bytes, F.col("body")).otherwise(F.decode(F.substring(F.col("body").cast("binary"), 1, most_bytes), "UTF-8"))
    return feeds.join(may, ["source_id", "url"]).select("source_id", "url", F.when(F.col("allowed"), kept).alias("body"), (~F.col("allowed")).alias("disallowed"))


def feed_crawl(feeds: DataFrame, rules: DataFrame, sources: DataFrame, pages: DataFrame | None, most: int) -> DataFrame:
    """Feeds as articles: robots rules, size bound, parsing, short bodies from their pages. sources: source_id, source_name, tags."""
    bodies = feed_bodies(feeds, rules).where("body IS NOT NULL")
    items = src.feed_items(bodies.withColumn("feed", F.struct("source_id", "url")), "feed", "body")
    named = items.select("feed.source_id", F.col("feed.url").alias("base"), *[c for c in items.columns if c != "feed"]).join(sources, "source_id")
    return item_articles(named, pages, most)


def sitemap_entries(
    maps: DataFrame, rules: DataFrame, fetch: Callable[[DataFrame], DataFrame] | None, levels: int = 1, most_maps: int = fixed.SITEMAP_MAPS, most_entries: int = fixed.SITEMAP_ENTRIES,
    most_links: int | None = 20_000,
) -> DataFrame:
    """source_id, loc, lastmod, pos of the pages that the sources' maps (source_id, url, xml) name, indexes followed.

    A map that names no page but other maps is an index. Its maps are a frontier: resolved, allowed by robots rules, newest
    first, they are fetched (fetch: url to url and xml, null where there is none) until a source has read `most_maps`
    that answered, or `most_entries` pages. A round asks for as many as a source may still read, and for eight times as
    many as the round before where maps fail, so that rounds are few; what was fetched beyond the budget is not used. An
    index among the fetched maps is followed to the next level, within the same budget of its source. Of one map `most_links`
    are read, or all.
    """
    spark = maps.sparkSession
    document = F.struct("source_id", F.coalesce("url", F.lit("")).alias("url"), F.col("order"))
    top = maps.select("source_id", "url", "xml", F.array(F.lit(0).cast("long")).alias("order"))
    links = storage.staged(src.sitemap_links(top.withColumn("doc", document), "doc", "xml", most_links), "maplinks")
    entries = [links.where("kind = 'url'").select("doc.source_id", "doc.order", "loc", "lastmod", "pos")]
    used = spark.createDataFrame([], maps.select("source_id").schema.add("maps", "long").add("pages", "long"))
    for _ in range(levels if fetch else 0):
        plain = links.where("kind = 'url'").select("doc").distinct()
        below = links.where("kind = 'sitemap'").join(plain, "doc", "left_anti")
        newest = src.link_time(F.col("lastmod"))
        at = below.select("doc.source_id", "doc.order", urls.resolve(F.col("doc.url"), F.col("loc")).alias("url"), newest.alias("at"), "pos").where(urls.is_http(F.col("url")))
        may = src.robots_allowed(at.withColumns({"host": urls.host(F.col("url")), "path": urls.path(F.col("url"))}), rules, ["source_id", "url"]).where("allowed")
        ranked = at.join(may.select("source_id", "url"), ["source_id", "url"], "left_semi").withColumn(
            "place", F.row_number().over(W.partitionBy("source_id").orderBy("order", F.col("at").desc_nulls_last(), "pos"))
        )
        frontier = storage.staged(ranked, "frontier")
        read, tried, ask = None, 0, most_maps
        while True:
            done = used if read is None else _budget(read, used, most_maps, most_entries)
            open_ = frontier.where(F.col("place") > tried).join(done, "source_id", "left")
            room = (F.coalesce("maps", F.lit(0)) < most_maps) & (F.coalesce("pages", F.lit(0)) < most_entries)
            wanted = open_.where(room & (F.col("place") <= tried + ask)).drop("maps", "pages")
            if not wanted.take(1):
                break
            bodies = fetch(wanted.select("url").distinct()).where("xml IS NOT NULL")
            got = wanted.join(bodies.select("url", "xml"), "url")
            found = src.sitemap_links(got.withColumn("doc", F.struct("source_id", "url", F.concat("order", F.array(F.col("place").cast("long"))).alias("order"))), "doc", "xml", most_links)
            counts = got.join(
                found.groupBy("doc.source_id", "doc.url").agg(F.count_if(F.col("kind") == "url").alias("n")), ["source_id", "url"]
            ).select("source_id", "url", "place", "n", "xml", "order")
            more = storage.staged(counts, "fetched")
            read = more if read is None else read.unionByName(more)
            tried, ask = tried + ask, ask * 8
        if read is None:
            break
        chosen = src.chosen_maps(read, used, most_maps, most_entries)
        used = storage.staged(_budget(read, used, most_maps, most_entries), "used")
        deeper = chosen.select(F.struct("source_id", "url", F.concat("order", F.array(F.col("place").cast("long"))).alias("order")).alias("doc"), "xml")
        links = storage.staged(src.sitemap_links(deeper, "doc", "xml", most_links), "maplinks")
        entries.append(links.where("kind = 'url'").select("doc.source_id", "doc.order", "loc", "lastmod", "pos"))
    rows = entries[0]
    for more in entries[1:]:
        rows = rows.unionByName(more)
    place = F.row_number().over(W.partitionBy("source_id").orderBy("order", "pos"))  # a source has no more rows than its budgets allow
    return rows.select("source_id", "loc", "lastmod", place.alias("pos"))


def _budget(read: DataFrame, used: DataFrame, most_maps: int, most_entries: int) -> DataFrame:
    """source_id, maps and pages that a source has used with the maps that were read."""
    spent = src.chosen_maps(read, used, most_maps, most_entries).groupBy("source_id").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("p"))
    both = spent.join(used, "source_id", "full_outer")
    return both.select("source_id", *[(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))).alias(b) for a, b in (("m", "maps"), ("p", "pages"))])


def sitemap_links_wanted(maps: DataFrame, rules: DataFrame, stored: DataFrame, most: int, fetch: Callable[[DataFrame], DataFrame] | None = None, **budgets: int | None) -> DataFrame:
    """source_id, site, tags, url, id of the newest links of sitemaps (source_id, site, tags, xml, perhaps url) that are
    articles, that robots rules allow and whose article is not stored yet. fetch reads the maps that an index names."""
    own = maps if "url" in maps.columns else maps.withColumn("url", F.concat("site", F.lit("sitemap.xml")))
    links = sitemap_entries(own.select("source_id", "url", "xml"), rules, fetch, **budgets)
    sites = own.select("source_id", "site", "tags").dropDuplicates(["source_id"])
    rows = links.join(sites, "source_id").select("source_id", "site", "tags", F.col("loc").alias("url"), "lastmod", "pos").where(urls.is_article_url(F.col("url"), F.col("site")))
    newest = src.newest_links(rows.groupBy("source_id", "site", "tags", "url").agg(F.min_by("lastmod", "pos").alias("lastmod"), F.min("pos").alias("pos")), "source_id", most)
    keyed = newest.withColumns({"id": text.article_id(F.col("source_id"), F.col("url")), "host": urls.host(F.col("url")), "path": urls.path(F.col("url"))})
    fresh = unseen(keyed, stored)
    may = src.robots_allowed(fresh, rules, ["source_id", "url"]).where("allowed")
    return fresh.join(may.select("source_id", "url"), ["source_id", "url"], "left_semi").select("source_id", "site", "tags", "url", "id")


def sitemap_crawl(maps: DataFrame, rules: DataFrame, stored: DataFrame, pages: DataFrame, last_year: int, most: int, min_words: int = fixed.PAGE_MIN_WORDS, fetch: Callable[[DataFrame], DataFrame] | None = None, **budgets: int | None) -> DataFrame:
    """Articles of the pages (url, html) behind the wanted links of sitemaps; a page that was not fetched gives none."""
    wanted = sitemap_links_wanted(maps, rules, stored, most, fetch, **budgets)
    fetched = wanted.join(pages.select("url", "html"), "url").withColumnRenamed("id", "page_id")
    return page_articles(fetched, last_year, min_words)


def upsert(stored: DataFrame, new: DataFrame, key: str = "id", always: tuple[str, ...] = ("url", "title", "source_id")) -> DataFrame:
    """Merge by key: a field that comes empty keeps its stored value, except those that are always sent."""
    s, n = stored.alias("s"), new.alias("n")
    fields = [c for c in stored.columns if c != key]

    def pick(c: str):
        fresh = F.col(f"n.{c}")
        kind = stored.schema[c].dataType.simpleString()
        value = F.nullif(fresh, F.lit("")) if kind == "string" else F.when(F.size(fresh) > 0, fresh) if kind.startswith("array") else fresh
        return F.when(F.col(f"n.{key}").isNotNull(), fresh).otherwise(F.col(f"s.{c}")) if c in always else F.coalesce(value, F.col(f"s.{c}"))

    return s.join(n, F.col(f"s.{key}") == F.col(f"n.{key}"), "full_outer").select(F.coalesce(f"n.{key}", f"s.{key}").alias(key), *[pick(c).alias(c) for c in fields])


def overwrite(stored: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The store's rule: the new row as a whole."""
    return stored.join(new.select(key), key, "left_anti").unionByName(new)


def crawl_route(outcomes: DataFrame) -> DataFrame:
    """What each source's pass comes to.

    outcomes: source_id, route (feed, sitemap, homepage), ord, ok, n, error, disallowed. The first route that worked
    wins; a feed that robots rules forbid is a success without articles; else the feed's error is told before others.
    """
    w = W.partitionBy("source_id").orderBy("done", "priority", "ord")
    p = F.when(F.col("route") == "feed", 0).when(F.col("route") == "sitemap", 1).otherwise(2)
    done = F.when(F.col("ok") | F.col("disallowed"), 0).otherwise(1)
    best = outcomes.withColumns({"priority": p, "done": done}).withColumn("r", F.row_number().over(w)).where("r = 1")
    return best.select("source_id", "route", F.when(F.col("disallowed"), 0).when(F.col("done") == 0, F.col("n")).otherwise(0).alias("n"), F.when(F.col("done") == 1, F.col("error")).alias("error"))


def ntiles(rows: DataFrame, key: str, order: str, tiles: int, block: int = 50_000) -> DataFrame:
    """key, order and the row's tile as ntile() numbers them per key, by a whole-number order column.

    Rows are numbered inside ranges of the order's values, of about `block` rows each by quantiles of the column, and the
    sizes of the ranges before are added, so that a key's rows need not meet in one task.
    """
    n = rows.count()
    # cuts: a number for each block of rows; approximate ones are as good, as sizes are counted afterwards
    cuts = rows.select(F.percentile_approx(order, [i / (-(-n // block)) for i in range(1, -(-n // block))], 10_000)).first()[0] if n > block else []
    at = F.aggregate(F.array(*map(F.lit, cuts)), F.lit(0), lambda a, cut: a + (F.col(order) > cut).cast("int")) if cuts else F.lit(0)
    ranged = rows.select(key, order, at.alias("__at"))
    sizes = ranged.groupBy(key, "__at").agg(F.count("*").alias("n"))
    of_key = W.partitionBy("k").orderBy("at")
    before = F.sum("n").over(of_key) - F.col("n")
    sizes = sizes.select(F.col(key).alias("k"), F.col("__at").alias("at"), "n").select("k", "at", before.alias("before"), F.sum("n").over(W.partitionBy("k")).alias("size"))
    numbered = ranged.withColumn("r", F.row_number().over(W.partitionBy(key, "__at").orderBy(order)))
    joined = numbered.join(sizes, F.col(key).eqNullSafe(F.col("k")) & F.col("__at").eqNullSafe(F.col("at")))
    least, more, r = F.floor(F.col("size") / tiles), F.col("size") % tiles, F.col("before") + F.col("r") - 1
    big = more * (least + 1)
    tile = F.when(r < big, F.floor(r / (least + 1))).otherwise(more + F.floor((r - big) / F.greatest(least, F.lit(1))))
    return joined.select(key, order, (tile + 1).cast("long").alias("tile"))
