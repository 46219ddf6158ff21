"""Queries of the whole source build and the small tables around it."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillet.operators import build_run, builder
from quillet.plans.literals import each, each_result
from quillet.sources import documents as src

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


SEEDS = [("https://github.com/a{n}/b",), ("https://github.com/topics/blogs{n}",), ("https://github.com/x{n}/y",)]
REPOS = [("blogs{n}", "x{n}/y", 50), ("blogs{n}", "p{n}/q", 90), ("blogs{n}", "low{n}/r", 1)]


@query(each_result("SELECT * FROM (VALUES ('a{n}/b', 'https://github.com/a{n}/b'), ('p{n}/q', 'https://github.com/topics/blogs{n}'), ('x{n}/y', 'https://github.com/topics/blogs{n} https://github.com/x{n}/y')) AS t(repository, seeds)"))
def seed_expansion(spark, d):
    seeds = src.seeds(each(spark, d, "value string", SEEDS))
    return build_run.expand_seeds(seeds, each(spark, d, "topic string, repository string, stars int", REPOS), 2).withColumn("seeds", F.array_join("seeds", " "))


UNITED = [("a/b", ["https://github.com/a/personal-ml", "https://github.com/topics/company-blogs"]), ("c/d", ["https://x.org/z", "https://x.org/security"]), ("e/f", ["https://x.org/z"])]


@query(each_result("SELECT * FROM (VALUES ('a/b', 'personal-blogs company-blogs ai machine-learning'), ('c/d', 'security'), ('e/f', 'tech')) AS t(repository, tags)"))
def seed_tags(spark, d):
    t = each(spark, d, "repository string, seeds array<string>", UNITED)
    return t.select("repository", F.array_join(builder.repository_tags(F.col("seeds")), " ").alias("tags"))


LISTED = [(1, ["https://a.org/x?utm_source=q", "https://a.org/x", "https://github.com/a", "https://b.org/skip", "https://c.org/."], ["https://b.org/skip"])]


@query(each_result("SELECT * FROM (VALUES (1, 'https://a.org/x https://c.org/')) AS t(id, urls)"))
def url_ordered_dedupe(spark, d):
    t = each(spark, d, "id int, listed array<string>, skip array<string>", LISTED)
    return t.select("id", F.array_join(build_run.clean_distinct(F.col("listed"), F.col("skip")), " ").alias("urls"))


LINES = [
    ("list.md", "https://lists.org/engineering", 1, "- [Ann's Notes](https://ann.org/post/1)"), ("list.md", "https://lists.org/engineering", 2, "- [Old Bob](http://bob.org/)"),
    ("list.md", "https://lists.org/engineering", 3, "- [Dead](https://dead.org/)"), ("list.md", "https://lists.org/engineering", 4, "- https://medium.com/@joe{n}/p and https://medium.com/"),
]
PROBES = [
    ("https://ann.org/", 200, "text/html", "https://ann.org/", None, None, None), ("http://bob.org/", 200, "text/html", "https://www.bob.org/", "Bob", None, None), ("https://dead.org/", 404, None, None, None, None, None),
    ("https://medium.com/@joe{n}/", 200, "text/html", "https://medium.com/@joe{n}/", "Joe", None, None), ("https://medium.com/", 200, "text/html", "https://medium.com/", "Medium", None, None),
]
OVERRIDES = [("https://ann.org", "Ann", None, ["personal-blogs", "rust"])]


def _build(spark, d, overrides=OVERRIDES):
    return build_run.build(
        each(spark, d, "path string, origin string, line_no int, line string", LINES),
        each(spark, d, "site string, status_code int, content_type string, final_url string, page_title string, site_name string, error string", PROBES),
        each(spark, d, "key string, feed string", [("bob.org", "https://bob.org/feed")]),
        each(spark, d, "site string, feed_url string, feed_title string, feed_tags array<string>, inconclusive boolean", [("https://ann.org/", "https://ann.org/rss", "Ann writes", ["go"], False)]),
        each(spark, d, "site string, id string", [("https://www.bob.org/", "old-bob{n}"), ("https://other.org/", "ann-{n}")]),
        each(spark, d, "site string, name string, feed string, tags array<string>", overrides),
    )


@query(each_result("SELECT * FROM (VALUES ('ann-{n}-2', 'Ann', 'https://ann.org/', 'https://ann.org/rss', 'personal-blogs', 'rust'), ('old-bob{n}', 'Bob', 'https://www.bob.org/', 'https://bob.org/feed', '', 'software-engineering'), ('medium-joe{n}', 'Joe', 'https://medium.com/@joe{n}/', NULL, '', 'software-engineering')) AS t(id, name, site, feed, kind, tags)"))
def source_build(spark, d):
    return _build(spark, d).entries.select("id", "name", "site", "feed", F.array_join("kind", ",").alias("kind"), F.array_join("tags", ",").alias("tags"))


@query(each_result("SELECT * FROM (VALUES ('https://ann.org/', 'tag form'), ('not a site {n}', 'site form')) AS t(site, problem)"))
def source_build_problems(spark, d):
    return _build(spark, d, [("https://ann.org", "Ann", None, ["Bad Tag"]), ("not a site {n}", "New", None, ["go"])]).problems


@query(each_result("SELECT * FROM (VALUES ('ann-{n}-2'), ('ann-{n}-3'), ('old-bob{n}'), ('medium-joe{n}')) AS t(id)"))
def source_build_ids(spark, d):
    """An entry that only an override knows gets an id beside those in use."""
    return _build(spark, d, [("https://ann-{n}.net/", "Other Ann", None, ["go"])]).entries.select("id")


@query("SELECT DISTINCT * FROM (" + each_result("SELECT * FROM (VALUES ('https://ann.org/', 'yes'), ('http://bob.org/', 'yes'), ('https://dead.org/', 'no'), ('https://medium.com/@joe{n}/', 'yes'), ('https://medium.com/', 'yes')) AS t(site, reachable)") + ")")
def source_build_audit(spark, d):
    return _build(spark, d).audit.select("site", "reachable").distinct()  # the platform is a candidate of every page


@query("SELECT 3 * count(*) AS entries, 2 * count(*) AS with_feed FROM pages")
def feed_coverage(spark, d):
    return build_run.feed_coverage(_build(spark, d).entries)


def _purchases(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").where("event_type = 'purchase'")
    return e.select(F.col("user_id").alias("owner"), F.concat(F.lit("https://a.org/"), F.col("event_id").cast("string")).alias("url"), F.lit("T").alias("title"), F.col("ts").cast("timestamp").alias("saved_at"))


@query("SELECT user_id AS owner, 'bookmarks-2024-02-01.json' AS name, count(*) AS items FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def bookmarks_envelope(spark, d):
    got = build_run.bookmarks_json(_purchases(spark, d), "2024-02-01 10:00:00")
    return got.select("owner", "name", F.size(F.from_json("body", "bookmarks array<struct<url:string>>")["bookmarks"]).cast("long").alias("items"))


@query("SELECT owner, count(*) AS n FROM (SELECT user_id AS owner, event_id FROM events WHERE event_type = 'purchase' AND event_id % 2 = 0 UNION ALL SELECT owner, event_id FROM (SELECT user_id AS owner, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, 'https://a.org/' || event_id) AS k, (SELECT count(*) FROM events s WHERE s.event_type = 'purchase' AND s.event_id % 2 = 0 AND s.user_id = e.user_id) AS n FROM events e WHERE event_type = 'purchase' AND event_id % 2 = 1) WHERE k + n <= 6) GROUP BY owner")
def bookmark_cap(spark, d):
    every = _purchases(spark, d).select("owner", "url", "saved_at", F.regexp_extract("url", "([0-9]+)$", 1).cast("long").alias("n"))
    saved, new = every.where("n % 2 = 0").drop("n"), every.where("n % 2 = 1").drop("n")
    return build_run.add_bookmarks(saved, new, 6).groupBy("owner").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id FROM pages WHERE contains(lower('Post ' || regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), ':[0-9]*$', ''), '^www\\.', '')), 'post b')")
def saved_list_search(spark, d):
    rows = spark.read.parquet(f"{d}/pages.parquet").withColumn("title", F.lit("Post"))
    return build_run.saved_search(rows, " POST b ").select("page_id")
