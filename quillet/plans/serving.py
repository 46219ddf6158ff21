"""Queries of crawling decisions and of request and answer shapes, held against written-out results."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillet.functions import fixed
from quillet.operators import corpus, crawl, filters, service
from quillet.plans.literals import each, each_result, each_values

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


SITES = [(1, ["https://a.org/map.xml", "https://a.org/sitemap.xml"], "https://a.org/blog/"), (2, None, "http://b.org/")]


@query(each_result("SELECT * FROM (VALUES (1, 'https://a.org/map.xml https://a.org/sitemap.xml https://a.org/sitemap_index.xml https://a.org/wp-sitemap.xml https://a.org/sitemap-index.xml'), (2, 'http://b.org/sitemap.xml http://b.org/sitemap_index.xml http://b.org/wp-sitemap.xml http://b.org/sitemap-index.xml')) AS t(id, maps)"))
def sitemap_candidates(spark, d):
    return each(spark, d, "id int, advertised array<string>, site string", SITES).select("id", F.array_join(crawl.sitemap_candidates(F.col("advertised"), F.col("site")), " ").alias("maps"))


PROBES = [("a.org", 0, "u0", False, "reset"), ("a.org", 1, "u1", True, None), ("a.org", 2, "u2", True, None), ("b.org", 0, "u0", True, None), ("b.org", 1, "u1", False, "timeout"), ("c.org", 0, "u0", False, None), ("d.org", 6, "u6", True, None)]


@query(each_result("SELECT * FROM (VALUES ('a.org', 'u1', TRUE), ('b.org', 'u0', FALSE), ('c.org', NULL, FALSE)) AS t(site, url, inconclusive)"))
def first_working_feed(spark, d):
    return crawl.first_that_works(each(spark, d, "site string, ord int, url string, ok boolean, error string", PROBES), "site", crawl.MAX_SITEMAP_CANDIDATES)


HOMES = [("s1{n}", "https://s1.org/x/", ["feed", "/rss", "mailto:a", "https://o.org/f", "late"])]


@query(each_result("SELECT * FROM (VALUES ('s1{n}', 'https://s1.org/x/feed https://s1.org/rss https://o.org/f')) AS t(site, feeds)"))
def homepage_feeds(spark, d):
    return crawl.site_feeds(each(spark, d, "site string, url string, feeds array<string>", HOMES)).select("site", F.array_join("feeds", " ").alias("feeds"))


CANDIDATES = [("https://a.org/", "List name", ["x"], ["tech"]), ("https://b.org/", None, [], ["tech"]), ("https://c.org/", None, [], ["tech"]), ("https://d.org/", "Dee", [], ["tech"])]
PAGES = [
    ("https://a.org/", 200, "text/html", "https://www.a.org/post/1", "Home | A Blog", None, None), ("https://b.org/", 404, "text/html", None, None, None, None), ("https://c.org/", None, None, None, None, None, "timed out"),
    ("https://d.org/", 200, "image/png", "https://d.org/", None, "Dee Site", None),
]
KNOWN = [("a.org", "https://a.org/old"), ("b.org", "https://b.org/old"), ("d.org", "https://d.org/old")]
FOUND = [("https://a.org/", "https://a.org/feed", "The A Feed", ["rust"], False), ("https://b.org/", None, None, [], True), ("https://d.org/", None, None, [], False)]


@query(each_result("SELECT * FROM (VALUES ('https://www.a.org/', 'The A Feed', 'https://a.org/feed', 'rust', NULL), ('https://b.org/', 'B {n}', 'https://b.org/old', 'tech', 'http 404'), ('https://c.org/', 'C {n}', NULL, 'tech', 'timed out'), ('https://d.org/', 'Dee Site', NULL, 'tech', 'not a page')) AS t(site, name, feed, tags, error)"))
def candidate_check(spark, d):
    got = crawl.check_candidates(
        each(spark, d, "site string, name string, tags array<string>, fallback_tags array<string>", CANDIDATES),
        each(spark, d, "site string, status_code int, content_type string, final_url string, page_title string, site_name string, error string", PAGES),
        each(spark, d, "key string, feed string", KNOWN), each(spark, d, "site string, feed_url string, feed_title string, feed_tags array<string>, inconclusive boolean", FOUND),
    )
    return got.withColumn("tags", F.array_join("tags", ","))


IPS = [("::1", False), ("fe80::1", False), ("fd00::1", False), ("2606:4700::1111", True), ("::ffff:10.0.0.1", False), ("100.64.1.1", False), ("9.9.9.9", True), ("nonsense", False), ("ff02::1", False)]


@query(f"WITH {each_values('t', 'ip, is_public', IPS)} SELECT * FROM t")
def public_ip_any(spark, d):
    return each(spark, d, "ip string, want boolean", IPS).select("ip", crawl.is_public_ip(F.col("ip")).alias("is_public"))


TAGS = [(1, '<meta Name="description" content=\'a &amp; b\' data-x=3 name=last>'), (2, "<br>")]


@query(each_result("SELECT * FROM (VALUES (1, 'content=a & b;data-x=3;name=last'), (2, '')) AS t(id, attrs)"))
def tag_attributes(spark, d):
    m = F.transform(F.array_sort(F.map_entries(crawl.tag_attributes(F.col("tag")))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return each(spark, d, "id int, tag string", TAGS).select("id", F.array_join(m, ";").alias("attrs"))


TITLES = [("Home | Ann's Notes",), ("A Very Long Post Title - Short Blog",), ("Welcome",), ("One",)]


@query(each_result("SELECT * FROM (VALUES ('Home | Ann''s Notes', 'Ann''s Notes'), ('A Very Long Post Title - Short Blog', 'Short Blog'), ('Welcome', NULL), ('One', 'One')) AS t(title, name)"))
def head_name(spark, d):
    return each(spark, d, "title string", TITLES).select("title", crawl.head_name(F.col("title")).alias("name"))


CALLERS = [("1.1.1.1, 2.2.2.2:443", "9.9.9.9:1", "2.2.2.2"), ("", "9.9.9.9:1", "9.9.9.9"), (None, "[::1]:80", "::1"), ("3.3.3.3", "x", "3.3.3.3")]


@query(f"WITH {each_values('t', 'xff, remote, caller', CALLERS)} SELECT * FROM t")
def caller_key(spark, d):
    return each(spark, d, "xff string, remote string, want string", CALLERS).select("xff", "remote", service.caller_key(F.col("xff"), F.col("remote")).alias("caller"))


SETTINGS = [("25", 25), ("", 7), ("-1", 7), ("abc", 7), (" 3 ", 3), ("0", 7)]


@query(f"WITH {each_values('t', 'raw, n', SETTINGS)} SELECT * FROM t")
def positive_setting(spark, d):
    return each(spark, d, "raw string, want int", SETTINGS).select("raw", service.setting(F.col("raw"), 7).alias("n"))


BODIES = [
    (1, '{"url":"https://a.org/1","title":"  T ","topics":["x"," x","","y"],"origin":"feed","score":1.5}'), (2, '{"url":"javascript:alert(1)","title":"t"}'), (3, "not json"), (4, '{"url":"http://b.org","origin":"else"}'),
]


@query(each_result("SELECT * FROM (VALUES (1, 'https://a.org/1', 'T', 'x,y', 'feed', 1.5::DOUBLE), (4, 'http://b.org', 'http://b.org', '', NULL, 0.0::DOUBLE)) AS t(id, url, title, topics, origin, score)"))
def result_sanitiser(spark, d):
    rows = each(spark, d, "id int, body string", BODIES).select("id", service.sanitised(F.col("body")).alias("r")).where("r IS NOT NULL")
    return rows.select("id", "r.url", "r.title", F.array_join("r.topics", ",").alias("topics"), "r.origin", "r.score")


ANSWERS = [(1, 0, 20, 5, 3, 20), (2, 40, 20, 100, 50, 20), (3, 0, 0, -1, -5, 20)]


@query(f"WITH {each_values('t', 'id, off, rows_n, total, nxt, size', ANSWERS)} SELECT id, greatest(total, off + rows_n) AS total, greatest(nxt, off + size) AS next_offset FROM t")
def response_sanitiser(spark, d):
    t = each(spark, d, "id int, off int, rows_n int, total int, nxt int, size int", ANSWERS)
    total, nxt = service.response_bounds(*map(F.col, ("off", "rows_n", "total", "nxt", "size")))
    return t.select("id", total.alias("total"), nxt.alias("next_offset"))


@query("SELECT url, n FROM (SELECT 'https://a.org/' || source AS url, min(doc_id) AS n FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1 ORDER BY n LIMIT 10)")
def response_rows(spark, d):
    """Of one answer that holds a result for each document, some without a web address: the first of each URL, ten at most."""
    scheme = F.when(F.pmod("doc_id", F.lit(3)) == 0, "ftp://a.org/").otherwise("https://a.org/")
    rows = spark.read.parquet(f"{d}/documents.parquet").select(F.lit(1).alias("answer"), F.col("doc_id").alias("n"), F.to_json(F.struct(F.concat(scheme, "source").alias("url"))).alias("body"))
    return service.sanitised_response(rows, "answer", "n", "body", most=10).select("r.url", "n")


@query("SELECT doc_id, json_object('id', doc_id, 'source', source, 'lang', lang) AS body FROM documents")
def json_response(spark, d):
    return service.answer(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", F.struct(F.col("doc_id").alias("id"), "source", "lang"))


@query("SELECT event_id, props IS NOT NULL AND json_valid(props) AS readable FROM events")
def json_decode(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.from_json("props", "map<string,string>").isNotNull().alias("readable"))


SETTINGS_OF_FILTERS = [
    (1, {}, False, False), (2, {"days": 30}, True, True), (3, {"first": "2024-01-01"}, True, True), (4, {"last": "2024-01-01"}, True, True), (5, {"tags": ("go",)}, True, False), (6, {"bookmarked": True}, True, False),
    (7, {"visited": True}, True, False), (8, {"days": 0, "tags": ()}, False, False), *[(10 + i, {"days": n}, n > 0, n > 0) for i, n in enumerate(fixed.PERIOD_DAYS)],
]


@query(f"WITH {each_values('t', 'id, active, dated', [(i, a, t) for i, _, a, t in SETTINGS_OF_FILTERS])} SELECT * FROM t")
def filter_active(spark, d):
    chosen = [(i, filters.Filters(**given)) for i, given, _, _ in SETTINGS_OF_FILTERS]
    return each(spark, d, "id int, active boolean, dated boolean", [(i, f.active(), f.dated()) for i, f in chosen])


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-09' AND event_type IN ('click', 'view') AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def filters_together(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").withColumns({"published_at": F.col("ts").cast("timestamp"), "topics": F.array("event_type")})
    chosen = filters.Filters(tags=("click", "view"), first="2024-01-03", last="2024-01-08", bookmarked=True)
    return filters.chosen(e, chosen, "2024-02-01", bookmarks=e.where("event_type = 'purchase'"), bookmark_key="user_id").select("event_id")


@query("SELECT doc_id, ntile(8) OVER (PARTITION BY source ORDER BY doc_id) AS chunk FROM documents")
def chunking(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet")
    return corpus.ntiles(rows, "source", "doc_id", 8).select("doc_id", F.col("tile").alias("chunk"))
