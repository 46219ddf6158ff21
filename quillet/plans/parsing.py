"""Queries over HTML, feeds, sitemaps, robots files and outlines. Parsed literals are held against written-out results."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillet.functions import fixed, urls
from quillet.operators import corpus, html
from quillet.plans.literals import each, each_result, each_values
from quillet.sources import documents as src

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def pages(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet")


_DROP = r"(?is)<(script|style|nav|header|footer|aside)\b.*?</(script|style|nav|header|footer|aside)>"


@query(f"SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '{_DROP}', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS text_md5 FROM pages")
def html_text_regex(spark, d):
    return pages(spark, d).select("page_id", F.md5(html.regex_text(F.col("html")).cast("binary")).alias("text_md5"))


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def html_title_regex(spark, d):
    return pages(spark, d).select("page_id", html.regex_title(F.col("html")).alias("title"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<p[^>]*>(.*?)(?:</p>|<p[ >]|</article>)', 1), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS summary FROM pages")
def html_paragraph_summary_regex(spark, d):
    return pages(spark, d).select("page_id", html.regex_first_paragraph(F.col("html")).alias("summary"))


HEADS = [
    (1, '<head><META name="robots" content="noindex, nofollow"><link rel="Alternate feed" type="application/rss+xml" href="/f.xml"></head>'),
    (2, '<head><meta name="robots" content="all"><link rel="stylesheet" type="text/css" href="/a.css"><link rel="alternate" type="text/html" href="/fr"></head>'),
    (3, '<link type="application/atom+xml" rel="alternate" href="https://b.org/atom"><link rel=alternate type=text/xml href=/two>'),
]


@query(f"WITH {each_values('t', 'id, html', HEADS)} SELECT id, regexp_matches(html, '(?is)<meta\\s[^>]*name=[\"'']?robots[\"'']?[^>]*noindex') AS noindex FROM t")
def html_noindex_regex(spark, d):
    return each(spark, d, "id int, html string", HEADS).select("id", html.regex_noindex(F.col("html")).alias("noindex"))


@query(each_result("SELECT * FROM (VALUES (1, '/f.xml'), (2, ''), (3, 'https://b.org/atom /two')) AS t(id, feeds)"))
def html_feed_links_regex(spark, d):
    return each(spark, d, "id int, html string", HEADS).select("id", F.array_join(html.regex_feeds(F.col("html")), " ").alias("feeds"))


# The generated pages are regular: all prose is in paragraphs of one article, under one heading, and no page has dates, feeds or robots marks
# that the extractor could miss. So the tree's results can be said with patterns.
_WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_BARE = lambda x: f"regexp_replace({x}, '<!--.*?-->|<[^>]*>', ' ', 'g')"
_PLAIN = lambda x: f"replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&amp;', '&')"
_PROSE = lambda x: f"list_filter(string_split(trim(regexp_replace({_PLAIN(_BARE(x))}, '{_WS}+', ' ', 'g')), ' '), lambda w: w <> '' AND NOT regexp_matches(w, '^[#*`~_=-]+$'))"
_ARTICLE, _HEADING = r"regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1)", r"'(?is)<h1[^>]*>(.*?)</h1>'"
EXTRACTED = f"""x AS (SELECT page_id, url, html, {_PROSE(_ARTICLE)} AS words, {_PROSE(f"regexp_extract(html, {_HEADING}, 1)")} AS title,
    {_PROSE(f"regexp_replace({_ARTICLE}, {_HEADING}, ' ')")} AS body FROM pages)"""


@query(
    f"WITH {EXTRACTED} SELECT page_id, array_to_string(words, ' ') AS main_text, len(words)::BIGINT AS n_words, array_to_string(body[1:40], ' ') AS summary, array_to_string(title, ' ') AS title, "
    "nullif(regexp_extract(html, '(?is)<time[^>]*datetime=\"([^\"]*)\"', 1), '') AS published, regexp_matches(html, '(?is)<meta[^>]*noindex') AS noindex, array_to_string(regexp_extract_all(html, '(?is)<link[^>]*>'), ' ') AS feeds FROM x"
)
def html_extract_udf(spark, d):
    return html.extract(pages(spark, d), "page_id", "html").withColumn("feeds", F.array_join("feeds", " "))


_SITE = r"regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), ':[0-9]*$', ''), '^www\.', '')"
ARTICLE_FIELDS = (
    f"regexp_replace({_SITE}, '[^A-Za-z0-9_-]', '-', 'g') || '-' || sha256(url)[1:16] AS id, url, array_to_string(title[1:40], ' ') AS title, {_SITE} AS source_id, 'sitemap' AS origin, "
    "array_to_string(body[1:40], ' ') AS summary, array_to_string(words[1:1000], ' ') AS content, NULL::TIMESTAMP AS published_at"
)


@query(f"WITH {EXTRACTED} SELECT {ARTICLE_FIELDS}, '' AS topics FROM x WHERE len(words) >= 20 AND len(title) > 0")
def page_to_article(spark, d):
    got = corpus.page_articles(pages(spark, d), 2027, min_words=20)
    return got.withColumns({"topics": F.array_join("topics", ","), "published_at": F.col("published_at").cast("timestamp_ntz")})


_WORDS = f"len(list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(html, '{_DROP}', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: w <> ''))"


@query(f"SELECT page_id, {_WORDS} AS n_words FROM pages WHERE {_WORDS} >= {fixed.PAGE_MIN_WORDS}")
def page_min_words(spark, d):
    n = F.size(F.filter(F.split(html.regex_text(F.col("html")), " "), lambda w: w != "")).cast("long")
    return pages(spark, d).select("page_id", n.alias("n_words")).where(F.col("n_words") >= fixed.PAGE_MIN_WORDS)


ENTITIES = [("caf&eacute; &amp;amp; &#8211; &#x41;",), ("a &lt;b&gt; &nosuch; &",), (None,)]


@query(each_result("SELECT * FROM (VALUES ('caf&eacute; &amp;amp; &#8211; &#x41;', 'café &amp; – A'), ('a &lt;b&gt; &nosuch; &', 'a <b> &nosuch; &'), (NULL, NULL)) AS t(raw, decoded)"))
def entity_decode(spark, d):
    return each(spark, d, "raw string", ENTITIES).select("raw", html.decode_entities(F.col("raw")).alias("decoded"))


RSS = """<?xml version="1.0"?><rss xmlns:dc="d" xmlns:content="c"><channel><title>Blog</title>
<item><title>First &amp; best</title><link> https://a.org/1 </link><dc:creator>Ann</dc:creator><description>&lt;p&gt;Short  text&lt;/p&gt;</description><content:encoded><![CDATA[<p>Long body</p>]]></content:encoded><category>Rust</category><category>Web Dev</category><pubDate>Tue, 05 Mar 2024 10:20:30 -0700</pubDate></item>
<item><title>Second</title><link>https://a.org/2</link><author>bob@a.org</author><description>Only & this</description></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Atom one</title><link rel="self" href="https://b.org/self"/><link rel="alternate" href="https://b.org/1"/><author><name>Cy</name></author><summary>Sum</summary><category term="go" label="Go lang"/><category term="ai"/><published>2024-03-05T10:20:30Z</published></entry>
<entry><title>Atom two</title><link href="https://b.org/2"/><content>Body</content><updated>2024-01-01T00:00:00Z</updated></entry></feed>"""
FEEDS = [(1, RSS), (2, ATOM), (3, "<html><body>no feed</body></html>")]
_RSS_ROWS = [
    (1, "First & best", "https://a.org/1", "Ann", "Short text", "<p>Long body</p>", "Rust,Web Dev", "Tue, 05 Mar 2024 10:20:30 -0700"),
    (1, "Second", "https://a.org/2", "bob@a.org", "Only & this", "Only & this", "", None),
]
_ATOM_ROWS = [
    (2, "Atom one", "https://b.org/1", "Cy", "Sum", "Sum", "Go lang,ai", "2024-03-05T10:20:30Z"),
    (2, "Atom two", "https://b.org/2", None, None, "Body", "", "2024-01-01T00:00:00Z"),
]
_FEED_COLS = "id, title, link, author, summary, content, categories, published"


def _items(spark, d, rows):
    return src.feed_items(each(spark, d, "id int, xml string", rows), "id", "xml").select(
        "id", "title", "link", "author", "summary", "content", F.array_join("categories", ",").alias("categories"), "published"
    )


@query(f"WITH {each_values('t', _FEED_COLS, _RSS_ROWS)} SELECT * FROM t")
def feed_rss(spark, d):
    return _items(spark, d, FEEDS[:1])


@query(f"WITH {each_values('t', _FEED_COLS, _ATOM_ROWS)} SELECT * FROM t")
def feed_atom(spark, d):
    return _items(spark, d, FEEDS[1:2])


@query(f"WITH {each_values('t', _FEED_COLS, _RSS_ROWS + _ATOM_ROWS)} SELECT * FROM t")
def feed_union(spark, d):
    return _items(spark, d, FEEDS)


_ARTICLES = [
    (1, "https://a.org/1", "First & best", "Ann", "Short text", "Long body", "linux,rust,web-dev", "2024-03-05 17:20:30"), (1, "https://a.org/2", "Second", "bob@a.org", "Only & this", "Only & this", "linux", None),
    (2, "https://b.org/1", "Atom one", "Cy", "Sum", "Sum", "linux,go-lang,ai", "2024-03-05 10:20:30"), (2, "https://b.org/2", "Atom two", "A blog", None, "Body", "linux", "2024-01-01 00:00:00"),
]


@query(f"WITH {each_values('t', 'id, url, title, author, summary, content, topics, published_at', _ARTICLES)} SELECT 'src-' || id || '-' || left(sha256(url), 16) AS id, url, title, author, 'src-' || id AS source_id, 'feed' AS origin, summary, content, topics, published_at::TIMESTAMP AS published_at FROM t")
def feed_articles(spark, d):
    items = src.feed_items(each(spark, d, "id int, xml string", FEEDS), "id", "xml").withColumns(
        {"source_id": F.concat(F.lit("src-"), F.col("id").cast("string")), "source_name": F.lit("A blog"), "tags": F.array(F.lit("linux")), "base": F.lit("https://a.org/feed")}
    )
    got = corpus.item_articles(items, None, 10)
    return got.withColumns({"topics": F.array_join("topics", ","), "published_at": F.col("published_at").cast("timestamp_ntz")})


MAPS = [
    (1, "<urlset><url><loc> https://a.org/1 </loc><lastmod>2024-01-02</lastmod></url><url><loc>https://a.org/2</loc></url><url><loc>https://a.org/3</loc><lastmod>2024-05-01T00:00:00Z</lastmod></url><url><loc>https://a.org/4</loc><lastmod>2024-01-02</lastmod></url></urlset>"),
    (2, "<sitemapindex><sitemap><loc>https://a.org/s1.xml</loc><lastmod>2024-02-02</lastmod></sitemap></sitemapindex>"),
    (3, "<html><url><loc>https://no.org</loc></url></html>"),
    (4, ""),
]


def _links(spark, d):
    return src.sitemap_links(each(spark, d, "id int, xml string", MAPS), "id", "xml")


@query(each_result("SELECT * FROM (VALUES (1, 'url', 'https://a.org/1', '2024-01-02'), (1, 'url', 'https://a.org/2', NULL), (1, 'url', 'https://a.org/3', '2024-05-01T00:00:00Z'), (1, 'url', 'https://a.org/4', '2024-01-02'), (2, 'sitemap', 'https://a.org/s1.xml', '2024-02-02')) AS t(id, kind, loc, lastmod)"))
def sitemap_parse(spark, d):
    return _links(spark, d).drop("pos")


@query(each_result("SELECT * FROM (VALUES (1, 'https://a.org/3', 1), (1, 'https://a.org/1', 2), (1, 'https://a.org/4', 3)) AS t(id, loc, rank)"))
def sitemap_newest_links(spark, d):
    return src.newest_links(_links(spark, d).where("kind = 'url'"), "id", 3).select("id", "loc", "rank")


CHILDREN = [(1, 0, "2024-01-01", 9000), (1, 1, "2024-03-01", 12000), (1, 2, "2024-02-01", 9000), (1, 3, None, 10), (1, 4, "2024-04-01", None), (2, 0, None, 5), (2, 1, None, 6), (2, 2, "2020-01-01", 7), (2, 3, None, 8), (2, 4, None, 9)]


@query(
    f"WITH {each_values('t', 'site, pos, seen, n', CHILDREN)} SELECT site, pos FROM (SELECT *, row_number() OVER w AS r, coalesce(sum(n) OVER (PARTITION BY site ORDER BY seen DESC NULLS LAST, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b "
    "FROM t WHERE n IS NOT NULL WINDOW w AS (PARTITION BY site ORDER BY seen DESC NULLS LAST, pos)) WHERE r <= 4 AND b < 20000"
)
def sitemap_child_choice(spark, d):
    return src.chosen_children(each(spark, d, "site int, pos int, at string, n int", CHILDREN), "site").select("site", "pos")


@query("SELECT page_id AS id, url FROM pages WHERE page_id NOT IN (SELECT page_id FROM pages WHERE page_id % 3 = 0)")
def sitemap_unseen(spark, d):
    p = pages(spark, d).select(F.col("page_id").alias("id"), "url")
    return corpus.unseen(p, p.where("id % 3 = 0"))


ROBOTS = [
    ("a.org", "User-agent: *\nDisallow: /\nUser-agent: quillet\nUser-agent: other # both\nAllow: /blog/\nDisallow: /blog/private\nSitemap: https://a.org/map.xml\n"),
    ("b.org", "Disallow: /ignored\nuser-agent: *\ndisallow: /tmp*\nallow: /tmp/ok$\ndisallow:\n"),
    ("c.org", "User-agent: quillet\n\nUser-agent: *\nDisallow: /\n"),
    ("d.org", "User-agent: quillet\nDisallow: /x\nUser-agent: *\nDisallow: /\n"),
]


def _lines(spark, d):
    return src.robots_lines(each(spark, d, "host string, body string", ROBOTS), "host", "body")


_RULES = [("a.org", "/blog/", True), ("a.org", "/blog/private", False), ("b.org", "/tmp*", False), ("b.org", "/tmp/ok$", True), ("c.org", "/", False), ("d.org", "/x", False)]


@query(f"WITH {each_values('t', 'host, pattern, allow', _RULES)} SELECT * FROM t")
def robots_parse(spark, d):
    return src.robots_rules(_lines(spark, d), "host", "quillet")


@query(each_result("SELECT * FROM (VALUES ('a.org', 'https://a.org/map.xml')) AS t(host, sitemap)"))
def robots_sitemaps(spark, d):
    return _lines(spark, d).where("directive = 'sitemap'").select("host", F.col("value").alias("sitemap"))


MATCHES = [
    ("/a", "/abc", True), ("/a$", "/abc", False), ("/a$", "/a", True), ("/*.pdf", "/x/y.pdf?z", True), ("/*.pdf$", "/x/y.pdf?z", False), ("/p?q=1", "/p?q=1&r", True), ("/b*", "/b", True),
    ("/b*/c", "/b/x/c/d", True), ("/b*/c", "/b/x", False), ("*", "/anything", True), ("/x$y", "/x$yz", True), ("/(a)", "/(a)b", True),
]


@query(f"WITH {each_values('t', 'pattern, path, hit', MATCHES)} SELECT * FROM t")
def robots_match(spark, d):
    return each(spark, d, "pattern string, path string, want boolean", MATCHES).select("pattern", "path", src.robots_match(F.col("pattern"), F.col("path")).alias("hit"))


ASKED = [("a.org", "/blog/x", True), ("a.org", "/blog/private/1", False), ("a.org", "/other", True), ("b.org", "/tmp/x", False), ("b.org", "/tmp/ok", True), ("b.org", "/tmp/ok2", False), ("c.org", "/x", False), ("e.org", "/y", True)]


@query(f"WITH {each_values('t', 'host, path, allowed', ASKED)} SELECT * FROM t")
def robots_allowed(spark, d):
    rules = src.robots_rules(_lines(spark, d), "host", "quillet")
    return src.robots_allowed(each(spark, d, "host string, path string, want boolean", ASKED).drop("want"), rules, ["host", "path"])


# A thousand rules for each host of the pages, prefixes, ends and gaps, in both directions.
_MANY = "SELECT CASE k % 4 WHEN 0 THEN '/en/' || k WHEN 1 THEN '/*/' || k || '$' WHEN 2 THEN '/*' || (k // 10) || '*.html' ELSE '/de/' || (k % 10) END AS pattern, k % 3 = 0 AS allow FROM range(1000) r(k)"
_SPLIT = "SELECT page_id, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages WHERE url IS NOT NULL"


@query(
    f"WITH r AS (SELECT DISTINCT * FROM ({_MANY})), p AS ({_SPLIT}), h AS (SELECT page_id, max({{'n': length(pattern), 'a': allow}}) AS best FROM p JOIN r ON regexp_matches(path, '^' || replace(replace(pattern, '.', '[.]'), '*', '.*')) GROUP BY page_id) "
    "SELECT p.page_id, coalesce(best.a, TRUE) AS allowed FROM p LEFT JOIN h USING (page_id)"
)
def robots_many_rules(spark, d):
    p = pages(spark, d).where("url IS NOT NULL").select("page_id", urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path"))
    k = F.col("id")
    pattern = (
        F.when(k % 4 == 0, F.concat(F.lit("/en/"), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit("/*/"), k.cast("string"), F.lit("$")))
        .when(k % 4 == 2, F.concat(F.lit("/*"), F.floor(k / 10).cast("string"), F.lit("*.html"))).otherwise(F.concat(F.lit("/de/"), (k % 10).cast("string")))
    )
    rules = p.select("host").distinct().select("host", F.explode(F.sequence(F.lit(0), F.lit(999))).alias("id")).select("host", pattern.alias("pattern"), (k % 3 == 0).alias("allow"))
    return src.robots_allowed(p, rules, ["page_id"])


OPML = [(1, '<opml><body><outline text="Group"><outline text="Ann" title="Ann\'s" xmlUrl="https://a.org/feed" htmlUrl="https://a.org/"/><outline name="Bob" feed="https://b.org/rss" url="https://b.org/"/></outline></body></opml>')]


@query(each_result("SELECT * FROM (VALUES (1, NULL, NULL, 'Group'), (1, 'https://a.org/feed', 'https://a.org/', 'Ann''s'), (1, 'https://b.org/rss', 'https://b.org/', 'Bob')) AS t(id, feed, site, name)"))
def opml_outlines(spark, d):
    rows = [(i, x.replace("title=\"Ann's\"", "title='Ann`s'").replace("`", "&#39;")) for i, x in OPML]
    got = src.outlines(each(spark, d, "id int, xml string", rows), "id", "xml")
    return got.select("id", "feed", "site", F.replace("name", F.lit("&#39;"), F.lit("'")).alias("name"))


OUTCOMES = [
    ("s1.org", "feed", 0, False, 0, "parse", False), ("s1.org", "sitemap", 1, False, 0, "none", False), ("s1.org", "homepage", 2, True, 5, None, False), ("s2.org", "feed", 0, True, 9, None, False),
    ("s3.org", "feed", 0, False, 0, "broken feed", False), ("s3.org", "sitemap", 1, False, 0, "broken map", False), ("s4.org", "feed", 0, False, 0, None, True), ("s4.org", "sitemap", 1, True, 8, None, False), ("s5.org", "sitemap", 1, False, 0, "no map", False),
]


@query(each_result("SELECT * FROM (VALUES ('s1.org', 'homepage', 5, NULL), ('s2.org', 'feed', 9, NULL), ('s3.org', 'feed', 0, 'broken feed'), ('s4.org', 'feed', 0, NULL), ('s5.org', 'sitemap', 0, 'no map')) AS t(source_id, route, n, error)"))
def crawl_route_priority(spark, d):
    return corpus.crawl_route(each(spark, d, "source_id string, route string, ord int, ok boolean, n int, error string, disallowed boolean", OUTCOMES))


_OLD = "SELECT doc_id AS id, md5(text) AS url, source AS title, lang AS author, source AS source_id FROM documents WHERE doc_id % 3 <> 0"
_NEW = "SELECT doc_id AS id, md5(text) AS url, 'new' AS title, CASE WHEN doc_id % 5 = 0 THEN 'writer' ELSE '' END AS author, source AS source_id FROM documents WHERE doc_id % 3 <> 1"


def _halves(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    base = docs.select(F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("url"), F.col("source").alias("title"), F.col("lang").alias("author"), F.col("source").alias("source_id"))
    new = base.where("id % 3 <> 1").withColumns({"title": F.lit("new"), "author": F.when(F.col("id") % 5 == 0, "writer").otherwise("")})
    return base.where("id % 3 <> 0"), new


@query(f"WITH s AS ({_OLD}), n AS ({_NEW}) SELECT coalesce(n.id, s.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.url ELSE s.url END AS url, CASE WHEN n.id IS NOT NULL THEN n.title ELSE s.title END AS title, coalesce(nullif(n.author, ''), s.author) AS author, CASE WHEN n.id IS NOT NULL THEN n.source_id ELSE s.source_id END AS source_id FROM s FULL JOIN n ON s.id = n.id")
def index_merge_upsert(spark, d):
    return corpus.upsert(*_halves(spark, d))


@query(f"WITH s AS ({_OLD}), n AS ({_NEW}) SELECT * FROM n UNION ALL SELECT * FROM s WHERE id NOT IN (SELECT id FROM n)")
def store_overwrite(spark, d):
    return corpus.overwrite(*_halves(spark, d))
