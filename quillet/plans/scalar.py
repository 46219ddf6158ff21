"""Queries over the text, URL and date functions, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillet.functions import dates, fixed, text, urls
from quillet.plans.literals import each, each_values, in_list

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


WS = text.WS
DECODE = lambda x: f"replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"
SPACED = lambda x: f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"
WORDS = lambda x: f"list_filter(string_split({SPACED(x)}, ' '), lambda w: w <> '')"
KEBAB = lambda x: f"regexp_replace(regexp_replace(lower(trim({x})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
SLUG = lambda x: f"CASE WHEN length({KEBAB(DECODE(x))}) < 2 OR length({KEBAB(DECODE(x))}) > 40 OR {KEBAB(DECODE(x))} IN {in_list(fixed.UNINFORMATIVE_CATEGORIES)} THEN '' ELSE {KEBAB(DECODE(x))} END"


def docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def pages(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet")


@query(f"SELECT doc_id, len({WORDS('text')}) AS n_words FROM documents WHERE text IS NOT NULL")
def text_words(spark, d):
    return docs(spark, d).where("text IS NOT NULL").select("doc_id", text.word_count(F.col("text")).alias("n_words"))


@query(f"SELECT doc_id, array_to_string({WORDS('text')}[1:8], ' ') AS title, array_to_string({WORDS('text')}[1:40], ' ') AS summary FROM documents WHERE text IS NOT NULL")
def text_truncate(spark, d):
    t = F.col("text")
    return docs(spark, d).where("text IS NOT NULL").select("doc_id", text.truncate_words(t, 8).alias("title"), text.truncate_words(t, 40).alias("summary"))


@query(f"SELECT doc_id, array_to_string(list_filter({WORDS('text')}, lambda w: NOT regexp_matches(w, '{text.MARKERS}')), ' ') AS prose FROM documents WHERE text IS NOT NULL")
def text_clean_prose(spark, d):
    return docs(spark, d).where("text IS NOT NULL").select("doc_id", text.clean_prose(F.col("text")).alias("prose"))


@query("SELECT page_id, md5(regexp_replace(html, '<[^>]*>', '', 'g')) AS bare_md5 FROM pages")
def text_strip_tags(spark, d):
    return pages(spark, d).select("page_id", F.md5(text.strip_tags(F.col("html")).cast("binary")).alias("bare_md5"))


@query("SELECT doc_id, left(regexp_replace(text, '[[:cntrl:]\\x{80}-\\x{9F}]', ' ', 'g'), 128) || CASE WHEN length(text) > 128 THEN '…' ELSE '' END AS logged FROM documents")
def log_query(spark, d):
    return docs(spark, d).select("doc_id", text.log_query(F.col("text")).alias("logged"))


@query("SELECT doc_id, left(trim(text, ' '), 512) AS clamped, nullif(left(trim(text, ' '), 120), '') AS author_text FROM documents")
def clamp_query(spark, d):
    return docs(spark, d).select("doc_id", text.clamp_query(F.col("text")).alias("clamped"), text.trimmed_text(F.col("text"), 120).alias("author_text"))


SLUGS = [
    ("Web Performance",), ("already-kebab",), ("Uncategorized",), ("!!!",), ("x",), ("R&amp;D and more",), ("a very long category name that goes well past forty",),
    ("  Trim  me ",), ("C++",), ("Général",), ("posts",), ("42",),
]


@query(f"WITH {each_values('t', 'raw', SLUGS)} SELECT raw, {SLUG('raw')} AS slug FROM t")
def topic_slug(spark, d):
    return each(spark, d, "raw string", SLUGS).select("raw", text.topic_slug(F.col("raw")).alias("slug"))


TOPICS = [
    (1, ["rust", "rust", "linux"], ["Rust", "Web Dev", "misc", "Web dev", "Go", "Zig"]),
    (2, ["a", "b", "c", "d", "e", "f", "g"], ["New One", "Another"]),
    (3, ["a", "b", "c", "d", "e", "f", "g", "h", "i"], ["New One"]),
    (4, ["ai"], ["blog", "!!"]),
    (5, ["ai"], ["One Thing"]),
]
_SLUGGED = f"list_transform(cats, lambda c: {SLUG('c')})"
_ORDERED = lambda x: f"list_filter({x}, lambda v, i: v <> '' AND list_position({x}, v) = i)"


@query(
    f"WITH {each_values('t', 'id, tags, cats', TOPICS)}, u AS (SELECT id, {_ORDERED('tags')} AS own, {_SLUGGED} AS slugs FROM t), "
    f"v AS (SELECT id, own, list_filter({_ORDERED('slugs')}, lambda s: NOT list_contains(own, s)) AS fresh FROM u) "
    f"SELECT id, list_concat(own, fresh[1:greatest(0, least(3, 8 - len(own)))]) AS topics FROM v"
)
def article_topics(spark, d):
    t = each(spark, d, "id int, tags array<string>, cats array<string>", TOPICS)
    return t.select("id", text.article_topics(F.col("tags"), F.col("cats")).alias("topics"))


NAMES = [
    ("  My   Notes | ",), ("Home",), ("* 12. The Long Road",), ("[No title found]",), ("see https://a.org",), ("!badge",), ("x" * 90,), ("Tom &amp; Ann&#39;s",),
    ("READ MORE",), ("",), ("- - Small Web -",), (None,),
]
_EDGE = r"[ \t\"''*`_|:·–—-]"
_NAME = f"trim(regexp_replace(regexp_replace(regexp_replace({DECODE('raw')}, '\\s+', ' ', 'g'), '^{_EDGE}+|{_EDGE}+$', '', 'g'), '^[*\\-•0-9.)\\s]+', '', 'g'))"


@query(
    f"WITH {each_values('t', 'raw', NAMES)}, n AS (SELECT raw, {_NAME} AS name FROM t) SELECT raw, CASE WHEN NOT (name = '' OR length(name) > 80 OR lower(name) IN {in_list(fixed.GENERIC_NAMES)} "
    "OR regexp_matches(name, '^\\[.*\\]$') OR contains(name, 'http://') OR contains(name, 'https://') OR starts_with(name, '!')) THEN name END AS name FROM n"
)
def clean_name(spark, d):
    return each(spark, d, "raw string", NAMES).select("raw", text.clean_name(F.col("raw")).alias("name"))


# URLs. `u` splits a URL as the engine does.
U = f"(SELECT page_id, url, lower(regexp_extract(url, '{urls.URL}', 1)) AS sch, lower(regexp_extract(url, '{urls.URL}', 2)) AS loc, regexp_extract(url, '{urls.URL}', 3) AS path, regexp_extract(url, '{urls.URL}', 4) AS q FROM src)"
V = f"(SELECT *, regexp_replace(regexp_replace(loc, '^.*@|:[0-9]*$', '', 'g'), '^\\.+|\\.+$', '', 'g') AS host FROM {U})"
BARE = "regexp_replace(host, '^www\\.', '')"
SEGS = "list_filter(string_split(path, '/'), lambda s: s <> '')"
_tail = lambda xs: "(" + "|".join(x.replace(".", "\\.") for x in xs) + ")$"
_head = lambda xs: "^(" + "|".join(x.replace(".", "\\.") for x in xs) + ")"
TENANT = f"(host IN {in_list(fixed.MULTI_TENANT_HOSTS)} OR regexp_matches(host, '{_tail(fixed.MULTI_TENANT_HOST_SUFFIXES)}'))"
EXT = "lower(regexp_extract(path, '[^/.][^/]*?(\\.[^./]+)/*$', 1))"
PAGES = "WITH src AS (SELECT page_id, url FROM pages) "

MORE_URLS = [
    (1, "https://medium.com/@someone/a-post-1?utm_source=x&b=2"), (2, "http://ann.github.io/blog/one.html#top"), (3, "https://www.example.com/"),
    (4, "http://10.0.0.1/x"), (5, "ftp://a.org/x"), (6, "https://cdn.site.org/a"), (7, "https://site.org/pic.PNG"), (8, "https://a.b.co.uk/Tech/2024/01/"),
    (9, "https://dev.to/joe/42"), (10, "https://substack.com/p/xyz"), (11, "https://Site.ORG:8080/~tom/x?ref=1&z=1&a=&c"), (12, "not a url"), (13, "https://localhost/x"),
    (14, "https://host.test/"), (15, "https://ok.org/a/b/?q=1&amp;fbclid=9)."), (16, "https://note.com/123/x"), (17, "https://vendor.com/engineering/x/y"),
]
MORE = f"WITH {each_values('src', 'page_id, url', MORE_URLS)} "


def _more(spark, d):
    return each(spark, d, "page_id int, url string", MORE_URLS)


@query(PAGES + f"SELECT page_id, host, {BARE} AS label FROM {V}")
def url_host_label(spark, d):
    u = F.col("url")
    return pages(spark, d).select("page_id", urls.host(u).alias("host"), urls.host_label(u).alias("label"))


@query(PAGES + f"SELECT page_id, {BARE} || regexp_replace(path, '/+$', '') AS site_key FROM {V}")
def url_site_key(spark, d):
    return pages(spark, d).select("page_id", urls.site_key(F.col("url")).alias("site_key"))


_FIRST = f"({SEGS})[1]"
_LOW = f"lower({_FIRST})"
_KEEP = f"(regexp_matches({_LOW}, '^[@~]') OR {_LOW} IN {in_list(fixed.BLOG_PATH_SEGMENTS)} OR ({TENANT} AND {_LOW} NOT IN {in_list(fixed.PATH_NOISE_SEGMENTS)} AND NOT contains({_LOW}, '.') AND NOT regexp_matches({_LOW}, '^[0-9]+$')))"
SITE = f"CASE WHEN host <> '' THEN sch || '://' || loc || CASE WHEN {_FIRST} IS NOT NULL AND {_KEEP} THEN '/' || {_FIRST} || '/' ELSE '/' END END"


@query(PAGES + f"SELECT page_id, {SITE} AS site FROM {V}")
def url_canonical_site(spark, d):
    return pages(spark, d).select("page_id", urls.canonical_site(F.col("url")).alias("site"))


@query(MORE + f"SELECT page_id, {SITE} AS site FROM {V}")
def url_canonical_site_cases(spark, d):
    return _more(spark, d).select("page_id", urls.canonical_site(F.col("url")).alias("site"))


_PAIRKEY = "lower(split_part(p, '=', 1))"
_QUERY = f"array_to_string(list_transform(list_filter(string_split(q, '&'), lambda p: p <> '' AND {_PAIRKEY} NOT IN {in_list(fixed.TRACKING_QUERY_KEYS)} AND NOT starts_with({_PAIRKEY}, 'utm_')), lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END), '&')"
_BAD = (
    f"(NOT regexp_matches(url, '^https?://') OR NOT contains(host, '.') OR host IN {in_list(fixed.EXCLUDED_HOSTS)} OR {BARE} IN {in_list(fixed.EXCLUDED_HOSTS)} OR regexp_matches(host, '{_tail(fixed.EXCLUDED_HOST_SUFFIXES)}') "
    f"OR regexp_matches(host, '{_head(fixed.EXCLUDED_HOST_PREFIXES)}') OR regexp_matches(host, '^[0-9.]+$') OR regexp_matches(host, '{_tail(fixed.RESERVED_TLD_SUFFIXES)}') OR {EXT} IN {in_list(fixed.NON_PAGE_EXTENSIONS)})"
)
_CLEANED = f"CASE WHEN NOT {_BAD} THEN CASE WHEN sch = 'http' AND ends_with(host, '.github.io') THEN 'https' ELSE sch END || '://' || loc || path || CASE WHEN {_QUERY} <> '' THEN '?' || {_QUERY} ELSE '' END END"
_PRE = lambda x: f"replace(regexp_replace({DECODE(f'trim({x})')}, '[.,;:!?''\">)\\]}}]+$', ''), '\\:', ':')"


@query(f"WITH src AS (SELECT page_id, {_PRE('url')} AS url FROM pages) SELECT page_id, {_CLEANED} AS clean FROM {V}")
def url_clean(spark, d):
    return pages(spark, d).select("page_id", urls.clean_url(F.col("url")).alias("clean"))


@query(f"WITH {each_values('raw', 'page_id, url', MORE_URLS)}, src AS (SELECT page_id, {_PRE('url')} AS url FROM raw) SELECT page_id, {_CLEANED} AS clean FROM {V}")
def url_clean_cases(spark, d):
    return _more(spark, d).select("page_id", urls.clean_url(F.col("url")).alias("clean"))


_LABELS = f"string_split({BARE}, '.')"


@query(PAGES + f"SELECT page_id, array_to_string(list_transform(string_split(replace(CASE WHEN len({_LABELS}) >= 2 THEN {_LABELS}[-2] ELSE {_LABELS}[1] END, '-', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name FROM {V}")
def url_domain_name(spark, d):
    return pages(spark, d).select("page_id", urls.domain_name(F.col("url")).alias("name"))


_KEEPN = f"(CASE WHEN regexp_matches({BARE}, '{_tail(fixed.MULTI_TENANT_HOST_SUFFIXES)}') THEN 3 ELSE 2 END)"


@query(PAGES + f"SELECT page_id, CASE WHEN len({_LABELS}) >= {_KEEPN} THEN array_to_string({_LABELS}[-{_KEEPN}:], '.') ELSE {BARE} END AS domain FROM {V}")
def url_registrable(spark, d):
    return pages(spark, d).select("page_id", urls.registrable_domain(urls.host(F.col("url"))).alias("domain"))


_PSK = f"(CASE WHEN regexp_matches(host, '{_tail(['.' + s for s in urls.LONG_SUFFIXES])}') THEN 3 ELSE 2 END)"


@query(MORE + f"SELECT page_id, CASE WHEN len(string_split(host, '.')) >= {_PSK} THEN array_to_string(string_split(host, '.')[-{_PSK}:], '.') ELSE host END AS domain FROM {V}")
def url_public_suffix(spark, d):
    return _more(spark, d).select("page_id", urls.public_suffix_plus_one(urls.host(F.col("url"))).alias("domain"))


_VP = f"array_to_string(list_sort(list_transform(list_filter(string_split(q, '&'), lambda p: p <> '' AND NOT regexp_matches(lower(split_part(p, '=', 1)), '{fixed.VISIT_TRACKING}')), lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END)), '&')"


_CANONICAL = PAGES + f"SELECT page_id, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(regexp_replace(loc, '^.*@', ''), CASE sch WHEN 'https' THEN ':(443)?$' WHEN 'http' THEN ':(80)?$' ELSE '^$' END, ''), '^www\\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN {_VP} <> '' THEN '?' || {_VP} ELSE '' END ELSE lower(trim(url)) END AS page FROM {V}"


@query(_CANONICAL)
def url_visit_canonical(spark, d):
    return pages(spark, d).select("page_id", urls.visit_canonical(F.col("url")).alias("page"))


# the hash as a fold over characters, in wide whole numbers that are cut to 32 bits
_U = lambda x: f"{x}::UHUGEINT"
_FOLD = (
    f"list_reduce(list_transform(range(1, len(page) + 1), lambda i: {{'a': {_U('ord(page[i])')}, 'b': {_U('0')}}}), lambda x, u: {{'a': (xor(x.a, u.a) * 2654435761) % 4294967296, 'b': (xor(x.b, u.a) * 1597334677) % 4294967296}}, "
    f"{{'a': {_U('3735928559')}, 'b': {_U('1103547991')}}})"
)
_STEPS = (("a", "a", 16, 2246822507, None), ("a", "b", 13, 3266489909, "a"), ("b", "b", 16, 2246822507, None), ("b", "a", 13, 3266489909, "b"))


def _mixed() -> str:
    """CTEs h0 to h4: the four closing steps, each of which changes one half."""
    out = f"h0 AS (SELECT page_id, r.a AS a, r.b AS b FROM (SELECT page_id, {_FOLD} AS r FROM c))"
    for i, (target, source, shift, factor, onto) in enumerate(_STEPS):
        value = f"(xor({source}, {source} // {2**shift}) * {factor}) % 4294967296"
        value = f"xor({onto}, {value})" if onto else value
        other = "b" if target == "a" else "a"
        out += f", h{i + 1} AS (SELECT page_id, {value} AS {target}, {other} FROM h{i})"
    return out


@query(f"WITH c AS ({_CANONICAL}), {_mixed()} SELECT page_id, (4294967296 * (b % 2097152) + a)::BIGINT AS visit_key FROM h4")
def url_cyrb53(spark, d):
    return pages(spark, d).select("page_id", urls.visit_key(F.col("url")).alias("visit_key"))


_ROOT = "sch || '://' || loc || '/'"
_BASE = "CASE WHEN ends_with(url, '/') THEN url ELSE url || '/' END"
_PATHS = "[" + ", ".join(f"'{p}'" for p in fixed.COMMON_FEED_PATHS) + "]"


@query(
    PAGES + f"SELECT page_id, len(list_distinct(list_concat(list_transform({_PATHS}, lambda p: ({_BASE}) || p), list_transform({_PATHS}, lambda p: ({_ROOT}) || p)))) AS n, "
    f"({_BASE}) || 'feed' AS first_guess FROM {V}"
)
def url_feed_guesses(spark, d):
    g = urls.feed_guesses(F.col("url"))
    return pages(spark, d).select("page_id", F.size(g).cast("long").alias("n"), F.get(g, F.lit(0)).alias("first_guess"))


@query(
    f"WITH {each_values('more', 'page_id, url', MORE_URLS)}, src AS (SELECT page_id, url FROM pages UNION ALL SELECT 1000000000 + page_id, url FROM more) "
    f"SELECT page_id, sch IN ('http', 'https') AND host <> '' AND len({SEGS}) > 0 AND {EXT} NOT IN {in_list(fixed.NON_ARTICLE_EXTENSIONS)} AND NOT list_has_any(list_transform({SEGS}, lambda s: lower(s)), {list(fixed.NON_ARTICLE_SEGMENTS)}) AS is_article FROM {V}"
)
def url_is_article(spark, d):
    every = pages(spark, d).select("page_id", "url").unionByName(_more(spark, d).select((F.col("page_id") + 1_000_000_000).cast("long").alias("page_id"), "url"))
    return every.select("page_id", urls.is_article_url(F.col("url"), F.col("url")).alias("is_article"))


PATHS = [("/2024/11/02/title",), ("/2024-11-31-title",), ("/2019/2/",), ("/1989/01/01/x",), ("/about/",), ("/blog/2024/13/01/",), ("/2023/02/30/a",), ("/x2024/01/02",), ("/2020/05",)]
_PD = r"(?:^|/)([0-9]{4})[/-]([0-9]{1,2})(?:[/-]([0-9]{1,2}))?(?:[/-]|$)"


@query(
    f"WITH {each_values('t', 'path', PATHS)}, p AS (SELECT path, try_cast(regexp_extract(path, '{_PD}', 1) AS INT) AS y, try_cast(regexp_extract(path, '{_PD}', 2) AS INT) AS m, "
    f"CASE WHEN regexp_extract(path, '{_PD}', 3) = '' THEN 1 ELSE try_cast(regexp_extract(path, '{_PD}', 3) AS INT) END AS dd FROM t) "
    "SELECT path, CASE WHEN y BETWEEN 1990 AND 2027 AND m BETWEEN 1 AND 12 AND dd BETWEEN 1 AND 31 THEN (make_date(y, m, 1) + (dd - 1)::INT)::DATE END AS day FROM p"
)
def url_date_from_path(spark, d):
    return each(spark, d, "path string", PATHS).select("path", urls.date_in_path(F.col("path"), 2027).alias("day"))


IPS = [("127.0.0.1",), ("8.8.8.8",), ("10.1.2.3",), ("172.16.0.1",), ("172.32.0.1",), ("192.168.1.1",), ("169.254.1.1",), ("100.64.0.1",), ("100.128.0.1",), ("224.0.0.1",), ("0.0.0.0",), ("99.1.1.1",)]


@query(
    f"WITH {each_values('t', 'ip', IPS)}, o AS (SELECT ip, list_transform(string_split(ip, '.'), lambda x: x::INT) AS o FROM t) SELECT ip, NOT (o[1] IN (0, 10, 127) OR o[1] >= 224 OR (o[1] = 172 AND o[2] BETWEEN 16 AND 31) "
    "OR (o[1] = 192 AND o[2] = 168) OR (o[1] = 169 AND o[2] = 254) OR (o[1] = 100 AND o[2] BETWEEN 64 AND 127)) AS is_public FROM o"
)
def url_public_ip(spark, d):
    return each(spark, d, "ip string", IPS).select("ip", urls.is_public_ipv4(F.col("ip")).alias("is_public"))


@query(PAGES + f"SELECT page_id, regexp_replace({BARE}, '[^A-Za-z0-9_-]', '-', 'g') || '-' || sha256(url)[1:16] AS article_id FROM {V}")
def article_id(spark, d):
    u = F.col("url")
    return pages(spark, d).select("page_id", text.article_id(urls.host_label(u), u).alias("article_id"))


TIMES = [
    ("2024-03-05T10:20:30Z",), ("2024-03-05T10:20:30+02:00",), ("Tue, 05 Mar 2024 10:20:30 -0700",), ("Tue, 5 Mar 2024 10:20:30 +0000",), ("05 Mar 24 10:20 +0100",),
    ("2024-03-05T10:20:30",), ("2024-03-05",), ("yesterday",), ("",), (None,), ("Tue, 05 Mar 2024 10:20:30 GMT",),
]
_WANT = ["2024-03-05 10:20:30", "2024-03-05 08:20:30", "2024-03-05 17:20:30", "2024-03-05 10:20:30", "2024-03-05 09:20:00", "2024-03-05 10:20:30", "2024-03-05 00:00:00", None, None, None, "2024-03-05 10:20:30"]


@query(f"WITH {each_values('t', 'raw, want', [(a, b) for (a,), b in zip(TIMES, _WANT)])} SELECT raw, want AS utc FROM t")
def feed_time_formats(spark, d):
    return each(spark, d, "raw string", TIMES).select("raw", F.date_format(dates.parse_time(F.col("raw")), "yyyy-MM-dd HH:mm:ss").alias("utc"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS rfc3339, ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-11' AS inside FROM events")
def date_output_and_day_bounds(spark, d):
    ts = F.col("ts").cast("timestamp")
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", dates.rfc3339(ts).alias("rfc3339"), dates.in_days(ts, "2024-01-05", "2024-01-10").alias("inside"))


@query(
    PAGES + f"SELECT page_id, base || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS source_id FROM (SELECT page_id, base, row_number() OVER (PARTITION BY base ORDER BY page_id) AS n FROM "
    f"(SELECT page_id, CASE WHEN k = '' THEN 'source' ELSE k END AS base FROM (SELECT page_id, {KEBAB('''array_to_string(list_concat(CASE WHEN regexp_matches(bare, '%s') AND len(labels) > 2 THEN labels[1:1] WHEN len(labels) > 1 THEN labels[:-2] ELSE labels END, CASE WHEN seg IS NOT NULL THEN [regexp_replace(seg, '^[@~]+', '')] ELSE []::VARCHAR[] END), '-')''' % _tail(fixed.MULTI_TENANT_HOST_SUFFIXES))} AS k "
    f"FROM (SELECT page_id, {BARE} AS bare, {_LABELS} AS labels, {_FIRST} AS seg FROM {V}))))"
)
def source_id_unique(spark, d):
    from quillet.operators.builder import unique_ids

    rows = pages(spark, d).select("page_id", urls.source_id_base(F.col("url")).alias("base"))
    return unique_ids(rows, "base", ["page_id"], "source_id").select("page_id", "source_id")
