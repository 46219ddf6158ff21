"""Queries of the source builder, the discovery pass, the streams and the star-schema extras, with their oracles."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillet.functions import fixed, text
from quillet.operators import builder, discover
from quillet.plans.literals import each, each_result, each_values, frame, judged_sql
from quillet.sources import documents as src
from quillet.streaming import jobs

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


LISTS = [
    ("list.md", "https://lists.org/x", 1, "- [Ann's Notes](https://ann.org/post/1) and https://bob.net/blog/a"), ("list.md", "https://lists.org/x", 2, "prose with https://hidden.org/ inside"),
    ("list.md", "https://lists.org/x", 3, "* [Home](https://bob.net/blog/z?utm_source=q) [own](https://www.lists.org/a)"), ("list.md", "https://lists.org/x", 4, "1. https://github.com/someone"), ("feeds.csv", "https://lists.org/x", 1, "name,https://cy{n}.github.io/feed.xml,x"),
]


@query(each_result("SELECT * FROM (VALUES ('https://ann.org/', 'Ann''s Notes'), ('https://ann.org/', NULL), ('https://bob.net/blog/', NULL), ('https://bob.net/blog/', NULL), ('https://bob.net/blog/', NULL), ('https://cy{n}.github.io/', NULL)) AS t(site, name)"))
def harvest_links(spark, d):
    return builder.harvest(each(spark, d, "path string, origin string, line_no int, line string", LISTS)).select("site", "name")


CANDIDATES = [
    ("https://a.org/", None, None, ["rust"], ["l1"], 1), ("https://a.org/", "A", None, ["go", "rust"], ["l2"], 2), ("https://a.org/", "Other", "https://a.org/feed", [], ["l1"], 3), ("https://b.org/", "B", None, ["ai"], ["l3"], 4),
]


@query(each_result("SELECT * FROM (VALUES ('https://a.org/', 'A', 'https://a.org/feed', 'go,rust', 'l1,l2'), ('https://b.org/', 'B', NULL, 'ai', 'l3')) AS t(site, name, feed, tags, origins)"))
def harvest_merge(spark, d):
    m = builder.merge_candidates(each(spark, d, "site string, name string, feed string, tags array<string>, origins array<string>, ord int", CANDIDATES))
    return m.select("site", "name", "feed", F.array_join("tags", ",").alias("tags"), F.array_join("origins", ",").alias("origins"))


@query("SELECT source AS site, min(doc_id) AS first_doc, string_agg(DISTINCT lang, ',' ORDER BY lang) AS tags FROM documents GROUP BY source")
def redirect_merge(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("site"), F.col("doc_id").cast("string").alias("name"), F.lit(None).cast("string").alias("feed"), F.array("lang").alias("tags"), F.array(F.lit("l")).alias("origins"), F.col("doc_id").alias("ord"))
    return builder.merge_candidates(docs).select("site", F.col("name").cast("long").alias("first_doc"), F.array_join("tags", ",").alias("tags"))


VOCABULARY = {"english": ["the", "and", "of"], "german": ["der", "und", "die"], "french": ["le", "les", "qui"], "spanish": ["el", "los", "que"]}


def _scored(tag, words):
    plain = "(' ' || regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g') || ' ')"
    return f"SELECT doc_id, '{tag}' AS tag, " + " + ".join(f"contains({plain}, ' {w} ')::INT" for w in words) + " AS score FROM documents WHERE text IS NOT NULL"


@query("SELECT * FROM (" + " UNION ALL ".join(_scored(t, w) for t, w in VOCABULARY.items()) + ") WHERE score >= 2")
def tag_scores(spark, d):
    return builder.tag_scores(table(spark, d, "documents"), VOCABULARY, "text", "doc_id")


TAGSETS = [(1, ["Zeta", "rust", "AI", "go", "b b", "python", "linux", "ai"]), (2, []), (3, ["personal-blogs", "x"])]
ORDER = ["rust", "go", "python", "linux", "ai", *fixed.PROVENANCE_TAGS]


@query(each_result("SELECT * FROM (VALUES (1, 'rust,go,python,linux,ai,b-b'), (2, ''), (3, 'personal-blogs,x')) AS t(id, tags)"))
def tag_order(spark, d):
    return each(spark, d, "id int, tags array<string>", TAGSETS).select("id", F.array_join(builder.ordered_tags(F.col("tags"), ORDER), ",").alias("tags"))


SEEDS = [("https://github.com/x/awesome-personal-blogs",), ("https://smallweb.org/list",), ("https://github.com/y/engineering-ml-company-blogs",), ("https://data.org/science",), ("https://z.org/",)]


@query(each_result("SELECT * FROM (VALUES ('https://github.com/x/awesome-personal-blogs', 'personal-blogs'), ('https://smallweb.org/list', 'personal-blogs,independent-web,small-web'), ('https://github.com/y/engineering-ml-company-blogs', 'company-blogs'), ('https://data.org/science', ''), ('https://z.org/', '')) AS t(seed, tags)"))
def tag_provenance(spark, d):
    return each(spark, d, "seed string", SEEDS).select("seed", F.array_join(builder.provenance_tags(F.col("seed")), ",").alias("tags"))


@query(each_result("SELECT * FROM (VALUES ('https://github.com/x/awesome-personal-blogs', 'tech'), ('https://smallweb.org/list', 'tech'), ('https://github.com/y/engineering-ml-company-blogs', 'software-engineering,ai,machine-learning'), ('https://data.org/science', 'data-science,science'), ('https://z.org/', 'tech')) AS t(seed, tags)"))
def tag_fallback(spark, d):
    return each(spark, d, "seed string", SEEDS).select("seed", F.array_join(builder.fallback_tags(F.col("seed")), ",").alias("tags"))


SEED_LINES = [("# comment",), ("",), ("  https://github.com/a/b ",), ("https\\://github.com/topics/blogs",), ("https://list.org/page",), ("https://github.com/only",), ("ftp://x.org",)]


@query(each_result("SELECT * FROM (VALUES ('https://github.com/a/b', 'repository', 'a/b'), ('https://github.com/topics/blogs', 'topic', 'blogs'), ('https://list.org/page', 'page', NULL), ('https://github.com/only', 'skipped', NULL), ('ftp://x.org', 'skipped', NULL)) AS t(seed, kind, name)"))
def seed_classes(spark, d):
    return src.seeds(each(spark, d, "value string", SEED_LINES))


FILES = [("README.md", 10, True), ("docs/LICENSE.md", 10, False), (".github/list.md", 10, False), ("a/blogs", 10, True), ("a/random", 10, False), ("pic.png", 10, False), ("big.csv", 10_000_000, False), ("x.opml", 10, True)]


@query(f"WITH {each_values('t', 'path, size, listed', FILES)} SELECT * FROM t")
def list_file_predicate(spark, d):
    return each(spark, d, "path string, size int, want boolean", FILES).select("path", "size", src.is_list_file(F.col("path"), F.col("size"), 1_000_000).alias("listed"))


ENTRIES = [
    ("a", "A", "https://a.org/", "https://a.org/feed", ["rust"]), ("b", "B", "http://www.b.org/", None, ["go"]), ("medium-com", "Medium", "https://medium.com/", None, ["tech"]), ("medium-joe", "Joe", "https://medium.com/@joe/", None, ["tech"]), ("lone", "Lone", "https://dev.to/", None, []),
]
ENTRY_SCHEMA = "id string, name string, site string, feed string, tags array<string>"
OVERRIDES = [("https://b.org", None, "https://b.org/rss", None), ("https://new.org/", "New", None, ["ai"]), ("https://gone.org/", "Gone", None, None)]
OVERRIDE_SCHEMA = "site string, name string, feed string, tags array<string>"


def _entries(spark, d):
    return each(spark, d, ENTRY_SCHEMA, ENTRIES)


@query(each_result("SELECT * FROM (VALUES ('https://a.org/', 'A', 'https://a.org/feed', 'rust'), ('http://www.b.org/', 'B', 'https://b.org/rss', 'go'), ('https://medium.com/', 'Medium', NULL, 'tech'), ('https://medium.com/@joe/', 'Joe', NULL, 'tech'), ('https://dev.to/', 'Lone', NULL, ''), ('https://new.org/', 'New', NULL, 'ai')) AS t(site, name, feed, tags)"))
def overrides_merge(spark, d):
    return builder.apply_overrides(_entries(spark, d), each(spark, d, OVERRIDE_SCHEMA, OVERRIDES)).withColumn("tags", F.array_join("tags", ","))


@query(each_result("SELECT * FROM (VALUES ('https://gone.org/')) AS t(site)"))
def overrides_unmatched(spark, d):
    return builder.unmatched_overrides(_entries(spark, d), each(spark, d, OVERRIDE_SCHEMA, OVERRIDES))


@query(each_result("SELECT * FROM (VALUES ('a'), ('b'), ('medium-joe'), ('lone')) AS t(id)"))
def drop_platform_roots(spark, d):
    return builder.drop_platform_roots(_entries(spark, d)).select("id")


BROKEN = [("a{n}", "A", "https://a.org/", None, ["rust"]), ("a{n}", "", "https://b.org/", None, ["Bad Tag"]), (None, "C", "nonsense{n}", None, []), ("d{n}", "D", "https://a.org/", None, [])]


@query(each_result("SELECT * FROM (VALUES ('https://a.org/', 'id repeated'), ('https://a.org/', 'site repeated'), ('https://b.org/', 'id repeated'), ('https://b.org/', 'name missing'), ('https://b.org/', 'tag form'), ('nonsense{n}', 'id missing'), ('nonsense{n}', 'id repeated'), ('nonsense{n}', 'site form'), ('https://a.org/', 'site repeated')) AS t(site, problem)"))
def validate_entries(spark, d):
    return builder.violations(each(spark, d, ENTRY_SCHEMA, BROKEN))


STATES = [("https://a.org/", ["x", "y"], ["l2", "l1"], 200, None), ("https://b.org/", [], ["l1"], None, "timeout"), ("https://c.org/", ["z"], [], None, None)]


@query(each_result("SELECT * FROM (VALUES ('https://a.org/', 'yes', 'x,y', 'l1 | l2', NULL), ('https://b.org/', 'no', '', 'l1', 'timeout'), ('https://c.org/', 'unchecked', 'z', '', NULL)) AS t(site, reachable, tags, origins, error)"))
def audit_report(spark, d):
    c = each(spark, d, "site string, tags array<string>, origins array<string>, status_code int, error string", STATES)
    return builder.audit(c, c.where("NOT contains(site, '/c-')"))


@query("SELECT p.page_id, k.page_id AS known FROM pages p LEFT JOIN (SELECT regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', ''), ':[0-9]*$', '') AS key, min(page_id) AS page_id FROM pages GROUP BY 1) k ON regexp_replace(regexp_replace(lower(regexp_extract(p.url, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', ''), ':[0-9]*$', '') = k.key")
def known_feed_join(spark, d):
    from quillet.functions import urls

    p = table(spark, d, "pages").withColumn("key", urls.host_label(F.col("url")))
    known = p.groupBy("key").agg(F.min("page_id").alias("known"))
    return p.join(known, "key", "left").select("page_id", "known")


RESERVED = [("blog{n}",), ("blog{n}-2",), ("blog{n}-4",), ("news{n}-2",)]
BASES = [("blog{n}", 1), ("blog{n}", 2), ("blog{n}", 3), ("news{n}", 1), ("news{n}", 2), ("free{n}", 1)]


@query(each_result("SELECT * FROM (VALUES ('blog{n}', 1, 'blog{n}-3'), ('blog{n}', 2, 'blog{n}-5'), ('blog{n}', 3, 'blog{n}-6'), ('news{n}', 1, 'news{n}'), ('news{n}', 2, 'news{n}-3'), ('free{n}', 1, 'free{n}')) AS t(base, n, id)"))
def source_id_reserved(spark, d):
    return builder.unique_ids(each(spark, d, "base string, n int", BASES), "base", ["n"], "id", each(spark, d, "id string", RESERVED)).select("base", "n", "id")


# Discovery.
_SOURCES = "s AS (SELECT source AS id, row_number() OVER (ORDER BY source) - 1 AS pos FROM (SELECT DISTINCT source FROM documents))"


def _sources(spark, d):
    names = table(spark, d, "documents").select(F.col("source").alias("id")).distinct()
    return names.withColumn("pos", F.row_number().over(W.orderBy("id")) - 1)


@query(f"WITH {_SOURCES} SELECT id, (pos - 17 + 20) % 20 AS turn FROM s WHERE (pos - 17 + 20) % 20 < 6")
def cursor_slice(spark, d):
    return discover.circular_slice(_sources(spark, d), 17, 6).select("id", F.col("turn").cast("long"))


@query(f"WITH {_SOURCES}, l(last) AS (VALUES ('src3'), ('nope'), ('src9')) SELECT last, coalesce((pos + 1) % (SELECT count(*) FROM s), 0) AS position FROM l LEFT JOIN s ON last = id")
def cursor_resume(spark, d):
    s = _sources(spark, d)
    return frame(spark, "last string, position long", [(x, discover.resume_position(s, x)) for x in ("src3", "nope", "src9")])


RESULTS = [("a", 3, None), ("b", 0, "context deadline exceeded"), ("c", 0, "parse error"), ("d", 2, None), ("e", 0, "context canceled"), ("f", 0, "Timeout awaiting headers")]


@query("SELECT 6 * count(*) AS sources, 5 * count(*) AS articles, 4 * count(*) AS failed, 2 * count(*) AS timed_out, TRUE AS advance FROM pages")
def pass_summary(spark, d):
    return discover.summary(each(spark, d, "id string, n int, error string", RESULTS))


@query("SELECT kind, n * (SELECT count(*) FROM pages) AS n FROM (VALUES ('timeout', 2), ('error', 1), ('canceled', 1)) AS t(kind, n)")
def failure_kinds(spark, d):
    r = each(spark, d, "id string, n int, error string", RESULTS).where("error IS NOT NULL")
    return r.groupBy(discover.failure_kind(F.col("error")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# Streams.


@query(f"SELECT user_id, event_id, s >= 1 AS allowed FROM ({judged_sql(0.001, 3, 'events')})")
def limiter_stream(spark, d):
    return jobs.run_limiter(spark, f"{d}/events.parquet", 0.001, 3)


@query("SELECT doc_id AS id, md5(text) AS url, source AS title, lang AS author, source AS source_id FROM documents")
def discover_stream(spark, d):
    row_of = lambda b: b.select(F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("url"), F.col("source").alias("title"), F.col("lang").alias("author"), F.col("source").alias("source_id"))
    return jobs.run_discovery(spark, f"{d}/documents.parquet", row_of)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark, d):
    return jobs.windowed_counts(table(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


# Extras on the star schema: one query for each kind of relational operator.


@query("SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def extra_join_aggregate(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def extra_anti_join(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_orderstatus = 'P'")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def extra_left_join(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").select("c_custkey", F.coalesce("n", F.lit(0).cast("long")).alias("orders"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def extra_pricing_summary(spark, d):
    l = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")
    )


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def extra_cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ROLLUP (p_brand, p_size)")
def extra_rollup(spark, d):
    return table(spark, d, "part").rollup("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS dr, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
def extra_ranking(spark, d):
    w, t = W.partitionBy("o_custkey").orderBy("o_orderpriority"), W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("dr"), F.lead("o_orderkey").over(t).alias("nxt"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def extra_top_per_group(spark, d):
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("r", F.row_number().over(w)).where("r <= 3").select("o_custkey", "o_orderkey")


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS moving FROM events")
def extra_moving_sum(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return table(spark, d, "events").select("event_id", F.round(F.sum("value").over(w), 4).alias("moving"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def extra_union(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def extra_intersect(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).intersect(o.where("o_orderstatus = 'O'").select("o_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def extra_except(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_custkey"))


@query("WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOURS THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM e) SELECT user_id, sid::BIGINT AS sid, count(*) AS n, min(ts) AS first_ts FROM s GROUP BY user_id, sid")
def extra_sessions(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.coalesce((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp")) > 6 * 3600 * 1_000_000).cast("int"), F.lit(0))
    return table(spark, d, "events").withColumn("new", gap).withColumn("sid", F.sum("new").over(w)).groupBy("user_id", "sid").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"))


@query("SELECT e.event_id, max(p.ts) AS last_purchase FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts WHERE e.event_type = 'click' GROUP BY e.event_id")
def extra_as_of(spark, d):
    # the last purchase at or before a click: one pass over each user's events, no range join
    w = W.partitionBy("user_id").orderBy("ts").rangeBetween(W.unboundedPreceding, 0)
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    last = F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(w)
    return e.withColumn("last_purchase", last).where("event_type = 'click'").select("event_id", F.col("last_purchase").cast("timestamp_ntz").alias("last_purchase"))


@query()
def extra_approx_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"))


@query("SELECT event_type, min(value) AS lo, max(value) AS hi, count(DISTINCT user_id) AS users, count(*) FILTER (value > 50) AS big FROM events GROUP BY event_type")
def extra_distinct_and_filtered(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("value") > 50).alias("big"))


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id")
def extra_pivot(spark, d):
    p = table(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "view"]).count()
    return p.select("user_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("click", "view")])


@query(f"SELECT doc_id, len(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''))) AS terms FROM documents")
def extra_array_distinct(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(F.array_distinct(text.search_terms(F.coalesce("text", F.lit(""))))).cast("long").alias("terms"))
