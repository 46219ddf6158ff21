"""Rules that one query can't show: loops against set forms, streams against batches, errors, awkward input."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillet.functions import dates, text, urls
from quillet.operators import builder, corpus, discover, filters, html, limits, search
from quillet.operators import index as stored
from quillet.plans import searching
from quillet.sources import documents as src
from quillet.streaming import jobs

DATA = "/root/testdata/sf0.001"
WINDOW = "rank int, url string, source_id string"


def test_page_selection_equals_the_loop(spark):
    r = random.Random(1)
    for _ in range(12):
        n, limit = r.randint(0, 40), r.randint(1, 12)
        rows = [(i + 1, f"u{r.randint(0, 30)}", r.choice([None, "a", "b", "c"])) for i in range(n)]
        window = spark.createDataFrame(rows, WINDOW)
        page = search.select_page(window, limit)
        kept, read = search.loop_page(rows, limit)
        assert [x["rank"] for x in page.orderBy("rank").collect()] == kept
        bounds = search.page_bounds(window, page, limit, 0, max(n, 1), F.lit(1000)).first()
        assert bounds["read"] == read or len(kept) == limit and bounds["read"] <= read


def test_one_source_owns_the_first_rows(spark):
    rows = [(i + 1, f"u{i}", "one" if i < 29 else f"s{i}") for i in range(100)]
    frame = spark.createDataFrame(rows, WINDOW)
    assert search.select_page(frame.where("rank <= 20"), 20).count() == 3
    page = search.select_page(frame.where("rank <= 60"), 20)
    assert page.count() == 20
    assert search.page_bounds(frame.where("rank <= 60"), page, 20, 0, 60, F.lit(100)).first()["next_offset"] == 46


def test_paging_repeats_and_loses_nothing(spark):
    r = random.Random(3)
    rows = [(i + 1, f"u{i}", r.choice("abcdef")) for i in range(70)]
    seen, offset = [], 0
    while offset < 70:
        window = [x for x in rows if offset < x[0] <= offset + 15]
        kept, read = search.loop_page(window, 5)
        seen += kept
        assert read > 0
        offset += read
    assert len(seen) == len(set(seen))


def test_requests():
    good = search.parse_request({"q": " Go  lang ", "limit": "50", "offset": "1000"})
    assert good.terms == ("go", "lang") and good.limit == 50
    assert search.parse_request({"q": "a", "mode": "semantic", "offset": "30"}).semantic
    for bad in ({}, {"q": "x" * 513}, {"q": "a", "limit": "0"}, {"q": "a", "offset": "1001"}, {"q": "a", "mode": "semantic", "offset": "31"}, {"q": "a", "origin": "x"}, {"q": "a", "mode": "x"}):
        assert isinstance(search.parse_request(bad), str)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('index')}"
    stored.add(searching.articles(spark.read.parquet(f"{DATA}/documents.parquet")), path)
    return stored.Index(spark, path)


def test_search_falls_back(spark, index):
    import time

    request = search.SearchRequest(("the",), semantic=True)
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet")
    ids = lambda df: [r["id"] for r in df.orderBy("rank").collect()]
    plain = ids(search.search(index, search.SearchRequest(("the",))))
    assert ids(search.search(index, request, vectors)) != plain
    assert ids(search.search(index, request, vectors.drop("embedding"))) == plain  # fails when it is analysed
    broken = vectors.withColumn("embedding", F.when(F.col("vec_id") >= 0, F.raise_error(F.lit("x"))).cast("array<float>"))
    assert ids(search.search(index, request, broken)) == plain  # fails when it runs
    slow = F.udf(lambda v: time.sleep(60) or v, "array<float>")
    began = time.time()
    assert ids(search.search(index, request, vectors.withColumn("embedding", slow("embedding")), seconds=2.0)) == plain  # hangs
    assert time.time() - began < 30
    near = search.search(index, request, vectors, encode=lambda q: list(vectors.where("vec_id = 7").first()["embedding"]))
    assert 7 not in ids(near) or ids(near)[0] == 7


def loop_bucket(times, rate, burst):
    tokens, last, out = float(burst), None, []
    for t in times:
        tokens = min(burst, tokens + (0 if last is None else (t - last) / 1e6 * rate))
        last = t
        out.append(tokens >= 1)
        tokens -= tokens >= 1
    return out


def test_buckets_equal_the_loop_and_the_stream(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    batch = {r["event_id"]: r["allowed"] for r in limits.buckets(events, "user_id", 0.001, 3).collect()}
    users = {}
    for r in events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).orderBy("ts", "event_id").collect():
        users.setdefault(r["user_id"], []).append((r["us"], r["event_id"]))
    for rows in users.values():
        assert [batch[i] for _, i in rows] == loop_bucket([t for t, _ in rows], 0.001, 3)
    stream = {r["event_id"]: r["allowed"] for r in jobs.run_limiter(spark, f"{DATA}/events.parquet", 0.001, 3).collect()}
    assert stream == batch
    assert limits.buckets(events, "user_id", 0, 3).where("NOT allowed").count() == 0


def test_common_budget_is_not_spent_by_refused_callers(spark):
    rows = [(i, "a", f"2024-01-01 00:00:0{i}") for i in range(5)] + [(9, "b", "2024-01-01 00:00:09")]
    events = spark.createDataFrame(rows, "event_id int, user_id string, at string").select("event_id", "user_id", F.to_timestamp("at").alias("ts"))
    got = {r["event_id"]: r["allowed"] for r in limits.two_level(events, "user_id", (0.06, 2), (0.06, 3)).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: False, 9: True}


PAGE = """<html><head><title>Site | Post</title><meta property="og:title" content="The Post"><meta name="date" content="2024-02-03"></head>
<body><nav>Menu</nav><main><h1>Heading<a class="anchor" href="#x">#</a></h1><p>First <b>paragraph here.<p>Second &amp; last -- para.</p>
<pre>code()</pre><script>var a = "</p>";</script><div hidden>secret</div><time datetime="2020-01-01">x</time></main><footer>Foot</footer></body></html>"""


def test_html():
    root = html.parse(PAGE)
    body = html.main_text(root)
    assert "First paragraph here. Second & last para." in body
    assert not any(x in body for x in ("Menu", "code()", "secret", "Foot", "#", "var a"))
    assert html.summary(root, 4) == "First paragraph here. Second"
    assert html.metadata(root) == ("The Post", "2024-02-03")
    assert not html.no_index(root) and html.no_index(html.parse('<meta name=quillet content="NoIndex">'))
    assert html.metadata(html.parse("<h1>Only</h1><time datetime='2021-05-06'>")) == ("Only", "2021-05-06")
    assert html.main_text(html.parse("<div>" * 5000 + "deep")) == "deep"
    assert html.feeds(html.parse('<link rel="ALTERNATE" type="application/rss+xml" href=" /f "><link rel=alternate type=text/css href=/x>')) == ["/f"]


def test_references_need_their_semicolon():
    root = html.parse("<h1>a &amp b &amp;amp; c&amp</h1><link rel=alternate type=rss href='/f?x=1&reg=2&amp;y=3'>&#65; &#66")
    assert html.metadata(root)[0] == "a &amp b &amp; c&amp" and html.feeds(root) == ["/f?x=1&reg=2&y=3"] and html.main_text(root).endswith("A &#66")


def test_html_table(spark):
    rows = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id int, html string")
    got = {r["page_id"]: r for r in html.extract(rows, "page_id", "html").collect()}
    assert got[1]["title"] == "The Post" and got[2]["n_words"] == 0 and got[3]["main_text"] == ""
    assert html.extract(rows.where("false"), "page_id", "html").count() == 0


def test_item_articles(spark):
    long = " ".join(f"word{i}" for i in range(300))
    rows = [
        ("s 1", "Blog", ["go"], i, t, "/p" + str(i), None, "short", c, ["Rust", "misc"], "2024-01-02", "https://a.org/feed")
        for i, (t, c) in enumerate([("One", "tiny"), ("", "x"), ("Three", long), ("Four", "tiny"), ("Five", "more")])
    ]
    schema = "source_id string, source_name string, tags array<string>, pos int, title string, link string, author string, summary string, content string, categories array<string>, published string, base string"
    pages = [("https://a.org/p0", long, " ".join(["sum"] * 15), False), ("https://a.org/p3", long, "s", True)]
    got = corpus.item_articles(spark.createDataFrame(rows, schema), spark.createDataFrame(pages, "url string, main_text string, summary string, noindex boolean"), 2)
    found = {r["title"]: r for r in got.collect()}
    assert set(found) == {"One", "Three"}
    assert found["One"]["content"] == long and found["One"]["summary"].startswith("sum sum") and found["One"]["author"] == "Blog"
    assert found["One"]["topics"] == ["go", "rust"] and found["One"]["id"].startswith("s-1-")


def test_allowlist(spark):
    good = "- {id: a, name: A, site: 'https://a.org/', tags: [x]}\n- {id: b, site: 'https://b.org/'}\n"
    assert [(r["id"], r["pos"]) for r in src.allowlist(spark, good).collect()] == [("a", 0), ("b", 1)]
    for bad in ("- {id: a}\n", "- {site: x}\n", "- {id: a, site: x}\n- {id: a, site: y}\n"):
        with pytest.raises(ValueError):
            src.allowlist(spark, bad)
    assert src.allowlist(spark, "").count() == 0


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/cursor.txt").write_text("  src9 \n")
    assert src.files(spark, f"file://{tmp_path}/in", contents=False).count() == 1
    assert src.text_value(spark, f"file://{tmp_path}/in/cursor.txt") == "src9"
    rows = spark.createDataFrame([("a", None, ["x"])], "id string, name string, tags array<string>")
    src.write_json(rows, f"file://{tmp_path}/json")
    assert spark.read.text(f"file://{tmp_path}/json").first()["value"] == '{"id":"a","tags":["x"]}'
    src.write_audit(rows.select("id", "name"), f"file://{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").columns == ["id", "name"]


def test_cursor_covers_every_source(spark):
    sources = spark.createDataFrame([(f"s{i}", i) for i in range(7)], "id string, pos int")
    seen, last = set(), None
    for _ in range(4):
        got = discover.circular_slice(sources, discover.resume_position(sources, last), 3).orderBy("turn").collect()
        assert len(got) == 3
        seen |= {r["id"] for r in got}
        last = got[-1]["id"]
    assert len(seen) == 7
    assert discover.circular_slice(sources, 2, 0).count() == discover.circular_slice(sources, 2, 99).count() == 7
    assert discover.resume_position(sources, "s6") == 0 == discover.resume_position(sources, "none")


def test_all_failed_keeps_the_cursor(spark):
    bad = spark.createDataFrame([("a", 0, "x"), ("b", 0, "timeout")], "id string, n int, error string")
    assert not discover.summary(bad).first()["advance"]


def test_history(spark):
    rows = spark.createDataFrame([(1, i, i) for i in range(10)] + [(2, 1, 99)], "owner int, at int, event_id int")
    assert sorted(r["at"] for r in filters.trim_history(rows, "owner", "at", 8, 5).where("owner = 1").collect()) == [5, 6, 7, 8, 9]
    assert filters.trim_history(rows, "owner", "at", 10, 5).count() == 11


def test_streamed_store_equals_the_table(spark, tmp_path):
    for i, rows in enumerate([[(1, "a", "x"), (2, "b", "y")], [(2, "", "z"), (3, "c", "w")]]):
        spark.createDataFrame(rows, "id int, author string, title string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = {r["id"]: (r["author"], r["title"]) for r in jobs.run_discovery(spark, f"file://{tmp_path}/in", lambda b: b).collect()}
    assert set(got) == {1, 2, 3}


def test_windowed_stream_equals_batch(spark, tmp_path):
    path = f"{DATA}/events.parquet"
    batch = {(r["start"], r["event_type"]): r["n"] for r in jobs.windowed_counts(spark.read.parquet(path)).collect()}
    q = jobs.windowed_counts(jobs.stream_of(spark, path)).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["start"], r["event_type"]): r["n"] for r in spark.sql("SELECT * FROM windows").collect()} == batch


def test_cyrb53_and_resolution(spark):
    rows = spark.createDataFrame([("https://a.org/b/", "../c?x=1"), ("https://a.org", "//d.org/e"), (None, "x")], "base string, ref string")
    got = rows.select(urls.resolve(F.col("base"), F.col("ref")).alias("u"), urls.cyrb53(F.col("ref")).alias("k")).collect()
    assert [r["u"] for r in got] == ["https://a.org/c?x=1", "https://d.org/e", None]
    assert all(0 <= r["k"] < 2**53 for r in got) and len({r["k"] for r in got}) == 3
    same = spark.createDataFrame([("http://www.a.org/P/?b=2&a=1&utm_source=z#top",), ("https://a.org/P?a=1&b=2",)], "u string").select(urls.visit_key(F.col("u")).alias("k")).collect()
    assert same[0]["k"] == same[1]["k"]


def test_times(spark):
    got = spark.createDataFrame([("Mon, 2 Jan 2006 15:04:05 -0700",), ("02 Jan 2006 15:04:05 EST",), ("2006-01-02T15:04:05.123Z",), ("nonsense",)], "t string").select(F.date_format(dates.parse_time(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("t")).collect()
    assert [r["t"] for r in got] == ["2006-01-02 22:04:05", "2006-01-02 15:04:05", "2006-01-02 15:04:05", None]


def test_words_split_at_unicode_space(spark):
    got = spark.createDataFrame([("a b c\td",)], "t string").select(text.word_count(F.col("t")).alias("n"), text.truncate_words(F.col("t"), 2).alias("two"), text.truncate_words(F.col("t"), 0).alias("none")).first()
    assert (got["n"], got["two"], got["none"]) == (4, "a b", "")


def test_multi_tenant_roots(spark):
    rows = [("https://medium.com/",), ("https://medium.com/@a/",), ("https://x.org/",), ("https://y.org/",), ("https://y.org/~t/",), ("https://www.note.com/",)]
    got = builder.drop_platform_roots(spark.createDataFrame(rows, "site string")).collect()
    assert {r["site"] for r in got} == {"https://medium.com/@a/", "https://x.org/", "https://y.org/~t/", "https://www.note.com/"}


def test_service(spark, index):
    import json

    from quillet.operators.service import Bucket, Service

    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet")
    limits_ = {"caller": (60, 4), "service": (600, 300), "semantic_caller": (10, 1), "semantic_service": (60, 15), "log": (6, 1)}
    s = Service(index, vectors, limits_, seconds=60.0)
    status, headers, body = s.handle({"q": "the"}, "a", now=0.0)
    got = json.loads(body)
    assert status == 200 and len(got["results"]) == 20 and "max-age" in headers["Cache-Control"] and got["nextOffset"] >= 20 and {"url", "title", "score"} <= set(got["results"][0])
    assert s.handle({"q": ""}, "a", now=0.0)[0] == 400
    semantic = json.loads(s.handle({"q": "the", "mode": "semantic"}, "a", now=0.0)[2])
    again = json.loads(s.handle({"q": "the", "mode": "semantic"}, "a", now=0.0)[2])  # its budget is spent
    assert semantic["results"] != got["results"] and again["results"] == got["results"]
    assert [(x["asked"], x["mode"]) for x in s.log] == [("keyword", "keyword"), ("semantic", "semantic"), ("semantic", "keyword")]
    for _ in range(2):
        status, headers, _ = s.handle({"q": "the"}, "a", now=0.0)
        assert status == 429 and headers["Retry-After"] == "2" and headers["RateLimit-Limit"] == "4"
    assert s.refused == 2 and [x["refusals"] for x in s.log if "refused" in x] == [1]
    assert s.health()[0] == 200
    b = Bucket(1.0, 2)
    assert [b.allow("k", 0.0)[0] for _ in range(3)] == [True, True, False] and b.allow("k", 1.0)[0]
    b.sweep(10_000.0)
    assert not b.state


def test_client_side(spark):
    from quillet.operators import service

    assert service.request_params(" go " + "x" * 600, offset=5000) == {"q": ("go " + "x" * 600)[:512], "offset": "1000"}
    assert service.request_params("go", limit=30, offset=40, mode="semantic") == {"q": "go", "limit": "30", "offset": "20", "mode": "semantic"}
    assert service.has_more(20, 21, 1000) and not service.has_more(20, 20, 1000) and not service.has_more(1001, 2000, 1000)
    pages = {0: (200, [1, 3], 9, 2), 2: (200, [5], 9, 3), 3: (200, [6, 8], 9, 5), 5: (429, [], 9, 5)}
    asked = []
    ask = lambda offset: asked.append(offset) or pages[offset]
    assert service.load_more(ask, 0, lambda x: x % 2 == 0, 1000) == ([1, 3, 5, 6, 8], 5) and asked == [0, 2, 3]
    assert service.load_more(ask, 5, bool, 1000) == ([], 5)
    assert service.load_more(ask, 0, lambda x: False, 1000, pages=2)[1] == 3
    ticks = iter(range(0, 100, 2))
    assert service.load_more(ask, 0, lambda x: False, 1000, clock=lambda: next(ticks))[1] == 3
    rows = spark.createDataFrame([(1, i, b) for i, b in enumerate(['{"url":"https://a.org/1","score":1e999}', '{"url":"https://a.org/1","title":"again"}', "no", '{"url":"https://b.org/","score":-2.5}'])], "k int, n int, body string")
    got = service.sanitised_response(rows, "k", "n", "body").orderBy("n").select("r.url", "r.score").collect()
    assert [tuple(r) for r in got] == [("https://a.org/1", 0.0), ("https://b.org/", -2.5)]
    assert service.bookmark(spark.createDataFrame([("u", "t", "a", "feed", "s", ["x"], None)], "url string, title string, author string, origin string, summary string, topics array<string>, published_at timestamp")).first()["saved_at"] is not None


def test_offset_errors_name_the_window():
    assert "30" in search.parse_request({"q": "a", "mode": "semantic", "limit": "20", "offset": "31"}) and "50" in search.parse_request({"q": "a", "mode": "semantic", "limit": "20", "offset": "31"})
    assert search.parse_request({"q": "a", "offset": "1001"}) == "offset must be from 0 to 1000"


class _Site:
    """A local web server for GETs; answers are by path."""

    def __enter__(self):
        import http.server
        import threading

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_GET(self):
                if self.path.startswith("/to"):
                    self.send_response(302)
                    self.send_header("Location", "/ok" if self.path == "/to" else "/toloop")
                    self.end_headers()
                    return
                self.send_response(200 if self.path in ("/ok", "/big", "/robots.txt") else 404)
                self.send_header("Content-Type", "text/html; charset=utf-8")
                self.end_headers()
                self.wfile.write({"/big": b"x" * 100_000, "/robots.txt": b"User-agent: *\nDisallow: /p"}.get(self.path, b"<html><head><title>caf\xc3\xa9</title></HEAD><body>" + b"y" * 50_000))

            def log_message(self, *args):
                pass

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        return f"http://127.0.0.1:{self.server.server_address[1]}"

    def __exit__(self, *args):
        self.server.shutdown()
        self.server.server_close()


def test_fetching(spark):
    import functools

    from quillet.sources import fetch

    get = functools.partial(fetch.http_get, open_world=True)
    with _Site() as site:
        wanted = spark.createDataFrame([(site + p,) for p in ("/ok", "/ok", "/big", "/to", "/toloop", "/none")] + [("ftp://a.org/",), ("http://127.0.0.1:1/",), (None,)], "url string")
        got = {r["url"]: r for r in fetch.fetch(wanted, limit=70_000, get=get).collect()}
        assert len(got) == 7
        assert got[site + "/ok"]["status"] == 200 and "café" in got[site + "/ok"]["body"] and got[site + "/ok"]["error"] is None
        assert len(got[site + "/big"]["body"]) == 70_000 and got[site + "/to"]["final_url"] == site + "/ok"
        assert got[site + "/none"]["status"] == 404 and got[site + "/none"]["error"] == "http 404" and got[site + "/toloop"]["error"]
        assert "not http" in got["ftp://a.org/"]["error"] and got["http://127.0.0.1:1/"]["status"] is None
        assert "not a public" in fetch.fetch(wanted.where(F.col("url").endswith("/ok"))).first()["error"]
        head = fetch.site_probe(spark.createDataFrame([(site + "/ok",)], "site string"), get=get).first()
        assert head["body"].lower().count("</head") == 1 and len(head["body"]) < 20_000
        robots = fetch.robots_bodies(spark.createDataFrame([(site + "/a",), (site + "/b",), ("http://127.0.0.1:1/c",)], "url string"), get=get).collect()
        assert sorted(r["body"] for r in robots) == ["", "User-agent: *\nDisallow: /p"]
        spark.dataSource.register(fetch.FetchSource)
        rows = spark.read.format("quillet_fetch").option("urls", f"{site}/ok\n{site}/none").option("limit", "10").option("open_world", "true").load().collect()
        assert {r["url"][len(site):]: (r["status"], r["body"]) for r in rows} == {"/ok": (200, "<html><hea"), "/none": (404, None)}


def test_a_slow_host_delays_no_other(spark, tmp_path):
    """A host of three seconds an answer and one that never answers, among quick ones; never more than two requests at once to one."""
    import time

    from quillet.sources import fetch

    log = tmp_path / "log"
    log.mkdir()

    def get(url, limit, until):
        name = url.split("/")[2]
        began = time.time()
        time.sleep({"slow.org": 1.5, "dead.org": 30}.get(name, 0.01))
        (log / f"{name}-{url.rsplit('/', 1)[1]}").write_text(f"{began} {time.time()}")
        return 200, "text/html", "x", url

    listed = [f"https://slow.org/{i}" for i in range(6)] + [f"https://dead.org/{i}" for i in range(4)] + [f"https://a{i % 20}.net/{i}" for i in range(200)]
    rows = spark.createDataFrame([(u,) for u in listed], "url string").coalesce(1)
    began = time.time()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = {r["url"]: r for r in fetch.fetch(rows, get=get, deadline=4.0).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert set(got) == set(listed) and time.time() - began < 40
    assert all("deadline" in got[u]["error"] for u in listed if "dead.org" in u) and all(got[u]["status"] == 200 for u in listed if "dead.org" not in u)
    spans = {}
    for f in log.iterdir():
        spans.setdefault(f.name.rsplit("-", 1)[0], []).append(tuple(map(float, f.read_text().split())))
    for mine in spans.values():
        assert max(sum(a <= t < b for a, b in mine) for t, _ in mine) <= 2
    quick = [b for name, mine in spans.items() if name.endswith(".net") for _, b in mine]
    assert max(quick) < min(b for _, b in spans["slow.org"]) + 3  # all quick answers are in before the slow host is done


def test_registered_names_by_joins_equal_the_rules(spark):
    exact, under, excluded = rules = urls.suffix_rules(spark)

    def one(host):
        labels = host.split(".")
        for i in range(len(labels)):
            name, parent = ".".join(labels[i:]), ".".join(labels[i + 1 :])
            if name in excluded:
                return name
            if name in exact or parent in under:
                return ".".join(labels[i - 1 :]) if i else host
        return ".".join(labels[-2:])

    r = random.Random(6)
    some = [f"{p}{x}" for x in [*r.sample(sorted(exact), 300), *sorted(under), *sorted(excluded), "localhost", "a.nosuchsuffix"] for p in ("", "a.", "b.a.", "c.b.a.")]
    rows = spark.createDataFrame([(h,) for h in [*some, *some[:9], "", None]], "host string")
    got = urls.with_registered_name(rows, F.col("host"), "name", rules)
    assert "Python" not in got._jdf.queryExecution().toString() and got.count() == len(some) + 11
    assert {r["host"]: r["name"] for r in got.collect()} == {h: one(h) for h in some} | {"": "", None: None}


def test_known_feed_of_the_listed_or_the_final_site(spark):
    from quillet.operators import crawl

    sites = ("https://listed.org/", "https://both.org/", "https://moved.org/")
    candidates = spark.createDataFrame([(s, "N", [], ["t"]) for s in sites], "site string, name string, tags array<string>, fallback_tags array<string>")
    probes = spark.createDataFrame([(s, 200, "text/html", s.replace(".org", ".net"), None, None, None) for s in sites], "site string, status_code int, content_type string, final_url string, page_title string, site_name string, error string")
    known = spark.createDataFrame([("listed.org", "f1"), ("both.org", "f2"), ("both.net", "f3"), ("moved.net", "f4")], "key string, feed string")
    feeds = spark.createDataFrame([(s, None, None, [], True) for s in sites], "site string, feed_url string, feed_title string, feed_tags array<string>, inconclusive boolean")
    got = {r["site"]: r["feed"] for r in crawl.check_candidates(candidates, probes, known, feeds).collect()}
    assert got == {"https://listed.net/": "f1", "https://both.net/": "f2", "https://moved.net/": "f4"}


def test_visit_keys_of_one_page(spark):
    same = ["https://a.org/x", "https://a.org:443/x", "http://a.org:80/x", "https://user:pw@www.a.org/x/", "https://a.org/x#top"]
    other = ["https://a.org:8443/x", "http://a.org:443/x", "https://a.org/X"]
    rows = spark.createDataFrame([(u,) for u in same + other], "url string")
    got = {r["url"]: r["k"] for r in rows.select("url", urls.visit_key(F.col("url")).alias("k")).collect()}
    assert len({got[u] for u in same}) == 1 and len(set(got.values())) == 4


def test_polite_partitions(spark):
    from quillet.operators import crawl

    rows = spark.createDataFrame([(f"https://s{i % 5}.blog{i % 3}.co.uk/{i}",) for i in range(60)], "url string")
    placed = crawl.by_domain(rows).withColumn("part", F.spark_partition_id()).groupBy("domain").agg(F.count_distinct("part").alias("parts")).collect()
    assert {r["domain"] for r in placed} == {f"blog{i}.co.uk" for i in range(3)} and all(r["parts"] <= 2 for r in placed)


def test_passes_resume(spark, tmp_path):
    sources = spark.createDataFrame([(f"s{i}", i) for i in range(5)], "id string, pos int")
    empty = spark.createDataFrame([], "id string, url string, title string, source_id string, author string")
    asked, down = [], set()

    def crawl(some):
        ids = [r["id"] for r in some.orderBy("turn").collect()]
        asked.append(ids)
        good = [i for i in ids if i not in down]
        articles = spark.createDataFrame([(f"{i}-{len(asked)}", "u", f"t{len(asked)}", i, "") for i in good] + [("both", "u", f"t{len(asked)}", "x", "Ann" if len(asked) == 1 else "")] * bool(good), empty.schema)
        return articles, spark.createDataFrame([(i, 1 if i in good else 0, None if i in good else "timeout") for i in ids], "id string, n int, error string")

    def again():  # a process that starts anew knows only the folder
        return discover.run_pass(discover.Store(spark, f"file://{tmp_path}/run", empty), sources, 2, crawl)

    assert again().last == "s1" and again().last == "s3"
    down.update({"s4", "s0"})
    failed = again()
    assert not failed.advanced and failed.timed_out == 2 and failed.start == 4
    down.remove("s0")
    assert again().last == "s0" and asked == [["s0", "s1"], ["s2", "s3"], ["s4", "s0"], ["s4", "s0"]]

    def dies(some):
        crawl(some)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        discover.run_pass(discover.Store(spark, f"file://{tmp_path}/run", empty), sources, 2, dies)
    assert again().start == 1
    store = discover.Store(spark, f"file://{tmp_path}/run", empty)
    rows = {r["id"]: (r["title"], r["author"]) for r in store.articles().collect()}
    assert rows["both"] == ("t6", "Ann") and len(rows) == 8
    assert store.compact(2) and store.passes() == [5] and {r["id"]: (r["title"], r["author"]) for r in store.articles().collect()} == rows


def test_a_pass_killed_at_any_step_loses_nothing(spark, tmp_path, monkeypatch):
    """Killed before and after the part is written, before the record is there, and after it."""
    from quillet.sources import storage

    sources = spark.createDataFrame([(f"s{i}", i) for i in range(4)], "id string, pos int")
    empty = spark.createDataFrame([], "id string, url string, title string, source_id string, author string")

    def crawl(some):
        ids = [r["id"] for r in some.collect()]
        return spark.createDataFrame([(f"of {i}", "u", "t", i, "") for i in ids], empty.schema), spark.createDataFrame([(i, 1, None) for i in ids], "id string, n int, error string")

    store = discover.Store(spark, f"file://{tmp_path}/run", empty)
    commit, write = storage.commit, discover.Store.write

    class Killed(BaseException):
        pass

    def at(step):
        def killed(*args):
            if step == "after the record":
                commit(*args)
            elif step == "half a record":
                (tmp_path / "run/records").mkdir(parents=True, exist_ok=True)
                (tmp_path / "run/records/_half").write_text('{"parts"')
            raise Killed

        def no_part(*args):
            raise Killed

        if step == "before the part":
            monkeypatch.setattr(discover.Store, "write", no_part)
        else:
            monkeypatch.setattr(storage, "commit", killed)
        with pytest.raises(Killed):
            discover.run_pass(store, sources, 1, crawl)
        monkeypatch.setattr(storage, "commit", commit)
        monkeypatch.setattr(discover.Store, "write", write)

    held = lambda: (store.cursor(), sorted(r["id"] for r in store.articles().collect()))
    discover.run_pass(store, sources, 1, crawl)
    assert held() == ("s0", ["of s0"])
    for step in ("before the part", "before the record", "half a record"):
        at(step)
        assert held() == ("s0", ["of s0"])
    at("after the record")
    assert held() == ("s1", ["of s0", "of s1"])
    discover.run_pass(store, sources, 1, crawl)
    assert held() == ("s2", ["of s0", "of s1", "of s2"])
    # two passes at once: the second to finish finds the cursor moved and leaves all as it is
    slow = lambda some: (discover.run_pass(store, sources, 1, crawl), crawl(some))[1]
    assert not discover.run_pass(store, sources, 1, slow).advanced
    assert held() == ("s3", ["of s0", "of s1", "of s2", "of s3"])


def test_sitemap_indexes_within_budgets(spark):
    def listed(kind, *locs):
        inner = "".join(f"<{'url' if kind == 'urlset' else 'sitemap'}><loc>{loc}</loc>{f'<lastmod>{day}</lastmod>' if day else ''}</{'url' if kind == 'urlset' else 'sitemap'}>" for loc, day in locs)
        return f"<{kind}>{inner}</{kind}>"

    # b's newest child fails, its next is an index itself, robots rules forbid one; a is a plain map that also names a map
    bodies = {f"https://b.org/c{i}.xml": listed("urlset", *[(f"https://b.org/{i}/{j}", None) for j in range(3)]) for i in range(6)}
    bodies |= {"https://b.org/deep.xml": listed("sitemapindex", ("https://b.org/c5.xml", None)), "https://b.org/broken.xml": None, "https://b.org/page.xml": "<html><body>no map</body></html>"}
    tops = [
        ("a", "https://a.org/sitemap.xml", "<urlset><url><loc>https://a.org/x</loc></url></urlset>"),
        ("b", "https://b.org/sitemap.xml", listed("sitemapindex", ("c0.xml", "2024-01-01"), ("/c1.xml", "2024-01-02"), ("broken.xml", "2024-02-01"), ("deep.xml", "2024-01-09"), ("private.xml", "2024-03-01"), ("c2.xml", None), ("c3.xml", "2024-01-03"), ("page.xml", "2024-01-04"))),
        ("c", "https://c.org/sitemap.xml", listed("sitemapindex", *[(f"https://c.org/none{i}.xml", None) for i in range(40)])),
    ]
    maps = spark.createDataFrame(tops, "source_id string, url string, xml string")
    rules = spark.createDataFrame([("b.org", "/private", False)], "host string, pattern string, allow boolean")
    asked = []

    def fetch(wanted):
        urls_ = [r["url"] for r in wanted.collect()]
        asked.append(urls_)
        return spark.createDataFrame([(u, bodies.get(u)) for u in urls_], "url string, xml string")

    def found(**budgets):
        asked.clear()
        got = {}
        for r in corpus.sitemap_entries(maps, rules, fetch, **budgets).orderBy("source_id", "pos").collect():
            got.setdefault(r["source_id"], []).append(r["loc"])
        return got

    of = lambda *parts: [f"https://b.org/{i}/{j}" for i in parts for j in range(3)]
    assert found() == {"a": ["https://a.org/x"], "b": of(3, 1, 0)}  # deep, c3, c1 and c0 answered: deep counts and is not followed
    assert "https://b.org/private.xml" not in sum(asked, []) and len(asked) <= 4 and len(sum(asked, [])) == len(set(sum(asked, [])))
    assert found(most_maps=2) == {"a": ["https://a.org/x"], "b": of(3)}
    assert found(most_entries=3)["b"] == of(3) and found(most_maps=5, levels=2)["b"] == of(3, 1, 0, 2) and found(most_maps=9, levels=2)["b"] == of(5, 3, 1, 0, 2)  # what an index names stands in its place
    assert set(found(levels=0)) == {"a"} and corpus.sitemap_entries(maps, rules, None).count() == 1


def test_stopped_stream_goes_on(spark, tmp_path):
    schema = "id int, author string, title string"
    spark.createDataFrame([(1, "a", "x")], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    keep = lambda b: b.select("id", F.lit("u").alias("url"), "title", F.lit("s").alias("source_id"), "author")
    run = lambda: {r["id"]: (r["title"], r["author"]) for r in jobs.run_discovery(spark, f"file://{tmp_path}/in", keep, folder=f"file://{tmp_path}/work").collect()}
    assert run() == {1: ("x", "a")}
    spark.createDataFrame([(1, "", "y"), (2, "b", "z")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == {1: ("y", "a"), 2: ("z", "b")} == run()
    store = discover.Store(spark, f"file://{tmp_path}/work/store", spark.createDataFrame([], "id int, url string, title string, source_id string, author string"))
    assert store.compact(2) and store.passes() == [3] and run() == {1: ("y", "a"), 2: ("z", "b")}
    spark.createDataFrame([(3, "c", "w")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == {1: ("y", "a"), 2: ("z", "b"), 3: ("w", "c")} and store.passes() == [3, 4]


def test_bursts_of_a_stream_that_was_stopped(spark, tmp_path):
    """Rows out of order over four files, two before the stream is stopped and two after, against the batch form."""
    import datetime

    r = random.Random(12)
    start = datetime.datetime(2024, 1, 1)
    rows = sorted((start + datetime.timedelta(seconds=r.randint(0, 4000)), r.choice("abc")) for _ in range(400))
    rows = [(i, u, t) for i, (t, u) in enumerate(rows)]
    mixed = [x for i in range(0, 400, 20) for x in r.sample(rows[i : i + 20], 20)]  # within the watermark's reach
    schema = "event_id long, user_id string, ts timestamp"
    batch = spark.createDataFrame(rows, schema)
    for part in range(4):
        spark.createDataFrame(mixed[part * 100 : part * 100 + 100], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if part in (1, 3):
            got = jobs.run_bursts(spark, f"file://{tmp_path}/in", 20, "10 minutes", folder=f"file://{tmp_path}/work")
    limit = max(t for _, _, t in rows) - datetime.timedelta(minutes=10, seconds=20, milliseconds=1)
    want = {x["event_id"] for x in jobs.last_of_bursts(batch, "user_id", "ts", "event_id", "20 SECONDS").where(F.col("ts") < F.lit(limit)).collect()}
    found = [x["event_id"] for x in got.collect()]
    assert len(found) == len(set(found)) and want <= set(found) and all(rows[i][2] <= limit + datetime.timedelta(seconds=2) for i in found) and len(want) > 50


def test_timer_and_idle_buckets(spark, tmp_path):
    schema = "event_id long, user_id string, ts timestamp"
    rows = lambda *x: spark.createDataFrame(x, "event_id long, user_id string, at string").select("event_id", "user_id", F.to_timestamp("at").alias("ts"))
    rows((1, "a", "2024-01-01 00:00:00"), (2, "b", "2024-01-01 00:00:01")).coalesce(1).write.parquet(f"{tmp_path}/in")
    seen = []
    q = jobs.on_timer(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"), lambda batch, n: seen.append(batch.count()), f"file://{tmp_path}/timer", every="1 second")
    q.processAllAvailable()
    q.stop()
    assert sum(seen) == 2
    # buckets that are full again long before the watermark are dropped
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    q = jobs.limited(source, "user_id", 1.0, 2, late="1 second").writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/state").start()
    q.processAllAvailable()
    held = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    for k, day in ((3, "02"), (4, "03"), (5, "04")):
        rows((k, "c", f"2024-01-{day} 00:00:00")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q.processAllAvailable()
    left = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    q.stop()
    assert held == 2 and left == 1


def test_sitemap_crawl_equals_its_parts(spark):
    from quillet.plans import crawling

    maps, rules, stored, pages = crawling._maps(spark, DATA)
    wanted = {r["url"] for r in corpus.sitemap_links_wanted(maps, rules, stored, 1_000_000).collect()}
    whole = {r["url"]: r for r in corpus.page_articles(pages, 2027, min_words=20).collect()}
    got = crawling.sitemap_crawl(spark, DATA).collect()
    assert {r["url"] for r in got} == wanted & set(whole) and got
    assert all(r["topics"] == "tech" and r["title"] == whole[r["url"]]["title"] for r in got)
    newest = corpus.sitemap_links_wanted(maps, rules, stored, 2).groupBy("source_id").count().agg(F.max("count")).first()[0]
    assert newest <= 2


def test_list_files(spark, tmp_path):
    for name, body in {"README.md": "- https://ann.org/", "LICENSE.md": "- https://no.org/", ".github/list.md": "- https://no.org/", "deep/feeds.opml": "<outline xmlUrl='https://bob.net/feed'/>", "pic.png": "x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    files = src.list_files(spark, f"file://{tmp_path}", "https://lists.org/engineering")
    found = builder.merge_candidates(builder.candidate_rows(builder.harvest_files(files))).collect()
    assert {r["site"]: (r["feed"], r["tags"]) for r in found} == {"https://ann.org/": (None, ["software-engineering"]), "https://bob.net/": ("https://bob.net/feed", ["software-engineering"])}
    assert src.list_files(spark, f"file://{tmp_path}", "o", most_files=1).count() == 1


def test_arrival_order_and_origins_last_through_redirects(spark):
    from quillet.operators import build_run

    lines = [("b.md", "https://l1.org/x", 1, "- [Second](https://old.org/)"), ("a.md", "https://l2.org/x", 900, "- [First](https://new.org/)")]
    probes = [("https://old.org/", 200, "text/html", "https://new.org/", None, None, None), ("https://new.org/", 200, "text/html", "https://new.org/", None, None, None)]
    none = lambda schema: spark.createDataFrame([], schema)
    built = build_run.build(
        spark.createDataFrame(lines, "path string, origin string, line_no int, line string"),
        spark.createDataFrame(probes, "site string, status_code int, content_type string, final_url string, page_title string, site_name string, error string"),
        none("key string, feed string"), none("site string, feed_url string, feed_title string, feed_tags array<string>, inconclusive boolean"), none("site string, id string"), none("site string, name string, feed string, tags array<string>"),
    )
    assert [(r["site"], r["name"]) for r in built.entries.collect()] == [("https://new.org/", "First")]
    assert builder.checked_entries(built.entries).count() == 1
    with pytest.raises(ValueError, match="id repeated"):
        builder.checked_entries(built.entries.unionByName(built.entries))


def test_site_of_many_lists_is_checked_once(spark):
    from quillet.operators import build_run

    lines = [(f"{i}.md", f"https://l{i}.org/x", 1, "- [Ann](https://ann.org/)") for i in range(7)]
    probes = [("https://ann.org/", 200, "text/html", "https://ann.org/", None, None, None)] * 7
    none = lambda schema: spark.createDataFrame([], schema)
    built = build_run.build(
        spark.createDataFrame(lines, "path string, origin string, line_no int, line string"),
        spark.createDataFrame(probes, "site string, status_code int, content_type string, final_url string, page_title string, site_name string, error string"),
        none("key string, feed string"), none("site string, feed_url string, feed_title string, feed_tags array<string>, inconclusive boolean"), none("site string, id string"), none("site string, name string, feed string, tags array<string>"),
    )
    assert [(r["site"], r["name"], r["tags"]) for r in built.entries.collect()] == [("https://ann.org/", "Ann", ["tech"])]
    assert [(r["site"], r["reachable"], len(r["origins"].split(" | "))) for r in built.audit.collect()] == [("https://ann.org/", "yes", 7)]


def test_stream_of_a_folder_named_like_a_file(spark, tmp_path):
    from quillet.streaming import jobs

    spark.range(30).repartition(3).write.parquet(f"{tmp_path}/t.parquet")
    got = jobs.run_discovery(spark, f"{tmp_path}/t.parquet", lambda b: b.select("id", *[F.lit("x").alias(c) for c in ("url", "title", "source_id")]))
    assert got.count() == 30


def test_sitemaps_of_pages_that_share_a_url(spark, tmp_path):
    import duckdb

    from quillet.plans import crawling

    p = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(30)
    more = p.where("page_id % 2 = 0").withColumn("page_id", (F.col("page_id") + 1_000_001).cast("long"))
    p.unionByName(more).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("sitemap_crawl_links", "sitemap_index_links"):
        want = sorted(r[0] for r in con.sql(crawling.ORACLES[name]).fetchall())
        assert want and sorted(r["url"] for r in crawling.QUERIES[name](spark, str(tmp_path)).collect()) == want


def test_sitemaps_of_pages_whose_urls_end_like_a_page_number(spark, tmp_path):
    """A fragment of the table's own stays; a table without it, and without shared URLs, keeps its URLs as they are."""
    import duckdb

    from quillet.plans import crawling

    p = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert sorted(r[0] for r in crawling._own_pages(spark, DATA).select("url").collect()) == sorted(r[0] for r in p.select("url").collect())
    p.withColumn("url", F.concat(F.regexp_replace("url", "#.*", ""), F.lit("#page=7"))).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("sitemap_crawl_links", "sitemap_index_links"):
        want = sorted(r[0] for r in con.sql(crawling.ORACLES[name]).fetchall())
        assert want and sorted(r["url"] for r in crawling.QUERIES[name](spark, str(tmp_path)).collect()) == want


def test_sitemap_of_many_links_whole(spark):
    body = "<urlset>" + "<url><loc>https://a.org/x</loc></url>" * 20_003 + "</urlset>"
    rows = spark.createDataFrame([(1, body)], "id int, xml string")
    assert [src.sitemap_links(rows, "id", "xml", most).count() for most in (20_000, None)] == [20_000, 20_003]


def test_feeds_are_joined_without_the_driver(spark):
    from quillet.operators import build_run, crawl

    probes = spark.createDataFrame([("u", 200, "<rss><channel><title>T</title></channel></rss>", None)], "url string, status int, body string, error string")
    found = spark.createDataFrame([("s", "u", False)], "site string, url string, inconclusive boolean")
    got = build_run.scored_feeds(found, crawl.feed_facts(probes), {"rust": ["rust"]})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [url" in plan and "BroadcastHashJoin [url" not in plan


def test_seeds_are_split_once(spark):
    rows = spark.createDataFrame([(["https://x.org/z", "https://x.org/security"],), (["https://z.org/"],), ([None],), ([],)], "seeds array<string>")
    got = rows.select(builder.repository_tags(F.col("seeds")).alias("tags"))
    assert [r["tags"] for r in got.collect()] == [["security"], ["tech"], ["tech"], ["tech"]]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_vocabulary(spark):
    words = builder.load_vocabulary("c: ['C++', 'node.js']\nrust: [Rust]\n")
    assert words == {"c": ["c++", "node.js"], "rust": ["rust"]} and builder.tag_order(words)[:2] == ["c", "rust"] and builder.tag_order(words)[-1] == "tech"
    rows = spark.createDataFrame([(1, "node.js and node.js, nodexjs; rust", ["rust"])], "id int, t string, cats array<string>")
    assert [(r["tag"], r["score"]) for r in builder.tag_scores(rows, words, "t", "id", "cats").collect()] == [("rust", 3)]
    for bad in ("a: []\n", "- {tag: a, keywords: [x]}\n- {tag: a, keywords: [y]}\n"):
        with pytest.raises(ValueError):
            builder.load_vocabulary(bad)


def test_wiring():
    from quillet.operators import wiring

    def broken(settings):
        return wiring.number(settings, "BATCH", 200)

    made = wiring.wire({"BATCH": "many"}, {"search": lambda s: "running", "discovery": broken})
    assert made.parts == {"search": "running"} and "BATCH" in made.problems["discovery"]
    assert wiring.wire({}, {"discovery": broken}).parts == {"discovery": 200}
    with pytest.raises(ValueError):
        wiring.wire({"BATCH": "0"}, {"search": broken})


def test_index_rows_and_feed_bound(spark):
    rows = spark.createDataFrame([("a", None)], "id string, fetched_at timestamp").withColumn("published_at", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    assert corpus.index_rows(rows).first().asDict() == {"id": "a", "published_at": "2024-01-02T03:04:05Z"}
    feeds = spark.createDataFrame([("s", "https://a.org/f", "x" * 50), ("s", "https://a.org/no", "y"), ("s", "https://b.org/", "z")], "source_id string, url string, body string")
    rules = spark.createDataFrame([("a.org", "/no", False)], "host string, pattern string, allow boolean")
    got = {r["url"]: (r["body"], r["disallowed"]) for r in corpus.feed_bodies(feeds, rules, 10).collect()}
    assert got == {"https://a.org/f": ("x" * 10, False), "https://a.org/no": (None, True), "https://b.org/": ("z", False)}


def test_reload_on_change(spark, tmp_path):
    from quillet.sources import storage

    (tmp_path / "list").mkdir()
    (tmp_path / "list/a.yml").write_text("one")
    held = storage.Reloaded(spark, f"file://{tmp_path}/list", lambda p: src.text_value(spark, p + "/a.yml"))
    assert held.get() == held.get() == "one" and held.loads == 1
    (tmp_path / "list/a.yml").write_text("another")
    assert held.get() == "another" and held.loads == 2


def test_overrides_and_yaml(spark):
    from quillet.operators import build_run

    assert build_run.overrides_of(spark, "- {site: 'https://a.org/', name: A}\n").count() == 1
    for bad in ("- {name: A}\n", "- {site: 'https://a.org', colour: red}\n", "- {site: 'https://a.org'}\n- {site: 'http://www.a.org/'}\n"):
        with pytest.raises(ValueError):
            build_run.overrides_of(spark, bad)
    rows = spark.createDataFrame([("b", "beta", "https://b.org/", None, [], ["x"]), ("a", "Älpha", "https://a.org/", "f", ["k"], [])], "id string, name string, site string, feed string, kind array<string>, tags array<string>")
    out = build_run.sources_yaml(rows)
    assert out.index("id: b") < out.index("id: a") and "Älpha" in out and "feed: null" not in out
    assert [r["id"] for r in src.allowlist(spark, out).orderBy("pos").collect()] == ["b", "a"]


def test_stored_index(spark, index):
    got = index.matches(("the", "of"))
    assert "EqualTo(term" in got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
    rows = searching.articles(spark.read.parquet(f"{DATA}/documents.parquet"))
    want = {r["id"]: (r["score"], r["source_id"], r["origin"]) for r in search.matches(rows, ("the", "of")).collect()}
    found = {r["id"]: (r["score"], r["source_id"], r["origin"]) for r in got.collect()}
    assert set(found) == set(want) and all(abs(found[k][0] - want[k][0]) < 2e-6 and found[k][1:] == want[k][1:] for k in want)


def test_chunks_of_every_source_equal_ntile(spark):
    from pyspark.sql import Window as W

    r = random.Random(8)
    rows = [(i * r.randint(1, 9), r.choice(["hot"] * 9 + ["a", "b", None])) for i in range(600)] + [(-7, "one"), (3, "few"), (2, "few"), (9, "few")]
    rows = list({x[0]: x for x in rows}.values())
    df = spark.createDataFrame(rows, "doc_id long, source string")
    tile = F.ntile(8).over(W.partitionBy("source").orderBy("doc_id")).cast("long")
    want = sorted(map(str, df.select("source", "doc_id", tile).collect()))
    for block in (20, 50_000):
        got = corpus.ntiles(df, "source", "doc_id", 8, block).select("source", "doc_id", F.col("tile").alias(df.select("source", "doc_id", tile).columns[2]))
        assert sorted(map(str, got.collect())) == want
    every = corpus.ntiles(spark.read.parquet(f"{DATA}/documents.parquet"), "source", "doc_id", 8)
    assert every.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()


def whole_bucket(times, rate, burst):
    """One bucket request by request, in units."""
    gain, token, full = limits.units(rate, burst)
    tokens, last, out = full, None, []
    for t in times:
        tokens = min(full, tokens + (0 if last is None else (t - last) * gain))
        last = t
        out.append(tokens >= token)
        tokens -= token * (tokens >= token)
    return out


@pytest.mark.parametrize("rate,burst", [(0.5, 3), (2.0, 20), (0.01, 1), (7.3, 4.5)])
def test_carried_tokens_equal_the_loop(rate, burst):
    r = random.Random(burst)
    gain, token, full = limits.units(rate, burst)
    for _ in range(30):
        gaps = [r.choice([0, 1, r.randint(0, 10**5), r.randint(0, 3 * 10**6), 10**8 * (r.random() < 0.02)]) for _ in range(60)]
        f = limits.Carried(token, full)
        for g in gaps:
            f.request(int(g) * gain)
        assert len(f.at) <= len(gaps)
        for entry in {0, full, token, token - 1, *(r.randint(0, full) for _ in range(20))}:
            tokens = entry
            for g in gaps:
                tokens = min(full, tokens + int(g) * gain)
                tokens -= token * (tokens >= token)
            i = max(i for i, a in enumerate(f.at) if a <= entry)
            assert tokens == f.value[i] + f.grows[i] * (entry - f.at[i])


def test_one_hot_key_is_judged_in_many_tasks(spark):
    """A million requests of one key, in bursts, floods and pauses, beside some small keys."""
    n = 1_000_000
    step = F.when(F.col("id") % 1000 < 900, F.pmod(F.xxhash64("id"), F.lit(9000))).when(F.col("id") % 50_000 == 950, 40_000_000).otherwise(F.pmod(F.xxhash64("id"), F.lit(300_000)))
    from pyspark.sql import Window as W

    times = [r["us"] for r in spark.range(n).select("id", step.alias("s")).select(F.sum("s").over(W.orderBy("id")).alias("us")).collect()]
    import pandas as pd

    hot = spark.createDataFrame(pd.DataFrame({"event_id": range(n), "user_id": "hot", "us": times}))
    small = spark.range(300).select((F.col("id") + n).alias("event_id"), F.concat(F.lit("u"), (F.col("id") % 7).cast("string")).alias("user_id"), (F.col("id") * 100_000).alias("us"))
    rows = hot.unionByName(small).select("event_id", "user_id", F.timestamp_micros("us").alias("ts"))
    got = limits.buckets(rows, "user_id", 20.0, 30, number=True).select("event_id", "user_id", "allowed", "nth").toPandas()
    assert len(got) == n + 300
    mine = got[got.user_id == "hot"].sort_values("event_id")
    assert mine.allowed.tolist() == whole_bucket(times, 20.0, 30) and mine.nth.tolist() == list(range(1, n + 1)) and 0 < mine.allowed.sum() < n
    for u in range(7):
        mine = got[got.user_id == f"u{u}"].sort_values("event_id")
        assert mine.allowed.tolist() == whole_bucket([i * 100_000 for i in range(u, 300, 7)], 20.0, 30)
    parts = rows.repartitionByRange("user_id", "ts", "event_id").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in parts) < 0.6 * n


def test_tag_scores_equal_patterns_at_500_tags(spark):
    import re

    r = random.Random(9)
    words = [f"{a}{b}" for a in ("ka", "lo", "mé", "ßu", "x_") for b in ("ra", "ti", "no", "ve", "1", "中")]
    vocabulary = {f"t{i}": list(dict.fromkeys(" ".join(r.choices(words, k=r.choice([1, 1, 2, 3]))) for _ in range(3))) for i in range(500)}
    vocabulary |= {"marks": ["c++", "ka-ra", ".lo"], "twice": ["kara loti", "loti nove", "nove"]}
    texts = ["".join(r.choice(words) + r.choice([" ", " ", " ", "  ", ", ", "-", "\n"]) for _ in range(r.randint(0, 60))) for _ in range(40)] + ["", None, "... c++x KARA LOTI NOVE!", "Ka-Ra"]
    rows = spark.createDataFrame([(i, t, ["Twice", "T1"] if i % 5 == 0 else [words[0]]) for i, t in enumerate(texts)], "id int, text string, cats array<string>")
    want = {}
    for i, t in enumerate(texts):
        scores = []
        for at, (tag, ws) in enumerate(vocabulary.items()):
            n = len(set(re.findall(r"\b(" + "|".join(map(re.escape, ws)) + r")\b", (t or "").lower())))
            kebab = {"twice", "t1"} if i % 5 == 0 else {re.sub("[^a-z0-9]+", "-", words[0])}
            n += 2 * bool(kebab & {tag, *(w.replace(" ", "-") for w in ws)})
            if n >= 2:
                scores.append((-n, at, tag))
        want[i] = {(tag, -n) for n, _, tag in sorted(scores)[:6]}
    got = {i: set() for i in want}
    for x in builder.tag_scores(rows, vocabulary, "text", "id", "cats").collect():
        got[x["id"]].add((x["tag"], x["score"]))
    assert got == want and any(len(x) == 6 for x in want.values())


def test_numbers_of_a_hot_key_over_ranges(spark):
    from pyspark.sql import Window as W

    from quillet.sources import storage

    r = random.Random(3)
    rows = spark.createDataFrame([(r.choice(["hot"] * 8 + ["a", None]), r.randint(0, 10**6) * 3000 + i) for i in range(3000)], "base string, at long").repartition(5)
    want = sorted(map(str, rows.select("base", "at", F.row_number().over(W.partitionBy("base").orderBy("at")).alias("n")).collect()))
    assert sorted(map(str, storage.numbered(rows, ["base"], ["at"], "n").collect())) == want
    assert [x["n"] for x in storage.numbered(rows, [], ["at"], "n").orderBy("at").collect()] == list(range(1, 3001))
    assert storage.numbered(rows.where("false"), ["base"], ["at"], "n").count() == 0


@pytest.mark.parametrize("rate,burst", [(0.01, 20), (2.0, 20), (7.3, 4.5), (0.01, 1)])
def test_stretches_of_requests_equal_single_ones(rate, burst):
    r = random.Random(burst)
    gain, token, full = limits.units(rate, burst)
    for load in (0.02, 0.3, 0.9, 1.0, 1.1, 3):
        gains = [min(full, r.choice([0, 1, r.randint(0, int(2 * token / gain * load)), 10**8 * (r.random() < 0.02)]) * gain) for _ in range(300)]
        one, many = limits.Carried(token, full), limits.Carried(token, full)
        for g in gains:
            one.request(g)
        for i in range(0, 300, 70):
            many.requests(np.array(gains[i : i + 70], np.int64))
        at = lambda f, t: f.value[i := np.searchsorted(f.at, t, "right") - 1] + f.grows[i] * (t - f.at[i])
        assert all(at(one, t) == at(many, t) for t in {0, full, *one.at.tolist(), *(x - 1 for x in one.at.tolist() if x), *(r.randint(0, full) for _ in range(50))})


def test_a_flood_is_not_folded_a_request_at_a_time(monkeypatch):
    gain, token, full = limits.units(0.01, 20)
    calls, single = [], limits.Carried.request
    monkeypatch.setattr(limits.Carried, "request", lambda self, g: calls.append(g) or single(self, g))
    limits.Carried(token, full).requests(np.full(100_000, 400_000 * gain, np.int64))
    assert len(calls) < 1000


def test_a_key_of_a_burst_stream_has_one_timer():
    """One call of the state store a batch of rows, and one timer, however many rows a key has."""
    import pandas as pd

    told = []

    class Rows:
        appendList = staticmethod(lambda rows: told.append(("rows", len(rows))))  # noqa: N815

    class Handle:
        timers: list[int] = []
        listTimers = staticmethod(lambda: iter(Handle.timers))  # noqa: N815
        registerTimer = staticmethod(lambda at: Handle.timers.append(at))  # noqa: N815
        deleteTimer = staticmethod(lambda at: Handle.timers.remove(at))  # noqa: N815

    held = jobs.Bursts("user_id", 10_000_000)
    held.handle, held.rows = Handle, Rows
    frame = lambda *seconds: pd.DataFrame({"ts": pd.to_datetime(seconds, unit="s"), "event_id": range(len(seconds))})
    for seconds, due in (((50, 40, 60), 50_001), ((70, 80), 50_001), ((30, 90), 40_001)):
        list(held.handleInputRows(("a",), iter([frame(*seconds)]), None))
        assert Handle.timers == [due]
    assert told == [("rows", 3), ("rows", 2), ("rows", 2)]
