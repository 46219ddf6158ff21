"""Bounded, polite and guarded GET of web pages, as a function over tables and as a data source."""

from __future__ import annotations

import asyncio
import http.client
import itertools
import re
import socket
import time
import urllib.parse
import urllib.request
from collections import defaultdict
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillet.functions import urls
from quillet.functions.addresses import is_public

RESPONSE = "url string, status int, content_type string, body string, final_url string, error string"
AGENT = "quillet-crawler/1.0"
#: Redirects followed, seconds, bytes of a feed, a sitemap and a page's head, requests at once to one registered name.
MAX_REDIRECTS, TIMEOUT = 5, 10.0
FEED_BYTES, SITEMAP_BYTES, HEAD_BYTES = 4_000_000, 8_000_000, 150_000
PER_DOMAIN = 2
#: Requests of a task under way, and those that wait for their turn with them; seconds that a request may take as a whole.
AT_ONCE, WAITING, DEADLINE = 32, 256, 30.0
MAX_ERROR = 200


def _opener(open_world: bool) -> urllib.request.OpenerDirector:
    """HTTP and HTTPS only; the address that is connected to, and no other lookup of the name, is checked."""

    def connect(self):
        found = socket.getaddrinfo(self.host, self.port, type=socket.SOCK_STREAM)
        address = found[0][4][0]
        if not open_world and not all(is_public(x[4][0]) for x in found):
            raise OSError(f"{self.host} is not a public address")
        self.sock = socket.create_connection((address, self.port), self.timeout)

    plain = type("Plain", (http.client.HTTPConnection,), {"connect": connect})

    def connect_tls(self):
        connect(self)
        self.sock = self._context.wrap_socket(self.sock, server_hostname=self.host)

    tls = type("Tls", (http.client.HTTPSConnection,), {"connect": connect_tls})
    handlers = (
        type("Http", (urllib.request.HTTPHandler,), {"http_open": lambda self, r: self.do_open(plain, r)}),
        type("Https", (urllib.request.HTTPSHandler,), {"https_open": lambda self, r: self.do_open(tls, r)}),
        type("Redirects", (urllib.request.HTTPRedirectHandler,), {"max_redirections": MAX_REDIRECTS}),
        urllib.request.HTTPErrorProcessor,
        urllib.request.HTTPDefaultErrorHandler,
    )
    opener = urllib.request.OpenerDirector()
    for handler in handlers:
        opener.add_handler(handler())
    return opener


def http_get(url: str, limit: int, until: str | None = None, timeout: float = TIMEOUT, open_world: bool = False) -> tuple[int, str, str, str]:
    """Status, content type, at most `limit` bytes of the body (up to `until`, if that comes first) and the final URL.

    A status of 300 or more is an HTTPError; open_world lets private addresses pass, for tests.
    """
    if urllib.parse.urlsplit(url).scheme.lower() not in ("http", "https"):
        raise ValueError(f"{url} is not http")
    request = urllib.request.Request(url, headers={"User-Agent": AGENT})
    with _opener(open_world).open(request, timeout=timeout) as answer:
        body, ends = b"", time.monotonic() + DEADLINE
        while len(body) < limit and (part := answer.read(min(16_384, limit - len(body)))):
            body += part
            if time.monotonic() > ends:
                raise TimeoutError(f"deadline of {DEADLINE:g} seconds exceeded")
            if until and until.encode() in body.lower():
                break
        kind = answer.headers.get("Content-Type", "")
        charset = re.search(r"charset=([\w-]+)", kind)
        try:
            text = body.decode(charset[1] if charset else "utf-8", "replace")
        except LookupError:
            text = body.decode("utf-8", "replace")
        return answer.status, kind, text, answer.geturl()


def settled(get: Callable, url: str, *args) -> tuple[int | None, str | None, str | None, str | None, str | None]:
    """What a GET came to: status, type, body, final URL and error; whatever it raises is an error of that URL alone."""
    try:
        return *get(url, *args), None
    except urllib.error.HTTPError as e:
        return e.code, None, None, url, f"http {e.code}"
    except Exception as e:
        return None, None, None, None, (str(e) or type(e).__name__)[:MAX_ERROR]


def fetch(wanted: DataFrame, url_col: str = "url", limit: int = FEED_BYTES, until: str | None = None, get: Callable = http_get, per_domain: int = PER_DOMAIN, deadline: float = DEADLINE) -> DataFrame:
    """RESPONSE of each different URL.

    A registered name's URLs lie in one task, mixed with others'. The task's event loop has at most AT_ONCE requests under
    way, of one name at most per_domain: a slow host keeps only its own requests waiting. A request that is not done by the
    deadline is an error, and its name's place is free once its connection is closed. A task that is stopped begins no more.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        loop, pool = asyncio.new_event_loop(), ThreadPoolExecutor(AT_ONCE)
        gates: dict[str, asyncio.Semaphore] = defaultdict(lambda: asyncio.Semaphore(per_domain))

        async def one(url: str, domain: str):
            gate = gates[domain]
            await gate.acquire()
            asked = loop.run_in_executor(pool, settled, get, url, limit, until)
            asked.add_done_callback(lambda _: gate.release())
            try:
                return url, *await asyncio.wait_for(asyncio.shield(asked), deadline)
            except TimeoutError:
                return url, None, None, None, None, f"deadline of {deadline:g} seconds exceeded"

        rows = ((u, d) for batch in batches for u, d in zip(*(c.to_pylist() for c in batch.columns)))
        pending: set = set()
        try:
            while True:
                pending |= {loop.create_task(one(u, d or "")) for u, d in itertools.islice(rows, WAITING - len(pending))}
                if not pending:
                    return
                done, pending = loop.run_until_complete(asyncio.wait(pending, return_when=asyncio.FIRST_COMPLETED))
                kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
                found = [pa.array(c, t) for c, t in zip(zip(*(t.result() for t in done)), kinds)]
                yield pa.RecordBatch.from_arrays(found, names=["url", "status", "content_type", "body", "final_url", "error"])
        finally:
            for task in pending:
                task.cancel()
            pool.shutdown(wait=False, cancel_futures=True)

    rows = wanted.select(F.col(url_col).alias("url")).where("url IS NOT NULL").distinct()
    dealt = urls.with_registered_name(rows, urls.host(F.col("url")), "domain").repartition("domain").sortWithinPartitions(F.xxhash64("url"))
    return dealt.select("url", "domain").mapInArrow(run, RESPONSE)


def site_probe(sites: DataFrame, url_col: str = "site", get: Callable = http_get) -> DataFrame:
    """RESPONSE of home pages up to the end of their heads."""
    return fetch(sites, url_col, HEAD_BYTES, "</head", get)


def robots_bodies(wanted: DataFrame, url_col: str = "url", get: Callable = http_get) -> DataFrame:
    """host and robots text, one GET for each scheme and host; where that fails the text is empty, which allows all."""
    root = F.concat(urls.scheme(F.col(url_col)), F.lit("://"), urls.netloc(F.col(url_col)), F.lit("/robots.txt"))
    found = fetch(wanted.where(urls.is_http(F.col(url_col))).select(root.alias("url")), get=get)
    return found.select(urls.host(F.col("url")).alias("host"), F.coalesce("body", F.lit("")).alias("body"))


def sitemap_bodies(wanted: DataFrame, url_col: str = "url", get: Callable = http_get) -> DataFrame:
    """RESPONSE of sitemaps, which may be larger than feeds."""
    return fetch(wanted, url_col, SITEMAP_BYTES, get=get)


class FetchSource(DataSource):
    """spark.read.format("quillet_fetch").option("urls", "one a line").option("limit", bytes).load()"""

    @classmethod
    def name(cls) -> str:
        return "quillet_fetch"

    def schema(self) -> str:
        return RESPONSE

    def reader(self, schema) -> DataSourceReader:
        return FetchReader(dict(self.options))


class FetchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = list(dict.fromkeys(u for u in options.get("urls", "").split() if u))
        self.limit, self.open_world = int(options.get("limit", FEED_BYTES)), options.get("open_world", "") == "true"

    def partitions(self) -> list[InputPartition]:
        """The URLs of one host are one partition, read in turn."""
        by_host: dict[str, list[str]] = {}
        for url in self.urls:
            by_host.setdefault(urllib.parse.urlsplit(url).hostname or "", []).append(url)
        return [InputPartition(x) for x in by_host.values()] or [InputPartition([])]

    def read(self, partition: InputPartition):
        for url in partition.value:
            yield (url, *settled(lambda u: http_get(u, self.limit, open_world=self.open_world), url))
