"""The request pipeline around a search, and the shapes of its answers."""

from __future__ import annotations

import json
import math
import time
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillet.functions import fixed, text
from quillet.operators import search


@dataclass
class Bucket:
    """Token buckets by key for one process; idle keys are dropped when asked."""

    per_second: float
    burst: float
    state: dict = field(default_factory=dict)

    def allow(self, key: str, now: float) -> tuple[bool, float]:
        if self.per_second <= 0 or self.burst <= 0:
            return True, 0.0
        tokens, last = self.state.get(key, (float(self.burst), now))
        tokens = min(self.burst, tokens + (now - last) * self.per_second)
        ok = tokens >= 1
        self.state[key] = (tokens - ok, now)
        return ok, 0.0 if ok else (1 - tokens) / self.per_second

    def sweep(self, now: float) -> None:
        idle = self.burst / self.per_second + 600 if self.per_second > 0 else 0
        self.state = {k: v for k, v in self.state.items() if now - v[1] <= idle}


def per_minute(rate: float, burst: float) -> Bucket:
    return Bucket(rate / 60, burst)


#: Fixed value: results that an answer holds at most.
MAX_RESULTS = 50


class Service:
    """Caller limit, service limit, validation, rerank budget or downgrade, search, one log line.

    index answers the requests; vectors and encode (a query's text to its vector) serve semantic ones.
    """

    def __init__(self, index: search.Index, vectors: DataFrame | None = None, limits=None, encode=None, seconds: float = search.RERANK_SECONDS):
        self.index, self.vectors, self.encode, self.seconds, self.log = index, vectors, encode, seconds, []
        lim = limits or fixed.LIMITS
        self.caller, self.all = per_minute(*lim["caller"]), per_minute(*lim["service"])
        self.semantic, self.semantic_all = per_minute(*lim["semantic_caller"]), per_minute(*lim["semantic_service"])
        self.refusals, self.refused = per_minute(*lim["log"]), 0

    def ready(self) -> bool:
        try:
            self.index.documents.limit(1).count()
            return True
        except Exception:
            return False

    def health(self) -> tuple[int, dict, str]:
        ok = self.ready()
        return (200 if ok else 503), {"Cache-Control": "no-store"}, json.dumps({"status": "ok" if ok else "unavailable"})

    def _refuse(self, scope: str, caller: str, bucket: Bucket, wait: float, now: float) -> tuple[int, dict, str]:
        """429 with the wait; refusals are counted always and logged within their own budget."""
        self.refused += 1
        if self.refusals.allow("", now)[0]:
            self.log.append({"refused": scope, "caller": caller, "wait": round(wait, 3), "refusals": self.refused})
        seconds = str(math.floor(wait) + 1)
        headers = {"Retry-After": seconds, "RateLimit-Limit": str(int(bucket.burst)), "RateLimit-Remaining": "0", "RateLimit-Reset": seconds}
        return 429, headers, json.dumps({"error": "too many requests"})

    def handle(self, params: dict[str, str], caller: str, now: float | None = None) -> tuple[int, dict, str]:
        """Status, headers and JSON body. Limits come before validation; only valid requests spend rerank budget."""
        now = time.time() if now is None else now
        for scope, bucket, key in (("caller", self.caller, caller), ("service", self.all, "")):
            ok, wait = bucket.allow(key, now)
            if not ok:
                return self._refuse(scope, caller, bucket, wait, now)
        request = search.parse_request(params)
        if isinstance(request, str):
            return 400, {}, json.dumps({"error": request})
        asked = "semantic" if request.semantic else "keyword"
        if request.semantic and not (self.semantic.allow(caller, now)[0] and self.semantic_all.allow("", now)[0]):
            request = replace(request, semantic=False)
        total = self.index.found(request).count()
        found, ranked = search.ranked_window(self.index, request, self.vectors, self.encode, self.seconds)
        fetch = search.fetch_size(request.semantic, request.limit, request.offset)
        window = self.index.shown(search.top(found, fetch, request.offset))
        # at most offset + fetch rows, both bounded by validation, so the page is cut here
        rows = [json.loads(x[0]) for x in window.orderBy("rank").select(F.to_json(F.struct("rank", "id", "url", "title", "author", "origin", "summary", "topics", "published_at", "source_id", "score"))).collect()]
        kept, read = search.loop_page([(r["rank"], r["url"], r.get("source_id")) for r in rows], request.limit)
        ends = len(rows) < fetch and read == len(rows)
        nxt = max(request.offset + read, total) if ends else request.offset + read
        shown = [{k: v for k, v in r.items() if k not in ("rank", "source_id")} for r in rows if r["rank"] in set(kept)]
        self.log.append({"query": logged(params["q"]), "caller": caller, "mode": "semantic" if ranked else "keyword", "asked": asked, "results": len(shown), "total": total})
        return 200, {"Cache-Control": "public, max-age=60"}, json.dumps({"results": shown, "total": total, "nextOffset": nxt})


def logged(query: str) -> str:
    """A query as it may stand in a log: control characters are blanks, and only its start is kept."""
    flat = "".join(" " if ord(c) < 32 or 127 <= ord(c) < 160 else c for c in query)
    return flat[:128] + "…" if len(flat) > 128 else flat


def retry_after(wait: Column) -> Column:
    """Whole seconds after which a refused request may come again."""
    return (F.floor(wait) + 1).cast("int")


def answer(rows: DataFrame, key: str, body: Column) -> DataFrame:
    """key and the JSON of each row."""
    return rows.select(key, F.to_json(body).alias("body"))


def response_bounds(offset: Column, rows: Column, total: Column, next_offset: Column, size: Column) -> tuple[Column, Column]:
    """Total and next offset of an untrusted answer, raised to what its own rows prove."""
    return F.greatest(total, offset + rows), F.greatest(next_offset, offset + size)


def sanitised_response(rows: DataFrame, key: str, order: str, body: str, most: int = MAX_RESULTS) -> DataFrame:
    """key, order and the struct r of each answer's good results: the first of each URL, `most` at the most."""
    good = rows.select(key, order, sanitised(F.col(body)).alias("r")).where("r IS NOT NULL")
    first = good.withColumn("__un", F.row_number().over(W.partitionBy(key, "r.url").orderBy(order))).where("__un = 1").drop("__un")
    return first.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(order))).where(F.col("__n") <= most).drop("__n")


# The client's side.


def request_params(query: str, limit: int = fixed.DEFAULT_LIMIT, offset: int = 0, origin: str = "", mode: str = "keyword") -> dict[str, str]:
    """What a client sends: the query clamped, the offset within its bound, and only what differs from the defaults."""
    limit = min(max(limit, 1), fixed.MAX_LIMIT)
    offset = min(max(offset, 0), search.max_offset(mode == "semantic", limit))
    given = {"q": query.strip()[: fixed.MAX_QUERY_CHARS], "limit": limit, "offset": offset, "origin": origin, "mode": mode}
    default = {"limit": fixed.DEFAULT_LIMIT, "offset": 0, "origin": "", "mode": "keyword"}
    return {k: str(v) for k, v in given.items() if k not in default or v != default[k]}


def has_more(next_offset: int, total: int, bound: int) -> bool:
    return next_offset < total and next_offset <= bound


def load_more(ask, offset: int, visible, bound: int, pages: int = 20, seconds: float = 3.0, clock=time.monotonic) -> tuple[list, int]:
    """Pages from offset on until one holds a visible row: its rows and the next offset.

    ask(offset) gives (status, results, total, next offset). At most so many pages and seconds; a refusal ends it silently.
    """
    began, rows = clock(), []
    for _ in range(pages):
        status, results, total, nxt = ask(offset)
        if status == 429:
            break
        rows += results
        offset = nxt
        if any(map(visible, results)) or not has_more(nxt, total, bound) or clock() - began > seconds:
            break
    return rows, offset


def bookmark(rows: DataFrame, saved_at: Column | None = None) -> DataFrame:
    """Results as bookmarks: what a bookmark keeps, and when it was saved."""
    return rows.select("url", "title", "author", "origin", "summary", "topics", "published_at", (saved_at if saved_at is not None else F.current_timestamp()).alias("saved_at"))


def caller_key(forwarded: Column, remote: Column) -> Column:
    """The last forwarded hop, or the peer, without its port."""
    hop = F.nullif(F.trim(F.element_at(F.split(F.coalesce(forwarded, F.lit("")), ","), -1)), F.lit(""))
    return F.regexp_replace(F.coalesce(hop, remote), r"^\[([^\]]*)\](:[0-9]+)?$|^([^:]*):[0-9]+$", "$1$3")


def setting(c: Column, default: int) -> Column:
    """A positive whole number, or the default."""
    n = F.trim(c).try_cast("int")
    return F.when(n > 0, n).otherwise(default)


RESULT = "struct<url:string,title:string,author:string,summary:string,topics:array<string>,origin:string,score:double>"


def sanitised(body: Column) -> Column:
    """An untrusted result: cut fields, distinct topics, known origins, finite scores; null without an http URL."""
    r = F.from_json(body, RESULT)
    topics = F.slice(F.array_distinct(F.filter(F.transform(F.coalesce(r["topics"], F.array().cast("array<string>")), lambda t: F.left(F.trim(t), F.lit(64))), lambda t: t != "")), 1, 12)
    return F.when(
        r["url"].rlike("^https?://[^/]+"),
        F.struct(
            r["url"].alias("url"), F.coalesce(text.trimmed_text(r["title"], 300), r["url"]).alias("title"), text.trimmed_text(r["author"], 120).alias("author"),
            text.trimmed_text(r["summary"], 2000).alias("summary"), topics.alias("topics"), F.when(r["origin"].isin("feed", "sitemap"), r["origin"]).alias("origin"),
            F.when(F.abs(r["score"]) < float("inf"), r["score"]).otherwise(0.0).alias("score"),
        ),
    )
