"""Conjunctive full-text search: matching, field-weighted relevance, capped pages, rerank.

The relevance is BM25 per field times the field's weight. Requests are answered from a stored index (operators.index).
Only windows of at most offset + fetch rows, both bounded by request validation, are ranked in one task and looked up in
the table of documents.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillet.functions import fixed, text
from quillet.operators.index import K1, B, Index


@dataclass(frozen=True)
class SearchRequest:
    terms: tuple[str, ...]
    limit: int = fixed.DEFAULT_LIMIT
    offset: int = 0
    origin: str = ""
    semantic: bool = False


def max_offset(semantic: bool, limit: int) -> int:
    return max(fixed.SEMANTIC_WINDOW - limit, 0) if semantic else fixed.MAX_OFFSET_KEYWORD


def fetch_size(semantic: bool, limit: int, offset: int) -> int:
    wanted = limit * fixed.OVERFETCH
    return min(wanted, max(fixed.SEMANTIC_WINDOW - offset, 0)) if semantic else wanted


def offset_error(semantic: bool, limit: int, bound: int) -> str:
    """What is wrong with an offset; a semantic request is told its limit and the window that both must fit."""
    said = f"offset must be from 0 to {bound}"
    return f"{said} with limit {limit}, as semantic results come from a window of {fixed.SEMANTIC_WINDOW}" if semantic else said


def parse_request(params: dict[str, str]) -> SearchRequest | str:
    """A request, or what is wrong with it. The offset's bound needs mode and limit, so it comes last."""
    q = params.get("q", "").strip()
    if not q:
        return "q is required"
    if len(q) > fixed.MAX_QUERY_CHARS:
        return f"q must be at most {fixed.MAX_QUERY_CHARS} characters"

    def number(name, default, low, high):
        raw = params.get(name, "")
        if raw == "":
            return default
        whole = re.fullmatch("[+-]?0*([0-9]{1,18})", raw, re.ASCII)
        return int(raw) if whole and low <= int(raw) <= high else None

    limit = number("limit", fixed.DEFAULT_LIMIT, 1, fixed.MAX_LIMIT)
    if limit is None:
        return f"limit must be from 1 to {fixed.MAX_LIMIT}"
    mode = params.get("mode", "") or "keyword"
    if mode not in ("keyword", "semantic"):
        return "mode must be keyword or semantic"
    origin = params.get("origin", "")
    if origin not in ("", "feed", "sitemap"):
        return "origin must be feed or sitemap"
    bound = max_offset(mode == "semantic", limit)
    offset = number("offset", 0, 0, bound)
    if offset is None:
        return offset_error(mode == "semantic", limit, bound)
    terms = tuple(dict.fromkeys(t for t in "".join(c if c.isalnum() else " " for c in q.lower()).split()))
    return SearchRequest(terms, limit, offset, origin, mode == "semantic")


def field_tokens(rows: DataFrame) -> DataFrame:
    """One row for each document and searchable field: its tokens and its weight."""
    fields = F.array(*[
        F.struct(F.lit(name).alias("field"), F.lit(weight).alias("weight"), text.search_terms(F.coalesce(F.col(name), F.lit(""))).alias("tokens"))
        for name, weight in fixed.FIELD_WEIGHTS.items()
    ])
    return rows.select("id", "url", "source_id", "origin", F.inline(fields))


def postings(rows: DataFrame) -> DataFrame:
    """The inverted index: term, field, id and term frequency; partially aggregated before the shuffle."""
    return field_tokens(rows).select("id", "field", F.explode("tokens").alias("term")).groupBy("term", "field", "id").agg(F.count(F.lit(1)).alias("tf"))


def matches(rows: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """Documents that hold every term in some field, with their relevance (six places)."""
    wanted = F.array(*[F.lit(t) for t in terms])
    # two bounded arrays for each field row: frequencies of the terms, and the length
    counted = field_tokens(rows).select(
        "id", "url", "source_id", "origin", "field", "weight", F.size("tokens").alias("len"),
        F.transform(wanted, lambda t: F.size(F.filter(F.col("tokens"), lambda x: x == t))).alias("tf"),
    )
    stats = counted.groupBy("field").agg(
        F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"),
        F.array(*[F.sum((F.get("tf", F.lit(i)) > 0).cast("int")) for i in range(len(terms))]).alias("df"),
    )
    one = counted.where(F.exists("tf", lambda x: x > 0)).join(F.broadcast(stats), "field")  # stats: a row a field, five at most

    def part(i: int) -> Column:
        tf, df = F.get("tf", F.lit(i)), F.get("df", F.lit(i))
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        return F.when(tf > 0, F.col("weight") * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("mean")))).otherwise(0.0)

    total = part(0)
    for i in range(1, len(terms)):
        total = total + part(i)
    grouped = one.groupBy("id", "url", "source_id", "origin").agg(
        F.round(F.sum(total), 6).alias("score"), *[F.max((F.get("tf", F.lit(i)) > 0).cast("int")).alias(f"has{i}") for i in range(len(terms))]
    )
    for i in range(len(terms)):
        grouped = grouped.where(F.col(f"has{i}") == 1)
    return grouped.select("id", "url", "source_id", "origin", "score")


def top(scored: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """Rows offset + 1 to offset + n by relevance, then id; `rank` counts from 1 over all."""
    some = scored.orderBy(F.desc("score"), "id").limit(offset + n)
    return some.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id"))).where(F.col("rank") > offset)


def select_page(window: DataFrame, limit: int, cap: int = fixed.PER_SOURCE_CAP) -> DataFrame:
    """Of a ranked window the first `limit` rows with new URLs and at most `cap` rows of a known source."""
    first = window.withColumn("un", F.row_number().over(W.partitionBy("url").orderBy("rank"))).where("un = 1").drop("un")
    capped = first.withColumn("sn", F.row_number().over(W.partitionBy("source_id").orderBy("rank"))).where((F.col("sn") <= cap) | F.col("source_id").isNull()).drop("sn")
    return capped.orderBy("rank").limit(limit)


def page_bounds(window: DataFrame, page: DataFrame, limit: int, offset: int, fetch: int, total: Column) -> DataFrame:
    """One row: rows on the page, documents read, next offset; the end once a short window was read out."""
    seen = window.agg(F.count(F.lit(1)).alias("seen"))
    shown = page.agg(F.count(F.lit(1)).alias("shown"), F.max("rank").alias("last"))
    read = F.when(F.col("shown") >= limit, F.col("last") - offset).otherwise(F.col("seen"))
    nxt = F.when((F.col("seen") < fetch) & (read == F.col("seen")), F.greatest(offset + read, total)).otherwise(offset + read)
    return seen.join(shown, F.lit(True)).select("shown", read.alias("read"), nxt.alias("next_offset"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def query_vector(candidates: DataFrame, vectors: DataFrame, best: int = 10) -> list[float] | None:
    """Where no encoder is at hand: the mean vector of the best keyword rows, unit vectors each. None if none has one."""
    top_rows = candidates.orderBy(F.desc("score"), "id").limit(best)
    near = vectors.join(F.broadcast(top_rows.select(F.col("id").alias("vec_id"))), "vec_id").select("embedding").collect()  # at most `best` rows
    units = [[x / n for x in r["embedding"]] for r in near if (n := math.sqrt(sum(x * x for x in r["embedding"]))) > 0]
    return [sum(x) / len(units) for x in zip(*units)] if units else None


def rerank(candidates: DataFrame, vectors: DataFrame, target: list[float]) -> DataFrame:
    """The semantic window's rows with their cosine to the query's vector, null for rows without one."""
    some = candidates.orderBy(F.desc("score"), "id").limit(fixed.SEMANTIC_WINDOW)
    # the window is bounded, so the table of vectors is scanned once and not shuffled
    near = vectors.join(F.broadcast(some.select("id")), vectors["vec_id"] == F.col("id")).select("id", "embedding")
    goal = F.array(*[F.lit(float(x)) for x in target])
    return some.join(near, "id", "left").select(*some.columns, F.round(cosine(F.col("embedding"), goal), 6).alias("similarity"))


def within_budget(spark: SparkSession, seconds: float, work: Callable):
    """work(), whose Spark jobs are cancelled and which fails with TimeoutError once the seconds are over."""
    group, done, failed = f"quillet-{uuid.uuid4().hex}", [], []

    def run():
        spark.sparkContext.setJobGroup(group, "within budget", interruptOnCancel=True)
        try:
            done.append(work())
        except Exception as e:  # told to the caller's thread
            failed.append(e)

    thread = InheritableThread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        spark.sparkContext.cancelJobGroup(group)
        raise TimeoutError(f"no answer in {seconds} seconds")
    if failed:
        raise failed[0]
    return done[0]


#: Fixed value: seconds that a ranking may take before the keyword order is given instead.
RERANK_SECONDS = 5.0


def reranked(candidates: DataFrame, ranking: Callable[[DataFrame], DataFrame], seconds: float = RERANK_SECONDS) -> tuple[DataFrame, bool]:
    """The semantic window in the order of its similarity, rows without one last in keyword order; and whether it was ranked.

    ranking adds `similarity`. It is executed here, within its own time; if it fails or hangs the keyword order stands.
    """
    spark = candidates.sparkSession
    try:
        rows = within_budget(spark, seconds, lambda: ranking(candidates).select("id", "similarity").collect())  # SEMANTIC_WINDOW rows at most
    except Exception:
        return candidates, False
    order = spark.createDataFrame([(r["id"], r["similarity"]) for r in rows], f"id {candidates.schema['id'].dataType.simpleString()}, similarity double")
    some = candidates.orderBy(F.desc("score"), "id").limit(fixed.SEMANTIC_WINDOW)
    # keyword scores are over 0, so a missing similarity sorts below any, by its keyword score
    place = F.coalesce(F.col("similarity") + 3, 1 - 1 / (1 + F.col("score")))
    return some.join(F.broadcast(order), "id", "left").withColumn("score", place).drop("similarity"), True


def search(
    index: Index, request: SearchRequest, vectors: DataFrame | None = None, encode: Callable[[str], list[float]] | None = None, seconds: float = RERANK_SECONDS
) -> DataFrame:
    """The page of a request. A semantic request falls back to keyword order if it can't be reranked in time."""
    found, _ = ranked_window(index, request, vectors, encode, seconds)
    window = top(found, fetch_size(request.semantic, request.limit, request.offset), request.offset)
    return select_page(index.shown(window), request.limit)


def ranked_window(
    index: Index, request: SearchRequest, vectors: DataFrame | None = None, encode: Callable[[str], list[float]] | None = None, seconds: float = RERANK_SECONDS
) -> tuple[DataFrame, bool]:
    """The best rows, as many as the request's window ends at, and whether they were reranked."""
    if request.semantic and vectors is not None:
        return reranked(index.top(request.terms, fixed.SEMANTIC_WINDOW, request.origin), semantic_ranking(request, vectors, encode), seconds)
    return index.top(request.terms, request.offset + fetch_size(request.semantic, request.limit, request.offset), request.origin), False


def semantic_ranking(request: SearchRequest, vectors: DataFrame, encode: Callable[[str], list[float]] | None = None) -> Callable[[DataFrame], DataFrame]:
    def rank(candidates: DataFrame) -> DataFrame:
        target = encode(" ".join(request.terms)) if encode else query_vector(candidates, vectors)
        return rerank(candidates, vectors, target) if target else candidates.limit(fixed.SEMANTIC_WINDOW).withColumn("similarity", F.lit(None).cast("double"))

    return rank


def loop_page(rows: list[tuple[int, str, str | None]], limit: int, cap: int = fixed.PER_SOURCE_CAP) -> tuple[list[int], int]:
    """The same selection row by row, for tests: kept ranks and rows read."""
    urls, per, kept, read = set(), {}, [], 0
    for rank, url, source in rows:
        if len(kept) == limit:
            break
        read += 1
        if url in urls:
            continue
        urls.add(url)
        if source is not None:
            per[source] = per.get(source, 0) + 1
            if per[source] > cap:
                continue
        kept.append(rank)
    return kept, read if math.isfinite(limit) else len(rows)
