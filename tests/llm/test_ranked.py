"""Ranked search against a full scoring of every document, and its stops."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quillet.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, item_id string, score int, rank int, at string, n int"


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def made():
    r = random.Random(4)
    words = ["the", "of", "Ähre", "ähre", "ÄHRE", "x1", "日本", "naïve", *(f"w{i}" for i in range(300))]
    shares = [400, 300, 5, 5, 5, 9, 9, 9, *(200 / (i + 1) for i in range(300))]
    texts = [" ".join(r.choices(words, shares, k=r.randint(1, 80))) for _ in range(300)]
    texts += ["the,THE;tHe_the", "", None, "...", "w250-w251", "long " * 3000 + "w7", "w250 w251"] + ["w1 w2 w3 copies"] * 120
    rows = list(enumerate(texts)) + [(None, "w250 w251"), (5, texts[6]), (5, texts[6])]
    items = [(i, r.choice(texts[:300])) for i in range(30)] + [(31, None), (32, ""), (33, "nowhere"), (34, "THE of the"), (34, "THE of the"), (35, "copies w250"), (None, "w250")]
    return rows, items


def expected(rows, items):
    held = [(d, Counter(terms_of(t))) for d, t in rows]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    count, length = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, n in held:
            m = 100 - 50 + (50 * n * count) // length
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms_of(text)) if t in c)
            if score > 0:
                found.append((-score, d is None, d if d is not None else 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(found)[:50])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [ranked.BLOCK_BYTES, 1000])
def test_search(spark, block_bytes):
    rows, items = made()
    docs = spark.createDataFrame([(d, t, "clash", 1, 2, "clash", 3) for d, t in rows], SCHEMA).repartition(3)
    queries = spark.createDataFrame(items, "item_id long, text string")
    got = ranked.search(docs, queries, block_bytes=block_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got.collect()), key=str) == expected(rows, items)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "some")], "item_id long, text string")
    assert ranked.search(docs.where("false"), items).collect() == []
    assert ranked.search(docs, items.where("false")).collect() == []


def test_long_text_in_parts():
    text = "word, Ünique " * 200_000 + "x" * 3_000_000 + " end"
    assert ranked.count_terms(text.encode()) == Counter(t.encode() for t in terms_of(text))


def test_stops_early_and_stays_exact():
    r = np.random.default_rng(1)
    n_docs = 5000
    # term t occurs in fewer documents the greater t is
    held = [np.flatnonzero(r.random(40) < 0.9 / (1 + np.arange(40))) for _ in range(n_docs)]
    sizes = np.array([len(x) for x in held])
    at = np.concatenate(held)
    tf = r.integers(1, 6, len(at))
    n = r.integers(20, 400, n_docs)
    df = np.bincount(at, minlength=40)
    weights = {t: ranked.weight(n_docs, int(df[t])) for t in (0, 1, 2, 3, 30, 36, 39)}
    some = ranked.Slice(n, sizes, at, tf, n_docs, int(n.sum()))
    full = some.whole(np.arange(n_docs), weights)
    least = int(np.sort(full)[-50])
    found, scores = some.best(weights, 50, least)  # as after earlier slices
    assert set(np.flatnonzero(full > least)) <= set(found) and (full[found] == scores).all()
    assert some.read < np.isin(at, list(weights)).sum() * 0.6
    found, scores = some.best(weights, 50, 0)
    assert sorted(scores)[-50:] == sorted(full)[-50:]
