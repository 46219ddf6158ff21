"""The quality classifier: statistics word by word, the fit and calibration against plain versions, held-out accuracy, awkward rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillet.llm import classifier

KINDS = "space lower upper digit sentence bang sign high control".split()


def kind(b):
    c = chr(b)
    if b in (9, 10, 11, 12, 13, 32):
        return "space"
    if b >= 128:
        return "high"
    if b < 32 or b == 127:
        return "control"
    if c.isalpha():
        return "lower" if c.islower() else "upper"
    return "digit" if c.isdigit() else "sentence" if c in ".,;:?'\"-()" else "bang" if c == "!" else "sign"


def plainly(text):
    words, size = text.split(), max(len(text), 1)
    n = max(len(words), 1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    kinds = Counter(map(kind, text))
    first, last = Counter(kind(w[0]) for w in words), Counter(kind(w[-1]) for w in words)
    pair = lambda k: sum(kind(a) == kind(b) == k for a, b in zip(text, text[1:]))
    return [
        math.log1p(len(text)), math.log1p(len(words)), math.log1p(len(lines)), math.log1p(len(text) / n), math.log1p(len(words) / max(len(lines), 1)),
        *(kinds[k] / size for k in KINDS[1:]), *(first[k] / n for k in ("upper", "digit", "sentence", "sign", "high")), *(last[k] / n for k in ("upper", "sentence", "bang", "sign")),
        pair("upper") / size, pair("sign") / size, math.log1p(len(set(words))) / math.log1p(n), max(Counter(words).values(), default=0) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n, (len(lines) - len(set(lines))) / max(len(lines), 1),
    ]


def test_statistics(monkeypatch):
    r = random.Random(1)
    texts = [b"", b" \n\t", "É!! Ça va; no no no\nline\nline\x00 [x] 12".encode(), b"one"]
    texts += ["".join(r.choices("aB1 .!#é\n\x0b", k=500)).encode() for _ in range(20)]
    for text in texts:
        assert classifier.statistics(text) == pytest.approx(plainly(text))
    monkeypatch.setattr(classifier, "CHUNK", 50)  # texts read in parts
    for text in texts:
        assert classifier.statistics(text) == pytest.approx(plainly(text))


def test_pooled_in_parts():
    r = random.Random(2)
    rows = [(x / 50, x / 50, float(sum(r.random() < x / 300 for _ in range(5))), 5.0) for x in range(300)]
    whole = classifier.pooled([], rows)
    parts = [p for i in range(0, 300, 37) for p in classifier.pooled([], rows[i : i + 37])]
    assert classifier.pooled([], parts) == whole
    means = [s / n for _, _, s, n in whole]
    assert means == sorted(means) and sum(n for *_, n in whole) == 1500
    values = [s / n for _, _, s, n in rows]  # max over starts of min over ends of means is the isotonic fit
    for i in (0, 100, 299):
        fit = max(min(np.mean(values[a : b + 1]) for b in range(i, 300)) for a in range(i + 1))
        assert fit == pytest.approx(next(s / n for low, high, s, n in whole if low <= rows[i][0] <= high))


def corpus():
    r = random.Random(5)
    rows, labels = [], []
    words = ["".join(r.choices("abcdefghijklm", k=r.randint(2, 8))) for _ in range(300)]
    for i in range(1200):
        some = r.choices(words, k=r.randint(5, 60))
        good = r.random() < 0.8
        text = " ".join(some).capitalize() + "." if good else r.choice([" ".join(some).upper() + "!!", " | ".join(some), " ".join([some[0]] * len(some))])
        rows.append((i, text))
        labels.append((i, int(good)))
    return rows, labels


SCHEMA = "doc_id long, text string, score string, x int, id string, held_out int"


def test_fit_and_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, "clash", 1, "clash", 2) for r in rows], SCHEMA).repartition(4)
    marks = spark.createDataFrame([*labels, (None, 1), (5, None), (99_999, 0)], "doc_id long, quality int")
    found = classifier.measured(docs)
    learn = classifier.labelled(found, marks, ~classifier.held_out(F.col("doc_id")), "doc_id", "quality", 10_000)
    model = classifier.fit(learn)
    seen = learn.collect()
    x, y = (np.array(v, float) for v in zip(*((r["x"], r["y"]) for r in seen if not r["calibrates"])))
    z = classifier.Fourier(x.mean(0), x.std(0))(x)
    ridge = np.eye(z.shape[1]) * classifier.RIDGE * len(z)
    ridge[-1, -1] = 0
    beta = np.linalg.solve(z.T @ z + ridge, z.T @ y)
    assert np.allclose(z @ beta, model.raw(x), atol=1e-4)
    # inner products of the features are near the kernel
    near = np.clip((x[:60] - x.mean(0)) / np.where(x.std(0) > 1e-9, x.std(0), 1), -classifier.FAR, classifier.FAR)
    kernel = np.exp(-((near[:, None] - near[None]) ** 2).sum(-1) / (2 * classifier.SIZE))
    assert abs(z[:60, :-1] @ z[:60, :-1].T - kernel).mean() < 0.06
    got = {r["doc_id"]: r for r in classifier.classify(docs, marks).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (i in set(held)) for i in got) and len(got) == len(rows)
    assert sum(got[i]["predicted"] == labels[i][1] for i in held) > 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())


def test_held_out_labels_and_other_columns_teach_nothing(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q) for i, q in labels]
    a, b = (
        {r["doc_id"]: r["score"] for r in classifier.classify(docs, spark.createDataFrame(x, "doc_id long, quality int")).collect()} for x in (labels, turned)
    )
    assert a == pytest.approx(b, abs=1e-6)


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "no id"), (4, "x" * 3_000_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in classifier.classify(docs, none).collect()} == {0.5}
    few = spark.createDataFrame([(1, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    got = classifier.classify(docs, few).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert classifier.classify(docs.where("false"), few).collect() == []
