"""Each corpus operator against a brute-force version, on awkward small tables."""

import base64
import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillet.llm import bpe, exact_dedup, langid, licences, lm, near_dup, packing, pii, quality, sharding

SPACE = re.compile(r"[\x20\x09-\x0D]+")
random.seed(5)
VOCABULARY = ["".join(random.choices("abcdefghilmnorstu", k=random.randint(2, 9))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choices(VOCABULARY, k=n)) + "."


BASE = prose(400, 1)
EDITED = BASE.replace(BASE.split()[200], "changedword", 1)
ROWS = [
    (1, "the cat sat on the mat with a hat and the cat sat on the mat again", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, "  \t\n ", "fr"),
    (5, "Mail bob@example.com, ann@b.c.org@x.y or +44 20 7946 0958; ip 10.0.0.1 and 1.2.3.4.5.6.7.8, 300.1.1.1", "en"),
    (6, "card 4111 1111 1111 1111 no 4111 1111 1111 1112 IBAN DE89 3704 0044 0532 0130 00 http://u:p@h.org", None),
    (7, BASE, "en"),
    (8, EDITED, "en"),
    (9, BASE.replace(" ", "  "), "de"),
    (10, BASE.upper(), "de"),
    (11, "x" * 5000 + " " + "ab1 " * 3000 + "\n" * 700 + "é" * 2000 + "日本語 " * 500, "fr"),
    (12, "line one here now\nline one here now\n\nline one here now\n$ # ok", "es"),
    (13, "don't we'll <|endoftext|> I'M  　 wide\x85next\x1cctl​zero naïve ÀÉ 12,345.67 🙂🙂 é", "es"),
    (13, "don't we'll <|endoftext|> I'M  　 wide\x85next\x1cctl​zero naïve ÀÉ 12,345.67 🙂🙂 é", "es"),
    (None, "an id is missing here", "en"),
    (None, "an id is missing  here", "en"),
    (15, prose(4000, 3), "en"),
    (16, prose(4000, 3) + " tail", "en"),
    (17, "a@" * 40 + "b.c +1234567890123 ++12 +1 (2) 3-4567890", "en"),
    (18, "12345678901234567890 0000 0000 0000 00 1-2-3-4-5-6-7-8-9-0-1-2-3-4 7.7.7", "en"),
]
SCHEMA = "doc_id long, text string, lang string, kept string, digit int, id string, part int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, l, "clash", 1, "clash", 2) for i, t, l in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def by_id(df):
    found = defaultdict(list)
    for r in df.collect():
        found[r["doc_id"]].append(r.asDict())
    return found


def texts():
    return [(i, t or "") for i, t, _ in ROWS]


# 1


def test_licences(spark):
    mit = licences.LICENCES["MIT"]
    rows = [
        (1, "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + mit.replace(". ", ".\n")),
        (2, mit.replace("noninfringement", "x")),
        (3, mit.replace("NONINFRINGEMENT", "OTHER")),
        (4, None),
        (5, ""),
        (6, "Copyright 2020 Somebody\n"),
        (7, licences.LICENCES["ISC"].replace("PERFORMANCE", "performance").replace("copyright notice", "copyright   notice")),
        (8, licences.LICENCES["Zlib"].replace("acknowledgment", "acknowledgement").replace("'", '"')),
        (8, "(c) 1999 X\n" + licences.LICENCES["BSD-3-Clause"]),
    ]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["licence"] or "") for r in got) == [
        (1, "MIT"), (2, "MIT"), (3, ""), (4, ""), (5, ""), (6, ""), (7, "ISC"), (8, "BSD-3-Clause"), (8, "Zlib"),
    ]
    assert licences.known(spark, licences.LICENCES).join(licences.known(spark), ["canonical_sha256", "licence"]).count() == len(licences.LICENCES)
    plan = licences.scan(spark.createDataFrame(rows, "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def canonical(text):
    """The canonical form line by line and word by word."""
    low = "".join(c.lower() if c.isascii() else c for c in text)
    lines = []
    for line in low.split("\n"):
        bare = re.sub(r"^[^a-z0-9©(]*", "", line)
        if re.match(r"spdx-license-identifier|copyright[^a-z0-9]*(c\)|©|[0-9]{4}|year|yyyy)|(\(c\)|©)\W*(copyright\W*)?[0-9]{4}|(\(c\)|©)[^0-9]{1,60}(19|20)[0-9]{2}", bare):
            continue
        lines.append(line.replace("all rights reserved", " "))
    titles = {"mit license", "the mit license mit", "isc license isc", "bsd 3 clause new or revised license", "bsd 2 clause simplified license", "the zlib libpng license", "the unlicense", "zlib license"}
    words = [w for x in lines if " ".join(re.findall("[a-z0-9]+", x)) not in titles for w in re.findall("[a-z0-9]+", x)]
    swaps = {"licence": "license", "licences": "licenses", "sublicence": "sublicense", "acknowledgement": "acknowledgment", "organisations": "organizations", "organisation": "organization", "programmes": "programs", "centre": "center", "labelling": "labeling", "authorised": "authorized", "favour": "favor", "whilst": "while", "willful": "wilful"}
    return " " + " ".join(swaps.get(w, w) for w in words)


def test_canonical_form_equals_a_plain_one(spark, docs, none):
    samples = [
        "MIT License\n\nCopyright (c) 2020 A\nAll rights reserved.\nPermission granted", "(c) You must stay\n(c) Ann B. Lee, 2001.\n  © Ann\n© Ann 2002\n(C) Copyright 2003 Ann\nend (c) 2004 all",
        "mit " * 50_000, "/* SPDX-License-Identifier: MIT */\n// The Licence licence licences sublicence", "The MIT and BSD licenses differ here",
        "see the MIT license\nfor organisations, programmes and the centre", 'BSD 3-Clause "New" or "Revised" License\nlabelling labelling authorised favour whilst willful', "ISC License (ISC)\n\n(c) 1999 X\n© 2000 Y\ntext", "x" * 300_000 + " licence", "", "\n\n",
    ]
    rows = [(i, t) for i, t in enumerate(samples)]
    got = {r["doc_id"]: r["form"] for r in spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", licences.canonical(F.col("text")).alias("form")).collect()}
    for i, t in rows:
        assert got[i] == canonical(t).strip(), t
    assert got[4] == "the mit and bsd licenses differ here"
    scanned = licences.scan(docs)
    assert scanned.count() == len(ROWS) and scanned.columns == ["doc_id", "canonical_sha256", "licence", "matched"] and licences.scan(none).count() == 0


def test_licence_oracle_on_planted_texts(spark):
    import duckdb

    mit, zlib_ = licences.LICENCES["MIT"], licences.LICENCES["Zlib"]
    rows = [(1, "The MIT License (MIT)\n\nCopyright (c) 2021 B\n\n" + mit.replace("copyright holders", "COPYRIGHT OWNERS")), (2, "SPDX-License-Identifier: Zlib\n" + zlib_.replace("acknowledgment", "acknowledgement")), (3, mit + " plus"), (4, None), (5, "licence " * 50)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = [tuple(r) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(con.sql(licences.scan_sql()).fetchall()) == sorted(got) and [r[2] for r in sorted(got)] == ["MIT", "Zlib", None, None, None]


def test_licences_whole_texts_and_titles(spark):
    files = {
        "Apache-2.0": "Apache-2.0", "Artistic": "Artistic", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0",
        "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
    }
    rows = [(want, (licences.Path("/usr/share/common-licenses") / f).read_text(encoding="utf-8")) for f, want in files.items()]
    titles = {
        "0BSD": "BSD Zero Clause License", "BSD-2-Clause": 'BSD 2-Clause "Simplified" License', "BSD-3-Clause": 'BSD 3-Clause "New" or "Revised" License', "BSL-1.0": "Boost Software License 1.0",
        "ISC": "ISC License (ISC)", "MIT": "The MIT License (MIT)", "Unlicense": "The Unlicense", "Zlib": "The zlib/libpng License",
    }
    rows += [(want, f"{title}\n\nCopyright (c) 2020 A. Person\n\n{licences.LICENCES[want]}") for want, title in titles.items()]
    rows += [("", rows[0][1] + " and more"), ("", rows[6][1].replace("Program", "Thing", 1))]
    got = licences.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert len(got) == len(rows) and all((r["licence"] or "") == r["doc_id"] and r["matched"] == (r["doc_id"] != "") for r in got)


def whole_licences():
    folder = licences.Path("/usr/share/common-licenses")
    texts = {f.name: f.read_text(encoding="utf-8") for f in folder.iterdir() if not f.is_symlink()}
    return texts | licences.LICENCES


def test_licences_wrapped_anew(spark):
    rows = []
    for name, text in whole_licences().items():
        paragraphs = [" ".join(p.split()) for p in re.split(r"\n\s*\n", text)]
        rows += [(name, width, "\n\n".join(textwrap.fill(p, width) for p in paragraphs)) for width in (60, 70, 76, 1_000_000)]
        rows.append((name, 0, text))
    got = defaultdict(set)
    for r in licences.scan(spark.createDataFrame(rows, "name string, width int, text string"), id_col="name").collect():
        got[r["name"]].add(r["licence"])
    assert all(len(x) == 1 and None not in x for x in got.values()), got


def test_licences_with_one_word_changed(spark):
    """One word of each line, another than a notice's or title's, makes a text unknown."""
    rows = []
    for name, text in whole_licences().items():
        lines = text.split("\n")
        for i, line in enumerate(lines):
            words = re.findall("[A-Za-z]{3,}", line)
            if words:
                word = words[len(words) // 2]
                rows.append((name, line, "\n".join([*lines[:i], line.replace(word, "gazebo", 1), *lines[i + 1 :]])))
    df = spark.createDataFrame(rows, "name string, line string, text string").repartition(8)
    kept = [r["line"].lower() for r in licences.scan(df.withColumn("both", F.struct("name", "line")), id_col="both").where("matched").select("both.line").collect()]
    assert len(rows) > 3000
    assert all("copyright" in x or "license" in x and len(x.split()) < 8 or re.search("free software foundation|franklin|fsf.org", x) for x in kept), kept


def test_apache_clause_c(spark):
    apache = whole_licences()["Apache-2.0"]
    line = next(x for x in apache.split("\n") if x.strip().startswith("(c) You"))
    rows = [(1, apache), (2, apache.replace(line, "      (c) You may delete everything and pay the Licensor a royalty of it")), (3, apache.replace(line, "\n        ".join(line.rsplit(" ", 2))))]
    got = {r["doc_id"]: r["licence"] for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "Apache-2.0", 2: None, 3: "Apache-2.0"}


# 2


@pytest.mark.parametrize("first,widen", [(32, 16), (1, 2)])
def test_exact_dedup(spark, first, widen):
    rows = [(i, t) for i, t, _ in ROWS] + [(20, "abc" * 500), (21, "abc" * 500 + "d"), (22, "abc " * 500), (23, "abc" * 499), (24, "ab")]
    got = exact_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), first_bytes=first, widen=widen).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[SPACE.sub("", t or "")].append((i, len(t or "")))
    expected = Counter()
    for body, members in groups.items():
        best = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))
        for k, (i, _) in enumerate(sorted(members, key=lambda m: m != best)):
            expected[i, best[0], len(members), k == 0, hashlib.sha256(body.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in got) == expected


def test_exact_dedup_of_an_empty_table_and_of_clashing_columns(docs, none):
    assert exact_dedup.dedup(none).count() == 0
    got = exact_dedup.dedup(docs).collect()
    assert len(got) == len(ROWS) and sum(r["kept"] for r in got) == len({SPACE.sub("", t) for _, t in texts()})


# 3


def check_packing(rows, got, capacity, end=0):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [end]
        for k, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s : s + capacity]
            expected[i, k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


@pytest.mark.parametrize("group_rows", [100_000, 9])
def test_packing(spark, docs, group_rows):
    got = packing.pack(docs, capacity=64, group_rows=group_rows).collect()
    used = check_packing(texts(), got, 64)
    bound = packing.lower_bound([r["length"] for r in got], 64)
    assert used <= bound + (1 if group_rows > 9 else 3)
    assert all(r["certified"] == (r["part_sequences"] == r["part_lower_bound"]) for r in got)


def test_packing_deals_repeated_rows_apart_and_certifies_the_whole(spark):
    rows = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three four five six").alias("text"))
    done = packing.pack(rows, capacity=64, group_rows=2_000)
    used, bound = packing.certificate(done, 64)
    assert used == bound == -(-30_000 // (64 // 7))
    in_part = done.groupBy(F.expr("sequence_id >> 28")).count().agg(F.max("count")).first()[0]
    assert in_part <= 4_000


def test_tokenizer_equals_the_library():
    from tokenizers import Tokenizer

    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    own = packing.Tokenizer()
    r = random.Random(9)
    signs = ["é", "É", "ß", "ñ", "İ", "ı", "ſ", "ŉ", "Σ", "ς", "e\u0301", "'s", "'", "’", "1", "!", "-", "_", "|", " ", "\n", "\u00a0", "\u0085", "日", "🙂", "ǆ", "Ǆ", "ﬁ", "<|endoftext|>", "A", "b", "the", "TION", "\x00", "µ", "º", "«", "“", "½", "²", "·", "€", "<|", "\x7f", "\x1c"]
    for _ in range(3000):
        t = "".join(r.choices(signs, k=r.randint(1, 14)))
        assert np.frombuffer(own.encode([t])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing_empty(none):
    assert packing.pack(none).count() == 0


def test_best_fit_and_bound():
    r = random.Random(2)
    for _ in range(200):
        capacity = r.randint(5, 40)
        lengths = [r.randint(1, capacity) for _ in range(r.randint(1, 9))]
        bins, offsets, room = packing.best_fit_decreasing(lengths, capacity)
        assert len(room) >= fewest(lengths, capacity) >= packing.lower_bound(lengths, capacity)
        for b in range(len(room)):
            assert sum(n for n, x in zip(lengths, bins) if x == b) == capacity - room[b]


def fewest(lengths, capacity):
    """Bins of an optimal packing, by trying all."""
    best = [len(lengths)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + lengths[i] <= capacity:
                bins[b] += lengths[i]
                place(i + 1, bins)
                bins[b] -= lengths[i]
        place(i + 1, [*bins, lengths[i]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best[0]


# 4


def test_sharding(spark, docs, none):
    got = sharding.assign(docs, group_rows=1).collect()
    assert len(got) == len(ROWS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in texts())
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "key" and 0 <= r["shard"] < 40 and r["grown_shard"] in (r["shard"], 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(none).count() == 0


def test_shards_equal_brute_force(spark, docs):
    import struct

    import xxhash

    def shard(key, weights):
        best = []
        for s, w in enumerate(weights):
            seed = 42 if key is None else xxhash.xxh64_intdigest(str(key).encode(), 42)
            bits = xxhash.xxh64_intdigest(struct.pack("<i", s), seed) >> 11
            best.append((-w / math.log((bits + 0.5) / 2**53), -s))
        return -max(best)[1]

    for weights in ([1.0] * 40, [1.0, 3.0, 0.5]):
        for r in sharding.assign(docs, weights=weights).collect():
            assert r["shard"] == shard(r["doc_id"], weights) and r["grown_shard"] == shard(r["doc_id"], [*weights, 1.0])
    narrow = sharding.assign(docs.withColumn("doc_id", F.col("doc_id").cast("int")))
    assert sorted(map(str, narrow.select("doc_id", "shard").collect())) == sorted(map(str, sharding.assign(docs).select("doc_id", "shard").collect()))


def test_one_row_many_times_is_ranked_in_many_groups(spark, monkeypatch):
    rows = spark.range(200_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("t").alias("text"))
    seen = []
    whole = sharding.staged
    monkeypatch.setattr(sharding, "staged", lambda df, label: seen.append(whole(df, label)) or seen[-1])
    got = sharding.assign(rows, weights=(1.0,), group_rows=5_000)
    assert got.agg(F.count_distinct("slot"), F.min("slot"), F.max("slot"), F.count_distinct("shard")).first()[:] == (200_000, 0, 199_999, 1)
    largest = seen[0].groupBy(F.pmod(F.xxhash64("__rid"), F.lit(40))).count().agg(F.max("count")).first()[0]
    assert largest < 6_000


def test_sharding_weights_and_growth(spark):
    keys = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    n = {r["shard"]: r["n"] for r in sharding.assign(keys, weights=(1.0, 2.0, 1.0)).groupBy("shard").agg(F.count("*").alias("n")).collect()}
    assert abs(n[1] / 20_000 - 0.5) < 0.02 and abs(n[0] / 20_000 - 0.25) < 0.02
    small = keys.select("doc_id", sharding.rendezvous(F.col("doc_id"), [1.0] * 5).alias("five"), sharding.rendezvous(F.col("doc_id"), [1.0] * 6).alias("six"))
    assert small.where("five <> six AND six <> 5").count() == 0
    moved = small.where("six = 5").count()
    assert abs(moved / 20_000 - 1 / 6) < 0.02


# 5

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card":
                total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
                if not 14 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_base_spans_equal_the_patterns():
    r = random.Random(4)
    for _ in range(20_000):
        t = "".join(r.choices("ab1299450.@+-  ()%_é\n" if r.random() < 0.5 else "0123456789. -+@", k=r.randint(1, 60)))
        assert [s for s in pii.find_spans(t) if s[1] < pii.BASE] == base_spans(t), t
    for _, t in texts():
        assert [s for s in pii.find_spans(t) if s[1] < pii.BASE] == base_spans(t)


def test_pii_table(docs, none):
    got = by_id(pii.detect(docs))
    for i, t in texts():
        spans = base_spans(t)
        row = got[i][0]
        assert row["base_sha256"] == hashlib.sha256(",".join(f"{list(PATTERNS)[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
        assert [row[c] for c in ("n_email", "n_ip", "n_card", "n_phone")] == [sum(s[1] == k for s in spans) for k in range(4)]
    assert "iban" in got[6][0]["spans"] and "login" in got[6][0]["spans"]
    assert pii.detect(none).count() == 0
    clean = by_id(pii.redacted(docs))
    assert clean[5][0]["text"].startswith("Mail <EMAIL>, <EMAIL>") and clean[2][0]["text"] is None and clean[7][0]["text"] == BASE
    assert clean[5][0]["kept"] == "clash"
    assert not any(base_spans(r["text"] or "") for rows in clean.values() for r in rows)


# 6


def weighted(a, b):
    def bag(t):
        w = t.lower().split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    x, y = bag(a), bag(b)
    both, every = sum((x & y).values()), sum((x | y).values())
    return both / every if every else 1.0


def test_dart_signatures_estimate_similarity():
    words = near_dup.Words()
    for a, b in [(BASE, EDITED), (prose(300, 8), prose(250, 8)), (BASE + " " + BASE, BASE), (prose(50, 2) * 40, prose(50, 2) * 30)]:
        sims = []
        for salt in range(12):
            sig = []
            for t in (a, b):
                e, n = np.unique(near_dup.shingles(words.hashes(t.lower().split())) ^ np.uint64(salt * 7919), return_counts=True)
                sig.append((e, n))
            both = near_dup.signature(sig)
            sims.append((both[0] == both[1]).mean())
        assert abs(np.mean(sims) - weighted(a, b)) < 0.05
        assert abs(near_dup.similarity(a, b) - weighted(a, b)) < 1e-9


def near_rows():
    rows = [(i, t) for i, t, _ in ROWS]
    for g in range(12):
        words = prose(120, 100 + g).split()
        for k in range(9):
            r = random.Random(g * 100 + k)
            edited = list(words)
            for _ in range(k % 4):
                edited[r.randrange(len(edited))] = r.choice(VOCABULARY)
            rows.append((1000 + g * 20 + k, " ".join(edited)))
    return rows


@pytest.mark.parametrize("block,size", [(2048, 24_000_000), (3, 24_000_000), (2048, 3_000)])
def test_near_dedup_equals_brute_force(spark, none, monkeypatch, block, size):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    monkeypatch.setattr(near_dup, "BLOCK_BYTES", size)
    rows = near_rows()
    rows += [(None, t) for _, t in rows if t and len(t) > 400][::7] + rows[-3:]  # null and repeated ids
    got = near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = (rows[i][1] or ""), (rows[j][1] or "")
            if bool(a.split()) == bool(b.split()) and weighted(a, b) >= 0.8:
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    expected = Counter()
    for members in groups.values():
        least = min(members, key=lambda d: (d is None, d or 0))
        for d in members:
            expected[d, least, len(members)] += 1
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in got) == expected
    assert sum(r["kept"] for r in got) == len(groups)
    assert near_dup.classes(none).count() == 0


def test_near_dedup_of_clashing_columns(docs):
    got = near_dup.classes(docs)
    assert got.columns == ["doc_id", "class_id", "class_size", "kept"] and got.count() == len(ROWS)


def test_pipeline_on_awkward_rows(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, label string"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    rows = [(i, t, l or "en", "s", len(t or ""), "clash", "clash") for i, t, l in ROWS]
    spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{tmp_path}/rows/documents.parquet")
    kept = spark.read.parquet(f"{tmp_path}/rows/documents.parquet")
    for k, (name, f) in enumerate(corpus_pipeline.STAGES[:3]):
        f(spark, kept, "").write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        assert kept.columns == schema.replace(" long", "").replace(" string", "").split(", ")
    left = kept.collect()
    # of the two rows without ids one stays, as do one of the repeated rows and the long text; digits have no language
    assert sum(r["doc_id"] is None for r in left) == 1 and sum(r["doc_id"] == 13 for r in left) == 1 and 11 in {r["doc_id"] for r in left} and 18 not in {r["doc_id"] for r in left}
    got = corpus_pipeline.run(spark, f"{tmp_path}/rows").collect()
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in left} and sum(r["doc_id"] is None for r in got) == 1
    assert max(r["piece"] for r in got if r["doc_id"] == 11) > 0


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, l) for i, t, l in ROWS if i is not None and i not in (13, 11, 18)]
    rows += rows[:8]  # repeated rows: one of each stays
    rows += [(i, t, "en") for i, t in near_rows() if (i or 0) >= 1000 and len(t) > 0]
    docs = spark.createDataFrame([(i, t, l, "s", len(t or "")) for i, t, l in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    stage = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, stage, str(tmp_path))
        assert out.columns == docs.columns
        rows_in, rows_out = stage.collect(), out.collect()
        if name == "language_id":
            lost = {r["doc_id"] for r in rows_in} - {r["doc_id"] for r in rows_out}
            assert {2, 3, 4} <= lost
        elif name == "exact_dedup":
            assert len(rows_out) == len({SPACE.sub("", r["text"]) for r in rows_in}) == len({SPACE.sub("", r["text"]) for r in rows_out})
        elif name == "near_dedup":
            left = sorted(rows_out, key=lambda r: r["doc_id"])
            assert all(weighted(a["text"], b["text"]) < 0.8 for i, a in enumerate(left) for b in left[:i])
            assert all(any(weighted(r["text"], k["text"]) >= 0.5 for k in left) for r in rows_in)
        else:
            assert [r["doc_id"] for r in sorted(rows_out)] == [r["doc_id"] for r in sorted(rows_in)]
            assert not any(base_spans(r["text"]) for r in rows_out)
            assert all(r["n_chars"] == len(r["text"]) for r in rows_out)
        spark.createDataFrame(rows_out, docs.schema).coalesce(2).write.parquet(f"{tmp_path}/{name}")
        stage = spark.read.parquet(f"{tmp_path}/{name}")
    check_packing([(r["doc_id"], r["text"]) for r in rows_out], got, 2048)


# 7


def base_quality(text):
    words = SPACE.sub(" ", text).strip(" ").split(" ") if SPACE.sub("", text) else []
    lines = [l for l in text.split("\n") if SPACE.sub("", l)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    n = len(words)
    failed = n < 10 or 100 * len(inside) > 20 * n
    return [n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed]


def test_quality(docs, none):
    got = by_id(quality.judge(docs, min_docs=1))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for i, t in texts():
        assert base_quality(t) in [[row[c] for c in names] for row in got[i]]
    assert quality.judge(none).count() == 0


def shares(counts):
    return [c / sum(counts) if sum(counts) else 0.0 for c in counts]


def divergence(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a > 0)
    return math.sqrt(max(0.0, (kl(p) + kl(q)) / 2))


def class_counts(text):
    import unicodedata

    counts = [0] * 7
    for c in text:
        if SPACE.fullmatch(c):
            counts[5] += 1
        elif c.isascii() and c.isalnum():
            counts[0 if c.islower() else 1 if c.isupper() else 2] += 1
        elif "!" <= c <= "~":
            counts[3] += 1
        else:
            counts[4 if unicodedata.category(c)[0] in "LM" else 6] += 1
    return counts


def judged(rows, common=24, min_words=60, min_docs=50):
    """(base_failed, kept, class_distance, word_distance) of each row (id, text, lang), by the defaults of judge()."""
    texts_of = defaultdict(list)
    for _, t, lang in rows:
        if t and lang:
            texts_of[lang].append(t)
    words = lambda t: [w for w in SPACE.split(t) if w]
    refs = {}
    for lang, every in texts_of.items():
        counts = Counter(w for t in every for w in words(t.lower()))
        n = sum(counts.values())
        if n >= min_docs * min_words:
            top = sorted(counts, key=lambda w: (-counts[w], w.encode()))[:common]
            of = [counts[w] / n for w in top]
            refs[lang] = top, shares([sum(x) for x in zip(*map(class_counts, every))]), [*of, max(0.0, 1 - sum(of))]
    for i, t, lang in rows:
        n, failed = len(words(t or "")), base_quality(t or "")[5]
        if n < min_words or lang not in refs:
            yield i, (failed, not failed, None, None)
            continue
        top, class_ref, word_ref = refs[lang]
        low = Counter(w.lower() for w in words(t))
        hist = [low[w] for w in top]
        far = divergence(shares(class_counts(t)), class_ref), divergence(shares([*hist, n - sum(hist)]), word_ref)
        bare = divergence([0.0] * len(top) + [1.0], word_ref)
        chance = len(top) / (8 * math.log(2) * n)
        lacks = far[1] > quality.BARE * bare and (sum(hist) < quality.FEW * (1 - word_ref[-1]) * n or far[1] ** 2 > quality.NOISE * chance)
        yield i, (failed, not failed and far[0] <= 0.3 and not lacks, *far)


def test_quality_verdicts_equal_brute_force(spark):
    r = random.Random(8)
    greek = str.maketrans("abcdefghilmnorstu", "αβγδεφγηιλμνορστυ")
    rows = [(i, prose(r.randint(5, 150), i).capitalize(), "en") for i in range(120)]
    rows += [(1000 + i, prose(r.randint(30, 200), i).translate(greek) + " – « 12 »", "el") for i in range(60)]
    rows += [(2000 + i, t, l) for i, (_, t, l) in enumerate(ROWS)]
    rows += [(3000, "0123 456 " * 80, "en"), (3001, " ".join(f"zq{i}x" for i in range(300)), "en"), (3002, prose(100, 1).translate(greek), "en"), (3003, "e\u0301 日本 🙂 ½ " * 30 + prose(90, 2), "en")]
    expected = dict(judged(rows))
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        failed, kept, *far = expected[r["doc_id"]]
        assert (r["base_failed"], r["kept"]) == (failed, kept), r
        for a, b in zip(far, (r["class_distance"], r["word_distance"])):
            assert (a is None) == (b is None) and (a is None or math.isclose(a * a, b * b, abs_tol=1e-12)), (r, far)
    assert {True, False} == {k for _, k, *_ in expected.values()} and not expected[3001][1]


def test_quality_class_references_cut_no_words(spark, monkeypatch):
    """Shares of classes equal those counted a character at a time, and their scan neither lowers texts nor cuts them into words."""
    r = random.Random(5)
    odd = ["\t", "\n", "\x0b", "\x0c", "\r", " ", "  ", "\u00a0", "\u2003", "\u0130", "\u03a3", "e\u0301", "\u65e5\u672c", "\U0001f642", "\u00bd", "#*$", "Ab1", "zz", "-", "\x00", "\x1f"]
    texts_of = {"en": ["".join(r.choices(odd, k=r.randint(1, 60))) for _ in range(40)], "el": ["".join(r.choices(odd, k=90)), ""], "blank": [" \n", "\t"]}
    rows = [(t, lang) for lang, every in texts_of.items() for t in every]
    plans = {}
    monkeypatch.setattr(quality, "staged", lambda df, label, f=quality.staged: plans.update({label: df._jdf.queryExecution().optimizedPlan().toString()}) or f(df, label))
    got = {x["__lang"]: x for x in quality.references(spark.createDataFrame(rows, "text string, lang string"), "text", "lang", 3, 0).collect()}
    assert set(got) == set(texts_of)
    for lang, every in texts_of.items():
        counts = Counter(w for t in every for w in SPACE.split(t.lower()) if w)
        assert got[lang]["__class_ref"] == pytest.approx(shares([sum(x) for x in zip(*map(class_counts, every))]))
        assert len(got[lang]["__keys"]) == min(3, len(counts))
        assert got[lang]["__word_ref"][:-1] == pytest.approx([n / sum(counts.values()) for n in sorted(counts.values(), reverse=True)[:3]])
    assert "split(" in plans["counts"] and "split(" not in plans["references"] and "lower(" not in plans["references"]


def test_quality_divergence(spark):
    rows = [(i, prose(200, i), "en") for i in range(200)] + [(900, " ".join("0123456789"[i % 10] * (3 + i % 7) + str(i) for i in range(300)), "en")]
    got = by_id(quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert not got[900][0]["kept"] and sum(not got[i][0]["kept"] for i in range(200)) == 0
    p, q = [0.5, 0.5, 0.0], [0.1, 0.4, 0.5]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a)
    d = spark.range(1).select(quality.jensen_shannon(F.array(*map(F.lit, p)), F.array(*map(F.lit, q))).alias("d")).first()["d"]
    assert abs(d - math.sqrt((kl(p) + kl(q)) / 2)) < 1e-9


def test_quality_rejects_texts_without_common_words(spark):
    r = random.Random(3)
    common = "the of and to a in is that it for was on with as be by this at from or".split()
    long_words = [w for w in VOCABULARY if len(w) > 4]
    clean = lambda n: " ".join(r.choice(common) if r.random() < 0.4 else r.choice(long_words) for _ in range(n))
    rows = [(i, clean(60 + 3 * i), "en") for i in range(200)] + [(900, " ".join(r.choices(long_words, k=600)), "en")]
    got = by_id(quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    bad = got[900][0]
    assert not bad["base_failed"] and bad["class_distance"] < 0.3 and not bad["kept"]
    assert all(got[i][0]["kept"] for i in range(200))


def test_quality_references_of_small_languages(spark):
    r = random.Random(4)
    greek = str.maketrans("abcdefghilmnorstu", "αβγδεφγηιλμνορστυ")
    rows = [(i, prose(100, i), "en") for i in range(300)] + [(1000 + i, prose(400, 1000 + i).translate(greek), "el") for i in range(30)]
    rows += [(2000, prose(100, 1).translate(greek), None), (2001, prose(100, 2).translate(greek), "rare"), (2002, prose(100, 3).translate(greek), "en")]
    got = by_id(quality.judge(spark.createDataFrame(r.sample(rows, len(rows)), "doc_id long, text string, lang string")))
    assert all(got[1000 + i][0]["kept"] and got[1000 + i][0]["class_distance"] < 0.1 for i in range(30))
    assert all(got[i][0]["kept"] and got[i][0]["class_distance"] is None for i in (2000, 2001))
    assert not got[2002][0]["kept"]


# 8


def segmentations(word, order, probs):
    """(pieces, probability) of every segmentation, piece by piece."""
    if not word:
        yield (), np.ones(probs.shape[1])
    for n in range(1, len(word) + 1):
        i = order.get(word[:n], len(order) + 1 if n == 1 else None)
        if i is not None:
            for rest, p in segmentations(word[n:], order, probs):
                yield (i, *rest), p * probs[i]


def test_forward_and_expected_counts_equal_all_segmentations():
    finder = langid.pieces(None)
    r = np.random.default_rng(1)
    probs = langid._smoothed(r.random((len(finder.names) + 2, 3)))
    order = {p: i for i, p in enumerate(finder.names)}
    words = ["the", "straße", "xq", "a", "日本", "nation.", "12.5", "international"]
    weights = r.random((len(words), 3))
    counts = np.zeros_like(probs)
    for w, row, weight in zip(words, finder.log_likelihood(words, probs), weights):
        every = list(segmentations(langid.START + w, order, probs))
        total = sum(p for _, p in every)
        assert np.allclose(row, np.log(total))
        for spelled, p in every:
            for i in spelled:
                counts[i] += weight * p / total
    assert np.allclose(finder.expected(words, weights, probs), counts)
    assert finder.longest == max(map(len, finder.names)) > 6


def test_long_words_stay_in_range(monkeypatch):
    finder = langid.pieces(None)
    r = np.random.default_rng(2)
    probs = langid._smoothed(r.random((len(finder.names) + 2, 2)) * 1e9)
    without = ["ሀ" * 39, "ሀ" * 5000, "日" * 9000, "nationale" * 2000]
    whole = finder.log_likelihood(without, probs)
    assert np.isfinite(whole).all() and np.allclose(whole[0] - np.log(probs[order_of(finder, langid.START)]), 39 * math.log(langid.UNSEEN))
    counts = finder.expected(without, np.ones((4, 2)), probs)
    spelled = np.array([len(p) for p in finder.names] + [0, 1])
    assert np.isfinite(counts).all() and np.allclose(spelled @ counts, sum(len(w) + 1 for w in without))
    monkeypatch.setattr(langid, "STRETCH", 50)
    monkeypatch.setattr(langid, "RESCALE", 7)
    assert np.allclose(finder.log_likelihood(without, probs), whole)


def order_of(finder, piece):
    return finder.names.index(piece)


def test_language_sample_is_bounded_per_language_and_ignores_copies(spark):
    rows = [(prose(30, i), "aa") for i in range(900)] + [("one text again and again", "aa")] * 5_000 + [(prose(30, 5_000 + i), "rare") for i in range(3)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    counts = df.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("text")).alias("texts")).collect()
    got = Counter(r["lang"] for r in langid.sampled(df, counts, 200).collect())
    assert got == {"aa": 200, "rare": 3}
    huge = [(c["lang"], c["n"], 10**14) for c in counts]  # a share of 1e-11 draws nothing here but is no zero threshold
    assert langid.sampled(df, [dict(zip(("lang", "n", "texts"), x)) for x in huge], 200).count() <= 1
    model = langid.train(df, language_rows=200, languages=1)
    assert model.languages == ["aa"] and langid.train(df, language_rows=200).languages == ["aa", "rare"]


def test_language_id_of_words_without_pieces(spark):
    rows = [(i, "ሀሁሂ" * 13 + " the and", "am" if i % 2 else "en") for i in range(40)] + [(100, "ሰ" * 39, "am"), (101, "the cat and the dog", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predict(df, langid.train(df)).collect()
    assert len(got) == 42 and all(r["lang_pred"] in ("am", "en") and 0 <= r["score"] <= 1 for r in got)


def test_language_scores_equal_brute_force(spark, docs):
    model = langid.train(docs)
    finder = langid.pieces(None)
    for r in langid.predict(docs, model).collect():
        if r["lang_pred"] != "und":
            words = r["text"].lower().split()
            post = model.prior + sum(finder.log_likelihood([w], model.probs)[0] for w in words)
            assert r["lang_pred"] == model.languages[int(post.argmax())] and math.isclose(r["score"], 1 / np.exp(post - post.max()).sum(), rel_tol=1e-6)


def test_language_id(spark, docs, none):
    model = langid.train(docs)
    got = by_id(langid.predict(docs, model))
    assert got[2][0]["lang_pred"] == got[4][0]["lang_pred"] == "und" and got[7][0]["lang_pred"] in model.languages
    assert all(0 <= r["score"] <= 1 for rows in got.values() for r in rows)
    assert langid.predict(none, model).count() == 0
    assert langid.train(none) is None and {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}


def test_language_id_of_texts_without_letters(spark, docs):
    rows = [(i, t) for i, t in enumerate(["½ ²", "Ⅳ", "①", "12 _ 3", "٣ 四"[:1], "!", "１"])] + [(90, "é"), (91, "1 a")]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), langid.train(docs)).collect()}
    assert all(got[i] == ("und", 0.0) for i in range(7)) and got[90][0] != "und" != got[91][0]


def test_language_id_held_out_accuracy(spark):
    from quillet.llm.queries import op8_language_id

    d = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "text")
    got = op8_language_id(spark, d).join(truth, "doc_id").where("held_out AND lang_pred <> 'und' AND length(text) > 40").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)


# 9


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, none, library):
    for chunk, overlap in ((65_536, 1_024), (64, 16), (40, 9)):
        got = by_id(bpe.encode(docs, chunk_chars=chunk, overlap=overlap))
        assert sum(map(len, got.values())) == len(ROWS)
        for i, t in texts():
            ids = library.encode_ordinary(t)
            row = {"doc_id": i, "n_tokens": len(ids), "ids_sha256": hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), "decoded_sha256": hashlib.sha256(t.encode()).hexdigest()}
            assert row in got[i], (i, chunk)
    assert bpe.encode(none).count() == 0


def test_text_without_boundaries_is_read_few_times(library, monkeypatch):
    c = bpe.Codec()
    t = "x" * 4000
    chunks = [(s, t[s : s + 40]) for s in range(0, 3980, 20)]
    read = []
    ends = c.ends
    monkeypatch.setattr(c, "ends", lambda text, *a: read.append(len(text)) or ends(text, *a))
    assert c.stitch([(s, x, ends(x, s, s + len(x) == len(t))) for s, x in chunks], len(t)) == [4000]
    assert sum(read) < 5 * len(t)


def test_stitching_is_exact(library):
    c = bpe.codec(None)
    r = random.Random(6)
    for _ in range(3000):
        t = "".join(r.choices(["a", "b", "É", "1", " ", "  ", "\n", "'s", "'re", ".", "　", "\x1c", "\x85", "語", "🙂", "x" * 9, " " * 7], k=r.randint(1, 90)))
        step = r.randint(8, 20)
        overlap = r.randint(5, 12)
        starts = range(0, max(0, len(t) - overlap - 1) + 1, step)
        chunks = [(s, t[s : s + step + overlap]) for s in starts]
        ends = c.stitch([(s, x, c.ends(x, s, s + len(x) == len(t))) for s, x in chunks], len(t))
        tokens = [t[a:b] for a, b in zip([0, *ends], ends)]
        assert "".join(tokens) == t
        assert [i for x in tokens for i in library._encode_single_piece(x)] == library.encode_ordinary(t)


# 10


def test_lm(spark, docs, none):
    def tokens(t):
        return [w for w in SPACE.split(re.sub("[A-Z]", lambda m: m.group().lower(), t)) if w] + [None]

    rows = [(i, t) for i, t in texts()]
    train = [(i, t) for i, t in rows if zlib.crc32(b"" if i is None else str(i).encode()) % 10]
    c = Counter(w for _, t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    pairs = Counter(p for _, t in train for p in zip(["<s>", *tokens(t)], tokens(t)))
    states = c | Counter({"<s>": len(train)})
    got = by_id(lm.score(docs, group_bytes=5_000, slice_chars=3_000))
    for i, t in rows:
        words = tokens(t)
        p = [(c[w] + 0.1) / (n + 0.1 * (v + 1)) for w in words]
        base = sum(map(math.log10, p))
        score = sum(math.log10((pairs[s, w] + lm.MU * q) / (states[s] + lm.MU)) for s, w, q in zip(["<s>", *words], words, p))
        held = zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
        assert any(
            r["held_out"] == held and r["n_tokens"] == len(words) and r["n_known"] == sum(c[w] > 0 for w in words) and r["train_tokens"] == n
            and math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-9)
            for r in got[i]
        ), i
    assert sum(map(len, got.values())) == len(ROWS)
    assert lm.score(none).count() == 0


def test_groups_and_blocks_of_large_inputs():
    """Blocks are groups times buckets; each holds many keys (0.6 a token of six bytes) whatever the input."""
    for total in (10**9, 10**11, 10**12, 10**13, 10**14):
        groups = lm.group_count(total, 200)
        assert 0.6 * total / 6 / groups**2 > 50 and total / groups <= lm.MOST_BYTES
    assert lm.group_count(0, 4) == 4 and lm.group_count(100, 1, 30) == 4


def test_tally_merges_parts():
    r = np.random.default_rng(3)
    tally, every = lm.Tally(), Counter()
    for _ in range(5):
        keys, counts = np.unique(r.integers(0, 50, 40).astype(np.uint64), return_counts=True)
        tally.add(keys, counts.astype(np.int64))
        every.update(dict(zip(keys.tolist(), counts.tolist())))
        if r.random() < 0.5:
            tally.merge()
    tally.merge()
    assert dict(zip(tally.keys.tolist(), tally.counts.tolist())) == every and (np.diff(tally.keys.astype(np.int64)) > 0).all()
    assert len(lm.Tally().merge().keys) == 0 and lm.slices(["ab", None, "abc", "x" * 9, "d"], 4) == [(0, 2), (2, 3), (3, 4), (4, 5)]


def test_lm_deals_one_row_among_all_groups(spark):
    rows = spark.range(200_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one text").alias("text"))
    sizes = [r["count"] for r in lm.dealt(rows, "doc_id", "text", "false", 20).groupBy("part").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 11_000
    assert lm.score(rows, group_bytes=100_000).distinct().count() == 1
