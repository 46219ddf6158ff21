"""The segmented index: additions, deletions and merges against one made at once; what prefixes of postings are read."""

import random
import threading

import duckdb
import pytest
from pyspark.sql import functions as F

from quillet.functions import text
from quillet.operators import index, search
from quillet.plans import searching
from quillet.sources import storage

DATA = "/root/testdata/sf0.001"
ASKED = [("the",), ("the", "and"), ("la", "de", "el"), ("of", "nowhere"), ()]


def answers(made, asked=ASKED):
    return {t: sorted(map(tuple, made.matches(t).collect()), key=str) for t in asked}


def listing(spark, path):
    return {(r["path"], r["modificationTime"], r["length"]) for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime", "length").collect()}


def test_additions_equal_an_index_made_at_once(spark, tmp_path):
    rows = searching.articles(spark.read.parquet(f"{DATA}/documents.parquet"))
    path = f"file://{tmp_path}/grown"
    index.add(rows.where("id % 2 = 0"), path)
    before = listing(spark, path)
    index.add(rows.where("id % 2 = 1"), path)
    changed = rows.where("id % 10 = 3").withColumn("content", F.concat(F.lit("the the and la nowhere "), "title")).withColumn("title", F.lit("and the new"))
    index.add(changed, path, deleted=rows.where("id % 17 = 1").select("id"))
    assert before <= listing(spark, path)  # what was written stays as it is
    last = rows.join(changed.select("id"), "id", "left_anti").where("id % 17 <> 1").unionByName(changed)
    index.add(last, f"file://{tmp_path}/whole")
    grown, whole = index.Index(spark, path), index.Index(spark, f"file://{tmp_path}/whole")
    assert len(grown.segments) == 3 and grown.n == whole.n == last.count() and grown.means == pytest.approx(whole.means)
    want = answers(whole)
    assert answers(grown) == want and want[("the", "and")] and not want[()]
    df = lambda made: {r["term"]: list(r["holding"]) for r in made.frequencies().where(F.exists("holding", lambda x: x != 0)).collect()}
    assert df(grown) == df(whole)
    columns = sorted(grown.documents.columns)
    assert sorted(map(str, grown.documents.select(columns).collect())) == sorted(map(str, whole.documents.select(columns).collect()))
    assert index.merge(spark, path, 2)
    merged = index.Index(spark, path)
    assert len(merged.segments) < 3 and answers(merged) == want and df(merged) == df(whole)
    scanned = {r["id"]: r["score"] for r in search.matches(last, ("the", "and")).collect()}
    assert {i: pytest.approx(s, abs=2e-6) for i, _, _, s in want[("the", "and")]} == scanned


def test_all_rows_deleted(spark, tmp_path):
    rows = searching.articles(spark.read.parquet(f"{DATA}/documents.parquet")).limit(9).cache()
    path = f"file://{tmp_path}/gone"
    index.add(rows, path)
    index.add(rows.limit(0), path, deleted=rows.select("id"))
    made = index.Index(spark, path)
    assert made.n == 0 and made.matches(("the",)).count() == 0 and made.top(("the",), 5).count() == 0 and made.documents.count() == 0


@pytest.fixture(scope="module")
def common(spark, tmp_path_factory):
    """20,000 documents with a very common word, in two segments, the second of longer documents."""
    r = random.Random(2)
    rows = [(i, " ".join(r.choices(["the" if i % 5 else "a", "of" if i % 3 else "b", *(f"w{j}" for j in range(50))], [20, 6, *[1] * 50], k=r.randint(20, 60 + i // 200)))) for i in range(20_000)]
    df = spark.createDataFrame(rows, "id long, content string").repartition(4)
    whole = df.select("id", F.md5("content").alias("url"), F.lit("s").alias("source_id"), F.when(F.col("id") % 2 == 0, "feed").otherwise("sitemap").alias("origin"), *[F.lit("").alias(c) for c in ("author", "title", "summary", "topics", "published")], "content")
    path = f"file://{tmp_path_factory.mktemp('common')}"
    index.add(whole.where("id < 12000"), path)
    index.add(whole.where("id >= 12000"), path)
    return index.Index(spark, path)


def blocks_read(made, term):
    mine = made.postings.where(F.col("term") == term)
    read = sum(mine.where((F.col("segment") == s) & (F.col("block") <= b)).count() for (s, t), b in made.cuts.items() if t == term)
    return read / mine.count()


@pytest.mark.parametrize("terms,most", [(("the",), 0.5), (("of",), 0.5), (("the", "w7"), 1.0), (("the", "of"), 1.0), (("w1", "w2", "w3"), 1.0)])
@pytest.mark.parametrize("k,origin", [(60, ""), (20, "sitemap")])
def test_top_reads_prefixes(spark, common, terms, most, k, origin):
    want = sorted((-r["score"], r["id"]) for r in common.matches(terms, origin).collect())[:k]
    got = sorted((-r["score"], r["id"]) for r in common.top(terms, k, origin, 16 * k).collect())
    assert [i for _, i in got] == [i for _, i in want] and [s for s, _ in got] == pytest.approx([s for s, _ in want], abs=2e-6)
    assert sorted((-r["score"], r["id"]) for r in common.top(terms, k, origin).collect()) == got
    common.top(terms, k, origin, 16 * k)
    assert blocks_read(common, terms[0]) < most or most == 1.0


def test_records_are_made_once(spark, tmp_path):
    folder = f"file://{tmp_path}/records"
    assert storage.newest(spark, folder) == (0, None)
    told = []
    threads = [threading.Thread(target=lambda i=i: told.append(storage.commit(spark, folder, 1, f"payload {i}"))) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sum(told) == 1
    (tmp_path / "records" / "_half").write_text("unfinished")
    number, payload = storage.newest(spark, folder)
    assert number == 1 and payload.startswith("payload") and not storage.commit(spark, folder, 1, "late") and storage.commit(spark, folder, 2, "next")
    assert storage.newest(spark, folder) == (2, "next")


def test_request_numbers_never_raise():
    for raw in ("--5", "²", "٣", "1e3", " 5", "5 ", "+", "-", "", "9" * 5000, "0x10", "1_0", "-1", "+7", "007"):
        for name in ("limit", "offset"):
            told = search.parse_request({"q": "a", name: raw})
            assert isinstance(told, str) == (raw not in ("", "+7", "007"))


def test_bounds_hold_at_other_means():
    r = random.Random(4)
    pairs = [(r.randint(1, 30), r.randint(1, 400)) for _ in range(200)]
    at = lambda mean: max(index.saturation(tf, n, mean) for tf, n in pairs)
    stored = [at(100 * g) for g in index.GRID]
    for factor in (0.01, 0.25, 0.3, 0.7, 1.0, 1.01, 1.5, 3.9, 4.0, 9.0):
        bound = sum(a * b for a, b in zip(index.between(factor), stored))
        assert at(100 * factor) <= bound + 1e-9 and (bound <= 1.15 * at(100 * factor) or not 0.25 <= factor <= 4)


def test_words_are_counted_in_parts_of_bounded_bytes():
    import pyarrow as pa

    texts = ["x" * n for n in (10, index.SLICE, 5, 0, index.SLICE // 2, index.SLICE // 2, index.SLICE * 3, 7)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts), pa.array([""] * 8)], names=["id", "a", "b"])
    parts = list(index._slices(batch, 1))
    assert sum((p.column(0).to_pylist() for p in parts), []) == list(range(8)) and len(parts) > 3
    assert all(sum(map(len, p.column(1).to_pylist()[1:])) <= index.SLICE for p in parts)
    assert list(index._slices(batch.slice(0, 0), 1)) == []


def test_postings_of_a_slice_travel_by_buckets(spark, tmp_path, monkeypatch):
    """A term that fills several buckets is found whole, and a slice sends one row a bucket, not one a posting."""
    rows = searching.articles(spark.read.parquet(f"{DATA}/documents.parquet"))
    index.add(rows, f"file://{tmp_path}/one")
    monkeypatch.setattr(index, "BUCKET", 999)
    index.add(rows, f"file://{tmp_path}/many")
    one, many = index.Index(spark, f"file://{tmp_path}/one"), index.Index(spark, f"file://{tmp_path}/many")
    assert answers(one) == answers(many)
    assert sorted(map(str, one.entries().collect())) == sorted(map(str, many.entries().collect()))
    sent = []
    whole = type(rows).repartition
    monkeypatch.setattr(type(rows), "repartition", lambda self, *by: sent.append(self) or whole(self, *by))
    stored = spark.read.parquet(f"file://{tmp_path}/one/{one.segments[0]['name']}/documents")
    index._postings(stored, "s", one.means, one.n, 1)
    assert len(sent) == 1 and sent[0].count() <= stored.rdd.getNumPartitions() < one.entries().count() / 1000


def shuffled(spark):
    """Bytes that all stages have written to shuffles so far."""
    sc, jvm = spark.sparkContext, spark._jvm
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_all_postings_are_counted_where_texts_lie(spark, monkeypatch):
    """No index is written for them, and nothing but the documents' ids is shuffled."""
    monkeypatch.setattr(index, "add", None)
    monkeypatch.setattr(storage, "made_once", None)
    assert searching.postings_index(spark, DATA).distinct().count() == searching.postings_index(spark, DATA).count() > 50_000
    before = shuffled(spark)
    searching.postings_index(spark, DATA).write.format("noop").mode("overwrite").save()
    assert shuffled(spark) - before < 100 * spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_postings_of_ids_that_several_rows_share_are_summed(spark, tmp_path):
    few = [(1, "The  the\u00a0end. Caf\u00e9 CAF\u00c9", "en", "a"), (1, "the end of the end", "en", "a"), (2, None, "fr", None), (None, "la la", "es", "b"), (None, "la", "es", "b"), (3, "", None, "b"), (4, "x " * 50 + "the", "en", "the"), (5, "\u2003- \u2014 -\u3000", "en", "c")]
    spark.createDataFrame(few, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = con.sql(f"SELECT term, field, id, tf FROM ({searching.ORACLES['postings_index']})").fetchall()
    got = searching.postings_index(spark, f"file://{tmp_path}").select("term", "field", "id", "tf").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and ("the", "content", 1, 4) in want
    alone = spark.createDataFrame(few[5:6], "doc_id long, text string, lang string, source string")
    assert [tuple(r) for r in index.entries(searching.articles(alone)).collect()] == [("b", "author", 3, 1)]
    assert index.entries(searching.articles(alone.limit(0))).collect() == []


def test_blank_and_ink_are_white_space_and_its_opposite(spark):
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([("".join(chars[i : i + 4096]),) for i in range(0, len(chars), 4096)], "s string")
    for one, other in ((text.WS, text._BLANK), ("[^" + text.WS[1:], text._INK)):
        kept = [F.regexp_replace("s", c, "") for c in (one, other)]
        assert rows.where(kept[0] != kept[1]).count() == 0 and rows.where(kept[0] != F.col("s")).count() > 0


def test_words_of_documents_that_stay_are_not_moved(spark, tmp_path, monkeypatch):
    """Where ids are too many to be broadcast, only rows that die or have a hash like theirs are shuffled with their words."""
    rows, path = searching.articles(spark.read.parquet(f"{DATA}/documents.parquet")), f"file://{tmp_path}/moved"
    index.add(rows, path)
    number, state = index.state_of(spark, path)
    stored = sum(p.stat().st_size for p in (tmp_path / "moved").glob("*/documents/*.parquet"))
    ids = rows.select("id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        sent = {}
        for step in (0, 20, 1):
            before = shuffled(spark)
            after = index._bury(spark, path, state, ids.where(f"id % {step} = 3" if step > 1 else f"{step} = 1"))
            sent[step] = shuffled(spark) - before
            want = {r["id"] for r in ids.collect() if step == 1 or step and r["id"] % step == 3}
            dead = index._dead(spark, path, after)
            assert (set() if dead is None else {r["id"] for r in dead.collect()}) == want
        assert sent[0] < stored / 10 and sent[20] < stored / 2 < sent[1]
        # one bit is set for all: everything is likely, and is found by the join
        monkeypatch.setattr(index, "MARKS", 64)
        after = index._bury(spark, path, state, ids.where("id % 20 = 3"))
        assert {r["id"] for r in index._dead(spark, path, after).collect()} == {r["id"] for r in ids.collect() if r["id"] % 20 == 3}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
