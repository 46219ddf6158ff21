"""A training corpus from `documents`: language ID, exact and near deduplication, redaction, packing.

Each stage takes (spark, docs, sf_dir), keeps all columns of documents and works on all that its predecessor
kept; run() writes each stage's rows to the shared folder and rereads them. The last stage returns the packed
pieces. docs must be a table read from files, as run() gives it: the two deduplication stages tell repeated rows and
rows with null ids apart by their places in the files.

Defined results: a null, empty or letterless text goes in the first stage; null and repeated ids are rows of their own;
columns beside doc_id, text, lang and n_chars pass through; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.llm import exact_dedup, langid, near_dup, packing, pii
from quillet.llm.common import documents, staged

#: A language ID under this posterior rejects the document, as does a text without letters.
LEAST_SCORE = 0.5


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined."""
    model = langid.train(docs.where(langid.training_rows(F.col("doc_id"))))
    found = langid.predict(docs, model)
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def _kept(docs: DataFrame, judge: Callable[..., DataFrame]) -> DataFrame:
    """The rows of docs that the judge keeps. docs is read from Parquet, so a row's place in its file tells repeated
    rows apart; ties still go to the smallest doc_id, null ones last."""
    place = F.struct(
        F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    )
    keyed = docs.select("*", place.alias("__place"))
    dropped = judge(keyed.select("__place", "text"), id_col="__place").where(~F.col("kept")).select("__place")
    return keyed.join(dropped, "__place", "left_anti").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return _kept(docs, exact_dedup.dedup)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return _kept(docs, near_dup.classes)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked; every document stays."""
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("pii", redact),
    ("packing", pack),
]

#: Language ID, near duplicates and tokens are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
