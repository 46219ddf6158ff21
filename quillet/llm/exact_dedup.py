"""Exact deduplication by distributed MSD radix partitioning.

Texts without white space are compared by their UTF-8 bytes. The first level splits all rows by their leading
bytes; each further level splits every group that is left by the next, longer run of bytes, together with
whether the text ends there. A group that is a single row is settled, and so is one whose texts have ended:
its members agreed in every byte, so equality needs no digest. Only rows of unsettled groups go on to the next
level, so most texts leave after a few bytes.

Group sizes and the best row of each group are aggregated before the shuffle, one row per group and task, written,
and joined back to the rows by a merge join at every size. Being read again, that table brings a plain shuffle to the
join, so a hot group is a skewed key that Spark splits, never one task's state.

Defined results: a null text counts as empty; all empty texts are one group; of equal texts the row with most
code points in its original text stays, then the smallest id (null ids last), then the first stored row, so
rows with repeated ids keep exactly one; an empty table gives an empty table; only the id and text columns are
read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.llm.common import SPACE_CLASS, staged, unstage

FIRST_BYTES = 32
#: Each level's digit is this many times longer than the one before.
WIDEN = 16


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_bytes: int = FIRST_BYTES, widen: int = WIDEN) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (of the text without white space)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = df.select(
        F.col(id_col).alias("id"),
        F.char_length(text).alias("chars"),
        F.regexp_replace(text, SPACE_CLASS + "+", "").cast("binary").alias("body"),
    )
    rows = bare.select("*", F.substring("body", 1, first_bytes).alias("digit"))
    shared = staged(rows.groupBy("digit").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digit").alias("shared")), "digits1")
    first = staged(
        rows.join(shared.hint("merge"), rows["digit"] == shared["shared"], "left").select(
            F.monotonically_increasing_id().alias("rid"),
            "id",
            "chars",
            F.sha2("body", 256).alias("text_sha256"),
            F.col("shared").alias("gid"),
            F.when(F.col("shared").isNotNull(), F.col("body")).alias("body"),
        ),
        "radix1",
    )
    unstage(shared)
    settled = [
        first.where(F.col("gid").isNull()).select(
            "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
        )
    ]
    open_rows = first.where(F.col("gid").isNotNull())
    at, width, level = first_bytes, first_bytes * widen, 2
    while not open_rows.isEmpty():
        keyed = open_rows.select(
            "*", F.substring(F.col("body"), F.lit(at + 1), F.lit(width)).alias("digit"), (F.octet_length("body") <= at + width).alias("ended")
        )
        best = F.struct((-F.col("chars")).alias("chars"), F.col("id").isNull().alias("no_id"), F.col("id"), F.col("rid"))
        groups = staged(keyed.groupBy("gid", "digit", "ended").agg(F.count(F.lit(1)).alias("n"), F.min(best).alias("best")), f"digits{level}")
        split = staged(
            keyed.join(groups.hint("merge"), ["gid", "digit", "ended"]).select(
                "rid",
                "id",
                "chars",
                "text_sha256",
                F.col("best.id").alias("keep_id"),
                F.col("best.rid").alias("keep_rid"),
                "n",
                (F.col("ended") | (F.col("n") == 1)).alias("settled"),
                F.when(~(F.col("ended") | (F.col("n") == 1)), F.col("body")).alias("body"),
            ),
            f"radix{level}",
        )
        unstage(groups)
        settled.append(
            split.where("settled").select(
                "id", "keep_id", F.col("n").cast("long").alias("group_size"), (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256"
            )
        )
        open_rows = split.where("NOT settled").select(
            "rid", "id", "chars", "text_sha256", F.col("keep_rid").cast("string").cast("binary").alias("gid"), "body"
        )
        at, width, level = at + width, width * widen, level + 1
    result = settled[0]
    for part in settled[1:]:
        result = result.unionByName(part)
    return result.withColumnRenamed("id", id_col)


DEDUP_SQL = r"""
    WITH d AS (
        SELECT doc_id, length(coalesce(text, '')) AS chars,
               regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body
        FROM documents),
    g AS (SELECT body, count(*) AS n, arg_min(doc_id, (-chars, doc_id)) AS keep_id FROM d GROUP BY body)
    SELECT doc_id, keep_id, n AS group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
    FROM d JOIN g USING (body)"""
