"""The shared folder, and things that are made once from files and again only when the files change."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillet.sources import documents as src


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not spark.sparkContext.getCheckpointDir():
        import tempfile

        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quillet-"))
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/quillet-{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written in the shared folder and read back: what several plans use is made once, and survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, keys: list[str], order: list, out: str) -> DataFrame:
    """The rows with their place, from 1, among those of equal keys, by an order; no task holds all rows of a key.

    Rows are dealt by ranges of keys and order and stored with their range; places inside a range are a window of that
    range, and the sizes of the ranges before, one row a key and range, are added.
    """
    dealt = rows.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id())
    stored = staged(dealt, "numbered")
    sizes = stored.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    earlier = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = stored.withColumn("__r", F.row_number().over(W.partitionBy(*keys, "__part").orderBy(*order)))
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__{i}"))
    return inside.join(before, same).withColumn(out, (F.col("__r") + F.col("__before")).cast("int")).select(*rows.columns, out)


def signature(spark: SparkSession, path: str) -> tuple[int, int]:
    """Number and digest of the names, times and sizes of the files below a path; contents are not read."""
    listed = src.files(spark, path, contents=False)
    row = listed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("path", "modificationTime", "length")), F.lit(0)).alias("h")).first()
    return row["n"], row["h"]


class Reloaded:
    """What load() makes of a path's files, made again only when they changed; a path that can't be probed is read anew."""

    def __init__(self, spark: SparkSession, path: str, load: Callable):
        self.spark, self.path, self.load = spark, path, load
        self.seen, self.value, self.loads = None, None, 0

    def get(self):
        try:
            now = signature(self.spark, self.path)
        except Exception:  # a failed probe is no reason to keep an old value
            now = None
        if now is None or now != self.seen:
            self.value, self.seen = self.load(self.path), now
            self.loads += 1
        return self.value


_made: dict[tuple[str, str, str], Reloaded] = {}


def made_once(spark: SparkSession, label: str, path: str, load: Callable):
    """One Reloaded a session, label and path."""
    key = (spark.sparkContext.applicationId, label, path)
    if key not in _made:
        _made[key] = Reloaded(spark, path, load)
    return _made[key].get()


def commit(spark: SparkSession, folder: str, number: int, payload: str) -> bool:
    """Make the payload the folder's record of that number; False if there is one already, whoever wrote it.

    The record is written whole under another name and renamed only where none is: a reader finds it whole or not at all,
    and of two writers one is told. A crash before the rename leaves nothing but a name that no reader looks at.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, fresh = hadoop.Path(f"{folder}/{number:012d}.record"), hadoop.Path(f"{folder}/_{uuid.uuid4().hex}")
    conf = spark._jsc.hadoopConfiguration()
    fs = target.getFileSystem(conf)
    fs.mkdirs(target.getParent())
    if fs.exists(target):
        return False
    out = fs.create(fresh)
    out.write(bytearray(payload, "utf-8"))
    out.close()
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        hadoop.FileContext.getFileContext(fs.makeQualified(target).toUri(), conf).rename(fs.makeQualified(fresh), fs.makeQualified(target), options)
    except Exception:
        fs.delete(fresh, False)
        if fs.exists(target):
            return False
        raise
    return True


def newest(spark: SparkSession, folder: str) -> tuple[int, str | None]:
    """Number and payload of the folder's last record; 0 and None where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return 0, None
    names = [x.getPath().getName() for x in fs.listStatus(path)]
    numbers = [int(n.removesuffix(".record")) for n in names if n.endswith(".record") and not n.startswith((".", "_"))]
    if not numbers:
        return 0, None
    return max(numbers), src.text_value(spark, f"{folder}/{max(numbers):012d}.record")
