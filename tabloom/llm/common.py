"""Shared plumbing: reading tables, shared-folder paths, materialising, shipping code."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of every contract: space and \t \n \v \f \r.
WS_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path goes to Spark's reader only, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """Folder that the driver and every executor see.

    It is ``spark.checkpoint.dir`` where the cluster names one.  Only where
    that is unset (tests, local mode) a folder of our own is made.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    own = getattr(spark, "_tabloom_shared", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="tabloom-")
        spark._tabloom_shared = own
    return own


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_root(spark)}/tabloom-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    Unlike a cache it survives lost executors and gives the next plan real
    sizes, from which Spark decides by itself whether a side may be broadcast.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Name of a row's key.
ROW = "__row"


def keyed(docs: DataFrame) -> DataFrame:
    """The rows, written with a key of their own (a long, the part above) that every later reading of them sees."""
    return written(docs.withColumn(ROW, F.monotonically_increasing_id()), "keyed")


def row_key(docs: DataFrame) -> Column | None:
    """A key of each row that every reading gives again, if ``docs`` is a plain Parquet table: digest of the file's path, place in the file."""
    plan = docs._jdf.queryExecution().analyzed()
    if plan.nodeName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return None
    if plan.relation().fileFormat().getClass().getSimpleName() != "ParquetFileFormat":
        return None
    place = docs.metadataColumn("_metadata")
    return F.concat(F.unhex(F.md5(place["file_path"].cast("binary"))), F.unhex(F.lpad(F.hex(place["row_index"]), 10, "0")))


def without(docs: DataFrame, decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``docs`` without the rows whose keys ``decide`` gives as ``__gone``.

    ``decide`` gets doc_id, text and the key, so identifiers may be null or
    repeat and other columns may have any name.  A Parquet table is not copied:
    its rows are known by their places; anything else is written first.  Only
    the keys of rows that go are joined: Spark sends them to every task if they
    are few and shuffles otherwise.
    """
    if row_key(docs) is None:
        docs = written(docs, "input")
    key = row_key(docs).alias(ROW)
    gone = decide(docs.select("doc_id", "text", key))
    whole = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("all"), key)
    return whole.join(gone, F.col(ROW) == F.col("__gone"), "left_anti").select("all.*")


def dropped(found: DataFrame, group: list[str], kept: Column) -> DataFrame:
    """Keys of the rows that go, as ``__gone``; of several rows of a group that ``kept`` holds for, the smallest key stays."""
    stay = found.where(kept)
    ties = stay.groupBy(*(F.col(c).alias("__" + c) for c in group)).agg(F.min(ROW).alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col("__" + c)) for c in group))
    extra = stay.join(ties, same).where(F.col(ROW) != F.col("__first"))
    return written(found.where(~kept).select(F.col(ROW).alias("__gone")).unionByName(extra.select(F.col(ROW).alias("__gone"))), "gone")


#: Most keys that ``join_counted`` may broadcast.
HOT_KEYS = 4096


def join_counted(rows: DataFrame, groups: DataFrame, key: str, counts: str, total: int) -> DataFrame:
    """``rows`` left join ``groups`` on ``key``, where ``counts`` says how many rows each key has (``total`` in all).

    Keys of more rows than total / HOT_KEYS are HOT_KEYS at most: they are
    broadcast, so that their rows never meet in one task.  The rest is left to Spark.
    """
    bound = max(1024, -(-total // HOT_KEYS))
    hot = groups.where(F.col(counts) > bound)
    mine = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.where(F.col(counts) <= bound), key, "left")
    return mine.unionByName(rest)


def input_bytes(df: DataFrame) -> int:
    """Bytes that the leaves of a plan read, as far as Spark knows them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60)  # what has no size says 2^63 - 1


def file_parts(df: DataFrame, target: int = 128 << 20) -> int:
    """Parts for files of about ``target`` bytes of input at most, and not fewer than ``spark.sql.shuffle.partitions``."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // target))


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch path through Hadoop, whatever store it lies in."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, and let Arrow batches suit long texts."""
    for key, usual, ours in (("maxRecordsPerBatch", "10000", "2000"), ("maxBytesPerBatch", "67108864b", "16777216b")):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key, None) == usual:  # a choice of the user's stays
            spark.conf.set(key, ours)
    if getattr(spark, "_tabloom_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    out = os.path.join(tempfile.mkdtemp(prefix="tabloom-code-"), "tabloom_code.zip")
    Path(out).write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(out)
    spark._tabloom_shipped = True


def short_batches(spark: SparkSession) -> None:
    """Let Parquet's batches suit long texts: 4,096 of them are arrays of 14 to 28 MB a task, which make an executor's heap grow."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    if spark.conf.get(key) == "4096":  # a choice of the user's stays
        spark.conf.set(key, "256")


def whole_text(col: str = "text") -> Column:
    """Text with null counted as empty."""
    return F.coalesce(F.col(col), F.lit(""))
