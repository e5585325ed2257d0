"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here: space and U+0009 to U+000D.
WS_CHARS = " \t\n\x0b\x0c\r"
WS_CLASS = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A broadcast side has at most so many rows; they are counted before.
BROADCAST_ROWS = 50_000


def prepare(spark: SparkSession) -> None:
    """Session settings that bound Arrow batches, and the import path of Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own if all run on
    this machine; else tables would be lost on other machines' disks, and it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the executors of {master} share")
        at = f"file://{tempfile.mkdtemp(prefix='linkspark-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/linkspark/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def written(df: DataFrame, name: str, partition_by: str | None = None, path: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, and later reads prune its columns."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    w = df.write.option("compression", "zstd")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    schema = df.schema
    return spark.read.schema(schema).parquet(path)


def bucketed(df: DataFrame, name: str, buckets: int, *keys: str) -> DataFrame:
    """df as a table bucketed and sorted by its keys, a file a bucket: joins and groups by them need not shuffle it again."""
    path = new_path(df.sparkSession, name)
    table = "linkspark_" + path.rsplit("/", 1)[1].replace("-", "_")
    w = df.repartition(buckets, *keys).write.option("compression", "zstd").option("path", path)
    w.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a written table that nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to have at most so many rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def text_of(docs: DataFrame, default: bool = True) -> Column:
    c = docs["text"].cast("string")
    return F.coalesce(c, F.lit("")) if default else c


def n_words(text: Column) -> Column:
    """Number of runs of characters other than white space; null counts 0."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, WS_CLASS))).cast("long")


def row_key(docs: DataFrame) -> list[Column]:
    """What identifies a row of documents: its id and a hash of its text. Rows equal in both share a result."""
    return [docs["doc_id"].cast("long").alias("_d"), F.xxhash64(text_of(docs)).alias("_th")]


def on_key(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join by the row key, null ids included; the right side's key columns are dropped."""
    r = right.withColumnsRenamed({"_d": "_rd", "_th": "_rth"})
    out = left.join(r, (left["_d"].eqNullSafe(r["_rd"])) & (left["_th"] == r["_rth"]), how)
    return out if how in ("left_semi", "left_anti") else out.drop("_rd", "_rth")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
