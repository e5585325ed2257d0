"""Readers with explicit schemas, and the entity view over the driver's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.functions import text as T

SOURCE = "entity_id string, business_name string, business_address string, country string"
TRUTH = "source1_entity_id string, matched_entity_ids string"
NULL_WORDS = ("", "null", "NULL", "None")


def source_tsv(spark: SparkSession, path: str, null_words: bool = False) -> DataFrame:
    """A raw source; malformed rows fail. null_words: empty and null-like fields become null."""
    out = spark.read.csv(path, schema=SOURCE, sep="\t", header=True, mode="FAILFAST", quote="", encoding="UTF-8")
    if null_words:
        out = out.select(*[F.when(~F.col(c).isin(*NULL_WORDS), F.col(c)).alias(c) for c in out.columns])
    return out


def truth_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=TRUTH, sep="\t", header=True, quote="")


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None, view: str | None = None) -> DataFrame:
    """A Parquet file, directory or glob; columns prune the scan."""
    out = spark.read.parquet(path)
    out = out.select(*columns) if columns else out
    if view:
        out.createOrReplaceTempView(view)
    return out


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines below each file's first, as they are: a CSV reader would hide quoted empty fields. value, line (in order
    inside a file), head (the file's first line)."""
    where = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    rows = spark.read.text(path).select("value", *where, F.monotonically_increasing_id().alias("line"))
    heads = rows.filter("start = 0").groupBy("file").agg(F.min("line").alias("first"), F.min_by("value", "line").alias("head"))  # one row a file
    return rows.join(heads, "file").filter("line <> first").select("value", "line", "head")


def first_lines(spark: SparkSession, path: str) -> DataFrame:
    """head: the first line of each file that has any."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    return rows.filter("start = 0").groupBy("file").agg(F.min_by("value", "line").alias("head"))


def head(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def with_keys(df: DataFrame, normal=T.normalize) -> DataFrame:
    """Adds the normalised, compact and token columns of name and address."""
    out = df.withColumn("name_norm", normal(F.col("business_name"))).withColumn("address_norm", normal(F.col("business_address")))
    return out.select("*", *[f(F.col(f"{x}_norm")).alias(f"{x}_{k}") for x in ("name", "address") for k, f in (("compact", T.compact), ("tokens", T.tokens))])


def entities(spark: SparkSession, sf_dir: str, normal=T.normalize) -> DataFrame:
    """documents as business records of three sources: src, entity_id, the raw fields (first line, last line, language), and their keys."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    src = (F.col("doc_id") % 3 + 1).cast("int")
    t = F.trim("text")
    raw = d.select(
        src.alias("src"), F.concat(F.lit("S"), src.cast("string"), F.lit("-"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("entity_id"),
        F.split_part(t, F.lit("\n"), F.lit(1)).alias("business_name"), F.split_part(t, F.lit("\n"), F.lit(-1)).alias("business_address"), F.col("lang").alias("country"), F.col("text").alias("_text"),
    )
    return with_keys(raw, normal)
