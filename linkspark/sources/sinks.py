"""Writers: Parquet, candidate lists and templates as TSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def finished(spark: SparkSession, path: str) -> bool:
    """If a writer has completed this output."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_parquet(df: DataFrame, path: str, resume: bool = False, bucket: tuple[int, str] | None = None) -> None:
    """zstd Parquet; resume keeps a finished output as it is and writes an unfinished one again. bucket: (number, key) writes
    a table for co-located joins."""
    if resume and finished(df.sparkSession, path):
        return
    w = df.write.mode("overwrite").option("compression", "zstd")
    if bucket:
        w.bucketBy(*bucket).sortBy(bucket[1]).option("path", path).saveAsTable(path.rstrip("/").rsplit("/", 1)[-1])
    else:
        w.parquet(path)


def keep_table(df: DataFrame, name: str, temporary: bool = True) -> DataFrame:
    """df under a name that SQL can use, in place of what had it: a view of this session, or a table that stays."""
    if temporary:
        df.createOrReplaceTempView(name)
    else:
        df.write.mode("overwrite").option("compression", "zstd").saveAsTable(name)
    return df.sparkSession.table(name)


def report(results: DataFrame) -> DataFrame:
    """(target, rule, block): the lines of each result of a rule benchmark as text; a recall without truth is 0."""
    whole = lambda c: F.format_number(F.col(c), 0)
    lines = [
        F.concat_ws(" / ", "target", "rule"), F.concat(F.lit("  candidate pairs: "), whole("candidate_pairs")), F.concat(F.lit("  S1 with candidates: "), whole("s1_with_candidates")),
        F.concat(F.lit("  true matches found: "), whole("true_matches_found")), F.concat(F.lit("  true matches total: "), whole("true_matches_total")),
        F.format_string("  recall: %.4f%%", F.coalesce("recall", F.lit(0.0)) * 100), F.format_string("  avg candidates/S1: %.2f", "avg_candidates"),
    ]
    return results.select("target", "rule", F.concat_ws("\n", *lines).alias("block"))


def write_report(results: DataFrame, path: str, title: str = "BLOCKING BENCHMARK") -> None:
    """The report as text, a heading and a block for each result (a few rows), in one file."""
    blocks = report(results).select(F.concat(F.col("target"), F.col("rule")).alias("at"), F.concat("block", F.lit("\n")).alias("value"))
    head = results.sparkSession.createDataFrame([("", f"{title}\n{'=' * 70}\n")], "at string, value string")
    head.unionByName(blocks).coalesce(1).sortWithinPartitions("at").select("value").write.mode("overwrite").text(path)


def id_lists(ids: DataFrame, pairs: DataFrame, column: str = "candidate_entity_ids") -> DataFrame:
    """One row for each id of source 1 (column source1_entity_id), with its sorted, comma-joined targets, '' if none."""
    lists = pairs.groupBy("source1_entity_id").agg(F.array_join(F.array_sort(F.collect_set("target_entity_id")), ",").alias(column))
    return ids.join(lists, "source1_entity_id", "left").select("source1_entity_id", F.coalesce(column, F.lit("")).alias(column))


def empty_template(ids: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    return ids.select("source1_entity_id", F.lit("").alias(column))


def write_tsv(df: DataFrame, path: str) -> None:
    """Sorted by the first column, with a header; empty fields are written empty, not as quotes."""
    df.orderBy(df.columns[0]).write.mode("overwrite").csv(path, sep="\t", header=True, emptyValue="", quote="")
