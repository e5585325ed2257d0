"""Blocking of arriving target records against a fixed source 1, as a stream.

Frequency caps are global and hold for each target source on its own, so each micro-batch counts its keys together
with those of earlier batches, which are kept as a Parquet table of (no, key, src, n) increments. Pairs that an earlier
batch made are not appended again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.operators import blocking


def block_stream(targets: DataFrame, s1: DataFrame, rules: list[blocking.Rule], out: str, counts: str, checkpoint: str, available_now: bool = True):
    """Starts a query that appends candidate pairs of each micro-batch of targets to `out`.

    A key leaves the candidates once its target count passes the cap; pairs made before stay, which a
    final `blocking.pairs` over all rows removes.
    """
    spark: SparkSession = targets.sparkSession
    left = blocking.keys(s1, rules)
    n1 = left.groupBy("no", "key").agg(F.count("*").alias("n1"))

    def batch(df: DataFrame, number: int) -> None:
        k = blocking.keys(df, rules)
        k.groupBy("no", "key", "src").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{counts}/batch={number}")
        seen = spark.read.parquet(counts).filter(F.col("batch") <= number).groupBy("no", "key", "src").agg(F.sum("n").alias("n2"))
        a, b = left.join(n1, ["no", "key"]), k.join(seen, ["no", "key", "src"])
        a = a.filter(F.coalesce(F.col("n1") <= F.col("cap"), F.lit(True))).select("no", "key", F.col("id").alias("source1_entity_id"), F.col("country").alias("c1"))
        b = b.filter(F.coalesce(F.col("n2") <= F.col("cap"), F.lit(True))).select("no", "key", "same", F.col("id").alias("target_entity_id"), F.col("country").alias("c2"))
        met = a.join(b, ["no", "key"]).filter(~F.col("same") | (F.col("c1") == F.col("c2")))
        met = met.select("source1_entity_id", "target_entity_id").distinct()
        if number:  # a repeated batch only looks at those before it
            before = spark.read.schema("source1_entity_id string, target_entity_id string, batch int").parquet(out).filter(F.col("batch") < number)
            met = met.join(before, ["source1_entity_id", "target_entity_id"], "left_anti")
        met.write.mode("overwrite").parquet(f"{out}/batch={number}")

    w = targets.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
