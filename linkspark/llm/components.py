"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is one grouped minimum (partial aggregation first) and one join that meets one row a node, so a
node with very many edges is only a large left side, which adaptive execution splits. Every round is
written to the shared folder, which cuts lineage; the driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.llm.common import written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: bigint a, b. Gives (node, root), root the smallest node of its component, for nodes with an edge."""
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = written(small.select("e.*").filter("a <> b").distinct(), "edges")
        # a star forest is a fixed point, and equal sums of edge hashes mean that nothing moved
        last, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
