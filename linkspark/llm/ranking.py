"""Gapless global positions without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkspark.llm.common import small, written

#: Rows that share a cell are dealt by a salt into parts of about so many rows.
PART_ROWS, SALTS = 4096, 1 << 20


def positions(rows: DataFrame, cell: str, ties: list[str], weight: str | None = None, index=None, cells_bounded: bool = False) -> DataFrame:
    """rows with _at, the sum of weights (1 each, if none) of all rows before, ordered by cell, salt and ties.

    rows has a column _salt in [0, SALTS), from a hash of each row, so that a cell with a third of all rows
    splits into parts. cell is a bigint column; `index` may replace a cell's place by another one (a function
    from the table of cells, with column `cell`, to that table with column _place). Only (cell, part)
    totals are prefix-summed in one task: one row for about PART_ROWS rows. cells_bounded: the number of
    cells has a bound small enough to broadcast them.
    """
    w = F.col(weight) if weight else F.lit(1)
    cells = rows.groupBy(cell).agg(F.count("*").alias("_n"))
    cells = index(cells) if index else cells.withColumn("_place", F.col(cell))
    cells = written(cells.select(F.col(cell).alias("_cell"), "_place", F.ceil(F.col("_n") / PART_ROWS).cast("long").alias("_parts")), "cells")
    dealt = rows.join(F.broadcast(cells) if cells_bounded else small(cells), rows[cell] == cells["_cell"]).drop("_cell")
    dealt = dealt.withColumn("_part", F.floor(F.col("_salt") * F.col("_parts") / SALTS).cast("long")).drop("_parts")
    sums = dealt.groupBy("_place", "_part").agg(F.sum(w).alias("_w"))
    before = Window.orderBy("_place", "_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("_place").alias("_p"), F.col("_part").alias("_q"), F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_place", "_part").orderBy("_salt", *ties).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(starts, (dealt["_place"] == starts["_p"]) & (dealt["_part"] == starts["_q"])).drop("_p", "_q")
    return out.withColumn("_at", F.col("_start") + F.coalesce(F.sum(w).over(inside), F.lit(0))).drop("_start", "_part")
