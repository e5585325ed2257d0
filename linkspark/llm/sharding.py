"""Sharding along a Hilbert curve over quantised metadata, with DataFrame functions only.

Four dimensions of 4 bits (MD5 of source, MD5 of language, logarithm of the size, place of doc_id
between the least and the largest) make at most 65,536 cells. Cells are ordered by curve index, rows of a
cell by an MD5 of the row, and the ordered rows are cut into runs of equal count (law `rows`), so a shard's
files hold a compact box of each dimension. Equal texts with equal metadata become neighbours; a group
may still be cut, since no shard may hold more rows than another.

Defined cases: a null text has size 1 and the crc32 of no bytes; null source, language or doc_id are
values of their own; rows equal in all columns are ordered among each other at random but deterministically
by content; an empty table gives an empty result; other columns are ignored by `assign`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm.common import on_key, read, row_key, text_of, written
from linkspark.llm.hilbert import with_hilbert
from linkspark.llm.ranking import positions

SHARDS, BITS, DIMS = 8, 4, ("_q0", "_q1", "_q2", "_q3")


def assign(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and the key _d, _th of every row."""
    side = 1 << bits
    digits = lambda c, a, n: F.conv(F.substring(c, a, n), 16, 10).cast("long")
    kind = lambda c: digits(F.md5(F.coalesce(docs[c].cast("string"), F.lit("")).cast("binary")), 1, 8) % side if c in docs.columns else F.lit(0).cast("long")
    text = F.md5(text_of(docs).cast("binary"))
    row = F.md5(F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.lit(":"), text))
    narrow = docs.select(
        *row_key(docs), (F.octet_length(text_of(docs)) + 1).cast("long").alias("size"), F.crc32(text_of(docs).cast("binary")).alias("text_crc32"),
        kind("source").alias("_q0"), kind("lang").alias("_q1"), digits(row, 1, 5).alias("_salt"), digits(row, 6, 15).alias("_tie"),
    )
    narrow = written(narrow, "shard-rows")
    seen = narrow.agg(F.count("*"), F.min("_d"), F.max("_d")).first()
    n, low, high = seen[0], seen[1] or 0, seen[2] or 0
    width = float(max(1, high - low + 1))
    grain = F.coalesce(F.floor((F.col("_d") - low).cast("double") / width * side).cast("long"), F.lit(0))
    rows = (
        narrow.withColumn("_q2", F.least(F.floor(F.log2("size")), F.lit(side - 1)).cast("long"))
        .withColumn("_q3", F.least(F.greatest(grain, F.lit(0)), F.lit(side - 1)))
        .withColumn("_cell", F.col("_q0") * side**3 + F.col("_q1") * side**2 + F.col("_q2") * side + F.col("_q3"))
        .withColumnRenamed("_cell", "cell").drop(*DIMS)
    )

    def on_curve(cells: DataFrame) -> DataFrame:
        for i, d in enumerate(DIMS):
            cells = cells.withColumn(d, F.floor(F.col("cell") / side ** (3 - i)) % side)
        return with_hilbert(cells, list(DIMS), bits, "_place")

    placed = positions(rows, "cell", ["_tie"], index=on_curve, cells_bounded=side**4 <= 65536)
    shard = F.expr(f"cast((_at * {shards}) div {max(n, 1)} as int)")
    slot = F.col("_at") - F.expr(f"(cast(_s as bigint) * {n} + {shards - 1}) div {shards}")
    return placed.withColumn("_s", shard).select(F.col("_d").alias("doc_id"), "_d", "_th", "size", "text_crc32", F.col("_s").alias("shard"), slot.cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Writes docs partitioned by shard, sorted by slot: each file of a shard covers a compact part of the metadata. Rows equal
    in doc_id and text stay together, in the first shard that holds one. Slots are range-partitioned, so a shard is
    written by many tasks."""
    spark = docs.sparkSession
    placed = assign(docs, **options).groupBy("_d", "_th").agg(F.min(F.struct("shard", "slot")).alias("p")).select("_d", "_th", "p.*")
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), *row_key(docs))
    out = on_key(keyed, placed, "inner").select("shard", "slot", F.col("_row").alias("row"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _curve_sql(bits: int = BITS) -> str:
    """Common table expressions c0, c1, ... that carry the coordinates x0 to x3 of each row along the curve, as `place`."""
    steps, n = [], len(DIMS)
    for b in range(bits - 1, 0, -1):
        for i in range(n):
            q, low = 1 << b, (1 << b) - 1
            swap = f"(CASE WHEN x{i} & {q} <> 0 THEN 0 ELSE xor(x0, x{i}) & {low} END)"
            first = f"xor(x0, CASE WHEN x{i} & {q} <> 0 THEN {low} ELSE {swap} END) AS x0"
            steps.append(f"* REPLACE ({first}{f', xor(x{i}, {swap}) AS x{i}' if i else ''})")
    steps += [f"* REPLACE (xor(x{i}, x{i - 1}) AS x{i})" for i in range(1, n)]
    flip = "0"
    for b in range(bits - 1, 0, -1):
        flip = f"xor({flip}, CASE WHEN x{n - 1} & {1 << b} <> 0 THEN {(1 << b) - 1} ELSE 0 END)"
    steps.append("* REPLACE (" + ", ".join(f"xor(x{i}, {flip}) AS x{i}" for i in range(n)) + ")")
    woven = " + ".join(f"((x{i} >> {b}) & 1) * {1 << (b * n + n - 1 - i)}" for b in range(bits) for i in range(n))
    steps.append(f"*, {woven} AS place")
    return ", ".join(f"c{k + 1} AS (SELECT {x} FROM c{k})" for k, x in enumerate(steps)) + f", placed AS (SELECT * FROM c{len(steps)})"


#: CRC-32 by its table of 256 entries, which the SQL makes from the polynomial.
_CRC = """tb AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
h AS (SELECT *, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM d),
e AS (SELECT doc_id, source, lang, octet_length(encode(t)) + 1 AS size, md5(coalesce(doc_id::VARCHAR, '') || ':' || m) AS r,
    xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295) AS crc FROM h, tb)"""

ORACLE = f"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t, md5(coalesce(text, '')) AS m FROM documents),
{_CRC},
b AS (SELECT count(*) AS n, min(doc_id) AS low, max(doc_id) AS high FROM e),
c0 AS (SELECT doc_id, size, crc, r, n, ('0x' || substr(md5(coalesce(source, '')), 1, 8))::BIGINT % 16 AS x0, ('0x' || substr(md5(coalesce(lang, '')), 1, 8))::BIGINT % 16 AS x1,
    least(floor(log2(size)), 15)::BIGINT AS x2, least(floor((doc_id - low)::DOUBLE / (high - low + 1) * 16), 15)::BIGINT AS x3 FROM e, b),
{_curve_sql()},
o AS (SELECT *, row_number() OVER (ORDER BY place, substr(r, 1, 5), substr(r, 6, 15)) - 1 AS no FROM placed),
s AS (SELECT *, (no * 8 // n)::INT AS shard FROM o)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, shard, no - (shard * n + 7) // 8 AS slot, NULL::INT AS grown_shard FROM s
"""
