"""SimHash near-dedup with pivot distance tables.

Fingerprints are made in Arrow batches. Distinct fingerprints are then linked: bits fall into `blocks`
blocks, and two fingerprints within `radius` bits agree in at least blocks - radius of them, so each is
routed once for every choice of agreeing blocks (pigeonhole; this only decides which pairs meet). There are
more blocks the more fingerprints there are, so that about BUCKET of them at most agree by chance. Inside
such a bucket every fingerprint has a row of a pivot table, its Hamming distances to PIVOTS reference
fingerprints; a pair whose rows differ by more than `radius` in any coordinate cannot be within `radius`
(triangle inequality) and is discarded, and survivors are verified by exact distance. Buckets give a
spanning forest of their links, never all pairs: a fingerprint that has been reached is not compared again.

Skew: equal fingerprints are one row before routing; a bucket over SPLIT rows is routed again by blocks of
its other bits, which loses no pair. Links, components and fingerprints stay distributed.

Defined cases: a null or empty text has fingerprint zero and links like any other; fewer words than a
shingle make one shingle; a null doc_id has the fingerprint of its text and counts as larger than any id;
repeated rows each get a result; an empty table gives an empty result; other columns are kept by `keep_first`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkspark.llm.common import on_key, prepare, read, row_key, text_of, written
from linkspark.llm.components import components

SHINGLE, SEED, RADIUS, PIVOTS, SPLIT, BUCKET = 4, 42, 4, 16, 50_000, 16
#: Reference fingerprints: multiples of an odd constant, mixed.
_REF = (np.arange(1, PIVOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (np.arange(1, PIVOTS + 1, dtype=np.uint64) << np.uint64(40))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()  # of bytes: A-Z only, and exactly the white space of the contract
    n = len(words)
    if not n:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= shingle:
        hashes = [digest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = np.array(hashes[at : at + 4096], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """_d, _th and the 64-bit fingerprint fp (as a signed bigint) of every row."""
    prepare(docs.sparkSession)

    @F.arrow_udf("bigint")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t or b"", shingle) for t in texts.to_pylist()], np.uint64).view(np.int64))

    return docs.select(*row_key(docs), prints(text_of(docs).cast("binary")).alias("fp"))


def _choices(bits: list[int], blocks: int, radius: int) -> list[int]:
    """A bit mask for each way to choose the blocks that agree."""
    cuts = np.array_split(np.array(bits), blocks)
    return [sum(1 << int(b) for c in chosen for b in c) for chosen in combinations(cuts, blocks - radius)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _routes(prints: DataFrame, masks: list[int], name: str) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)])
    return prints.select("*", F.explode(arr).alias(name))


def _bucket_links(key_of_rows: np.ndarray, fp: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning links inside runs of equal keys; rows sorted by key."""
    n = len(fp)
    if n < 2:
        return []
    out = []
    table = np.stack([np.bitwise_count(fp ^ p) for p in _REF]).astype(np.int8)
    starts = np.flatnonzero(np.r_[True, key_of_rows[1:] != key_of_rows[:-1]])
    sizes = np.diff(np.r_[starts, n])
    few = np.repeat(sizes <= 32, sizes)
    for step in range(1, int(min(32, sizes.max()))):
        i = np.flatnonzero(few[:-step] & (key_of_rows[:-step] == key_of_rows[step:]))
        for row in table:  # discard by the coordinates of the pivot table, then verify
            if not len(i):
                break
            i = i[np.abs(row[i] - row[i + step]) <= radius]
        i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= radius]
        if len(i):
            out.append((fp[i], fp[i + step]))
    for s, size in zip(starts[sizes > 32], sizes[sizes > 32]):
        order = s + np.argsort(table[0, s : s + size], kind="stable")
        left = order  # not reached yet, by distance to the first pivot
        while len(left):
            todo, left = [left[0]], left[1:]
            while todo and len(left):
                at = todo.pop()
                d = table[0, left]
                a, b = np.searchsorted(d, (table[0, at] - radius, table[0, at] + radius + 1))
                near = np.arange(a, b)
                for row in table[1:]:
                    if len(near) < 16:
                        break
                    near = near[np.abs(row[left[near]] - row[at]) <= radius]
                near = near[np.bitwise_count(fp[left[near]] ^ fp[at]) <= radius]
                if len(near):
                    got = left[near]
                    out.append((np.full(len(got), fp[at]), fp[got]))
                    todo.extend(got.tolist())
                    left = np.delete(left, near)
    return out


def _linked(routed: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Links (a, b) inside the groups of equal keys."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: np.ndarray, fp: np.ndarray):
            key = np.cumsum(np.r_[0, (rows[1:] != rows[:-1]).any(axis=1)]) if len(rows) else np.zeros(0)
            if links := _bucket_links(key, fp.view(np.uint64), radius):
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*links))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

        held, n = [], 0
        for batch in it:
            held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in [*keys, "fp"]], axis=1))
            n += len(held[-1])
            if n >= 100_000:  # everything but the last group, which may go on
                rows = np.concatenate(held)
                end = len(rows) - np.argmax((rows[::-1, :-1] != rows[-1, :-1]).any(axis=1)) if (rows[0, :-1] != rows[-1, :-1]).any() else 0
                yield from done(rows[:end, :-1], np.ascontiguousarray(rows[:end, -1]))
                held, n = [rows[end:]], len(rows) - end if end else 0
        if held:
            rows = np.concatenate(held)
            yield from done(rows[:, :-1], np.ascontiguousarray(rows[:, -1]))

    dealt = routed.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys, "fp")
    return dealt.mapInArrow(scan, "a bigint, b bigint")


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """Blocks that leave about BUCKET of n fingerprints, were they random, that agree in all but `radius` blocks."""
    return next(b for b in range(radius + 2, 65) if n <= BUCKET * 2.0 ** (64 * (b - radius) // b) or b == 2 * radius + 8)


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int | None = None, split: int = SPLIT) -> DataFrame:
    """Links that connect distinct fingerprints (column fp) within `radius` bits, enough for their components."""
    masks = _choices(list(range(64)), blocks or blocks_for(distinct.count(), radius), radius)
    routed = _routes(distinct.select("fp"), masks, "r").select("fp", F.col("r.t").alias("t"), F.col("r.k").alias("k"))
    hot = written(routed.groupBy("t", "k").count().filter(F.col("count") > split).select("t", "k"), "hot-buckets")
    if hot.isEmpty():
        return _linked(routed, ["t", "k"], radius)
    out = _linked(routed.join(hot, ["t", "k"], "left_anti"), ["t", "k"], radius)
    inside = routed.join(hot, ["t", "k"], "left_semi")
    for t, mask in enumerate(masks):  # the bits that do not agree by routing, cut into eight blocks
        finer = _choices([b for b in range(64) if not mask >> b & 1], radius + 4, radius)
        again = _routes(inside.filter(F.col("t") == t), finer, "r2").select("fp", "t", "k", F.col("r2.t").alias("t2"), F.col("r2.k").alias("k2"))
        out = out.unionByName(_linked(again, ["t", "k", "t2", "k2"], radius))
    return out


def groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """_d, _th, fp, root (the fingerprint that names the component) and component_id (the smallest doc_id reachable,
    null if no row of the component has an id) of every row."""
    prints = written(fingerprints(docs, shingle), "prints")
    distinct = written(prints.groupBy("fp").agg(F.min("_d").alias("first")), "distinct-prints")
    roots = components(links(distinct, radius))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp").select("_d", "_th", "fp", "root", "component_id")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The row of docs with the smallest doc_id of each group (of rows that repeat it, one)."""
    out = written(groups(docs, **options), "near-groups")
    # the id decides alone (null after all others) unless rows repeat it, and then the text's hash does
    first = out.groupBy("root").agg(F.min(F.struct(F.col("_d").isNull().alias("none"), "_d", "_th")).alias("m")).select("m._d", "m._th")
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), *row_key(docs))
    kept = on_key(keyed, first, "inner")
    copies = kept.withColumn("_n", F.row_number().over(Window.partitionBy("_d", "_th").orderBy(F.xxhash64(F.col("_row").cast("string")))))
    return copies.filter("_n = 1").select("_row.*")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = groups(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("_d").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
