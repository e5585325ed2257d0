"""Approximate nearest neighbours by balanced posting lists.

Centroids come from k-means on a bounded sample (SAMPLE rows with the smallest id hashes), oversize clusters
split again; every vector is indexed. A vector is listed under its nearest centroid and, at a boundary,
under up to REPLICAS - 1 further ones whose distance is within a ratio. A query walks a graph over the
centroids in memory, and takes lists in order of distance until a distance ratio prunes them; it takes
more as long as those lists hold too few vectors. Lists meet queries in chunks of bounded size on
both sides, and scores are exact cosines of the original vectors in double precision. A query that meets fewer than
k other ids that way meets all lists. Centroids are at most MOST_CENTROIDS, which bounds what is broadcast.

Skew: a list over CHUNK rows is cut into chunks, and many queries for a list into blocks, so a vector that a
third of all rows repeat fills many small tasks; equal vectors of a chunk are scored once. All vectors that are as
near as the k-th id of a chunk are scored exactly, however many tie.

Defined cases: null, zero, non-finite vectors, and vectors of another length than most, take no part; rows
that repeat a vec_id are one candidate (its best vector) and one query (its least vector, bytewise); ties go to the
smaller vec_id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkspark.llm.common import prepare, read, written

SAMPLE, LIST_ROWS, MOST_CENTROIDS, ROUNDS = 20_000, 256, 4096, 12
REPLICAS, BOUNDARY, PROBE, LEAST_FOUND = 4, 1.10, 1.35, 64
DEGREE, BEAM, CHUNK, SEED = 16, 256, 8192, 5
#: More than rounding moves a cosine of unit vectors.
MARGIN = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, with the same order of sums for equal rows."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def nearest_of(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The number of each row's nearest centroid, some rows at once."""
    return np.concatenate([np.argmax(x[i : i + 2000] @ c.T, axis=1) for i in range(0, len(x), 2000)])


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        near = nearest_of(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        lengths = np.linalg.norm(sums, axis=1)
        c = np.where(lengths[:, None] > 1e-12, sums / np.maximum(lengths, 1e-12)[:, None], x[rng.choice(len(x), k)])
    return c


def centroids(x: np.ndarray, k: int) -> np.ndarray:
    """About k unit centroids of unit rows; a cluster over twice the mean size is split again."""
    rng = np.random.default_rng(SEED)
    x = np.unique(x, axis=0)
    k = max(1, min(k, len(x)))
    c = kmeans(x, k, rng)
    near = nearest_of(x, c)
    out, mean = [], len(x) / k
    for i in range(k):
        own = x[near == i]
        if len(own) > 2 * mean and len(out) < MOST_CENTROIDS - k:
            out.extend(kmeans(own, int(np.ceil(len(own) / mean)), rng))
        else:
            out.append(c[i])
    return np.array(out)[:MOST_CENTROIDS]


class Graph:
    """A graph over centroids: each one's nearest DEGREE, with links both ways, and a few far entries."""

    def __init__(self, c: np.ndarray):
        self.c = c
        sims = c @ c.T
        k = min(DEGREE, len(c) - 1)
        near = np.argsort(-sims, axis=1)[:, 1 : k + 1] if k else np.zeros((len(c), 0), int)
        links = [set(r.tolist()) for r in near]
        for i, r in enumerate(near):
            for j in r.tolist():
                links[j].add(i)
        self.links = [np.array(sorted(s), int) for s in links]
        self.entries = np.unique(np.linspace(0, len(c) - 1, min(16, len(c))).astype(int))

    def search(self, q: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Centroids by similarity to the unit vector q, best first: (numbers, similarities)."""
        seen = np.zeros(len(self.c), bool)
        found, sims = self.entries, self.c[self.entries] @ q
        seen[found] = True
        done: set[int] = set()
        while True:
            best = np.argsort(-sims, kind="stable")[:beam]
            found, sims = found[best], sims[best]
            todo = [i for i in found.tolist() if i not in done][:8]
            if not todo:
                return found, sims
            done.update(todo)
            new = np.unique(np.concatenate([self.links[i] for i in todo])) if todo else np.zeros(0, int)
            new = new[~seen[new]]
            seen[new] = True
            found, sims = np.r_[found, new], np.r_[sims, self.c[new] @ q]


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f8").reshape(-1, dim)


def _clean(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """vec_id, v (doubles as bytes) of the rows that take part, and their dimension."""

    @F.arrow_udf("binary")
    def packed(x: pa.Array) -> pa.Array:
        out = []
        for v in x.to_pylist():
            ok = v and None not in v
            a = np.array(v, "<f8") if ok else None
            out.append(a.tobytes() if ok and np.isfinite(a).all() and 0 < np.sqrt((a * a).sum()) < np.inf else None)
        return pa.array(out, pa.binary())

    table = vectors.select(vectors[id_col].cast("long").alias("vec_id"), packed(vectors[vec_col].cast("array<double>")).alias("v"))
    table = written(table.filter("v IS NOT NULL AND vec_id IS NOT NULL"), "vectors")
    sizes = table.groupBy(F.octet_length("v").alias("b")).count().orderBy(F.desc("count"), "b").first()
    dim = sizes["b"] // 8 if sizes else 0
    return table.filter(F.octet_length("v") == dim * 8), dim


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for rows whose id is divisible by `every`, the k nearest others found."""
    spark = vectors.sparkSession
    prepare(spark)
    table, dim = _clean(vectors, id_col, vec_col)
    n = table.count()
    sample = table.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).select("v").collect() if n else []
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    c = centroids(unit(_matrix([r["v"] for r in sample], dim)), int(np.clip(n // LIST_ROWS, 1, MOST_CENTROIDS // 2)))
    shared = spark.sparkContext.broadcast(c)

    @F.arrow_udf("array<int>")
    def lists_of(v: pa.Array) -> pa.Array:
        if not len(v):
            return pa.array([], pa.list_(pa.int32()))
        d = np.sqrt(np.maximum(2 - 2 * (unit(_matrix(v.to_pylist(), dim)) @ shared.value.T), 0))
        top = np.argsort(d, axis=1, kind="stable")[:, :REPLICAS]
        near = np.take_along_axis(d, top, axis=1)
        keep = near <= near[:, :1] * BOUNDARY
        return pa.array([t[m].tolist() for t, m in zip(top, keep)], pa.list_(pa.int32()))

    posted = written(table.select("vec_id", "v", F.explode(lists_of("v")).alias("list")), "postings")
    sizes = {r["list"]: r["n"] for r in posted.groupBy("list").agg(F.count("*").alias("n")).collect()}  # one row a centroid
    graph = spark.sparkContext.broadcast((Graph(c), np.array([sizes.get(i, 0) for i in range(len(c))])))

    @F.arrow_udf("array<int>")
    def probes(v: pa.Array) -> pa.Array:
        walk, held = graph.value
        out = []
        for q in unit(_matrix(v.to_pylist(), dim)) if len(v) else []:
            found, sims = walk.search(q)
            d = np.sqrt(np.maximum(2 - 2 * sims, 0))
            upto = np.cumsum(held[found])
            take = (d <= d[0] * PROBE)
            enough = (upto - held[found]) >= LEAST_FOUND
            if upto[-1] < LEAST_FOUND:  # the walk's lists are nearly empty: take all there are
                out.append(list(range(len(held))))
            else:
                out.append(found[take | ~enough].tolist())
        return pa.array(out, pa.list_(pa.int32()))

    def scored(lists: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        rows = found_in(lists, asks, dim, k) if len(lists) and len(asks) else []
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    def met(probed: DataFrame) -> DataFrame:
        """query_id, vec_id, score: the k nearest ids, and more, of the lists that each query takes. probed: vec_id, v, list."""
        asked = {r["list"]: r["n"] for r in probed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # one row a centroid
        plan = [(i, -(-sizes[i] // CHUNK), -(-asked[i] // CHUNK)) for i in sorted(asked) if sizes.get(i)]
        cuts = F.broadcast(spark.createDataFrame(plan, "list int, chunks int, blocks int"))
        left = posted.join(cuts, "list").select("vec_id", "v", "list", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        right = probed.join(cuts, "list").select("vec_id", "v", "list", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"))
        keys = ["list", "chunk", "block"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(scored, "query_id long, vec_id long, score double")
        best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    queries = table.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    probed = written(queries.select("vec_id", "v", F.explode(probes("v")).alias("list")), "probes")
    found = written(met(probed), "found")
    whole = found.groupBy("query_id").count().filter(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    short = written(queries.join(whole, "vec_id", "left_anti"), "short-queries")
    if short.isEmpty():
        return found
    every_list = F.explode(F.array(*[F.lit(i) for i in sorted(sizes)]))
    again = met(short.select("vec_id", "v", every_list.alias("list")))
    return found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)


def found_in(lists: pd.DataFrame, asks: pd.DataFrame, dim: int, k: int) -> list[tuple[int, int, float]]:
    """(query, vec_id, score): for each query of asks the k nearest other ids of lists, ties to the smaller id."""
    lists = lists.drop_duplicates(["v", "vec_id"]).sort_values(["v", "vec_id"])
    ids, raw = lists["vec_id"].to_numpy(), lists["v"].tolist()
    first = np.flatnonzero([True, *(a != b for a, b in zip(raw, raw[1:]))])  # equal vectors are scored once
    held = np.minimum(np.diff(np.r_[first, len(raw)]), k + 1)  # more ids of one vector than that are never among the nearest
    x = _matrix([raw[i] for i in first], dim)
    u, q = unit(x), _matrix(asks["v"], dim)
    out = []
    for at in range(0, len(q), 512):
        sims = unit(q[at : at + 512]) @ u.T
        for i, query in enumerate(asks["vec_id"].to_numpy()[at : at + 512].tolist()):
            near, m = sims[i], min(len(x), k + 4)
            while True:  # until the nearest vectors hold k other ids, or all do
                least = np.partition(near, len(near) - m)[len(near) - m]
                some = np.flatnonzero(near >= least - MARGIN)
                score = cosines(np.broadcast_to(q[at + i], (len(some), dim)), x[some])
                n = held[some]
                own = ids[np.repeat(first[some] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
                score = np.repeat(score, n)
                best: dict[int, float] = {}
                for j in np.lexsort((own, -score)).tolist():
                    if len(best) == k:
                        break
                    if own[j] != query:
                        best.setdefault(int(own[j]), float(score[j]))
                if len(best) == k or len(some) == len(x):
                    break
                m = min(len(x), max(2 * m, len(some) + 1))
            out += [(query, v, s) for v, s in best.items()]
    return out


def op8_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"))
