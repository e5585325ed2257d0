"""Quality classifier: random Fourier features over document statistics, ridge regression, isotonic calibration.

Statistics are counts and ratios of the whole text only: labels, language, source and id never enter.
Partitions sum the normal equations of their rows; sums of a fixed FEATURES x (FEATURES + 1) matrix are merged
by row, as a stream in order of the partitions, and solved on the driver. Calibration pools adjacent violators over a histogram of raw scores with
a fixed number of bins. Every labelled row outside the held-out fold is used, and rows are weighted by class
only through their numbers.

Defined cases: null and empty texts have all-zero statistics and still get a score; a null doc_id is not
held out and has no label; several labels of a document each count; without labels every score is 0.5; an
empty table gives an empty result; repeated rows each get a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm.common import prepare, read, row_key, text_of, written
from linkspark.llm.rules import base_counts

FEATURES, BANDWIDTH, RIDGE, SEED, BINS = 256, 2.0, 1e-3, 7, 2000
STATS = ("log_bytes", "log_words", "word_bytes", "upper", "lower", "digit", "mark", "symbol", "space", "high", "newline", "line_bytes", "dup_lines", "repeats", "distinct", "top_word", "ends_marked")


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode()
    n = len(raw)
    words = raw.split()
    if not words:
        return [float(np.log1p(n)), *[0.0] * (len(STATS) - 1)]
    b = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n_words, _, symbols, dup_lines, repeats = base_counts(text)
    lines = b[10] + 1
    lower, upper, digit, high = int(b[97:123].sum()), int(b[65:91].sum()), int(b[48:58].sum()), int(b[128:].sum())
    space = int(b[32] + b[9:14].sum())
    marks = int(b[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum())
    kinds: dict[bytes, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    ends = sum(c for w, c in kinds.items() if w[-1] < 128 and not w[-1:].isalnum())
    return [
        float(np.log1p(n)), float(np.log1p(n_words)), min(20.0, (n - space) / n_words) / 10, upper / n, lower / n, digit / n, marks / n, symbols / n, space / n, high / n, int(b[10]) / n * 10,
        float(np.log1p(n / lines)), dup_lines / lines, repeats / n_words, len(kinds) / n_words, max(kinds.values()) / n_words, ends / n_words,
    ]


def stats_table(docs: DataFrame) -> DataFrame:
    """_d, _th and the array x of statistics of every row."""
    prepare(docs.sparkSession)

    @F.arrow_udf("array<double>")
    def stats(texts: pa.Array) -> pa.Array:
        return pa.array([statistics(t) for t in texts.to_pylist()], pa.list_(pa.float64()))

    return docs.select(*row_key(docs), stats(text_of(docs)).alias("x"))


class Model:
    """Standardised statistics -> random Fourier features -> ridge score -> calibrated probability."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, 1 / BANDWIDTH, (len(mean), FEATURES - 1)) / np.sqrt(len(mean) / 4)
        self.b = rng.uniform(0, 2 * np.pi, FEATURES - 1)
        self.beta, self.knots, self.values = None, np.array([0.0]), np.array([0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.sqrt(2 / (FEATURES - 1)) * np.cos(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w + self.b)
        return np.hstack([z, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.beta is None:
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0.0, 1.0)


def isotonic(at: np.ndarray, total: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: places and non-decreasing rates."""
    pools: list[list[float]] = []
    for x, n, y in sorted(zip(at.tolist(), total.tolist(), ones.tolist())):
        pools.append([x, x, n, y])
        while len(pools) > 1 and pools[-2][3] * pools[-1][2] >= pools[-1][3] * pools[-2][2]:
            _, end, n2, y2 = pools.pop()
            pools[-1][1:] = [end, pools[-1][2] + n2, pools[-1][3] + y2]
    knots = [k for lo, hi, _, _ in pools for k in ((lo,) if lo == hi else (lo, hi))]
    values = [y / n for lo, hi, n, y in pools for _ in range(1 if lo == hi else 2)]
    return np.array(knots), np.array(values)


def _batches(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in it:
        if batch.num_rows:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(STATS))
            yield x, batch.column("y").to_numpy(zero_copy_only=False).astype(float)


def fit(train: DataFrame) -> Model:
    """train: x (array of statistics), y (0 or 1)."""
    stats = train.select([f(F.col("x")[i]).alias(f"{n}{i}") for i in range(len(STATS)) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([stats[f"m{i}"] or 0.0 for i in range(len(STATS))])
    scale = np.array([max(stats[f"s{i}"] or 0.0, 1e-3) for i in range(len(STATS))])
    model = Model(mean, scale)
    sent = train.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("i", pa.int32()), ("part", pa.int32()), ("row", pa.binary())])

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES, FEATURES + 1))
        for x, y in _batches(it):
            z = sent.value.features(x)
            total += z.T @ np.column_stack([z, y])
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(range(FEATURES), pa.int32()), pa.array([part] * FEATURES, pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], schema=schema)

    def added(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in it:
            for i, row in zip(batch.column("i").to_pylist(), batch.column("row").to_pylist()):
                total[i] = total.get(i, 0) + np.frombuffer(row)
        yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int32()), pa.array([-1] * len(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], schema=schema)

    types = "i int, part int, row binary"
    rows = train.mapInArrow(sums, types).repartition("i").sortWithinPartitions("i", "part").mapInArrow(added, types).collect()
    if not rows:
        return model
    both = np.stack([np.frombuffer(r["row"]) for r in sorted(rows)])
    a, b = both[:, :FEATURES], both[:, FEATURES]
    n = a[-1, -1]
    if n == 0:
        return model
    model.beta = np.linalg.solve(a + RIDGE * n / FEATURES * np.eye(FEATURES), b)
    sent = train.sparkSession.sparkContext.broadcast(model)
    out = pa.schema([("bin", pa.int32()), ("y", pa.float64())])

    def placed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y in _batches(it):
            at = np.clip(np.rint(sent.value.raw(x) * BINS), -BINS, 2 * BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(y)], schema=out)

    bins = train.mapInArrow(placed, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect()
    model.knots, model.values = isotonic(*(np.array([float(r[c]) for r in bins]) for c in ("bin", "n", "y")))
    model.knots = model.knots / BINS
    return model


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """_d, _th, held_out, score and predicted of every row of docs; labels: doc_id, quality."""
    table = written(stats_table(docs).withColumn("held_out", held_out(F.col("_d"))), "stats")
    marks = labels.select(labels["doc_id"].cast("long").alias("_l"), labels["quality"].cast("int").alias("y")).filter("y IN (0, 1)")
    train = table.filter(~F.col("held_out")).join(marks, F.col("_d") == F.col("_l")).select("x", "y")
    train = written(train, "train")
    sent = docs.sparkSession.sparkContext.broadcast(fit(train))

    @F.arrow_udf("double")
    def scored(x: pa.Array) -> pa.Array:
        if not len(x):
            return pa.array([], pa.float64())
        return pa.array(sent.value.score(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), len(STATS))))

    out = table.withColumn("score", scored("x"))
    return out.select("_d", "_th", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, read(spark, sf_dir, "labels")).select(F.col("_d").alias("doc_id"), "held_out", "score", "predicted")
