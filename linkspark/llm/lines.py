"""Line dedup over levelled sorted runs of line hashes, with DataFrame functions only.

A run is a table of (h1, h2, n_docs, last_doc), bucketed and sorted by hash: for each line key that was new with a
batch, the number of the batch's documents that hold it and the largest doc_id. A new batch merge-anti-joins
the runs: what no run holds becomes a run of level 0, and the counts of keys that a run holds already
are set apart as updates. So a key is in one run only, and its totals are its row there plus its updates, without
grouping the runs. When a level has `fanout` runs they are compacted into one of the next level. Runs share
their buckets, so neither the joins with them nor compaction shuffles a run.

Skew: keys are counted with map-side partial aggregation, and the join that looks lines up meets one row
a key, so a line in a third of all documents is only a large left side, which adaptive execution splits.

Defined cases: a null or empty text is one empty line; a null doc_id is one document, below all others;
rows equal in doc_id count as one document, and each row loses its own lines; an empty table gives an
empty result; other columns are kept by `dedup` and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm.common import WS_CHARS, ascii_lower, bucketed, on_key, read, row_key, small, text_of, written

LEAST_CHARS, LEAST_DOCS, BATCHES, FANOUT = 20, 3, 4, 2


def line_key(line: Column) -> Column:
    return F.btrim(line, F.lit(WS_CHARS))


def long_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """_d, _th, pos and the 128-bit hash of each line whose key has at least so many code points."""
    lines = docs.select(*row_key(docs), F.posexplode(F.split(text_of(docs), "\n", -1)).alias("pos", "line"))
    lines = lines.select("_d", "_th", "pos", line_key(F.col("line")).alias("k")).filter(F.length("k") >= least_chars)
    k = ascii_lower(F.col("k"))
    return lines.select("_d", "_th", "pos", F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(7), k).alias("h2"))


KEY = ["h1", "h2"]


class LineRuns:
    """The runs of a growing corpus; `add` takes batches whose documents are in no other batch."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels, self.updates = spark, fanout, [], []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def add(self, lines: DataFrame) -> DataFrame:
        """Adds a batch of long_lines; gives the run of its new keys."""
        own = lines.groupBy(*KEY).agg(F.countDistinct(F.struct("_d")).alias("n_docs"), F.max("_d").alias("last_doc"))
        new = own = self._bucketed(own, "line-batch")
        for i, r in enumerate(self.runs()):
            new = new.join(r.select(*KEY).hint("merge"), KEY, "left_anti")
            again = own.join(r.select(*KEY).hint("merge"), KEY, "left_semi")
            held = held.unionByName(again) if i else again
        if self.levels:
            self.updates.append(written(held, "line-updates"))
            new = self._bucketed(new, "line-run")
        self._put(new, 0)
        return new

    def _bucketed(self, df: DataFrame, name: str) -> DataFrame:
        return bucketed(df, name, self.buckets, *KEY)

    def _put(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            first, *rest = self.levels[level]
            self.levels[level] = []
            for r in rest:  # no key is in two runs, so a full merge join puts them one into the other
                r = r.withColumnsRenamed({"n_docs": "n", "last_doc": "l"})
                first = first.hint("merge").join(r, KEY, "full").select(*KEY, F.coalesce("n_docs", "n").alias("n_docs"), F.coalesce("last_doc", "l").alias("last_doc"))
            self._put(self._bucketed(first, f"line-level{level + 1}"), level + 1)

    def totals(self) -> DataFrame:
        """Each key once, with the number of its documents and the largest doc_id."""
        first, *rest = self.runs()
        for r in rest:
            first = first.unionByName(r)
        if not self.updates:
            return first
        more = self.updates[0]
        for u in self.updates[1:]:
            more = more.unionByName(u)
        more = more.groupBy(*KEY).agg(F.sum("n_docs").alias("n"), F.max("last_doc").alias("l"))
        return first.join(more, KEY, "left").select(*KEY, (F.col("n_docs") + F.coalesce("n", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "l").alias("last_doc"))


def dedup(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """docs with n_lines, n_dropped and kept (the text left), under the struct column _row and those names."""
    lines = written(long_lines(docs, least_chars).withColumn("batch", F.pmod(F.xxhash64("_d"), F.lit(batches)).cast("int")), "lines", "batch")
    runs = LineRuns(docs.sparkSession, fanout)
    for b in range(batches):
        runs.add(lines.filter(F.col("batch") == b).drop("batch"))
    # written, so that the join below has plain shuffles on both sides, whose skew adaptive execution can split
    common = written(runs.totals().filter(F.col("n_docs") >= least_docs).select(*KEY, "last_doc"), "common-lines")
    dropped = (
        lines.join(small(common), KEY).filter(~F.col("_d").eqNullSafe(F.col("last_doc")))
        .groupBy("_d", "_th").agg(F.collect_set("pos").alias("_drop"))
    )
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), *row_key(docs))
    t = F.split(F.coalesce(F.col("_row.text").cast("string"), F.lit("")), "\n", -1)
    out = on_key(keyed, dropped, "left").withColumn("_lines", t)
    out = out.withColumn("_n", F.size("_lines"))
    keep = F.array_except(F.sequence(F.lit(0), F.col("_n") - 1), F.coalesce(F.col("_drop"), F.array().cast("array<int>")))
    # _lines and _n are both read below, so the split is not repeated for each line
    kept = F.when(F.col("_drop").isNull(), F.coalesce(F.col("_row.text").cast("string"), F.lit(""))).otherwise(
        F.array_join(F.transform(keep, lambda i: F.element_at(F.col("_lines"), i + 1)), "\n"))
    return out.select("_row", F.col("_n").cast("long").alias("n_lines"), F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("_nd"), "_drop", kept.alias("kept")).select(
        "_row", "n_lines", F.when(F.col("_drop").isNull(), F.lit(0)).otherwise(F.col("_nd")).cast("long").alias("n_dropped"), "kept")


def drop_lines(docs: DataFrame, **options) -> DataFrame:
    """The columns of docs, with the text left; a document that loses every line keeps an empty text."""
    out = dedup(docs, **options)
    text = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("_row.text"))
    return out.select(*[text.alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select(F.col("_row.doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.last_doc AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
