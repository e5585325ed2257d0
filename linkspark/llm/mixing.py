"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Each document draws u in (0, 1] from its id and gets the exponential key -ln(u) / quality. A source's
target is k whole epochs and a rest; the rest goes to the documents with the smallest keys, by prefix
sums of their sizes. What the prefix leaves open is filled from the FILL documents that come next, in key
order and up to FILL_PASSES times over, by those that still fit.

The end of a prefix is found by two histograms of each source's own keys: one of fixed steps of the key's
logarithm, and one that cuts its bin at the boundary into FINE parts. Only a histogram's bins are prefix-summed, a bounded
number for each source, and only the documents of the last bin at the boundary are sorted row by row (some millionth
of a source, whatever its qualities), so a source with a third of all rows needs no task of its own.

Defined cases: a null or empty text has size 0 and is never taken beyond that; a null source is a source,
ordered last; a null doc_id draws by its text; rows equal in doc_id, text and source are one unit that is taken together; other columns
are kept by `mix` and may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkspark.llm.common import n_words, read, row_key, small, text_of, written

WEIGHTS, TOTAL_SHARE, CAP, SEED = (5, 2, 1), 1.5, 2, 42
#: Bins of the key for each power of two, and parts of the bin at the boundary.
STEPS, FINE = 64, 4096
FILL, FILL_PASSES = 256, 3


def quality_weight(text: Column, size: Column) -> Column:
    """Falls with the number of mark-up symbols a word: 1 without any."""
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return F.lit(1.0) / (F.lit(1.0) + symbols.cast("double") / F.greatest(size, F.lit(1)).cast("double"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=TOTAL_SHARE, cap=CAP) -> DataFrame:
    """sizes: source, source_size. Adds weight and target: the weighted share, at most cap times the size.

    Water filling: with sources by cap * size / weight, the level is that of the first source that its share
    does not fill. One row a source goes through one task.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (rank % len(weights) + 1).cast("int"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    full = F.col("source_size") * cap
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum(full).over(before), F.lit(0))) / F.sum("weight").over(onward)
    return (
        sizes.withColumn("weight", w)
        .withColumn("_level", level)
        .withColumn("_level", F.min(F.when(F.col("_level") * F.col("weight") <= full, F.struct(F.col("source_size") / F.col("weight"), F.col("_level").alias("l")))).over(everything)["l"])
        .withColumn("target", F.least(full.cast("double"), F.coalesce(F.col("_level") * F.col("weight"), full.cast("double"))))
        .drop("_level")
    )


def _edges(bins: DataFrame, base: str, fill: int, last: str) -> DataFrame:
    """For each source, from its bins (_src, rest, bin, n, sum) in order: the first bin `low` whose sums exceed rest, the bin
    `high` with `fill` documents after that, and the sum `last` of all bins before the first. base: the sum before all bins."""
    run = Window.partitionBy("_src").orderBy("bin")
    at = bins.withColumn("_upto", F.col(base) + F.sum("sum").over(run)).withColumn("_rows", F.sum("n").over(run))
    at = at.withColumn("_low", F.min(F.when(F.col("_upto") > F.col("rest"), F.struct("bin", "_rows", (F.col("_upto") - F.col("sum")).alias("s")))).over(Window.partitionBy("_src")))
    enough = F.min(F.when(F.col("_rows") >= F.col("_low._rows") + fill, F.col("bin")))
    return at.groupBy("_src", "rest", "_low").agg(F.coalesce(enough, F.max("bin")).alias("high")).select(F.col("_src").alias("_esrc"), F.col("_low.bin").alias("low"), "high", F.col("_low.s").alias(last))


def _with(rows: DataFrame, edges: DataFrame) -> DataFrame:
    return rows.join(small(edges), rows["_src"].eqNullSafe(edges["_esrc"]), "left").drop("_esrc")


def plan(docs: DataFrame, weights=WEIGHTS, share=TOTAL_SHARE, cap=CAP, seed=SEED, quality=quality_weight, steps: int = STEPS, fine: int = FINE) -> DataFrame:
    """A row for each unit: _d, _th, source, size, rows, source_size, target, copies (times it is taken)."""
    base = docs.select(*row_key(docs), docs["source"].cast("string").alias("source"), n_words(docs["text"]).alias("size"), text_of(docs).alias("_t"))
    base = base.select("_d", "_th", "source", "size", quality(F.col("_t"), F.col("size")).alias("_q"))
    units = written(base.groupBy("_d", "_th", "source").agg(F.first("size").alias("each"), F.first("_q").alias("_q"), F.count("*").alias("rows")), "mix-units")
    name = F.coalesce(F.col("_d").cast("string"), F.concat(F.lit("text "), F.col("_th").cast("string")))
    u = (F.conv(F.substring(F.md5(F.concat(name, F.lit(f":{seed}"))), 1, 12), 16, 10).cast("double") + 1) / F.lit(float(1 << 48))
    units = units.withColumn("size", F.col("each") * F.col("rows")).withColumn("_key", -F.log(u) / F.col("_q"))
    per = source_targets(units.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    per = (
        per.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumnRenamed("source", "_src").drop("weight")
    )
    per = written(per, "mix-sources")
    place = F.log2(F.greatest("_key", F.lit(1e-300))) * steps
    dealt = units.join(small(per), units["source"].eqNullSafe(per["_src"])).withColumn("_place", place).withColumn("bin", F.floor("_place"))
    sums = (F.count("*").alias("n"), F.sum("size").alias("sum"))
    coarse = dealt.groupBy("_src", "rest", "bin").agg(*sums).withColumn("_none", F.lit(0))
    dealt = _with(dealt, written(_edges(coarse, "_none", FILL, "_before"), "mix-edges"))
    # a source without a boundary has nothing to sample: its rest is 0 because its size is
    inside = F.coalesce(F.col("bin").between(F.col("low"), F.col("high")), F.lit(False))
    clear = dealt.filter(~inside).withColumn("extra", F.coalesce(F.col("bin") < F.col("low"), F.lit(False)) & (F.col("rest") > 0))
    finer = F.floor((F.col("_place") - F.col("low")) / (F.col("high") - F.col("low") + 1) * fine)
    near = dealt.filter(inside).withColumn("bin", finer).drop("low", "high")
    near = _with(near, written(_edges(near.groupBy("_src", "rest", "bin", "_before").agg(*sums), "_before", FILL, "_base"), "mix-fine-edges"))
    inside = F.col("bin").between(F.col("low"), F.col("high"))
    sides = near.filter(~inside).withColumn("extra", (F.col("bin") < F.col("low")) & (F.col("rest") > 0))
    # the documents at the boundary of each source, row by row
    whole = Window.partitionBy("source")
    order = whole.orderBy("_key", "_d", "_th").rowsBetween(Window.unboundedPreceding, 0)
    last = near.filter(inside).withColumn("_c", F.col("_base") + F.sum("size").over(order))
    last = last.withColumn("extra", (F.col("_c") <= F.col("rest")) & (F.col("rest") > 0))
    last = last.withColumn("_left", F.col("rest") - F.col("_base") - F.sum(F.when(F.col("extra"), F.col("size")).otherwise(0)).over(whole))
    last = last.withColumn("_may", ~F.col("extra") & (F.count_if(~F.col("extra")).over(order) <= FILL) & (F.col("rest") > 0))
    for _ in range(FILL_PASSES):
        fits = F.col("_may") & ~F.col("extra") & (F.col("size") <= F.col("_left"))
        last = last.withColumn("_c", F.when(fits, F.sum(F.when(fits, F.col("size")).otherwise(0)).over(order)))
        last = last.withColumn("_new", F.coalesce(F.col("_c") <= F.col("_left"), F.lit(False)))
        last = last.withColumn("_left", F.col("_left") - F.sum(F.when(F.col("_new"), F.col("size")).otherwise(0)).over(whole))
        last = last.withColumn("extra", F.col("extra") | F.col("_new")).drop("_new")
    few = ["_d", "_th", "source", F.col("each").alias("size"), "rows", "source_size", "target", (F.col("epochs") + F.col("extra").cast("long")).alias("copies")]
    return clear.select(*few).unionByName(sides.select(*few)).unionByName(last.select(*few))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it: whole epochs, then the sampled rest."""
    taken = plan(docs, **options).filter("copies > 0").select("_d", "_th", F.col("source").alias("_s"), "copies")
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), *row_key(docs), docs["source"].cast("string").alias("_source"))
    t = taken.withColumnsRenamed({"_d": "_rd", "_th": "_rth"})
    out = keyed.join(t, keyed["_d"].eqNullSafe(t["_rd"]) & (keyed["_th"] == t["_rth"]) & keyed["_source"].eqNullSafe(t["_s"]))
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = plan(read(spark, sf_dir, "documents"))
    out = out.select(F.col("_d").alias("doc_id"), "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rows")
    return out.select("*", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).drop("rows", "col")


_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
k AS (SELECT doc_id, source, size,
    -ln((('0x' || substr(md5(doc_id::VARCHAR || ':42'), 1, 12))::BIGINT::DOUBLE + 1) / 281474976710656.0)
      / (1.0 / (1.0 + (length(t) - length(translate(t, '#*$%&|<>', '')))::DOUBLE / greatest(size, 1)::DOUBLE)) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM k GROUP BY source),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2 * source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM s),
m AS (SELECT (SELECT lv FROM l WHERE lv * w <= 2 * source_size ORDER BY source_size / w, lv LIMIT 1) AS lv),
t AS (SELECT source, source_size, least(2.0 * source_size, coalesce(m.lv * w, 2.0 * source_size))::DOUBLE AS target FROM l, m),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
b AS (SELECT k.doc_id, k.source, k.size, k.key, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS UNBOUNDED PRECEDING) AS c FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source),
x AS (SELECT *, rest > 0 AND c <= rest AS x FROM b),
n0 AS (SELECT *, rest - sum(CASE WHEN x THEN size ELSE 0 END) OVER (PARTITION BY source) AS lft,
    NOT x AND rest > 0 AND sum((NOT x)::INT) OVER (PARTITION BY source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) <= 256 AS may FROM x),
@PASSES@
SELECT doc_id, source, size, source_size, target, (epochs + x::INT) * size AS taken FROM n@LAST@
"""
_PASS = """b{k} AS (SELECT *, may AND NOT x AND size <= lft AS fits FROM n{k}),
c{k} AS (SELECT *, fits AND sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) <= lft AS new FROM b{k}),
n{n} AS (SELECT * EXCLUDE (x, lft, fits, new), x OR new AS x, lft - sum(CASE WHEN new THEN size ELSE 0 END) OVER (PARTITION BY source) AS lft FROM c{k})"""
ORACLE = _SQL.replace("@PASSES@", ",\n".join(_PASS.format(k=k, n=k + 1) for k in range(FILL_PASSES))).replace("@LAST@", str(FILL_PASSES))
