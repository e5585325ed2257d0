"""Ground truth, recall, F-score, profiles and the validator of result files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkspark.sources import readers

PAIR = ["source1_entity_id", "target_entity_id"]


def truth_pairs(truth: DataFrame) -> DataFrame:
    """Pairs of comma-joined lists; pieces are trimmed and empty ones dropped; a null or empty list has none."""
    out = truth.select("source1_entity_id", F.explode(F.split("matched_entity_ids", ",")).alias("t"))
    out = out.select("source1_entity_id", F.trim("t").alias("target_entity_id"))
    return out.filter(F.col("target_entity_id") != "").distinct()


def recall(found: DataFrame, truth: DataFrame, n_s1: DataFrame) -> DataFrame:
    """One row: pairs, hits, truth, recall (null without truth), s1_with_candidates, avg_candidates over all of source 1."""
    both = found.select(*PAIR).distinct().withColumn("f", F.lit(1)).join(truth.select(*PAIR).distinct().withColumn("t", F.lit(1)), PAIR, "full")
    sums = both.agg(F.count("f").alias("candidate_pairs"), F.count("t").alias("true_pairs"), F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("found_pairs"), F.countDistinct(F.when(F.col("f").isNotNull(), F.col("source1_entity_id"))).alias("s1_with_candidates"))
    total = n_s1.agg(F.countDistinct("source1_entity_id").alias("n_s1"))
    out = sums.crossJoin(F.broadcast(total))  # one row each
    div = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6))
    return out.select("candidate_pairs", "true_pairs", "found_pairs", "s1_with_candidates", div("found_pairs", "true_pairs").alias("recall"), div("candidate_pairs", "n_s1").alias("avg_candidates"))


def recall_by_target(found: DataFrame, truth: DataFrame, n_s1: DataFrame, targets: tuple[str, ...] = ("S2", "S3")) -> DataFrame:
    """recall for each prefix of target ids, in one pass over both sides."""
    both = found.select(*PAIR).distinct().withColumn("f", F.lit(1)).join(truth.select(*PAIR).distinct().withColumn("t", F.lit(1)), PAIR, "full")
    hit = F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull())
    sums = both.groupBy(F.substring_index("target_entity_id", "-", 1).alias("target")).agg(
        F.count("f").alias("candidate_pairs"), F.count("t").alias("true_pairs"), hit.alias("found_pairs"), F.countDistinct(F.when(F.col("f").isNotNull(), F.col("source1_entity_id"))).alias("s1_with_candidates"))
    every = found.sparkSession.createDataFrame([(t,) for t in targets], "target string").join(sums, "target", "left").fillna(0)
    out = every.crossJoin(F.broadcast(n_s1.agg(F.countDistinct("source1_entity_id").alias("n_s1"))))  # one row
    div = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6))
    return out.select("target", "candidate_pairs", "true_pairs", "found_pairs", "s1_with_candidates", div("found_pairs", "true_pairs").alias("recall"), div("candidate_pairs", "n_s1").alias("avg_candidates"))


def macro_f(predicted: DataFrame, truth: DataFrame, ids: DataFrame, beta: float = 0.5) -> DataFrame:
    """One row: mean F over every id; both empty gives 1, one empty or nothing right gives 0."""
    both = predicted.select(*PAIR).distinct().withColumn("p", F.lit(1)).join(truth.select(*PAIR).distinct().withColumn("t", F.lit(1)), PAIR, "full")
    per = both.groupBy("source1_entity_id").agg(F.count("p").alias("np"), F.count("t").alias("nt"), F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("hit"))
    b2 = beta * beta
    f = F.when(F.col("np").isNull() | (F.col("np") + F.col("nt") == 0), 1.0).when(F.col("hit") == 0, 0.0).otherwise((1 + b2) * F.col("hit") / (b2 * F.col("nt") + F.col("np")))
    return ids.join(per, "source1_entity_id", "left").agg(F.count("*").alias("n_s1"), F.round(F.avg(f), 6).alias("macro_f"))


def reduction(found: DataFrame, n_s1: DataFrame, n_target: DataFrame) -> DataFrame:
    """One row: share of all possible pairs that blocking does not make."""
    out = found.agg(F.count("*").alias("n_pairs")).crossJoin(F.broadcast(n_s1.agg(F.count("*").alias("n_s1")))).crossJoin(F.broadcast(n_target.agg(F.count("*").alias("n_target"))))
    return out.select("n_pairs", F.round(1 - F.col("n_pairs") / (F.col("n_s1") * F.col("n_target")), 6).alias("reduction_ratio"))


def cumulative_recall(rule_pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """(no, new_pairs, new_hits, pairs, hits) after each rule, each pair under its first one."""
    first = rule_pairs.groupBy(*PAIR).agg(F.min("no").alias("no"))
    hit = first.join(truth.select(*PAIR).distinct().withColumn("t", F.lit(1)), PAIR, "left")
    per = hit.groupBy("no").agg(F.count("*").alias("new_pairs"), F.count("t").alias("new_hits"))
    upto = Window.orderBy("no").rowsBetween(Window.unboundedPreceding, 0)  # one row a rule
    return per.select("no", "new_pairs", "new_hits", F.sum("new_pairs").over(upto).alias("pairs"), F.sum("new_hits").over(upto).alias("hits"))


def rule_benchmark(rule_pairs: DataFrame, truth: DataFrame, n_s1: DataFrame) -> DataFrame:
    """For each target and rule, and for all rules together: candidate_pairs, s1_with_candidates, true_matches_found and
    _total, recall (null without truth), avg_candidates over all of source 1."""
    target = F.substring_index("target_entity_id", "-", 1).alias("target")
    t = truth.select(*PAIR).distinct().withColumn("t", F.lit(1))
    each = rule_pairs.select("rule", *PAIR)
    both = each.unionByName(each.withColumn("rule", F.lit("COMBINED"))).distinct().join(t, PAIR, "left")
    out = both.groupBy(target, "rule").agg(F.count("*").alias("candidate_pairs"), F.countDistinct("source1_entity_id").alias("s1_with_candidates"), F.count("t").alias("true_matches_found"))
    return benchmark_rates(out, t.groupBy(target).agg(F.count("*").alias("true_matches_total")), n_s1)


def benchmark_rates(out: DataFrame, totals: DataFrame, n_s1: DataFrame) -> DataFrame:
    """The counts of each target and rule, with all true matches of the target, recall and average."""
    out = out.join(F.broadcast(totals), "target", "left").fillna(0, ["true_matches_total"])  # one row a target
    out = out.crossJoin(F.broadcast(n_s1.agg(F.countDistinct("source1_entity_id").alias("n_s1"))))  # one row
    div = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6))
    return out.select("target", "rule", "candidate_pairs", "s1_with_candidates", "true_matches_found", "true_matches_total", div("true_matches_found", "true_matches_total").alias("recall"), div("candidate_pairs", "n_s1").alias("avg_candidates"))


def covered(truth: DataFrame, *found: DataFrame) -> DataFrame:
    """Truth pairs that some candidate set holds: one semi-join to their union."""
    every = found[0].select(*PAIR)
    for f in found[1:]:
        every = every.unionByName(f.select(*PAIR))
    return truth.join(every, PAIR, "left_semi")


# ---- profiles --------------------------------------------------------------------------------------------


def null_counts(df: DataFrame) -> DataFrame:
    """(column_name, dtype, nulls), one scan."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("dtype"), F.col(c).alias("nulls")) for c, t in df.dtypes])).alias("r")).select("r.*")


def shape(df: DataFrame) -> DataFrame:
    """null_counts with the numbers of rows and columns, one scan."""
    wide = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    each = [F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("dtype"), F.col(c).alias("nulls")) for c, t in df.dtypes]
    return wide.select(F.explode(F.array(*each)).alias("r"), "_rows").select("r.*", F.col("_rows").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))


def frequency_profile(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    c = F.col(column)
    return df.groupBy(*[by] if by else []).agg(F.count("*").alias("n_rows"), F.countDistinct(c).alias("n_distinct"), F.count_if(c == "").alias("n_empty"), F.count_if(c != "").alias("n_nonempty"))


def top_values(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    return df.filter(F.col(column) != "").groupBy(F.col(column).alias("value")).agg(F.count("*").alias("freq")).orderBy(F.desc("freq"), "value").limit(n)


def summary(df: DataFrame, column: str) -> DataFrame:
    """count, nulls, mean, std, min, exact quartiles, max."""
    c = F.col(column)
    q = [F.round(F.percentile(c, p), 6).alias(n) for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    return df.agg(F.count(c).alias("n"), F.count_if(c.isNull()).alias("nulls"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev(c), 6).alias("std"), F.min(c).cast("double").alias("min"), *q, F.max(c).cast("double").alias("max"))


# ---- validation ------------------------------------------------------------------------------------------


def parse_lines(lines: DataFrame) -> DataFrame:
    """value -> id, ids, has_tab: the id before the first tab, and the pieces between commas after it, as they are; none if
    all after the tab is blank. Only lines without a tab can be blank, and those are left out."""
    v = F.regexp_replace("value", "[\r\n]+$", "")
    blank = lambda c: ~F.col(c).rlike(r"\S")
    tab = F.instr("value", "\t") > 0
    out = lines.select(v.alias("value")).withColumn("has_tab", tab).filter(~(blank("value") & ~F.col("has_tab")))
    out = out.withColumn("rest", F.when(F.col("has_tab"), F.expr("substring(value, instr(value, '\t') + 1)")))
    ids = F.when(F.col("has_tab") & ~blank("rest"), F.split("rest", ",", -1)).otherwise(F.array().cast("array<string>"))
    return out.select("value", "has_tab", F.when(F.col("has_tab"), F.split_part("value", F.lit("\t"), F.lit(1))).alias("id"), ids.alias("ids"))


def findings(lines: DataFrame, required: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(check, n, examples): faults of a result file's lines below the header, with up to five sorted examples. n counts
    different offenders, and of lines without a tab all.

    required: source1_entity_id of every row that must be there; known: target_entity_id of all existing targets. Lines,
    required and known ids meet in one grouped table of (kind, x).
    """
    one = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("x"))
    target = lambda t: F.when(t.startswith("S1-"), "self_match").when(t.startswith("S2-") | t.startswith("S3-"), "target").otherwise("bad_prefix")
    repeated = F.when(F.size("ids") != F.size(F.array_distinct("ids")), F.array(one("repeated_id", F.col("id"))))
    none = F.expr("array()").cast("array<struct<kind: string, x: string>>")
    rows = F.concat(F.array(one("row", F.col("id"))), F.coalesce(repeated, none), F.transform(F.array_distinct("ids"), lambda t: F.struct(target(t).alias("kind"), t.alias("x"))))
    facts = parse_lines(lines).select(F.explode(F.when(F.col("has_tab"), rows).otherwise(F.array(one("no_tab", F.col("value"))))).alias("f")).select("f.*", F.lit(0).alias("given"))
    facts = facts.unionByName(required.select(F.lit("row").alias("kind"), F.col("source1_entity_id").alias("x"), F.lit(1).alias("given")))
    if known is not None:
        facts = facts.unionByName(known.select(F.lit("target").alias("kind"), F.col("target_entity_id").alias("x"), F.lit(1).alias("given")))
    seen = facts.groupBy("kind", "x").agg(F.count_if(F.col("given") == 0).alias("c"), F.max("given").alias("given"))
    kind, c, given = F.col("kind"), F.col("c"), F.col("given") == 1
    checks = [
        F.when(~kind.isin("row", "target"), kind), F.when((kind == "row") & (c > 1), "duplicate_row"), F.when((kind == "row") & given & (c == 0), "missing_s1"),
        F.when((kind == "row") & ~given, "unexpected_s1"), F.when((kind == "target") & ~given, "unknown_id") if known is not None else F.lit(None).cast("string"),
    ]
    values = seen.select(F.explode(F.array_compact(F.array(*checks))).alias("check"), "x", F.when(kind == "no_tab", c).otherwise(1).alias("c"))
    few = values.withColumn("r", F.row_number().over(Window.partitionBy("check").orderBy("x"))).filter("r <= 5")
    few = few.groupBy("check").agg(F.array_join(F.array_sort(F.collect_list("x")), ";").alias("examples"))
    return values.groupBy("check").agg(F.sum("c").alias("n")).join(few, "check")


def not_in_candidates(matched: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matched pairs outside the candidates: a warning only."""
    return matched.select(*PAIR).distinct().join(candidates.select(*PAIR), PAIR, "left_anti")


def validate_file(spark: SparkSession, path: str, column: str, required: DataFrame, known: DataFrame | None = None) -> dict:
    """{"passed", "errors": {check: (n, examples)}} of a file, or of a folder of files with a header each: presence, encoding and
    headers first, which end it, then the lines."""
    try:
        n = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    except AnalysisException:  # the path does not exist
        n = None
    if not n:
        return {"passed": False, "errors": {"missing_or_empty": (1, path)}}
    if not spark.read.text(path).filter(~F.is_valid_utf8("value")).isEmpty():
        return {"passed": False, "errors": {"not_utf8": (1, path)}}
    fields = F.transform(F.split("head", "\t", -1), lambda h: F.lower(F.trim(h)))
    wrong = F.when(F.instr("head", "\t") == 0, "header_no_tab").when(fields != F.array(F.lit("source1_entity_id"), F.lit(column)), "header")
    bad = readers.first_lines(spark, path).select("head", wrong.alias("wrong")).filter("wrong IS NOT NULL").orderBy("wrong", "head").first()
    if bad:
        return {"passed": False, "errors": {bad["wrong"]: (1, bad["head"])}}
    errors = {r["check"]: (r["n"], r["examples"]) for r in findings(readers.text_lines(spark, path), required, known).collect()}
    return {"passed": not errors, "errors": errors}


def quick_check(lines: DataFrame) -> DataFrame:
    """One row: rows, pairs, rows without candidates, mean list length, and the first faulty line with its fault (null if none).
    lines: value and line, their order. A field that is wholly in quotes counts as what is in them. On a line the
    number of columns comes first, then the prefix of its id, a repeated target, and the prefixes of the targets."""
    plain = lambda f: F.when(f.rlike('^".*"$') & (F.length(f) > 1), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f)
    rows = lines.select("line", F.transform(F.split(F.regexp_replace("value", "[\r\n]+$", ""), "\t", -1), plain).alias("f"), (F.col("value") == "").alias("blank"))
    rows = rows.select("line", F.when(F.col("blank"), 0).otherwise(F.size("f")).alias("n"), F.get("f", F.lit(0)).alias("id"), F.get("f", F.lit(1)).alias("rest"))
    rows = rows.withColumn("ids", F.when(F.coalesce("rest", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split("rest", ",", -1)))
    bad = F.exists("ids", lambda x: ~(x.startswith("S2-") | x.startswith("S3-")))
    fault = (
        F.when(F.col("n") != 2, "columns").when(~F.col("id").startswith("S1-"), "s1_prefix")
        .when(F.size("ids") != F.size(F.array_distinct("ids")), "repeated_id").when(bad, "target_prefix")
    )
    first = F.min(F.when(fault.isNotNull(), F.struct("line", fault.alias("fault")))).alias("first")
    sums = rows.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.size("ids")), F.lit(0)).cast("long").alias("n_pairs"), F.count_if(F.size("ids") == 0).alias("n_empty"), first)
    return sums.select("n_rows", "n_pairs", "n_empty", F.col("first.line").alias("first_line"), F.col("first.fault").alias("first_fault"), F.when(F.col("n_rows") > 0, F.round(F.col("n_pairs") / F.col("n_rows"), 6)).alias("avg_candidates"))
