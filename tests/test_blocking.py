"""Hand fixtures for keys, caps, metrics, similarities and the validator."""

import math
import random

import pytest
from pyspark.sql import functions as F

from linkspark.functions import similarity as S
from linkspark.functions import text as T
from linkspark.operators import blocking as B
from linkspark.operators import evaluation as E
from linkspark.operators import fuzzy as Z
from linkspark.sources import readers, sinks

RAW = "src int, entity_id string, business_name string, business_address string, country string"


def ents(spark, rows, normal=T.normalize):
    return readers.with_keys(spark.createDataFrame(rows, RAW), normal)


def got(df):
    return sorted((r["source1_entity_id"], r["target_entity_id"]) for r in df.collect())


def test_normalisation(spark):
    rows = [("A&B", "a and b"), ("Straße", "strasse"), ("ﬁt", "fit"), ("ＡＢＣ", "abc"), ("दुकान", "द क न"), (None, ""), ("  --  ", "")]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(rows)], "i int, a string")
    out = [r["n"] for r in df.select("i", T.normalize_unicode(F.col("a")).alias("n")).orderBy("i").collect()]
    assert out == [b for _, b in rows]
    plain = [r["n"] for r in df.select("i", T.normalize(F.col("a")).alias("n")).orderBy("i").collect()]
    assert plain[1] == "straße" and plain[5] == ""


def test_keys(spark):
    r = spark.range(1).select(T.tokens(F.lit("acme blue acme")).alias("t"), T.name_core(F.lit("acme group")).alias("c"), T.name_core(F.lit("group")).alias("g"), T.first_word(F.lit("four word")).alias("f"), T.first_word(F.lit("fiver word")).alias("h"), T.composite(F.lit("US"), F.lit("")).alias("x"), T.composite(F.lit("US"), F.lit(""), strict=True).alias("y"), T.suffix(F.lit("abc"), 6).alias("s")).first()
    assert list(r) == ["acme blue", "acme", "group", None, "fiver", None, "US|", "abc"]


def test_empty_keys_never_pair(spark):
    rows = [(s, f"S{s}-{i}", n, None, "US") for s in (1, 2) for i, n in enumerate((None, "", "  ", "--"))]
    assert got(B.pairs(ents(spark, rows), B.R_MAIN)) == []


@pytest.mark.parametrize("n,made", [(3, 3), (4, 0)])
def test_cap_is_inclusive_and_ignores_country(spark, n, made):
    rows = [(1, "S1-0", "acme", "x", "US")] + [(2, f"S2-{i}", "acme", f"y{i}", ("US", "FR")[i % 2]) for i in range(n)]
    assert len(got(B.pairs(ents(spark, rows), [B.rule("exact_name", 1, 3)]))) == made
    same = got(B.pairs(ents(spark, rows), [B.rule("exact_name", 1, 3, True)]))
    assert len(same) == (2 if made else 0)


def test_targets_are_capped_apart_or_together(spark):
    rows = [(1, "S1-0", "acme", "x", "US"), (2, "S2-0", "acme", "y", "US"), *[(3, f"S3-{i}", "acme", "z", "US") for i in range(3)]]
    e = ents(spark, rows)
    assert got(B.pairs(e, [B.rule("exact_name", 1, 2)])) == [("S1-0", "S2-0")]
    assert got(B.pairs(e, [B.rule("exact_name", 1, 3)], "target")) == []
    assert len(got(B.pairs(e, [B.rule("exact_name", 1, 4)], "target"))) == 4


def test_null_country_never_joins_a_country_rule(spark):
    rows = [(1, "S1-0", "acmes x", "a", None), (2, "S2-0", "acmes y", "b", None), (1, "S1-1", "other x", "c", "France"), (2, "S2-1", "other y", "d", "France")]
    assert got(B.pairs(ents(spark, rows), [B.rule("first_word_country", 5, 20)])) == [("S1-1", "S2-1")]


def test_or_join_is_the_union(spark):
    rows = [(1, "S1-0", "a", "x", "US"), (2, "S2-0", "a", "y", "US"), (2, "S2-1", "b", "x", "US"), (3, "S3-0", "c", "z", "US")]
    e = ents(spark, rows)
    plan = B.any_equal(e, ["name_norm", "address_norm"])
    assert got(plan) == [("S1-0", "S2-0"), ("S1-0", "S2-1")]
    assert "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()


def test_truth_and_scores(spark):
    t = spark.createDataFrame([("S1-1", "S2-1, S3-2"), ("S1-2", ""), ("S1-3", None), ("S1-4", ",")], readers.TRUTH)
    truth = E.truth_pairs(t)
    assert got(truth) == [("S1-1", "S2-1"), ("S1-1", "S3-2")]
    pair = "source1_entity_id string, target_entity_id string"
    one = spark.createDataFrame([("S1-a", x) for x in ("S2-47", "S2-193", "S3-812")], pair)
    real = spark.createDataFrame([("S1-a", x) for x in ("S2-47", "S3-812")], pair)
    ids = spark.createDataFrame([("S1-a",)], "source1_entity_id string")
    assert round(E.macro_f(one, real, ids).first()["macro_f"], 3) == 0.714
    none = real.filter("false")
    assert E.macro_f(none, none, ids).first()["macro_f"] == 1.0
    assert E.macro_f(one, none, ids).first()["macro_f"] == 0.0
    assert E.recall(one, none, ids).first()["recall"] is None


def dp(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def test_similarities():
    rnd = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 12))) for _ in range(2))
        assert S.lcs(a, b) == dp(a, b)
    assert S.indel_ratio("ab", "ba") == 50.0
    assert round(S.indel_ratio("abc", "abd"), 2) == 66.67
    assert S.best_window_ratio("acme", "the acme shop") == 100.0
    assert S.best_window_ratio("", "a") == 0.0


def every_window(a, b):
    """Best ratio over all windows, one by one."""
    s, t = (a, b) if len(a) <= len(b) else (b, a)
    n = len(s)
    best = 0.0
    for x, y in ((s, t), (t, s))[: 2 if len(a) == len(b) else 1]:
        for i in range(1 - n, len(y)):
            w = y[max(0, i) : min(len(y), i + n)]
            best = max(best, 200.0 * dp(x, w) / (n + len(w)))
    return best


def test_window_ratio_against_every_window():
    rnd = random.Random(2)
    for _ in range(300):
        letters = rnd.choice(("ab", "abcdefgh"))
        a, b = ("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 25))) for _ in range(2))
        want = every_window(a, b)
        assert abs(S.best_window_ratio(a, b) - want) < 1e-9
        least = S.best_window_ratio(a, b, 65.0)
        assert least < 65 and want < 65 or abs(least - want) < 1e-9
        assert S.indel_ratio(a, b, 70.0) == S.indel_ratio(a, b) or S.indel_ratio(a, b) < 70
    long = "".join(rnd.choice("abcdefgh ") for _ in range(20_000))
    assert S.best_window_ratio(long[5000:15_000], long, 65.0) == 100.0


def slow_jaro_winkler(a, b):
    if a == b or not a or not b:
        return float(a == b)
    reach, used, mine = max(0, max(len(a), len(b)) // 2 - 1), set(), []
    for i, ch in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in used and b[j] == ch), None)
        if j is not None:
            used.add(j)
            mine.append(ch)
    if not mine:
        return 0.0
    m, swaps = len(mine), sum(x != b[j] for x, j in zip(mine, sorted(used))) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    start = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return jaro + min(4, start) * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def test_jaro_winkler_against_the_plain_form():
    rnd = random.Random(3)
    for _ in range(500):
        a, b = ("".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 14))) for _ in range(2))
        assert abs(S.jaro_winkler_of(a, b) - slow_jaro_winkler(a, b)) < 1e-12


def test_fuzzy_pairs_against_brute_force(spark):
    rnd = random.Random(4)
    names = ["".join(rnd.choice("abc") for _ in range(rnd.randint(3, 9))) for _ in range(60)]
    e = ents(spark, [(1 + i % 3, f"S{1 + i % 3}-{i}", n, "x", "US") for i, n in enumerate(names)])
    left = [(f"S1-{i}", n) for i, n in enumerate(names) if i % 3 == 0]
    for t in (2, 3):
        right = [(f"S{t}-{i}", n) for i, n in enumerate(names) if i % 3 == t - 1]
        for made, cut, cap, score, ratio in (
            (Z.signature_pairs(e, t, 6), lambda n: {(k, x) for k in (3, 4, 5) for x in (("p", n[:k]), ("s", n[-k:]))}, 6, 70.0, lambda a, b: 200.0 * dp(a, b) / (len(a) + len(b))),
            (Z.prefix_pairs(e, t, 6), lambda n: {(k, n[:k]) for k in (4, 5, 6) if len(n) >= k}, 6, 65.0, every_window),
        ):
            size = {}
            for _, n in right:
                for x in cut(n):
                    size[x] = size.get(x, 0) + 1
            ok = lambda n: {x for x in cut(n) if size.get(x, 0) in range(1, cap + 1)}  # noqa: E731, B023
            want = {(a, b): ratio(n, m) for a, n in left for b, m in right if ok(n) & cut(m) and ratio(n, m) >= score}
            out = {(r["source1_entity_id"], r["target_entity_id"]): r["score"] for r in made.collect()}
            assert out.keys() == want.keys() and all(abs(out[k] - want[k]) < 1e-9 for k in out)


def test_tfidf_against_brute_force(spark, monkeypatch):
    rnd = random.Random(5)
    names = ["".join(rnd.choice("abc ") for _ in range(rnd.randint(1, 12))) for _ in range(60)]
    df = spark.createDataFrame([(f"{i:02d}", n) for i, n in enumerate(names)], "id string, name string")
    grams = lambda n, k: [n[i : i + z] for z in (3, 4, 5) for i in range(len(n) - z + 1) if k is None or n[i : i + z] in k]
    target = names[20:]
    df_of = {}
    for n in target:
        for g in set(grams(n, None)):
            df_of[g] = df_of.get(g, 0) + 1
    total = {g: sum(grams(n, None).count(g) for n in target) for g in df_of}
    for most in (None, 15):
        kept = sorted((g for g in df_of if df_of[g] >= 2), key=lambda g: (-total[g], g))[:most]
        idf = {g: math.log((1 + len(target)) / (1 + df_of[g])) + 1 for g in kept}

        def vector(n):
            own = grams(n, idf)
            w = {g: (1 + math.log(own.count(g))) * idf[g] for g in own}
            norm = math.sqrt(sum(x * x for x in w.values()))
            return {g: x / norm for g, x in w.items()}

        want = {}
        for i in range(20):
            a = vector(names[i])
            sims = sorted((-round(sum(x * vector(names[j]).get(g, 0) for g, x in a.items()), 6), f"{j:02d}") for j in range(20, 60))
            want |= {(f"{i:02d}", t): -s for s, t in sims[:4] if s < 0}
        for name, few in (("ASK_BLOCK", 6), ("ROW_BLOCK", 7), ("ASKED", 2)) if most else ():
            monkeypatch.setattr(Z, name, few)
        out = {(r["source1_entity_id"], r["target_entity_id"]): r["similarity"] for r in Z.tfidf_top(df.filter("id < '20'"), df.filter("id >= '20'"), 4, max_features=most).collect()}
        assert out.keys() == want.keys() and all(abs(out[k] - want[k]) < 2e-6 for k in out)


def test_nested_prefix_buckets(spark):
    rows = [(1, "S1-0", "abcdef", "x", "US"), (2, "S2-0", "abcdeg", "x", "US"), *[(2, f"S2-{i}", f"abcdz{i}", "x", "US") for i in range(1, 4)]]
    e = ents(spark, rows)
    assert got(Z.prefix_buckets(e, cap=3)) == [("S1-0", "S2-0")]
    assert got(Z.prefix_pairs(e, cap=3)) == [("S1-0", "S2-0")]


def test_export_passes_the_validator_and_faults_are_found(spark, tmp_path):
    ids = spark.createDataFrame([("S1-1",), ("S1-2",)], "source1_entity_id string")
    pairs = spark.createDataFrame([("S1-1", "S3-2"), ("S1-1", "S2-1")], "source1_entity_id string, target_entity_id string")
    path = str(tmp_path / "out")
    sinks.write_tsv(sinks.id_lists(ids, pairs).coalesce(1), path)
    assert [r[0] for r in spark.read.text(path).collect()] == ["source1_entity_id\tcandidate_entity_ids", "S1-1\tS2-1,S3-2", "S1-2\t"]
    assert E.validate_file(spark, path, "candidate_entity_ids", ids)["passed"]
    bad = tmp_path / "bad.tsv"
    bad.write_text("source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-1,S2-1\n\nS1-1\tS1-9\nnotab\nS1-9\tX-1\nS1-3\t\"\"\n")
    errors = E.validate_file(spark, str(bad), "candidate_entity_ids", ids, pairs)["errors"]
    assert set(errors) == {"repeated_id", "duplicate_row", "self_match", "no_tab", "bad_prefix", "missing_s1", "unexpected_s1"}
    assert errors["bad_prefix"] == (2, '"";X-1')
    for text, key in (("a,b\n", "header_no_tab"), ("a\tb\n", "header"), ("", "missing_or_empty")):
        bad.write_text(text)
        assert key in E.validate_file(spark, str(bad), "candidate_entity_ids", ids)["errors"]
    assert "missing_or_empty" in E.validate_file(spark, str(tmp_path / "none"), "candidate_entity_ids", ids)["errors"]


def test_validator_on_odd_lines(spark, tmp_path):
    ids = spark.createDataFrame([("S1-1",)], "source1_entity_id string")
    head = "source1_entity_id\tcandidate_entity_ids\n"
    path = tmp_path / "x.tsv"
    for body, want in (
        ("S1-1\tS2-1,\n", {"bad_prefix"}), ("S1-1\tS2-1,,S3-1\n", {"bad_prefix"}), ("S1-1\t\n\t\n", {"unexpected_s1"}), (f"S1-1\t\n{head}", {"unexpected_s1", "bad_prefix"}), ("S1-1\tS2-1,,\n", {"bad_prefix", "repeated_id"}),
        ("S1-1\t  \n   \n\n", set()), ("S1-1\tS2-\ufffd\n", set()), ("S1-1\tS2-1\tx\n", set()), ("S1-1\t S2-1\n", {"bad_prefix"}),
    ):
        path.write_text(head + body, encoding="utf-8")
        out = E.validate_file(spark, str(path), "candidate_entity_ids", ids)
        assert set(out["errors"]) == want and out["passed"] == (not want), body
    path.write_bytes((head + "S1-1\tS2-").encode() + b"\xff\n")
    assert set(E.validate_file(spark, str(path), "candidate_entity_ids", ids)["errors"]) == {"not_utf8"}
    path.write_text("Source1_Entity_ID\t candidate_entity_ids \nS1-1\t\n")
    assert E.validate_file(spark, str(path), "candidate_entity_ids", ids)["passed"]
    many = tmp_path / "many"
    rows = spark.createDataFrame([(f"S1-{i}", "S2-1") for i in range(40)], "source1_entity_id string, candidate_entity_ids string")
    sinks.write_tsv(rows.repartition(4), str(many))
    assert E.validate_file(spark, str(many), "candidate_entity_ids", rows.select("source1_entity_id"))["passed"]


def test_quick_check_stops_at_the_first_fault(spark):
    good = "S1-1\tS2-1,S3-2"
    for lines, want in (
        ([good, "S1-2\t"], None), ([good, 'S1-2\t""'], None), ([good, ""], (1, "columns")), ([good, "S1-2"], (1, "columns")), ([good, "S1-2\tS2-1\t"], (1, "columns")),
        ([good, "X\t", "x"], (1, "s1_prefix")), ([good, "S1-2\tS2-1,S2-1"], (1, "repeated_id")), ([good, "S1-2\tS2-1,"], (1, "target_prefix")), ([good, good], None),
    ):
        r = E.quick_check(spark.createDataFrame(list(zip(lines, range(len(lines)))), "value string, line long")).first()
        assert (r["first_line"], r["first_fault"]) == (want or (None, None)) and r["n_rows"] == len(lines), lines


def test_sources(spark, tmp_path):
    text = "entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tA \"quoted\" name\t1, Main St\tUS\nS1-2\tNone\tnull\t\n"
    (tmp_path / "a.tsv").write_text(text)
    rows = readers.source_tsv(spark, str(tmp_path / "a.tsv")).collect()
    assert [r["entity_id"] for r in rows] == ["S1-1", "S1-2"] and rows[0]["business_name"] == 'A "quoted" name' and rows[0]["business_address"] == "1, Main St"
    nulls = readers.source_tsv(spark, str(tmp_path / "a.tsv"), null_words=True).collect()[1]
    assert list(nulls) == ["S1-2", None, None, None]
    (tmp_path / "bad.tsv").write_text(text + "S1-3\ttoo\tfew\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        readers.source_tsv(spark, str(tmp_path / "bad.tsv")).collect()
    (tmp_path / "t.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-2\nS1-2\t\n")
    assert got(E.truth_pairs(readers.truth_tsv(spark, str(tmp_path / "t.tsv")))) == [("S1-1", "S2-1"), ("S1-1", "S3-2")]
    df = spark.createDataFrame([(i, f"n{i}") for i in range(10)], "i int, n string")
    for part in ("p1", "p2"):
        sinks.write_parquet(df, str(tmp_path / part))
    both = readers.parquet(spark, str(tmp_path / "p*"), ["i"], view="some_view")
    assert both.columns == ["i"] and both.count() == 20 and spark.table("some_view").count() == 20
    assert "ReadSchema: struct<i:int>" in both._jdf.queryExecution().executedPlan().toString()
    assert readers.head(df, 3).count() == 3


def test_sinks(spark, tmp_path):
    a, b = (spark.createDataFrame([(x,)], "x int") for x in (1, 2))
    path = str(tmp_path / "out")
    sinks.write_parquet(a, path)
    sinks.write_parquet(b, path, resume=True)
    assert spark.read.parquet(path).first()[0] == 1
    (tmp_path / "out" / "_SUCCESS").unlink()
    sinks.write_parquet(b, path, resume=True)
    assert spark.read.parquet(path).first()[0] == 2
    assert sinks.keep_table(a, "kept").first()[0] == 1 and sinks.keep_table(b, "kept").first()[0] == 2
    name = f"kept_{tmp_path.name}".replace("-", "_")
    for df, want in ((a, 1), (b, 2)):
        assert sinks.keep_table(df, name, temporary=False).first()[0] == want
    assert spark.table(name).first()[0] == 2
    keyed = spark.createDataFrame([(i, f"k{i % 7}") for i in range(50)], "i int, k string")
    for n in ("left", "right"):
        sinks.write_parquet(keyed, str(tmp_path / f"{n}_{name}"), bucket=(4, "k"))
    met = spark.table(f"left_{name}").hint("merge").join(spark.table(f"right_{name}"), "k")
    assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString() and met.count() == keyed.join(keyed, "k").count()
    rows = spark.createDataFrame([("S2", "exact_name", 1234, 5, 3, 4, 0.75, 1.5), ("S3", "COMBINED", 0, 0, 0, 0, None, 0.0)], "target string, rule string, candidate_pairs long, s1_with_candidates long, true_matches_found long, true_matches_total long, recall double, avg_candidates double")
    sinks.write_report(rows, str(tmp_path / "report"))
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "report")).collect())
    assert text.startswith("BLOCKING BENCHMARK\n" + "=" * 70) and "  candidate pairs: 1,234\n" in text and "  recall: 75.0000%\n" in text and "  recall: 0.0000%\n" in text


def test_a_stream_makes_the_pairs_of_its_batches(spark, tmp_path):
    from linkspark.streaming.incremental import block_stream

    e = ents(spark, [(1, "S1-0", "acme", "x", "US"), (2, "S2-0", "acme", "y", "US"), (2, "S2-1", "other", "y", "US")])
    e.filter("src = 2").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    block_stream(stream, e.filter("src = 1"), [B.rule("exact_name", 1, 5)], str(tmp_path / "out"), str(tmp_path / "n"), str(tmp_path / "c")).awaitTermination()
    assert got(spark.read.parquet(str(tmp_path / "out"))) == [("S1-0", "S2-0")]


def test_a_stream_repeats_no_pair_and_caps_each_target(spark, tmp_path):
    from linkspark.streaming.incremental import block_stream

    e = ents(spark, [(1, "S1-0", "acme", "x", "US"), (2, "S2-0", "acme", "y", "US"), (2, "S2-1", "acme", "y", "US"), (3, "S3-0", "acme", "y", "US"), (2, "S2-9", "acme", "y", "US")])
    for batch in ("S2-0 S3-0", "S2-0 S2-1", "S2-9"):
        e.filter(F.col("entity_id").isin(*batch.split())).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
        block_stream(stream, e.filter("src = 1"), [B.rule("exact_name", 1, 3)], str(tmp_path / "out"), str(tmp_path / "n"), str(tmp_path / "c")).awaitTermination()
    assert got(spark.read.parquet(str(tmp_path / "out"))) == [("S1-0", "S2-0"), ("S1-0", "S2-1"), ("S1-0", "S3-0")]


def test_queries_load_without_a_library_of_the_optional_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; assert 'candidate_export' in e.queries() and 'candidate_export' in e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True).returncode == 0


def test_fuzzy_queries_search_both_targets(spark, tmp_path):
    from linkspark.plans import registry

    rows = [(0, "acme widgets ltd", "en"), (1, "acme widgets lt", "en"), (2, "acme widgets lttd", "en"), (5, "quite another", "en")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("fuzzy_ratio_pairs", "fuzzy_partial_pairs"):
        out = registry.queries()[name](spark, str(tmp_path)).select("source1_entity_id", "target_entity_id").collect()
        assert sorted(map(tuple, out)) == [("S1-00000000", "S2-00000001"), ("S1-00000000", "S3-00000002")]


def _plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def _repeated(spark):
    """Frequent keys, repeated ids with other names, nulls and ids that hold many keys."""
    words = ["a b", "ab", "b a", "a", "", None, "c"]
    rows = [(i % 3 + 1, f"S{i % 3 + 1}-{i // 3 % 17}", words[i * 5 % 7], words[i * 3 % 5], "en" if i % 4 else None) for i in range(120)]
    return ents(spark, rows)


@pytest.mark.parametrize("rules", [[B.rule("exact_address")], [B.rule("compact_address")], B.R_BENCH, B.R_NEXT, B.R_STREAM, [B.rule("first_word_country", 1), B.rule("name_tokens", 2)]])
def test_pairs_without_caps_are_made_once_and_not_shuffled(spark, monkeypatch, rules):
    monkeypatch.setattr(B, "CHUNK", 2)
    e = _repeated(spark)
    plain = B.rule_pairs(e, rules, "none").select("source1_entity_id", "target_entity_id").distinct()
    out = B.pairs(e, rules, "none")
    assert got(out) == got(plain) != []
    assert "Exchange hashpartitioning(source1_entity_id" in _plan(plain)
    assert "Exchange hashpartitioning(source1_entity_id" not in _plan(out)


def _with_text(e):
    return e.withColumn("_text", F.concat_ws("\n", "business_name", "business_address"))


def test_pairs_that_share_several_keys_are_not_made_apart(spark, monkeypatch):
    monkeypatch.setattr(B, "CHUNK", 2)
    e = _repeated(spark)
    name, address, words = (B.rule_pairs(e, [B.rule(n)], "none").select(*E.PAIR).distinct() for n in ("exact_name", "exact_address", "name_tokens"))
    both = B.sharing(e, [[B.rule("exact_name"), B.rule("exact_address")]])
    assert got(both) == got(name.intersect(address)) != got(name)
    some = B.sharing(e, [[B.rule("exact_name"), B.rule("exact_address")], [B.rule("name_tokens"), B.rule("exact_address")]])
    assert got(some) == got(E.covered(address, name, words).distinct())
    assert "Exchange hashpartitioning(source1_entity_id" not in _plan(both)


@pytest.mark.parametrize("name", ["covered_exists", "pair_intersection"])
def test_queries_on_several_keys_shuffle_no_pair(spark, name):
    from linkspark.plans import registry

    assert "Exchange hashpartitioning(source1_entity_id" not in _plan(registry.queries()[name](spark, "/root/testdata/sf0.001"))


@pytest.mark.parametrize("rules", [B.R_BENCH, B.R_NEXT, [B.rule("exact_name"), B.rule("name_tokens", 2), B.rule("first_word_country", 1)]])
def test_counts_of_pairs_without_pairs(spark, rules):
    words = ["a b", "ab", "b a", "a", "", None, "c"]
    e = _with_text(ents(spark, [(i % 3 + 1, f"S{i % 3 + 1}-{i // 3 % 30}", words[i * 5 % 7], words[i * 3 % 5], "en" if i % 4 else None) for i in range(150)]))
    text = B.Rule("text", lambda: T.compact(T.normalize(F.col("_text"))))
    s1 = e.filter("src = 1").select(F.col("entity_id").alias("source1_entity_id"))
    plain = E.rule_benchmark(B.rule_pairs(e, rules, "none"), B.rule_pairs(e, [text], "none").select(*E.PAIR), s1)
    out = E.benchmark_rates(*B.shared_counts(e, rules, text), s1)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, plain.collect())) != []
    assert out.columns == plain.columns


@pytest.mark.parametrize("name", ["rule_benchmark", "benchmark_report"])
def test_the_benchmark_makes_no_pairs(spark, name):
    from linkspark.plans import registry

    assert "target_entity_id" not in _plan(registry.queries()[name](spark, "/root/testdata/sf0.001"))


@pytest.mark.parametrize("share", [-1.0, 0.05, 2.0])
def test_tfidf_deals_names_and_sums_frequent_and_rare_grams(spark, monkeypatch, share):
    rnd = random.Random(7)
    names = ["".join(rnd.choice("abcd é") for _ in range(rnd.randint(1, 14))) for _ in range(50)] + [None, "", "ab"]
    df = spark.createDataFrame([(f"{i:02d}", n) for i, n in enumerate(names)], "id string, name string")
    out = []
    for s, few in ((0.007, 100), (share, 9)):
        for name, x in (("DENSE_SHARE", s), ("ASK_BLOCK", few), ("ROW_BLOCK", few), ("ASKED", 2)):
            monkeypatch.setattr(Z, name, x)
        top = Z.tfidf_top(df, df, 3)
        assert "collect_list" not in _plan(top)
        out.append({(r[0], r[1]): (r["rank"], r["similarity"]) for r in top.collect()})
    assert out[0].keys() == out[1].keys() and all(abs(out[0][x][1] - out[1][x][1]) < 2e-6 for x in out[0])
    assert sum(s == t and abs(x[1] - 1) < 1e-9 for (s, t), x in out[0].items()) > 30


def test_further_pairs_come_beside_those_without_caps(spark):
    e = _repeated(spark)
    ids = lambda s, c: e.filter(s).select(F.col("entity_id").alias(c)).distinct()
    more = ids("src = 1", "source1_entity_id").crossJoin(ids("src > 1", "target_entity_id")).filter("right(target_entity_id, 1) < '6'")
    exact = B.pairs(e, [B.rule("exact_name")], "none")
    assert got(B.with_more(e, [B.rule("exact_name")], more.union(more))) == got(exact.union(more).distinct()) != got(more)


def test_generator_pairs_shuffle_no_pair_of_exact_rules(spark):
    from linkspark.plans import registry

    plan = _plan(registry.queries()["generator_pairs"](spark, "/root/testdata/sf0.001"))
    union = next(i for i, x in enumerate(plan.splitlines()) if "Union" in x)
    assert "Exchange" not in "".join(plan.splitlines()[:union])


def test_long_keys_are_not_shuffled(spark):
    plan = _plan(B.rule_pairs(_repeated(spark), B.R_HIGH))
    assert "md5" in plan and S.indel_ratio("x" * 20, "x" * 20, 70.0) == 100.0


def test_tfidf_recall_asks_all_of_source_1(spark, tmp_path, monkeypatch):
    from linkspark.plans import registry

    monkeypatch.setattr(registry, "SAMPLE_ROWS", 1)
    spark.createDataFrame([(i, f"name {i // 3} {i // 3}", "en") for i in range(9)], "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert registry.queries()["tfidf_recall"](spark, str(tmp_path)).select("true_pairs", "found_pairs").first() == (6, 6)
    assert "LIMIT" not in registry.oracle_sql()["tfidf_recall"]


def test_tfidf_multiplies_equal_names_once(spark, monkeypatch):
    """Ids of equal names are made from one vector each; ties go on by id across names, and kinds change no result."""
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abc") for _ in range(4)) for _ in range(7)] + ["abcd xyz", "xyz abcd"]
    rows = [(f"{i:03d}", words[i * i % 9], "xy"[i % 2]) for i in range(90)]
    df = spark.createDataFrame(rows, "id string, name string, kind string")
    top = Z.tfidf_top(df, df, 12)
    assert "md5" in _plan(top)
    out = sorted(map(tuple, top.collect()))
    monkeypatch.setattr(Z, "PIECE", 2)
    monkeypatch.setattr(Z, "TEXTS", 3)
    again = sorted(map(tuple, Z.tfidf_top(df.drop("kind"), df.drop("kind"), 12).collect()))
    assert [(x[0], x[1], x[3]) for x in out] == [(x[0], x[1], x[3]) for x in again]
    name = {i: n for i, n, _ in rows}
    for i, n, _ in rows:
        same = [x for x in sorted(name) if name[x] == n][:12]
        assert [x[1] for x in out if x[0] == i and x[3] == 1] == same[:1] and {x[1] for x in out if x[0] == i and abs(x[2] - 1) < 1e-9} >= set(same)


def test_windows_of_many_pairs_are_scored_together():
    rnd = random.Random(11)
    word = lambda most, signs: "".join(rnd.choice(signs) for _ in range(rnd.randint(0, most)))
    for most, signs in ((8, "ab"), (40, "abcdefé"), (90, "ab")):
        a, b = ([word(most, signs) for _ in range(200)] for _ in range(2))
        b[:40] = [x[:3] + "z" + x[4:] for x in a[:40]]
        for least in (0.0, 65.0):
            for x, y in zip(S.best_window_ratios(a, b, least), map(S.best_window_ratio, a, b)):
                assert abs(x - y) < 1e-9 if y >= least else x < least


def test_names_of_prefix_pairs_are_scored_once(spark):
    names = ["acme widgets", "acme widgetz", "acme", "acmq widgets", "acm", None]
    e = ents(spark, [(1 + i % 3, f"S{1 + i % 3}-{i}", names[i * 7 % 6 if i % 4 else 0], "x", "US") for i in range(48)])
    for cap in (2, 7, 50):
        old = Z.prefix_buckets(e, 2, cap).withColumn("score", S.partial_ratio_from(65.0)("name1", "name2")).filter("score >= 65").drop("name1", "name2")
        new = Z.prefix_pairs(e, 2, cap)
        assert "MapInPandas" in _plan(new) and sorted(map(tuple, new.collect())) == sorted(map(tuple, old.collect()))
