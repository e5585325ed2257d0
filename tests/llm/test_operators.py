"""Small cases with defined results for each operator, against brute force where SQL cannot say it."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from linkspark.llm import classifier, hilbert, lines, mixing, neighbours, packing, rules, sharding, simhash, substrings, urls

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, _row string"


def docs(spark, texts, ids=None):
    """Rows with extra columns whose names clash with those inside the operators."""
    rows = [(ids[i] if ids else i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, 0, -1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary):03d}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    base = [words(rnd, rnd.randint(5, 200)) for _ in range(25)]
    near = [b.replace("w1", "x1", 1) for b in base[:8]]
    common = "this is one common line of text"
    return [None, "", " \n ", "a", "a b c", *base, *base[:6], *near, *(f"{common}\n{b}\n {common.upper()}\t" for b in base[:5]), "ab" * 4000, words(rnd, 20_000)]


def test_line_dedup(spark, texts):
    out = {r["_row"]["doc_id"]: r for r in lines.dedup(docs(spark, texts)).collect()}
    ws = " \t\n\x0b\x0c\r"
    low = str.maketrans(urls.UPPER, urls.LOWER)
    key = lambda x: x.strip(ws).translate(low)
    holders = defaultdict(set)
    for i, t in enumerate(texts):
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(i)
    for i, t in enumerate(texts):
        every = (t or "").split("\n")
        keep = [x for x in every if len(holders[key(x)]) < 3 or max(holders[key(x)]) == i]
        assert (out[i]["n_lines"], out[i]["n_dropped"], out[i]["kept"]) == (len(every), len(every) - len(keep), "\n".join(keep))
    assert lines.drop_lines(docs(spark, texts)).columns == DOCS.replace(",", "").split()[::2]
    assert lines.dedup(docs(spark, [])).count() == 0


def test_line_runs_compact_and_hold_each_key_once(spark):
    runs = lines.LineRuns(spark, fanout=2)
    for at in range(5):
        t = ["a line that is in each batch of these", f"a line that only batch {at} has in it", f"a line in this batch and {at // 2 * 2} of them"]
        new = runs.add(lines.long_lines(docs(spark, t, [10 * at, 10 * at + 1, 10 * at + 2])))
        assert new.count() == 1 + (at == 0) + (at % 2 == 0)
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    plan = new.join(runs.levels[2][0].hint("merge"), lines.KEY, "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    keys = [tuple(r) for run in runs.runs() for r in run.select(*lines.KEY).collect()]
    assert len(keys) == len(set(keys)) == 9
    assert sorted((r["n_docs"], r["last_doc"]) for r in runs.totals().collect()) == sorted([(5, 40), *((1, 10 * i + 1) for i in range(5)), (2, 12), (2, 32), (1, 42)])


def test_line_dedup_with_null_and_repeated_ids(spark):
    x = "a line that many documents have"
    t = docs(spark, [x, f"{x}\nown", x, x, f"{x}\nown"], [None, 7, 3, 7, None])
    out = sorted((str(r["_row"]["doc_id"]), r["kept"]) for r in lines.dedup(t).collect())
    assert out == [("3", ""), ("7", x), ("7", f"{x}\nown"), ("None", ""), ("None", "own")]


def test_mixing_targets_and_limits(spark, texts):
    out = mixing.plan(docs(spark, texts)).collect()
    per = defaultdict(list)
    for r in out:
        per[r["source"]].append(r)
    assert len(out) == len(texts)
    total = sum(r["size"] for r in out)
    assert abs(sum(rows[0]["target"] for rows in per.values()) - 1.5 * total) < 1e-6 * total
    for rows in per.values():
        size, target = rows[0]["source_size"], rows[0]["target"]
        assert target <= 2 * size + 1e-9 and size == sum(r["size"] for r in rows)
        assert abs(sum(r["copies"] * r["size"] for r in rows) - target) <= max(r["size"] for r in rows)
        assert all(0 <= r["copies"] <= 2 for r in rows)
    again = mixing.plan(docs(spark, texts)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, out), key=str)
    mixed = Counter(r["doc_id"] for r in mixing.mix(docs(spark, texts)).collect())
    assert mixed == Counter({r["_d"]: r["copies"] for r in out if r["copies"]})
    assert mixing.plan(docs(spark, [])).count() == 0


def by_rows(rows, seed=mixing.SEED):
    """The plan of (doc_id, source, words, symbols) without histograms: document by document."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(r[2] for r in rows if r[1] == s) for s in sources}
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sources)}
    target, free, total = {}, set(sources), 1.5 * sum(size.values())
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] > 2 * size[s]]
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * size[s] for s in full}
        free -= set(full)
    out = {}
    for s in sources:
        epochs = int(target[s] // size[s]) if size[s] else 0
        left = target[s] - epochs * size[s]
        key = lambda r: (-math.log((int(hashlib.md5(f"{r[0]}:{seed}".encode()).hexdigest()[:12], 16) + 1) / 2**48) * (1 + r[3] / max(r[2], 1)), r[0])
        own = sorted((r for r in rows if r[1] == s), key=key)
        n = next((i for i, r in enumerate(own) if sum(x[2] for x in own[: i + 1]) > left), len(own)) if left > 0 else 0
        taken = {r[0] for r in own[:n]}
        left -= sum(r[2] for r in own[:n])
        for _ in range(mixing.FILL_PASSES):
            upto = 0
            fits = [r for r in own[n : n + mixing.FILL] if r[0] not in taken and r[2] <= left] if left > 0 else []
            for r in fits:
                upto += r[2]
                if upto <= left:
                    taken.add(r[0])
            left = target[s] - epochs * size[s] - sum(r[2] for r in own if r[0] in taken)
        out |= {r[0]: (target[s], epochs + (r[0] in taken)) for r in own}
    return out


@pytest.mark.parametrize("steps,fine", [(mixing.STEPS, mixing.FINE), (1, 2), (1, 4096)])
def test_mixing_equals_the_plan_by_rows(spark, steps, fine):
    rnd = random.Random(16)
    rows = []
    for i in range(1200):  # source m is mark-up only: 20 symbols a word
        s, n = ("m" if i % 3 == 0 else "s" if i % 7 else None), rnd.randint(1, 60)
        rows.append((i, s, n, 20 * n if s == "m" else 0))
    t = spark.createDataFrame([(i, " ".join(["w" + "#" * (m // n)] * n), s, -1) for i, s, n, m in rows], "doc_id long, text string, source string, rest long")
    out = {r["_d"]: (r["target"], r["copies"]) for r in mixing.plan(t, steps=steps, fine=fine).collect()}
    want = by_rows(rows)
    assert {d: c for d, (_, c) in out.items()} == {d: c for d, (_, c) in want.items()}
    assert all(abs(out[d][0] - want[d][0]) < 1e-6 * want[d][0] for d in out)


def test_mixing_of_a_source_of_mark_up(spark):
    n = 20_000
    t = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("w" + "#" * 20).alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    sizes = mixing.plan(t).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("n"), F.first("target").alias("t")).collect()
    assert all(abs(r["n"] - r["t"]) <= 1 for r in sizes)


def test_mixing_takes_equal_rows_together(spark):
    t = docs(spark, ["a b c"] * 4 + ["d e"] * 2 + ["x"], [1, 1, 1, 1, None, None, 2]).withColumn("source", F.lit("s"))
    out = mixing.plan(t).collect()
    assert sorted((str(r["_d"]), r["size"], r["rows"]) for r in out) == [("1", 3, 4), ("2", 1, 1), ("None", 2, 2)]


def slow_print(text):
    low = (text or "").translate(str.maketrans(urls.UPPER, urls.LOWER))
    w = [x for x in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups(spark, texts):
    out = {r["_d"]: r for r in simhash.groups(docs(spark, texts)).collect()}
    prints = [slow_print(t) for t in texts]
    assert [out[i]["fp"] % (1 << 64) for i in range(len(texts))] == prints
    root = list(range(len(texts)))
    for _ in root:
        root = [min(root[j] for j in range(len(texts)) if (prints[i] ^ prints[j]).bit_count() <= 4) for i in range(len(texts))]
    assert [out[i]["component_id"] for i in range(len(texts))] == root
    kept = simhash.keep_first(docs(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root)) and kept.columns == DOCS.replace(",", "").split()[::2]
    assert simhash.groups(docs(spark, [])).count() == 0


def test_simhash_keeps_one_of_each_group_without_ids(spark):
    rnd = random.Random(12)
    a, b, c, d = (words(rnd, 80) for _ in range(4))
    table = docs(spark, [a, b, c, c, c, d, d], [None, None, None, 9, 7, None, None])
    kept = [(r["doc_id"], r["text"]) for r in simhash.keep_first(table).collect()]
    assert sorted(kept, key=str) == sorted([(None, a), (None, b), (7, c), (None, d)], key=str)


def test_simhash_hot_buckets_lose_no_link(spark):
    rnd = random.Random(5)
    base = rnd.getrandbits(64)
    fps = {base}
    while len(fps) < 150:
        x = base
        for b in rnd.sample(range(64), rnd.randint(1, 5)):
            x ^= 1 << b
        fps.add(x)
    fps |= {rnd.getrandbits(64) for _ in range(100)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    for split in (10, 1000):
        parent = {x: x for x in signed}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for r in simhash.links(df, split=split).collect():
            assert ((r["a"] ^ r["b"]) % (1 << 64)).bit_count() <= 4
            parent[find(r["a"])] = find(r["b"])
        for a in signed:
            for b in signed:
                if ((a ^ b) % (1 << 64)).bit_count() <= 4:
                    assert find(a) == find(b)


def test_url_trie(spark):
    cases = {
        None: ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "http://A.COM": ("a.com", "", None, "allow"), "http://a.com/x?y#z": ("a.com", "/x", "com/", "allow"),
        "https://example.com/en/1": ("example.com", "/en/1", "example.com/en/", "block"), "https://m.example.com/en/": ("m.example.com", "/en/", "example.com/en/", "block"), "https://www.example.com/en/a#b": ("www.example.com", "/en/a", "www.example.com/en/", "allow"),
        "https://example.com/en": ("example.com", "/en", "com/", "allow"), "http://x.net/es/": ("x.net", "/es/", "net/es/", "block"), "http://notcom/": ("notcom", "/", None, "allow"), "http://com/": ("com", "/", "com/", "allow"),
    }
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(cases)], "page_id long, url string, host string")
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df).collect()}
    assert [out[i] for i in range(len(cases))] == list(cases.values())
    assert urls.Trie([("block", "a.b", "/x"), ("allow", "a.b", "/x/y/")]).match("a.b", "/xyz") == ("block", "a.b/x")
    assert urls.Trie([("block", "com", "/aaaaaaaaaa"), ("allow", "a.com", "/")]).match("a.com", "/aaaaaaaaaab") == ("block", "com/aaaaaaaaaa")
    assert urls.Trie([("block", "com", "/ab"), ("allow", "a.com", "/")]).match("a.com", "/ab") == ("allow", "a.com/")
    assert urls.Trie([("block", "com", "/ab"), ("allow", "com", "/ab")]).match("com", "/ab") == ("allow", "com/ab")


def test_urls_keep_other_columns_and_repeated_rows(spark):
    t = spark.createDataFrame([(1, "http://a.com/", "keep"), (1, "http://a.com/", "keep"), (None, None, None)], "page_id long, url string, _j string")
    out = urls.judge(t)
    assert out.columns == ["page_id", "url", "_j", "host", "path", "rule", "verdict"]
    assert sorted(str(r["_j"]) for r in out.collect()) == ["None", "keep", "keep"] and urls.judge(t.filter("false")).count() == 0


def test_url_rules_as_a_table(spark):
    rnd = random.Random(17)
    host = lambda: ".".join(rnd.choice(("a", "b", "com", "net")) for _ in range(rnd.randint(1, 4)))
    path = lambda: rnd.choice(("/", "/x", "/x/", "/x/y", "/x/y/", "/xy"))
    rules = [(rnd.choice(("allow", "block")), host(), path()) for _ in range(60)]
    t = [f"http://{host()}{path()}{rnd.choice(('', 'z', '/z?q', '#x'))}" for _ in range(300)] + [None, "", "x", "http://"] * 2
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(t)], "page_id long, url string, j string")
    table = spark.createDataFrame([(*r, i) for i, r in enumerate(rules)], "verdict string, host string, path string, no int")
    a, b = (sorted(f(df, r).collect()) for f, r in ((urls.judge, rules), (urls.judge_by_table, table)))
    slow = {}
    for i, u in enumerate(t):
        h, p = urls.parts(u)
        fits = [(len(x + y), len(x), no, x + y, v) for no, (v, x, y) in enumerate(rules) if (h == x or h.endswith("." + x)) and p.startswith(y)]
        slow[i] = max(fits)[3:] if fits else (None, "allow")
    assert a == b and {r["page_id"]: (r["rule"], r["verdict"]) for r in a} == slow


def test_classifier_equals_direct_ridge_and_pools(spark):
    rnd = random.Random(18)
    t = [words(rnd, rnd.randint(1, 60)) + "#" * rnd.randint(0, 9) for _ in range(150)]
    y = [int(rnd.random() < 0.3 + 0.4 * ("#" in x)) for x in t]
    labels = spark.createDataFrame([*enumerate(y), (150, 1), (0, 7)], "doc_id long, quality int")
    out = {r["_d"]: r["score"] for r in classifier.classify(docs(spark, [*t, None]).repartition(3), labels).collect()}
    x = np.array([classifier.statistics(a) for a in [*t, None]])
    own = [i for i in range(151) if zlib.crc32(str(i).encode()) % 3 != 1]
    model = classifier.Model(x[own].mean(axis=0), np.maximum(x[own].std(axis=0), 1e-3))
    z, want = model.features(x), np.array([*y, 1.0])
    k = classifier.FEATURES
    raw = z @ np.linalg.solve(z[own].T @ z[own] + classifier.RIDGE * len(own) / k * np.eye(k), z[own].T @ want[own])
    bins = np.rint(raw * classifier.BINS)
    at = sorted(set(bins[own]))
    n, ones = (np.array([sum(v for b, v in zip(bins[own], w) if b == a) for a in at]) for w in (np.ones(len(own)), want[own]))
    # isotonic regression by its min-max formula
    fit = [max(min(ones[i : j + 1].sum() / n[i : j + 1].sum() for j in range(m, len(at))) for i in range(m + 1)) for m in range(len(at))]
    assert len(out) == 151 and all(abs(out[i] - np.interp(raw[i], np.array(at) / classifier.BINS, fit)) < 2e-2 for i in range(151))
    assert np.mean([abs(out[i] - np.interp(raw[i], np.array(at) / classifier.BINS, fit)) < 1e-6 for i in range(151)]) > 0.95


def test_classifier_of_empty_repeated_and_long_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (5, 1)], "doc_id long, quality int")
    t = docs(spark, ["a b", "a b", "##", None, "x " * 300_000], [1, 1, 2, None, 5])
    out = classifier.classify(t, labels).collect()
    assert len(out) == 5 and len({r["score"] for r in out if r["_d"] == 1}) == 1 and not [r for r in out if r["_d"] is None][0]["held_out"]
    assert classifier.classify(docs(spark, []), labels).count() == 0


def test_classifier_learns_and_scores_everything(spark):
    rnd = random.Random(2)
    t = [words(rnd, 40) if i % 2 else " ".join(x + "###" for x in words(rnd, 40).split()) for i in range(300)] + ["", None]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    out = classifier.classify(docs(spark, t), labels).collect()
    assert len(out) == 302 and all(0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["held_out"] and r["_d"] < 300]
    assert all(r["held_out"] == (zlib.crc32(str(r["_d"]).encode()) % 3 == 1) for r in out)
    assert np.mean([r["predicted"] == r["_d"] % 2 for r in held]) > 0.95
    none = classifier.classify(docs(spark, t), labels.filter("false")).collect()
    assert {r["score"] for r in none} == {0.5}
    k, v = classifier.isotonic(np.array([0.0, 1, 2, 3]), np.array([1.0] * 4), np.array([0.0, 1, 0, 1]))
    assert v.tolist() == [0, 0.5, 0.5, 1]


def brute_repeats(rows, n=100):
    seen, out = set(), {}
    for key, b in rows:
        gone = bytearray(len(b))
        for s in range(len(b) - n + 1):
            if (w := b[s : s + n]) in seen:
                gone[s : s + n] = b"\1" * n
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[key] = (len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot,group", [(512, 1024), (2, 1024), (512, 3)])
def test_repeated_strings(spark, texts, hot, group, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "GROUP", group)
    rnd = random.Random(9)
    passage = words(rnd, 14)
    t = [*texts, *[words(rnd, 30) + passage + words(rnd, 30) for _ in range(12)], "é" * 120, "é" * 90]
    out = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.dedup(docs(spark, t), batches=5).collect()}
    assert out == brute_repeats([(i, (x or "").encode()) for i, x in enumerate(t)])


def test_repeated_strings_with_repeated_and_null_ids(spark):
    a, b = "x" * 10 + words(random.Random(1), 60), words(random.Random(2), 60)
    out = substrings.dedup(docs(spark, [a, b, a, a], [7, 7, None, 7])).collect()
    assert Counter((r["doc_id"], r["n_removed"] > 0) for r in out) == {(None, False): 1, (7, False): 1, (7, True): 2}
    assert substrings.dedup(docs(spark, [])).count() == 0


def test_repeated_strings_that_become_hot_in_a_later_batch(spark):
    rnd = random.Random(13)
    passage = words(rnd, 30)[: substrings.LENGTH + 10]
    around = lambda: (words(rnd, 16, 100_000), words(rnd, 16, 100_000))
    n = substrings.HOT + 60
    t = []
    for i in range(2 * n):  # rare in the first batch, and in all documents of the second, in one partition
        a, b = around()
        t.append(f"{a} {passage if i == 3 or i >= n else ''} {b}")
    out = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.dedup(docs(spark, t).coalesce(1), batches=2).collect()}
    assert out == brute_repeats([(i, x.encode()) for i, x in enumerate(t)])


def test_repeated_windows_against_brute_force():
    rnd = random.Random(15)
    for n in (8, 9, 30, 200, 2000):
        for kinds in (1, 2, 20, 400):
            w = [f"w{rnd.randrange(kinds)}" for _ in range(n)]
            w += w[: rnd.choice((0, 7, 8, 12))]
            seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
            twice = {i + j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(8)}
            assert rules.base_counts(" ".join(w))[4] == len(twice)


def test_base_counts():
    assert rules.base_counts(None) == (0, 0, 0, 0, 0)
    w = "a b c d e f g h".split()
    t = "é# " + " ".join(w) + " x\n" + " ".join(w) + "\n\n \nq\nq"
    n, chars, symbols, dups, repeats = rules.base_counts(t)
    assert (n, symbols, dups, repeats) == (20, 1, 1, 16) and chars == sum(len(x) for x in t.split())


def test_kneser_ney_sums_to_one():
    rnd = np.random.default_rng(0)
    code = np.unique(rnd.integers(0, rules.SIZE, 5000))
    p = np.exp(-rules.expanded(rules.kneser_ney(code, rnd.integers(1, 6, len(code)))).astype(float)).reshape(-1, rules.SYMBOLS)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)


def brute_perplexities(texts):
    """Mean negative log probability of each text of a model (symbols) by recursion over dictionaries."""
    pad, order = list(rules.PAD), rules.ORDER
    counts = [Counter() for _ in range(order + 1)]
    found = defaultdict(list)  # (symbols before, its n-grams) of each long unit
    for t in texts:
        s, first = pad + t, 0
        for i, x in enumerate(s):
            if x == rules.MARK or i == len(s) - 1:
                grams = [tuple(s[j - order + 1 : j + 1]) for j in range(max(first, len(pad)), i + 1)]
                if i + 1 - first < rules.LEAST_UNIT:
                    counts[order].update(grams)
                else:
                    found[tuple(s[first : i + 1])].append((s[first - order + 1 : first] if first else [0] * (order - 1), grams))
                first = i + 1
    for each in found.values():
        counts[order].update(min(each)[1])
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    off, total, back = [None], [None], [None]
    for c in counts[1:]:
        d = rules.discounts(*(sum(v == i for v in c.values()) for i in (1, 2, 3, 4)))
        off.append({g: d[min(v, 3)] for g, v in c.items()})
        total.append(Counter())
        back.append(Counter())
        for g, v in c.items():
            total[-1][g[:-1]] += v
            back[-1][g[:-1]] += off[-1][g]

    def p(g):
        if not g:
            return 1 / rules.SYMBOLS
        k, lower = len(g), p(g[1:])
        n = total[k][g[:-1]]
        return (counts[k][g] - off[k].get(g, 0)) / n + back[k][g[:-1]] / n * lower if n else lower

    return [np.mean([-np.log(p(tuple((pad + t)[i : i + order]))) for i in range(len(t))]) if t else None for t in texts]


@pytest.mark.parametrize("least", [1500, rules.CHUNK])
def test_perplexities_equal_brute_force(spark, least, monkeypatch):
    rnd = random.Random(8)
    base = [". ".join(words(rnd, rnd.randint(3, 30), 90) for _ in range(6)) for _ in range(12)]
    t = [None, "", "a", "é!", "..,", *base, *base[:5], *(b.replace("w0", "W1", 1) for b in base[:4]), "ab" * 1500]
    table = docs(spark, t).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "en").when(F.col("doc_id") % 3 == 1, "fr")).coalesce(2)
    langs = rules.languages(table)
    expected = {}
    parts = sorted(rules.chunks(table, langs, least).collect(), key=lambda r: r["chunk"])
    assert least > 1500 or len(parts) > 6
    every = []
    for r in parts:
        s, at, texts = list(rules.symbols_of(r["symbols"])), 0, []
        for n in r["lengths"]:
            texts.append([int(x) for x in s[at + len(rules.PAD) : at + len(rules.PAD) + n]])
            at += n + len(rules.PAD)
        every.append(texts)
    for m in sorted({r["model"] for r in parts}):
        own = [i for i, r in enumerate(parts) if r["model"] == m]
        ids = [row["_d"] for i in own for row in parts[i]["info"]]
        expected |= dict(zip(ids, brute_perplexities([t for i in own for t in every[i]])))
    out = {r["_d"]: r["nll"] for r in rules.scores(table, langs, least).collect()}
    assert out.keys() == expected.keys() == set(range(len(t)))
    for d, x in expected.items():
        assert (out[d] is None and x is None) or abs(out[d] - x) < 1e-3, d
    for name, few in (("MOST_SHARDS", 3), ("BLOCK", 2), ("MERGED", 50)):
        monkeypatch.setattr(rules, name, few)
    again = {r["_d"]: r["nll"] for r in rules.scores(table.repartition(7, F.col("text")), langs, least).collect()}
    assert again == out  # neither layout nor shards nor blocks matter


def test_every_language_has_a_model_and_a_band(spark):
    rnd = random.Random(14)
    t, of = [], []
    for k in range(19):  # the last languages have the fewest documents
        letters = rnd.sample("abcdefghijklmnopqrstuvwxyz", 8)
        own = ["".join(rnd.choices(letters, k=5)) for _ in range(40)]
        for _ in range(6 if k < 16 else 4):
            t.append(" ".join(rnd.choices(own, k=60)))
            of.append(f"l{k:02d}")
    names = F.array(*map(F.lit, of))
    table = docs(spark, t).withColumn("lang", names[F.col("doc_id").cast("int")]).coalesce(1)
    nll = lambda d: {r["_d"]: (r["nll"], r["middle"]) for r in rules.verdicts(d).collect()}
    whole = nll(table)
    assert len(rules.languages(table)) == 19 and len(whole) == len(t)
    for x in ("l00", "l16", "l18"):
        for d, pair in nll(table.filter(F.col("lang") == x)).items():
            assert np.allclose(pair, whole[d], atol=1e-3), (x, d)


def test_many_languages_in_a_task_hold_few_texts(spark):
    t = [f"text {i} " + "x" * 100 for i in range(200)]
    table = docs(spark, t).withColumn("lang", F.concat(F.lit("l"), (F.col("doc_id") % 50).cast("string"))).coalesce(1)
    parts = rules.chunks(table, rules.languages(table), 300).collect()
    assert sorted(k["_d"] for r in parts for k in r["info"]) == list(range(200))
    assert all(len(r["info"]) == len(r["lengths"]) for r in parts) and any(len(r["info"]) < 2 for r in parts)


def test_rules_reject_gibberish_and_keep_the_rest(spark):
    rnd = random.Random(4)
    t = [words(rnd, 80, 60) for _ in range(60)] + ["".join(chr(rnd.randrange(33, 127)) for _ in range(20)) + " " + " ".join("".join(chr(rnd.randrange(33, 127)) for _ in range(9)) for _ in range(60)), "", None, "one two " * 30]
    out = {r["_d"]: r for r in rules.verdicts(docs(spark, t).withColumn("lang", F.lit("en"))).collect()}
    assert all(out[i]["kept"] for i in range(60)) and not out[60]["kept"] and not out[60]["base_failed"]
    assert all(out[i]["base_failed"] for i in (61, 62, 63))
    assert rules.drop_low_quality(docs(spark, t)).columns == DOCS.replace(",", "").split()[::2]
    assert rules.verdicts(docs(spark, [])).count() == 0


@pytest.mark.parametrize("first, letters", [(0x430, 32), (0x4E00, 2000)])
def test_rules_tell_letters_of_other_scripts_apart(spark, first, letters):
    rnd = random.Random(11)
    word = lambda: "".join(chr(first + rnd.randrange(letters)) for _ in range(5))
    own = [word() for _ in range(50)]
    t = [" ".join(rnd.choices(own, k=80)) for _ in range(60)] + [" ".join(word() for _ in range(80))]
    out = {r["_d"]: r for r in rules.verdicts(docs(spark, t)).collect()}
    assert all(out[i]["kept"] for i in range(60)) and not out[60]["kept"] and not out[60]["base_failed"]


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[100:300] = x[100]  # a third of all rows
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(600, None), (650, [0.0] * 8), (700, [float("nan")] * 8), (750, [])]
    out = defaultdict(list)
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        out[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    u = neighbours.unit(x.astype(float))
    hits = 0
    for q in range(0, 600, 50):
        s = u @ u[q]
        best = sorted((i for i in range(600) if i != q), key=lambda i: (-round(s[i], 12), i))[:5]
        found = [v for _, v, _ in sorted(out[q])]
        assert len(found) == 5
        hits += len(set(best) & set(found))
    assert sorted(out) == list(range(0, 600, 50)) and hits >= 0.9 * 60
    assert [v for _, v, _ in sorted(out[150])] == [100, 101, 102, 103, 104]
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_nearest_neighbours_with_repeated_ids(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)] + [(5000, (x[0] * 1.01 + 0.001).tolist(), "clash")] * 8 + [(0, x[0].tolist(), "clash")] * 3
    rows += [(77, (x[0] * 2).tolist(), "clash")]  # a second vector of an id: its best counts
    out = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string")).collect()}
    assert sorted(out) == [(q, k) for q in [*range(0, 300, 50), 5000] for k in range(1, 6)]
    assert out[0, 1][0] == 77 and abs(out[0, 1][1] - 1) < 1e-12 and out[0, 2][0] == 5000 and len({out[0, k][0] for k in range(1, 6)}) == 5


def test_nearest_neighbours_of_many_ties(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=8)
    rows = [(i, w.tolist()) for i, w in enumerate(rng.normal(size=(100, 8)))] + [(2000 + (7 * i) % 24, (v * 2.0 ** (i - 12)).tolist()) for i in range(24)]
    out = [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    assert sorted(x for x in out if x[0] == 2000) == [(2000, k, 2000 + k) for k in range(1, 6)]


def test_nearest_neighbours_in_clusters_and_with_few_candidates(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 3000)] + 0.2 * rng.normal(size=(3000, 16))).astype(np.float32)
    out = defaultdict(set)
    for r in neighbours.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect():
        out[r["query_id"]].add(r["vec_id"])
    u = neighbours.unit(x.astype(float))
    hits = sum(len(out[q] & set(np.argsort(-np.where(np.arange(3000) == q, -2, u @ u[q]))[:5].tolist())) for q in range(0, 3000, 50))
    assert hits >= 0.9 * 5 * 60
    few = neighbours.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(few)] == [(1, 2), (2, 1)]


def test_hilbert_curves_agree_and_are_continuous(spark):
    n, bits = 3, 3
    grid = np.stack(np.meshgrid(*[range(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
    at = hilbert.hilbert_numpy(grid, bits)
    assert sorted(at) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(at)], axis=0)).sum(axis=1) == 1).all()
    df = spark.createDataFrame([tuple(map(int, g)) for g in grid], "a int, b int, c int")
    assert [r["h"] for r in hilbert.with_hilbert(df, ["a", "b", "c"], bits, "h").collect()] == at.tolist()


def test_shards(spark, texts):
    out = sharding.assign(docs(spark, texts)).collect()
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert len(out) == len(texts) and sharding.assign(docs(spark, [])).count() == 0
    same = sharding.assign(docs(spark, ["x"] * 40, [1] * 40)).collect()
    assert Counter(r["shard"] for r in same) == {i: 5 for i in range(8)}


def test_shards_follow_the_curve_and_are_written_by_slot(spark, texts, tmp_path):
    t = docs(spark, texts)
    out = {r["doc_id"]: r for r in sharding.assign(t).collect()}
    number = lambda x: int(hashlib.md5((x or "").encode()).hexdigest()[:8], 16) % 16
    rows = {r["doc_id"]: r for r in t.collect()}
    point = lambda i: (number(rows[i]["source"]), number(rows[i]["lang"]), min(15, int(math.log2(out[i]["size"]))), int(i / len(texts) * 16))
    ids = sorted(out, key=lambda i: (out[i]["shard"], out[i]["slot"]))
    curve = hilbert.hilbert_numpy(np.array([point(i) for i in ids]), 4)
    assert (np.diff(curve) >= 0).all()
    sharding.write_shards(t, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards")).select("shard", "slot", "row.*").collect()
    assert {r["doc_id"]: (r["shard"], r["slot"], r["text"]) for r in back} == {i: (out[i]["shard"], out[i]["slot"], texts[i]) for i in out}


def test_packing_follows_the_curve(spark, texts):
    tokens = packing.tokenised(docs(spark, texts))
    rows = {r["_id"]: r for r in tokens.collect()}
    at = {r["_id"]: r["_at"] for r in packing.places(tokens).collect()}
    ids = sorted(at, key=at.get)
    assert [rows[i]["key"] for i in ids] == sorted(r["key"] for r in rows.values())
    assert [at[i] for i in ids] == [0, *np.cumsum([rows[i]["n_tokens"] for i in ids])[:-1].tolist()]
    words = packing.Words.of(packing.default_tokenizer())
    project = packing._projection(words.vocabulary)
    for r in rows.values():
        x = np.frombuffer(r["ids"], "<u4")[:-1]
        point = project[:, x].sum(axis=1) / math.sqrt(max(len(x), 1))
        grid = np.clip((point / packing.SPAN + 0.5) * (1 << packing.BITS), 0, (1 << packing.BITS) - 1).astype(int)
        assert hilbert.hilbert_numpy(grid[None], packing.BITS)[0] == r["key"]


def test_packing_of_null_ids_and_forgotten_words(spark, texts, monkeypatch):
    assert sorted(str(r["doc_id"]) for r in packing.pack(docs(spark, ["a", "a", "b"], [None, None, 1])).collect()) == ["1", "None", "None"]
    plain = packing.Words(packing.default_tokenizer())
    for name, few in (("ENTRIES", 50), ("RECENT", 7), ("SEGMENT", 300)):
        monkeypatch.setattr(packing, name, few)
    small = packing.Words(packing.default_tokenizer())
    raw = [(t or "").encode() for t in texts]
    assert [x for t in raw for x in small.ids([t])] == [np.array(plain.tokenizer.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes() for t in raw]
    assert sum(len(t[0]) for t in small.tables) < 1000


def test_packing_round_trip(spark, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    t = texts[:30] + ["Don't STOP! it's <|endoftext|> naïve² ½ Ａ é́ x", "ab" * 500]
    want = {i: [*tok.encode(x or "", add_special_tokens=False).ids, 1] for i, x in enumerate(t)}
    parts, seqs = defaultdict(dict), defaultdict(dict)
    for r in packing.pack(docs(spark, t)).collect():
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"]) and r["doc_tokens"] == len(want[r["doc_id"]])
        parts[r["doc_id"]][r["start"]] = r["ids"]
        seqs[r["sequence_id"]][r["offset"]] = r["length"]
    assert {d: [x for s in sorted(p) for x in p[s]] for d, p in parts.items()} == want
    fill = [sum(s.values()) for _, s in sorted(seqs.items())]
    assert all(x == 2048 for x in fill[:-1]) and sorted(seqs) == list(range(len(seqs)))
    assert packing.pack(docs(spark, [])).count() == 0
    assert packing.pack(docs(spark, ["a b"] * 3, [5] * 3)).count() == 3


def test_pipeline_runs(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(6)
    d = docs(spark, [words(rnd, 60) for _ in range(30)] + [None, ""])
    d.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and {r["doc_id"] for r in out} <= set(range(30))


def test_pipeline_of_an_empty_table_and_of_null_ids(spark, tmp_path):
    import corpus_pipeline

    docs(spark, []).write.parquet(str(tmp_path / "a" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "a")).count() == 0
    rnd = random.Random(19)
    t = [words(rnd, 60) for _ in range(12)]
    d = docs(spark, [*t, t[0], None, ""], [*[None] * 6, *range(7), None, None])
    stages = dict(corpus_pipeline.STAGES)
    for name in ("quality_rules", "line_dedup", "near_dedup", "mix"):
        d = stages[name](spark, d, "")
        assert d.columns == DOCS.replace(",", "").split()[::2]
        d = spark.createDataFrame(d.collect(), DOCS)
        if name == "near_dedup":
            assert Counter(r["text"] for r in d.collect()) == Counter(t)


def test_languages_band_against_brute_force(spark):
    rnd = random.Random(20)
    rows = [(k % 3, round(rnd.gauss(2 + k % 3, 0.3), 4) if k % 11 else None, rnd.randint(1, 60)) for k in range(200)]
    out = {r["model"]: (r["middle"], r["spread"]) for r in rules.bands(spark.createDataFrame(rows, "model int, nll double, n_words long")).collect()}
    for m in range(3):
        x = sorted(round(v * 1000) for k, v, n in rows if k == m and v is not None and n >= 20)
        middle = x[(len(x) - 1) // 2]
        off = sorted(abs(v - middle) for v in x)
        assert np.allclose(out[m], (middle / 1000, off[(len(x) - 1) // 2] / 1000 * 1.4826))


def test_cached_words_equal_the_tokenizer():
    from tokenizers import Tokenizer

    from linkspark.llm.packing import Words, default_tokenizer

    plain = Tokenizer.from_file(default_tokenizer())
    odd = ["Été ÉTÉ. naïve, it's we'll x's' a<b> <|endoftext|> end</w>", "İstanbul ſ éa É́!  x y z\x1cq", "... -- '' ''' 12 3a4 a1, Straße×÷ ﬁt 日本語。 \U0001f600!", "", " \n\t", "word" * 500 + "!!!" * 200]
    words = Words(default_tokenizer())
    for texts in (odd, odd[::-1]):
        got = words.ids([t.encode() for t in texts])
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
