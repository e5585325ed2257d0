"""Blocking rules and candidate pairs.

All rules go through one key table (rule, key, src, id, country): key frequencies are counted with partial
aggregation, rules with too frequent keys lose them before any pair is made, and one equi-join of the
left keys meets all targets. A key that is too frequent never reaches the join, so no task sees its rows. Without caps
ids meet by hashes of their keys (`sharing`).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.functions import text as T


@dataclass(frozen=True)
class Rule:
    name: str
    key: Callable[[], Column]
    least: int = 1
    cap: int | None = None
    same_country: bool = False


def _col(name: str) -> Callable[[], Column]:
    return lambda: F.col(name)


KEYS = {
    "exact_name": _col("name_norm"), "compact_name": _col("name_compact"), "exact_address": _col("address_norm"),
    "compact_address": _col("address_compact"), "name_tokens": _col("name_tokens"), "address_tokens": _col("address_tokens"),
    "first_word_country": lambda: T.first_word(F.col("name_norm"), 1), "prefix6_country": lambda: T.prefix(F.col("name_compact"), 6),
    "prefix6": lambda: T.prefix(F.col("name_compact"), 6, False), "prefix8": lambda: T.prefix(F.col("name_compact"), 8, False),
    "suffix6": lambda: T.suffix(F.col("name_compact"), 6), "name_core": lambda: T.name_core(F.col("name_norm")),
    "country_name": lambda: T.composite(F.col("country"), F.col("name_norm")), "country_compact": lambda: T.composite(F.col("country"), F.col("name_compact")),
    "country_address": lambda: T.composite(F.col("country"), F.col("address_norm")),
}


def rule(name: str, least: int = 1, cap: int | None = None, same_country: bool | None = None) -> Rule:
    return Rule(name, KEYS[name], least, cap, name.endswith("_country") if same_country is None else same_country)


EXACT = ("exact_name", "compact_name", "exact_address", "compact_address", "name_tokens", "address_tokens")
# fixed values: rule names, minimal lengths and caps of each set
R_MAIN = [*(rule(n, 1, 50) for n in EXACT), rule("first_word_country", 5, 20), rule("prefix6_country", 6, 15)]
R_HIGH = [rule(n, 1, 50) for n in EXACT]
R_EXP1 = [*(rule(n, 3, 500) for n in EXACT[:4]), rule("prefix6", 3, 250), rule("prefix8", 3, 400), rule("suffix6", 3, 250)]
R_EXP2 = [*(rule(n, 1, 1000) for n in ("exact_name", "compact_name", "exact_address", "name_tokens")), rule("first_word_country", 4, 500), rule("prefix6_country", 5, 500)]
R_NEXT = [rule(n) for n in ("name_tokens", "address_tokens", "country_name", "country_compact", "country_address")]
R_BENCH = [rule(n) for n in EXACT[:4]]
R_STREAM = [rule(n) for n in EXACT]
R_CORE = {c: [rule("name_core", 1, c)] for c in (20, 50, 100, 200)}
R_CAP = (("exact_name", "compact_name", "name_tokens", "exact_address"), (5, 10, 20, 50, 100, 500))


#: Rules that make every pair of a rule, if they take keys of any length.
IMPLIED = {"exact_name": ("compact_name", "name_tokens"), "exact_address": ("compact_address", "address_tokens")}
#: Ids of each side of a block that meet in one row.
CHUNK = 1024


def keys(ents: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, key, least, cap, same_country, src, id, country) of usable keys: neither null nor empty, and long enough."""
    each = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(r.name).alias("rule"), r.key().alias("key"), F.lit(r.cap).cast("long").alias("cap"), F.lit(r.same_country).alias("same"), F.lit(r.least).alias("least")) for i, r in enumerate(rules)])
    out = ents.select("src", F.col("entity_id").alias("id"), "country", F.explode(each).alias("k")).select("src", "id", "country", "k.*")
    return out.filter((F.col("key") != "") & (F.length("key") >= F.col("least"))).drop("least")


def frequencies(keyed: DataFrame) -> DataFrame:
    """Rows of each key in each source: n1, n2, n3."""
    return keyed.groupBy("no", "rule", "key", "cap").agg(*[F.count_if(F.col("src") == s).alias(f"n{s}") for s in (1, 2, 3)])


def eligible(freq: DataFrame, side: str) -> DataFrame:
    """(no, key, t2, t3): which targets a key may join. side: both (each target on its own), target (S2 and S3 together), none."""
    cap = F.coalesce("cap", F.lit(1 << 62))
    if side == "both":
        ok = {t: (F.col("n1") <= cap) & F.col(f"n{t}").between(1, cap) for t in (2, 3)}
    elif side == "target":
        ok = {t: (F.col("n2") + F.col("n3") <= cap) & (F.col(f"n{t}") > 0) for t in (2, 3)}
    else:
        ok = {t: F.col(f"n{t}") > 0 for t in (2, 3)}
    return freq.filter("n1 > 0").select("no", "key", ok[2].alias("t2"), ok[3].alias("t3")).filter("t2 OR t3")


def rule_pairs(ents: DataFrame, rules: list[Rule], side: str = "both") -> DataFrame:
    """(source1_entity_id, target_entity_id, rule, no), a row for each rule that makes the pair; caps ignore the country."""
    k = keys(ents, rules).withColumn("key", F.unhex(F.md5("key")))  # a key is as long as a line
    good = eligible(frequencies(k), side)
    left = k.filter("src = 1").join(good, ["no", "key"]).select("no", "key", F.col("id").alias("source1_entity_id"), F.col("country").alias("c1"), "t2", "t3")
    right = k.filter("src > 1").select("no", "key", "rule", "same", "src", F.col("id").alias("target_entity_id"), F.col("country").alias("c2"))
    met = left.join(right, ["no", "key"]).filter(F.when(F.col("src") == 2, F.col("t2")).otherwise(F.col("t3")))
    return met.filter(~F.col("same") | (F.col("c1") == F.col("c2"))).select("source1_entity_id", "target_entity_id", "rule", "no")


def pairs(ents: DataFrame, rules: list[Rule], side: str = "both") -> DataFrame:
    """Distinct pairs of all rules."""
    if side == "none":
        return sharing(ents, [[r] for r in rules])
    return rule_pairs(ents, rules, side).select("source1_entity_id", "target_entity_id").distinct()


def _digest(r: Rule) -> Column:
    """The key's 128-bit hash, with the country's where that counts; null if the key is not usable."""
    key = r.key()
    usable = (key != "") & (F.length(key) >= r.least)
    if r.same_country:
        return F.when(usable, F.unhex(F.md5(F.concat(F.md5(key), F.md5("country")))))
    return F.when(usable, F.unhex(F.md5(key)))


def _products(some: Column, more: Column) -> Column:
    return F.flatten(F.transform(some, lambda x: F.transform(more, lambda y: F.concat(x, y))))


def _marked(some: Column, no: int) -> Column:
    return F.transform(some, lambda x: F.unhex(F.md5(F.concat(F.lit(bytearray([no])), x))))


def _choices(ents: DataFrame, ways: list[list[Rule]]) -> DataFrame:
    """(first, id, w0, w1, ...): for each id of source 1 (first) or of the targets and each way one hash for each choice of its
    keys under that way's rules; so two ids share a hash of a way if they share a key under each of its rules. Caps do not count."""
    rules = list(dict.fromkeys(r for way in ways for r in way))
    rows = ents.filter(F.col("src").isin(1, 2, 3)).select((F.col("src") == 1).alias("side"), F.col("entity_id").alias("id"), *[_digest(r).alias(f"k{i}") for i, r in enumerate(rules)])
    # first is an aggregate, so that no filter of a side goes below the exchange, which all readers share
    rows = rows.groupBy("side", "id").agg(F.max("side").alias("first"), *[F.collect_set(f"k{i}").alias(f"k{i}") for i in range(len(rules))])
    each = []
    for no, way in enumerate(ways):
        some = F.col(f"k{rules.index(way[0])}")
        for r in way[1:]:
            some = _products(some, F.col(f"k{rules.index(r)}"))
        each.append(_marked(some, no).alias(f"w{no}"))
    return rows.select("first", "id", *each)


def sharing(ents: DataFrame, ways: list[list[Rule]]) -> DataFrame:
    """Distinct pairs of ids that share a key under every rule of some way.

    No pair is shuffled: a block is the ids that hold a hash, blocks of the same ids count once, and a pair is made only in the
    first block that both ids hold. Both sides of a block are dealt into chunks by id, and each two chunks meet on their own,
    so a frequent key is spread over many tasks."""
    rows = _choices(ents, ways).select("first", "id", F.concat(*[f"w{i}" for i in range(len(ways))]).alias("held"))
    each = rows.select("first", "id", "held", F.explode("held").alias("h"))
    mark = lambda *c: F.bit_xor(F.xxhash64(*c, "first", "id"))
    blocks = each.groupBy("h").agg(F.count_if("first").alias("n1"), F.count_if(~F.col("first")).alias("nt"), mark().alias("m1"), mark(F.lit("again")).alias("m2")).filter("n1 > 0 AND nt > 0")
    if len(ways) > 1:
        blocks = blocks.groupBy("n1", "nt", "m1", "m2").agg(F.min("h").alias("h"))
    mine = each.join(blocks.select("h", "n1", "nt"), "h")
    if len(ways) > 1:
        mine = mine.groupBy("first", "id").agg(F.collect_list(F.struct("h", "n1", "nt")).alias("b"))
        mine = mine.select("first", "id", F.transform("b", lambda x: x["h"]).alias("held"), F.explode("b").alias("x")).select("first", "id", "held", "x.*")
    a, b = (F.ceil(F.col(n) / CHUNK) for n in ("n1", "nt"))
    own, every = lambda n: F.array(F.pmod(F.xxhash64("id"), n)), lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    one = mine.select("first", "h", "id", F.filter("held", lambda x: x < F.col("h")).alias("before"), F.explode(F.when(F.col("first"), own(a)).otherwise(every(a))).alias("a"), b.alias("nb"))
    one = one.select("first", "h", "a", F.struct("id", "before", F.size("before").alias("n"), F.when(F.size("before") == 1, F.xxhash64(F.get("before", F.lit(0)))).alias("only")).alias("x"), F.explode(F.when(F.col("first"), every(F.col("nb"))).otherwise(own(F.col("nb")))).alias("b"))
    n = int(ents.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, or few small partitions would make all pairs
    met = one.repartition(n, "h", "a", "b").groupBy("h", "a", "b").agg(F.collect_list(F.when(F.col("first"), F.col("x"))).alias("l"), F.collect_list(F.when(~F.col("first"), F.col("x"))).alias("r"))
    met = met.select(F.explode("l").alias("l"), "r").select("l", F.explode("r").alias("r"))
    other = F.when((F.col("l.n") == 0) | (F.col("r.n") == 0), True).when(F.col("l.only") != F.col("r.only"), True).otherwise(~F.arrays_overlap("l.before", "r.before"))
    return met.filter(other).select(F.col("l.id").alias("source1_entity_id"), F.col("r.id").alias("target_entity_id"))


def shared_counts(ents: DataFrame, rules: list[Rule], truth: Rule, targets: tuple[str, ...] = ("S2", "S3")) -> tuple[DataFrame, DataFrame]:
    """What `evaluation.rule_benchmark` counts over the pairs of rules without caps, without making a pair: (target, rule,
    candidate_pairs, s1_with_candidates, true_matches_found), also for all rules as COMBINED, and (target, true_matches_total). True
    pairs are those that share a key of `truth`. Pairs are products of the counts of a hash; those that share several hashes are
    counted by inclusion and exclusion over all choices of an id's hashes, so an id should have few."""
    wide = [r for r in rules if not any(o.name in IMPLIED.get(r.name, ()) and o.least <= 1 and not o.same_country for o in rules)]
    sets = [*((r.name, [[r]]) for r in rules), ("COMBINED", [[r] for r in wide])]
    sets = [(g, False, ways) for g, ways in sets] + [(g, True, [[truth, *w] for w in ways]) for g, ways in [*sets, (None, [[]])]]
    every = [w for _, _, ways in sets for w in ways]
    rows, each, at = _choices(ents, every), [], 0
    for no, (_, _, ways) in enumerate(sets):
        each.append(F.struct(F.lit(no).alias("no"), F.sort_array(F.concat(*[f"w{at + i}" for i in range(len(ways))])).alias("w")))
        at += len(ways)
    rows = rows.select("first", "id", F.explode(F.array(*each)).alias("x")).select("first", "id", "x.*").filter(F.size("w") > 0)
    rows = rows.select("first", "id", "no", "w", F.explode(F.expr("sequence(1, shiftleft(1, size(w)) - 1)")).alias("mask"))
    chosen = F.expr("aggregate(filter(w, (x, i) -> getbit(mask, i) = 1), X'', (a, x) -> concat(a, x))")
    rows = rows.select("first", "id", "no", F.unhex(F.md5(chosen)).alias("h"), F.bit_count("mask").alias("n"))
    target = F.substring_index("id", "-", 1)
    sizes = rows.groupBy("no", "h", "n").agg(F.count_if("first").alias("n1"), *[F.count_if(~F.col("first") & (target == t)).alias(f"of_{t}") for t in targets]).filter("n1 > 0")
    per = sizes.select("no", "n", "n1", F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"of_{t}").alias("nt")) for t in targets])).alias("t")).select("no", "n", "n1", "t.*")
    per = per.groupBy("no", "target").agg(F.sum(F.when(F.col("n") % 2 == 1, 1).otherwise(-1) * F.col("n1") * F.col("nt")).alias("pairs"))
    met = rows.filter(F.col("first") & (F.col("n") == 1)).join(sizes.filter("n = 1"), ["no", "h"]).groupBy("no", "id").agg(*[F.max(F.col(f"of_{t}") > 0).alias(t) for t in targets])
    met = met.groupBy("no").agg(*[F.count_if(t).alias(t) for t in targets])
    met = met.select("no", F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("s1")) for t in targets])).alias("t")).select("no", "t.*")
    both = per.filter("pairs > 0").join(met, ["no", "target"])  # some rows a rule
    half = len(rules) + 1
    name = F.element_at(F.array(*[F.lit(g) for g, _, _ in sets[:half]]), F.col("no") + 1)
    made = both.filter(F.col("no") < half).select("no", "target", name.alias("rule"), F.col("pairs").alias("candidate_pairs"), F.col("s1").alias("s1_with_candidates"))
    true = both.filter((F.col("no") >= half) & (F.col("no") < 2 * half)).select((F.col("no") - half).alias("no"), "target", F.col("pairs").alias("true_matches_found"))
    counts = made.join(true, ["no", "target"], "left").fillna(0, ["true_matches_found"]).drop("no")
    return counts, both.filter(F.col("no") == 2 * half).select("target", F.col("pairs").alias("true_matches_total"))


def pairs_with_rules(ents: DataFrame, rules: list[Rule], side: str = "both") -> DataFrame:
    """Distinct pairs with the sorted names of the rules that make them."""
    return rule_pairs(ents, rules, side).groupBy("source1_entity_id", "target_entity_id").agg(F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("block_rules"))


def with_more(ents: DataFrame, rules: list[Rule], more: DataFrame) -> DataFrame:
    """Distinct pairs of the rules without caps, and those of `more` that share no key: only `more` is shuffled."""
    rows = _choices(ents, [[r] for r in rules]).select("first", "id", F.concat(*[f"w{i}" for i in range(len(rules))]).alias("held"))
    left = rows.filter("first").select(F.col("id").alias("source1_entity_id"), F.col("held").alias("l"))
    right = rows.filter(~F.col("first")).select(F.col("id").alias("target_entity_id"), F.col("held").alias("r"))
    new = more.select("source1_entity_id", "target_entity_id").distinct().join(left, "source1_entity_id").join(right, "target_entity_id").filter(~F.arrays_overlap("l", "r"))
    return pairs(ents, rules, "none").unionByName(new.select("source1_entity_id", "target_entity_id"))


def any_equal(ents: DataFrame, columns: list[str]) -> DataFrame:
    """An OR of equalities as a union of equi-joins: a disjunction would be planned as a nested loop."""
    return pairs(ents, [Rule(c, _col(c)) for c in columns], "none")


def new_pairs(found: DataFrame, known: DataFrame) -> DataFrame:
    return found.join(known, ["source1_entity_id", "target_entity_id"], "left_anti").distinct()


def block_statistics(ents: DataFrame, r: Rule, cap: int, target: int = 2) -> DataFrame:
    """Keys within the cap on both sides and the pairs they make, without making them."""
    f = frequencies(keys(ents, [r])).filter(F.col("n1").between(1, cap) & F.col(f"n{target}").between(1, cap))
    return f.agg(F.count("*").alias("distinct_keys"), F.coalesce(F.sum(F.col("n1") * F.col(f"n{target}")), F.lit(0)).alias("candidate_pairs"))


def largest_blocks(ents: DataFrame, r: Rule, cap: int, target: int = 2, n: int = 30) -> DataFrame:
    f = frequencies(keys(ents, [r])).filter(F.col("n1").between(1, cap) & F.col(f"n{target}").between(1, cap))
    f = f.select("key", F.col("n1").alias("s1_count"), F.col(f"n{target}").alias("target_count"), (F.col("n1") * F.col(f"n{target}")).alias("candidate_pairs"))
    return f.orderBy(F.desc("candidate_pairs"), "key").limit(n)


def cap_sweep(ents: DataFrame, truth: DataFrame, names=R_CAP[0], caps=R_CAP[1], target: int = 2) -> DataFrame:
    """Pairs and true pairs recovered for each rule and cap: made once under the largest cap, counted for each smaller one."""
    rules = [rule(n, 1, max(caps)) for n in names]
    k = keys(ents.filter(F.col("src").isin(1, target)), rules)
    need = F.greatest("n1", f"n{target}").alias("need")
    f = frequencies(k).filter((F.col("n1") > 0) & (F.col(f"n{target}") > 0)).filter(F.greatest("n1", f"n{target}") <= max(caps))
    left = k.filter("src = 1").join(f.select("no", "key", need), ["no", "key"]).select("no", "key", "rule", "need", F.col("id").alias("source1_entity_id"))
    met = left.join(k.filter(F.col("src") == target).select("no", "key", F.col("id").alias("target_entity_id")), ["no", "key"])
    met = met.join(truth.withColumn("hit", F.lit(1)), ["source1_entity_id", "target_entity_id"], "left")
    counts = [x for c in caps for x in (F.count_if(F.col("need") <= c).alias(f"p{c}"), F.count_if((F.col("need") <= c) & F.col("hit").isNotNull()).alias(f"h{c}"))]
    wide = met.groupBy("rule").agg(*counts)
    rows = F.array(*[F.struct(F.lit(c).alias("cap"), F.col(f"p{c}").alias("pairs"), F.col(f"h{c}").alias("recovered")) for c in caps])
    return wide.select("rule", F.explode(rows).alias("r")).select("rule", "r.*")
