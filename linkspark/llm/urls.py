"""URL filter: a broadcast trie over reversed host labels and path segments, longest match wins.

Rules are (verdict, host, path). A rule fits its host and all subdomains when the url's path starts with
the rule's path; the rule with most characters (host and path) wins, the one with the longer host among equals, so an
allow entry can stand inside a block entry and the other way round. Of several entries for one host and path the
last counts. The rule list is the bound of what is broadcast (MOST_RULES entries of a few hundred bytes); longer
lists come as a table, and `judge_by_table` joins it by host.

Defined cases: a null url, or one without "://", has empty host and path and no rule; the default verdict is
allow; an empty table gives an empty result; repeated rows are judged each; other columns are kept.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm.common import LOWER, UPPER, prepare, read

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
DEFAULT, MOST_RULES = "allow", 200_000
_LOWER = str.maketrans(UPPER, LOWER)


class Trie:
    """Nodes are [children by label, path node or None]; path nodes are [children by segment, (verdict, rule) that ends
    at a slash here, list of (partial segment, verdict, rule)]."""

    def __init__(self, rules=RULES):
        if len(rules) > MOST_RULES:
            raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} are broadcast, judge_by_table takes more")
        self.root = [{}, None]
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node[0].setdefault(label, [{}, None])
            if node[1] is None:
                node[1] = [{}, None, []]
            *whole, last = path.split("/")
            at = node[1]
            for segment in whole:
                at = at[0].setdefault(segment, [{}, None, []])
            if last:
                at[2][:] = [x for x in at[2] if x[0] != last]
                at[2].append((last, verdict, host + path))
                at[2].sort(key=lambda x: -len(x[0]))
            else:
                at[1] = (verdict, host + path)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest rule that fits, or None."""
        best, node = None, self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node[0].get(label)
            if node is None:
                break
            if node[1] is not None:
                found = self._path(node[1], segments)
                best = found if found and (best is None or len(found[1]) >= len(best[1])) else best
        return best

    @staticmethod
    def _path(at: list, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for i, segment in enumerate(segments):
            if at[1] is not None:
                best = at[1]
            best = next(((v, r) for part, v, r in at[2] if segment.startswith(part)), best)
            if i == len(segments) - 1:
                break
            at = at[0].get(segment)
            if at is None:
                break
        return best


def parts(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    tail = rest[end:]
    cut = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return rest[:end].translate(_LOWER), tail[:cut]


def judge(pages: DataFrame, rules=RULES, default: str = DEFAULT) -> DataFrame:
    """pages with host, path, rule and verdict in place of columns of those names."""
    spark = pages.sparkSession
    prepare(spark)
    trie = spark.sparkContext.broadcast(Trie(rules))
    verdicts = pa.struct([(x, pa.string()) for x in ("host", "path", "rule", "verdict")])

    @F.arrow_udf("host string, path string, rule string, verdict string")
    def judged(urls: pa.Array) -> pa.Array:
        rows = []
        for url in urls.to_pylist():
            host, path = parts(url)
            found = trie.value.match(host, path)
            rows.append({"host": host, "path": path, "rule": found and found[1], "verdict": found[0] if found else default})
        return pa.array(rows, verdicts)

    out = pages.select(F.struct(*pages.columns).alias("row"), judged(pages["url"].cast("string")).alias("j"))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in pages.columns if c not in JUDGED], "j.*")


JUDGED = ("host", "path", "rule", "verdict")


def judge_by_table(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """judge for any number of rules: columns verdict, host, path and no, the entry's place in its list. A url meets the rules of its
    host and of every domain above it in one equi-join, and distinct urls are looked up once."""
    prepare(pages.sparkSession)

    @F.arrow_udf("host string, path string")
    def split(urls: pa.Array) -> pa.Array:
        return pa.array([dict(zip(("host", "path"), parts(u))) for u in urls.to_pylist()], pa.struct([("host", pa.string()), ("path", pa.string())]))

    last = rules.groupBy("host", "path").agg(F.max_by("verdict", "no").alias("verdict"))
    last = last.select(F.col("host").alias("domain"), F.col("path").alias("start"), "verdict")
    keyed = pages.select(F.struct(*pages.columns).alias("row"), split(pages["url"].cast("string")).alias("j"))
    labels = F.split("j.host", "[.]")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = keyed.select("j").distinct().withColumn("domain", F.explode(domains)).join(last, "domain").filter(F.startswith("j.path", "start"))
    rank = F.struct(F.length(F.concat("domain", "start")), F.length("domain"))
    best = met.groupBy("j").agg(F.max_by(F.struct(F.concat("domain", "start").alias("rule"), "verdict"), rank).alias("m"))
    out = keyed.join(best.withColumnRenamed("j", "j2"), F.col("j") == F.col("j2"), "left")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in pages.columns if c not in JUDGED], "j.*", F.col("m.rule").alias("rule"), F.coalesce("m.verdict", F.lit(default)).alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH r(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
a AS (SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT page_id, host, path, (SELECT struct_pack(s := h || p, v := verdict) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC, length(h) DESC LIMIT 1) AS m FROM b)
SELECT page_id, host, path, m.s AS rule, coalesce(m.v, 'allow') AS verdict FROM c
"""
