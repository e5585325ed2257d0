"""Suffix-array dedup: a logarithmic family of sparse suffix indexes finds every repeated byte string.

The suffixes that are indexed start at anchors: in every string of LENGTH bytes, the GRAM-byte string with
the least hash marks its place, so equal strings mark equal places (about 3.5 % of all positions). An
index is a table of suffixes in a fixed order - by the hash of their first GRAM bytes, then by the hash of
the context that a string of LENGTH bytes around the anchor can reach - with the first place of each
distinct context. It plays the part of a bytewise suffix array, whose construction over whole texts in
Python costs several times the time that is to be met.

Batches of documents come in ascending order. A batch's own index is merge-scanned with all levels: a context
met before means that everything it spans is repeated; anchors with several different contexts go to an
exact comparison of all LENGTH-byte strings around them. New contexts become a level, and two levels
of one size merge into the next, so a document is rewritten a logarithmic number of times.

Skew: equal contexts of a partition are combined before the shuffle. An anchor with very many different
contexts in one partition (a frequent passage in many surroundings) is dealt by context. Contexts to be compared are
counted over all batches and partitions: an anchor's strings are compared in one task if there are GROUP or fewer,
else by a grouped minimum with partial aggregation.

Defined cases: a null or empty text has no bytes; documents with equal doc_id are ordered by a hash of their
texts, null ids first, and rows equal in both are one document whose result they share; documents under
LENGTH bytes stay whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm.common import delete, new_path, prepare, read, row_key, small, text_of, written
from linkspark.llm.packing import places

LENGTH, GRAM, BATCHES, HOT, FLUSH, SALTS = 100, 40, 4, 512, 1_000_000, 64
#: Bytes of text that are hashed at once, and contexts that are compared at once: a worker holds some 150 and 10,000 bytes for each.
PIECE, COMPARED = 400_000, 6_000
#: Contexts of an anchor that one task compares.
GROUP = 1024
REACH = LENGTH - GRAM
SPAN = LENGTH + REACH  # bytes of a whole context
ENTRY, COVERED, NEED, NEED_HOT, LEVEL = range(5)
_P = np.uint64(0x9E3779B97F4A7C15)
FIELDS = pa.schema([("kind", pa.int8()), ("h", pa.int64()), ("ctx", pa.int64()), ("doc", pa.int64()), ("pos", pa.int32()), ("end", pa.int32()), ("salt", pa.int8())])
TYPES = "kind byte, h bigint, ctx bigint, doc bigint, pos int, end int, salt byte"


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of the k values from each place on, along the last axis; by doubling."""
    cur, h, p = 1, values, _P
    out, at, mul = None, 0, {}
    parts = {}
    with np.errstate(over="ignore"):
        while True:
            parts[cur], mul[cur] = h, p
            if cur * 2 > k:
                break
            h, p, cur = h[..., :-cur] * p + h[..., cur:], p * p, cur * 2
        for size in sorted(parts, reverse=True):
            if k - at >= size:
                piece = parts[size][..., at:]
                n = piece.shape[-1] if out is None else min(out.shape[-1], piece.shape[-1])
                out = piece if out is None else out[..., :n] * mul[size] + piece[..., :n]
                at += size
        out = out[..., : values.shape[-1] - k + 1]
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each window of w values."""
    cur = 1
    while cur * 2 <= w:
        x = pick(x[:-cur], x[cur:])
        cur *= 2
    rest = w - cur
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """For the anchors of all texts (each of LENGTH bytes or more): number of the text, place, hash, context hash."""
    gap = bytes(REACH)
    joined = np.frombuffer(gap + gap.join(texts) + gap, np.uint8).astype(np.uint64) + np.uint64(1)
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = REACH + np.cumsum(np.r_[0, lengths[:-1] + REACH])
    inside = np.zeros(len(joined) + 1, np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + lengths, -1)
    joined[np.cumsum(inside)[:-1] == 0] = 0
    grams = rolling(joined, GRAM)
    least = sliding(grams, LENGTH - GRAM + 1, np.minimum)
    whole = np.zeros(len(least) + 1, np.int64)  # windows that lie in one text
    np.add.at(whole, starts, 1)
    np.add.at(whole, starts + lengths - LENGTH + 1, -1)
    least[np.cumsum(whole)[:-1] == 0] = 0
    pad = np.zeros(LENGTH - GRAM, np.uint64)
    over = sliding(np.r_[pad, least, pad], LENGTH - GRAM + 1, np.maximum)
    at = np.flatnonzero(grams == over)
    at = at[over[at] != 0]
    contexts = rolling(joined, SPAN)
    text = np.searchsorted(starts, at, side="right") - 1
    return text, at - starts[text], grams[at].view(np.int64), contexts[at - REACH].view(np.int64)


def _rows(kind, h, ctx, doc, pos, end, salt) -> pa.RecordBatch:
    n = len(doc)
    full = lambda v, t: np.full(n, v, t) if np.isscalar(v) else np.asarray(v).astype(t)
    return pa.RecordBatch.from_arrays([pa.array(full(v, t)) for v, t in zip((kind, h, ctx, doc, pos, end, salt), (np.int8, np.int64, np.int64, np.int64, np.int32, np.int32, np.int8))], schema=FIELDS)


def merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals of each document joined where they touch."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order].astype(np.int64), hi[order].astype(np.int64)
    # ends run up within a document; documents are kept apart by a large step
    step = np.cumsum(np.r_[0, doc[1:] != doc[:-1]]) * (1 << 32)
    reach = np.maximum.accumulate(hi + step)
    new = np.r_[True, (lo + step)[1:] > reach[:-1]]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(doc)] - 1
    return doc[first], lo[first], (reach - step)[last]


def _covered(doc, pos, end) -> Iterator[pa.RecordBatch]:
    """Everything that contexts at these places span, if a string of LENGTH bytes fits. end: of the context."""
    lo = np.maximum(pos - REACH, 0)
    ok = end - lo >= LENGTH
    if ok.any():
        d, a, b = merged(doc[ok], lo[ok], end[ok])
        yield _rows(COVERED, 0, 0, d, a, b, 0)


def suffixes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map side of a batch: first places of distinct contexts of the partition, and what repeats inside it."""
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        doc, pos, end, h, ctx = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.lexsort((pos, doc, ctx, h))
        doc, pos, end, h, ctx = doc[order], pos[order], end[order], h[order], ctx[order]
        fresh = np.r_[True, (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1])]
        yield from _covered(doc[~fresh], pos[~fresh], end[~fresh])
        doc, pos, end, h, ctx = doc[fresh], pos[fresh], end[fresh], h[fresh], ctx[fresh]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        sizes = np.diff(np.r_[first, len(h)])
        hot = np.repeat(sizes > HOT, sizes)
        yield _rows(ENTRY, h, ctx, doc, pos, end - pos, np.where(hot, 1 + (ctx % SALTS), 0))
        notices = h[first[sizes > HOT]]
        if len(notices):
            yield _rows(ENTRY, notices, 0, np.full(len(notices), -(1 << 62)), -1, 0, 0)

    def some(docs: list[int], texts: list[bytes]) -> None:
        text, pos, h, ctx = anchors(texts)
        lengths = np.array([len(t) for t in texts])
        held.append((np.array(docs, np.int64)[text], pos, np.minimum(lengths[text], pos + LENGTH), h, ctx))

    for batch in it:
        docs, texts, n = [], [], 0
        for d, t in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
            if len(t) >= LENGTH:
                docs.append(d)
                texts.append(t)
                n += len(t)
            if n > PIECE:
                some(docs, texts)
                docs, texts, n = [], [], 0
        if texts:
            some(docs, texts)
        if sum(len(x[0]) for x in held) > FLUSH:
            yield from flush()
    if held:
        yield from flush()


def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge scan of a batch (kind ENTRY) with the levels (kind LEVEL), rows sorted by h, salt, ctx, doc, pos."""

    def done(kind, h, ctx, doc, pos, end, salt) -> Iterator[pa.RecordBatch]:
        past = kind == COVERED
        if past.any():
            yield _rows(COVERED, 0, 0, *merged(doc[past], pos[past], end[past]), 0)
            if past.all():
                return
            kind, h, ctx, doc, pos, end, salt = (x[~past] for x in (kind, h, ctx, doc, pos, end, salt))
        end = pos + end  # of entries and levels: kept as a length, which compresses better
        group = np.r_[True, (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])]
        number = np.cumsum(group) - 1
        n = number[-1] + 1
        notice = pos < 0
        noticed = np.bincount(number[notice], minlength=n) > 0
        fresh = group | np.r_[True, ctx[1:] != ctx[:-1]]
        fresh[1:] |= notice[:-1]
        repeat = ~fresh & (kind == ENTRY) & ~notice
        yield from _covered(doc[repeat], pos[repeat], end[repeat])
        first = fresh & ~notice
        new = first & (kind == ENTRY)
        tell = notice & (kind == ENTRY)
        # a notice stands for entries under other salts, which older rows of this group have not met
        active = np.bincount(number[new | tell], minlength=n) > 0
        several = np.bincount(number[first], minlength=n) > 1
        hot = (noticed | (salt[np.flatnonzero(group)] > 0))[number]
        for want, as_kind in ((first & hot & active[number], NEED_HOT), (first & ~hot & (active & several)[number], NEED)):
            if want.any():
                yield _rows(as_kind, h[want], ctx[want], doc[want], pos[want], end[want], 0)
        keep = new | (tell & ~np.r_[False, (notice[:-1] & ~group[1:])])
        if keep.any():
            yield _rows(LEVEL, h[keep], ctx[keep], doc[keep], pos[keep], (end - pos)[keep], salt[keep])

    held, n = [], 0
    for batch in it:
        if not batch.num_rows:
            continue
        held.append([batch.column(f.name).to_numpy(zero_copy_only=False) for f in FIELDS])
        n += batch.num_rows
        if n >= 200_000:
            rows = [np.concatenate(x) for x in zip(*held)]
            same = (rows[1] == rows[1][-1]) & (rows[6] == rows[6][-1])
            cut = n if not same[-1] else int(np.argmax(same))  # equal groups are adjacent
            if cut:
                yield from done(*(x[:cut] for x in rows))
            held, n = [[x[cut:] for x in rows]], n - cut
    if held and n:
        yield from done(*(np.concatenate(x) for x in zip(*held)))


def contexts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes around the places that need an exact comparison; lead: how far the context starts before the place."""
    schema = pa.schema([("kind", pa.int8()), ("h", pa.int64()), ("doc", pa.int64()), ("pos", pa.int32()), ("bytes", pa.binary())])
    for batch in it:
        kinds, hs, docs, poss, cut = [], [], [], [], []
        for doc, text, wants in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "wants"))):
            for w in wants:
                p = w["pos"]
                kinds.append(w["kind"])
                hs.append(w["h"])
                docs.append(doc)
                poss.append(p)
                cut.append(text[max(0, p - REACH) : p + LENGTH])
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int8()), pa.array(hs, pa.int64()), pa.array(docs, pa.int64()), pa.array(poss, pa.int32()), pa.array(cut, pa.binary())], schema=schema)


def strings(pos: np.ndarray, cut: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the LENGTH-byte strings at each of the REACH + 1 offsets around each place, and which of them exist."""
    m = np.zeros((len(cut), SPAN), np.uint8)
    lead = np.maximum(REACH - pos, 0)
    size = np.array([len(c) for c in cut])
    for i, (a, c) in enumerate(zip(lead.tolist(), cut)):
        m[i, a : a + len(c)] = np.frombuffer(c, np.uint8)
    offset = np.arange(REACH + 1)
    exists = (offset >= lead[:, None]) & (offset + LENGTH <= (lead + size)[:, None])
    return rolling(m.astype(np.uint64), LENGTH), exists


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """Equal strings around equal anchors stand at equal offsets, so the offset belongs to the hash."""
    with np.errstate(over="ignore"):
        return hashes ^ (np.arange(1, REACH + 2, dtype=np.uint64) * _P)


def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by h, doc, pos: intervals whose strings stand earlier in the same group of h."""

    def done(h, doc, pos, cut) -> Iterator[pa.RecordBatch]:
        hashes, exists = strings(pos, cut)
        group = np.cumsum(np.r_[True, h[1:] != h[:-1]]).astype(np.uint64)
        with np.errstate(over="ignore"):
            key = _mixed(hashes) + (group * np.uint64(0xD6E8FEB86659FD93))[:, None]
        flat = np.flatnonzero(exists.reshape(-1))
        where = np.unique(key.reshape(-1)[flat], return_index=True)[1]
        repeated = exists.copy()
        repeated.reshape(-1)[flat[where]] = False
        some = np.flatnonzero(repeated.any(axis=1))
        if len(some):
            low = repeated[some].argmax(axis=1)
            high = REACH - repeated[some][:, ::-1].argmax(axis=1)
            base = pos[some].astype(np.int64) - REACH
            yield _rows(COVERED, 0, 0, *merged(doc[some], base + low, base + high + LENGTH), 0)

    held, n = [], 0
    for batch in it:
        if not batch.num_rows:
            continue
        held.append((batch.column("h").to_numpy(), batch.column("doc").to_numpy(), batch.column("pos").to_numpy(), batch.column("bytes").to_pylist()))
        n += batch.num_rows
        if n >= COMPARED:
            h, doc, pos = (np.concatenate([x[i] for x in held]) for i in range(3))
            cut = [c for x in held for c in x[3]]
            at = int(np.argmax(h == h[-1]))
            if at:
                yield from done(h[:at], doc[:at], pos[:at], cut[:at])
            held, n = [(h[at:], doc[at:], pos[at:], cut[at:])], n - at
    if held and n:
        h, doc, pos = (np.concatenate([x[i] for x in held]) for i in range(3))
        yield from done(h, doc, pos, [c for x in held for c in x[3]])


def spread(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each string around a hot anchor: its hash and where it starts."""
    schema = pa.schema([("h", pa.int64()), ("s", pa.int64()), ("doc", pa.int64()), ("start", pa.int64())])
    for batch in it:
        h, doc, pos, cut = batch.column("h").to_numpy(), batch.column("doc").to_numpy(), batch.column("pos").to_numpy(), batch.column("bytes").to_pylist()
        for a in range(0, len(cut), 2000):
            hashes, exists = strings(pos[a : a + 2000], cut[a : a + 2000])
            i, o = np.nonzero(exists)
            yield pa.RecordBatch.from_arrays([pa.array(h[a + i]), pa.array(_mixed(hashes)[i, o].view(np.int64)), pa.array(doc[a + i]), pa.array(pos[a + i].astype(np.int64) - REACH + o)], schema=schema)


def joined(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered strings (doc, start) as merged intervals; those of a document are in one partition."""
    held, n = [], 0
    for batch in it:
        if batch.num_rows:
            held.append((batch.column("doc").to_numpy(), batch.column("start").to_numpy()))
            n += batch.num_rows
        if n > 500_000:
            doc, start = (np.concatenate(x) for x in zip(*held))
            yield _rows(COVERED, 0, 0, *merged(doc, start, start + LENGTH), 0)
            held, n = [], 0
    if held:
        doc, start = (np.concatenate(x) for x in zip(*held))
        yield _rows(COVERED, 0, 0, *merged(doc, start, start + LENGTH), 0)


def _release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished steps, which nothing reads any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class SuffixIndex:
    """Levels of a growing corpus. `add` takes batches of (doc, text) whose docs are larger than all before."""

    def __init__(self, spark: SparkSession):
        self.spark, self.levels, self.found = spark, [], []  # levels: (size, table, path)

    def add(self, docs: DataFrame, last: bool = False) -> None:
        """last: no batch will follow, so no level is written and all are removed."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, a, old_a), (_, b, old_b) = self.levels.pop(), self.levels.pop()
            both = a.unionByName(b).repartition("h", "salt").sortWithinPartitions("h", "salt", "ctx", "doc", "pos")
            path = new_path(self.spark, f"suffix-level{size + 1}")
            self.levels.append((size + 1, written(both, "", path=path), path))
            for old in (old_a, old_b):
                delete(self.spark, old)
        self._scan(docs, last)
        if last:
            for _, _, path in self.levels:
                delete(self.spark, path)
            self.levels = []
        _release(self.spark)

    def _scan(self, docs: DataFrame, last: bool) -> None:
        rows = docs.mapInArrow(suffixes, TYPES)
        for _, level, _ in self.levels:
            rows = rows.unionByName(level)
        # what a partition found by itself passes through the scan, dealt by document
        salt = F.when(F.col("kind") == COVERED, F.pmod("doc", F.lit(100)).cast("byte")).otherwise(F.col("salt"))
        dealt = rows.withColumn("salt", salt).repartition("h", "salt").sortWithinPartitions("h", "salt", "ctx", "doc", "pos")
        out = dealt.mapInArrow(scan, TYPES)
        path = new_path(self.spark, "suffix-scan")
        if last:
            self.found.append(written(out.filter(F.col("kind") != LEVEL), "", path=path))
            return
        # a folder for what is found and one for the level, as each kind of its own would make many small files
        out = written(out.withColumn("level", F.col("kind") == LEVEL), "", "level", path)
        self.found.append(out.filter(~F.col("level")).drop("level"))
        self.levels.append((0, out.filter("level").drop("level"), f"{path}/level=true"))


def _keyed(docs: DataFrame) -> DataFrame:
    """docs as (doc, text): doc is doc_id, or where ids repeat or are null, the rank of (doc_id, hash of text)."""
    narrow = docs.select(*row_key(docs))
    text = text_of(docs).cast("binary").alias("text")
    if narrow.filter("_d IS NULL").isEmpty() and narrow.groupBy("_d").count().filter("count > 1").isEmpty():
        return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["doc_id"].cast("long").alias("doc"), text)
    ids = written(narrow.distinct().withColumn("_id", F.monotonically_increasing_id()), "doc-ids")
    ranks = places(ids.select(F.col("_d").alias("key"), F.col("_th").alias("_tie"), "_id", F.lit(1).cast("long").alias("n_tokens"))).join(ids, "_id")
    ranks = written(ranks.select(F.col("_d").alias("_rd"), F.col("_th").alias("_rth"), F.col("_at").alias("doc")), "doc-ranks")
    keyed = docs.select(*row_key(docs), text)
    return written(keyed.join(ranks, keyed["_d"].eqNullSafe(ranks["_rd"]) & (keyed["_th"] == ranks["_rth"])).select(F.col("_d").alias("doc_id"), "doc", "text"), "ranked-docs")


def repeats(keyed: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(doc, lo, hi): byte intervals that a string of LENGTH bytes which starts earlier covers. keyed: doc, text."""
    spark = keyed.sparkSession
    docs = keyed.select("doc", "text")
    cuts = keyed.select(F.percentile_approx("doc", [i / batches for i in range(1, batches)], 10_000).alias("p")).first()["p"] or []
    cuts = sorted(set(cuts))
    index = SuffixIndex(spark)
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = docs
        if low is not None:
            part = part.filter(F.col("doc") > low)
        if high is not None:
            part = part.filter(F.col("doc") <= high)
        index.add(part, last=high is None)
    found = index.found[0]
    for x in index.found[1:]:
        found = found.unionByName(x)
    # exact comparison where an anchor has several contexts
    needs = found.filter(F.col("kind").isin(NEED, NEED_HOT)).select("kind", "h", "doc", "pos")
    many = needs.groupBy("h").agg(F.count("*").alias("n"), F.max("kind").alias("as_kind")).filter((F.col("n") > GROUP) | (F.col("as_kind") == NEED_HOT))
    many = written(many.select("h", F.lit(NEED_HOT).cast("byte").alias("as_kind")), "hot-anchors")
    needs = needs.join(small(many), "h", "left").withColumn("kind", F.coalesce("as_kind", "kind"))
    wants = needs.groupBy("doc").agg(F.collect_set(F.struct(F.col("kind"), F.col("h"), F.col("pos"))).alias("wants"))
    near = docs.join(wants, "doc").mapInArrow(contexts, "kind byte, h bigint, doc bigint, pos int, bytes binary")
    near = written(near, "contexts", "kind")
    _release(spark)
    mild = near.filter(F.col("kind") == NEED).select("h", "doc", "pos", "bytes").repartition("h").sortWithinPartitions("h", "doc", "pos")
    spans = mild.mapInArrow(compare, TYPES)
    hot = near.filter(F.col("kind") == NEED_HOT)
    if not hot.isEmpty():
        each = written(hot.select("h", "doc", "pos", "bytes").mapInArrow(spread, "h bigint, s bigint, doc bigint, start bigint"), "hot-strings")
        first = each.groupBy("h", "s").agg(F.min(F.struct("doc", "start")).alias("f"))
        again = each.join(first, ["h", "s"]).filter((F.col("doc") != F.col("f.doc")) | (F.col("start") != F.col("f.start")))
        spans = spans.unionByName(again.select("doc", "start").repartition("doc").mapInArrow(joined, TYPES))
    spans = spans.unionByName(found.filter(F.col("kind") == COVERED))
    return written(spans.select("doc", F.col("pos").alias("lo"), F.col("end").alias("hi")), "spans")


def dedup(docs: DataFrame, batches: int = BATCHES, with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, and kept (the bytes left)."""
    prepare(docs.sparkSession)
    keyed = _keyed(docs)
    spans = repeats(keyed, batches).groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    _release(docs.sparkSession)
    kinds = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.binary())] if with_bytes else [])]
    out_type = pa.struct(kinds)

    @F.arrow_udf("n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_bytes)
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        rows = []
        for text, found in zip(texts.to_pylist(), spans.to_pylist()):
            left, at, removed, n = [], 0, 0, 0
            for lo, hi in sorted((s["lo"], s["hi"]) for s in found or ()):
                if lo > at or not n:
                    left.append(text[at:lo])
                    n += 1
                    at = lo
                if hi > at:
                    removed += hi - at
                    at = hi
            left.append(text[at:])
            kept = b"".join(left)
            rows.append((len(text), removed, n, hashlib.sha256(kept).hexdigest(), kept)[: len(kinds)])
        cols = list(zip(*rows)) if rows else [()] * len(kinds)
        return pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, kinds)], fields=list(out_type))

    return keyed.join(spans, "doc", "left").select("doc_id", cut("text", "spans").alias("c")).select("doc_id", "c.*")


def op6_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), with_bytes=False)
