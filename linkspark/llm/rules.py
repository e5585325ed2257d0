"""Quality rules: base rules on counts, then an n-gram perplexity band for each language.

The model is a modified Kneser-Ney model over character 6-grams of 32 symbol classes (letters without case,
marks of the base rules, digit, white space, sentence marks, others, other bytes). Texts are gathered in chunks; each
chunk lists its distinct n-grams with counts, so what is gathered grows with the input. Lists are dealt to shards by
the symbols between an n-gram's first and last, so a shard has whole contexts and whole suffixes: it merges its
lists into sorted arrays and finds the probabilities of orders 6 and 5 by itself. Orders 1 to 4 have a bound (32 ** 4
n-grams a language): one group a language makes their model and gives each shard the probabilities of the 4-grams in
it. Nothing of the models is collected or broadcast, so every language has its own, however many there are; each
chunk's lists get their scores back in their shards.

There are at most MOST_SHARDS shards, so a chunk has a bounded number of lists, and a shard's distinct n-grams are some
million at most. Lists are merged and looked up as streams of rows in order of their shard, in blocks of BLOCK chunks, so no
task holds a list of every chunk, and a shard that many chunks fill is many tasks.

A model would know by heart a text that has many copies, and the text would look too predictable. A run of LEAST_UNIT
symbols or more up to a sentence mark is therefore counted once a language: that occurrence which follows the least symbols.
Its n-grams are then the same whichever of equal ones is taken, so scores do not depend on which rows share a chunk.

A document's score is its mean negative log probability a character. A language's band is the median of
its documents' scores, plus and minus BAND robust standard deviations and a term that widens for short
texts; medians come from a histogram of all scores with steps of 1/1000, so reruns agree. Documents outside
the band, or failing a base rule, are not kept.

Defined cases: a null or empty text has no words and fails the base rules; a null language is one of the
languages; repeated rows are judged each; an empty table gives an empty result; other columns are kept by
`drop_low_quality` and may have any name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkspark.llm.common import bucketed, on_key, prepare, read, row_key, text_of, written

LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
#: Orders up to LOW have a bound and one group a language makes them; the two above, up to ORDER, are found in their shards.
LOW, ORDER, SYMBOLS, BITS = 4, 6, 32, 5
BAND, LEAST_SPREAD, SHORT = 2.0, 0.02, 3.2
SIZE = SYMBOLS**LOW
SPACE, MARK = 28, 29
PAD = bytes([SPACE]) * (ORDER - 1)
#: Texts gathered in a chunk, and bytes of text for one shard of the n-grams.
CHUNK, SHARD_BYTES, LEAST_SHARDS, MOST_SHARDS = 2 << 20, 32 << 20, 12, 1024
#: Chunks whose lists of a shard meet in one task, and n-grams that it holds before it merges them.
BLOCK, MERGED = 1024, 1 << 20
#: Bits of a long unit's hash within its shard, and of the symbols before it.
UNIT_BITS = 48
#: A task with many languages holds so many chunks' worth of texts, then gives out its largest chunk before it is full.
MOST_HELD = 16
#: Symbols are written once and dealt once, so they are worth a slow level of compression.
LEVEL = 12
#: A run of so many symbols up to a sentence mark is counted once, however many texts repeat it.
LEAST_UNIT = 32


def _classes() -> np.ndarray:
    """Symbol of each byte: letters without case 0-25, marks of the base rules 26, digit 27, white space 28, sentence marks 29, others 30, first bytes
    of longer characters 31. Their further bytes are dealt to 0-25 by value: after a 31 they are no letters, and so differ by character."""
    of = np.full(256, 30, np.uint8)
    of[0xC0:] = 31
    of[0x80:0xC0] = np.arange(64) % 26
    of[ord("a") : ord("z") + 1] = of[ord("A") : ord("Z") + 1] = np.arange(26)
    of[[ord(c) for c in "#*$%&|<>"]] = 26
    of[ord("0") : ord("9") + 1] = 27
    of[[32, *range(9, 14)]] = SPACE
    of[[ord(c) for c in ".,;:?!'\"-()"]] = MARK
    return of


CLASS_OF = _classes().tobytes()


def codes(symbols: np.ndarray) -> np.ndarray:
    """The code of each ORDER-gram of symbols, by the place of its first symbol."""
    n = max(len(symbols) - ORDER + 1, 0)
    out = np.zeros(n, np.int32)
    for i in range(ORDER):
        out <<= BITS
        out |= symbols[i : n + i]
    return out


def starts_of(lengths: list[int]) -> np.ndarray:
    """Where each text of a chunk starts, with the PAD before it."""
    return np.cumsum([0, *(n + len(PAD) for n in lengths[:-1])])


def in_texts(s: np.ndarray, lengths: list[int]) -> np.ndarray:
    """Which symbols of a chunk belong to texts and not to the PAD before each."""
    inside = np.ones(len(s), bool)
    for i in range(len(PAD)):
        inside[starts_of(lengths) + i] = False
    return inside


def gram_codes(s: np.ndarray, lengths: list[int]) -> np.ndarray:
    """Codes of the n-grams that end at each symbol of a chunk's texts."""
    return codes(s)[in_texts(s, lengths)[ORDER - 1 :]]


def units(s: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes and 64-bit hashes of a chunk's units, runs of symbols up to a sentence mark or the end of a text, and the
    ORDER - 1 symbols before each; a text's first unit starts with its PAD and has none."""
    cut = np.zeros(len(s), bool)
    cut[1:] = s[:-1] == MARK
    cut[starts_of(lengths)] = True
    first = np.flatnonzero(cut)
    size = np.diff(first, append=len(s))
    powers = np.multiply.accumulate(np.full(int(size.max()), 0x9E3779B97F4A7C15, np.uint64))
    h = (s.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= powers[np.arange(len(s)) - np.repeat(first, size)]
    h = np.add.reduceat(h, first)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    before = np.zeros(len(first), np.int32)
    for i in range(ORDER - 1, 0, -1):
        before = before << BITS | s[np.maximum(first - i, 0)]
    before[np.isin(first, starts_of(lengths))] = 0
    return size, h ^ (h >> np.uint64(29)), before


def symbols_of(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), np.uint8)


def pack(numbers: np.ndarray) -> bytes:
    """Non-negative numbers, their byte planes apart and compressed."""
    return zstandard.compress(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").reshape(-1)


def pack_sorted(numbers: np.ndarray) -> bytes:
    return pack(np.diff(numbers, prepend=0))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data))


def _some_window_twice(w: np.ndarray) -> bool:
    """If two windows of words have equal hashes; equal windows do."""
    h = w + np.uint64(1)
    size = 1
    while size < WINDOW:
        h = h[:-size] * np.uint64(0x9E3779B97F4A7C15) + (h[size:] ^ (h[size:] >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        size *= 2
    h = np.sort(h)
    return bool((h[1:] == h[:-1]).any())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    spaces = len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r"))
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n >= WINDOW:
        ids: dict[bytes, int] = {}
        w = np.array([ids.setdefault(x, len(ids)) for x in words], np.uint64)
        if len(ids) < n and _some_window_twice(w):
            ranks = w.astype(np.int64)
            size = 1
            while size < WINDOW:  # names of windows of 2, 4 and 8 words, exact
                pairs = ranks[:-size] * (int(ranks.max()) + 1) + ranks[size:]
                ranks = np.unique(pairs, return_inverse=True)[1].reshape(-1)
                size *= 2
            twice = np.flatnonzero(np.bincount(ranks)[ranks] > 1)
            if len(twice):
                cover = np.zeros(n + 1, np.int64)
                np.add.at(cover, twice, 1)
                np.add.at(cover, twice + WINDOW, -1)
                repeated = int((np.cumsum(cover)[:n] > 0).sum())
    return n, len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated


# ---- the language model ----------------------------------------------------------------------------------


def languages(docs: DataFrame) -> dict[str, int]:
    """The number of each language's model, by its name."""
    every = docs.groupBy(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("l")).count().orderBy(F.desc("count"), "l").collect()
    return {r["l"]: i for i, r in enumerate(every)}


def chunks(docs: DataFrame, langs: dict[str, int], least: int = CHUNK) -> DataFrame:
    """chunk, model, symbols, lengths, info: texts of one model as symbols, `least` bytes or all of a task, and
    what is known of each text (its key and base counts)."""
    one = "struct<_d: bigint, _th: bigint, n_words: bigint, word_chars: bigint, n_symbols: bigint, n_dup_lines: bigint, n_repeat_words: bigint, n_bytes: bigint>"
    info = pa.struct([(n, pa.int64()) for n in re.findall(r"(\w+): bigint", one)])
    schema = pa.schema([("chunk", pa.int64()), ("model", pa.int32()), ("symbols", pa.binary()), ("lengths", pa.list_(pa.int32())), ("info", pa.list_(info))])

    def gathered(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        held: dict[int, tuple[list[bytes], list[dict]]] = {}

        def flushed(m: int) -> pa.RecordBatch:
            nonlocal made
            made += 1
            parts, known = held.pop(m)
            del sizes[m]
            lengths = [k["n_bytes"] for k in known]
            return pa.RecordBatch.from_pylist([{"chunk": task << 32 | made, "model": m, "symbols": zstandard.compress(b"".join(parts), LEVEL), "lengths": lengths, "info": known}], schema)

        sizes: dict[int, int] = {}
        total = 0
        for batch in it:
            for lang, text, d, th in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "_d", "_th"))):
                m = langs[lang or ""]
                raw = (text or "").encode()
                parts, known = held.setdefault(m, ([], []))
                parts.append(PAD + raw.translate(CLASS_OF))
                known.append(dict(zip(info.names, (d, th, *base_counts(text), len(raw)))))
                sizes[m] = sizes.get(m, 0) + len(raw) + len(PAD)
                total += len(raw) + len(PAD)
                full = m if sizes[m] >= least else max(sizes, key=sizes.get) if total >= MOST_HELD * least else None
                if full is not None:
                    total -= sizes[full]
                    yield flushed(full)
        for m in list(held):
            yield flushed(m)

    few = docs.select(docs["lang"].cast("string").alias("lang"), text_of(docs, False).alias("text"), *row_key(docs))
    return few.mapInArrow(gathered, f"chunk bigint, model int, symbols binary, lengths array<int>, info array<{one}>")


def shard_order(grams: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of sorted codes by shard then code, and where each shard starts. A shard holds all n-grams with the
    same symbols between the first and the last, so it has whole contexts and whole suffixes."""
    middle = (grams >> BITS) & (SIZE - 1)
    shard = ((middle.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(shards)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))


def long_units(size: np.ndarray, hashes: np.ndarray, before: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the long units, each distinct one once, where the least symbols are before it; by shard and hash. And
    where each shard starts."""
    long = np.flatnonzero(size >= LEAST_UNIT)
    order = long[np.lexsort((before[long], hashes[long]))]
    h = hashes[order]
    order = order[np.r_[True, h[1:] != h[:-1]]] if len(order) else order
    shard = unit_shard(hashes[order], shards)
    order = order[np.lexsort((unit_name(hashes[order]), shard))]
    return order, np.searchsorted(np.sort(shard), np.arange(shards + 1))


def unit_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(UNIT_BITS)) * np.uint64(shards) >> np.uint64(64 - UNIT_BITS)).astype(np.int64)


def unit_name(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64((1 << UNIT_BITS) - 1)).astype(np.int64)


def unit_lists(parts: DataFrame, shards: int) -> DataFrame:
    """model, shard, chunk, names, before: each chunk's distinct long units, one list a shard."""
    schema = pa.schema([("model", pa.int32()), ("shard", pa.int32()), ("chunk", pa.int64()), ("names", pa.binary()), ("before", pa.binary())])

    def listed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for chunk, m, data, lengths in zip(*(batch.column(c).to_pylist() for c in ("chunk", "model", "symbols", "lengths"))):
                size, h, before = units(symbols_of(data), lengths)
                which, at = long_units(size, h, before, shards)
                rows = []
                for k in np.flatnonzero(np.diff(at)).tolist():
                    mine = which[at[k] : at[k + 1]]
                    rows.append({"model": m, "shard": k, "chunk": chunk, "names": pack_sorted(unit_name(h[mine])), "before": pack(before[mine])})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return parts.select("chunk", "model", "symbols", "lengths").mapInArrow(listed, "model int, shard int, chunk bigint, names binary, before binary")


def unit_owners(lists: DataFrame) -> DataFrame:
    """chunk, shard, own: for each unit of a list, if the chunk counts it. The units of a partition are sorted by Spark,
    which can spill, so a task holds no more than a list."""
    one = pa.schema([("name", pa.int64()), ("before", pa.int32()), ("chunk", pa.int64()), ("at", pa.int64())])
    flag = pa.schema([("chunk", pa.int64()), ("at", pa.int64()), ("own", pa.bool_())])
    out = pa.schema([("chunk", pa.int64()), ("shard", pa.int32()), ("own", pa.binary())])

    def unpacked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for m, shard, chunk, names, before in zip(*(batch.column(c).to_pylist() for c in ("model", "shard", "chunk", "names", "before"))):
                name = unpack_sorted(names) | ((m * 40503 + shard) % (1 << 15)) << UNIT_BITS
                n = len(name)
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(unpack(before).astype(np.int32)), pa.array(np.full(n, chunk)), pa.array(np.arange(n) | shard << 32)], schema=one)

    def firsts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in it:
            if batch.num_rows:
                name = batch.column("name").to_numpy()
                own = np.r_[last is None or name[0] != last, name[1:] != name[:-1]]
                last = name[-1]
                yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("at"), pa.array(own)], schema=flag)

    def packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(chunk: np.ndarray, shard: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.r_[True, (chunk[1:] != chunk[:-1]) | (shard[1:] != shard[:-1])])
            bits = [np.packbits(x).tobytes() for x in np.split(own, first[1:])]
            return pa.RecordBatch.from_arrays([pa.array(chunk[first]), pa.array(shard[first].astype(np.int32)), pa.array(bits, pa.binary())], schema=out)

        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
        waiting = [held]
        for batch in it:
            if batch.num_rows:
                waiting.append([batch.column("chunk").to_numpy(), batch.column("at").to_numpy() >> 32, batch.column("own").to_numpy(zero_copy_only=False)])
            if sum(len(x[0]) for x in waiting) > 100_000:
                held = [np.concatenate(x) for x in zip(*waiting)]
                rest = int(np.argmax((held[0] == held[0][-1]) & (held[1] == held[1][-1])))  # the last list may go on
                if rest:
                    yield done(*(x[:rest] for x in held))
                waiting = [[x[rest:] for x in held]]
        held = [np.concatenate(x) for x in zip(*waiting)]
        if len(held[0]):
            yield done(*held)

    rows = lists.repartition("model", "shard").mapInArrow(unpacked, "name bigint, before int, chunk bigint, at bigint")
    flags = rows.sortWithinPartitions("name", "before", "chunk").mapInArrow(firsts, "chunk bigint, at bigint, own boolean")
    return flags.sortWithinPartitions("chunk", "at").mapInArrow(packed, "chunk bigint, shard int, own binary")


def counted_symbols(s: np.ndarray, lengths: list[int], own: pd.DataFrame, shards: int) -> np.ndarray:
    """Which symbols of a chunk are counted: those of short units, and of each long unit that it counts, once."""
    size, hashes, before = units(s, lengths)
    which, at = long_units(size, hashes, before, shards)
    counted = size < LEAST_UNIT
    for k, bits in zip(own["shard"], own["own"]):
        mine = which[at[k] : at[k + 1]]
        counted[mine] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(mine))
    return np.repeat(counted, size)


def gram_lists(parts: DataFrame, owners: DataFrame, shards: int) -> DataFrame:
    """model, shard, chunk, codes, counts: each chunk's distinct n-grams, one list a shard. N-grams of repeated
    units that the chunk does not own are listed, as they get scores, but do not count."""

    def listed(whole: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        r = whole.iloc[0]
        s, lengths = symbols_of(r["symbols"]), list(r["lengths"])
        grams, at = np.unique(gram_codes(s, lengths), return_inverse=True)
        n = np.bincount(at.reshape(-1), weights=counted_symbols(s, lengths, own, shards)[in_texts(s, lengths)], minlength=len(grams)).astype(np.int64)
        order, at = shard_order(grams, shards)
        rows = []
        for k in np.flatnonzero(np.diff(at)):
            mine = order[at[k] : at[k + 1]]
            rows.append((int(r["model"]), int(k), r["chunk"], pack_sorted(grams[mine]), pack(n[mine])))
        return pd.DataFrame(rows, columns=["model", "shard", "chunk", "codes", "counts"])

    few = parts.select("chunk", "model", "symbols", "lengths").groupBy("chunk")
    return few.cogroup(owners.groupBy("chunk")).applyInPandas(listed, "model int, shard int, chunk bigint, codes binary, counts binary")


def merged(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes and summed counts of some lists."""
    grams, n = (np.concatenate(x) for x in zip(*lists))
    order = np.argsort(grams, kind="stable")
    grams = grams[order]
    first = np.flatnonzero(np.diff(grams, prepend=-1))
    return grams[first], np.add.reduceat(n[order], first)


def merged_lists(lists: DataFrame, keys: list[str], finish, types: str) -> DataFrame:
    """finish(key, codes, counts) for the merged lists of each key. lists come as a stream in order of their keys: a task
    holds one key's distinct n-grams and some lists."""

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, n = None, [], 0
        for batch in it:
            for *key, grams, counts in zip(*(batch.column(c).to_pylist() for c in (*keys, "codes", "counts"))):
                if key != now:
                    if held:
                        yield rows_of(finish(now, *merged(held)))
                    now, held, n = key, [], 0
                held.append((unpack_sorted(grams), unpack(counts)))
                n += len(held[-1][0])
                if n > 2 * max(MERGED, len(held[0][0])):
                    held = [merged(held)]
                    n = len(held[0][0])
        if held:
            yield rows_of(finish(now, *merged(held)))

    def rows_of(row: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([row], schema)

    schema = arrow_schema(types)
    few = lists.select(*keys, "codes", "counts").repartition(*keys).sortWithinPartitions(*keys)
    return few.mapInArrow(scan, types)


def arrow_schema(types: str) -> pa.Schema:
    of = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(c.split()[0], of[c.split()[1]]) for c in types.split(", ")])


def shard_totals(lists: DataFrame) -> DataFrame:
    """model, shard, codes, counts, kinds, low_codes, low_counts: a shard's n-grams, sorted, with their counts; how
    many n-grams of the two highest orders have counts 1 to 4; the n-grams of the order below with continuation counts."""

    def summed(key: list, grams: np.ndarray, n: np.ndarray) -> dict:
        five, c5 = np.unique(grams[n > 0] & (SIZE * SYMBOLS - 1), return_counts=True)
        low = np.unique(grams & (SIZE - 1))  # those of n-grams that do not count too, as they get scores
        c4 = np.bincount(np.searchsorted(low, five & (SIZE - 1)), minlength=len(low))
        kinds = [int((c == i).sum()) for c in (n, c5) for i in (1, 2, 3, 4)]
        return {"model": key[0], "shard": key[1], "codes": pack_sorted(grams), "counts": pack(n), "kinds": kinds, "low_codes": pack_sorted(low), "low_counts": pack(c4)}

    blocks = merged_lists(lists, ["model", "shard", "block"], lambda key, grams, n: dict(zip(("model", "shard", "codes", "counts"), (*key[:2], pack_sorted(grams), pack(n)))), "model int, shard int, codes binary, counts binary")
    return merged_lists(blocks, ["model", "shard"], summed, "model int, shard int, codes binary, counts binary, kinds array<bigint>, low_codes binary, low_counts binary")


def low_counts(totals: DataFrame) -> DataFrame:
    """(model, code, n): continuation counts of the LOW-grams over all shards."""
    schema = pa.schema([("model", pa.int32()), ("code", pa.int32()), ("n", pa.int64())])

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in it:
            for m, grams, n in zip(*(batch.column(c).to_pylist() for c in ("model", "low_codes", "low_counts"))):
                sums.setdefault(m, np.zeros(SIZE, np.int64))[unpack_sorted(grams)] += unpack(n)
        for m, s in sums.items():
            found = np.flatnonzero(s)
            for at in range(0, len(found), 100_000):
                part = found[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), m, np.int32)), pa.array(part.astype(np.int32)), pa.array(s[part])], schema=schema)

    few = totals.select("model", "low_codes", "low_counts")
    return few.mapInArrow(counted, "model int, code int, n bigint").groupBy("model", "code").agg(F.sum("n").alias("n"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Discount of counts 0, 1, 2 and 3 or more, from how many n-grams have counts 1 to 4."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    ratios = ((1, n2, n1), (2, n3, n2), (3, n4, n3))
    return np.array([0.0, *(min(max(i - (i + 1) * y * a / b, 0.05), i - 0.05) if b else 0.5 for i, a, b in ratios)])


def interpolated(grams: np.ndarray, counts: np.ndarray, d: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probabilities of sorted n-grams with whole contexts, given those of their suffixes."""
    first = np.flatnonzero(np.diff(grams >> BITS, prepend=-1))
    size = np.diff(first, append=len(grams))
    off = d[np.minimum(counts, 3)]
    total = np.add.reduceat(counts, first)
    back = np.where(total > 0, np.add.reduceat(off, first) / np.maximum(total, 1), 1.0)
    return (counts - off) / np.repeat(np.maximum(total, 1), size) + np.repeat(back, size) * lower


def shard_scores(lists: DataFrame, totals: DataFrame, models: DataFrame, blocks: int) -> DataFrame:
    """chunk, shard, nll: negative log probabilities of a chunk's n-grams in a shard, as 1/2000, in order of their codes."""
    schema = arrow_schema("chunk bigint, shard int, nll binary")

    def looked_up(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = steps = None
        for batch in it:
            rows = []
            for chunk, shard, codes, counts, low, kinds in zip(*(batch.column(c).to_pylist() for c in ("chunk", "shard", "codes", "counts", "low", "kinds"))):
                if chunk < 0:  # a block's model comes before its lists
                    grams, steps = probabilities(unpack_sorted(codes), unpack(counts), low, kinds)
                else:
                    rows.append({"chunk": chunk, "shard": shard, "nll": zstandard.compress(steps[np.searchsorted(grams, unpack_sorted(codes))].tobytes())})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    every = totals.select("model", "shard", "codes", "counts").join(models, ["model", "shard"])
    every = every.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("chunk", F.lit(-1).cast("bigint"))
    both = every.unionByName(lists.select("model", "shard", "block", "chunk", "codes"), allowMissingColumns=True)
    both = both.repartition("model", "shard", "block").sortWithinPartitions("model", "shard", "block", "chunk")
    return both.select("chunk", "shard", "codes", "counts", "low", "kinds").mapInArrow(looked_up, "chunk bigint, shard int, nll binary")


def probabilities(grams: np.ndarray, n: np.ndarray, low: bytes, kinds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """A shard's codes and their negative log probabilities as 1/2000."""
    five, at = np.unique(grams & (SIZE * SYMBOLS - 1), return_inverse=True)
    c5 = np.bincount(at, weights=n > 0).astype(np.int64)
    p4 = np.frombuffer(zstandard.decompress(low), "<f4")[np.searchsorted(np.unique(five & (SIZE - 1)), five & (SIZE - 1))]
    p5 = interpolated(five, c5, discounts(*kinds[4:]), p4)
    p = interpolated(grams, n, discounts(*kinds[:4]), p5[at])
    return grams, np.minimum(np.round(-2000 * np.log(p)), 65_535).astype("<u2")


def text_scores(parts: DataFrame, found: DataFrame, shards: int) -> DataFrame:
    """model, info and the mean negative log probability nll of each text, null if it is empty."""

    def scored(whole: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
        r = whole.iloc[0]
        lengths = np.asarray(r["lengths"], np.int64)
        grams, at = np.unique(gram_codes(symbols_of(r["symbols"]), list(lengths)), return_inverse=True)
        order, _ = shard_order(grams, shards)
        nll = np.empty(len(grams), np.int64)
        if len(grams):
            nll[order] = np.concatenate([np.frombuffer(zstandard.decompress(x), "<u2") for x in lists.sort_values("shard")["nll"]])
        sums = np.r_[0, np.cumsum(nll[at.reshape(-1)])]
        ends = np.cumsum(lengths)
        means = (sums[ends] - sums[ends - lengths]) / np.maximum(lengths, 1) / 2000
        return pd.DataFrame({"model": int(r["model"]), "info": list(r["info"]), "nll": [float(x) if n else None for x, n in zip(means, lengths)]})

    info = parts.schema["info"].dataType.elementType.simpleString()
    few = parts.select("chunk", "model", "symbols", "lengths", "info").groupBy("chunk")
    return few.cogroup(found.groupBy("chunk")).applyInPandas(scored, f"model int, info {info}, nll double")


def kneser_ney(code: np.ndarray, count: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Modified Kneser-Ney: for orders 1 to LOW, sorted n-gram codes with discounted probabilities, and sorted
    context codes with back-off weights. Counts of the highest of them are given, those below are continuation counts."""
    full = np.zeros(SIZE, np.int64)
    full[code] = count
    levels = [full]
    for _ in range(LOW - 1):
        levels.append((levels[-1].reshape(SYMBOLS, -1) > 0).sum(axis=0))
    out = []
    for c in reversed(levels):
        d = discounts(*(int((c == i).sum()) for i in (1, 2, 3, 4)))
        off = d[np.minimum(c, 3)].reshape(-1, SYMBOLS)
        total = c.reshape(-1, SYMBOLS).sum(axis=1)
        grams, contexts = np.flatnonzero(c), np.flatnonzero(total)
        seen = ((c - off.reshape(-1))[grams] / total[grams // SYMBOLS]).astype("<f4")
        out.append((grams.astype("<i4"), seen, contexts.astype("<i4"), (off.sum(axis=1)[contexts] / total[contexts]).astype("<f4")))
    return out


def expanded(levels: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """Negative log probability of every n-gram code, from the sorted arrays."""
    p = np.full(1, 1.0 / SYMBOLS)
    for k, (grams, seen, contexts, weights) in enumerate(levels):
        back = np.ones(SYMBOLS**k)
        back[contexts] = weights
        lower = np.resize(p, SYMBOLS ** (k + 1)) * np.repeat(back, SYMBOLS)
        lower[grams] += seen
        p = lower
    return -np.log(np.maximum(p, 1e-9)).astype(np.float32)


def train(totals: DataFrame) -> DataFrame:
    """model, shard, low, kinds: probabilities of the LOW-grams in each shard, in order of their codes, and the model's
    sums of kinds. A group is one model: at most SIZE counts, and the codes of its shards."""

    def fit(counts: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        p = np.exp(-expanded(kneser_ney(counts["code"].to_numpy(np.int64), counts["n"].to_numpy(np.int64))))
        kinds = np.sum(np.stack(list(own["kinds"])), axis=0).tolist()
        low = [zstandard.compress(p[unpack_sorted(x)].astype("<f4").tobytes()) for x in own["low_codes"]]
        return pd.DataFrame({"model": own["model"], "shard": own["shard"], "low": low, "kinds": [kinds] * len(own)})

    own = totals.select("model", "shard", "low_codes", "kinds").groupBy("model")
    return low_counts(totals).groupBy("model").cogroup(own).applyInPandas(fit, "model int, shard int, low binary, kinds array<bigint>")


# ---- scores and verdicts ---------------------------------------------------------------------------------


def scores(docs: DataFrame, langs: dict[str, int], least: int = CHUNK) -> DataFrame:
    """_d, _th, the base counts, the model's number and the mean negative log probability nll of each row."""
    # dealt by chunk once: both passes over the texts then find them in place
    parts = bucketed(chunks(docs, langs, least), "symbols", int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chunk")
    size = parts.select(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    shards = min(MOST_SHARDS, max(LEAST_SHARDS, math.ceil(size / SHARD_BYTES)))
    blocks = max(1, math.ceil(size / least / BLOCK))
    lists = written(gram_lists(parts, unit_owners(unit_lists(parts, shards)), shards), "gram-lists")
    lists = lists.withColumn("block", F.pmod(F.xxhash64("chunk"), F.lit(blocks)).cast("int"))
    totals = written(shard_totals(lists), "gram-totals")
    found = shard_scores(lists, totals, train(totals), blocks)
    return text_scores(parts, found, shards).select("info.*", "model", "nll")


def _median(df: DataFrame, value: str) -> DataFrame:
    """Median of an integer column for each model, from counts of its values."""
    bins = df.groupBy("model", value).agg(F.count("*").alias("_n"))
    by = Window.partitionBy("model")
    upto = F.sum("_n").over(by.orderBy(value))
    bins = bins.withColumn("_upto", upto).withColumn("_all", F.sum("_n").over(by))
    return bins.filter(2 * F.col("_upto") >= F.col("_all")).groupBy("model").agg(F.min(value).alias("m"))


def bands(scored: DataFrame) -> DataFrame:
    """middle and spread of nll for each model."""
    fine = scored.filter("nll IS NOT NULL AND n_words >= 20").select("model", F.round(F.col("nll") * 1000).cast("long").alias("v"))
    middle = written(_median(fine, "v"), "nll-medians").withColumnsRenamed({"model": "model", "m": "middle"})
    off = fine.join(F.broadcast(middle), "model").select("model", F.abs(F.col("v") - F.col("middle")).alias("w"))
    return middle.join(_median(off, "w"), "model").select("model", F.col("middle") / 1000, (F.col("m") / 1000 * 1.4826).alias("spread")).toDF("model", "middle", "spread")


def verdicts(docs: DataFrame, band: float = BAND) -> DataFrame:
    """_d, _th, the base counts, base_failed, kept, nll and the band of each row."""
    prepare(docs.sparkSession)
    if "lang" not in docs.columns:
        docs = docs.withColumn("lang", F.lit(None).cast("string"))
    langs = languages(docs)
    scored = written(scores(docs, langs), "quality-scores")
    limits = written(bands(scored), "bands")  # one row a language
    out = scored.join(F.broadcast(limits), "model", "left")
    width = F.greatest(F.col("spread"), F.lit(LEAST_SPREAD)) * band + F.lit(SHORT) / F.sqrt(F.greatest("n_bytes", F.lit(1)))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    inside = F.abs(F.col("nll") - F.col("middle")) <= width
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & F.coalesce(inside, F.lit(True)))


def drop_low_quality(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that are kept."""
    good = verdicts(docs, **options).filter("kept").select("_d", "_th").distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), *row_key(docs))
    return on_key(keyed, good, "left_semi").select("_row.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = verdicts(read(spark, sf_dir, "documents"))
    return out.select(F.col("_d").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("nll", 6).alias("nll"))
