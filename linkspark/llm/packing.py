"""Packing documents into token sequences along a space-filling curve.

A document's tokens, hashed into a few random projections and quantised, give a Hilbert key. Documents are
range-sorted by that key (then by a hash of the row, so that equal texts spread over range partitions),
laid end to end, and cut at every multiple of the sequence length; only the very last sequence is padded.
Documents are tokenised once, into a written table; the order is found on its narrow columns.

Words are tokenised by the `tokenizers` library when a worker first meets them and kept in a bounded table: this
tokenizer drops white space and splits at it, so a text's ids are those of its white-space runs one after the
other. Texts are cut into words, hashed and put together again by array operations over whole segments of a batch.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each; a null doc_id is
kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkspark.llm.common import prepare, read, small, text_of, written
from linkspark.llm.hilbert import hilbert_numpy

SEQUENCE, END_ID, DIMS, BITS, SPAN, SEED = 2048, 1, 3, 10, 6.0, 11
#: Entries a worker keeps; the half that was used longest ago goes when there are more.
ENTRIES = 1_500_000
#: Bytes of text that are cut into pieces at once; a worker holds some 60 bytes for each.
SEGMENT = 1 << 20
#: Entries added since the last merge into the sorted table.
RECENT = 60_000
#: Classes of bytes: white space, letters, marks that are a token's worth of their own after letters (neither apostrophe nor
#: angle brackets), others, and the two bytes of the letters from U+00C0 to U+00FF.
_SPACE, _LETTER, _MARK, _OTHER, _LEAD, _REST = range(6)


def _classes() -> bytes:
    of = np.full(256, _OTHER, np.uint8)
    of[[32, *range(9, 14)]] = _SPACE
    of[ord("a") : ord("z") + 1] = of[ord("A") : ord("Z") + 1] = _LETTER
    of[list(b"!#$%&*+,-./:;=?@^_`|~()[]{}\"\\")] = _MARK
    of[0xC3] = _LEAD
    of[0x80:0xC0] = _REST
    of[[0x97, 0xB7]] = _OTHER  # the signs of multiplication and division
    return of.tobytes()


_CLASS = _classes()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def segments(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts with their numbers, some SEGMENT bytes at once; a longer text is cut at white space."""
    numbers, parts, n = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > SEGMENT:
                cut = _GAP.search(text, at + SEGMENT)
                end = cut.start() if cut else end
            numbers.append(i)
            parts.append(text[at:end])
            n, at = n + end - at, end
            if n >= SEGMENT:
                yield numbers, parts
                numbers, parts, n = [], [], 0
    if parts:
        yield numbers, parts


_GAP = re.compile(rb"[ \t-\r]")


def pieces(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of a text with white space at both ends, and which are words: a run without white
    space is one piece, or if letters and then marks only, a word and the marks."""
    of = np.frombuffer(joined.translate(_CLASS), np.uint8)
    space = of == _SPACE
    turns = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = turns[::2], turns[1::2]
    good = of == _LETTER
    pair = (of[:-1] == _LEAD) & (of[1:] == _REST)
    good[:-1] |= pair
    good[1:] |= pair
    body = np.r_[-1, np.flatnonzero(~space & (of != _MARK))]
    core = np.maximum(body[np.searchsorted(body, end) - 1] + 1, start)
    bad = np.r_[0, np.cumsum(~good, dtype=np.int64)]
    word = (core > start) & (bad[core] == bad[start])
    tail = word & (core < end)
    at = np.arange(len(start)) + np.cumsum(tail) - tail
    starts, ends, words = (np.empty(len(start) + int(tail.sum()), t) for t in (np.int64, np.int64, bool))
    starts[at], ends[at], words[at] = start, np.where(word, core, end), word
    at = at[tail] + 1
    starts[at], ends[at], words[at] = core[tail], end[tail], False
    return starts, ends, words


def hashes(joined: bytes, starts: np.ndarray, ends: np.ndarray, words: np.ndarray) -> np.ndarray:
    """64-bit hashes of pieces, words without regard to the case of A-Z: sums of mixed pairs of byte and place."""
    size = ends - starts
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    at = place + np.repeat(starts, size)
    b = np.where(np.repeat(words, size), np.frombuffer(joined.lower(), np.uint8)[at], np.frombuffer(joined, np.uint8)[at]).astype(np.uint64)
    v = (b + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + (place + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    v ^= v >> np.uint64(29)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(32)
    h = np.add.reduceat(v, first) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))) + words


class Words:
    """Ids of texts, by a table from 64-bit hashes of pieces to places in a pool of ids. Pieces are tokenised when first met."""

    held: dict[str, Words] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.zeros(self.vocabulary + 1, bool)  # tokens that end a word
        self.ends[[i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token.endswith("</w>")]] = True
        self.pool, self.fill, self.round = np.zeros(1 << 16, "<u4"), 0, 0
        self.tables = [self._table(*([],) * 4), self._table(*([],) * 4)]  # sorted by key: most entries, and the latest

    @classmethod
    def of(cls, path: str) -> Words:
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    @staticmethod
    def _table(key, first, size, used) -> list[np.ndarray]:
        return [np.asarray(key, np.uint64), np.asarray(first, np.int64), np.asarray(size, np.int64), np.asarray(used, np.int32)]

    def _learn(self, parts: list[bytes], words: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after the other, and how many each has, in few calls. words: each piece is letters only, so
        one token ends it; otherwise offsets tell which piece a token belongs to."""
        ids, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for at in range(0, len(parts), 2000):
            part = parts[at : at + 2000]
            if words:
                got = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
                cuts = np.r_[0, np.flatnonzero(self.ends[got]) + 1]
                if len(cuts) != len(part) + 1:
                    got, size = self._learn(part, False)
                    cuts = np.r_[0, np.cumsum(size)]
            else:
                texts = [p.decode("utf-8", "replace") for p in part]
                found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
                starts = np.cumsum([0, *(len(p) + 1 for p in texts)])
                owner = np.searchsorted(starts, [a for a, _ in found.offsets], side="right") - 1
                got = np.array(found.ids, "<u4")
                cuts = np.searchsorted(owner, np.arange(len(part) + 1))
            ids.append(got)
            sizes.append(np.diff(cuts))
        return np.concatenate(ids), np.concatenate(sizes)

    def _add(self, key: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        while self.fill + len(ids) > len(self.pool):
            self.pool = np.r_[self.pool, np.zeros(len(self.pool), "<u4")]
        self.pool[self.fill : self.fill + len(ids)] = ids
        new = self._table(key, self.fill + np.cumsum(size) - size, size, np.full(len(key), self.round))
        self.fill += len(ids)
        self.tables[1] = self._merged(self.tables[1], new)
        if len(self.tables[1][0]) > RECENT:
            self.tables = [self._merged(*self.tables), self._table(*([],) * 4)]

    @staticmethod
    def _merged(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
        both = [np.concatenate(x) for x in zip(a, b)]
        order = np.argsort(both[0], kind="stable")
        return [x[order] for x in both]

    def _forget(self) -> None:
        """Drops the half that was used longest ago, and its ids."""
        _, first, size, used = every = self._merged(*self.tables)
        keep = used > np.median(used)
        every, first, size = [x[keep] for x in every], first[keep], size[keep]
        start = np.cumsum(size) - size
        self.pool = self.pool[np.repeat(first - start, size) + np.arange(int(size.sum()))]
        self.fill = len(self.pool)
        self.pool = np.r_[self.pool, np.zeros(1 << 16, "<u4")]
        every[1] = start
        self.tables = [every, self._table(*([],) * 4)]

    def each(self, texts: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Numbers of texts, the ids of some of their text one after the other, and where each one's ids start and end."""
        for numbers, parts in segments(texts):
            joined = b" " + b" ".join(parts) + b" "
            starts, ends, words = pieces(joined)
            begin = 1 + np.cumsum([0, *(len(p) + 1 for p in parts)])
            if not len(starts):
                yield numbers, np.zeros(0, "<u4"), np.zeros(len(begin), np.int64)
                continue
            if sum(len(t[0]) for t in self.tables) > ENTRIES:
                self._forget()
            self.round += 1
            code, key = pd.factorize(hashes(joined, starts, ends, words))
            first, size, missing = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64), np.ones(len(key), bool)

            def find(those: np.ndarray, table: list[np.ndarray]) -> None:
                at = np.minimum(np.searchsorted(table[0], key[those]), len(table[0]) - 1)
                hit = table[0][at] == key[those]
                at, those = at[hit], those[hit]
                first[those], size[those], missing[those] = table[1][at], table[2][at], False
                table[3][at] = self.round

            for table in self.tables:
                if len(table[0]) and missing.any():
                    find(np.flatnonzero(missing), table)
            if missing.any():
                where = np.empty(len(key), np.int64)
                where[code[::-1]] = np.arange(len(code))[::-1]
                low = joined.lower()
                for kind, source in ((True, low), (False, joined)):
                    new = np.flatnonzero(missing & (words[where] == kind))
                    if len(new):
                        at = where[new]
                        ids, n = self._learn([source[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())], kind)
                        first[new], size[new] = self.fill + np.cumsum(n) - n, n
                        self._add(key[new], ids, n)
            size = size[code]
            upto = np.cumsum(size)
            ids = self.pool[np.repeat(first[code] - upto + size, size) + np.arange(int(upto[-1]))]
            yield numbers, ids, np.r_[0, upto][np.searchsorted(starts, begin)]

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit bytes."""
        out = [b""] * len(texts)
        for numbers, ids, cuts in self.each(texts):
            for i, a, b in zip(numbers, cuts.tolist(), cuts[1:].tolist()):
                out[i] += ids[a:b].tobytes()
        return out


def tokenised(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, _id (unique), ids (binary, the end id included), n_tokens and the curve key of every row; written."""
    prepare(docs.sparkSession)
    path = path or default_tokenizer()
    schema = pa.struct([("ids", pa.binary()), ("n_tokens", pa.int64()), ("key", pa.int64())])
    end = np.array([end_id], "<u4").tobytes()

    @F.arrow_udf("ids binary, n_tokens bigint, key bigint")
    def encoded(texts: pa.Array) -> pa.Array:
        tokenizer = Words.of(path)
        project = _projection(tokenizer.vocabulary)
        ids, points = [b""] * len(texts), np.zeros((len(texts), DIMS))
        for numbers, found, cuts in tokenizer.each([t or b"" for t in texts.to_pylist()]):
            some = np.flatnonzero(np.diff(cuts))
            if len(some):
                sums = np.stack([np.add.reduceat(p[found], cuts[some]) for p in project], axis=1)
                np.add.at(points, np.array(numbers)[some], sums)
            for i, a, b in zip(numbers, cuts.tolist(), cuts[1:].tolist()):
                ids[i] += found[a:b].tobytes()
        points /= np.sqrt(np.maximum([[len(x) / 4] for x in ids], 1)) if len(ids) else 1
        grid = np.clip((points / SPAN + 0.5) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
        keys = hilbert_numpy(grid, BITS) if len(ids) else []
        return pa.StructArray.from_arrays([pa.array([x + end for x in ids], pa.binary()), pa.array([len(x) // 4 + 1 for x in ids], pa.int64()), pa.array(keys, pa.int64())], fields=list(schema))

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), encoded(text_of(docs).cast("binary")).alias("e"), F.xxhash64(text_of(docs), docs["doc_id"].cast("long")).alias("_tie"))
    return written(rows.select("doc_id", "_tie", F.monotonically_increasing_id().alias("_id"), "e.*"), "tokens")


_PROJECTIONS: dict[int, np.ndarray] = {}


def _projection(vocabulary: int) -> np.ndarray:
    if vocabulary not in _PROJECTIONS:
        _PROJECTIONS[vocabulary] = np.random.default_rng(SEED).normal(size=(DIMS, vocabulary + 1))
    return _PROJECTIONS[vocabulary]


def places(tokens: DataFrame) -> DataFrame:
    """_id and _at, the number of tokens before each row along the curve."""
    spark = tokens.sparkSession
    schema = pa.schema([("_id", pa.int64()), ("part", pa.int32()), ("inner", pa.int64()), ("upto", pa.int64())])

    def running(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, part = 0, TaskContext.get().partitionId()
        for b in it:
            upto = before + np.cumsum(b.column("n_tokens").to_numpy())
            if len(upto):
                inner = np.r_[before, upto[:-1]]
                before = int(upto[-1])
                yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(np.full(len(upto), part, np.int32)), pa.array(inner), pa.array(upto)], schema=schema)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = tokens.select("key", "_tie", "_id", "n_tokens").repartitionByRange(n, "key", "_tie", "_id").sortWithinPartitions("key", "_tie", "_id")
    inner = written(ordered.select("_id", "n_tokens").mapInArrow(running, "_id bigint, part int, inner bigint, upto bigint"), "token-places")
    totals = inner.groupBy("part").agg(F.max("upto").alias("_sum"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range partition
    starts = totals.select("part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    return inner.join(small(written(starts, "token-starts")), "part").select("_id", (F.col("_start") + F.col("inner")).alias("_at"))


def pack(docs: DataFrame, sequence: int = SEQUENCE, path: str | None = None, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids (int array)."""
    tokens = tokenised(docs, path, end_id)
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    if with_ids:
        kinds.append(("ids", pa.list_(pa.int32())))
    schema = pa.schema(kinds)

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows: list[list] = [[] for _ in kinds]
            for doc, ids, at in zip(*(b.column(c).to_pylist() for c in ("doc_id", "ids", "_at"))):
                n, start = len(ids) // 4, 0
                while start < n:
                    seq, offset = divmod(at + start, sequence)
                    length = min(n - start, sequence - offset)
                    piece = ids[4 * start : 4 * (start + length)]
                    for col, v in zip(rows, (doc, start, length, zlib.crc32(piece), n, seq, offset)):
                        col.append(v)
                    if with_ids:
                        rows[-1].append(np.frombuffer(piece, "<u4").astype(np.int32))
                    start += length
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(rows, kinds)], schema=schema)

    laid = tokens.select("_id", "doc_id", "ids").join(places(tokens), "_id").select("doc_id", "ids", "_at")
    types = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * with_ids
    return laid.mapInArrow(cut, types)


def op10_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False)
