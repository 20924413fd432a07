"""Benchmark decontamination by an FM-index per training shard.

A shard is a bounded stretch of a task's documents, all their words as signs of the shard's own vocabulary, with a
sign between documents that matches nothing. It is indexed once: the Burrows-Wheeler transform in a wavelet matrix
of packed bits with sampled ranks, and suffix positions sampled by text position. All windows of all items are then
searched backward against it, block by block of the benchmark; occurrences are located by walking to the next sampled
position, and spans of words are merged for removal.

The benchmark reaches the tasks in blocks of bounded size, of which a pass takes a bounded number; a benchmark beyond
that needs more passes, each of which indexes the shards anew. No shuffle. Null texts and items have no words; an
item with an empty text matches nothing; repeated rows give a row each; items that share an id count as one, a null id
as 'null'; empty tables give empty or clean results. Columns besides text and ids pass through, whatever their names.
A document longer than a shard is a shard of its own; its words and their index stand in memory.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_map, as_bytes, ddl, materialize, unused

WINDOW = 8
#: Items with occurring windows from which a document counts as contaminated.
CONTAMINATED = 2
#: Bytes of benchmark text in a block and in a pass, at most (a longer item is a block of its own).
BLOCK_BYTES, PASS_BYTES = 4 << 20, 64 << 20
#: Words and bytes of documents in a shard, at most.
SHARD_WORDS, SHARD_BYTES = 500_000, 32 << 20
#: Every so many text positions of the index one is sampled; phrases that are searched together.
SAMPLED, TOGETHER = 8, 1 << 16
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORDS = re.compile(rb"[^\x20]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Suffix array of a sequence in which 0 parts documents; each 0 is a sign of its own, by position."""
    n = len(s)
    marks = s == 0
    own = np.where(marks, np.cumsum(marks) - 1, s + marks.sum()).astype(np.int64)
    # The first sort takes as many signs as fit in 63 bits; then the sorted length doubles, among ties only.
    bits = max(1, int(own.max()).bit_length()) if n else 1
    step = min(3, 63 // bits)
    key = own.copy()
    for k in range(1, step):
        key <<= bits
        key[: n - k] |= own[k:]
    order = np.argsort(key)
    fresh = np.r_[True, key[order][1:] != key[order][:-1]] if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    del key, own
    while True:
        at = np.flatnonzero(~(fresh & np.r_[fresh[1:], True]))
        if not len(at):
            return order
        rows = order[at]
        key = np.where(rows + step < n, rank[np.minimum(rows + step, n - 1)] + 1, 0)
        by = np.lexsort((key, rank[rows]))
        rows, key = rows[by], key[by]
        order[at] = rows
        old = rank[rows]
        new = np.r_[True, (old[1:] != old[:-1]) | (key[1:] != key[:-1])]
        fresh[at] = new
        rank[rows] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        step *= 2


class Bits:
    """Packed bits; ones before a position are a sampled count and those of one word."""

    def __init__(self, bit: np.ndarray) -> None:
        packed = np.zeros(8 * (len(bit) // 64 + 1), np.uint8)
        raw = np.packbits(bit, bitorder="little")
        packed[: len(raw)] = raw
        self.words = packed.view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, end: np.ndarray) -> np.ndarray:
        word = end >> 6
        inside = self.words[word] & ((np.uint64(1) << (end & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(inside)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    """Ranks of any sign in a prefix, for many signs and prefixes at once."""

    def __init__(self, s: np.ndarray, signs: int) -> None:
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(max(1, int(signs - 1).bit_length()) - 1, -1, -1):
            up = (s >> shift) & 1 == 1
            self.levels.append((shift, Bits(up), int(len(s) - up.sum())))
            s = np.concatenate([s[~up], s[up]])

    def rank(self, sign: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each sign stands before each end."""
        first = np.zeros(len(sign), np.int64)
        for shift, bits, zeros in self.levels:
            up = (sign >> shift) & 1 == 1
            a, b = bits.rank(first), bits.rank(end)
            first, end = np.where(up, zeros + a, first - a), np.where(up, zeros + b, end - b)
        return end - first

    def sign_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sign at each position, and how often it stands before."""
        first, sign = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for shift, bits, zeros in self.levels:
            up = bits[at]
            a, b = bits.rank(first), bits.rank(at)
            first, at = np.where(up, zeros + a, first - a), np.where(up, zeros + b, at - b)
            sign |= up.astype(np.int64) << shift
        return sign, at - first


class FMIndex:
    """Backward search and location over a sequence of signs below ``signs``."""

    def __init__(self, s: np.ndarray, signs: int) -> None:
        self.n = len(s)
        order = suffix_order(s)
        last = s[order - 1]  # the sign before each suffix; before the first, the last one
        # A document's first position is sampled too: no walk crosses a 0, whose suffixes are ordered by position alone.
        kept = (order % SAMPLED == 0) | (last == 0)
        self.sampled, self.positions = Bits(kept), order[kept].astype(np.int32 if self.n < 1 << 31 else np.int64)
        self.matrix = WaveletMatrix(last, signs)
        self.before = np.r_[0, np.cumsum(np.bincount(s, minlength=signs))]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes [low, high) that begin with each phrase (a row; rows of one length)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j]
            a, b = self.before[c] + self.matrix.rank(c, low[live]), self.before[c] + self.matrix.rank(c, high[live])
            low[live], high[live] = a, np.maximum(a, b)
            live = live[b > a]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: each walks back through the text until a sampled one."""
        rows, at, steps = rows.copy(), np.full(len(rows), -1, np.int64), 0
        todo = np.arange(len(rows))
        while len(todo):
            here = rows[todo]
            done = self.sampled[here]
            at[todo[done]] = self.positions[self.sampled.rank(here[done])] + steps
            todo, here = todo[~done], here[~done]
            sign, before = self.matrix.sign_and_rank(here)
            rows[todo] = self.before[sign] + before
            steps += 1
        return at


@dataclass
class Block:
    """The words of some items, as numbers of the block's own vocabulary, one item after the other."""

    words: list[bytes]
    text: np.ndarray
    sizes: np.ndarray
    items: list[str]

    @classmethod
    def of(cls, items: list[tuple[str, bytes]]) -> Block:
        number: dict[bytes, int] = defaultdict(count().__next__)
        found = [[number[w] for w in words_of(text)] for _, text in items]
        return cls(list(number), np.array([i for f in found for i in f], np.int32), np.array([len(f) for f in found], np.int64), [i for i, _ in items])

    def windows(self, sign: dict[bytes, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows all of whose words have a sign, as signs, with the numbers of their items; by length, in bounded parts."""
        if not len(self.text):
            return
        s = np.fromiter((sign.get(w, 0) for w in self.words), np.int64, len(self.words))[self.text]
        start, owner = np.cumsum(self.sizes) - self.sizes, np.repeat(np.arange(len(self.sizes)), self.sizes)
        unknown = np.r_[0, np.cumsum(s == 0)]
        for length in range(1, WINDOW + 1):
            fits = self.sizes >= WINDOW if length == WINDOW else self.sizes == length
            at = np.arange(len(s))[fits[owner]]
            at = at[at + length <= (start + self.sizes)[owner[at]]]
            at = at[unknown[at + length] == unknown[at]]
            for k in range(0, len(at), TOGETHER):
                some = at[k : k + TOGETHER]
                yield s[some[:, None] + np.arange(length)], owner[some]


@dataclass
class Shard:
    """Documents as signs, indexed together; and what has been found in each."""

    sign: dict[bytes, int] = field(default_factory=lambda: defaultdict(count(1).__next__))
    texts: list[np.ndarray] = field(default_factory=list)
    words: int = 0

    def add(self, words: list[bytes]) -> None:
        self.texts.append(np.fromiter(map(self.sign.__getitem__, words), np.int32, len(words)))
        self.words += len(words)

    def match(self, blocks: Iterable[Block]) -> list[tuple[list[tuple[int, int]], set[str]]]:
        """For each document: merged spans of hit words, and the items that occur."""
        out: list[tuple[list[tuple[int, int]], set[str]]] = [([], set()) for _ in self.texts]
        if not self.words:
            return out
        sizes = np.array([len(t) + 1 for t in self.texts])
        starts = np.cumsum(sizes) - sizes
        s = np.zeros(sizes.sum(), np.int64)
        s[np.delete(np.arange(len(s)), starts + sizes - 1)] = np.concatenate(self.texts)
        index, found = FMIndex(s, len(self.sign) + 1), []
        known = dict(self.sign)
        for block in blocks:
            for phrases, owner in block.windows(known):
                low, high = index.search(phrases)
                which = np.flatnonzero(high > low)
                if not len(which):
                    continue
                by = which[np.argsort(low[which], kind="stable")]  # equal windows have equal suffixes
                edge = np.flatnonzero(np.r_[True, low[by][1:] != low[by][:-1]])
                first, many = low[by[edge]], (high - low)[by[edge]]
                window = np.repeat(np.arange(len(edge)), many)
                at = index.locate(np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
                found.append((at, np.full(len(at), phrases.shape[1])))
                doc = np.searchsorted(starts, at, side="right") - 1
                pairs = np.unique(window * len(starts) + doc)
                held = [sorted({block.items[i] for i in owner[by[a:b]].tolist()}) for a, b in zip(edge, [*edge[1:], len(by)], strict=True)]
                for w, d in zip((pairs // len(starts)).tolist(), (pairs % len(starts)).tolist(), strict=True):
                    out[d][1].update(held[w])
        if found:
            at, length = (np.concatenate(x) for x in zip(*found, strict=True))
            for a, b in merged(zip(at.tolist(), (at + length).tolist(), strict=True)):  # no span reaches over a document's end
                d = int(np.searchsorted(starts, a, side="right")) - 1
                out[d][0].append((a - int(starts[d]), b - int(starts[d])))
        return out


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or touch as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def byte_spans(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """From the first byte of the first word to the last byte of the last, for spans of words."""
    at = [m.span() for m in _WORDS.finditer(text.translate(_WORD))]
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


_FOUND = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])
_FOUND_DDL = "struct<n_words:bigint,hits:array<struct<start:bigint,end:bigint>>,items:array<string>>"


class _Match:
    """Adds what a pass finds as the last column, or folds it into the last column."""

    def __init__(self, blocks: list, text: int, into: str, first: bool) -> None:
        self.blocks, self.text, self.into, self.first = blocks, text, into, first

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        shard, size = Shard(), 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            for t in as_bytes(b.column(self.text)):
                shard.add(words_of(t))
            if shard.words >= SHARD_WORDS or size >= SHARD_BYTES:
                yield from self._done(held, shard)
                held, shard, size = [], Shard(), 0
        yield from self._done(held, shard)

    def _done(self, held: list[pa.RecordBatch], shard: Shard) -> Iterator[pa.RecordBatch]:
        found, at = shard.match(x.value for x in self.blocks), 0
        for b in held:
            some, n = found[at : at + b.num_rows], [len(t) for t in shard.texts[at : at + b.num_rows]]
            at += b.num_rows
            base = b.columns if self.first else b.columns[:-1]
            if not self.first:
                before = b.column(b.num_columns - 1).to_pylist()
                some = [(merged([*spans, *((x["start"], x["end"]) for x in old["hits"])]), items.union(old["items"])) for (spans, items), old in zip(some, before, strict=True)]
            rows = [{"n_words": k, "hits": [{"start": x, "end": y} for x, y in spans], "items": sorted(items)} for k, (spans, items) in zip(n, some, strict=True)]
            yield pa.RecordBatch.from_arrays([*base, pa.array(rows, _FOUND)], names=[*b.schema.names[: len(base)], self.into])


def passes(benchmark: DataFrame) -> Iterator[list[Block]]:
    """The items in blocks, and these in passes; the driver holds one pass at a time."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    some, size, found, total = [], 0, [], 0
    for r in items.toLocalIterator():
        if some and size + len(r.text) > BLOCK_BYTES:
            found.append(Block.of(some))
            some, size = [], 0
        if found and total + len(r.text) > PASS_BYTES:
            yield found
            found, total = [], 0
        some.append((r.item, bytes(r.text)))
        size, total = size + len(r.text), total + len(r.text)
    yield [*found, Block.of(some)]


def match(documents: DataFrame, benchmark: DataFrame, into: str) -> DataFrame:
    """``documents`` with a column ``into`` (n_words, hits as spans of words, items), whose name must be unused."""
    out, sc, text, live = documents, documents.sparkSession.sparkContext, documents.columns.index("text"), []
    schema = f"{ddl(documents)}, `{into}` {_FOUND_DDL}"
    for k, blocks in enumerate(passes(benchmark)):
        if live:  # what an earlier pass found is written before the next begins, and its blocks are let go
            out = materialize(out, "matched")
            for x in live:
                x.destroy()
        live = [sc.broadcast(b) for b in blocks]
        out = arrow_map(out, _Match(live, text, into, k == 0), schema)
    return out


def op9(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("found.hits", F.lit(0).cast("long"), lambda n, x: n + x.end - x.start)
    return match(documents.select("doc_id", "text"), benchmark, "found").select(
        "doc_id", F.col("found.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "found.items").cast("binary"), 256).alias("items_sha256"), (F.size("found.items") >= CONTAMINATED).alias("contaminated"),
    )


class _Cut:
    """The last column's hits are cut out of the text, and the column goes."""

    def __init__(self, columns: list[str]) -> None:
        self.columns = columns

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(b.columns[:-1])
            at, length = self.columns.index("text"), self.columns.index("n_chars") if "n_chars" in self.columns else None
            texts, lengths = cols[at].to_pylist(), None if length is None else cols[length].to_pylist()
            for i, found in enumerate(b.column(b.num_columns - 1).to_pylist()):
                if found["hits"]:
                    raw = texts[i].encode()
                    kept, end = [], 0
                    for start, stop in byte_spans(raw, [(h["start"], h["end"]) for h in found["hits"]]):
                        kept.append(raw[end:start])
                        end = stop
                    texts[i] = b"".join([*kept, raw[end:]]).decode()
                    if lengths is not None:
                        lengths[i] = len(texts[i])
            cols[at] = pa.array(texts, pa.string())
            if length is not None:
                cols[length] = pa.array(lengths, b.column(length).type)
            yield pa.RecordBatch.from_arrays(cols, names=self.columns)


def remove(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Contaminated documents go; from others the hit spans are cut out. Clean rows are left as they are."""
    into = unused(documents.columns, "found")
    kept = match(documents, benchmark, into).where(F.size(F.col(f"{into}.items")) < CONTAMINATED)
    return arrow_map(kept, _Cut(documents.columns), documents.schema)


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item, size, array_to_string(w[i : i + size - 1], ' ') AS g
  FROM (SELECT item, w, least(8, len(w)) AS size FROM b WHERE len(w) > 0), unnest(range(1, len(w) - size + 2)) AS u(i)
), grams AS (
  SELECT rid, i, size, array_to_string(w[i : i + size - 1], ' ') AS g
  FROM d, (SELECT DISTINCT size FROM win), unnest(range(1, len(w) - size + 2)) AS u(i)
), occ AS (
  SELECT rid, i, size, item FROM grams JOIN win USING (g, size)
), hit AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM occ) GROUP BY rid
), it AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM occ) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
"""
