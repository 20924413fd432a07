"""Document fingerprints: SimHash over weighted terms, and permuted block tables for near ones.

Terms are words and pairs of neighbouring words, A-Z lower-cased. A word's hash is the half of its MD5 that comes
last, a pair's a linear mix of its words'; a term weighs the number of binary digits of its count and votes with that
on 64 signed bits. Votes are sums of integers, exact in whatever order they are added, so that equal texts have equal
fingerprints on any machine. ``near_pairs`` splits fingerprints into radius + 2 blocks: two fingerprints within the
radius agree on at least two blocks, so tables keyed by each pair of blocks find all of them. Classes of equal
fingerprints count as one entry with a weight; a key with many entries is split over as many salts as it needs, and
query entries are copied to each of them.

The next document comes from a range layout: rows are dealt by ranges of (id, hash of the text) that hold about
equally many, each to a partition of its own, sorted, and streamed; the first row of each range is also given to the
range before it. One shuffle of compressed texts.

Null texts count as empty. Rows with a null id come last; rows that share an id follow each other by a hash of their
text, and many of them are split over ranges too, but for those that are equal in both. A table of one row is its own
next; an empty table gives an empty result; columns besides doc_id and text, whatever their names, are left out. A
text of any length is one string in memory, as is its edited one.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_map, as_bytes, materialize

#: Fingerprints that differ in at most so many bits are near.
RADIUS = 3
#: Ids whose documents are the queries of the near search: those divisible by this.
QUERY_STEP = 20
#: Entries of a key that one task compares with queries.
SALT_ROWS = 20_000
#: What a pair's first word is multiplied by before the second's hash is added, modulo 2 to the 64th.
PAIR = 0x9E3779B97F4A7C1
#: Digits of words that a worker remembers.
REMEMBERED = 200_000
#: Totals of weights under this are added in single precision without loss.
_SINGLE = 1 << 24


@lru_cache(maxsize=REMEMBERED)
def word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.md5(word, usedforsecurity=False).digest()[8:], "little")


def fingerprint(text: str) -> int:
    words = text.encode(errors="surrogatepass").lower().split()
    if not words:
        return 0
    one = np.fromiter(map(word_hash, words), np.uint64, len(words))
    two = one[:-1] * np.uint64(PAIR) + one[1:]
    terms, count = np.unique(np.concatenate([one, two]), return_counts=True)
    weight = np.frexp(count)[1]  # binary digits of the count
    total = int(weight.sum())
    kind = np.float32 if total < _SINGLE else np.float64
    bits = np.unpackbits(terms.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    votes = 2 * (weight.astype(kind) @ bits.astype(kind)).astype(np.int64) - total
    return int.from_bytes(np.packbits(votes > 0).tobytes(), "big")


def likeness(a: int, b: int) -> float:
    return 1 - (a ^ b).bit_count() / 64


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class _Dealt:
    """Rows with the number of their range, counted from the highest, and the text compressed.

    Columns are bare (no id), key, tie and text; bounds are the least (has an id, key, tie) of all ranges but the last.
    """

    def __init__(self, bounds: list[tuple[bool, int, int]]) -> None:
        self.bounds = bounds
        self.keys = np.array([k for some, k, _ in bounds if some], np.int64)
        self.bare = len(bounds) - len(self.keys)  # bounds among rows without an id, which come first as the lowest

    def ranges(self, bare: np.ndarray, key: np.ndarray, tie: np.ndarray) -> np.ndarray:
        """Of each row: the bounds above it."""
        at = self.bare + np.searchsorted(self.keys, key, side="left")
        close = np.flatnonzero(bare | np.isin(key, self.keys))  # what the tie must decide
        for i in close.tolist():
            at[i] = _bounds_upto(self.bounds, (not bare[i], 0 if bare[i] else int(key[i]), int(tie[i])))
        return len(self.bounds) - at

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            own = self.ranges(*_order_columns(b))
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *b.columns[:3], pa.array([pack(t) for t in as_bytes(b.column(3))], pa.binary())], names=["range", "bare", "key", "tie", "packed"])


def _bounds_upto(bounds: list[tuple[bool, int, int]], row: tuple[bool, int, int]) -> int:
    at = bisect_left(bounds, row)
    return at + (at < len(bounds) and bounds[at] == row)


def _order_columns(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(3))


class _Heads:
    """The highest row of each range that a task meets."""

    def __init__(self, dealt: _Dealt) -> None:
        self.dealt = dealt

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, tuple] = {}
        for b in batches:
            bare, key, tie = _order_columns(b)
            own = self.dealt.ranges(bare, key, tie)
            last = np.lexsort((tie, key, ~bare, own))
            ends = np.flatnonzero(np.r_[own[last][1:] != own[last][:-1], True]) if len(last) else []
            for i in last[ends].tolist():
                row = not bare[i], int(key[i]), int(tie[i])
                top[int(own[i])] = max(row, top.get(int(own[i]), row))
        cols = [list(top), [not s for s, _, _ in top.values()], [k for _, k, _ in top.values()], [t for _, _, t in top.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], names=["range", "bare", "key", "tie"])


def _streamed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    names = ["doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "near_edited", "near_next"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    before = None
    rows: list[tuple] = []
    for b in batches:
        for rng, extra, bare, key, packed in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            text = unpack(packed).decode(errors="replace")
            here = (rng, None if bare else key, text, fingerprint(text))
            if before and before[0] == rng:
                _, k, t, fp = before
                made = edited(t, text)
                efp = fingerprint(made)
                rows.append((k, len(t), hashlib.sha256(made.encode()).hexdigest(), signed(fp), signed(efp), likeness(fp, efp), likeness(fp, here[3])))
            before = None if extra else here
        if len(rows) >= 512:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows = []
    cols = zip(*rows, strict=True) if rows else [()] * 7
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)


def bounds_of(rows: DataFrame, parts: int) -> list[tuple[bool, int, int]]:
    """Lower bounds of about equal ranges of (has an id, key, tie), from quantiles; a key that fills several is cut by ties."""
    share = [i / parts for i in range(1, parts)]
    if not share:
        return []
    cut = rows.agg(F.percentile_approx(F.when(~F.col("bare"), F.col("key")), share, 10_000).alias("keys"), F.count(F.lit(1)).alias("rows"), F.count_if("bare").alias("bare")).first()
    times: dict[int, int] = {}
    for k in cut["keys"] or []:
        times[k] = times.get(k, 0) + 1
    out = [(True, k, -(1 << 63)) for k, n in times.items()]
    for k in [k for k, n in times.items() if n > 1]:  # at most a key for every second range
        ties = rows.where(~F.col("bare") & (F.col("key") == k)).agg(F.percentile_approx("tie", [i / times[k] for i in range(1, times[k])], 10_000)).first()[0]
        out += [(True, k, t) for t in ties or []]
    if cut["bare"]:
        n = -(-parts * cut["bare"] // cut["rows"])
        ties = rows.where("bare").agg(F.percentile_approx("tie", [i / (n + 1) for i in range(1, n + 1)], 10_000)).first()[0]
        out += [(False, 0, t) for t in ties or []]
    return sorted(set(out))


def with_next(documents: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp and edited_fp (as signed longs), near_edited, near_next."""
    spark = documents.sparkSession
    key = F.col("doc_id").cast("long")
    rows = documents.select(key.isNull().alias("bare"), F.coalesce(key, F.lit(0)).alias("key"), F.xxhash64("text").alias("tie"), F.coalesce("text", F.lit("")).alias("text"))
    parts = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), documents.rdd.getNumPartitions())
    dealt = _Dealt(bounds_of(rows, parts))
    places = len(dealt.bounds) + 1
    found = arrow_map(rows.select("bare", "key", "tie"), _Heads(dealt), "range int, bare boolean, key long, tie long")
    heads = sorted((r["range"], r["top"]) for r in found.groupBy("range").agg(F.max(F.struct((~F.col("bare")).alias("some"), "key", "tie")).alias("top")).collect())  # a row for each range
    schema = "range int, bare boolean, key long, tie long, packed binary"
    own = arrow_map(rows, dealt, schema).withColumn("extra", F.lit(False))
    # The first row of a range also ends the range before it; the first range's ends the last.
    table = spark.createDataFrame([(not top.some, top.key, top.tie, heads[i - 1][0]) for i, (_, top) in enumerate(heads)], "bare boolean, key long, tie long, before int")
    firsts = rows.join(F.broadcast(table.drop("before")), ["bare", "key", "tie"]).groupBy("bare", "key", "tie").agg(F.min("text").alias("text"))  # equal rows have equal texts
    given = (
        arrow_map(firsts.select("bare", "key", "tie", "text"), dealt, schema)
        .join(F.broadcast(table), ["bare", "key", "tie"]).select(F.col("before").alias("range"), "bare", "key", "tie", "packed", F.lit(True).alias("extra"))
    )
    laid = own.unionByName(given).repartitionById(places, F.col("range")).sortWithinPartitions("range", "extra", "bare", F.desc("key"), F.desc("tie"))
    return arrow_map(laid.select("range", "extra", "bare", "key", "packed"), _streamed, "doc_id long, n_chars long, edited_sha256 string, fp long, edited_fp long, near_edited double, near_next double")


def blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, mask) of the blocks into which 64 bits are parted."""
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def _paired_with(radius: int):  # noqa: ANN202
    parts = blocks(radius)
    tables = list(combinations(range(len(parts)), 2))

    def same(a: np.ndarray, b: np.ndarray, block: int) -> np.ndarray:
        shift, mask = parts[block]
        return ((a ^ b) >> np.uint64(shift)) & np.uint64(mask) == 0

    def close(at: tuple, queries: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Pairs of a query and another fingerprint near it, each only in the first table where it agrees."""
        step = max(1, (1 << 18) // max(1, len(fps)))
        for k in range(0, len(queries), step):
            q = queries[k : k + step, None]
            far = np.bitwise_count(q ^ fps[None])
            good = (far > 0) & (far <= radius)
            for i, j in tables[: at[0]]:
                good &= ~(same(q, fps[None], i) & same(q, fps[None], j))
            x, y = np.nonzero(good)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(q[x, 0].view(np.int64)), pa.array(fps[y].view(np.int64))], names=["fp", "near"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, queries, found = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if queries and found:
                yield from close(key, np.array(queries, np.int64).view(np.uint64), np.array(found, np.int64).view(np.uint64))
            found.clear()

        for b in batches:
            for *at, is_query, fp in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if tuple(at) != key:
                    yield from flush()
                    key, queries = tuple(at), []
                if is_query:
                    queries.append(fp)
                elif queries:
                    found.append(fp)
                    if len(found) >= 4096:
                        yield from flush()
        yield from flush()

    return run


class _Paired:
    def __init__(self, radius: int) -> None:
        self.radius = radius

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _paired_with(self.radius)(batches)


def near_pairs(fingerprints: DataFrame, queries: DataFrame, radius: int = RADIUS, salt_rows: int = SALT_ROWS) -> DataFrame:
    """(fp, near): each query with each other fingerprint within the radius, once. Both tables have a column fp (long).

    Queries under one key stand in memory together, in each task that holds entries of the key.
    """
    parts = blocks(radius)
    keys = F.explode(F.array(*[
        F.struct(F.lit(t).alias("table"), (F.shiftrightunsigned("fp", parts[i][0]).bitwiseAND(F.lit(parts[i][1])) * (1 << 32) + F.shiftrightunsigned("fp", parts[j][0]).bitwiseAND(F.lit(parts[j][1]))).alias("key"))
        for t, (i, j) in enumerate(combinations(range(len(parts)), 2))
    ])).alias("k")
    keyed = lambda df: df.select("fp").distinct().select("fp", keys).select(F.col("k.table").alias("table"), F.col("k.key").alias("key"), "fp")
    entries, asked = keyed(fingerprints), keyed(queries)
    hot = entries.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > salt_rows).select("table", "key", F.ceil(F.col("n") / salt_rows).cast("int").alias("salts"))
    hot = materialize(hot, "hot-blocks")
    salts = F.coalesce("salts", F.lit(1))
    own = entries.join(hot, ["table", "key"], "left").select("table", "key", F.pmod(F.xxhash64("fp"), salts).cast("int").alias("salt"), F.lit(False).alias("is_query"), "fp")
    copies = asked.join(hot, ["table", "key"], "left").select("table", "key", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(True).alias("is_query"), "fp")
    laid = own.unionByName(copies).repartition("table", "key", "salt").sortWithinPartitions("table", "key", "salt", F.desc("is_query"))
    return arrow_map(laid, _Paired(radius), "fp long, near long")


def near_counts(fingerprints: DataFrame, queries: DataFrame, radius: int = RADIUS, salt_rows: int = SALT_ROWS) -> DataFrame:
    """fp of each query, and n: rows of ``fingerprints`` within the radius, from the pairs and the sizes of classes."""
    sizes = fingerprints.groupBy(F.col("fp").alias("near")).agg(F.count(F.lit(1)).alias("weight"))
    own = queries.select("fp", F.col("fp").alias("near")).distinct()
    return near_pairs(fingerprints, queries, radius, salt_rows).unionByName(own).join(sizes, "near").groupBy("fp").agg(F.sum("weight").alias("n"))


def _asked() -> Column:
    return F.col("doc_id") % QUERY_STEP == 0


def _hexed(c: str) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def op8(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near.

    n_near: for documents whose id is divisible by 20, how many other rows have a fingerprint within the radius.
    """
    made = materialize(with_next(documents), "fingerprints")
    counts = near_counts(made.select("fp"), made.where(_asked()).select("fp"))
    return made.join(counts, "fp", "left").select(
        "doc_id", "n_chars", "edited_sha256", _hexed("fp").alias("fingerprint"), _hexed("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next",
        F.when(_asked(), F.coalesce("n", F.lit(1)) - 1).alias("n_near"),
    )


def op8_near(documents: DataFrame) -> DataFrame:
    """fingerprint, near_fingerprint: of the documents that op8 counts for, and each other one within the radius.

    The documents of a fingerprint are those that op8 gives it for.
    """
    made = materialize(with_next(documents), "fingerprints")
    return near_pairs(made.select("fp"), made.where(_asked()).select("fp")).select(_hexed("fp").alias("fingerprint"), _hexed("near").alias("near_fingerprint"))


#: The same in DuckDB, for ids that don't repeat and aren't null.
_MADE_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(text) OVER w, first_value(text) OVER (ORDER BY doc_id DESC), '') AS following
  FROM documents WINDOW w AS (ORDER BY doc_id DESC)
), e AS (
  SELECT doc_id, text, substr(text, 1, length(text) - length(text) // 2) || substr(following, 1, length(text) // 2) AS made FROM d
), t AS (
  SELECT doc_id, false AS edited, text AS x FROM e UNION ALL SELECT doc_id, true, made FROM e
), h AS (
  SELECT doc_id, edited, list_transform(
           regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'),
           lambda v: CAST(md5_number_lower(v) AS HUGEINT)) AS one
  FROM t
), terms AS (
  SELECT doc_id, edited, CAST(h AS UBIGINT) AS h, length(bin(count(*))) AS weight
  FROM (SELECT doc_id, edited, unnest(list_concat(one, list_transform(range(1, greatest(len(one), 1)),
          lambda i: (one[i] * {PAIR} + one[i + 1]) % 18446744073709551616))) AS h FROM h)
  GROUP BY ALL
), bits AS (
  SELECT doc_id, edited, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN weight ELSE -weight END) > 0 AS up
  FROM terms, unnest(range(64)) AS u(b) GROUP BY ALL
), prints AS (
  SELECT doc_id, edited, CAST(sum(CASE WHEN up THEN CAST(1 AS HUGEINT) << b ELSE 0 END) AS UBIGINT) AS fp FROM bits GROUP BY ALL
), made AS (
  SELECT e.doc_id, length(e.text) AS n_chars, sha256(e.made) AS edited_sha256, coalesce(a.fp, 0) AS fp, coalesce(b.fp, 0) AS edited_fp
  FROM e LEFT JOIN prints a ON a.doc_id = e.doc_id AND NOT a.edited LEFT JOIN prints b ON b.doc_id = e.doc_id AND b.edited
)"""
ORACLE_SQL = rf"""{_MADE_SQL}, following AS (
  SELECT *, coalesce(lead(fp) OVER (ORDER BY doc_id DESC), first_value(fp) OVER (ORDER BY doc_id DESC)) AS next_fp FROM made
), near AS (
  SELECT q.doc_id, count(*) - 1 AS n_near FROM made q JOIN made o ON bit_count(xor(q.fp, o.fp)) <= {RADIUS} WHERE q.doc_id % {QUERY_STEP} = 0 GROUP BY 1
)
SELECT doc_id, n_chars, edited_sha256, lpad(printf('%x', fp), 16, '0') AS fingerprint, lpad(printf('%x', edited_fp), 16, '0') AS edited_fingerprint,
       1 - bit_count(xor(fp, edited_fp)) / 64.0::DOUBLE AS near_edited, 1 - bit_count(xor(fp, next_fp)) / 64.0::DOUBLE AS near_next, n_near
FROM following LEFT JOIN near USING (doc_id)
"""
NEAR_SQL = rf"""{_MADE_SQL}
SELECT DISTINCT lpad(printf('%x', q.fp), 16, '0') AS fingerprint, lpad(printf('%x', o.fp), 16, '0') AS near_fingerprint
FROM made q JOIN made o ON q.fp <> o.fp AND bit_count(xor(q.fp, o.fp)) <= {RADIUS} WHERE q.doc_id % {QUERY_STEP} = 0
"""
