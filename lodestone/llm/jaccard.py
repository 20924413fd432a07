"""N-gram Jaccard join as an exact metric-space join.

Distance is one minus the Jaccard similarity of the sets of word shingles, a metric. Which documents can lie
within the threshold at all is found by shared shingles: in one order of all shingles (common ones last) two
linked sets share k of their first ``n - ceil(t n) + k``. The documents that share such a shingle lie around one
pivot, the smallest set of them; the documents of a pivot are its Voronoi region. Distances to the pivot are
computed exactly; those within the threshold link to it. (Sizes of linked sets differ by a fifth at most, the
same bound against the empty set, so a shingle's documents are first parted where their sorted sizes leap. Runs of a
few documents have no need of a region: their pairs are counted over all shingles, and a pair that no longer run
holds together can link only if k such runs do.) By the triangle inequality two linked documents differ
by at most the threshold in their distance to the pivot, so a region is cut into rings of that width, the
documents of a ring stand in the next one's window too, and cells that are large get a pivot of their own and
are cut again. Regions within a task's memory are cut there, others over tables. Small cells are joined exactly in
memory; a cell that no pivot parts is joined block by block.

Documents with equal sets are one class, and a cell gives a spanning forest of its links, so that copies are not
expanded into pairs. Components come from star contraction over link tables that are written to the shared
folder each round; joins read these alone, so that Spark can split a node with many links. Nothing but the table of
common shingles (of bounded size) and row counts reaches the driver.

Null and empty texts and texts without words have no set and link with nothing. Rows that share an id are one
document. Any long is an id. Rows with a null id link like others, each under a number that no id has and that its
text decides; their component's id is null where no row in it has one. Empty tables give empty results. ``op6`` leaves
out columns besides doc_id and text, whatever their names; ``keep_one`` gives back all columns. Sets of equal size in a
run come by id, the smallest first; a text of any length is one string in memory, with the hashes of its shingles.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from lodestone.llm.common import arrow_map, as_bytes, bucketed, ddl, discard, materialize, unused

SIZE, PERCENT = 5, 80
#: Shingles that linked sets share at least among their first ones, which are so many more; runs of a shingle's
#: documents up to this length are counted by pairs.
SHARED, SHORT_RUN = 3, 4
#: Rows of the table of common shingles, which only orders shingles; counts that make one common in a task; and documents, about, that are counted, and by how many tasks.
COMMON_ROWS, COMMON_LEAST, COMMON_SAMPLE, COMMON_TASKS = 65_536, 3, 32_768, 8
#: Shingles that a task counts together.
COUNTED = 2_000_000
#: Shingles of a cell that is joined in memory, rows of a region that one task cuts or of a salt of a larger one, rounds of cutting.
CELL_WEIGHT, SALT_ROWS, ROUNDS = 400_000, 500, 5
#: Bits of a sketch at least and at most; rows and bytes of sketches of a region that is sieved, larger ones go on whole.
SKETCH_LEAST, SKETCH_MOST, SIEVED_ROWS, SIEVED_BYTES = 64, 65_536, 16_384, 8 << 20
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
_SIGN = np.uint64(1 << 63)


def shingles(text: bytes, size: int = SIZE) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles; with fewer words the whole sequence is one."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        if i and i % len(_FACTORS) == 0:
            out ^= out >> np.uint64(29)
            out *= _FACTORS[3]
        out += h[i : len(h) - n + 1 + i] * _FACTORS[i % len(_FACTORS)]  # of hashes, so a sum is enough
    out ^= out >> np.uint64(32)
    out *= _FACTORS[3]
    out ^= out >> np.uint64(29)
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]]


def prefix_length(n: int, percent: int = PERCENT, shared: int = 1) -> int:
    """First shingles of a set in one order of all, of which a linked set has ``shared`` (or all it has) among its own."""
    return min(n, n - -(-percent * n // 100) + shared)


def linked(shared: int, n: int, m: int, percent: int = PERCENT) -> bool:
    return 100 * shared >= percent * (n + m - shared)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def packed(s: np.ndarray) -> np.ndarray:
    """As signed longs, for Arrow."""
    return s.view(np.int64)


# ---------------------------------------------------------------- sketches


def sketch(s: np.ndarray) -> bytes:
    """Parities of how many shingles fall on each bit, of which there are as many as shingles, up to a power of two.

    The bits in which two sketches differ are no more than the shingles that one set has and the other has not.
    """
    if not len(s):
        return b""
    bits = min(SKETCH_MOST, max(SKETCH_LEAST, 1 << (len(s) - 1).bit_length()))
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def _folded(rows: np.ndarray, words: int) -> np.ndarray:
    """The same sketches with fewer bits."""
    while rows.shape[1] > words:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def may_link(ids: np.ndarray, sizes: np.ndarray, sketches: list[bytes], percent: int) -> np.ndarray:
    """For each row, whether its sketch leaves it possible that it links with a row of another id.

    Linked sets of n and m shingles differ in (100 - percent) (n + m) / (100 + percent) of them at most.
    """
    out = np.zeros(len(ids), bool)
    words = np.array([len(x) // 8 for x in sketches])
    for w in np.unique(words[words > 0]).tolist():
        # Those of this width with each other, and with wider ones of a size that may link, folded.
        least = int(sizes[words == w].max())
        at = np.flatnonzero((words == w) | (words > w) & (percent * sizes <= 100 * least))
        at = at[np.argsort(sizes[at], kind="stable")]
        rows = np.concatenate([_folded(np.frombuffer(sketches[i], np.uint64)[None], w) for i in at])
        n, own = sizes[at], ids[at]
        step = max(1, (1 << 19) // (w * len(at)))
        home = np.flatnonzero(words[at] == w)
        for k in range(0, len(home), step):
            i = home[k : k + step]
            low, high = np.searchsorted(100 * n, percent * n[i[0]]), np.searchsorted(percent * n, 100 * n[i[-1]], "right")
            for lo in range(low, high, 1 << 14):
                j = np.arange(lo, min(high, lo + (1 << 14)))
                differ = np.bitwise_count(rows[i, None] ^ rows[None, j]).sum(2, dtype=np.int64)
                near = ((100 + percent) * differ <= (100 - percent) * (n[i, None] + n[None, j])) & (own[i, None] != own[None, j])
                out[at[i]] |= near.any(1)
                out[at[j]] |= near.any(0)
    return out


# ---------------------------------------------------------------- passes over texts


class _Counted:
    """Shingles that are common in the task, and how many sets hold each."""

    def __init__(self, size: int) -> None:
        self.size = size

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common: dict[int, int] = {}
        held: list[np.ndarray] = []
        seen: set[bytes] = set()
        total = 0

        def count() -> None:
            values, times = np.unique(np.concatenate(held), return_counts=True) if held else ([], np.zeros(0))
            for v, k in zip(packed(values[times >= COMMON_LEAST]).tolist(), times[times >= COMMON_LEAST].tolist(), strict=True) if held else ():
                common[v] = common.get(v, 0) + k
            if len(common) > 4 * COMMON_ROWS:
                for v in sorted(common, key=lambda v: (common[v], v))[: len(common) - 2 * COMMON_ROWS]:
                    del common[v]
            held.clear()
            seen.clear()

        for b in batches:
            for text in as_bytes(b.column(0)):
                s = shingles(text, self.size)
                digest = xxh3_128_digest(s.tobytes())
                if len(s) and digest not in seen:
                    seen.add(digest)
                    held.append(s)
                    total += len(s)
            if total >= COUNTED:
                count()
                total = 0
        count()
        yield pa.RecordBatch.from_arrays([pa.array(list(common), pa.int64()), pa.array(list(common.values()), pa.int64())], names=["key", "n"])


class _Profiled:
    """Id, tie, size, digest and sketch of each row's set, and its first shingles in the common order: rare ones, then common ones."""

    def __init__(self, size: int, percent: int, common) -> None:  # noqa: ANN001
        self.size, self.percent, self.common = size, percent, common

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ranks = self.common.value  # hashes sorted; rank: later for more common ones
        for b in batches:
            sizes, digests, sketches, keys, ends, rare = [], [], [], [np.zeros(0, np.int64)], [0], []
            for text in as_bytes(b.column(2)):
                s = shingles(text, self.size)
                sizes.append(len(s))
                digests.append(xxh3_128_digest(s.tobytes()))
                sketches.append(sketch(s))
                n = prefix_length(len(s), self.percent, SHARED)
                if len(hashes) and n:
                    at = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
                    rank = np.where(hashes[at] == s, ranks[at], 0)
                    first = np.argsort(rank, kind="stable")[:n]
                    s, rank = s[first], rank[first]
                    rare.append(int((rank == 0).sum()))
                else:
                    s = s[:n]
                    rare.append(n)
                keys.append(packed(s))
                ends.append(ends[-1] + n)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys)))
            columns = [b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), lists, pa.array(rare, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "tie", "n", "digest", "sketch", "keys", "rare"])


def _compressed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1).compress
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pack(t) for t in as_bytes(b.column(1))], pa.binary())], names=["id", "text"])


class _Measured:
    """Distances of a region's documents to its pivot, as shared shingles and sizes; the pivot comes first."""

    def __init__(self, size: int) -> None:
        self.size = size

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        region, pivot, centre = None, None, np.zeros(0, np.uint64)
        for b in batches:
            out = ([], [], [], [], [], [])
            for cell, salt, member, own, text in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                s = shingles(unpack(text), self.size)
                if not member:
                    if (cell, salt) != region:
                        region, pivot, centre = (cell, salt), own, s
                elif (cell, salt) == region:
                    for column, value in zip(out, (cell, pivot, own, len(s), len(centre), overlap(s, centre)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["cell", "pivot", "id", "n", "m", "shared"])


class _Joined:
    """Exact join of small cells (or of two blocks of a large one): a spanning forest of each one's links."""

    def __init__(self, size: int, percent: int) -> None:
        self.size, self.percent = size, percent

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        cell, members = None, []
        for b in batches:
            for at, window, own, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if at != cell:
                    yield self._links(members)
                    cell, members = at, []
                members.append((own, window, shingles(unpack(text), self.size)))
        yield self._links(members)

    def _links(self, members: list[tuple[int, bool, np.ndarray]]) -> pa.RecordBatch:
        return self._told(join_in_memory(members, self.percent))

    @staticmethod
    def _told(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["u", "v"])


class _Cut(_Joined):
    """Regions that fit in memory, each with its pivot first: cut into rings, joined with their windows, as links."""

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        cell, members = None, []
        for b in batches:
            for at, own, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if at != cell:
                    yield self._region(members)
                    cell, members = at, []
                members.append((own, shingles(unpack(text), self.size)))
        yield self._region(members)

    def _region(self, members: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        return self._told(join_around(members, self.percent))


def join_around(members: list[tuple[int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links of a region, its pivot first: those of the pivot, and of each ring with itself and its window."""
    if len(members) < 2:
        return []
    pivot, centre = members[0]
    out: list[tuple[int, int]] = []
    placed: dict[int, list[tuple[int, np.ndarray]]] = {}
    for own, s in members[1:]:
        shared = overlap(s, centre)
        if linked(shared, len(s), len(centre), percent):
            out.append((pivot, own))
        placed.setdefault(ring_of(shared, len(s) + len(centre) - shared, percent), []).append((own, s))
    for k, homes in placed.items():
        if k:  # those of ring 0 are linked through the pivot
            out += join_in_memory([(own, False, s) for own, s in homes] + [(own, True, s) for own, s in placed.get(k - 1, ())], percent)
    return out


def ring_of(shared: int, union: int, percent: int) -> int:
    """Ring k holds distances over k and up to k + 1 thresholds."""
    return max(0, -(-100 * (union - shared) // (union * (100 - percent))) - 1) if union else 0


def join_in_memory(members: list[tuple[int, bool, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links of a cell as a spanning forest; two documents of the window are not compared with each other.

    Candidates share one of their first shingles, rarest in the cell first; a pair that is connected is skipped.
    """
    if len(members) < 2:
        return []
    members = sorted(members, key=lambda m: (len(m[2]), m[0]))
    flat = np.concatenate([s for _, _, s in members])
    values, times = np.unique(flat, return_counts=True)
    parent = list(range(len(members)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    index: dict[int, list[list[int]]] = {}  # of each shingle's documents so far, those known to be connected together
    out = []
    for i, (own, window, s) in enumerate(members):
        if not len(s):
            continue
        rare = s[np.argsort(times[np.searchsorted(values, s)], kind="stable")[: prefix_length(len(s), percent)]].tolist()
        tried: set[int] = set()
        mine = i
        for key in rare:
            for group in index.get(key, ()):
                if len(group) == 1 and group[0] in tried or root(group[0]) == mine:
                    continue
                for j in group:
                    if j in tried:
                        continue
                    tried.add(j)
                    if window and members[j][1] or 100 * len(members[j][2]) < percent * len(s):
                        continue
                    if linked(overlap(members[j][2], s), len(s), len(members[j][2]), percent):
                        parent[mine] = root(j)
                        mine = root(j)
                        out.append((members[j][0], own))
                        break
        for key in rare:
            groups = index.setdefault(key, [])
            for group in groups if mine != i else ():
                if root(group[0]) == mine:
                    group.append(i)
                    break
            else:
                groups.append([i])
    return out


# ---------------------------------------------------------------- regions


def _laid(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*rows.columns[:3])


class _Sieved:
    """Of regions that come sorted, the pivot first, the members whose sketches leave a link possible."""

    def __init__(self, percent: int) -> None:
        self.percent = percent

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, size, whole = None, [], 0, False
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[0] != cell:
                    out += self._left(held)
                    cell, held, size, whole = row[0], [], 0, False
                if whole:
                    out += [row] if row[1] else []
                    continue
                held.append(row)
                size += len(row[5])
                if len(held) > SIEVED_ROWS or size > SIEVED_BYTES:
                    out += [r for r in held if r[1]]
                    held, whole = [], True
            yield self._batch(out)
        yield self._batch(self._left(held))

    def _left(self, held: list[tuple]) -> list[tuple]:
        """Pairs are compared with the pivot alone, members of the region with all of it."""
        centre = [r for r in held if not r[1]]
        region = [r for r in held if r[1] and not r[2]]
        out = [r for r in held if r[2] and any(self._possible([*centre, r]))]
        if region:
            out += [r for r, kept in zip(region, self._possible(centre + region)[len(centre) :], strict=True) if kept]
        return out

    def _possible(self, rows: list[tuple]) -> np.ndarray:
        return may_link(np.array([r[3] for r in rows], np.int64), np.array([r[4] for r in rows], np.int64), [r[5] for r in rows], self.percent)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = ((0, pa.int64()), (2, pa.bool_()), (3, pa.int64()), (4, pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in types], names=["cell", "single", "id", "n"])


def sieve(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Of (cell, pivot, id, single, n), rows whose sketches (id, n, sketch) leave a link with others of their cell possible.

    No link is lost: sketches bound the difference of two sets from below. Members of regions, most of which share
    one shingle by chance, so need not be read as texts.
    """
    centres = pairs.select("cell", F.lit(False).alias("member"), F.lit(False).alias("single"), F.col("pivot").alias("id")).distinct()
    every = centres.unionByName(pairs.select("cell", F.lit(True).alias("member"), "single", "id"))
    rows = every.join(sketches, "id").select("cell", "member", "single", "id", "n", "sketch").repartition("cell").sortWithinPartitions("cell", "member", "single", "id")
    left = arrow_map(rows, _Sieved(percent), "cell long, single boolean, id long, n long")
    return materialize(left.groupBy("cell", F.col("cell").alias("pivot"), "id").agg(F.min("single").alias("single"), F.max("n").alias("n")), "sieved")


def measure(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """From (cell, pivot, id): cell, pivot, id, sizes n and m, and shared shingles, written to the shared folder.

    A large region is dealt over salts, to each of which its pivot is copied.
    """
    regions = pairs.groupBy("cell").agg(F.first("pivot").alias("pivot"), F.count(F.lit(1)).alias("rows"))
    regions = regions.withColumn("salts", F.ceil(F.col("rows") / SALT_ROWS).cast("int"))
    large = regions.where("salts > 1").select("cell", "salts")
    salt = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    centres = regions.select("cell", F.col("pivot").alias("id"), "salts").join(texts, "id").select("cell", salt, F.lit(False).alias("member"), "id", "text")
    own = pairs.join(large, "cell", "left").select("cell", "id", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    members = own.join(texts, "id").select("cell", "salt", F.lit(True).alias("member"), "id", "text")
    rows = centres.unionByName(members).repartition("cell", "salt").sortWithinPartitions("cell", "salt", "member", "id")
    return materialize(arrow_map(rows, _Measured(size), "cell long, pivot long, id long, n long, m long, shared long"), "distances")


def cut(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links of regions that fit in memory, from (cell, pivot, id): each goes to one task, its texts once."""
    centres = pairs.groupBy("cell").agg(F.first("pivot").alias("id")).select("cell", F.lit(False).alias("member"), "id")
    every = centres.unionByName(pairs.select("cell", F.lit(True).alias("member"), "id"))
    rows = every.join(texts, "id").select("cell", "member", "id", "text").repartition("cell").sortWithinPartitions("cell", "member", "id")
    return materialize(arrow_map(rows, _Cut(size, percent), "u long, v long"), "region-links")


def near(distances: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) of pivots with what lies within the threshold."""
    within = 100 * F.col("shared") >= percent * (F.col("n") + F.col("m") - F.col("shared"))
    return distances.where((F.col("id") != F.col("pivot")) & within).select(F.col("pivot").alias("u"), F.col("id").alias("v"))


def rings(distances: DataFrame, percent: int) -> DataFrame:
    """(cell, id, n, window): the cells of rings that documents beyond the threshold occupy, with their windows.

    Ring k holds distances over k and up to k + 1 thresholds. Documents of ring 0 link to the pivot and so with
    each other; they matter only as the window of ring 1. The pivot itself is linked or too far for all others.
    """
    union = F.col("n") + F.col("m") - F.col("shared")
    ring = F.greatest(F.lit(0), F.ceil(100 * (union - F.col("shared")) / (union * (100 - percent)) - F.lit(1e-12)).cast("int") - 1)
    placed = distances.select("cell", "id", "n", ring.alias("ring"))
    homes = placed.where("ring > 0").select("cell", "ring", "id", "n", F.lit(False).alias("window"))
    windows = placed.select("cell", (F.col("ring") + 1).alias("ring"), "id", "n", F.lit(True).alias("window"))
    cells = homes.unionByName(windows)
    kept = cells.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("rows"), F.max((~F.col("window")).cast("int")).alias("has_home")).where("rows > 1 AND has_home = 1").select("cell", "ring")
    return cells.join(kept, ["cell", "ring"]).select(F.xxhash64("cell", "ring").alias("cell"), "id", "n", "window")


def links(pairs: DataFrame, texts: DataFrame, size: int = SIZE, percent: int = PERCENT, cell_weight: int = CELL_WEIGHT, rounds: int = ROUNDS) -> list[DataFrame]:
    """All links among the documents of common regions, from (cell, pivot, id, n), up to connection: tables of (u, v).

    Regions within ``cell_weight`` and SALT_ROWS are cut in one task each, the others over tables, until their cells
    are small.
    """
    weights = materialize(pairs.groupBy("cell").agg(F.sum("n").alias("weight"), F.count(F.lit(1)).alias("rows")), "region-weights")
    large = (F.col("weight") > cell_weight) | (F.col("rows") > SALT_ROWS)
    out = [cut(pairs.join(weights.where(~large), "cell", "left_semi"), texts, size, percent)]
    pairs = pairs.join(weights.where(large), "cell", "left_semi").select("cell", "pivot", "id")
    if weights.where(large).isEmpty():
        return out
    for depth in range(rounds):
        distances = measure(pairs, texts, size)
        out.append(near(distances, percent))
        cells = materialize(rings(distances.where("id != pivot"), percent), "cells")
        weights = materialize(cells.groupBy("cell").agg(F.sum("n").alias("weight"), F.min(F.struct("window", "id")).alias("first")), "weights")
        out.append(_join(cells.join(weights.where(F.col("weight") <= cell_weight).select("cell"), "cell"), texts, size, percent))
        large = weights.where(F.col("weight") > cell_weight)
        if large.isEmpty():
            return out
        rest = cells.join(large.select("cell", "weight", F.col("first.id").alias("pivot")), "cell")
        if depth + 1 < rounds:
            pairs = rest.select("cell", "pivot", "id")
        else:  # no pivot parts these: block by block
            blocks = F.ceil(2 * F.col("weight") / cell_weight).cast("int")
            own = rest.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
            other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
            dealt = own.select("cell", "id", "n", "window", "own", other.alias("other")).select(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "id", "n", "window")
            out.append(_join(dealt, texts, size, percent))
    return out


def _join(cells: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    rows = cells.select("cell", "window", "id").join(texts, "id").select("cell", "window", "id", "text").repartition("cell").sortWithinPartitions("cell", "window", "id")
    return materialize(arrow_map(rows, _Joined(size, percent), "u long, v long"), "links")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of each document with a link: rounds of large-star and small-star until nothing moves."""
    edges = materialize(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = materialize(small.where("u != v").distinct(), "stars")
        discard(edges, least, large, low)
        edges = after
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        seen = now


def identified(documents: DataFrame) -> tuple[Column, bool]:
    """What identifies a row: its id, or where that is null a hash of its text that no row has as its id; and whether there are such."""
    given = F.col("doc_id").cast("long")
    bare = documents.where(given.isNull())
    if bare.isEmpty():
        return given, False
    ids = documents.select(given.alias("id")).where("id IS NOT NULL")
    salt = 0
    while not (made := bare.select(F.xxhash64(F.lit(salt), F.coalesce("text", F.lit(""))).alias("id")).distinct()).join(ids, "id", "left_semi").isEmpty():
        salt += 1
    return F.coalesce(given, F.xxhash64(F.lit(salt), F.coalesce("text", F.lit("")))), True


def classes(documents: DataFrame, size: int = SIZE, percent: int = PERCENT, cell_weight: int = CELL_WEIGHT, rounds: int = ROUNDS, own_id: Column | None = None, tie: Column | None = None) -> DataFrame:
    """(id, tie, n, component) of each row; the id is the document's, or stands for the text of a row without one."""
    spark = documents.sparkSession
    own_id = identified(documents)[0] if own_id is None else own_id
    rows = documents.select(own_id.alias("id"), (F.lit(0).cast("long") if tie is None else tie).alias("tie"), "text")
    every = max(1, -(-rows.count() // COMMON_SAMPLE))  # the table's rows come from a sample by id: any order of shingles gives the same links
    sampled = rows.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("text").repartition(COMMON_TASKS)
    counted = arrow_map(sampled, _Counted(size), "key long, n long")
    common = counted.groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(COMMON_ROWS).collect()  # of bounded size
    hashes = np.array([r.key for r in common], np.int64).view(np.uint64)
    by = np.argsort(hashes)
    table = spark.sparkContext.broadcast((hashes[by], (len(hashes) - np.arange(len(hashes)))[by]))
    profile = materialize(arrow_map(rows, _Profiled(size, percent, table), "id long, tie long, n long, digest binary, sketch binary, keys array<long>, rare int"), "profile")
    rows = rows.drop("tie")
    own = materialize(profile.select("id", "tie", "n", "digest"), "sets")
    nodes = materialize(own.where("n > 0").groupBy("digest").agg(F.min("id").alias("node")), "nodes")
    node_of = materialize(own.where("n > 0").select("id", "digest", "n").distinct().join(nodes, "digest").select("id", "node", "n"), "members")

    key = lambda keys: profile.select(F.explode(keys).alias("key"), F.col("n").cast("int").alias("n"), "id")
    rare_keys, common_keys = key(F.slice("keys", F.lit(1), F.col("rare"))), key(F.slice("keys", F.col("rare") + 1, F.size("keys")))
    # Few keys, but of many rows: sizes fall into bands of which linked ones span two, and pivots are found by partial sums.
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.01 * 100 / percent)))
    banded = materialize(common_keys.select("key", F.explode(F.array(band, band + 1)).alias("band"), "n", "id"), "common-keys")
    first = banded.groupBy("key", "band").agg(F.min(F.struct("n", "id")).alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("key", "band", F.col("first.id").alias("pivot"))
    first = materialize(first, "common-pivots")  # read anew, the join's sides are plain exchanges, of which a hot key's can be split
    around = banded.join(first, ["key", "band"]).select("id", "pivot")
    # Of other keys' rows, sorted by size, each long run of sizes that may link goes to the region of its first one.
    rest = rare_keys.repartition("key").sortWithinPartitions("key", "n", "id")
    found = arrow_map(rest, _Around(percent), "id long, pivot long, needed int").groupBy("id", "pivot", "needed").agg(F.count(F.lit(1)).alias("runs"))
    found = materialize(found.where("needed = 0 OR runs >= needed").select("id", "pivot", (F.col("needed") > 0).alias("single")).unionByName(around.where("id != pivot").distinct().withColumn("single", F.lit(False))), "found")
    as_node = lambda df, c: df.join(node_of.select(F.col("id").alias(c), F.col("node").alias(f"{c}_node"), F.col("n").alias(f"{c}_n")), c)
    pairs = as_node(as_node(found, "id"), "pivot").select(F.col("pivot_node").alias("cell"), F.col("pivot_node").alias("pivot"), F.col("id_node").alias("id"), F.col("id_n").alias("n"), "single")
    pairs = materialize(pairs.where("id != pivot").groupBy("cell", "pivot", "id").agg(F.min("single").alias("single"), F.max("n").alias("n")), "pairs")
    sketches = profile.where("n > 0").select("id", "n", "sketch").distinct()
    pairs, unsieved = sieve(pairs, sketches, percent), pairs
    discard(banded, first, found, unsieved, profile)
    needed = pairs.select("id").unionByName(pairs.select(F.col("pivot").alias("id"))).distinct()
    texts = bucketed(arrow_map(rows, _compressed, "id long, text binary").join(needed.hint("merge"), "id", "left_semi"), "texts", "id")

    edges = node_of.where("id != node").select(F.col("id").alias("u"), F.col("node").alias("v"))
    edges = edges.unionByName(near(measure(pairs.where("single").select("cell", "pivot", "id"), texts, size), percent))
    for more in links(pairs.where("NOT single").drop("single"), texts, size, percent, cell_weight, rounds):
        edges = edges.unionByName(more)
    linked_ids = components(edges)
    discard(texts, pairs, node_of, nodes)
    table.unpersist()
    return own.select("id", "tie", "n").join(linked_ids, "id", "left").select("id", "tie", "n", F.coalesce("component", "id").alias("component"))


class _Around:
    """From rows that come sorted by key, size and id: what lies around what, by runs of sizes that may link.

    Of a long run, (id, first id, 0) for all but the first; of a short one all its few pairs, with the number of
    such runs that a link needs.
    """

    def __init__(self, percent: int) -> None:
        self.percent = percent

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = n = own = np.zeros(0, np.int64)  # the rows of the last run so far
        open_run = None  # of a run over 8192 rows, which are given out as they come: key and size of its last row, and its first id
        for b in batches:
            more = [b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]
            if open_run and len(more[0]):
                at, size, first = open_run
                ends = np.flatnonzero(self._parted(np.r_[at, more[0]], np.r_[size, more[1]]))
                to = int(ends[0]) if len(ends) else len(more[0])
                yield self._batch(more[2][:to], np.full(to, first), np.zeros(to, np.int64))
                open_run = None if len(ends) else (at, more[1][-1], first)
                more = [x[to:] for x in more]
            key, n, own = (np.concatenate(x) for x in zip((key, n, own), more, strict=True))
            if not len(key):
                continue
            starts = np.flatnonzero(np.r_[True, self._parted(key, n)])
            last = int(starts[-1])
            yield self._told(n[:last], own[:last], starts[:-1])
            key, n, own = key[last:], n[last:], own[last:]
            if len(key) > 8192:
                yield self._told(n, own, np.zeros(1, np.int64))
                open_run = key[-1], n[-1], own[0]
                key = n = own = np.zeros(0, np.int64)
        yield self._told(n, own, np.flatnonzero(np.r_[True, self._parted(key, n)]) if len(key) else np.zeros(0, np.int64))

    def _parted(self, key: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether a run ends between a row and the next."""
        return (key[1:] != key[:-1]) | (100 * n[:-1] < self.percent * n[1:])

    def _told(self, n: np.ndarray, own: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        """Runs from each start to the next."""
        size = np.diff(np.r_[starts, len(own)])
        ids, pivots, needed = [], [], []
        if len(starts):
            run = np.repeat(np.arange(len(starts)), size)
            far = (size[run] > SHORT_RUN) & (np.arange(len(own)) != starts[run])
            ids.append(own[far])
            pivots.append(own[starts[run]][far])
            needed.append(np.zeros(int(far.sum()), np.int64))
            for i in range(SHORT_RUN - 1):
                for j in range(i + 1, SHORT_RUN):
                    at = starts[(size > j) & (size <= SHORT_RUN)]
                    ids.append(own[at + j])
                    pivots.append(own[at + i])
                    needed.append(np.minimum(SHARED, n[at + i]))
        whole = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return self._batch(whole(ids), whole(pivots), whole(needed))

    @staticmethod
    def _batch(ids: np.ndarray, pivots: np.ndarray, needed: np.ndarray) -> pa.RecordBatch:
        other = ids != pivots
        return pa.RecordBatch.from_arrays([pa.array(ids[other]), pa.array(pivots[other]), pa.array(needed[other].astype(np.int32))], names=["id", "pivot", "needed"])


def op6(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    own_id, some_bare = identified(documents)
    if not some_bare:
        return classes(documents, own_id=own_id).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    # Numbers that stand for rows without an id are told from ids by the tie column, and give way to the least id.
    found = materialize(classes(documents, own_id=own_id, tie=F.col("doc_id").isNull().cast("long")), "classes").withColumn("doc_id", F.when(F.col("tie") == 0, F.col("id")))
    least = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


class _Restored:
    """The rows' texts, unpacked and in their place."""

    def __init__(self, columns: list[str]) -> None:
        self.columns = columns

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            names = b.schema.names
            texts = pa.array([None if t is None else unpack(t).decode() for t in b.column(names.index("text")).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if c == "text" else b.column(names.index(c)) for c in self.columns], names=self.columns)


class _Shipped:
    """All columns, the text compressed."""

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            at = b.schema.names.index("text")
            texts = pa.array([None if t is None else pack(t) for t in b.column(at).cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)


def keep_one(documents: DataFrame) -> DataFrame:
    """One row of each component, that of the smallest id; rows that share an id are one document. Columns as given.

    Of a component without ids the row stays whose number is smallest, and of several rows with one id that whose
    columns have the smallest hash. Rows with neither an id nor words link with nothing and all stay.
    """
    own_id, some_bare = identified(documents)
    kept_id, tie, place = (unused(documents.columns, c) for c in ("kept_id", "kept_tie", "kept_place"))
    stays = F.col("doc_id").isNull() & ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    # Rows that are the same in all that is hashed stand in for each other; maps can't be hashed.
    content = F.when(stays, F.lit(0).cast("long")).otherwise(F.xxhash64(*[F.col(f"`{f.name}`") for f in documents.schema if "map<" not in f.dataType.simpleString()]))
    found = classes(documents, own_id=own_id, tie=content)
    if some_bare:  # the smallest id of a component, or the smallest number where no row has one
        found = materialize(found, "classes")
        real = documents.select(F.col("doc_id").cast("long").alias("id")).where("id IS NOT NULL").distinct().withColumn("real", F.lit(0))
        ranked = found.join(real, "id", "left").withColumn("rank", F.struct(F.coalesce("real", F.lit(1)), "id"))
        best = ranked.groupBy("component").agg(F.min("rank").alias("best"))
        found = ranked.join(best, "component").where(F.col("rank") == F.col("best"))
    else:
        found = found.where("id = component")
    kept = found.groupBy(F.col("id").alias(kept_id)).agg(F.min("tie").alias(tie))
    # Of what all stays each row has a place of its own; for others the column is null.
    named = documents.withColumns({kept_id: own_id, tie: content, place: F.when(stays, F.monotonically_increasing_id())})
    shipped = arrow_map(named, _Shipped(), ddl(named, text="binary"))
    rows = shipped.join(kept, [kept_id, tie], "left_semi").dropDuplicates([kept_id, place])
    return arrow_map(rows.select(*[F.col(f"`{c}`") for c in documents.columns]), _Restored(documents.columns), documents.schema)


def brute_force(rows: list[tuple[int, str | None]], size: int = SIZE, percent: int = PERCENT) -> dict[int, tuple[int, int]]:
    """{doc_id: (n_shingles, component_id)} by comparing all pairs; for tests."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


#: The same in DuckDB, for ids that don't repeat and aren't null; it counts all pairs, so tables must be small.
ORACLE_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - {SIZE - 1}, 1) + 1), lambda i: array_to_string(w[i : i + {SIZE - 1}], ' '))) END AS s FROM w
), x AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))
), beside AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT doc_id, doc_id AS root FROM s UNION SELECT b, root FROM reached JOIN beside ON a = doc_id
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(root) AS component_id FROM s JOIN reached USING (doc_id) GROUP BY ALL
"""
