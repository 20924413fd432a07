"""SentencePiece encoding and decoding by a streaming Viterbi search over a given vocabulary.

A text, with spaces written as U+2581 and one put before it, is cut into the pieces whose scores sum highest;
characters without a piece cost the lowest score less ten and fall back to byte pieces. The search takes one
character at a time. It keeps a window of the boundaries at which a piece has begun that may still go on, so at most
as many as the longest piece has characters, and commits ids when all paths to these and to the last boundary meet in
one. Where no piece goes on from one character to the next, as over the start of a word, all paths meet at once and
the search stands as at its beginning; so the ids between two such boundaries depend on the characters there alone, and
those of words, and of the parts that a word has, are remembered once they were searched. Of equal paths the one with the longer last piece wins; scores are sums of whole multiples of 2 to
the -24th, so that equal is exact.

A literal U+2581 in a text counts as a character without a piece, so that decoding gives back every text exactly.
The vocabulary file's path is a parameter; the model's scores are used as they are, also those of a BPE model (whose
ids may then differ from the library's merges), and tokenizers are never trained. Null texts count as empty and have
no ids; repeated rows give a row each; an empty table gives an empty result. Other columns pass through; new ones must
have unused names. A text of any length is one string in memory with its ids; what the search holds beside it is the
window and the steps of paths since the last boundary where all met.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import inf

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_map, ddl

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stands for a literal U+2581 while a text is cut; no valid text holds it.
_LITERAL = "\ud800"
#: What a character without a piece costs beyond the lowest score, and the unit of scores.
UNKNOWN_PENALTY, UNIT = 10.0, 1 << 24
#: Words, and parts of words, whose ids a task remembers; it forgets them when it ends.
WORDS, PARTS = 200_000, 400_000
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


@dataclass
class Vocabulary:
    """Pieces with id and score, in units, also as a tree by characters; "" leads to a piece that ends there."""

    pieces: dict[str, tuple[int, int]]
    tree: dict
    pairs: frozenset[str]  # neighbouring characters in pieces
    as_bytes: list[bytes]
    byte_ids: list[int]
    unknown: int
    longest: int
    by_word: bool

    @classmethod
    def of(cls, found: list[tuple[str, float, str]]) -> Vocabulary:
        """From (piece, score, kind) by id; kind is normal, byte or control."""
        normal = {p: (i, round(s * UNIT)) for i, (p, s, k) in enumerate(found) if k == "normal" and p}
        byte_ids = [0] * 256
        for i, (p, _, k) in enumerate(found):
            if k == "byte":
                byte_ids[int(p[3:5], 16)] = i
        tree: dict = {}
        for p, own in normal.items():
            node = tree
            for c in p:
                node = node.setdefault(c, {})
            node[""] = own
        raw = [bytes([int(p[3:5], 16)]) if k == "byte" else p.replace(SPACE, " ").encode() if k == "normal" else b"" for p, _, k in found]
        lowest = min((s for _, s in normal.values()), default=0)
        pairs = frozenset(p[i : i + 2] for p in normal for i in range(len(p) - 1))
        return cls(normal, tree, pairs, raw, byte_ids, lowest - round(UNKNOWN_PENALTY * UNIT), max(map(len, normal), default=1), not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in normal))


@lru_cache(maxsize=4)
def load_vocabulary(path: str = VOCABULARY) -> Vocabulary:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "byte" if m.is_byte(i) else "control" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "normal"
    return Vocabulary.of([(m.id_to_piece(i), m.get_score(i), kind(i)) for i in range(m.get_piece_size())])


def prepared(text: str) -> str:
    return SPACE + text.replace(SPACE, _LITERAL).replace(" ", SPACE) if text else ""


def fallback(c: str, v: Vocabulary) -> list[int]:
    return [v.byte_ids[b] for b in {_LITERAL: SPACE, SPACE: " "}.get(c, c).encode()]


def stream(text: Iterable[str], v: Vocabulary) -> Iterator[int]:
    """Ids of a prepared text given by characters, committed when all paths that are left meet.

    ``begun`` is the window: boundaries from which a piece may still go on, and how far in the tree it has come. Where
    none is, all paths meet at the last boundary. Else the paths are walked back to where they meet, each time that
    the stretch since the last commit has doubled, so that walking costs a constant share.
    """
    tree, unknown = v.tree, v.unknown
    begun: list[tuple[int, dict]] = []
    score, before, piece = [0], [0], [""]  # by boundary since the last commit: of its best path, and that path's last step
    due = 2 * v.longest
    for c in text:
        last = len(score) - 1
        begun.append((last, tree))
        going = []
        top, first, own, alone = -inf, last, c, True
        for b, node in begun:
            node = node.get(c)
            if node is not None:
                going.append((b, node))
                if "" in node:
                    i, s = node[""]
                    s += score[b]
                    if s > top:
                        top, first, own = s, b, i
                    if b == last:
                        alone = False
        if alone and score[last] + unknown > top:
            top, first, own = score[last] + unknown, last, c
        begun = going
        score.append(top)
        before.append(first)
        piece.append(own)
        if begun and len(score) <= due:
            continue
        end = last + 1
        meet = _meeting(before, [*(b for b, _ in begun), end]) if begun else end
        if meet:
            yield from _steps(before, piece, meet, v)
            score, before, piece = score[meet:], [0, *(x - meet for x in before[meet + 1 :])], piece[meet:]
            begun = [(b - meet, node) for b, node in begun]
        due = 2 * max(v.longest, len(score))
    yield from _steps(before, piece, len(score) - 1, v)


def _meeting(before: list[int], live: list[int]) -> int:
    """The last boundary that lies on the best paths of all living boundaries (in order)."""
    heads = set(live)
    while len(heads) > 1:
        most = max(heads)
        heads.remove(most)
        heads.add(before[most])
    return heads.pop()


def _steps(before: list[int], piece: list, end: int, v: Vocabulary) -> list[int]:
    """The ids of the best path to a boundary."""
    path = []
    while end:
        path.append(piece[end])
        end = before[end]
    out: list[int] = []
    for p in reversed(path):
        out += fallback(p, v) if isinstance(p, str) else (p,)
    return out


def brute_force(text: str, v: Vocabulary) -> list[int]:
    """Ids by a search over the whole text with all boundaries kept; for tests."""
    t = prepared(text)
    best: list[tuple[int, int, object]] = [(0, 0, None)]
    for j in range(1, len(t) + 1):
        ways = [(best[i][0] + v.pieces[t[i:j]][1], i, v.pieces[t[i:j]][0]) for i in range(j) if t[i:j] in v.pieces]
        if t[j - 1] not in v.pieces:
            ways.append((best[j - 1][0] + v.unknown, j - 1, t[j - 1]))
        best.append(max(ways, key=lambda w: (w[0], -w[1])))
    out, j = [], len(t)
    while j:
        _, i, piece = best[j]
        out.append(fallback(piece, v) if isinstance(piece, str) else [piece])
        j = i
    return [i for ids in reversed(out) for i in ids]


class _Remembered(dict):
    """Ids by word or part; those of a new one are searched."""

    def __init__(self, search: Callable[[str], bytes]) -> None:
        super().__init__()
        self.search = search

    def __missing__(self, key: str) -> bytes:
        got = self[key] = self.search(key)
        return got


class Encoder:
    """Streams texts through the search; what lies between two boundaries that no piece goes over is remembered."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.known = _Remembered(self._word)  # by word without the U+2581 before it
        self.parts = _Remembered(self._part)

    def _cut(self, text: str) -> list[str]:
        """The words of a text, each without the U+2581 before it."""
        text = text.replace(SPACE, _LITERAL)
        words = text.split(" ")
        return words if "" not in words else [w[1:] for w in _WORDS.findall(SPACE + text.replace(" ", SPACE))] if text else []

    def _part(self, part: str) -> bytes:
        return array("i", stream(part, self.v)).tobytes()

    def _word(self, word: str) -> bytes:
        whole, pairs, known = SPACE + word, self.v.pairs, self.parts
        cuts = [i for i in range(1, len(whole)) if whole[i - 1 : i + 1] not in pairs]
        return b"".join([known[whole[a:b]] for a, b in zip([0, *cuts], [*cuts, len(whole)], strict=True)])

    def forget(self) -> None:
        self.known.clear()
        self.parts.clear()

    def encode(self, text: str) -> np.ndarray:
        if not self.v.by_word:
            return np.fromiter(stream(prepared(text), self.v), np.int32)
        if len(self.known) > WORDS:
            self.known.clear()
        if len(self.parts) > PARTS:
            self.parts.clear()
        return np.frombuffer(b"".join(map(self.known.__getitem__, self._cut(text))), np.int32)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(load_vocabulary(path))


def decode_ids(ids: Iterable[int], v: Vocabulary) -> str:
    """The text of ids; the space before it is taken away, invalid bytes become U+FFFD."""
    return b"".join(map(v.as_bytes.__getitem__, ids)).removeprefix(b" ").decode(errors="replace")


class _Encoded:
    def __init__(self, path: str, text: int, into: str) -> None:
        self.path, self.text, self.into = path, text, into

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(self.path)
        for b in batches:
            ids = [own.encode(t or "") for t in b.column(self.text).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))], names=[*b.schema.names, self.into])
        own.forget()


class _Decoded:
    def __init__(self, path: str, ids: int, into: str) -> None:
        self.path, self.ids, self.into = path, ids, into

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(load_vocabulary(self.path).as_bytes, pa.binary())
        for b in batches:
            ids = b.column(self.ids)
            spelled = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, table.take(ids.values)), b"")
            texts = [(x or b"").removeprefix(b" ").decode(errors="replace") for x in spelled.to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, self.into])


class _Both:
    """Encoding and decoding in one pass over the rows."""

    def __init__(self, encoded: _Encoded, decoded: _Decoded) -> None:
        self.encoded, self.decoded = encoded, decoded

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return self.decoded(self.encoded(batches))


def _new(df: DataFrame, *names: str) -> None:
    if taken := {c.lower() for c in df.columns} & {n.lower() for n in names}:
        raise ValueError(f"there is a column {sorted(taken)[0]} already; name another")


def encode(documents: DataFrame, path: str = VOCABULARY, ids: str = "input_ids") -> DataFrame:
    """``documents`` with the ids of their texts."""
    _new(documents, ids)
    return arrow_map(documents, _Encoded(path, documents.columns.index("text"), ids), f"{ddl(documents)}, `{ids}` array<int>")


def decode(encoded: DataFrame, path: str = VOCABULARY, ids: str = "input_ids", decoded: str = "decoded") -> DataFrame:
    """Rows with the text that their ids spell."""
    _new(encoded, decoded)
    return arrow_map(encoded, _Decoded(path, encoded.columns.index(ids), decoded), f"{ddl(encoded)}, `{decoded}` string")


def round_trip(documents: DataFrame, path: str = VOCABULARY, ids: str = "input_ids", decoded: str = "decoded") -> DataFrame:
    """``documents`` with the ids of their texts and what these spell."""
    _new(documents, ids, decoded)
    both = _Both(_Encoded(path, documents.columns.index("text"), ids), _Decoded(path, len(documents.columns), decoded))
    return arrow_map(documents, both, f"{ddl(documents)}, `{ids}` array<int>, `{decoded}` string")


def op5(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, input_ids, decoded_sha256, and whether decoding gave back the text."""
    return round_trip(documents.select("doc_id", "text"), path).select(
        "doc_id", F.size("input_ids").cast("long").alias("n_tokens"), "input_ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )
