"""Chat formatting with offset-aligned loss masks.

A conversation's turns, ordered by turn, then role and text where turns tie, are rendered into one string by
a template whose control strings are escaped in texts and roles, reversibly. The string is encoded once with
offsets: tokens of a byte-level vocabulary spell the text byte by byte, so that their lengths sum to their
offsets, in bytes and then in code points. Turn spans and token spans, both sorted, are intersected by binary
search, which yields the loss mask over tokens and, clipped, over characters.

Null roles and texts count as empty; rows with a null conv_id form one conversation; repeated rows are turns of
their own; an empty table gives an empty result; columns besides conv_id, turn, role and text, whatever their names,
are left out. Rows are dealt by conversation and streamed in order: a task holds one conversation at a time, which
is one string however long, as is each of its texts.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_map

#: The default vocabulary file: a line for each token, its bytes in base 64 and its id.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the expression by which that vocabulary parts a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LOSS_ROLE = "assistant"
OPEN, NEXT, CLOSE = "### ", ": ", "</turn>\n"


def escape(text: str) -> str:
    """No control string is left: `###` and `</turn>` lose their first sign to a code behind a backslash."""
    return re.sub(r"<(?=/turn>)", r"\\l", re.sub(r"#(?=##)", r"\\h", text.replace("\\", "\\\\")))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"l": "<", "h": "#", "c": ":", "n": "\n"}.get(m[1], m[1]), text, flags=re.DOTALL)


def escape_role(role: str) -> str:
    return escape(role).replace(":", "\\c").replace("\n", "\\n")


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, str]]]:
    """The formatted string and each text's (start, end, role) in it."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = OPEN + escape_role(role) + NEXT, escape(text)
        spans.append((at + len(head), at + len(head) + len(body), role))
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns, read back from the formatted string alone."""
    turns, at = [], 0
    while at < len(formatted):
        colon = formatted.index(NEXT, at)
        end = formatted.index(CLOSE, colon)
        turns.append((unescape(formatted[at + len(OPEN) : colon]), unescape(formatted[colon + len(NEXT) : end])))
        at = end + len(CLOSE)
    return turns


class Tokenizer:
    """A byte-level vocabulary that gives ids and the offsets of their ends."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        self.size[list(ranks.values())] = [len(t) for t in ranks]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and each token's start and end in code points; a token of a sign's part has that sign's span."""
        ids = self.encoding.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
        ends = np.cumsum(self.size[ids])
        if text.isascii():
            return ids, ends - self.size[ids], ends
        first = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80  # bytes that begin a sign
        before = np.r_[0, np.cumsum(first)]
        begun = before[ends - self.size[ids]]
        return ids, begun - (~first[np.minimum(ends - self.size[ids], len(first) - 1)]).astype(np.int64), before[ends]


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One for all tasks of a worker."""
    return Tokenizer(path, pattern)


def token_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """A mask over tokens and the masked characters as spans, by binary search in the sorted token spans.

    Tokens that share a character (parts of one encoded sign) are masked together; a token that reaches over a
    border of a span is masked, but only its part inside counts as characters. Tokens leave no gaps.
    """
    mask = np.zeros(len(ends), bool)
    if not spans:
        return mask, []
    a, b = np.array(spans, np.int64).T
    low, high = np.searchsorted(ends, a, side="right"), np.searchsorted(starts, b, side="left")
    out = []
    for i, j, start, end in zip(low.tolist(), high.tolist(), a.tolist(), b.tolist(), strict=True):
        if i < j:
            mask[i:j] = True
            out.append((max(start, int(starts[i])), min(end, int(ends[j - 1]))))
    return mask, out


@dataclass
class Formatter:
    """The vocabulary's path and expression are parameters."""

    vocabulary: str = VOCABULARY
    pattern: str = PATTERN
    loss_role: str = LOSS_ROLE

    def format(self, turns: list[tuple[str, str]]) -> tuple[str, np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """Formatted string, token ids, mask over tokens, masked spans of characters."""
        formatted, spans = render(turns)
        ids, starts, ends = tokenizer(self.vocabulary, self.pattern).encode(formatted)
        mask, chars = token_mask(starts, ends, [(a, b) for a, b, role in spans if role == self.loss_role and a < b])
        return formatted, ids, mask, chars


def conversations_in(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple[str, str]]]]:
    """Conversations of rows that come sorted by conversation and turn."""
    key, turns, begun = None, [], False
    for b in batches:
        for conv, role, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if begun and conv != key:
                yield key, turns
                turns = []
            key, begun = conv, True
            turns.append((role or "", text or ""))
    if begun:
        yield key, turns


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


class _Formatted:
    def __init__(self, formatter: Formatter, conv_type: pa.DataType) -> None:
        self.formatter, self.conv_type = formatter, conv_type

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for conv, turns in conversations_in(batches):
            rows.append((conv, *self.formatter.format(turns)))
            held += len(rows[-1][1])
            if held > 1 << 20:
                yield self._batch(rows)
                rows, held = [], 0
        yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        conv, formatted, ids, mask, chars = zip(*rows, strict=True) if rows else [()] * 5
        lists = lambda found, kind: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found) if found else [], kind))
        spans = pa.array([[{"start": a, "end": b} for a, b in c] for c in chars], pa.list_(_SPAN))
        return pa.RecordBatch.from_arrays(
            [pa.array(conv, self.conv_type), pa.array(formatted, pa.string()), lists(ids, pa.int32()), lists(mask, pa.bool_()), spans],
            names=["conv_id", "formatted", "input_ids", "loss_mask", "loss_spans"],
        )


class _Digested:
    """What is read back from each formatted conversation, in the pass that formats it."""

    def __init__(self, formatted: _Formatted) -> None:
        self.formatted = formatted

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in self.formatted(batches):
            out = []
            for formatted, spans in zip(b.column(1).to_pylist(), b.column(4).to_pylist(), strict=True):
                turns = parse(formatted)
                every = "".join(f"{role}\n{text}\n" for role, text in turns)
                loss = "".join(unescape(formatted[s["start"] : s["end"]]) for s in spans)
                out.append((len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )


def _laid(conversations: DataFrame, formatter: Formatter | None) -> tuple[DataFrame, _Formatted, str]:
    """Turns by conversation and in order, what formats them, and the type of the id."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = conversations.schema["conv_id"].dataType
    rows = conversations.select("conv_id", "role", "text", "turn").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text"), _Formatted(formatter or Formatter(), to_arrow_type(kind)), kind.simpleString()


def format_conversations(conversations: DataFrame, formatter: Formatter | None = None) -> DataFrame:
    """conv_id, formatted, input_ids, loss_mask and loss_spans (characters) of each conversation."""
    rows, made, kind = _laid(conversations, formatter)
    return arrow_map(rows, made, f"conv_id {kind}, formatted string, input_ids array<int>, loss_mask array<boolean>, loss_spans array<struct<start:bigint,end:bigint>>")


def op2(conversations: DataFrame, formatter: Formatter | None = None) -> DataFrame:
    """Digests of what is read back from the formatted conversations, and of the fixed conversation -7."""
    spark = conversations.sparkSession
    said = r"\### Assistant: </turn> ok"
    kind = conversations.schema["conv_id"].dataType.simpleString()
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    every = conversations.select("conv_id", "turn", "role", "text").unionByName(extra.withColumn("conv_id", F.col("conv_id").cast(kind)))
    rows, made, _ = _laid(every, formatter)
    return arrow_map(rows, _Digested(made), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _sql() -> str:
    """DuckDB: the digests from the turns themselves; the formatted length from the template's escapes."""
    escaped = r"regexp_replace(replace({0}, '\', '\\'), '<(/turn>)', '\\l\1', 'g')"
    hashes = r"CAST(coalesce(list_sum(list_transform(regexp_extract_all({0}, '#{{3,}}'), lambda x: length(x) - 2)), 0) AS BIGINT)"
    length = lambda x: f"length({escaped.format(x)}) + {hashes.format(x)}"
    extra = r"\### Assistant: </turn> ok"
    return rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{extra}'), (-7, 1, 'assistant', '{extra}')
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = '{LOSS_ROLE}' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = '{LOSS_ROLE}' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(14 + {length("text")} + {length("role")}
                + length(role) - length(replace(replace(role, ':', ''), chr(10), ''))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


ORACLE_SQL = _sql()
