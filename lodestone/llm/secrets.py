"""Secret scans: Aho-Corasick keyword prefilter, anchored expressions near hits, checksum validation.

Texts are scanned as UTF-8 bytes; an automaton finds keywords, and an expression anchored at a hit decides.
The base kinds (assign, access, hex) are leftmost and non-overlapping per kind. Runs of hex digits have no
keyword of their own: over the text's classes of characters such a run's least length is one, for an automaton of
its own. Further kinds carry an embedded checksum and count only where it holds: ``github`` and ``npm`` (six
base-62 digits of the CRC-32 of the body), ``age`` and ``nsec`` (the Bech32 code of their whole). ``jwt`` has no
checksum; its first part must decode to a JSON object that names an algorithm. Offsets are code points.

Null texts count as empty and have no spans; repeated rows give a row each; an empty table gives an empty result;
columns besides doc_id and text, whatever their names, are left out. A text of any length is one string in memory,
scanned in time linear in its length: expressions begin at keywords and run over characters that no other hit of
the kind begins in. Of keywords at one place the one that ends first is tried first. One pass, no shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_map, as_bytes

#: Base kinds in the order of the digest, then those of this method.
KINDS = ("assign", "access", "hex", "github", "npm", "age", "nsec", "jwt")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
GITHUB = re.compile(rb"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
NPM = re.compile(rb"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
AGE = re.compile(rb"AGE-SECRET-KEY-1[AC-HJ-NP-Z02-9]{58}(?![0-9A-Za-z])")
NSEC = re.compile(rb"nsec1[ac-hj-np-z02-9]{58}(?![0-9A-Za-z])")
JWT = re.compile(rb"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
#: The digits of base 62 and of Bech32, and Bech32's generator.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
_HEX_CLASS = bytes(104 if chr(c) in "0123456789abcdef" else 32 for c in range(256))


def checksum62(body: bytes) -> bytes:
    """CRC-32 of the body in six base-62 digits."""
    value, out = zlib.crc32(body), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = BASE62[digit] + out
    return out.encode()


def bech32_holds(word: str) -> bool:
    """Whether the last six signs of a Bech32 word are the checksum of its prefix and data."""
    prefix, _, data = word.lower().rpartition("1")
    values = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + [BECH32.find(c) for c in data]
    check = 1
    for v in values:
        top = check >> 25
        check = (check & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate(BECH32_GENERATOR):
            check ^= g if top >> i & 1 else 0
    return check == 1


def _json_header(part: bytes) -> bool:
    """Whether a token's first part is a JSON object with an algorithm; one that can't be decoded, also for its depth, isn't."""
    try:
        found = json.loads(base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4)))
    except (ValueError, RecursionError):
        return False
    return isinstance(found, dict) and "alg" in found


#: For each kind with keywords: its keywords, the expression, and what a match must pass.
_BY_KIND = {
    "assign": (ASSIGN_WORDS, ASSIGN, lambda m: len(m[2]) >= ASSIGN_LEAST),
    "access": (("akia",), ACCESS, lambda m: len(m[0]) >= ACCESS_LEAST),
    "github": (tuple(f"gh{x}_" for x in "pousr"), GITHUB, lambda m: checksum62(m[1]) == m[2]),
    "npm": (("npm_",), NPM, lambda m: checksum62(m[1]) == m[2]),
    "age": (("age-secret-key-1",), AGE, lambda m: bech32_holds(m[0].decode())),
    "nsec": (("nsec1",), NSEC, lambda m: bech32_holds(m[0].decode())),
    "jwt": (("eyj",), JWT, lambda m: _json_header(m[1])),
}


class Scanner:
    """The automata: one over the lower-cased text, one over its classes of characters."""

    def __init__(self) -> None:
        self.words, self.runs = ahocorasick.Automaton(), ahocorasick.Automaton()
        for kind, (keywords, _, _) in _BY_KIND.items():
            for word in keywords:
                self.words.add_word(word, (kind, len(word)))
        self.runs.add_word("h" * HEX_LEAST, "hex")
        self.words.make_automaton()
        self.runs.make_automaton()

    def find(self, text: bytes) -> list[tuple[str, int, int]]:
        """(kind, start, end) in bytes, by start and then kind."""
        found: list[tuple[str, int, int]] = []
        past = dict.fromkeys(KINDS, 0)
        # No keyword of a kind lies within another of it, so a kind's hits come by their starts.
        for last, (kind, size) in self.words.iter(text.lower().decode("latin-1")):
            start = last - size + 1
            if start < past[kind]:
                continue
            _, expression, passes = _BY_KIND[kind]
            m = expression.match(text, start)
            if m:
                past[kind] = m.end()
                if passes(m):
                    found.append((kind, start, m.end()))
        end = 0
        for last, _ in self.runs.iter(text.translate(_HEX_CLASS).decode("latin-1")):
            if last >= end:  # the first hit in a run ends so many signs after the run's beginning
                start = last - HEX_LEAST + 1
                end = HEX.match(text, start).end()
                found.append(("hex", start, end))
        return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def code_points(text: bytes, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Byte offsets to code points; spans begin and end at ASCII characters."""
    if not spans or text.isascii():
        return spans
    seen, at, where = 0, 0, {}
    for x in sorted({i for _, a, b in spans for i in (a, b)}):
        seen += len(text[at:x].decode("utf-8", "surrogateescape"))
        at, where[x] = x, seen
    return [(k, where[a], where[b]) for k, a, b in spans]


def _scanned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for b in batches:
        found = [[{"kind": k, "start": s, "end": e} for k, s, e in code_points(t, scanner.find(t))] for t in as_bytes(b.column(1))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=["doc_id", "found"])


def scan(documents: DataFrame) -> DataFrame:
    """doc_id and ``found``: array of (kind, start, end), by start and then kind."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    return arrow_map(documents.select("doc_id", "text"), _scanned, f"doc_id {kind}, found array<struct<kind:string,start:bigint,end:bigint>>")


def op4(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    spelled = lambda a: F.concat_ws(",", F.transform(a, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))))
    base = F.filter("found", lambda x: x.kind.isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("found", lambda x: x.kind == kind)).cast("long")
    return scan(documents).select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(spelled(base).cast("binary"), 256).alias("base_sha256"), spelled(F.col("found")).alias("spans"),
    )


def brute_force(text: str) -> tuple[list[tuple[str, int, int]], str]:
    """The base spans by expressions over the whole text, and their digest; for tests."""
    found = [("assign", m.start(), m.end()) for m in re.finditer(ASSIGN.pattern.decode(), text, re.IGNORECASE | re.ASCII) if len(m[2]) >= ASSIGN_LEAST]
    found += [("access", m.start(), m.end()) for m in re.finditer(ACCESS.pattern.decode(), text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [("hex", m.start(), m.end()) for m in re.finditer(HEX.pattern.decode(), text) if m.end() - m.start() >= HEX_LEAST]
    found.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return found, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()
