"""Personal data: base expressions, and a character-level bidirectional LSTM with CRF transitions.

The network is written and trained in numpy, from labelled spans that a seeded generator sets into invented
prose: the base kinds and spellings of them that the expressions miss (numbers without a plus, addresses with
spaces), beside look-alikes that are no personal data. Characters around digits and at-signs, and the whole name and
host beside an at-sign, are covered by overlapping windows; every span that is accepted holds one of these, so
nothing else can hold a span, and one of an address is widened to the whole of its name and host. Windows
are decoded by Viterbi, each position takes its tag from the window whose middle is nearest, and the document's
tag sequence is read into spans. Spans of the network stand where they pass their kind's check (digits, Luhn,
octets, at-sign) and touch no base span.

Null texts count as empty; repeated rows give a row each; an empty table gives an empty result. ``op7`` leaves out
columns besides doc_id and text, whatever their names; ``mask`` gives back all columns, with text and n_chars to match.
A text of any length is one string in memory with two bytes beside it for each character; its windows are tagged some
thousand at a time. Where two windows' middles are equally near, the earlier window's tag stands. One pass, no shuffle.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_map, as_bytes

KINDS = ("email", "ip", "card", "phone")
#: Tags: 0 is outside; 2k+1 begins and 2k+2 continues kind k.
TAGS = 2 * len(KINDS) + 1
#: Width of a window, distance of windows, and characters around a digit or at-sign that are covered.
WINDOW, STRIDE, MARGIN = 64, 32, 24
HIDDEN, STEPS, BATCH, SEED = 16, 240, 64, 11
#: Windows that are tagged together.
TAGGED = 2048
#: Labelled windows that training draws its batches from.
LABELLED = 4000

_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(rb"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(rb"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_HOST_RUN, _HOST = re.compile(r"\s*[A-Za-z0-9.-]*"), re.compile(r"\s*[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def luhn(digits: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = (c - 48) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def digits_of(text: bytes) -> bytes:
    return bytes(c for c in text if 48 <= c <= 57)


def good_ip(text: bytes) -> bool:
    parts = text.split(b".")
    return len(parts) == 4 and all(p.isdigit() and len(p.lstrip(b"0")) <= 3 and int(p) <= 255 for p in parts)


def good_card(text: bytes) -> bool:
    d = digits_of(text)
    return 13 <= len(d) <= 19 and luhn(d)


def base_spans(text: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes, by kind and then start."""
    found: list[tuple[str, int, int]] = []
    past, at = 0, text.find(b"@")
    while at >= 0:  # a match begins where the run of signs before its at-sign begins, so each at-sign is looked at once
        start = at
        while start > past and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append(("email", start, m.end()))
            past = m.end()
        at = text.find(b"@", max(at + 1, past))
    found += [("ip", *m.span()) for m in _IP.finditer(text) if good_ip(m[0])]
    found += [("card", *m.span()) for m in _CARD.finditer(text) if good_card(m[0])]
    found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return found


# ---------------------------------------------------------------- labelled spans


def _prose(r: Random) -> str:
    return "".join(r.choices(("an", "er", "the", "ion", "st", "ou", "de", "que", "ver", "sch", "la", "é", "ö", "lo", "in", "ta", "re", "mi"), k=r.randint(1, 4)))


def _number(r: Random, n: int) -> str:
    return "".join(r.choices("0123456789", k=n))


def _card(r: Random) -> str:
    body = "4" + _number(r, 14)
    body += next(d for d in "0123456789" if luhn((body + d).encode()))
    sep = r.choice(["", "", " ", "-"])
    return sep.join(body[i : i + 4] for i in range(0, 16, 4))


def _phone(r: Random) -> str:
    a, b, c = _number(r, 3), _number(r, 3), _number(r, 4)
    return r.choice(["+1 ({0}) {1}-{2}", "+{0} {1} {2}", "+44 {0} {1} {2}", "({0}) {1}-{2}", "{0}-{1}-{2}", "001 {0} {1} {2}"]).format(a, b, c)


def _mail(r: Random) -> str:
    name = _prose(r).replace("é", "e").replace("ö", "o") + r.choice(["", "." + _number(r, 2), "_" + _number(r, 3)])
    host = f"mail{_number(r, 1)}.example." + r.choice(["com", "org", "net"])
    return name + r.choice(["@", "@", "@", " @ ", "@ "]) + host


def _address(r: Random) -> str:
    return ".".join(str(r.randint(1, 255)) for _ in range(4))


def _noise(r: Random) -> str:
    hexes = "".join(r.choices("0123456789abcdef", k=r.randint(12, 39)))
    return r.choice([
        _number(r, r.randint(1, 6)), f"{_number(r, 1)}.{_number(r, 1)}.", f"v{_number(r, 1)}.{_number(r, 2)}.{_number(r, 1)}", hexes,
        f"password={hexes[:18]}", f'token = "{hexes}"', "AKIA" + hexes[:16].upper(), f"{_number(r, 4)}-{_number(r, 2)}-{_number(r, 2)}", f"${_number(r, 3)}.{_number(r, 2)}", f"@{_prose(r)}",
    ])


def labelled(r: Random) -> tuple[str, list[int]]:
    """A window of invented prose with labelled spans."""
    text, tags = "", []
    while len(text) < WINDOW + 16:
        kind = r.randrange(9)
        if kind < 4:
            word = (_mail, _address, _card, _phone)[kind](r)
            own = [2 * kind + 1] + [2 * kind + 2] * (len(word) - 1)
        else:
            word = _noise(r) if kind == 4 else _prose(r) + r.choice(["", "", ".", ","])
            own = [0] * len(word)
        text, tags = text + word + r.choice([" ", " ", " ", "\n"]), [*tags, *own, 0]
    cut = r.randrange(16)
    return text[cut : cut + WINDOW], tags[cut : cut + WINDOW]


def codes(text: str) -> np.ndarray:
    """Characters as 0 to 127; letters and signs beyond ASCII are one code."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(raw < 127, raw, 127).astype(np.int64)


# ---------------------------------------------------------------- the network


def _sig(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _run(x: np.ndarray, table: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (T, B, H) of one direction over codes (B, T); the table holds each code's share of the gates."""
    b, t = x.shape
    n = u.shape[0]
    h, c = np.zeros((b, n), table.dtype), np.zeros((b, n), table.dtype)
    out = np.empty((t, b, n), table.dtype)
    for k in range(t):
        z = table[x[:, k]] + h @ u
        ifo, g = _sig(z[:, : 3 * n]), np.tanh(z[:, 3 * n :])
        before = c
        c = ifo[:, n : 2 * n] * c + ifo[:, :n] * g
        tc = np.tanh(c)
        if keep is not None:
            keep.append((h, before, ifo, g, tc))
        h = ifo[:, 2 * n :] * tc
        out[k] = h
    return out


def _back(x: np.ndarray, u: np.ndarray, kept: list, grad: np.ndarray, codes_: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the table and of u, from those of the hidden states."""
    n = u.shape[0]
    d_table, d_u = np.zeros((codes_, 4 * n), u.dtype), np.zeros_like(u)
    dh, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
    for k in range(len(kept) - 1, -1, -1):
        h, before, ifo, g, tc = kept[k]
        i, f, o = ifo[:, :n], ifo[:, n : 2 * n], ifo[:, 2 * n :]
        dh = dh + grad[k]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.hstack([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)])
        np.add.at(d_table, x[:, k], dz)
        d_u += h.T @ dz
        dh, dc = dz @ u.T, dc * f
    return d_table, d_u


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


@dataclass
class Tagger:
    """Weights by name: tables and recurrences of both directions, output, CRF transitions."""

    w: dict[str, np.ndarray]

    def emissions(self, x: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        w = self.w
        a = _run(x, w["fx"], w["fu"], keep and keep[0])
        b = _run(x[:, ::-1], w["bx"], w["bu"], keep and keep[1])[::-1]
        h = np.concatenate([a, b], 2)
        return h @ w["o"] + w["ob"], h

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tags (B, T) of windows of codes (B, T)."""
        e, trans = self.emissions(x)[0], self.w["t"]
        score, back = e[0] + self.w["s"], []
        for k in range(1, len(e)):
            every = score[:, :, None] + trans
            back.append(every.argmax(1))
            score = every.max(1) + e[k]
        tags = np.empty(x.shape, np.int8)
        tags[:, -1] = at = score.argmax(1)
        for k in range(len(back) - 1, -1, -1):
            at = back[k][np.arange(len(x)), at]
            tags[:, k] = at
        return tags

    def loss_and_gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        w, keep = self.w, ([], [])
        e, h = self.emissions(x, keep)
        t, b, k = e.shape
        rows, trans = np.arange(b), w["t"]
        alpha = [e[0] + w["s"]]
        for i in range(1, t):
            alpha.append(_lse(alpha[-1][:, :, None] + trans, 1) + e[i])
        beta = [np.zeros((b, k), e.dtype)]
        for i in range(t - 1, 0, -1):
            beta.append(_lse(trans[None] + (e[i] + beta[-1])[:, None, :], 2))
        beta.reverse()
        z = _lse(alpha[-1], 1)
        gold = w["s"][y[:, 0]] + sum(e[i, rows, y[:, i]] for i in range(t)) + sum(trans[y[:, i - 1], y[:, i]] for i in range(1, t))
        de = np.exp(np.stack(alpha) + np.stack(beta) - z[None, :, None])
        for i in range(t):
            de[i, rows, y[:, i]] -= 1
        d_t = np.zeros_like(trans)
        for i in range(1, t):
            d_t += np.exp(alpha[i - 1][:, :, None] + trans + (e[i] + beta[i])[:, None, :] - z[:, None, None]).sum(0)
            np.add.at(d_t, (y[:, i - 1], y[:, i]), -1)
        de /= b
        dh = de @ w["o"].T
        n = w["fu"].shape[0]
        fx, fu = _back(x, w["fu"], keep[0], dh[:, :, :n], len(w["fx"]))
        bx, bu = _back(x[:, ::-1], w["bu"], keep[1], dh[::-1, :, n:], len(w["bx"]))
        return float((z - gold).mean()), {
            "fx": fx, "fu": fu, "bx": bx, "bu": bu, "o": np.tensordot(h, de, ([0, 1], [0, 1])), "ob": de.sum((0, 1)), "s": de[0].sum(0), "t": d_t / b,
        }


@lru_cache(maxsize=4)
def train(hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, seed: int = SEED) -> Tagger:
    """Adam over generated windows; the same arguments give the same weights."""
    r = np.random.default_rng(seed)
    init = lambda *shape, scale: r.normal(0, scale, shape).astype(np.float32)
    w = {
        "fx": init(128, 4 * hidden, scale=0.3), "fu": init(hidden, 4 * hidden, scale=0.25), "bx": init(128, 4 * hidden, scale=0.3), "bu": init(hidden, 4 * hidden, scale=0.25),
        "o": init(2 * hidden, TAGS, scale=0.2), "ob": np.zeros(TAGS, np.float32), "s": np.zeros(TAGS, np.float32), "t": np.zeros((TAGS, TAGS), np.float32),
    }
    for k in range(1, TAGS):  # a kind is continued only after itself
        if k % 2 == 0:
            w["t"][[j for j in range(TAGS) if j not in (k, k - 1)], k] = -6
            w["s"][k] = -1
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    tagger, own = Tagger(w), Random(seed)
    pool = [labelled(own) for _ in range(LABELLED)]
    xs, ys = np.stack([codes(t) for t, _ in pool]), np.array([y for _, y in pool])
    for step in range(1, steps + 1):
        some = r.integers(0, LABELLED, batch)
        _, grad = tagger.loss_and_gradients(xs[some], ys[some])
        norm = float(np.sqrt(sum((g * g).sum() for g in grad.values())))
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grad.items():
            g = g * min(1.0, 5.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.98 * v[k] + 0.02 * g * g
            w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.98**step)) + 1e-6)).astype(np.float32)
    return tagger


def _name_start(text: str, at: int, least: int = 0) -> int:
    """Where the run of a name's characters that ends before ``at`` begins."""
    while at > least and text[at - 1].isascii() and ord(text[at - 1]) in _LOCAL:
        at -= 1
    return at


def windows_of(text: str) -> list[tuple[int, int]]:
    """(start, end) of the overlapping windows around digits and at-signs, and the names and hosts beside these."""
    regions: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if m[0] == "@":
            at = m.start()
            while at and text[at - 1].isspace():
                at -= 1
            a, b = min(a, _name_start(text, at)), max(b, _HOST_RUN.match(text, m.end()).end())
        while regions and a <= regions[-1][1]:
            p, q = regions.pop()
            a, b = min(a, p), max(b, q)
        regions.append([a, b])
    return [(i, min(i + WINDOW, b)) for a, b in regions for i in range(a, max(a + 1, b - STRIDE), STRIDE)]


def spans_of(tags: np.ndarray) -> list[tuple[str, int, int]]:
    """Spans of a document's tags by position; where no window reaches the tag is 0."""
    found, kind, start, last = [], -1, 0, -2
    for at in [*np.flatnonzero(tags).tolist(), -9]:
        tag = int(tags[at]) if at >= 0 else 0
        here = (tag - 1) // 2 if tag else -1
        if kind >= 0 and (here != kind or tag % 2 == 1 or at != last + 1):
            found.append((KINDS[kind], start, last + 1))
            kind = -1
        if here >= 0 and kind < 0:
            kind, start = here, at
        last = at
    return found


class _Taken:
    """The base spans of a text; ``end_before(b)`` is how far those that begin before ``b`` reach."""

    def __init__(self, spans: Iterable[tuple[str, int, int]]) -> None:
        found = sorted((a, b) for _, a, b in spans)
        self.starts, self.reach = [a for a, _ in found], list(accumulate((b for _, b in found), max))

    def end_before(self, b: int) -> int:
        k = bisect_left(self.starts, b)
        return self.reach[k - 1] if k else 0

    def next_start(self, b: int, last: int) -> int:
        k = bisect_left(self.starts, b)
        return self.starts[k] if k < len(self.starts) else last


def widened(text: str, a: int, b: int, taken: _Taken) -> tuple[int, int]:
    """A span of an address up to the ends of its name and host, or to the base spans beside it."""
    at = text.find("@", a, b)
    if at < 0 or taken.end_before(b) > a:
        return a, b
    host = _HOST.match(text, at + 1)
    return _name_start(text, a, taken.end_before(b)), max(b, min(taken.next_start(b, len(text)), host.end())) if host else b


def accepted(kind: str, text: str) -> bool:
    """A span of the network passes its kind's check."""
    raw = text.encode()
    n = len(digits_of(raw))
    if kind == "email":
        name, _, host = (x.strip() for x in text.partition("@"))
        return bool(name and _DOMAIN.fullmatch(host.encode())) and not re.search(r"\s", name)
    if kind == "ip":
        return good_ip(raw)
    if kind == "card":
        return good_card(raw)
    return 9 <= n <= 15 and text[-1].isdigit() and not re.search(r"[^0-9() +.\-]", text) and not re.fullmatch(r"[0-9]+", text)


def _tagged(held: list[tuple[str, list[tuple[int, int]]]], tagger: Tagger) -> list[np.ndarray]:
    """The tags of each text by position, each from the window whose middle is nearest."""
    tags = [np.zeros(len(text), np.int8) for text, _ in held]
    nearest = [np.full(len(text), WINDOW, np.uint8) for text, _ in held]  # twice the distance from that window's middle
    every = [(i, a, b) for i, (_, found) in enumerate(held) for a, b in found]
    for k in range(0, len(every), TAGGED):
        some = every[k : k + TAGGED]
        x = np.full((len(some), WINDOW), 32, np.int64)
        for j, (i, a, b) in enumerate(some):
            x[j, : b - a] = codes(held[i][0][a:b])
        for (i, a, b), row in zip(some, tagger.decode(x), strict=True):
            far = np.abs(2 * np.arange(b - a) - (b - a - 1)).astype(np.uint8)
            better = far < nearest[i][a:b]
            nearest[i][a:b][better] = far[better]
            tags[i][a:b][better] = row[: b - a][better]
    return tags


def detect(texts: list[bytes], tagger: Tagger) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """For each text: base spans, and those that the network adds; code points, by kind and then start."""
    out: list[tuple[list, list]] = []
    held: list[tuple[str, list[tuple[int, int]]]] = []
    owner: list[int] = []
    for i, raw in enumerate(texts):
        base = base_spans(raw)
        if base and not raw.isascii():
            where = code_point_of(raw, {x for _, a, b in base for x in (a, b)})
            base = [(k, where[a], where[b]) for k, a, b in base]
        out.append((base, []))
        text = raw.decode(errors="replace")
        if found := windows_of(text):
            held.append((text, found))
            owner.append(i)
    for i, (text, _), tags in zip(owner, held, _tagged(held, tagger), strict=True):
        taken = _Taken(out[i][0])
        for kind, a, b in spans_of(tags):
            while a < b and text[a].isspace():
                a += 1
            while a < b and text[b - 1].isspace():
                b -= 1
            if kind == "email":
                a, b = widened(text, a, b, taken)
            if a < b and accepted(kind, text[a:b]) and taken.end_before(b) <= a:
                out[i][1].append((kind, a, b))
        out[i][1].sort(key=lambda s: (KINDS.index(s[0]), s[1]))
    return out


def code_point_of(raw: bytes, ends: set[int]) -> dict[int, int]:
    """Byte offsets at which a character begins, as code points, in one pass over the text."""
    seen, at, where = 0, 0, {}
    for x in sorted(ends):
        seen += len(raw[at:x].decode(errors="replace"))
        at, where[x] = x, seen
    return where


class _Found:
    def __init__(self, tagger: Tagger) -> None:
        self.tagger = tagger

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        row = lambda found: [{"kind": k, "start": a, "end": b} for k, a, b in found]
        for b in batches:
            found = detect(as_bytes(b.column(1)), self.tagger)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([row(x) for x, _ in found], span), pa.array([row(x) for _, x in found], span)], names=["doc_id", "base", "added"])


def find(documents: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """doc_id, base and added: arrays of (kind, start, end) in code points."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return arrow_map(documents.select("doc_id", "text"), _Found(tagger or train()), f"doc_id {kind}, base {spans}, added {spans}")


def op7(documents: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all)."""
    spelled = lambda a: F.concat_ws(",", F.transform(a, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))))
    of = lambda spans, kind: F.filter(spans, lambda x: x.kind == kind)
    ordered = F.flatten(F.array(*[F.array_sort(of(F.concat("base", "added"), k)) for k in KINDS]))  # within a kind structs sort by start
    return find(documents, tagger).select(
        "doc_id", *[F.size(of(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(spelled(F.col("base")).cast("binary"), 256).alias("base_sha256"), spelled(ordered).alias("spans"),
    )


class _Masked:
    def __init__(self, tagger: Tagger) -> None:
        self.tagger = tagger

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            at = names.index("text")
            texts, cols = b.column(at).to_pylist(), list(b.columns)
            lengths = b.column(names.index("n_chars")).to_pylist() if "n_chars" in names else None
            for i, (base, added) in enumerate(detect(as_bytes(b.column(at)), self.tagger)):
                if base or added:
                    texts[i] = masked(texts[i], [*base, *added])
                    if lengths is not None:
                        lengths[i] = len(texts[i])
            cols[at] = pa.array(texts, pa.string())
            if lengths is not None:
                cols[names.index("n_chars")] = pa.array(lengths, b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(cols, names=names)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span becomes its kind in brackets; spans that overlap become one, named after the first."""
    joined: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if joined and a < joined[-1][2]:
            joined[-1][2] = max(joined[-1][2], b)
        else:
            joined.append([kind, a, b])
    out, at = [], 0
    for kind, a, b in joined:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def mask(documents: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """``documents`` with personal data in text masked and n_chars to match; clean rows are left as they are."""
    return arrow_map(documents, _Masked(tagger or train()), documents.schema)


def brute_force(text: str) -> tuple[list[tuple[str, int, int]], str]:
    """Base spans by plain expressions over the whole text, and their digest; for tests."""
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, good in (("card", r"[0-9]([\x20-]?[0-9])+", good_card), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(digits_of(x)) <= 15)):
        found += [(kind, *m.span()) for m in re.finditer(pattern, text) if good(m[0].encode())]
    return found, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()
