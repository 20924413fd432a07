"""Scenario files through the engine: ``statement ok|error|count n`` and ``query types [rowsort|valuesort]`` with rows."""

from __future__ import annotations

import math
from pathlib import Path

import pytest

from lodestone.engine.session import Engine

FILES = sorted(Path(__file__).parent.glob("logic/*.test"))


def records(text):
    for block in text.split("\n\n"):
        lines = [x for x in block.strip().splitlines() if not x.startswith("#")]
        if lines:
            head, body = lines[0].split(), lines[1:]
            at = body.index("----") if "----" in body else len(body)
            yield head, "\n".join(body[:at]), body[at + 1 :]


def shown(value, kind):
    if value is None:
        return "NULL"
    if kind == "R":
        return float(value)
    return str(value) if kind == "T" else str(int(value))


def same(got, want):
    return len(got) == len(want) and all(math.isclose(a, float(b), rel_tol=1e-6) if isinstance(a, float) else a == b for a, b in zip(got, want, strict=True))


@pytest.mark.parametrize("path", FILES, ids=lambda p: p.stem)
def test_scenario(path, spark, tmp_path):
    engine, ran = Engine(spark, str(tmp_path / "warehouse")), 0
    for head, sql, rows in records(path.read_text()):
        ran += 1
        if head[:2] == ["statement", "error"]:
            with pytest.raises(Exception):  # noqa: B017, PT011
                found = engine.sql(sql)
                found.rows()
            continue
        result = engine.sql(sql)
        if head[0] == "statement":
            assert head[1] != "count" or result.rows_affected == int(head[2]), sql
            continue
        got = [[shown(v, k) for v, k in zip(r, head[1], strict=True)] for r in result.rows()]
        want = [x.split(" ") if len(head[1]) > 1 else [x] for x in rows]
        if "rowsort" in head:
            got, want = sorted(got, key=str), sorted(want, key=str)
        if "valuesort" in head:
            got, want = [[v] for v in sorted(v for r in got for v in r)], [[v] for v in sorted(v for r in want for v in r)]
        assert len(got) == len(want) and all(same(a, b) for a, b in zip(got, want, strict=True)), (sql, got, want)
    assert ran > 10
