"""Settings from a file of key=value lines and from the command line, which wins."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import dataclass, field, fields


@dataclass
class Config:
    """master and warehouse of a session, further Spark settings, and whether output is text or tab-separated."""

    master: str = "local[*]"
    warehouse: str = "lodestone-warehouse"
    separator: str = "|"
    conf: dict[str, str] = field(default_factory=dict)

    def apply(self, lines: Sequence[str]) -> Config:
        """key=value lines; # begins a comment. Keys that begin with spark. are Spark's; an unknown key is an error."""
        for line in lines:
            line = line.split("#", 1)[0].strip()
            if not line:
                continue
            key, mark, value = (x.strip() for x in line.partition("="))
            if not mark:
                raise ValueError(f"key=value expected, not {line}")
            if key.startswith("spark."):
                self.conf[key] = value
            elif key in {f.name for f in fields(self)} - {"conf"}:
                setattr(self, key, value)
            else:
                raise ValueError(f"unknown setting {key}")
        return self


def from_arguments(arguments: Sequence[str]) -> Config:
    parser = argparse.ArgumentParser(prog="python -m lodestone", description="Runs SQL statements from standard input.")
    parser.add_argument("--config", help="a file of key=value lines")
    parser.add_argument("--master")
    parser.add_argument("--warehouse")
    parser.add_argument("--separator")
    parser.add_argument("--conf", action="append", default=[], metavar="KEY=VALUE", help="a Spark setting")
    given = parser.parse_args(arguments)
    out = Config()
    if given.config:
        with open(given.config, encoding="utf-8") as f:
            out.apply(f.readlines())
    return out.apply([f"{k}={v}" for k in ("master", "warehouse", "separator") if (v := getattr(given, k)) is not None] + given.conf)
