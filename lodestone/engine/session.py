"""SQL sessions with transactions over immutable table versions.

Queries run as Spark SQL over the pinned version of each table. INSERT adds a Parquet folder; UPDATE and DELETE
write a new version of the table (copy on write). BEGIN pins all versions; statements then stage theirs, COMMIT
writes one manifest for all tables and fails if another commit changed a table that it wrote, ROLLBACK deletes
what was staged. Without BEGIN each statement is a transaction. NOT NULL is enforced, keys are declared only.
"""

from __future__ import annotations

import time
import uuid
from copy import deepcopy
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.engine import dialect, types
from lodestone.engine.catalog import Catalog, CommitConflict, MemoryCatalog
from lodestone.engine.dialect import Token


class EngineError(RuntimeError):
    """A statement that can't be run."""


@dataclass
class Result:
    df: DataFrame | None = None
    rows_affected: int = 0
    elapsed_us: int = 0

    def rows(self) -> list[tuple]:
        return [tuple(r) for r in self.df.collect()] if self.df is not None else []


@dataclass
class _Transaction:
    state: dict
    base: int
    written: set[str] = field(default_factory=set)
    staged: list[str] = field(default_factory=list)


def _take(parts: list[Token], *words: str) -> bool:
    """Removes the words from the front if they stand there."""
    if [p.upper for p in parts[: len(words)]] == list(words):
        del parts[: len(words)]
        return True
    return False


def _name(parts: list[Token]) -> str:
    if not parts or parts[0].kind == "sign":
        raise EngineError("a name is missing")
    t = parts.pop(0).text
    return t[1:-1].replace("``", "`") if t[:1] == "`" else t.strip('"')


def _closed(parts: list[Token]) -> list[Token]:
    """The tokens within the parentheses that stand at the front."""
    if not parts or parts.pop(0).text != "(":
        raise EngineError("( expected")
    depth, out = 1, []
    while parts:
        t = parts.pop(0)
        depth += (t.text == "(") - (t.text == ")")
        if depth == 0:
            return out
        out.append(t)
    raise EngineError(") expected")


def _listed(parts: list[Token]) -> list[list[Token]]:
    """Parts between commas outside of parentheses."""
    out, depth = [[]], 0
    for t in parts:
        depth += (t.text == "(") - (t.text == ")")
        if t.text == "," and depth == 0:
            out.append([])
        else:
            out[-1].append(t)
    return [x for x in out if x]


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _key(found: dict, name: str) -> str | None:
    """The name under which it is known; case doesn't matter."""
    return next((k for k in found if k.lower() == name.lower()), None)


class Engine:
    """A session. Without a warehouse it has only the tables that are attached to it."""

    def __init__(self, spark: SparkSession, warehouse: str | None = None) -> None:
        self.spark = spark
        self.catalog = Catalog(spark, warehouse) if warehouse else MemoryCatalog()
        self._open: _Transaction | None = None
        self._attached: dict[str, DataFrame] = {}

    # -------------------------------------------------------- statements

    def script(self, text: str) -> list[Result]:
        return [self.sql(s) for s in dialect.split(text)]

    def sql(self, text: str) -> Result:
        began = time.perf_counter()
        statements = dialect.split(text)
        if len(statements) != 1:
            raise EngineError("one statement expected")
        kind = dialect.classify(statements[0]).kind
        run = {
            "BEGIN": self._begin, "COMMIT": self._commit, "ROLLBACK": self._rollback, "CREATE TABLE": self._create_table, "DROP TABLE": self._drop_table,
            "CREATE INDEX": self._create_index, "DROP INDEX": self._drop_index, "INSERT": self._insert, "UPDATE": self._update, "DELETE": self._delete,
            "TRUNCATE": self._truncate, "ALTER": self._alter,
        }.get(kind)
        out = run(dialect.lex(statements[0]), statements[0]) if run else Result(self._query(statements[0]))
        out.elapsed_us = int(1e6 * (time.perf_counter() - began))
        return out

    def attach(self, name: str, df: DataFrame) -> None:
        """Makes a DataFrame a read-only table of this session."""
        self._attached[name] = df

    def register_function(self, name: str, function, returns: str | None = None) -> None:  # noqa: ANN001
        """A Python function, a pandas UDF or a UDTF, under a name for SQL; plain functions run over Arrow batches."""
        if hasattr(function, "evalType") and hasattr(function, "func") and not hasattr(function, "returnType"):
            self.spark.udtf.register(name, function)
        elif type(function).__name__ == "UserDefinedTableFunction":
            self.spark.udtf.register(name, function)
        elif hasattr(function, "returnType"):
            self.spark.udf.register(name, function)
        else:
            self.spark.udf.register(name, F.udf(function, returns or "string", useArrow=True))

    def _query(self, text: str, state: dict | None = None) -> DataFrame:
        """Runs a query over views that stand only while it is analyzed, so that no table outlives its state."""
        state = state or self._state()
        used = {t.text.strip('`"').lower() for t in dialect.lex(text) if t.kind in ("word", "name") or t.text[:1] == '"'}
        frames = {n: df for n, df in self._attached.items() if n.lower() in used}
        frames |= {n: self._read(state, n) for n in state["tables"] if n.lower() in used}
        known = {t.name.lower() for t in self.spark.catalog.listTables() if t.isTemporary} if frames else set()
        before = {n: self.spark.table(_quoted(n)) for n in frames if n.lower() in known}
        try:
            for n, df in frames.items():
                df.createOrReplaceTempView(_quoted(n))
            return self.spark.sql(dialect.rewrite(text))
        finally:
            for n in frames:
                self.spark.catalog.dropTempView(n)
            for n, df in before.items():
                df.createOrReplaceTempView(_quoted(n))

    # -------------------------------------------------------- the catalog

    def table(self, name: str) -> DataFrame:
        return self._attached[name] if name in self._attached else self._read(self._state(), name)

    def tables(self) -> list[str]:
        return sorted([*self._state()["tables"], *self._attached])

    def indexes(self, table: str | None = None) -> list[str]:
        return sorted(k for k, v in self._state()["indexes"].items() if table is None or v["table"].lower() == table.lower())

    def exists(self, name: str) -> bool:
        return _key(self._state()["tables"], name) is not None or _key(self._attached, name) is not None

    def version(self) -> int:
        return self._state()["version"]

    def statistics(self, name: str) -> dict:
        """oid, rows, files, times and columns of a table."""
        info = self._info(self._state(), name)
        return {k: info[k] for k in ("oid", "rows", "created", "modified")} | {"files": len(info["paths"]), "columns": T.StructType.fromJson(info["schema"]).simpleString()}

    def describe(self) -> str:
        """The catalog as text: a line for each table and index."""
        state = self._state()
        lines = [f"version {state['version']}"]
        for name, info in sorted(state["tables"].items()):
            lines.append(f"table {name} (oid {info['oid']}, {info['rows']} rows): {T.StructType.fromJson(info['schema']).simpleString()}")
        lines += [f"index {k} on {v['table']}({v['column']}){' unique' if v['unique'] else ''}" for k, v in sorted(state["indexes"].items())]
        return "\n".join(lines)

    def vacuum(self, keep: int = 1, older_than_s: float = 3600.0) -> list[str]:
        """Deletes data that no kept version names; what an open transaction has pinned or staged stays."""
        held = {p for t in self._open.state["tables"].values() for p in t["paths"]} | set(self._open.staged) if self._open else set()
        return self.catalog.vacuum(keep, older_than_s, frozenset(held))

    # -------------------------------------------------------- transactions

    def _state(self) -> dict:
        return self._open.state if self._open else self.catalog.load()

    def _begin(self, parts: list[Token], text: str) -> Result:
        if self._open:
            raise EngineError("transaction already in progress")
        state = self.catalog.load()
        self._open = _Transaction(state, state["version"])
        return Result()

    def _rollback(self, parts: list[Token], text: str) -> Result:
        if not self._open:
            raise EngineError("no transaction in progress")
        done, self._open = self._open, None
        for path in done.staged:
            self.catalog.delete(path)
        return Result()

    def _commit(self, parts: list[Token], text: str) -> Result:
        if not self._open:
            raise EngineError("no transaction in progress")
        done, self._open = self._open, None
        if done.written:
            try:
                self._publish(done)
            except CommitConflict:
                for path in done.staged:
                    self.catalog.delete(path)
                raise
        return Result()

    def _publish(self, done: _Transaction) -> None:
        """One manifest for all that was written; first committer wins, table by table."""
        kinds = ("tables", "indexes")
        before = self.catalog.load(done.base)
        while True:
            now = self.catalog.load()
            for key in done.written:
                kind, name = key.split(":", 1)
                if now[kind].get(name) != before[kind].get(name):
                    raise CommitConflict(f"{name} was changed by another transaction")
            merged = deepcopy(now)
            for key in done.written:
                kind, name = key.split(":", 1)
                assert kind in kinds
                if name in done.state[kind]:
                    merged[kind][name] = done.state[kind][name]
                else:
                    merged[kind].pop(name, None)
            merged["next_oid"] = max(now["next_oid"], done.state["next_oid"])
            try:
                self.catalog.store(merged, now["version"])
                return
            except CommitConflict:
                continue  # someone wrote other tables meanwhile; look again

    def _write(self, change) -> Result:  # noqa: ANN001
        """Runs change(transaction) in the open transaction, or in one of its own."""
        if self._open:
            return change(self._open)
        state = self.catalog.load()
        own = _Transaction(state, state["version"])
        try:
            out = change(own)
            if own.written:
                self._publish(own)
        except BaseException:
            for path in own.staged:
                self.catalog.delete(path)
            raise
        return out

    # -------------------------------------------------------- tables

    def _info(self, state: dict, name: str) -> dict:
        key = _key(state["tables"], name)
        if key is None:
            raise EngineError(f"table {name} does not exist")
        return state["tables"][key]

    def _read(self, state: dict, name: str) -> DataFrame:
        info = self._info(state, name)
        schema = T.StructType.fromJson(info["schema"])
        if not info["paths"]:
            return self.spark.createDataFrame([], T.StructType([T.StructField(f.name, f.dataType) for f in schema]))
        return self.spark.read.schema(schema).parquet(*info["paths"])

    def _stage(self, own: _Transaction, name: str, df: DataFrame, keep: bool) -> int:
        """Writes rows as a folder of the table's next version, laid out as its first index asks; their number.

        keep: beside the folders it has.
        """
        name = _key(own.state["tables"], name)
        info = self._info(own.state, name)
        schema = T.StructType.fromJson(info["schema"])
        rows = df.select(*[F.col(_quoted(f.name)).cast(f.dataType).alias(f.name) for f in schema])
        for f in schema:
            if not f.nullable:
                c = F.col(_quoted(f.name))
                rows = rows.withColumn(f.name, F.when(c.isNull(), F.raise_error(F.lit(f"null value in column {f.name} of {name}"))).otherwise(c))
        laid = next((v["column"] for _, v in sorted(own.state["indexes"].items()) if v["table"] == name), None)
        if laid:
            rows = rows.repartitionByRange(F.col(_quoted(laid))).sortWithinPartitions(_quoted(laid))
        path = self.catalog.data_path(name, uuid.uuid4().hex)
        own.staged.append(path)
        seen = Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        count = int(seen.get["rows"])
        before = info["rows"] if keep else 0
        own.state["tables"][name] = info | {"paths": [*(info["paths"] if keep else []), path], "rows": before + count, "modified": time.time()}
        own.written.add(f"tables:{name}")
        return count

    def _create_table(self, parts: list[Token], text: str) -> Result:
        del parts[:2]
        maybe = _take(parts, "IF", "NOT", "EXISTS")
        name = _name(parts)
        fields, keys = [], []
        for column in _listed(_closed(parts)):
            if column[0].upper in ("PRIMARY", "UNIQUE"):
                keys.append(" ".join(t.text for t in column))
                continue
            label, kind = _name(column), _name(column)
            arguments = [int(t.text) for t in _closed(column) if t.text.isdigit()] if column and column[0].text == "(" else []
            rules = " ".join(t.upper for t in column)
            keys += [f"{label} {r}" for r in ("PRIMARY KEY", "UNIQUE") if r in rules]
            fields.append(T.StructField(label, types.parse(kind, arguments), "NOT NULL" not in rules and "PRIMARY KEY" not in rules))

        def change(own: _Transaction) -> Result:
            if _key(own.state["tables"], name):
                if maybe:
                    return Result()
                raise EngineError(f"table {name} already exists")
            oid = own.state["next_oid"]
            own.state["next_oid"] = oid + 1
            own.state["tables"][name] = {"oid": oid, "schema": T.StructType(fields).jsonValue(), "paths": [], "rows": 0, "keys": keys, "created": time.time(), "modified": time.time()}
            own.written.add(f"tables:{name}")
            return Result(rows_affected=1)

        return self._write(change)

    def _drop_table(self, parts: list[Token], text: str) -> Result:
        del parts[:2]
        maybe = _take(parts, "IF", "EXISTS")
        name = _name(parts)

        def change(own: _Transaction) -> Result:
            key = _key(own.state["tables"], name)
            if maybe and key is None:
                return Result()
            self._info(own.state, name)
            del own.state["tables"][key]
            own.written.add(f"tables:{key}")
            for index in [k for k, v in own.state["indexes"].items() if v["table"] == key]:
                del own.state["indexes"][index]
                own.written.add(f"indexes:{index}")
            return Result(rows_affected=1)

        return self._write(change)

    def _create_index(self, parts: list[Token], text: str) -> Result:
        """Declares the index and lays the table out sorted by its column, so that row-group statistics prune."""
        parts.pop(0)
        unique = _take(parts, "UNIQUE")
        parts.pop(0)
        index = _name(parts)
        if not _take(parts, "ON"):
            raise EngineError("ON expected")
        name = _name(parts)
        column = _name(_closed(parts))

        def change(own: _Transaction) -> Result:
            if _key(own.state["indexes"], index):
                raise EngineError(f"index {index} already exists")
            df = self._read(own.state, name)
            found = _key(dict.fromkeys(df.columns), column)
            if found is None:
                raise EngineError(f"column {column} does not exist")
            own.state["indexes"][index] = {"table": _key(own.state["tables"], name), "column": found, "unique": unique}
            if self._info(own.state, name)["paths"]:
                self._stage(own, name, df, keep=False)
            own.written.add(f"indexes:{index}")
            return Result(rows_affected=1)

        return self._write(change)

    def _drop_index(self, parts: list[Token], text: str) -> Result:
        del parts[:2]
        maybe = _take(parts, "IF", "EXISTS")
        index = _name(parts)

        def change(own: _Transaction) -> Result:
            key = _key(own.state["indexes"], index)
            if key is None:
                if maybe:
                    return Result()
                raise EngineError(f"index {index} does not exist")
            del own.state["indexes"][key]
            own.written.add(f"indexes:{key}")
            return Result(rows_affected=1)

        return self._write(change)

    def _insert(self, parts: list[Token], text: str) -> Result:
        if not (_take(parts, "INSERT", "INTO")):
            raise EngineError("INSERT INTO expected")
        name = _name(parts)

        def change(own: _Transaction) -> Result:
            schema = T.StructType.fromJson(self._info(own.state, name)["schema"])
            names = dict.fromkeys(schema.names)
            rest = list(parts)
            given = [_name(c) for c in _listed(_closed(rest))] if rest and rest[0].text == "(" else schema.names
            columns = [_key(names, c) for c in given]
            if None in columns:
                raise EngineError(f"unknown column {given[columns.index(None)]}")
            if not rest:
                raise EngineError("VALUES or a query expected")
            source = text[rest[0].start :]
            rows = self._query(f"SELECT * FROM {source}" if rest[0].upper == "VALUES" else source, own.state)
            if len(rows.columns) != len(columns):
                raise EngineError(f"{len(columns)} values expected, {len(rows.columns)} given")
            rows = rows.toDF(*columns)
            rows = rows.select("*", *[F.lit(None).alias(c) for c in schema.names if c not in columns])
            return Result(rows_affected=self._stage(own, name, rows, keep=True))

        return self._write(change)

    def _marked(self, own: _Transaction, name: str, parts: list[Token], text: str) -> tuple[str, str]:
        """SQL for the table's rows with a column that tells which the WHERE hits, and that column's name."""
        if parts and parts[0].upper != "WHERE":
            raise EngineError(f"WHERE expected, not {parts[0].text}")
        if parts and len(parts) < 2:
            raise EngineError("a condition is missing")
        where = text[parts[1].start :] if parts else "true"
        hit = "hit"
        while _key(dict.fromkeys(T.StructType.fromJson(self._info(own.state, name)["schema"]).names), hit):
            hit += "_"
        return f"SELECT *, coalesce(({where}), false) AS {_quoted(hit)} FROM {_quoted(name)}", hit

    def _update(self, parts: list[Token], text: str) -> Result:
        """All right sides see the old row. One pass: rows are rewritten and hits counted together."""
        parts.pop(0)
        name = _name(parts)
        if not _take(parts, "SET"):
            raise EngineError("SET expected")
        depth, end = 0, len(parts)
        for i, t in enumerate(parts):
            depth += (t.text == "(") - (t.text == ")")
            if depth == 0 and t.upper == "WHERE":
                end = i
                break
        new: dict[str, str] = {}
        for p in _listed(parts[:end]):
            column = _name(p)
            if len(p) < 2 or p[0].text != "=":
                raise EngineError(f"= and a value expected for {column}")
            new[column] = text[p[1].start : p[-1].end]

        def change(own: _Transaction) -> Result:
            schema = T.StructType.fromJson(self._info(own.state, name)["schema"])
            names = dict.fromkeys(schema.names)
            if unknown := [c for c in new if _key(names, c) is None]:
                raise EngineError(f"unknown column {unknown[0]}")
            given = {_key(names, c): e for c, e in new.items()}
            marked, hit = self._marked(own, name, parts[end:], text)
            columns = [f"CASE WHEN {_quoted(hit)} THEN CAST(({given[f.name]}) AS {f.dataType.simpleString()}) ELSE {_quoted(f.name)} END AS {_quoted(f.name)}" if f.name in given else _quoted(f.name) for f in schema]
            df = self._query(f"SELECT {', '.join(columns)}, {_quoted(hit)} FROM ({marked}) AS {_quoted(name)}", own.state)
            return Result(rows_affected=self._rewritten(own, name, df, hit, keep_hit=True))

        return self._write(change)

    def _delete(self, parts: list[Token], text: str) -> Result:
        if not _take(parts, "DELETE", "FROM"):
            raise EngineError("DELETE FROM expected")
        name = _name(parts)

        def change(own: _Transaction) -> Result:
            marked, hit = self._marked(own, name, parts, text)
            return Result(rows_affected=self._rewritten(own, name, self._query(marked, own.state), hit, keep_hit=False))

        return self._write(change)

    def _rewritten(self, own: _Transaction, name: str, df: DataFrame, hit: str, keep_hit: bool) -> int:
        """Stages the rows, with or without those that are hit; where none is, the table stays as it was."""
        seen = Observation()
        rows = df.observe(seen, F.count_if(F.col(_quoted(hit))).alias("hits"))
        key = _key(own.state["tables"], name)
        before, written = own.state["tables"][key], f"tables:{key}" in own.written
        if not before["paths"]:
            return 0
        self._stage(own, key, rows if keep_hit else rows.where(~F.col(_quoted(hit))), keep=False)
        hits = int(seen.get["hits"])
        if not hits:
            self.catalog.delete(own.staged.pop())
            own.state["tables"][key] = before
            if not written:
                own.written.discard(f"tables:{key}")
        return hits

    def _truncate(self, parts: list[Token], text: str) -> Result:
        parts.pop(0)
        _take(parts, "TABLE")
        name = _name(parts)

        def change(own: _Transaction) -> Result:
            info, key = self._info(own.state, name), _key(own.state["tables"], name)
            own.state["tables"][key] = info | {"paths": [], "rows": 0, "modified": time.time()}
            own.written.add(f"tables:{key}")
            return Result(rows_affected=info["rows"])

        return self._write(change)

    def _alter(self, parts: list[Token], text: str) -> Result:
        """ADD COLUMN, DROP COLUMN, RENAME COLUMN a TO b, RENAME TO t. A new column is null in the rows that are there."""
        if not _take(parts, "ALTER", "TABLE"):
            raise EngineError("ALTER TABLE expected")
        name = _name(parts)

        def change(own: _Transaction) -> Result:
            rest = list(parts)
            info, key = self._info(own.state, name), _key(own.state["tables"], name)
            schema = T.StructType.fromJson(info["schema"])
            names = dict.fromkeys(schema.names)
            found = lambda c: _key(names, c) or _missing(c)
            own.written.add(f"tables:{key}")
            if _take(rest, "RENAME", "TO"):
                to = _name(rest)
                if _key(own.state["tables"], to):
                    raise EngineError(f"table {to} already exists")
                own.state["tables"][to] = own.state["tables"].pop(key)
                own.written.add(f"tables:{to}")
                for index, v in own.state["indexes"].items():
                    if v["table"] == key:
                        v["table"] = to
                        own.written.add(f"indexes:{index}")
                return Result(rows_affected=1)
            if _take(rest, "ADD"):
                _take(rest, "COLUMN")
                label, kind = _name(rest), _name(rest)
                if _key(names, label):
                    raise EngineError(f"column {label} already exists")
                arguments = [int(t.text) for t in _closed(rest) if t.text.isdigit()] if rest and rest[0].text == "(" else []
                own.state["tables"][key] = info | {"schema": schema.add(label, types.parse(kind, arguments)).jsonValue(), "modified": time.time()}
                return Result(rows_affected=1)
            if _take(rest, "DROP"):
                _take(rest, "COLUMN")
                old, to = found(_name(rest)), None
            elif _take(rest, "RENAME", "COLUMN"):
                old = found(_name(rest))
                if not _take(rest, "TO"):
                    raise EngineError("TO expected")
                to = _name(rest)
                if _key(names, to):
                    raise EngineError(f"column {to} already exists")
            else:
                raise EngineError("ADD, DROP or RENAME expected")
            df = self._read(own.state, key)
            for index in [k for k, v in own.state["indexes"].items() if v["table"] == key and v["column"] == old]:
                if to is None:
                    del own.state["indexes"][index]
                else:
                    own.state["indexes"][index]["column"] = to
                own.written.add(f"indexes:{index}")
            kept = [T.StructField(to if f.name == old else f.name, f.dataType, f.nullable) for f in schema if to is not None or f.name != old]
            if not kept:
                raise EngineError("a table must have a column")
            own.state["tables"][key] = info | {"schema": T.StructType(kept).jsonValue(), "modified": time.time()}
            if info["paths"]:
                self._stage(own, key, df.drop(old) if to is None else df.withColumnRenamed(old, to), keep=False)
            return Result(rows_affected=1)

        return self._write(change)


def _missing(column: str) -> str:
    raise EngineError(f"column {column} does not exist")
