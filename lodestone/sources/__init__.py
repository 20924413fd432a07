"""Columnar tables, read and appended in batches, tables dealt into shards by a key's hash, and files of other formats."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.functions import djb2_of, lenient, shard_of

BATCH_ROWS = 1024


class ColumnarTable:
    """A Parquet table with an append-only batch interface."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType) -> None:
        self.spark, self.path, self.schema = spark, path, schema

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType) -> ColumnarTable:
        spark.createDataFrame([], schema).write.mode("errorifexists").parquet(path)
        return cls(spark, path, schema)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> ColumnarTable:
        return cls(spark, path, spark.read.parquet(path).schema)

    def append_batch(self, rows: Sequence[tuple] | DataFrame) -> None:
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(list(rows), self.schema)
        df.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).write.mode("append").parquet(self.path)

    def scan(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def row_count(self) -> int:
        return self.scan().count()

    def map_batches(self, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """Batch-level access for what expressions can't say; batches have BATCH_ROWS rows at most."""
        return self.scan().mapInArrow(_Sliced(function), schema)


class _Sliced:
    def __init__(self, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> None:
        self.function = function

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return self.function(b.slice(at, BATCH_ROWS) for b in batches for at in range(0, max(1, b.num_rows), BATCH_ROWS))


def vectorized_pipeline(df: DataFrame, where: Column | str | None = None, project: Sequence[Column | str] | None = None, aggregate: Sequence[Column] | None = None) -> DataFrame:
    """Scan, filter, then project or aggregate over all rows, in whole-stage code over columnar batches."""
    out = df.where(where) if where is not None else df
    if aggregate:
        return out.agg(*aggregate)
    return out.select(*project) if project else out


SHARD = "__shard"


def write_sharded(df: DataFrame, path: str, key: str, shards: int) -> None:
    """One directory for each shard. Rows are rebalanced by shard first: few files, and a large shard is split over tasks."""
    df.withColumn(SHARD, shard_of(F.col(key), shards)).hint("rebalance", SHARD).write.partitionBy(SHARD).mode("overwrite").parquet(path)


def read_sharded(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def shard_lookup(spark: SparkSession, path: str, key: str, value: object, shards: int) -> DataFrame:
    """Rows of one key; the derived shard predicate prunes all other directories."""
    shard = djb2_of(value) % shards
    return spark.read.parquet(path).where((F.col(SHARD) == shard) & (F.col(key) == F.lit(value))).drop(SHARD)


#: Formats that are read and written as files, with the options that make a round trip exact.
FORMATS = {
    "parquet": {}, "orc": {}, "json": {"ignoreNullFields": "false"}, "csv": {"header": "true", "nullValue": "\\N", "escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"},
}


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: StructType | None = None, compat: bool = False, **options: str) -> DataFrame:
    """Files of a format. Text formats need a schema; compat: values that don't fit it are null instead of an error."""
    reader = spark.read.options(**{**FORMATS[kind], **options})
    if kind in ("csv", "json"):
        if schema is None:
            raise ValueError(f"{kind} needs a schema")
        if compat:
            text = ", ".join(f"`{f.name}` string" for f in schema)
            return lenient(reader.schema(text).format(kind).load(path), schema)
        return reader.schema(schema).option("mode", "FAILFAST").format(kind).load(path)
    return (reader.schema(schema) if schema is not None else reader).format(kind).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", **options: str) -> None:
    df.write.options(**{**FORMATS[kind], **options}).format(kind).mode(mode).save(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **properties: str) -> DataFrame:
    """A table of another database, in ``parts`` ranges of a numeric column; needs that database's driver on the class path."""
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=properties)
