"""Relational operators as thin builders over DataFrames; Catalyst plans and runs them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Estimated bytes up to which a join side may be broadcast.
BROADCAST_BYTES = 64 << 20


def seq_scan(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """All rows of a Parquet table; columns and filters are pushed into the scan."""
    df = spark.read.parquet(path)
    return df.alias(table) if table else df


def buffer_scan(spark: SparkSession, rows: Sequence[tuple], schema: StructType | str) -> DataFrame:
    """Rows held in memory."""
    return spark.createDataFrame(list(rows), schema)


def index_scan(df: DataFrame, column: str, key: object) -> DataFrame:
    """Point lookup: a filter that reaches the Parquet scan with row-group statistics."""
    return df.where(F.col(column) == F.lit(key))


def filter_rows(df: DataFrame, condition: Column | str) -> DataFrame:
    return df.where(condition)


def project(df: DataFrame, *columns: Column | str) -> DataFrame:
    return df.select(*columns)


def sort(df: DataFrame, keys: Sequence[str | Column], ascending: Sequence[bool] | None = None) -> DataFrame:
    """Null counts as the greatest value: last ascending, first descending."""
    rising = ascending or [True] * len(keys)
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return df.orderBy(*[c.asc_nulls_last() if up else c.desc_nulls_first() for c, up in zip(cols, rising, strict=True)])


@dataclass(frozen=True)
class Aggregate:
    """One aggregate: count, sum, min, max or avg, of a column or (count) of all rows, optionally distinct."""

    function: str
    column: str | None
    name: str
    distinct: bool = False

    def expression(self, compat: bool = False) -> Column:
        c = F.col(self.column) if self.column else F.lit(1)
        match self.function.lower(), self.distinct:
            case "count", False:
                out = F.count(c)
            case "count", True:
                out = F.countDistinct(c)
            case "sum", distinct:
                c = c.cast("double")
                out = F.sum_distinct(c) if distinct else F.sum(c)
                out = F.coalesce(out, F.lit(0.0)) if compat else out
            case "avg", distinct:
                out = F.sum_distinct(c.cast("double")) / F.countDistinct(c) if distinct else F.avg(c)
            case "min", _:
                out = F.min(c)
            case "max", _:
                out = F.max(c)
            case other, _:
                raise ValueError(f"no aggregate named {other}")
        return out.alias(self.name)


def aggregate(df: DataFrame, keys: Sequence[str | Column], aggregates: Sequence[Aggregate], having: Column | str | None = None, compat: bool = False) -> DataFrame:
    """Grouped or, without keys, global. compat: the sum of nothing is 0.0 instead of null."""
    out = df.groupBy(*keys).agg(*[a.expression(compat) for a in aggregates])
    return out.where(having) if having is not None else out


def hash_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, kind: str = "inner", null_safe: bool = False, strategy: str | None = None) -> DataFrame:
    """Equi-join. strategy: broadcast (only where the right side's estimated size is within BROADCAST_BYTES), shuffle, or Spark's own."""
    if strategy == "broadcast":
        small = int(str(right._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= BROADCAST_BYTES  # noqa: SLF001
        right = F.broadcast(right) if small else right.hint("shuffle_hash")
    elif strategy == "shuffle":
        right = right.hint("merge")
    a, b = left[left_key], right[right_key]
    return left.join(right, a.eqNullSafe(b) if null_safe else a == b, kind)


def limit(df: DataFrame, count: int | None = None, offset: int = 0) -> DataFrame:
    """A negative count is no limit, a negative offset none."""
    out = df.offset(offset) if offset > 0 else df
    return out if count is None or count < 0 else out.limit(count)


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def semi_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, anti: bool = False) -> DataFrame:
    """Rows of the left side that have a partner, or none."""
    return left.join(right, left[left_key] == right[right_key], "left_anti" if anti else "left_semi")


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, values: Sequence[str], prefix: str = "last_") -> DataFrame:
    """Each left row with the values of the latest right row of its key at its time or before; null where there is none.

    Both sides in one sorted pass over each key: one shuffle, and no pairs. Of right rows at one time the one with the
    greatest values counts. Left rows with a null key or time get nulls.
    """
    side, held = "asof_side", "asof_values"
    both = left.withColumns({side: F.lit(1), held: F.lit(None).cast(right.select(F.struct(*values).alias("v")).schema["v"].dataType)}).unionByName(
        right.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, time, F.lit(0).alias(side), F.struct(*values).alias(held)), allowMissingColumns=True
    )
    upto = Window.partitionBy(key).orderBy(F.col(time).asc_nulls_first(), side, held).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = F.when(F.col(key).isNotNull(), F.last(held, ignorenulls=True).over(upto))
    return both.withColumn(held, latest).where(F.col(side) == 1).select(*left.columns, *[F.col(f"{held}.{v}").alias(prefix + v) for v in values])


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= point < high, by bins of ``width``: an interval is copied to each bin it meets, a point to its own."""
    bin_ = "range_bin"
    points = left.withColumn(bin_, F.floor(F.col(point) / width))
    spans = right.where(F.col(low) < F.col(high)).withColumn(bin_, F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return points.join(spans, bin_).where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop(bin_)
