"""Helpers shared by the training-data operators: table access, scratch tables, Arrow batches.

Scratch tables go to a folder of the application's own below the one in ``spark.checkpoint.dir``, which executors
and driver share. Operators delete what they have no more use for; the rest goes when the driver's JVM ends.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of a batch that a function gets at once; a longer row is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20
_BYTES_SETTING, _BYTES_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", f"{64 << 20}b"
#: Spark takes no more buckets than this by default.
MOST_BUCKETS = 100_000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202
    place = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application below the shared one that the session names.

    In local mode, where driver and executors are one process, a session that names none gets a temporary one;
    on a cluster that would be each machine's own disk, so it is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="lodestone-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/lodestone-{spark.sparkContext.applicationId}"
    place, fs = _file_system(spark, path)
    if not fs.exists(place):
        fs.mkdirs(place)
        fs.deleteOnExit(place)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: lineage ends there, and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._lodestone_path = path  # noqa: SLF001
    return found


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like ``materialize``, in buckets by ``key``: later joins on it find these rows in place and move the other side only.

    As many buckets as shuffle partitions, so that a shuffled side meets them; rows should come dealt by the key.
    """
    spark = df.sparkSession
    table = f"lodestone_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_BUCKETS)
    df.write.bucketBy(buckets, key).option("path", path).saveAsTable(table, format="parquet")
    found = spark.table(table)
    found._lodestone_path, found._lodestone_table = path, table  # noqa: SLF001
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes scratch tables that nothing will read any more."""
    for df in tables:
        spark = df.sparkSession
        if name := getattr(df, "_lodestone_table", None):
            spark.sql(f"DROP TABLE IF EXISTS `{name}`")
        if path := getattr(df, "_lodestone_path", None):
            place, fs = _file_system(spark, path)
            fs.delete(place, True)


def bounded(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows and about so many bytes at most; an empty one passes as it is."""
    for b in batches:
        if b.num_rows <= 1:
            yield b
            continue
        step = max(1, min(rows, size * b.num_rows // max(1, b.nbytes)))
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            if part.num_rows > 1 and part.nbytes > 2 * size:  # rows of very unlike length
                yield from bounded([part.slice(0, part.num_rows // 2), part.slice(part.num_rows // 2)], rows, size)
            else:
                yield part


class _Bounded:
    def __init__(self, function: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]) -> None:
        self.function = function

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        return self.function(bounded(batches))


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over batches of bounded bytes, of which the function sees slices.

    Spark's default of 64 MB at once is too much for executors of a few GB, on both sides of each of their tasks. Where
    the session has left it at that it is lowered; it changes no result, and a value that someone has set stays.
    """
    conf = df.sparkSession.conf
    if conf.get(_BYTES_SETTING, _BYTES_DEFAULT) == _BYTES_DEFAULT:
        conf.set(_BYTES_SETTING, f"{BATCH_BYTES}b")
    return df.mapInArrow(_Bounded(function), schema)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def unused(columns: Iterable[str], name: str) -> str:
    """``name``, with underscores until it clashes with no column in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def ddl(df: DataFrame, **changed: str) -> str:
    """The columns as DDL, some with another type."""
    return ", ".join(f"`{f.name.replace('`', '``')}` {changed.get(f.name, f.dataType.simpleString())}" for f in df.schema)


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null ids count as 'null'."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null"))) % divisor


def labelled_sample(documents: DataFrame, labels: DataFrame, target: str, divisor: int, held: int, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents that are not held out, written to scratch.

    Ids are chosen by a hash, before any text moves. An id with several labels counts with the highest; of several
    documents with one id the one with the least text counts. Repeats collapse in the tasks that read them.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & (remainder("doc_id", divisor) != held))
        .groupBy("doc_id").agg(F.max(F.col(target).cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    found = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most `rows` rows
    return materialize(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")), "labelled")
