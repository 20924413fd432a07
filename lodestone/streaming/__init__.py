"""Streams: windowed aggregates with watermarks, sessions, deduplication, and runs of what has arrived."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str, key: str, value: str, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Rows and sum of ``value`` for each tumbling (or sliding) window and key; works on streams and tables alike.

    A stream drops rows that come later than ``late`` behind the latest time; a table has no late rows.
    """
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Start, end and rows of each run of a key's events that lie less than ``gap`` apart."""
    found = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, time: str, *keys: str, late: str = "10 minutes") -> DataFrame:
    """The first event of each key among those within the watermark."""
    if events.isStreaming:
        return events.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))
    return events.dropDuplicates(list(keys))


def read_files(spark: SparkSession, folder: str, schema, pattern: str = "*", files_at_once: int = 1000, kind: str = "parquet") -> DataFrame:  # noqa: ANN001
    """A stream of the files in a folder, so many in a batch."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_at_once).format(kind).load(folder)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what has arrived and stops; a run after it goes on from the checkpoint.

    append: final rows are added to the table at ``path``, each exactly once. complete: each batch's whole result
    becomes the folder of its number below ``path``; the highest is the present state.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").start(path)
    else:
        query = writer.foreachBatch(lambda df, number: df.write.mode("overwrite").parquet(f"{path}/batch={number}")).start()
    query.awaitTermination()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The state that a complete run has left."""
    found = spark.read.parquet(path)
    last = found.agg(F.max("batch")).first()[0]
    return found.where(F.col("batch") == last).drop("batch")
