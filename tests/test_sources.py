"""Files, columnar tables, shards, streams, settings and the command line."""

from __future__ import annotations

import io
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestone import __main__ as cli
from lodestone import config, operators, sources, streaming
from lodestone.functions import djb2, djb2_of


def test_formats_keep_nulls_and_odd_texts(spark, tmp_path):
    rows = [(1, None, 0.1), (2, "", None), (3, 'say "hi", you\nthere', -1.5), (None, "\\N?", 1e300), (5, " x ", 2.0)]
    df = spark.createDataFrame(rows, "k long, s string, v double")
    for kind in sources.FORMATS:
        sources.write(df, f"{tmp_path}/{kind}", kind)
        assert sorted(sources.read(spark, f"{tmp_path}/{kind}", kind, df.schema).collect(), key=repr) == sorted(df.collect(), key=repr)
    with pytest.raises(ValueError):
        sources.read(spark, f"{tmp_path}/csv", "csv")


def test_text_that_does_not_fit(spark, tmp_path):
    spark.createDataFrame([("1", "x"), ("z", "2.5")], "k string, v string").write.option("header", "true").csv(f"{tmp_path}/bad")
    schema = spark.createDataFrame([], "k int, v double").schema
    assert sorted(sources.read(spark, f"{tmp_path}/bad", "csv", schema, compat=True).collect(), key=repr) == [(1, None), (None, 2.5)]
    with pytest.raises(Exception):  # noqa: B017, PT011
        sources.read(spark, f"{tmp_path}/bad", "csv", schema).collect()


def test_columnar_table_appends_and_maps(spark, tmp_path):
    table = sources.ColumnarTable.create(spark, f"{tmp_path}/c", spark.createDataFrame([], "k long, v double").schema)
    table.append_batch([(k, None if k % 3 else k / 2) for k in range(2500)])
    table.append_batch([(9999, 1.0)])
    assert table.row_count() == 2501 and sources.ColumnarTable.open(spark, table.path).scan().where("v IS NULL").count() == 1666

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    found = [r.n for r in table.map_batches(sizes, "n long").collect()]
    assert sum(found) == 2501 and max(found) <= sources.BATCH_ROWS
    empty = sources.vectorized_pipeline(table.scan(), "k < 0", aggregate=[F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")]).first()
    nulls = sources.vectorized_pipeline(table.scan(), "v IS NULL", aggregate=[F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")]).first()
    assert (empty.n, empty.s) == (0, None) and (nulls.n, nulls.s) == (1666, None)


def test_shards_are_pruned(spark, tmp_path):
    assert [r.h for r in spark.createDataFrame([("",), ("100",), ("é",)], "k string").select(djb2(F.col("k")).alias("h")).collect()] == [djb2_of(""), djb2_of("100"), djb2_of("é")]
    sources.write_sharded(spark.range(300).withColumnRenamed("id", "k"), f"{tmp_path}/s", "k", 3)
    found = sources.shard_lookup(spark, f"{tmp_path}/s", "k", 77, 3)
    assert found.collect() == [(77,)]
    assert "PartitionFilters: [isnotnull(__shard" in found._jdf.queryExecution().toString()
    assert sources.read_sharded(spark, f"{tmp_path}/s").count() == 300


def test_asof_and_range_joins_against_loops(spark):
    left = [(k, k % 4 or None, k * 7 % 31 if k % 5 else None) for k in range(40)]
    right = [(k % 3, k * 5 % 23, k) for k in range(20)] + [(1, 10, 98), (1, 10, 99), (None, 3, 1), (2, None, 1)]
    a, b = spark.createDataFrame(left, "id int, u int, t int"), spark.createDataFrame(right, "u int, t int, v int")
    best = lambda u, t: max(((x[1], x[2]) for x in right if None not in (u, t, x[0], x[1]) and x[0] == u and x[1] <= t), default=(0, None))[1]
    assert sorted((r.id, r.last_v) for r in operators.asof_join(a, b, "u", "t", ["v"]).collect()) == [(i, best(u, t)) for i, u, t in left]
    spans = spark.createDataFrame([(k, k * 2, k * 2 + k % 7 - 1) for k in range(15)], "s int, low int, high int")
    got = sorted((r.id, r.s) for r in operators.range_join(a, spans, "t", "low", "high", 4).select("id", "s").collect())
    assert got == sorted((i, s) for i, _, t in left if t is not None for s, low, high in [tuple(x) for x in spans.collect()] if low <= t < high)


def test_operators_that_take_odd_arguments(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 4), (4, None)], "k int, v int")
    assert [r.k for r in operators.sort(df, ["v", "k"]).collect()] == [3, 2, 1, 4]
    assert [r.k for r in operators.sort(df, ["v", "k"], [False, True]).collect()] == [1, 4, 2, 3]
    assert operators.limit(df, -1, -5).count() == 4 and operators.limit(df, 1, 9).count() == 0 and operators.limit(df, 0).count() == 0
    assert operators.aggregate(df.where("k < 0"), [], [operators.Aggregate("sum", "v", "s")], compat=True).first().s == 0.0
    assert operators.distinct(operators.project(df, "v")).count() == 3


def moments(*minutes):
    return [(datetime(2024, 1, 1, m // 60, m % 60), "a", 1.0) for m in minutes]


def test_a_stream_drops_late_rows_and_goes_on(spark, tmp_path):
    folder, schema = f"{tmp_path}/in", "ts timestamp, kind string, v double"

    def arrive(*minutes):
        spark.createDataFrame(moments(*minutes), schema).coalesce(1).write.mode("append").parquet(folder)

    def run():
        made = streaming.windowed(streaming.read_files(spark, folder, schema, files_at_once=1), "ts", "kind", "v", "10 minutes", "5 minutes")
        streaming.run_available(made, f"{tmp_path}/out", f"{tmp_path}/state")
        return sorted((r.start.minute + 60 * r.start.hour, r.n) for r in spark.read.schema("start timestamp, kind string, n long, total double").parquet(f"{tmp_path}/out").collect())

    arrive(1, 2, 12)
    assert run() == []  # no window is past the watermark yet
    arrive(40)
    assert run() == [(0, 2), (10, 1)]
    arrive(3, 41)  # the first comes far too late
    arrive(70)
    assert run() == [(0, 2), (10, 1), (40, 2)]


def test_sessions_and_duplicates(spark):
    df = spark.createDataFrame(moments(0, 1, 1, 50, 55), "ts timestamp, kind string, v double")
    assert sorted(r.n for r in streaming.sessions(df, "ts", "kind", "20 minutes").collect()) == [2, 3]
    assert streaming.deduplicated(df, "ts", "ts", "kind").count() == 4


def test_settings(tmp_path):
    (tmp_path / "c").write_text("# first\nmaster = local[2]\nspark.sql.shuffle.partitions=3 # few\n\nwarehouse=/w\n")
    found = config.from_arguments(["--config", str(tmp_path / "c"), "--warehouse", "/other", "--conf", "spark.x=1"])
    assert (found.master, found.warehouse, found.conf) == ("local[2]", "/other", {"spark.sql.shuffle.partitions": "3", "spark.x": "1"})
    for wrong in ("colour=red", "word"):
        with pytest.raises(ValueError):
            config.Config().apply([wrong])


def test_command_line(spark, tmp_path, capsys):
    text = "CREATE TABLE t (a INT, b DOUBLE, c BOOLEAN); INSERT INTO t VALUES (1, 1e20, true), (2, NULL, false);\nSELECT nope FROM t; SELECT * FROM t ORDER BY a; SELECT a / 0 FROM t WHERE a = 1"
    assert cli.main(["--warehouse", str(tmp_path / "w")], io.StringIO(text)) == 1
    out = capsys.readouterr()
    assert out.out.splitlines() == ["OK 1", "OK 2", "1|1e+20|TRUE", "2|NULL|FALSE", "inf"] and out.err.startswith("ERROR")
