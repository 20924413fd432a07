"""SQL scenarios: golden rows, transactions, dialect."""

from __future__ import annotations

import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.engine import dialect
from lodestone.engine.catalog import CommitConflict
from lodestone.engine.session import Engine, EngineError
from lodestone.functions import fmt_value


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "warehouse"))


def rows(engine, text):
    return engine.sql(text).rows()


def test_metadata_of_results_and_catalog(engine):
    made = engine.sql("CREATE TABLE Depot (bay INT, tons DOUBLE, goods TEXT)")
    assert made.rows_affected == 1 and made.elapsed_us > 0 and made.rows() == []
    assert engine.sql("INSERT INTO depot SELECT id, id * 0.5, concat('g', id) FROM range(40)").rows_affected == 40
    assert engine.exists("DEPOT") and engine.tables() == ["Depot"] and engine.version() == 2
    assert engine.sql("DELETE FROM depot WHERE bay >= 30").rows_affected == 10
    stats = engine.statistics("depot")
    assert stats["rows"] == 30 and stats["oid"] == 1 and stats["modified"] >= stats["created"]
    engine.sql("CREATE UNIQUE INDEX at_bay ON depot (bay)")
    assert engine.indexes("depot") == ["at_bay"] and "index at_bay on Depot(bay) unique" in engine.describe()
    assert rows(engine, "EXPLAIN SELECT * FROM depot WHERE bay = 3")[0][0].count("EqualTo(bay,3)") == 1
    with pytest.raises(EngineError):
        engine.statistics("nothing")


def test_index_prunes_row_groups(engine, spark, request):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else this little data is one file
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    engine.sql("CREATE TABLE wide (k INT, v TEXT)")
    engine.sql("INSERT INTO wide SELECT pmod(hash(id), 100000), repeat('x', 20) FROM range(20000)")
    engine.sql("CREATE INDEX by_k ON wide (k)")
    engine.sql("INSERT INTO wide SELECT pmod(hash(id), 100000), 'late' FROM range(500)")
    import pyarrow.parquet as pq

    state = engine.catalog.load()["tables"]["wide"]
    files = [f for p in state["paths"] for f in spark.read.parquet(p).inputFiles()]
    spans = [pq.read_metadata(f.removeprefix("file://")).row_group(0).column(0).statistics for f in files]
    assert len(state["paths"]) == 2 and any(s.max - s.min < 60_000 for s in spans)
    for f in files:
        keys = pq.read_table(f.removeprefix("file://")).column("k").to_pylist()
        assert keys == sorted(keys)


def test_views_end_with_their_statement(engine, spark):
    spark.range(3).createOrReplaceTempView("shelf")
    engine.script("CREATE TABLE shelf (a INT); INSERT INTO shelf VALUES (41)")
    assert rows(engine, "SELECT a FROM shelf") == [(41,)]
    assert spark.table("shelf").count() == 3
    kept = engine.sql("SELECT a FROM shelf").df
    engine.script("DROP TABLE shelf; CREATE TABLE shelf (a INT)")
    assert kept.collect() == [(41,)] and rows(engine, "SELECT a FROM shelf") == []
    spark.catalog.dropTempView("shelf")
    engine.sql("DROP TABLE shelf")
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        engine.sql("SELECT a FROM shelf")
    other = Engine(spark, engine.catalog.root + "-other")
    other.script("CREATE TABLE lamp (a INT)")
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        engine.sql("SELECT * FROM lamp")


def folders(engine):
    return {str(p.parent) for p in Path(engine.catalog.root).glob("data/*/*/_SUCCESS")} | {str(p) for p in Path(engine.catalog.root).glob("data/*/*")}


def test_failed_statements_leave_nothing(engine, spark):
    engine.script("CREATE TABLE slot (a INT NOT NULL); INSERT INTO slot VALUES (1), (2)")
    before = folders(engine)
    with pytest.raises(Exception, match="null value"):
        engine.sql("INSERT INTO slot VALUES (3), (NULL)")
    with pytest.raises(Exception, match="null value"):
        engine.sql("UPDATE slot SET a = NULL WHERE a = 2")
    assert engine.sql("UPDATE slot SET a = 9 WHERE a = 7").rows_affected == 0
    assert folders(engine) == before and sorted(rows(engine, "SELECT a FROM slot")) == [(1,), (2,)]
    other = Engine(spark, engine.catalog.root)
    other.script("BEGIN; DELETE FROM slot WHERE a = 1")
    engine.sql("INSERT INTO slot VALUES (5)")
    with pytest.raises(CommitConflict):
        other.sql("COMMIT")
    assert len(folders(engine)) == len(before) + 1
    engine.sql("DELETE FROM slot WHERE a = 5")
    assert len(engine.vacuum(older_than_s=0)) == 2 and len(folders(engine)) == 1
    assert sorted(rows(engine, "SELECT a FROM slot")) == [(1,), (2,)]


def test_broken_manifests_are_passed_over(engine, spark):
    engine.script("CREATE TABLE jar (a INT); INSERT INTO jar VALUES (1)")
    last = engine.version()
    (Path(engine.catalog.root) / "_manifests" / f"{last + 1:012d}.json").write_text('{"version": 3, "tab')
    again = Engine(spark, engine.catalog.root)
    assert again.version() == last and rows(again, "SELECT a FROM jar") == [(1,)]
    again.sql("INSERT INTO jar VALUES (2)")
    assert again.version() == last + 2 and sorted(rows(engine, "SELECT a FROM jar")) == [(1,), (2,)]
    with pytest.raises(CommitConflict):
        engine.catalog.store(engine.catalog.load(), last)


def test_functions_of_the_session(engine):
    engine.register_function("twice", lambda x: 2 * x, "int")
    assert rows(engine, "SELECT twice(id) FROM range(3) ORDER BY 1") == [(0,), (2,), (4,)]

    @F.udtf(returnType="n int")
    class Count:
        def eval(self, upto: int):
            for i in range(upto):
                yield (i,)

    engine.register_function("count_to", Count)
    assert rows(engine, "SELECT n FROM count_to(2) ORDER BY n") == [(0,), (1,)]


def test_snapshot_holds_through_others_commits(engine, spark):
    engine.script("CREATE TABLE tide (at INT, cm INT); INSERT INTO tide VALUES (6, 210), (12, 35)")
    reader = Engine(spark, engine.catalog.root)
    reader.sql("BEGIN")
    engine.script("BEGIN; UPDATE tide SET cm = cm + 5; INSERT INTO tide VALUES (18, 220)")
    assert rows(engine, "SELECT sum(cm) FROM tide") == [(475,)] and rows(reader, "SELECT sum(cm) FROM tide") == [(245,)]
    engine.sql("COMMIT")
    assert rows(reader, "SELECT sum(cm) FROM tide") == [(245,)]
    reader.sql("COMMIT")
    assert rows(reader, "SELECT sum(cm) FROM tide") == [(475,)]


def test_first_committer_wins_by_table(engine, spark):
    engine.script("CREATE TABLE a (v INT); CREATE TABLE b (v INT)")
    other = Engine(spark, engine.catalog.root)
    engine.script("BEGIN; INSERT INTO a VALUES (1)")
    other.script("BEGIN; INSERT INTO a VALUES (2)")
    engine.sql("INSERT INTO b VALUES (1)")
    engine.sql("COMMIT")
    with pytest.raises(CommitConflict):
        other.sql("COMMIT")
    other.sql("INSERT INTO b VALUES (2)")
    assert sorted(rows(engine, "SELECT v FROM b")) == [(1,), (2,)]


def test_not_null_and_errors(engine):
    engine.sql("CREATE TABLE n (id BIGINT PRIMARY KEY, v VARCHAR(10))")
    with pytest.raises(Exception, match="null value"):
        engine.sql("INSERT INTO n VALUES (NULL, 'x')")
    with pytest.raises(EngineError):
        engine.sql("CREATE TABLE n (id INT)")
    with pytest.raises(EngineError):
        engine.sql("UPDATE n SET nope = 1")
    engine.sql("CREATE UNIQUE INDEX i ON n (id)")
    with pytest.raises(EngineError):
        engine.sql("CREATE INDEX i ON n (id)")
    assert engine.sql("DROP INDEX IF EXISTS j").rows_affected == 0
    assert engine.sql("DROP INDEX i").rows_affected == 1


def test_rewrites_leave_the_rest_as_it_is():
    text = dialect.rewrite("SELECT a, row_number() OVER (PARTITION BY b ORDER BY c DESC, f(d, e)) FROM t ORDER BY a, b NULLS FIRST OFFSET 1 ROWS LIMIT 2")
    assert "ORDER BY c DESC NULLS FIRST, f(d, e) NULLS LAST)" in text and text.endswith("ORDER BY a NULLS LAST, b NULLS FIRST LIMIT 2 OFFSET 1")
    for same in (
        "SELECT 1e5, 10L, 1.5D, 2BD, .5e-3, r'\\d', 'it\\'s', x'0F', \"q\" FROM t", "SELECT /*+ BROADCAST(b) */ a == b, a <=> b, x >> 2, a::int, m -> 1 FROM t -- a / b", "SELECT `a/b`, '/', 4 / 2, x / 1.5e0 FROM t",
        "SELECT interval '2' day / x FROM t",
    ):
        assert dialect.rewrite(same) == same
    assert dialect.split("a; -- ;\n b ';' ; /* ; */ c;") == ["a", "-- ;\n b ';'", "/* ; */ c"]


def test_division_of_any_operands(spark):
    engine = Engine(spark)
    engine.attach("d", spark.sql("SELECT * FROM VALUES (1, 6, 4.0D), (2, 0, 0.0D), (3, -2, 0.0D), (4, NULL, 1.0D) AS d(k, a, b)"))
    got = rows(engine, "SELECT k, a / b, -a / b * 2, abs(a) / (b - 4), a * 3 / b / 2, CASE WHEN k = 1 THEN 8 END / b, a / CAST(b AS INT) FROM d ORDER BY k")
    nan, inf = "nan", math.inf
    plain = [tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in got]
    assert plain == [(1, 1.5, -3.0, inf, 2.25, 2.0, 1.5), (2, nan, nan, -0.0, nan, None, nan), (3, -inf, inf, -0.5, -inf, None, -inf), (4, None, None, None, None, None, None)]
    assert rows(engine, "SELECT sum(a) / count(*), sum(a) / sum(b) FROM d") == [(1.0, 0.8)]
    assert rows(engine, "SELECT a / b AS q, count(*) FROM d WHERE k <> 2 GROUP BY a / b ORDER BY q") == [(-inf, 1), (1.5, 1), (None, 1)]
    assert rows(engine, "SELECT k FROM d WHERE a / b < 0 OR sum_of(k) / 0 > 9".replace("sum_of(k)", "abs(k)")) == [(1,), (2,), (3,), (4,)]


def test_fmt_value_has_ten_significant_digits(spark):
    values = [0.0, -0.0, 1.0, -2.5, 1 / 3, 123456789.125, 9999999999.0, 12345678901.5, 1e10, -1e-4, 1.5e-5, 6.02214076e23, 100.0, 2e-300, 0.00012345678912345]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(fmt_value(F.col("v"), "double").alias("t")).collect()
    assert [r.t for r in got] == [f"{v:.10g}" for v in values]
    odd = spark.createDataFrame([(0, None), (1, math.nan), (2, math.inf), (3, -math.inf)], "i int, v double")
    assert [r.t for r in odd.orderBy("i").select(fmt_value(F.col("v"), "double").alias("t")).collect()] == ["NULL", "nan", "inf", "-inf"]
