"""Queries over the test tables, one or more for each operator, with the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone import operators as ops
from lodestone import sources
from lodestone.engine import dialect
from lodestone.engine.catalog import CommitConflict
from lodestone.engine.session import Engine
from lodestone.functions import djb2, ieee_div, shard_of
from lodestone.streaming import latest, read_files, run_available, windowed

Query = Callable[[SparkSession, str], DataFrame]
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
SHARDS = 4

#: Plain SQL in this engine's dialect: name: (query, DuckDB text or None where the query's own will do).
SQL: dict[str, tuple[str, str | None]] = {
    "seq_scan_project": ("SELECT s_suppkey, s_name, s_acctbal FROM supplier", None),
    "filter_comparison_ops": (
        "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' AND o_orderdate <= TIMESTAMP '2001-08-01 00:00:00' AND o_custkey <> 5 AND o_totalprice > 1000 AND o_totalprice < 200000 AND o_orderstatus = 'O'", None),
    "filter_and_or_not": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_quantity < 10 OR l_discount > 0.05) AND (l_returnflag = 'A' OR l_linestatus = 'F')", None),
    "filter_in": ("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')", None),
    "filter_not_in": ("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')", None),
    "filter_is_null": ("SELECT o_orderkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE l_orderkey IS NULL", None),
    "filter_is_not_null": ("SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE l_orderkey IS NOT NULL", None),
    "project_arithmetic": ("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_quantity + l_tax AS plus FROM lineitem", None),
    "unary_minus": ("SELECT c_custkey, -c_acctbal AS owed, +c_nationkey AS nation FROM customer", None),
    "join_inner": ("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", None),
    "join_left": ("SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey", None),
    "join_right": ("SELECT a.c_custkey AS l_key, o_orderkey FROM customer a RIGHT JOIN orders b ON CASE WHEN a.c_acctbal > 0 THEN a.c_custkey END = CASE WHEN b.o_orderstatus <> 'F' THEN b.o_custkey ELSE -1 - b.o_orderkey END", None),
    "join_full": ("SELECT a.c_custkey AS l_key, o_orderkey FROM customer a FULL OUTER JOIN orders b ON CASE WHEN a.c_acctbal > 0 THEN a.c_custkey END = CASE WHEN b.o_orderstatus <> 'F' THEN b.o_custkey ELSE -1 - b.o_orderkey END", None),
    "join_multi": ("SELECT r_name, n_name, c_custkey, o_orderkey FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey", None),
    "join_swapped_on": ("SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey", None),
    "agg_global": ("SELECT count(l_orderkey) AS n, CAST(sum(l_quantity) AS DOUBLE) AS total, min(l_shipdate) AS first, max(l_shipdate) AS last, round(avg(l_quantity), 6) AS mean FROM lineitem", None),
    "agg_global_empty": ("SELECT count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS total, min(l_orderkey) AS low, avg(l_quantity) AS mean FROM lineitem WHERE l_quantity < 0", None),
    "agg_count_star": ("SELECT count(*) AS n FROM orders", None),
    "agg_group_by": ("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS total, round(avg(l_discount), 6) AS mean FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "agg_group_multi": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY o_orderstatus, o_orderpriority", None),
    "agg_group_expr": ("SELECT l_linenumber + 1 AS k, count(*) AS n, count(*) + 1 AS more FROM lineitem GROUP BY l_linenumber + 1", None),
    "agg_having": ("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12", None),
    "agg_where_group": ("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment", None),
    "agg_distinct_count": ("SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem", None),
    "agg_distinct_sum": ("SELECT o_orderstatus, CAST(sum(DISTINCT o_custkey) AS DOUBLE) AS total FROM orders GROUP BY o_orderstatus", None),
    "agg_min_max_text": ("SELECT min(p_name) AS low, max(p_name) AS high FROM part", None),
    "select_distinct": ("SELECT DISTINCT o_orderstatus FROM orders", None),
    "limit_offset": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 5 LIMIT 10", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5"),
    "offset_only": ("SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20", None),
    "limit_zero": ("SELECT n_nationkey FROM nation LIMIT 0", None),
    "literal_exponent": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice > 5e4 AND l_quantity < 4.5E+1 AND l_discount >= .5e-1", None),
    "null_safe_operator": ("SELECT c_custkey FROM customer WHERE NULLIF(c_nationkey, 3) <=> NULL OR c_nationkey <=> 7", "SELECT c_custkey FROM customer WHERE NULLIF(c_nationkey, 3) IS NULL OR c_nationkey = 7"),
    "cast_lambda": (
        "SELECT o_orderkey, CAST(o_totalprice AS INT) AS whole, transform(array(o_custkey, o_orderkey), x -> x + 1)[1] AS following, o_orderkey::string AS name FROM orders",
        "SELECT o_orderkey, CAST(trunc(o_totalprice) AS INTEGER) AS whole, o_orderkey + 1 AS following, CAST(o_orderkey AS VARCHAR) AS name FROM orders"),
    "division_sql": ("SELECT l_orderkey, l_linenumber, l_quantity / l_discount AS ratio, (l_quantity - 25) / l_discount * 2 AS twice, l_quantity / 4 AS quarter FROM lineitem", None),
    "modulo_concat": ("SELECT c_custkey, c_custkey % 7 AS rest, c_name || '-' || c_mktsegment AS tag FROM customer", None),
    "like_between_case": ("SELECT p_partkey, CASE WHEN p_size BETWEEN 10 AND 20 THEN 'middle' WHEN p_size > 20 THEN 'large' ELSE 'small' END AS class FROM part WHERE p_name LIKE '%1%' AND p_type NOT LIKE 'X%'", None),
    "scalar_functions": ("SELECT c_custkey, upper(c_name) AS high, substr(c_name, 2, 4) AS some, abs(c_acctbal) AS size, coalesce(NULLIF(c_mktsegment, 'BUILDING'), 'none') AS segment, length(c_name) AS n FROM customer", None),
    "null_literal": ("SELECT s_suppkey, NULL IS NULL AS yes, (s_acctbal + NULL) IS NULL AS also, (s_nationkey IN (100, NULL)) IS NULL AS unknown FROM supplier", None),
    "join_inner_keyword": ("SELECT o_orderkey, c_name FROM orders INNER JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> 3", None),
    "join_composite": ("SELECT a.l_orderkey, a.l_linenumber, b.l_partkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber + 1", None),
    "join_theta": ("SELECT n_nationkey, r_regionkey FROM nation LEFT JOIN region ON n_regionkey < r_regionkey", None),
    "join_cross": ("SELECT n_nationkey, r_regionkey FROM nation CROSS JOIN region", None),
    "agg_rollup": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", None),
    "agg_cube_grouping": ("SELECT o_orderstatus, o_orderpriority, CAST(GROUPING(o_orderstatus) AS INT) AS over, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", None),
    "agg_filter_percentile": (
        "SELECT l_returnflag, count(*) FILTER (WHERE l_discount > 0.05) AS n, percentile(l_quantity, 0.5) AS middle FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, count(*) FILTER (WHERE l_discount > 0.05) AS n, quantile_cont(l_quantity, 0.5) AS middle FROM lineitem GROUP BY l_returnflag"),
    "agg_mean_by_division": ("SELECT o_custkey, CAST(sum(o_orderkey) AS DOUBLE) / count(*) AS mean FROM orders GROUP BY o_custkey", None),
    "set_operations": (
        "(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')", None),
    "subquery_exists": ("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > (SELECT avg(o_totalprice) FROM orders)) AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)", None),
    "ext_window_union_cte": (
        "WITH a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) SELECT o_custkey, o_orderkey FROM a WHERE rn = 1 UNION SELECT c_custkey, -1 FROM customer WHERE c_acctbal < 0", None),
}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ops.seq_scan(spark, f"{sf_dir}/{table}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The text through the engine, over the tables that it names."""
    engine, words = Engine(spark), {t.lower() for t in dialect.tokens(text)}
    for t in TABLES:
        if t in words:
            engine.attach(t, load(spark, sf_dir, t))
    return engine.sql(text).df


def _scratch(spark: SparkSession) -> str:
    """A new folder among those that driver and executors share, which goes when the driver's JVM ends.

    In local mode a session that names none gets a temporary one; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="lodestone-")
    path = f"{root}/plans-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    fs.mkdirs(place)
    fs.deleteOnExit(place)
    return f"{path}/table"


def _division(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "lineitem").select("l_orderkey", "l_linenumber", ieee_div(F.col("l_quantity"), F.col("l_discount")).alias("ratio"))


def _join_with(strategy: str) -> Query:
    return lambda s, d: ops.hash_join(load(s, d, "orders"), load(s, d, "customer"), "o_custkey", "c_custkey", strategy=strategy).select("o_orderkey", "c_name")


def _vec_filter(s: SparkSession, d: str) -> DataFrame:
    return sources.vectorized_pipeline(load(s, d, "orders"), F.col("o_orderkey") > 500, ["o_orderkey", "o_custkey"])


def _vec_agg(s: SparkSession, d: str) -> DataFrame:
    return sources.vectorized_pipeline(load(s, d, "orders"), aggregate=[F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").cast("double").alias("total")])


def _columnar(s: SparkSession, d: str) -> DataFrame:
    table = sources.ColumnarTable.create(s, _scratch(s), load(s, d, "lineitem").schema)
    table.append_batch(load(s, d, "lineitem"))
    return sources.ColumnarTable.open(s, table.path).scan()


def _shard_point(s: SparkSession, d: str) -> DataFrame:
    path = _scratch(s)
    sources.write_sharded(load(s, d, "customer").select("c_custkey", "c_name"), path, "c_custkey", SHARDS)
    return sources.shard_lookup(s, path, "c_custkey", 100, SHARDS)


def _shard_counts(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "orders").groupBy(shard_of(F.col("o_orderkey"), SHARDS).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


def _merge(s: SparkSession, d: str) -> DataFrame:
    """Aggregates by shard, merged: sums of counts and sums, least and greatest, mean from sum and count."""
    part = load(s, d, "lineitem").groupBy(shard_of(F.col("l_orderkey"), SHARDS).alias("shard")).agg(F.count("l_quantity").alias("n"), F.sum("l_quantity").alias("total"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))
    return part.agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"), F.round(F.sum("total") / F.sum("n"), 6).alias("mean"))


def _semi(anti: bool) -> Query:
    return lambda s, d: ops.project(ops.semi_join(load(s, d, "customer"), ops.filter_rows(load(s, d, "orders"), "o_totalprice > 300000"), "c_custkey", "o_custkey", anti), "c_custkey")


def _asof(s: SparkSession, d: str) -> DataFrame:
    """Each event with the latest purchase of its user so far."""
    events = load(s, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    bought = events.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("bought"))
    return ops.asof_join(events.select("event_id", "user_id", "ts"), bought, "user_id", "ts", ["bought"]).select("event_id", "last_bought")


def _range(s: SparkSession, d: str) -> DataFrame:
    """Customers with the suppliers whose balance band holds theirs."""
    bands = load(s, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 20).alias("high"))
    return ops.range_join(load(s, d, "customer").select("c_custkey", "c_acctbal"), bands, "c_acctbal", "low", "high", 50.0).select("c_custkey", "s_suppkey")


def _compat(s: SparkSession, d: str) -> DataFrame:
    none = ops.filter_rows(load(s, d, "orders"), "o_orderkey < 0")
    return ops.aggregate(none, [], [ops.Aggregate("sum", "o_custkey", "total"), ops.Aggregate("count", "o_custkey", "n"), ops.Aggregate("avg", "o_custkey", "mean")], compat=True)


def _top(s: SparkSession, d: str) -> DataFrame:
    return ops.limit(ops.sort(ops.project(load(s, d, "orders"), "o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], [False, True]), 12, 3)


def _formats(s: SparkSession, d: str) -> DataFrame:
    """Customers through each format of files in turn, with nulls among them."""
    df = load(s, d, "customer").withColumn("c_mktsegment", F.expr("nullif(c_mktsegment, 'BUILDING')"))
    for kind in sources.FORMATS:
        path = _scratch(s)
        sources.write(df, path, kind)
        df = sources.read(s, path, kind, df.schema)
    return df


def _lenient(s: SparkSession, d: str) -> DataFrame:
    """Names read as numbers: what isn't one is null."""
    path = _scratch(s)
    given = load(s, d, "customer")
    sources.write(given.select("c_custkey", F.expr("CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE string(c_nationkey) END").alias("v")), path, "csv")
    return sources.read(s, path, "csv", T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("v", T.IntegerType())]), compat=True)


def _stream(s: SparkSession, d: str) -> DataFrame:
    """Daily windows by a stream over the events' file, to the end of what has arrived."""
    path, schema = _scratch(s), load(s, d, "events").schema
    events = read_files(s, d, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    run_available(windowed(events, "ts", "event_type", "value", "1 day"), path, f"{path}-state", "complete")
    return latest(s, path).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def _conflict(s: SparkSession, d: str) -> DataFrame:
    """Of two transactions that write a table the first to commit wins; the other changes nothing."""
    one = Engine(s, _scratch(s))
    one.attach("nation_rows", load(s, d, "nation"))
    one.script("CREATE TABLE nations (n_nationkey INT NOT NULL, n_name TEXT); INSERT INTO nations SELECT n_nationkey, n_name FROM nation_rows")
    two = Engine(s, one.catalog.root)
    one.script("BEGIN; UPDATE nations SET n_name = 'FIRST' WHERE n_nationkey < 3")
    two.script("BEGIN; DELETE FROM nations")
    one.sql("COMMIT")
    try:
        two.sql("COMMIT")
    except CommitConflict:
        return two.sql("SELECT n_nationkey, n_name FROM nations").df
    raise AssertionError("both commits went through")


def _engine_after(*statements: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        engine = Engine(s, _scratch(s))
        engine.sql("CREATE TABLE nations (n_nationkey INT NOT NULL, n_name TEXT, n_regionkey INT)")
        engine.attach("nation_rows", load(s, d, "nation"))
        engine.attach("regions", load(s, d, "region"))
        engine.sql("INSERT INTO nations SELECT n_nationkey, n_name, n_regionkey FROM nation_rows")
        for x in statements:
            engine.sql(x)
        return engine.sql("SELECT n_nationkey, n_name, n_regionkey FROM nations").df

    return run


def _ranked(text: str) -> Query:
    """The rows of a sorted query with their rank in its order, counted by partitions so that no task gets all rows."""

    def run(s: SparkSession, d: str) -> DataFrame:
        path = _scratch(s)
        run_sql(s, d, text).withColumn("at", F.monotonically_increasing_id()).write.parquet(path)
        rows = s.read.parquet(path).withColumn("part", F.shiftright("at", 33))
        # One row for each partition, so the window over all of them is small.
        before = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n")
        rank = (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("rank")
        return rows.join(F.broadcast(before), "part").select(*[c for c in rows.columns if c not in ("at", "part")], rank)

    return run


BUILT: dict[str, tuple[Query, str | None]] = {
    "order_by_asc": (_ranked("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey"), "SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS rank FROM customer"),
    "order_by_desc": (_ranked("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey"), "SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer"),
    "order_by_multi_expr": (
        _ranked("SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_linenumber + l_orderkey DESC, l_orderkey, l_linenumber"),
        "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_linenumber + l_orderkey DESC, l_orderkey, l_linenumber) AS rank FROM lineitem"),
    "order_nulls_last": (
        _ranked("SELECT NULLIF(n_regionkey, 2) AS k, n_nationkey FROM nation ORDER BY NULLIF(n_regionkey, 2), n_nationkey"),
        "SELECT NULLIF(n_regionkey, 2) AS k, n_nationkey, row_number() OVER (ORDER BY NULLIF(n_regionkey, 2) NULLS LAST, n_nationkey) AS rank FROM nation"),
    "index_point_lookup": (lambda s, d: ops.index_scan(load(s, d, "orders"), "o_orderkey", 100).select("o_orderkey", "o_custkey", "o_totalprice"), "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 100"),
    "buffer_scan": (lambda s, d: ops.buffer_scan(s, [(1, "a"), (2, None), (3, "c")], "id int, val string"), "SELECT * FROM (VALUES (1, 'a'), (2, NULL), (3, 'c')) t(id, val)"),
    "ieee_division": (_division, "SELECT l_orderkey, l_linenumber, l_quantity / l_discount AS ratio FROM lineitem"),
    "join_broadcast": (_join_with("broadcast"), "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"),
    "join_shuffle": (_join_with("shuffle"), "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"),
    "join_null_safe": (
        lambda s, d: ops.hash_join(load(s, d, "nation").select("n_nationkey", F.expr("nullif(n_regionkey, 2)").alias("k")), load(s, d, "region").select("r_name", F.expr("nullif(r_regionkey, 2)").alias("r")), "k", "r", null_safe=True).select("n_nationkey", "r_name"),
        "SELECT n_nationkey, r_name FROM nation JOIN region ON NULLIF(n_regionkey, 2) IS NOT DISTINCT FROM NULLIF(r_regionkey, 2)"),
    "agg_operator": (
        lambda s, d: ops.aggregate(load(s, d, "orders"), ["o_orderstatus"], [ops.Aggregate("count", None, "n"), ops.Aggregate("sum", "o_custkey", "total", distinct=True), ops.Aggregate("max", "o_orderpriority", "high")], having="n > 1"),
        "SELECT o_orderstatus, count(*) AS n, CAST(sum(DISTINCT o_custkey) AS DOUBLE) AS total, max(o_orderpriority) AS high FROM orders GROUP BY o_orderstatus HAVING count(*) > 1"),
    "vec_scan_filter_project": (_vec_filter, "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 500"),
    "vec_global_agg": (_vec_agg, "SELECT count(*) AS n, CAST(sum(o_orderkey) AS DOUBLE) AS total FROM orders"),
    "columnar_roundtrip": (_columnar, "SELECT * FROM lineitem"),
    "shard_prune_point": (_shard_point, "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 100"),
    "shard_distribution": (
        _shard_counts,
        f"WITH h AS (SELECT list_reduce(list_prepend(5381::BIGINT, list_transform(range(0, length(CAST(o_orderkey AS VARCHAR))), lambda i: ascii(CAST(o_orderkey AS VARCHAR)[i + 1])::BIGINT)), lambda a, b: (a * 33 + b) % 4294967296) AS h FROM orders) SELECT CAST(h % {SHARDS} AS INTEGER) AS shard, count(*) AS n FROM h GROUP BY 1"),
    "hash_djb2": (lambda s, d: s.range(1).select(djb2(F.lit("100")).alias("h")), "SELECT CAST(193431990 AS BIGINT) AS h"),
    "agg_partial_merge": (_merge, "SELECT count(l_quantity) AS n, sum(l_quantity) AS total, min(l_quantity) AS low, max(l_quantity) AS high, round(avg(l_quantity), 6) AS mean FROM lineitem"),
    "dml_insert": (_engine_after("INSERT INTO nations (n_nationkey, n_name) VALUES (100, 'ATLANTIS'), (101, 'MU')"), "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL VALUES (100, 'ATLANTIS', NULL), (101, 'MU', NULL)"),
    "dml_update": (_engine_after("UPDATE nations SET n_regionkey = n_regionkey + 10, n_name = 'X' WHERE n_nationkey < 5"), "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 'X' ELSE n_name END AS n_name, CASE WHEN n_nationkey < 5 THEN n_regionkey + 10 ELSE n_regionkey END AS n_regionkey FROM nation"),
    "dml_delete": (_engine_after("DELETE FROM nations WHERE n_regionkey = 2"), "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 2"),
    "ddl_index": (_engine_after("CREATE INDEX i ON nations (n_nationkey)"), "SELECT n_nationkey, n_name, n_regionkey FROM nation"),
    "txn_commit": (_engine_after("BEGIN", "DELETE FROM nations WHERE n_nationkey > 3", "INSERT INTO nations VALUES (50, 'NEW', 1)", "COMMIT"), "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey <= 3 UNION ALL VALUES (50, 'NEW', 1)"),
    "txn_rollback": (_engine_after("BEGIN", "DELETE FROM nations", "ROLLBACK"), "SELECT n_nationkey, n_name, n_regionkey FROM nation"),
    "dml_update_subquery": (
        _engine_after("UPDATE nations SET n_name = (SELECT max(r_name) FROM regions) WHERE n_regionkey IN (SELECT r_regionkey FROM regions WHERE r_name LIKE 'A%')", "DELETE FROM nations WHERE NOT EXISTS (SELECT 1 FROM regions WHERE r_regionkey = n_regionkey AND r_regionkey < 4)"),
        "SELECT n_nationkey, CASE WHEN n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%') THEN (SELECT max(r_name) FROM region) ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_regionkey < 4"),
    "drop_recreate": (
        _engine_after("DROP TABLE nations", "CREATE TABLE nations (n_nationkey INT NOT NULL, n_name TEXT, n_regionkey INT)", "INSERT INTO nations SELECT n_nationkey + 100, n_name, n_regionkey FROM nation_rows WHERE n_regionkey = 1"),
        "SELECT n_nationkey + 100 AS n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 1"),
    "ddl_alter_truncate": (
        _engine_after("TRUNCATE TABLE nations", "ALTER TABLE nations DROP COLUMN n_name", "ALTER TABLE nations ADD COLUMN n_name TEXT", "INSERT INTO nations (n_nationkey, n_name) SELECT n_nationkey, n_name FROM nation_rows", "ALTER TABLE nations RENAME TO other", "ALTER TABLE other RENAME TO nations"),
        "SELECT n_nationkey, n_name, CAST(NULL AS INTEGER) AS n_regionkey FROM nation"),
    "index_through_engine": (_engine_after("CREATE INDEX i ON nations (n_nationkey)", "INSERT INTO nations VALUES (60, 'LATE', 1)", "DELETE FROM nations WHERE n_nationkey <> 60 AND n_nationkey <> 7"), "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey = 7 UNION ALL VALUES (60, 'LATE', 1)"),
    "txn_conflict": (_conflict, "SELECT n_nationkey, CASE WHEN n_nationkey < 3 THEN 'FIRST' ELSE n_name END AS n_name FROM nation"),
    "join_semi": (_semi(False), "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)"),
    "join_anti": (_semi(True), "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)"),
    "join_asof": (
        _asof,
        "SELECT event_id, (SELECT max({'ts': b.ts, 'id': b.event_id}).id FROM events b WHERE b.event_type = 'purchase' AND b.user_id = a.user_id AND b.ts <= a.ts) AS last_bought FROM events a"),
    "join_range": (_range, "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_acctbal >= s_acctbal AND c_acctbal < s_acctbal + 20"),
    "agg_compat": (_compat, "SELECT 0.0::DOUBLE AS total, CAST(0 AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS mean"),
    "top_k_operator": (_top, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 12 OFFSET 3"),
    "formats_roundtrip": (_formats, "SELECT c_custkey, c_name, c_nationkey, c_acctbal, NULLIF(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer"),
    "lenient_load": (_lenient, "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_nationkey END AS v FROM customer"),
    "stream_windowed_events": (_stream, "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
    "ext_windowed_events": (
        lambda s, d: windowed(load(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "value", "1 day").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total")),
        "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
}


def queries() -> dict[str, Query]:
    return {k: (lambda s, d, text=text: run_sql(s, d, text)) for k, (text, _) in SQL.items()} | {k: q for k, (q, _) in BUILT.items()}


def oracle_sql() -> dict[str, str]:
    return {k: other or text for k, (text, other) in SQL.items()} | {k: sql for k, (_, sql) in BUILT.items() if sql}


FLAGSHIP = """
SELECT o_orderpriority, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE l_quantity > 10 AND o_orderstatus <> 'P'
GROUP BY o_orderpriority ORDER BY revenue DESC OFFSET 0 LIMIT 5
"""
