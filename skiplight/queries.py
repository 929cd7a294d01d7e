"""Queries over managed tables, each through the engine with predicate skipping, and the SQL they must agree with."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .geometry import Geometry
from .sources.readers import parse_log, read_csv, with_event_times
from .streaming.sink import append_stream

#: Small tables need small groups to have several.
SMALL = Geometry(8192, 512)
#: Ingest order: keys that are unique, or every column where there is none.
ORDER = {"orders": ["o_orderkey"], "events": ["event_id"], "documents": ["doc_id"], "customer": ["c_custkey"], "part": ["p_partkey"], "lineitem": ["l_orderkey", "l_linenumber"]}

_engines: dict[str, Engine] = {}
_held: dict[tuple[str, str, str], str] = {}


def engine_of(spark: SparkSession) -> Engine:
    """The engine of this application; entries and tables are shared by its queries."""
    app = spark.sparkContext.applicationId
    if app not in _engines:
        _engines[app] = Engine(spark, geometry=SMALL)
    _engines[app].set_enabled(True)
    return _engines[app]


def held(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The managed copy of a table, made at its first use."""
    e, key = engine_of(spark), (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _held:
        own = f"{name}_{len(_held)}"
        e.create_table(own, spark.read.parquet(f"{sf_dir}/{name}.parquet"), order_by=ORDER.get(name))
        _held[key] = own
    return _held[key]


def own_path(spark: SparkSession, name: str) -> str:
    """A folder for what a query writes: under the shared one, or a temporary one where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    return f"{base.rstrip('/')}/skiplight-{name}" if base else "file://" + tempfile.mkdtemp(prefix=f"skiplight-{name}-")


def fresh(spark: SparkSession, sf_dir: str, name: str, as_name: str) -> Engine:
    """An engine in which ``as_name`` is a new copy of a table."""
    e = engine_of(spark)
    e.drop_table(as_name, if_exists=True)
    e.create_table(as_name, spark.read.parquet(f"{sf_dir}/{name}.parquet"), order_by=ORDER.get(name))
    return e


#: name: (tables, SQL with {table} names that both engines run). Each runs twice: the first run builds, the second skips.
SELECTS: dict[str, tuple[list[str], str]] = {
    "filter_eq_count": (["lineitem"], "SELECT count(*) AS n FROM {lineitem} WHERE l_quantity = 42"),
    "filter_range_count": (["lineitem"], "SELECT count(*) AS n FROM {lineitem} WHERE l_orderkey < 1000"),
    "filter_flipped": (["lineitem"], "SELECT count(*) AS n FROM {lineitem} WHERE 1000 > l_orderkey"),
    "filter_and_or": (["events"], "SELECT count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM {events} WHERE (event_type = 'error' AND value > 100) OR user_id = 7"),
    "filter_selective": (["events"], "SELECT event_id, user_id, event_type FROM {events} WHERE user_id = 7 AND value > 100"),
    "filter_like": (["documents"], "SELECT lang, count(*) AS n FROM {documents} WHERE text LIKE '%the%' GROUP BY lang"),
    "filter_like_and": (["documents"], "SELECT source, count(*) AS n FROM {documents} WHERE text LIKE '%the%' AND text LIKE '%tion%' GROUP BY source"),
    "filter_group_order": (["events"], "SELECT event_type, count(*) AS n FROM {events} WHERE value > 50 GROUP BY event_type ORDER BY n DESC, event_type"),
    "filter_in": (["orders"], "SELECT o_orderpriority, count(*) AS n FROM {orders} WHERE o_orderstatus IN ('F', 'P') GROUP BY o_orderpriority"),
    "filter_between": (["orders"], "SELECT count(*) AS n FROM {orders} WHERE o_totalprice BETWEEN 1000 AND 20000"),
    "filter_not_eq": (["orders"], "SELECT count(*) AS n FROM {orders} WHERE o_orderstatus <> 'O'"),
    "filter_is_null": (["events"], "SELECT count(*) AS n FROM {events} WHERE props IS NULL OR value IS NULL"),
    "filter_is_not_null": (["events"], "SELECT count(*) AS n FROM {events} WHERE props IS NOT NULL AND event_type = 'signup'"),
    "filter_case": (["lineitem"], "SELECT count(*) AS n FROM {lineitem} WHERE CASE WHEN l_returnflag = 'R' THEN l_discount > 0.05 ELSE l_quantity > 45 END"),
    "filter_mod": (["orders"], "SELECT count(*) AS n FROM {orders} WHERE o_custkey % 100 = 3"),
    "filter_concat": (["orders"], "SELECT count(*) AS n FROM {orders} WHERE o_orderstatus || '-' || o_orderpriority LIKE 'F-1%'"),
    "filter_date": (["orders"], "SELECT count(*) AS n FROM {orders} WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-02-01 00:00:00'"),
    "filter_topk": (["orders"], "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 100"),
    "filter_sum": (["lineitem"], "SELECT l_returnflag, round(sum(l_extendedprice), 2) AS total FROM {lineitem} WHERE l_quantity > 45 GROUP BY l_returnflag"),
    "filter_no_match": (["events"], "SELECT count(*) AS n FROM {events} WHERE event_id < 0"),
    "filter_derived_join": (["orders", "customer"], "SELECT c_mktsegment, count(*) AS n FROM (SELECT * FROM {orders} WHERE o_orderkey < 5000) o JOIN {customer} c ON o.o_custkey = c.c_custkey GROUP BY c_mktsegment"),
    "filter_cte_twice": (["orders"], "WITH x AS (SELECT * FROM {orders} WHERE o_orderkey < 3000) SELECT count(*) AS n FROM x a JOIN x b ON a.o_orderkey = b.o_orderkey"),
    "filter_union": (["orders"], "SELECT o_orderkey FROM {orders} WHERE o_orderkey < 100 UNION ALL SELECT o_orderkey FROM {orders} WHERE o_totalprice > 400000"),
    "filter_having": (["orders"], "SELECT o_custkey, count(*) AS n FROM {orders} WHERE o_orderstatus = 'F' GROUP BY o_custkey HAVING count(*) > 8"),
    "filter_renamed_derived": (["orders"], "SELECT count(*) AS n FROM (SELECT o_orderkey - 500 AS o_orderkey FROM {orders}) d WHERE o_orderkey BETWEEN 0 AND 50"),
}


def _select(name: str):
    tables, sql = SELECTS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = sql.format(**{t: held(spark, sf_dir, t) for t in tables})
        e = engine_of(spark)
        e.sql(text)  # builds entries; nothing but the build runs
        return e.sql(text)

    run.__name__ = name
    return run


QUERIES = {name: _select(name) for name in SELECTS}
ORACLES = {name: sql.format(**{t: t for t in tables}) for name, (tables, sql) in SELECTS.items()}


def query(oracle: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _numbered(table: str, key: str) -> str:
    return f"(SELECT *, row_number() OVER (ORDER BY {key}) - 1 AS rid FROM {table})"


def _info(table: str, key: str, match: str, gone: str = "false", extra: int = 0) -> str:
    """SQL for condition_cache_info: ``gone`` tells groups that were invalidated, ``extra`` the rows inserted since. An entry
    without groups is gone: all zeros."""
    return f"""
WITH r AS (SELECT *, rid // 8192 AS g, rid // 512 AS v FROM {_numbered(table, key)}),
x AS (SELECT DISTINCT g FROM r WHERE {gone}),
n AS (SELECT count(*) + {extra} AS rows FROM r),
l AS (SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS k FROM r WHERE g NOT IN (SELECT g FROM x)),
h AS (SELECT g, v FROM r WHERE ({match}) AND g NOT IN (SELECT g FROM x))
SELECT CAST((SELECT count(DISTINCT g) FROM h) AS INTEGER) AS cached_row_groups, CAST((SELECT k * ((rows + 8191) // 8192) FROM n, l) AS INTEGER) AS total_row_groups,
CAST((SELECT count(DISTINCT v) FROM h) AS INTEGER) AS qualifying_vectors, CAST((SELECT k * ((rows + 511) // 512) FROM n, l) AS INTEGER) AS total_vectors"""


@query("SELECT rid AS rowid, o_orderkey FROM " + _numbered("orders", "o_orderkey") + " WHERE o_orderkey < 500")
def filter_project_rowid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_of(spark).sql(f"SELECT rowid, o_orderkey FROM {held(spark, sf_dir, 'orders')} WHERE o_orderkey < 500")


@query("""
WITH r AS (SELECT *, rid // 8192 AS g, rid // 512 AS v FROM """ + _numbered("orders", "o_orderkey") + """)
SELECT 'Cache Built: ' || count(DISTINCT v) FILTER (o_totalprice > 400000) || '/' || count(DISTINCT v) || ' vectors, ' || count(DISTINCT g) FILTER (o_totalprice > 400000) || '/' || count(DISTINCT g) || ' row groups' AS status FROM r""")
def cache_build_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_of(spark).sql(f"SELECT * FROM condition_cache_build('{held(spark, sf_dir, 'orders')}', 'o_totalprice > 400000')")


@query(_info("orders", "o_orderkey", "o_orderkey < 2000"))
def cache_info_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry that a SELECT left, asked for with exchanged operands."""
    e, t = engine_of(spark), held(spark, sf_dir, "orders")
    e.sql(f"SELECT count(*) FROM {t} WHERE o_orderkey < 2000")
    return e.sql(f"SELECT * FROM condition_cache_info('{t}', '2000   >  o_orderkey')")


@query("SELECT CAST(0 AS INTEGER) AS cached_row_groups, CAST(0 AS INTEGER) AS total_row_groups, CAST(0 AS INTEGER) AS qualifying_vectors, CAST(0 AS INTEGER) AS total_vectors")
def cache_info_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_of(spark).sql(f"SELECT * FROM condition_cache_info('{held(spark, sf_dir, 'orders')}', 'o_orderkey = -12345')")


@query(_info("events", "event_id", "event_type = 'error'", "event_id < 1000"))
def cache_info_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fresh(spark, sf_dir, "events", "ev_delete")
    e.sql("SELECT * FROM condition_cache_build('ev_delete', 'event_type = ''error''')")
    e.sql("DELETE FROM ev_delete WHERE event_id < 1000")
    return e.sql("SELECT * FROM condition_cache_info('ev_delete', 'event_type = ''error''')")


@query(_info("events", "event_id", "event_type = 'error'", "event_id = 9000"))
def cache_info_after_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fresh(spark, sf_dir, "events", "ev_update")
    e.sql("SELECT * FROM condition_cache_build('ev_update', 'event_type = ''error''')")
    e.sql("UPDATE ev_update SET value = value + 1 WHERE event_id = 9000")
    return e.sql("SELECT * FROM condition_cache_info('ev_update', 'event_type = ''error''')")


@query(_info("events", "event_id", "event_type = 'error'", "g = (SELECT count(*) FROM events) // 8192", 2))
def cache_info_after_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the partial last group is forgotten."""
    e = fresh(spark, sf_dir, "events", "ev_insert")
    e.sql("SELECT * FROM condition_cache_build('ev_insert', 'event_type = ''error''')")
    e.sql("INSERT INTO ev_insert (event_id, event_type) VALUES (-1, 'error'), (-2, 'click')")
    return e.sql("SELECT * FROM condition_cache_info('ev_insert', 'event_type = ''error''')")


@query(_info("events", "event_id", "event_type = 'error'", "event_id = 9500 OR g = (SELECT count(*) FROM events) // 8192", 1))
def cache_info_after_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fresh(spark, sf_dir, "events", "ev_merge")
    spark.sql("SELECT CAST(9500 AS BIGINT) AS id, 'error' AS kind UNION ALL SELECT CAST(-5 AS BIGINT), 'click'").createOrReplaceTempView("ev_merge_src")
    e.sql("SELECT * FROM condition_cache_build('ev_merge', 'event_type = ''error''')")
    e.sql("MERGE INTO ev_merge AS d USING ev_merge_src AS s ON d.event_id = s.id WHEN MATCHED THEN UPDATE SET event_type = s.kind WHEN NOT MATCHED THEN INSERT (event_id, event_type) VALUES (s.id, s.kind)")
    return e.sql("SELECT * FROM condition_cache_info('ev_merge', 'event_type = ''error''')")


COUNT = "SELECT event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM {t} WHERE event_type IN ('error', 'click') AND event_id % 7 = 3 GROUP BY event_type"


def _changed(name: str, source: str, *statements: str):
    """A query, changes, and the same query: ``source`` is SQL for the rows the table ends with."""
    table = f"t_{name}"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = fresh(spark, sf_dir, "events", table)
        e.sql(COUNT.format(t=table)).collect()
        for s in statements:
            e.sql(s.format(t=table))
        return e.sql(COUNT.format(t=table))

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = f"WITH t AS ({source}) " + COUNT.format(t="t")


_E = "event_id, event_type"
_changed("dml_delete", f"SELECT {_E} FROM events WHERE event_id >= 100", "DELETE FROM {t} WHERE event_id < 100")
_changed("dml_delete_null_safe", f"SELECT {_E} FROM events WHERE NOT coalesce(value > 10, false)", "DELETE FROM {t} WHERE value > 10")
_changed("dml_update", f"SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'error' ELSE event_type END AS event_type FROM events", "UPDATE {t} SET event_type = 'error' WHERE event_id % 50 = 0")
_changed("dml_insert", f"SELECT {_E} FROM events UNION ALL SELECT 9999997, 'error'", "INSERT INTO {t} (event_id, event_type) VALUES (9999997, 'error')")
_changed("dml_insert_select", f"SELECT {_E} FROM events UNION ALL SELECT event_id + 7000000, event_type FROM events WHERE event_id < 20000", "INSERT INTO {t} SELECT event_id + 7000000, ts, user_id, event_type, value, props FROM {t} WHERE event_id < 20000")
_changed("dml_merge", f"SELECT e.event_id, coalesce(s.k, e.event_type) AS event_type FROM events e LEFT JOIN (SELECT c_custkey * 7 + 3 AS id, 'error' AS k FROM customer) s ON s.id = e.event_id UNION ALL SELECT id, 'error' FROM (SELECT c_custkey * 7 + 3 AS id FROM customer) WHERE id NOT IN (SELECT event_id FROM events)", "MERGE INTO {t} AS d USING merge_keys AS s ON d.event_id = s.id WHEN MATCHED THEN UPDATE SET event_type = s.k WHEN NOT MATCHED THEN INSERT (event_id, event_type) VALUES (s.id, s.k)")
_changed("dml_upsert", f"SELECT event_id, CASE WHEN event_id = 3 THEN 'click' ELSE event_type END AS event_type FROM events UNION ALL SELECT 7000000 * 7 + 3, 'error'", "INSERT INTO {t} (event_id, event_type) VALUES (3, 'click'), (49000003, 'error') ON CONFLICT (event_id) DO UPDATE SET event_type = excluded.event_type")
_changed("dml_truncate", f"SELECT {_E} FROM events WHERE event_id < 500", "CREATE TABLE IF NOT EXISTS {t}_few AS SELECT * FROM {t} WHERE event_id < 500", "TRUNCATE {t}", "INSERT INTO {t} SELECT * FROM {t}_few", "DROP TABLE {t}_few")
_changed("dml_drop_recreate", "SELECT event_id + 1 AS event_id, event_type FROM events", "CREATE TABLE {t}_copy AS SELECT event_id + 1 AS event_id, event_type FROM {t}", "DROP TABLE {t}", "CREATE TABLE {t} AS SELECT * FROM {t}_copy", "DROP TABLE {t}_copy")
_changed("dml_interleaved", "SELECT event_id, CASE WHEN event_id BETWEEN 1000 AND 1999 THEN 'error' ELSE event_type END AS event_type FROM events WHERE event_id NOT BETWEEN 3000 AND 3999 UNION ALL SELECT 9999997, 'click'", "UPDATE {t} SET event_type = 'error' WHERE event_id BETWEEN 1000 AND 1999", COUNT, "DELETE FROM {t} WHERE event_id BETWEEN 3000 AND 3999", COUNT, "INSERT INTO {t} (event_id, event_type) VALUES (9999997, 'click')")

_merge = QUERIES["dml_merge"]


def dml_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/customer.parquet").select((F.col("c_custkey") * 7 + 3).alias("id"), F.lit("error").alias("k")).createOrReplaceTempView("merge_keys")
    return _merge(spark, sf_dir)


QUERIES["dml_merge"] = dml_merge


@query("SELECT count(*) AS n, CAST(0 AS INTEGER) AS cached_row_groups FROM orders WHERE o_custkey = 5")
def cache_toggle_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Off: entries are gone and none is made; answers stay."""
    e, t = engine_of(spark), held(spark, sf_dir, "orders")
    e.sql(f"SELECT count(*) FROM {t} WHERE o_custkey = 5")
    e.sql("SET use_query_condition_cache = false")
    counted = e.sql(f"SELECT count(*) AS n FROM {t} WHERE o_custkey = 5")
    info = e.sql(f"SELECT cached_row_groups FROM condition_cache_info('{t}', 'o_custkey = 5')").first()[0]
    e.sql("SET use_query_condition_cache = true")
    return counted.select("n", F.lit(info).alias("cached_row_groups"))


@query("SELECT event_type AS Component, count(*) AS n FROM events WHERE event_type <> 'view' AND value > 20 GROUP BY event_type")
def log_story(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw log lines, made here of events, are parsed, ingested and queried by a pattern."""
    e = engine_of(spark)
    level = F.when(F.col("value") > 20, "WARN").otherwise("INFO")
    line = F.concat(F.lit("2016-10-22 13:28:13,003 "), level, F.lit(" "), F.col("event_type"), F.lit(": blk_"), F.col("event_id").cast("string"))
    e.drop_table("event_logs", if_exists=True)
    e.create_table("event_logs", parse_log(spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("event_id").select(line.alias("value"))))
    text = "SELECT Component, count(*) AS n FROM event_logs WHERE Level = 'WARN' AND Content LIKE '%blk_%' AND Component <> 'view' GROUP BY Component"
    e.sql(text)
    return e.sql(text)


@query("SELECT event_type, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY event_type")
def streaming_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of files appended to a managed table that already has an entry."""
    e = engine_of(spark)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    e.drop_table("streamed", if_exists=True)
    e.create_table("streamed", rows.limit(0))
    text = "SELECT event_type, count(*) AS n FROM streamed WHERE event_id % 2 = 0 GROUP BY event_type"
    e.sql(text).collect()
    own = own_path(spark, "stream")
    stream = spark.readStream.schema(rows.schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    append_stream(e, stream, "streamed", f"{own}/{spark.sparkContext.applicationId}-{len(e.catalog.tables)}-{e.catalog._last_oid}").awaitTermination()
    return e.sql(text)


@query("""
WITH r AS (SELECT range AS id, range % 100 AS val, range // 8192 AS g, range // 512 AS v FROM range(500000)),
p AS (SELECT 'val = 42' AS predicate, g, v, val = 42 AS hit FROM r UNION ALL SELECT 'id < 3000', g, v, id < 3000 FROM r)
SELECT predicate, 'Cache Built: ' || count(DISTINCT v) FILTER (hit) || '/' || count(DISTINCT v) || ' vectors, ' || count(DISTINCT g) FILTER (hit) || '/' || count(DISTINCT g) || ' row groups' AS status FROM p GROUP BY predicate""")
def cache_build_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Builds over a table made of a range: a predicate that matches everywhere, and one that matches at the start."""
    e = engine_of(spark)
    e.drop_table("range_rows", if_exists=True)
    e.sql("CREATE TABLE range_rows AS SELECT id, id % 100 AS val FROM range(500000)")
    first, second = (e.condition_cache_build("range_rows", p).select(F.lit(p).alias("predicate"), "status") for p in ("val = 42", "id < 3000"))
    return first.union(second)


@query("SELECT c_mktsegment, count(*) AS n, min(c_acctbal) AS least FROM customer WHERE c_acctbal > 5000 GROUP BY c_mktsegment")
def csv_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as CSV, read from it, ingested and queried."""
    e, rows = engine_of(spark), spark.read.parquet(f"{sf_dir}/customer.parquet")
    path = f"{own_path(spark, 'csv')}/{spark.sparkContext.applicationId}-{e.catalog._last_oid}"
    rows.write.csv(path, header=True, mode="overwrite")
    e.drop_table("csv_customer", if_exists=True)
    e.create_table("csv_customer", read_csv(spark, path, rows.schema), order_by=["c_custkey"])
    text = "SELECT c_mktsegment, count(*) AS n, min(c_acctbal) AS least FROM csv_customer WHERE c_acctbal > 5000 GROUP BY c_mktsegment"
    e.sql(text)
    return e.sql(text)


@query("""
WITH o AS (SELECT CAST(count(*) AS VARCHAR) AS n FROM orders)
SELECT 'delete' AS change, 'INVALIDATE' AS mode, '__rid' AS row_id_column, '' AS pre_insert_rows UNION ALL SELECT 'update', 'INVALIDATE', '__rid', ''
UNION ALL SELECT 'insert', 'INSERT', '', n FROM o UNION ALL SELECT 'merge', 'MERGE', '__rid', n FROM o UNION ALL SELECT 'upsert', 'MERGE', '__rid', n FROM o""")
def explain_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the explanations of changes say, one row a statement, '' where they say nothing. Nothing is changed."""
    e, t = engine_of(spark), held(spark, sf_dir, "orders")
    statements = {
        "delete": f"DELETE FROM {t} WHERE o_orderkey < 10",
        "update": f"UPDATE {t} SET o_totalprice = 0 WHERE o_orderkey < 10",
        "insert": f"INSERT INTO {t} SELECT * FROM {t}",
        "merge": f"MERGE INTO {t} AS d USING {t} AS s ON d.o_orderkey = s.o_orderkey WHEN MATCHED THEN DELETE",
        "upsert": f"INSERT INTO {t} SELECT * FROM {t} ON CONFLICT (o_orderkey) DO NOTHING",
    }
    rows = []
    for name, text in statements.items():
        said = dict(line.split(": ", 1) for line in e.explain_dml(text).split("\n")[1:])
        rows.append((name, said["Mode"], said.get("Row ID Column", ""), said.get("Pre-insert Rows", "")))
    return spark.createDataFrame(rows, "change string, mode string, row_id_column string, pre_insert_rows string")


@query("""
SELECT (SELECT count(*) FROM orders WHERE o_orderkey < 2000) AS n, CAST(0 AS INTEGER) AS automatic, CAST(count(DISTINCT v) AS INTEGER) AS by_hand
FROM (SELECT *, rid // 512 AS v FROM """ + _numbered("orders", "o_orderkey") + """) WHERE o_orderkey < 2000""")
def indexed_by_hand_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with a key gets no entry from a query, and one from a build by hand."""
    e = engine_of(spark)
    e.drop_table("orders_keyed", if_exists=True)
    e.create_table("orders_keyed", spark.read.parquet(f"{sf_dir}/orders.parquet"), order_by=["o_orderkey"], primary_key=["o_orderkey"])
    counted = e.sql("SELECT count(*) AS n FROM orders_keyed WHERE o_orderkey < 2000")
    vectors = lambda: e.condition_cache_info("orders_keyed", "o_orderkey < 2000").first()["qualifying_vectors"]
    automatic = vectors()
    e.condition_cache_build("orders_keyed", "o_orderkey < 2000")
    return counted.select("n", F.lit(automatic).alias("automatic"), F.lit(vectors()).alias("by_hand"))


@query("SELECT count(*) AS n, false AS cached FROM orders WHERE o_orderkey < 2000")
def unstable_left_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate whose value can change without the data leaves no entry; answers are right."""
    e = fresh(spark, sf_dir, "orders", "orders_unstable")
    counted = e.sql("SELECT count(*) AS n FROM orders_unstable WHERE o_orderkey < 2000 AND rand() >= 0")
    return counted.select("n", F.lit(e.store.has_entries(e._table("orders_unstable").oid)).alias("cached"))


@query("""
WITH r AS (SELECT *, rid // 512 AS v FROM """ + _numbered("orders", "o_orderkey") + """)
SELECT 'F' AS status, CAST(count(DISTINCT v) FILTER (o_orderstatus = 'F') AS INTEGER) AS vectors FROM r UNION ALL SELECT 'O', CAST(0 AS INTEGER)
UNION ALL SELECT 'P', CAST(count(DISTINCT v) FILTER (o_orderstatus = 'P') AS INTEGER) FROM r""")
def cache_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three entries under a budget for two: the one that was used least recently is gone."""
    e = Engine(spark, geometry=SMALL)
    e.create_table("orders_evicted", spark.read.parquet(f"{sf_dir}/orders.parquet"), order_by=["o_orderkey"])
    vectors = lambda s: e.condition_cache_info("orders_evicted", f"o_orderstatus = '{s}'").first()["qualifying_vectors"]
    build = lambda s: e.condition_cache_build("orders_evicted", f"o_orderstatus = '{s}'")
    build("F")
    e.store.budget_bytes = 2 * sum(e.store._sizes.values())
    build("O")
    vectors("F")  # a look counts as a use
    build("P")
    return spark.createDataFrame([(s, vectors(s)) for s in "FOP"], "status string, vectors int")


@query("""
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, count(DISTINCT user_id) AS users, CAST(floor(epoch(min(ts))) AS BIGINT) AS first_second FROM events
WHERE event_type = 'error' AND CAST(ts AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-01-20' GROUP BY CAST(ts AS DATE)""")
def hits_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web hits whose days and times come as numbers, made here of events, ingested with dates and timestamps."""
    e = engine_of(spark)
    day = F.unix_date(F.to_date("ts")).cast("int").alias("EventDate")
    second = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))").alias("seconds")
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("event_id").select(day, second, F.col("user_id").alias("UserID"), F.col("event_type").alias("Kind"))
    e.drop_table("hits", if_exists=True)
    e.create_table("hits", with_event_times(raw, day="EventDate", times={"EventTime": "seconds"}))
    text = "SELECT CAST(EventDate AS STRING) AS day, count(*) AS n, count(DISTINCT UserID) AS users, min(unix_seconds(EventTime)) AS first_second FROM hits WHERE Kind = 'error' AND EventDate BETWEEN DATE '2024-01-02' AND DATE '2024-01-20' GROUP BY EventDate"
    e.sql(text)
    return e.sql(text)
