"""Goldens of the cache's functions and setting, keys, DML, and the rule that skipping never changes a result."""

import random

import pytest
from pyspark.sql import functions as F

from skiplight import Engine, Geometry
from skiplight.engine import EngineError, scan_metrics
from skiplight.plans.keys import Uncacheable, children
from skiplight.plans.rewrite import key_of
from skiplight.sources.readers import read_csv, read_logs, with_event_times


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark)


def rows(engine, sql):
    return [tuple(r) for r in engine.sql(sql).collect()]


def one(engine, sql):
    return rows(engine, sql)[0][0]


@pytest.fixture(scope="module")
def t(engine):
    engine.sql("CREATE TABLE t AS SELECT id, id % 100 AS val FROM range(500000)")
    return engine


def test_build(t):
    for sql, status in (("val = 42", "245/245 vectors, 5/5"), ("id < 3000", "2/245 vectors, 1/5"), ("val = 42", "245/245 vectors, 5/5")):
        for name in ("t", "main.t", "memory.main.t"):
            assert rows(t, f"SELECT status FROM condition_cache_build('{name}', '{sql}')") == [(f"Cache Built: {status} row groups",)]


def test_build_errors(t):
    for args, text in (("'nonexistent', 'val = 42'", "Table with name nonexistent does not exist"), ("'t', 'invalid_col = 42'", "does not contain column invalid_col"), ("'bad_schema.t', 'val = 42'", 'schema "bad_schema" does not exist'), ("'bad_catalog.main.t', 'val = 42'", 'Catalog "bad_catalog" does not exist'), ("'t', ''", "failed to parse predicate"), ("'t', '   '", "failed to parse predicate")):
        with pytest.raises(EngineError, match=text):
            t.sql(f"SELECT * FROM condition_cache_build({args})")
    with pytest.raises(EngineError, match="Table with name nonexistent"):
        t.sql("SELECT * FROM condition_cache_info('nonexistent', 'val = 42')")
    t.sql("CREATE TABLE t_str AS SELECT 'hello' AS name")
    with pytest.raises(EngineError, match="Could not convert string"):
        t.sql("SELECT * FROM condition_cache_build('t_str', 'name')")


def test_info_and_automatic_build(t):
    info = "SELECT * FROM condition_cache_info('t', '{}')"
    t.store.clear()
    assert rows(t, info.format("val = 42")) == [(0, 0, 0, 0)]
    assert one(t, "SELECT count(*) FROM t WHERE val = 42") == 5000
    for p in ("val = 42", "val=42", "val  =   42", "42 = val"):
        assert rows(t, info.format(p)) == [(5, 5, 245, 245)]
    assert rows(t, info.format("val = 99")) == rows(t, info.format("  ")) == [(0, 0, 0, 0)]
    assert one(t, "SELECT count(*) FROM t WHERE id < 3000") == 3000
    assert rows(t, info.format("id < 3000")) == [(1, 5, 2, 245)]
    assert [f.dataType.simpleString() for f in t.sql(info.format("val = 1")).schema] == ["int"] * 4
    # the cache's functions inside a larger query
    assert rows(t, "SELECT qualifying_vectors + 1 AS q FROM condition_cache_info('t', 'id < 3000') WHERE total_vectors = 245") == [(3,)]


def test_setting(t):
    t.sql("SELECT count(*) FROM t WHERE val = 42")
    t.sql("SET use_query_condition_cache = false")
    assert not t.enabled
    t.sql("SELECT count(*) FROM t WHERE val = 99")
    for v in (99, 42):
        assert rows(t, f"SELECT * FROM condition_cache_info('t', 'val = {v}')") == [(0, 0, 0, 0)]
    t.sql("SELECT * FROM condition_cache_build('t', 'val = 1')")  # a manual build works while it is off
    assert one(t, "SELECT cached_row_groups FROM condition_cache_info('t', 'val = 1')") == 5
    t.sql("SET use_query_condition_cache = true")


def test_skipping_is_real(t, spark):
    small = Engine(spark, geometry=Geometry(8192, 512))
    small.create_table("scattered", spark.range(100_000), order_by=["id"])
    sql = "SELECT count(*) FROM scattered WHERE id % 20011 = 7"  # no statistics help here
    plain = small.spark.sql(sql)
    n = plain.collect()
    small.sql(sql)
    fast = small.sql(sql)
    assert fast.collect() == n
    assert scan_metrics(plain)["numOutputRows"] == 100_000
    assert scan_metrics(fast) == {"numFiles": 5, "numOutputRows": 5 * 512}
    none = small.sql("SELECT count(*) FROM scattered WHERE id % 20011 = 30000")
    assert none.collect()[0][0] == 0 and scan_metrics(none)["numOutputRows"] == 0


def test_rowid_and_projection(t):
    assert rows(t, "SELECT rowid, id FROM t WHERE id < 3 ORDER BY 1") == [(0, 0), (1, 1), (2, 2)]
    assert t.sql("SELECT * FROM t WHERE id < 3").columns == ["id", "val"]


def key(engine, predicate):
    plan = engine.spark.sql(f"SELECT * FROM k WHERE {predicate}")._jdf.queryExecution().analyzed()
    return key_of([children(plan)[0].condition()])


def test_keys(engine):
    engine.sql("CREATE TABLE IF NOT EXISTS k (id INT, val INT, name STRING, at TIMESTAMP)")
    same = [("val = 42", "42 = val"), ("id < 100", "100 > id"), ("val <= 50", "50 >= val"), ("val > 10", "10 < val"), ("val >= 10", "10 <= val"), ("val != 0", "0 != val"), ("id = val", "val = id"), ("val = 42 AND id < 100", "42 = val AND 100 > id"), ("val = 42 OR id > 100", "42 = val OR 100 < id"), ("name = 'hello'", "'hello' = name"), ("val = 42 OR val = 99", "val = 99 OR val = 42"), ("val = 42 AND id < 100", "id < 100 AND val = 42"), ("(val = 42 AND id < 100) OR val = 99", "val = 99 OR (id < 100 AND val = 42)"), ("val = 42 OR val = 99", "99 = val OR 42 = val"), ("val = 42", "val  =   42"), ("val = 42 AND id < 100 AND name = 'hello'", "name = 'hello' AND val = 42 AND id < 100"), ("1 = 2", "2 = 1"), ("1 < 2", "2 > 1"), ("VAL = 42", "k.val = 42"), ("val <=> NULL", "NULL <=> val")]
    for a, b in same:
        assert key(engine, a) == key(engine, b), (a, b)
    different = ["val = 42", "val < 42", "val = 43", "id = 42", "name = '42'", "val = 42 OR id = 1", "val = 42 AND id = 1", "name LIKE 'a%'", "name LIKE 'a%' ESCAPE '!'", "val IN (1, 2)", "val IN (1, 3)", "CAST(val AS STRING) = '1'", "CAST(val AS BIGINT) % 2 = 1", "val BETWEEN 1 AND 2", "val BETWEEN 1 AND 3", "id BETWEEN 1 AND 2", "name = 'And(a, b)'", "NOT val = 42"]
    assert len({key(engine, p) for p in different}) == len(different)
    for p in ("rand() < 0.5", "at < current_timestamp()", "at < now()", "id IN (SELECT id FROM k)", "unix_timestamp() > id", "name = current_user()", "to_date(at) = current_date()"):
        with pytest.raises(Uncacheable):
            key(engine, p)


def test_nondeterministic_predicates_are_left_alone(t):
    t.store.clear()
    t.sql("SELECT count(*) FROM t WHERE rand() < 0.5").collect()
    assert len(t.store) == 0
    with pytest.raises(EngineError, match="can't be cached"):
        t.sql("SELECT * FROM condition_cache_build('t', 'rand() < 0.5')")


def test_indexed_tables_are_built_by_hand_only(engine, spark):
    engine.create_table("pk", spark.range(1000), primary_key=["id"])
    engine.sql("SELECT count(*) FROM pk WHERE id < 5").collect()
    assert not engine.store.has_entries(engine._table("pk").oid)
    assert one(engine, "SELECT status FROM condition_cache_build('pk', 'id < 5')") == "Cache Built: 1/1 vectors, 1/1 row groups"


def test_invalidation_counts(engine):
    engine.sql("SET use_query_condition_cache = false")
    engine.sql("CREATE TABLE inv AS SELECT id, id % 100 AS val FROM range(130000)")
    p = "val = 42 AND id % 2 = 0"
    engine.sql(f"SELECT * FROM condition_cache_build('inv', '{p}')")
    got = [one(engine, f"SELECT cached_row_groups FROM condition_cache_info('inv', '{p}')")]
    for sql in ("DELETE FROM inv WHERE id < 1000", "UPDATE inv SET val = val + 1 WHERE id = 125000"):
        engine.sql(sql)
        got.append(one(engine, f"SELECT cached_row_groups FROM condition_cache_info('inv', '{p}')"))
    engine.sql("SET use_query_condition_cache = true")
    assert got == [2, 1, 0]


FLAGS = "SELECT id, CAST(CASE WHEN id <= 10 THEN 1 ELSE 0 END AS INT) AS flag FROM range(200000)"


@pytest.mark.parametrize("name,create,query,steps", [
    ("one", FLAGS, "SELECT count(*) FROM {t} WHERE flag = 1", [11, "UPDATE {t} SET flag = 1 WHERE id = 100000", 12]),
    ("bulk", FLAGS, "SELECT count(*) FROM {t} WHERE flag = 1", [11, "UPDATE {t} SET flag = 1 WHERE id % 2048 = 1000 AND id > 2048", 108]),
    ("off", FLAGS, "SELECT count(*) FROM {t} WHERE flag = 1", [11, "UPDATE {t} SET flag = 0 WHERE id = 5", 10]),
    ("del", FLAGS, "SELECT count(*) FROM {t} WHERE flag = 1", [11, "DELETE FROM {t} WHERE id = 5", 10]),
    ("ins", FLAGS, "SELECT count(*) FROM {t} WHERE flag = 1", [11, "INSERT INTO {t} VALUES (999999, 1)", 12]),
    ("multi", FLAGS.replace("id <= 10", "id % 50000 = 0"), "SELECT count(*) FROM {t} WHERE flag = 1", [4, "UPDATE {t} SET flag = 1 WHERE id = 75000", 5, "DELETE FROM {t} WHERE id = 0", 4, "INSERT INTO {t} VALUES (999999, 1)", 5, "UPDATE {t} SET flag = 0 WHERE id = 75000", 4]),
    ("sum", "SELECT id, id AS val FROM range(200000)", "SELECT sum(val) FROM {t} WHERE val < 2048", [2096128, "UPDATE {t} SET val = 0 WHERE id BETWEEN 100 AND 199", 2081178]),
    ("trunc", FLAGS, "SELECT count(*) FROM {t} WHERE flag = 1", [11, "TRUNCATE {t}", 0, "INSERT INTO {t} SELECT id, CASE WHEN id = 50000 THEN 1 ELSE 0 END FROM range(200000)", 1]),
    ("part", "SELECT id, CAST(CASE WHEN id < 10 THEN 1 ELSE 0 END AS INT) AS flag FROM range(130000)", "SELECT count(*) FROM {t} WHERE flag = 1", [10, "INSERT INTO {t} VALUES (999999, 1)", 11, "INSERT INTO {t} SELECT id + 1000000, CASE WHEN id = 0 THEN 1 ELSE 0 END FROM range(200000)", 12]),
    ("drop", FLAGS, "SELECT count(*) FROM {t} WHERE flag = 1", [11, "DROP TABLE {t}", "CREATE TABLE {t} AS SELECT id, CASE WHEN id = 50000 THEN 1 ELSE 0 END AS flag FROM range(200000)", 1]),
])
def test_answers_follow_changes(engine, name, create, query, steps):
    table = f"c_{name}"
    engine.sql(f"CREATE TABLE {table} AS {create}")
    for s in steps:
        if isinstance(s, int):
            assert one(engine, query.format(t=table)) == s
        else:
            engine.sql(s.format(t=table))
    engine.drop_table(table)


def test_merge_and_upsert(engine, spark):
    engine.sql(f"CREATE TABLE dst AS {FLAGS}")
    engine.sql("CREATE TABLE src (id INT, flag INT)")
    engine.sql("INSERT INTO src VALUES (5, 0), (100000, 1), (300000, 1)")
    q = "SELECT count(*) FROM dst WHERE flag = 1"
    assert one(engine, q) == 11
    engine.sql("MERGE INTO dst AS dst USING src AS src ON dst.id = src.id WHEN MATCHED THEN UPDATE SET flag = src.flag WHEN NOT MATCHED THEN INSERT VALUES (src.id, src.flag)")
    assert one(engine, q) == 12
    engine.sql("INSERT INTO dst VALUES (300000, 0), (300001, 1) ON CONFLICT (id) DO UPDATE SET flag = excluded.flag")
    assert one(engine, q) == 12
    engine.sql("INSERT INTO dst VALUES (300001, 0), (300002, 1) ON CONFLICT (id) DO NOTHING")
    assert one(engine, q) == 13
    engine.sql("MERGE INTO dst AS d USING src AS s ON d.id = s.id WHEN MATCHED AND s.flag = 1 THEN DELETE WHEN MATCHED THEN UPDATE SET flag = 1")
    assert one(engine, q) == 13  # 5 counts again, 100000 is gone; 300000 was 0
    twice = spark.createDataFrame([(7, 1), (7, 0)], "id long, flag int")
    with pytest.raises(ValueError, match="more than one source row"):
        engine.upsert("dst", twice, "id")
    assert one(engine, q) == 13
    assert rows(engine, "SELECT count(*), count(DISTINCT rowid) FROM dst") == [(200001, 200001)]


def test_isolation_and_growth(engine, spark):
    engine.create_table("a", spark.range(1000).select("id", (F.col("id") % 10).alias("v")), geometry=Geometry(512, 64))
    engine.create_table("b", spark.range(1000).select("id", (F.col("id") % 10).alias("v")), geometry=Geometry(512, 64))
    for n in "ab":
        engine.sql(f"SELECT count(*) FROM {n} WHERE v = 3").collect()
    engine.sql("DELETE FROM a WHERE id = 700")
    info = "SELECT * FROM condition_cache_info('{}', 'v = 3')"
    assert rows(engine, info.format("a"))[0][0] == 1 and rows(engine, info.format("b"))[0][0] == 2
    engine.insert("b", spark.range(1000, 1020).select("id", F.lit(3).cast("long").alias("v")))
    assert rows(engine, info.format("b")) == [(1, 2, 8, 16)]
    assert one(engine, "SELECT count(*) FROM b WHERE v = 3") == 120
    kept = engine.sql("SELECT count(*) FROM b WHERE v = 3")
    engine.sql("DELETE FROM b WHERE v = 3")
    assert kept.collect()[0][0] == 120  # a snapshot stays as it was
    assert one(engine, "SELECT count(*) FROM b WHERE v = 3") == 0


def test_explain(engine):
    oid = engine._table("k").oid
    assert engine.explain_dml("DELETE FROM k WHERE id = 1").split("\n") == ["CACHE_INVALIDATOR", f"Table OID: {oid}", "Mode: INVALIDATE", "Row ID Column: __rid"]
    assert "Mode: INSERT" in engine.explain_dml("INSERT INTO k VALUES (1, 2, 'a', NULL)")
    assert "Mode: MERGE" in engine.explain_dml("MERGE INTO k USING k AS s ON k.id = s.id WHEN MATCHED THEN DELETE")
    assert "Mode: MERGE" in engine.explain_dml("INSERT INTO k VALUES (1, 2, 'a', NULL) ON CONFLICT (id) DO NOTHING")


def test_tables_can_be_opened_again(spark, tmp_path):
    first = Engine(spark, root=f"file://{tmp_path}")
    table = first.create_table("kept", spark.range(100), geometry=Geometry(64, 8))
    first.sql("DELETE FROM kept WHERE id < 70")
    second = Engine(spark, root=f"file://{tmp_path}")
    second.open_table(table.path)
    assert one(second, "SELECT count(*) FROM kept WHERE id > 5") == 30
    second.sql("INSERT INTO kept VALUES (1000)")
    assert one(second, "SELECT max(rowid) FROM kept") == 100


def test_every_change_can_be_opened_again(spark, tmp_path):
    root = f"file://{tmp_path}"
    first = Engine(spark, root=root, geometry=Geometry(64, 8))
    table = first.create_table("d", spark.range(100).selectExpr("id", "id % 7 AS v"), primary_key=["id"])

    def again(sql="SELECT count(*), sum(v) FROM d"):
        second = Engine(spark, root=root)
        second.open_table(table.path)
        return rows(second, sql)[0]

    for change in ("INSERT INTO d VALUES (200, 3)", "UPDATE d SET v = 100 WHERE id = 5", "DELETE FROM d WHERE id BETWEEN 10 AND 20", "INSERT INTO d VALUES (200, 9), (201, 9) ON CONFLICT (id) DO NOTHING", "MERGE INTO d USING (SELECT 1 AS id UNION ALL SELECT 777) s ON d.id = s.id WHEN MATCHED THEN DELETE WHEN NOT MATCHED THEN INSERT (id, v) VALUES (s.id, 1)", "TRUNCATE TABLE d"):
        first.sql(change)
        assert again() == rows(first, "SELECT count(*), sum(v) FROM d")[0], change
    assert again()[0] == 0
    first.sql("INSERT INTO d VALUES (1, 1)")
    second = Engine(spark, root=root)
    second.open_table(table.path)
    second.sql("INSERT INTO d VALUES (1, 5), (2, 6) ON CONFLICT DO NOTHING")  # the snapshot knows the key
    assert rows(second, "SELECT count(*), sum(v) FROM d")[0] == (2, 7)
    empty = first.create_table("nothing", spark.range(0))
    second.open_table(empty.path)
    assert one(second, "SELECT count(*) FROM nothing") == 0


def test_a_merge_is_seen_as_a_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    from skiplight.operators import dml

    engine = Engine(spark, root=f"file://{tmp_path}", geometry=Geometry(64, 8))
    table = engine.create_table("m", spark.range(100).selectExpr("id", "0 AS v"))
    text = "MERGE INTO m USING (SELECT id FROM range(90, 110)) s ON m.id = s.id WHEN MATCHED THEN UPDATE SET v = 1 WHEN NOT MATCHED THEN INSERT (id, v) VALUES (s.id, 2)"
    for name in ("write_groups", "written_groups", "save_manifest"):
        with monkeypatch.context() as m:
            m.setattr(dml, name, lambda *a: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                engine.sql(text)
        second = Engine(spark, root=f"file://{tmp_path}")
        second.open_table(table.path)
        assert rows(second, "SELECT count(*), sum(v) FROM m") == rows(engine, "SELECT count(*), sum(v) FROM m") == [(100, 0)], name
        engine = second if name == "written_groups" else engine
    engine.sql(text)
    assert rows(engine, "SELECT count(*), sum(v), max(rowid) FROM m") == [(110, 30, 109)]


def test_a_source_of_a_merge_is_evaluated_once(spark, tmp_path):
    engine = Engine(spark, root=f"file://{tmp_path}", geometry=Geometry(64, 8))
    table = engine.create_table("r", spark.range(50).selectExpr("id", "0 AS v"))
    source = spark.range(40).select((F.rand() * 100).cast("long").alias("id")).distinct().alias("s")
    touched = engine.changes.merge(table, source, F.col("r.id") == F.col("s.id"), matched=[(None, {"v": F.lit(1)})], not_matched=[(None, {"id": F.col("s.id"), "v": F.lit(2)})], source_alias="s")
    n, distinct = rows(engine, "SELECT count(*), count(DISTINCT id) FROM r")[0]
    assert n == distinct == 50 + touched[1]  # a source that changes between its uses would insert ids that exist


def test_a_stream_resumes_where_its_table_is(spark, tmp_path):
    first = Engine(spark, root=f"file://{tmp_path}")
    table = first.create_table("s", spark.range(10))
    assert first.insert("s", spark.range(5), batch=("q", 0)) == 5
    second = Engine(spark, root=f"file://{tmp_path}")
    second.open_table(table.path)
    assert second.insert("s", spark.range(5), batch=("q", 0)) == 0 and second.insert("s", spark.range(5), batch=("p", 0)) == 5
    assert second.insert("s", spark.range(5), batch=("q", 1)) == 5 and one(second, "SELECT count(*) FROM s") == 25


def test_queries_and_changes_from_several_threads(spark):
    from concurrent.futures import ThreadPoolExecutor

    engine = Engine(spark, geometry=Geometry(512, 64))
    engine.create_table("c", spark.range(4000).selectExpr("id", "id % 10 AS v"))

    def work(i):
        if i % 3 == 0:
            engine.sql(f"DELETE FROM c WHERE id = {i}")
        elif i % 3 == 1:
            engine.insert("c", spark.range(1).selectExpr(f"CAST({10_000 + i} AS BIGINT) AS id", "CAST(3 AS BIGINT) AS v"))
        return one(engine, "SELECT count(*) FROM c WHERE v = 3")

    with ThreadPoolExecutor(4) as pool:
        seen = list(pool.map(work, range(12)))
    assert all(398 <= n <= 404 for n in seen)
    assert one(engine, "SELECT count(*) FROM c WHERE v = 3") == 400 - sum(i % 10 == 3 for i in range(0, 12, 3)) + 4
    assert one(engine, "SELECT count(*) FROM c") == 4000


def test_sources(spark, tmp_path):
    (tmp_path / "a.log").write_text("2016-10-22 13:28:13,003 INFO org.apache.Foo: blk_1 added\nnoise\n2016-10-22 13:28:14,004 WARN Bar: lost: blk_2\n")
    got = [tuple(r) for r in read_logs(spark, str(tmp_path / "a.log")).orderBy("Time").collect()]
    assert got == [("2016-10-22", "13:28:13", "INFO", "org.apache.Foo", "blk_1 added", "a.log"), ("2016-10-22", "13:28:14", "WARN", "Bar", "lost: blk_2", "a.log")]
    (tmp_path / "b.csv").write_text("x,y\n1,a\nbad,b\n3,c\n")
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "b.csv"), "x int, y string").collect()] == [(1, "a"), (3, "c")]
    row = with_event_times(spark.createDataFrame([(1, 60)], "d int, s long"), day="d", times={"at": "s"}).selectExpr("string(d)", "string(at)").first()
    assert tuple(row) == ("1970-01-02", "1970-01-01 00:01:00")


PREDICATES = ["v = {0}", "v < {0} AND id > {1}", "v IN ({0}, {1}) OR s LIKE '%{0}%'", "id BETWEEN {1} AND {1} + 200", "s IS NULL", "NOT (v > {0})", "CASE WHEN v = {0} THEN id < {1} ELSE false END", "id % 97 = {0}", "s = 'x{0}' AND v >= 0"]


@pytest.mark.parametrize("geometry", [(4096, 64), (512, 64), (8192, 64)])
def test_random_changes_never_change_answers(spark, geometry):
    """Random queries and changes against the same statements on a plain list of rows."""
    rng = random.Random(geometry[0])
    engine = Engine(spark, geometry=Geometry(*geometry))
    n = 6000
    base = spark.range(n).selectExpr("id", "CAST(id * 7919 % 50 AS INT) AS v", "CASE WHEN id % 11 = 0 THEN NULL ELSE concat('x', id % 23) END AS s")
    engine.create_table("fz", base)
    plain = base.toPandas().convert_dtypes()
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE fz AS SELECT * FROM plain")
    for step in range(14):
        a, b = rng.randrange(50), rng.randrange(n)
        p = rng.choice(PREDICATES).format(a, b)
        for _ in range(2):
            sql = f"SELECT count(*) AS n, CAST(sum(id) AS BIGINT) AS s FROM fz WHERE {p}"
            assert rows(engine, sql)[0] == con.execute(sql).fetchall()[0], (step, p)
        change = rng.choice([f"DELETE FROM fz WHERE id BETWEEN {b} AND {b} + 40", f"UPDATE fz SET v = {a}, s = 'x{a}' WHERE id % 101 = {a}", f"INSERT INTO fz SELECT id + 100000 * {step + 1}, {a}, 'x{a}' FROM fz WHERE v = {a}", f"DELETE FROM fz WHERE v = {a}"])
        engine.sql(change)
        con.execute(change)
    engine.drop_table("fz")
