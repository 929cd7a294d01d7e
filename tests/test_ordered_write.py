"""Ingest in the order of keys: what it moves, and the rows, ids and files it leaves."""

import os
import random

from pyspark.sql import functions as F

from skiplight import Engine, Geometry
from skiplight.sources.layout import GROUP, RID, rows_of

from .conftest import SF

SMALL = Geometry(512, 64)


def shuffled(spark, run):
    """Bytes that ``run`` writes to shuffles."""
    sc = spark._jsc.sc()
    before = sc.dagScheduler().nextStageId()
    run()
    sc.listenerBus().waitUntilEmpty()
    total = 0
    for i in range(before, sc.dagScheduler().nextStageId()):
        try:
            total += sc.statusStore().lastStageAttempt(i).shuffleWriteBytes()
        except Exception:  # a stage that never ran
            pass
    return total


def most_held(spark, run):
    """Most bytes that a task of ``run`` holds for sorting at once, and bytes that spill."""
    sc = spark._jsc.sc()
    before = sc.dagScheduler().nextStageId()
    run()
    sc.listenerBus().waitUntilEmpty()
    peak = spilled = 0
    for i in range(before, sc.dagScheduler().nextStageId()):
        try:
            stage = sc.statusStore().lastStageAttempt(i)
        except Exception:  # a stage that never ran
            continue
        tasks = sc.statusStore().taskList(i, stage.attemptId(), 1000)
        peak = max([peak, *(tasks.apply(k).taskMetrics().get().peakExecutionMemory() for k in range(tasks.size()))])
        spilled += stage.memoryBytesSpilled()
    return peak, spilled


def checkpointed(spark):
    top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return sum(len(files) for _, _, files in os.walk(top))


def made(spark, rows, order_by, geometry=SMALL):
    engine = Engine(spark, geometry=geometry)
    return engine, engine.create_table("ordered", rows, order_by=order_by)


def check(spark, table, rows, order_by):
    """Contiguous ids in the order of the keys, no row lost, and one file a group."""
    got = rows_of(spark, table).orderBy(RID)
    ids = [r[0] for r in got.select(RID).collect()]
    assert ids == list(range(len(ids))) and table.next_rid == len(ids)
    keys = [F.col(k).cast("string") for k in order_by]
    assert [tuple(r) for r in got.select(*keys).collect()] == [tuple(r) for r in rows.orderBy(*order_by).select(*keys).collect()]
    assert sorted(map(str, got.select(*table.columns).collect())) == sorted(map(str, rows.collect()))
    files = rows_of(spark, table).withColumn("__file", F.col("_metadata.file_path")).groupBy(GROUP).agg(F.countDistinct("__file"), F.min(RID), F.max(RID), F.count(RID)).collect()
    size = table.geometry.row_group_size
    assert sorted(r[0] for r in files) == sorted(table.groups)
    assert all(n == 1 and first == g * size and count == last - first + 1 for g, n, first, last, count in files)


def test_rows_are_shuffled_once_and_not_checkpointed(spark):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet")
    once = shuffled(spark, lambda: rows.repartition(4, "l_orderkey").write.format("noop").mode("overwrite").save())
    engine, before = Engine(spark, geometry=SMALL), checkpointed(spark)
    moved = shuffled(spark, lambda: engine.create_table("ordered", rows, order_by=["l_orderkey", "l_linenumber"]))
    assert checkpointed(spark) == before
    assert once < moved < 1.6 * once  # the sixth part that is put together again included
    check(spark, engine.catalog.get("ordered"), rows, ["l_orderkey", "l_linenumber"])


def test_ties_nulls_and_odd_numbers_keep_their_order(spark):
    number = F.expr("CASE id % 7 WHEN 0 THEN NULL WHEN 1 THEN double('NaN') WHEN 2 THEN -0.0D WHEN 3 THEN 0.0D WHEN 4 THEN -1.5D ELSE double(id % 5) END")
    rows = spark.range(0, 5000, 1, 7).select(number.alias("a"), F.when(F.col("id") % 11 > 0, (F.col("id") * 37 % 101).cast("string")).alias("b"), F.col("id").alias("bucket"))
    _, table = made(spark, rows, ["b", "bucket"])
    check(spark, table, rows, ["b", "bucket"])
    _, table = made(spark, rows, ["a", "bucket"])
    positive = lambda df: df.select(F.expr("a + 0.0D").cast("string"), "bucket").collect()  # noqa: E731  -0.0 and 0.0 are equal
    assert positive(rows_of(spark, table).orderBy(RID)) == positive(rows.orderBy("a", "bucket"))


def test_one_key_for_all_rows(spark):
    rows = spark.range(3000).select(F.lit(1).alias("k"), F.col("id"))
    _, table = made(spark, rows, ["k"])
    check(spark, table, rows, ["k"])


def test_ordered_rows_behind_a_partial_group(spark):
    engine, table = made(spark, spark.range(700), ["id"])
    engine.changes.insert(table, spark.range(700, 4000).orderBy(F.desc("id")), ["id"])
    check(spark, table, spark.range(4000), ["id"])


def test_rows_that_differ_at_each_evaluation_are_numbered_once(spark):
    often = F.udf(lambda x: random.random() < 0.5, "boolean").asNondeterministic()
    engine, table = made(spark, spark.range(6000).where(often("id")), ["id"])
    ids = [r[0] for r in rows_of(spark, table).orderBy("id").select(RID).collect()]
    assert ids == list(range(table.next_rid)) and 2000 < len(ids) < 4000
    assert engine.sql("SELECT count(DISTINCT id) FROM ordered").first()[0] == len(ids)


def test_a_range_of_keys_is_counted_over_rows_that_were_not_checkpointed(spark):
    rows, before = spark.read.parquet(f"{SF}/lineitem.parquet"), checkpointed(spark)
    engine, _ = made(spark, rows, ["l_orderkey", "l_linenumber"])
    text = "SELECT count(*) FROM ordered WHERE l_orderkey < 1000"
    assert [engine.sql(text).first()[0] for _ in range(2)] == [rows.where("l_orderkey < 1000").count()] * 2
    assert checkpointed(spark) == before


def test_tasks_sort_few_bytes_however_many_there_are(spark):
    """400 MB in four tasks would hold 200 MB each: an executor with little memory spills them."""
    rows = spark.range(0, 80_000, 1, 4).select((F.col("id") * 7919 % 80_000).alias("id"), F.expr("repeat(char(97 + id % 26), 5000)").alias("text"))
    engine = Engine(spark, geometry=SMALL)
    peak, spilled = most_held(spark, lambda: engine.create_table("ordered", rows, order_by=["id"]))
    assert peak < 150 << 20 and not spilled
    ids = engine.sql("SELECT id, rowid FROM ordered").collect()
    assert len(ids) == 80_000 and all(a == b for a, b in ids)
