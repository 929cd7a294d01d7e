import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skiplight.llm.mixing import poisson_table, rates, replicate, uniform


def test_tables_and_uniforms(spark):
    for mean in (0.0, 0.3, 2.5, 16.0):
        got = spark.range(1).select(poisson_table(F.lit(mean)).alias("c")).first()["c"]
        want, p = [], math.exp(-mean)
        for k in range(97):
            want.append((want[-1] if want else 0) + p)
            p *= mean / (k + 1)
        assert got == pytest.approx(want, abs=1e-12) and got[-1] == pytest.approx(1, abs=1e-9)
    u = [r[0] for r in spark.range(4000).select(uniform(F.lit("s"), F.col("id").cast("string"))).collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(sum(u) / 4000 - 0.5) < 0.03


def test_repetition_follows_the_target(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 3 = 1 THEN 'b' ELSE 'c' END AS source")
    weights = {"a": 1.0, "b": 3.0}
    rate = {r["_mix_source"]: r["rate"] for r in rates(docs, weights=weights).collect()}
    assert rate["sb"] / rate["sa"] == pytest.approx(3, rel=0.02) and rate["sc"] == 1.0
    got = replicate(docs, weights=weights).groupBy("source").count()
    n = {r["source"]: r["count"] / 2000 for r in got.collect()}
    for s in "abc":
        assert n[s] == pytest.approx(rate["s" + s], rel=0.1)
    # a mean of 40 is drawn in parts; its counts have the mean and the variance of a Poisson number
    many = replicate(docs.where("source = 'a'"), weights={"a": 1.0}, total=40.0 * docs.where("source = 'a'").agg(F.sum(F.length("text"))).first()[0])
    counts = [r["count"] for r in many.groupBy("doc_id").count().collect()]
    mean = sum(counts) / 2000
    assert mean == pytest.approx(40, rel=0.02) and sum((c - mean) ** 2 for c in counts) / 2000 == pytest.approx(40, rel=0.15)


def test_copies_are_shuffled_and_repeatable(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "string(id) AS text", "'s' AS source")
    a = [tuple(r) for r in replicate(docs).collect()]
    assert a == [tuple(r) for r in replicate(docs.repartition(7)).collect()]
    assert [r[-1] for r in a] == sorted(r[-1] for r in a) and [r[0] for r in a] != sorted(r[0] for r in a)
    assert [tuple(r) for r in replicate(docs, seed="other").collect()] != a
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in _replicas(a).values())


def _replicas(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r[3])
    return out


def test_defined_cases(docs_of, spark):
    rows = [(i, f"some text {i}") for i in range(60)] + [(70, None), (71, ""), (None, "null id"), (3, "some text 3"), (72, "long " * 100_000)]
    docs = docs_of(rows, extra=["replica", "shuffle_key", "rate", "_mix_cdf"]).withColumn("source", F.when(F.col("doc_id") % 5 > 0, F.col("source")))
    got = replicate(docs).collect()
    assert set(got[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "rate", "_mix_cdf", "replica", "shuffle_key"}
    n = Counter(r["doc_id"] for r in got)
    assert n[3] % 2 == 0  # equal rows draw alike
    blank = docs_of([(1, None), (2, "")])
    assert {r["rate"] for r in rates(blank).collect()} != set() and replicate(blank).count() >= 0
    assert replicate(docs_of([])).collect() == [] and replicate(docs, shuffle=False).count() == len(got)


def test_plan_is_native(docs_of):
    plan = replicate(docs_of(["a"]))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "NestedLoop", "Cartesian"))
