"""The pipeline stage by stage against brute force, and its entry points."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from skiplight.llm import toxicity
from skiplight.llm.common import durable
from skiplight.llm.pieces import PieceCodec
from skiplight.llm.queries import PIECES

from .test_line_dedup import brute as brute_lines
from .test_near_dup import brute as brute_groups


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with planted copies, repeated passages and toxic texts, as a table folder."""
    rng = random.Random(9)
    words = [f"word{i}" for i in range(300)]
    text = lambda n: "\n".join(" ".join(rng.choices(words, k=10)) for _ in range(n))
    rows = [(i, text(rng.randint(2, 20))) for i in range(60)]
    passage = " ".join(rng.choices(words, k=70))
    plants = {"copy": (100, rows[3][1]), "near": (101, rows[4][1].replace("word1 ", "word2 ")), "p1": (102, "start one\n" + passage + "\nend one"), "p2": (103, "start two\n" + passage + "\nend two"), "toxic": (104, text(5) + " idiot moron scum"), "hidden": (105, "1d10t and m0r0n " + text(3)), "null": (106, None), "empty": (107, ""), "short": (108, "hi")}
    rows += list(plants.values()) + [(109, " ".join(rng.choices(words, k=40_000)))]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", f"s{i % 4}", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i == 104)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), plants


def test_stages(spark, corpus):
    d, plants = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in P.STAGES:
        before = docs.collect()
        docs = durable(stage(spark, docs, d), name)
        seen[name] = (before, docs.collect())
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
    ids = {n: [r["doc_id"] for r in after] for n, (_, after) in seen.items()}
    assert set(r["doc_id"] for r in seen["toxicity"][0]) - set(ids["toxicity"]) == {104, 105}
    before, after = seen["line_dedup"]
    want = brute_lines([(r["doc_id"], r["text"]) for r in before])
    got = {r["doc_id"]: r for r in after}
    assert {i: r["text"] or "" for i, r in got.items()} == {i: t for i, t in want.items() if t.strip() or i in (106, 107)}
    assert 100 not in got and got[106]["text"] is None and got[103]["text"] == "start two\nend two"
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in after)
    before, after = seen["near_dup"]
    root = brute_groups([(r["doc_id"], r["text"]) for r in before], 5, 80, 100)
    assert sorted(ids["near_dup"]) == sorted(i for i, r in root.items() if i == r)
    before, after = seen["mixing"]
    assert {tuple(r) for r in after} <= {tuple(r) for r in before} and len(after) > 0.5 * len(before)
    before, after = seen["pieces"]
    lib = PieceCodec(PIECES).lib
    texts = {r["doc_id"]: r["text"] or "" for r in before}
    assert len(before) == len(after)
    for r in after:
        assert r["ids"] == lib.encode(texts[r["doc_id"]]) and r["decoded"] == lib.decode(r["ids"]) and r["n_tokens"] == len(r["ids"])


def test_near_copies_leave_one(spark, corpus):
    d, plants = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet").where(F.col("doc_id").isin(3, 4, 100, 101))
    assert sorted(r["doc_id"] for r in P.near_dup_stage(spark, docs, d).collect()) in ([3, 4], [3, 4, 101])


def test_run_equals_its_stages(spark, corpus):
    d, _ = corpus
    one = sorted(map(str, P.run(spark, d).collect()))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in P.STAGES:
        docs = durable(stage(spark, docs, d), name)
    assert one == sorted(map(str, docs.collect())) and P.ORACLE_SQL is None


def test_an_empty_table_and_clashing_columns(spark, corpus):
    d, _ = corpus
    own = {"kept": F.lit("x"), "N_Lines": F.lit("y"), "replica": F.lit("mine"), "k": F.lit("z"), "a.b": F.lit("w"), "back`tick": F.lit("v"), "c0": F.struct(F.lit(1).alias("x y"))}
    docs = spark.read.parquet(f"{d}/documents.parquet").select("*", *(c.alias(n) for n, c in own.items()))
    for rows in (docs, docs.limit(0)):
        out = rows
        for name, stage in P.STAGES[:-1]:
            out = durable(stage(spark, out, d), name)
            assert out.columns == rows.columns and out.dtypes == rows.dtypes
            assert {tuple(r)[5:] for r in out.collect()} == ({("x", "y", "mine", "z", "w", "v", (1,))} if rows is docs else set())
        assert (P.pieces_stage(spark, out, d).count() == 0) == (rows is not docs)


def test_entry_lists_every_query():
    import __spark_entry__ as E

    names = E.queries()
    assert {f"op{n}_" for n in range(1, 11)} <= {q.split("_")[0] + "_" for q in names} and "pipeline" in names
    assert set(E.oracle_sql()) <= set(names)
    assert toxicity.MAX_LABELLED and len(P.STAGES) == 5
