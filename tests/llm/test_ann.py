import numpy as np
import pytest
from pyspark.sql import functions as F

from skiplight.llm.ann import Index, balanced_centroids, build, neighbours
from skiplight.llm.queries import QUERIES
from tests.conftest import SF


def exact(rows, k):
    """Best k by inner product for each id divisible by 20, ties to the smaller id."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for q in sorted(set(ids[ids % 20 == 0].tolist())):
        at = int(np.flatnonzero(ids == q)[0])
        s = (x * x[at]).sum(1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), s[j]) for j in order]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def run(df, k=20):
    got = {}
    for r in neighbours(df, F.col("id") % 20 == 0, k=k).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r)
    for rows in got.values():
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    return got


@pytest.mark.parametrize("norms", [False, True])
def test_recall_and_scores(spark, norms):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if norms:
        x *= rng.uniform(0.5, 3, (3000, 1)).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got, want = run(frame(spark, rows)), exact(rows, 20)
    hit = sum(len({r["vec_id"] for r in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert got.keys() == want.keys() and hit / (20 * len(want)) >= 0.9
    full = x.astype(float)
    for q, found in got.items():
        assert len(found) == 20
        for r in found:
            assert r["score"] == pytest.approx(float((full[q] * full[r["vec_id"]]).sum()), rel=1e-12)


def test_query_recall(spark):
    got = {}
    for r in QUERIES["op3_balanced_postings"](spark, SF).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = exact(rows, 20)
    assert got.keys() == want.keys()
    assert sum(len(got[q] & {i for i, _ in want[q]}) for q in want) / (20 * len(want)) >= 0.9


def test_ties_and_large_groups_of_equal_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(500)] + [(500 + i, [float(c) for c in rng.normal(size=3)]) for i in range(300)]
    got, want = run(frame(spark, rows)), exact(rows, 20)
    for q in range(0, 500, 20):
        assert [r["vec_id"] for r in got[q]] == [i for i, _ in want[q]]
    assert len(got) == len(want)


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0]), (7, [1.0, None]), (None, [1.0, 1.0]), (40, [nan, 0.0]), (8, []), (9, [-1.0, 0.0])]
    df = frame(spark, rows).selectExpr("*", "1 AS id", "'x' AS v", "'y' AS rep", "2 AS list")
    got = run(df)
    assert {q: [(r["vec_id"], r["score"]) for r in v] for q, v in got.items()} == {0: [(1, 1.0), (20, 0.0), (9, -1.0)], 20: [(1, 1.0), (0, 0.0), (9, 0.0)]}
    assert run(df, k=1)[0][0]["vec_id"] == 1
    assert run(frame(spark, [])) == {} and run(frame(spark, [(20, [1.0])])) == {} and run(frame(spark, [(4, None)])) == {}


def test_index():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(4000, 16))
    c = balanced_centroids(x, 60)
    assert len(c) == 64
    index = build(x, 8000, 10)
    assert isinstance(index, Index) and len(index.centroids) == 64 and index.links.shape[0] == 64
    q = index.lift(x[:200], True)
    ids, d = index.nearest(q, 8)
    brute = ((q[:, None] - index.centroids[None]) ** 2).sum(2)
    assert np.mean([len(set(a) & set(np.argsort(b)[:8])) / 8 for a, b in zip(ids, brute)]) > 0.95
    assert np.allclose(np.take_along_axis(brute, ids, 1), d) and (np.diff(d, axis=1) >= 0).all()
    held, ok = index.postings(x[:50])
    assert ok[:, 0].all() and ok.sum() > 50
    same = build(x[rng.permutation(4000)], 8000, 10)
    assert (same.centroids == index.centroids).all()
