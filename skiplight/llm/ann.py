"""Approximate nearest neighbours by largest inner product, with balanced posting lists.

Vectors are clustered on a bounded sample by repeated balanced bisection: every split halves its set, so clusters hold
equally many sample vectors. Inner products become distances by one more coordinate that gives all vectors the length
of the longest. A vector is posted to its nearest cluster and, near a boundary, to further ones whose squared distance
is within ``BOUNDARY`` times the nearest's (up to ``REPLICAS``). Centroids are found through an in-memory graph: beam
search over each centroid's nearest neighbours and a few random links. A query visits lists in order of distance,
pruned by their distance's ratio to the nearest and by a number; both are calibrated on the sample so that it reaches
``TARGET`` recall there, for as many neighbours as the k nearest of all leave in a sample of that size.

Equal vectors are posted once; of each such group only the first k + 1 ids can appear in an answer. Long lists are
dealt into blocks of about ``BLOCK`` vectors, and each query visits all blocks of its lists. Only the index reaches the
driver and is broadcast: at most ``MAX_LISTS`` centroids with ``DEGREE`` links, whatever the table's size.

Defined cases: vectors that are null, zero, or hold a null or non-finite component take no part, nor do those of
another dimension than the most frequent one (of ties the smallest), nor null ids; rows that repeat an id and vector
count once; an id with several vectors answers with its best; fewer than k candidates are all returned; an empty table
gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

SAMPLE, MAX_LISTS, LIST_SIZE, CALIBRATION = 100_000, 8192, 128, 10_000
REPLICAS, BOUNDARY, BLOCK, TARGET = 4, 1.1, 4096, 0.96
DEGREE, LONG_LINKS, ENTRIES = 16, 6, 32
#: Answers that a task holds while it merges those of its lists.
HELD = 2_000_000


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 5) -> np.ndarray:
    """Means of ``lists`` (rounded up to a power of two, at most the number of rows) equally large clusters."""
    rng = np.random.default_rng(seed)
    parts = [np.arange(len(x))]
    while len(parts) < lists and min(map(len, parts)) >= 2:
        halves = []
        for part in parts:
            rows = x[part]
            pair = rows[rng.choice(len(rows), 2, replace=False)]
            for _ in range(6):
                order = np.argsort(rows @ (pair[0] - pair[1]) - (pair[0] @ pair[0] - pair[1] @ pair[1]) / 2, kind="stable")
                low, high = order[: len(order) // 2], order[len(order) // 2 :]
                pair = np.stack([rows[high].mean(0), rows[low].mean(0)])
            halves += [part[low], part[high]]
        parts = halves
    return np.stack([x[p].mean(0) for p in parts])


@dataclass
class Index:
    """Centroids (with the added coordinate), their graph, and how far a search goes."""

    centroids: np.ndarray
    links: np.ndarray
    longest: float
    probes: int = 8
    ratio: float = 1.5

    def lift(self, v: np.ndarray, query: bool) -> np.ndarray:
        """Vectors with the added coordinate; queries are scaled to the common length, which keeps their order."""
        size = np.einsum("ij,ij->i", v, v)
        if query:
            return np.concatenate([v * (self.longest / np.sqrt(size))[:, None], np.zeros((len(v), 1))], 1)
        return np.concatenate([v, np.sqrt(np.maximum(self.longest**2 - size, 0))[:, None]], 1)

    def nearest(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and squared distances of about the k nearest centroids, nearest first, by beam search in the graph."""
        n, k = len(self.centroids), min(k, len(self.centroids))
        norms = np.einsum("ij,ij->i", self.centroids, self.centroids)
        beam = min(n, max(2 * k, 48))
        ids, dist = np.zeros((len(q), k), np.int64), np.zeros((len(q), k))
        for a in range(0, len(q), 512):
            part = q[a : a + 512]
            b = len(part)
            own = np.einsum("ij,ij->i", part, part)[:, None]
            row = np.arange(b)[:, None]
            seen = np.zeros((b, n), bool)
            entry = np.unique(np.linspace(0, n - 1, min(n, ENTRIES)).astype(int))
            got = np.tile(entry, (b, 1))
            seen[:, entry] = True
            d = own + norms[got] - 2 * part @ self.centroids[entry].T
            done = np.zeros(got.shape, bool)
            while True:
                open_d = np.where(done, np.inf, d)
                width = min(4, open_d.shape[1])
                pick = np.argpartition(open_d, width - 1, axis=1)[:, :width]
                live = np.take_along_axis(open_d, pick, 1) < np.inf
                if not live.any():
                    break
                np.put_along_axis(done, pick, True, 1)
                fresh = self.links[np.take_along_axis(got, pick, 1)].reshape(b, -1)
                new = ~seen[row, fresh] & np.repeat(live, self.links.shape[1], 1)
                # the same centroid may come from two links: its first place counts
                order = np.argsort(fresh, axis=1, kind="stable")
                ranked = np.take_along_axis(fresh, order, 1)
                twice = np.zeros(fresh.shape, bool)
                np.put_along_axis(twice, order[:, 1:], ranked[:, 1:] == ranked[:, :-1], 1)
                new &= ~twice
                far = np.full(fresh.shape, np.inf)
                r, c = np.nonzero(new)
                f = fresh[r, c]
                seen[r, f] = True
                far[r, c] = own[r, 0] + norms[f] - 2 * np.einsum("ij,ij->i", part[r], self.centroids[f])
                got, d, done = np.concatenate([got, fresh], 1), np.concatenate([d, far], 1), np.concatenate([done, ~new], 1)
                if got.shape[1] > beam:
                    best = np.argpartition(d, beam - 1, axis=1)[:, :beam]
                    got, d, done = (np.take_along_axis(z, best, 1) for z in (got, d, done))
            best = np.argsort(d, axis=1, kind="stable")[:, :k]
            ids[a : a + b], dist[a : a + b] = np.take_along_axis(got, best, 1), np.maximum(np.take_along_axis(d, best, 1), 0)
        return ids, dist

    def postings(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lists of each vector, and which of them hold it."""
        ids, d = self.nearest(self.lift(v, False), REPLICAS)
        return ids, (d <= BOUNDARY * d[:, :1] + 1e-12) & np.isfinite(d)

    def visits(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lists that each query visits."""
        ids, d = self.nearest(self.lift(v, True), self.probes)
        return ids, (d <= self.ratio**2 * d[:, :1] + 1e-12) & np.isfinite(d)


def build(sample: np.ndarray, total: int, k: int) -> Index:
    """An index for ``total`` vectors from a sample of them (any order; sorted here so that the result is repeatable)."""
    v = sample[np.lexsort(sample.T[::-1])]
    longest = float(np.sqrt(np.einsum("ij,ij->i", v, v).max()))
    index = Index(np.zeros((1, v.shape[1] + 1)), np.zeros((1, 1), np.int64), longest)
    lifted = index.lift(v, False)
    index.centroids = balanced_centroids(lifted, max(1, min(MAX_LISTS, total // LIST_SIZE, len(v) // 4)))
    n = len(index.centroids)
    rng = np.random.default_rng(11)
    degree = min(DEGREE, n)
    near = np.zeros((n, degree), np.int64)
    norms = np.einsum("ij,ij->i", index.centroids, index.centroids)
    for a in range(0, n, 1024):
        d = norms - 2 * index.centroids[a : a + 1024] @ index.centroids.T
        near[a : a + 1024] = np.argpartition(d, degree - 1, axis=1)[:, :degree]
    index.links = np.concatenate([near, rng.integers(0, n, (n, LONG_LINKS)), ((np.arange(n) + 1) % n)[:, None]], 1)
    # calibration: exact neighbours within the sample against the lists that hold them
    base = v[rng.permutation(len(v))[:CALIBRATION]]
    ask = base[:300]
    score = ask @ base.T
    score[np.arange(len(ask)), np.arange(len(ask))] = -np.inf
    # the k nearest of all are about so many of those in the sample
    k = min(max(3, -(-k * len(base) // total)), len(base) - 1)
    if k < 1:
        return index
    truth = np.argpartition(-score, k - 1, axis=1)[:, :k]
    held, ok = index.postings(base)
    most = min(n, 512)
    ids, d = index.nearest(index.lift(ask, True), most)
    place = np.full((len(ask), n), most, np.int64)
    np.put_along_axis(place, ids, np.arange(most)[None, :], 1)
    # the first visited list that holds each true neighbour
    first = np.where(ok[truth], place[np.arange(len(ask))[:, None, None], held[truth]], most).min(2)
    grow = np.sqrt(d / np.maximum(d[:, :1], 1e-12))
    best = None
    for probes in sorted({min(p, most) for p in (4, 8, 16, 32, 48, 64, 96, 128, 192, 256, 384, 512)}):
        for ratio in (1.05, 1.1, 1.15, 1.2, 1.3, 1.5, 2.0, 4.0):
            used = np.minimum((grow <= ratio).sum(1), probes)
            if (first < used[:, None]).mean() >= TARGET and (best is None or used.mean() < best[0]):
                best = (used.mean(), probes, ratio)
    index.probes, index.ratio = best[1:] if best else (most, 4.0)
    return index


def leading(q: np.ndarray, rep: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (score descending, then rep) of each q, without repeated pairs."""
    order = np.lexsort((rep, -score, q))
    q, rep, score = q[order], rep[order], score[order]
    # copies of a vector in several lists have the same score, so repeated pairs are neighbours
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (rep[1:] != rep[:-1])
    q, rep, score = q[new], rep[new], score[new]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], rep[keep], score[keep]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part, without repeated ones."""
    v = F.col(vector_col)
    kind = dict(vectors.dtypes)[vector_col]
    plain = v if kind == "array<float>" else v.cast("array<double>")
    finite = F.forall(plain, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), plain.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda c: c != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (sizes["n"] if sizes else 0)).distinct()


def neighbours(vectors: DataFrame, is_query: Column, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for each row that ``is_query`` (over column id) admits."""
    spark = vectors.sparkSession
    rows = durable(usable(vectors, id_col, vector_col), "vectors")
    by_vector = Window.partitionBy("v").orderBy("id")
    members = rows.withColumn("r", F.row_number().over(by_vector)).where(F.col("r") <= k + 1).drop("r")
    members = durable(members.withColumn("rep", F.first("id").over(by_vector)), "members")
    reps = members.where("id = rep").select("rep", "v")
    queries = rows.where(is_query).join(reps, "v").select(F.col("id").alias("query_id"), F.col("rep").alias("q"), "v")
    total = reps.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kind = np.dtype("<f4" if dict(rows.dtypes)["v"] == "array<float>" else "<f8")
    sample = reps.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()
    dim = len(sample[0])
    matrix = lambda col, n: np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, dim)
    index = spark.sparkContext.broadcast(build(matrix(sample, len(sample)), total, k))

    def deal(batches):
        # side 0: postings; side 1: visits
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                v = matrix(part.column("v"), part.num_rows)
                asked = np.asarray(part.column("asked").to_numpy(zero_copy_only=False), bool)
                raw = v.astype(kind)
                keys = part.column("rep").to_numpy()
                for side, (ids, ok), own in ((0, index.value.postings(v), np.arange(len(v))), (1, index.value.visits(v[asked]) if asked.any() else (np.zeros((0, 1), int), np.zeros((0, 1), bool)), np.flatnonzero(asked))):
                    i, j = np.nonzero(ok)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i, j], pa.int32()), pa.array(np.full(len(i), side), pa.int32()), pa.array(keys[own[i]], pa.int64()), pa.array([raw[r].tobytes() for r in own[i]], pa.binary())], names=["list", "side", "key", "raw"])

    asked = queries.select(F.col("q").alias("rep")).distinct().withColumn("asked", F.lit(True))
    flagged = reps.join(asked, "rep", "left").select("rep", "v", F.coalesce("asked", F.lit(False)).alias("asked"))
    dealt = durable(flagged.mapInArrow(deal, "list int, side int, key long, raw binary"), "lists")
    # one row for each list, at most MAX_LISTS (rounded up to a power of two)
    sizes = dealt.where("side = 0").groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = dealt.join(F.broadcast(sizes), "list")
    block = F.when(F.col("side") == 0, F.array(F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = placed.select("list", F.explode(block).alias("block"), "side", "key", "raw")

    def scan(batches):
        group, keys, held, base, ask = None, [], [], None, []
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def answer():
            nonlocal base, ask, size
            if ask and (held or base is not None):
                if base is None:
                    base = np.frombuffer(b"".join(held), kind).reshape(len(held), dim).astype(np.float64)
                ids = np.array(keys)
                q = np.frombuffer(b"".join(r for _, r in ask), kind).reshape(len(ask), dim).astype(np.float64)
                rough = q @ base.T
                top = min(k + 1, len(ids))
                # all that come near the last place are scored anew, summed alike everywhere, so that ties are exact
                edge = np.partition(rough, len(ids) - top, axis=1)[:, len(ids) - top]
                slack = 1e-9 * (np.abs(q) @ np.abs(base).max(0))
                i, j = np.nonzero(rough >= (edge - slack)[:, None])
                names = np.array([x for x, _ in ask])
                best.append(leading(names[i], ids[j], (q[i] * base[j]).sum(1), k + 1))
                size += len(best[-1][0])
            ask = []

        def merged():
            """What the task's lists have so far: the best of each query, as the final merge would keep them."""
            nonlocal size
            if best:
                best[:] = [leading(*(np.concatenate(c) for c in zip(*best)), k + 1)]
                size = len(best[0][0])

        def out():
            for q, rep, score in best:
                for a in range(0, len(q), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(q[a : a + (1 << 16)]), pa.array(rep[a : a + (1 << 16)]), pa.array(score[a : a + (1 << 16)])], names=["q", "rep", "score"])

        for batch in batches:
            for lst, blk, side, key, raw in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if (lst, blk) != group:
                    answer()
                    group, keys, held, base = (lst, blk), [], [], None
                if side == 0:
                    keys.append(key)
                    held.append(raw)
                else:
                    ask.append((key, raw))
                    if len(ask) == 512:
                        answer()
            if size > HELD:
                merged()
                if size > HELD // 2:  # too many queries to hold; the final merge takes care of the rest
                    yield from out()
                    best.clear()
                    size = 0
        answer()
        merged()
        yield from out()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = placed.repartition(n, "list", "block").sortWithinPartitions("list", "block", "side").mapInArrow(scan, "q long, rep long, score double")
    found = found.groupBy("q", "rep").agg(F.max("score").alias("score"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    full = found.join(members.select("rep", F.col("id").alias("vec_id")), "rep").join(queries.select("query_id", "q"), "q").where("vec_id <> query_id")
    full = full.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return full.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
