"""Near-duplicate grouping with SuperMinHash.

1. Each text's words (A-Z lowered, split at space, tab, LF, VT, FF, CR) give its set of distinct word shingles as
   64-bit hashes. A SuperMinHash signature is drawn from the set: every element walks one random permutation of the
   slots (a Fisher-Yates shuffle, one step for each rank), so an element's values in different slots are correlated
   ranks, and the walk stops as soon as no slot of the document can still improve. Slots are banded.
2. Texts with equal sets are one class, named by its smallest id; only classes are banded and joined.
3. Members of a band bucket are tied to the bucket's smallest class (a star, never all pairs), and each tie is verified
   on full sets. A class tied to very many is dealt with them by a salt, ``STAR`` at a time, and a task holds the sets of
   two classes at once.
4. Only buckets whose members (but the smallest) lie in several components of the verified ties can still hold a link
   that changes anything: all their pairs are verified, buckets of the same members once. Intersection sizes come from a
   product of membership patterns; a bucket beyond ``CHUNK`` classes or ``CHUNK_SHINGLES`` elements is dealt into
   chunks, and each pair of chunks is a unit of its own, so no pair is lost and no task holds more than two chunks. Only
   a spanning forest of the links leaves a task. So each pair that shares a band is verified, or its classes are known to
   be connected, whatever the sizes; a group of copies costs time in proportion to its size.
5. Union-find over the links, as alternating large and small stars, names each component by its smallest id.

With ``BANDS`` bands of ``ROWS`` slots a pair of similarity 0.85 shares no band with a probability of 8e-7, one of 0.8
with 3e-4.

Defined cases: texts without words (and null texts) have no shingles and link with nothing; a text of fewer words than
a shingle has its whole sequence as its one shingle; rows that share an id count as one document whose links are those
of all its texts; a null id is linked with nothing, its component is null and it is kept; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_paths, durable, mix64, scratch, slices, small_batches, text_bytes, word_hashes

BANDS, ROWS = 44, 8
STAR, CHUNK, CHUNK_SHINGLES = 200, 400, 1_000_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(column, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows of an Arrow string column, sorted by row and hash, and each one's row."""
    data, rows = text_bytes(column)
    words, starts = word_hashes(data, lower=True)
    doc = np.searchsorted(rows, starts, "right") - 1
    n = len(words)
    with np.errstate(over="ignore"):
        if n >= size:
            joined = words[: n - size + 1].copy()
            for k in range(1, size):
                joined = mix64(joined) + words[k : n - size + 1 + k]
            inside = doc[: n - size + 1] == doc[size - 1 :]
            joined, where = mix64(joined)[inside], doc[: n - size + 1][inside]
        else:
            joined, where = words[:0], doc[:0]
        counts = np.bincount(doc, minlength=len(rows) - 1)
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            first = np.searchsorted(doc, short)
            tail = words[first] ^ _GOLD
            for k in range(1, size - 1):
                more = counts[short] > k
                tail[more] = mix64(tail[more]) + words[first[more] + k]
            joined, where = np.concatenate([joined, mix64(tail)]), np.concatenate([where, short])
    order = np.lexsort((joined, where))
    joined, where = joined[order], where[order]
    new = np.ones(len(joined), bool)
    new[1:] = (joined[1:] != joined[:-1]) | (where[1:] != where[:-1])
    return joined[new], where[new]


def super_minhash(elements: np.ndarray, doc: np.ndarray, n_docs: int, slots: int, at_once: int = 16384) -> np.ndarray:
    """Signatures [n_docs, slots]: rank and fraction as one integer. ``doc`` is sorted; each document has elements."""
    sig = np.full((n_docs, slots), np.iinfo(np.uint64).max, np.uint64)
    flat = sig.reshape(-1)
    order = np.arange(slots, dtype=np.uint16)
    held = np.empty((min(at_once, max(len(elements), 1)), slots), np.uint16)
    for a in range(0, len(elements), at_once):
        e, d = elements[a : a + at_once], doc[a : a + at_once].astype(np.int64)
        perm = held[: len(e)]
        perm[:] = order
        perm = perm.reshape(-1)
        base = np.arange(len(e), dtype=np.int64) * slots
        with np.errstate(over="ignore"):
            for j in range(slots):
                draw = mix64(e + np.uint64(j + 1) * _GOLD)
                k = j + (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
                slot = perm[base + k]
                perm[base + k] = perm[base + j]
                np.minimum.at(flat, d * slots + slot, (np.uint64(j) << np.uint64(32)) | (draw >> np.uint64(32)))
                # a document is done when even its worst slot beats the next rank
                first, last = d[0], d[-1]
                done = sig[first : last + 1].max(1) < np.uint64(j + 1) << np.uint64(32)
                if done.any():
                    left = ~done[d - first]
                    if not left.any():
                        break
                    if left.sum() < 0.7 * len(e):
                        e, d, base = e[left], d[left], base[left]
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """[n_docs, bands] 64-bit keys; the band's number is part of its key."""
    with np.errstate(over="ignore"):
        key = np.broadcast_to(mix64(np.arange(bands, dtype=np.uint64)), (len(sig), bands)).copy()
        parts = sig.reshape(len(sig), bands, rows)
        for k in range(rows):
            key = mix64(key * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, k])
    return key


def signatures(docs: DataFrame, *, shingle: int, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, h, n, key, bands) per row: the id, the text's hash, the set's size, a 128-bit key of the set, and its band keys."""
    small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("h", T.LongType()), T.StructField("n", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "t", 2 << 20):
                sets, where = shingle_sets(part.column("t"), shingle)
                sizes = np.bincount(where, minlength=part.num_rows)
                full = np.flatnonzero(sizes)
                keys, found = [None] * part.num_rows, [None] * part.num_rows
                if len(full):
                    dense = np.searchsorted(full, where)
                    first = np.flatnonzero(np.diff(dense, prepend=-1))
                    with np.errstate(over="ignore"):
                        one, two = np.add.reduceat(mix64(sets), first), np.add.reduceat(mix64(~sets), first)
                    bandings = band_keys(super_minhash(sets, dense, len(full), bands * rows), bands, rows).view(np.int64)
                    for i, r in enumerate(full):
                        keys[r] = one[i].tobytes() + two[i].tobytes()
                        found[r] = bandings[i]
                yield pa.RecordBatch.from_arrays([part.column("k"), part.column("h"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["k", "h", "n", "key", "bands"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, schema)


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, h, t): id, text hash and text."""
    return docs.select(F.col(id_col).cast("long").alias("k"), F.xxhash64(F.col(text_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("t"))


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """(node, root) of every node with an edge (columns a, b), and the folder that holds it.

    Alternating stars: in a large star each node ties its larger neighbours to the smallest of all, in a small star the
    smaller ones. Each round is written to the shared folder; two counts and a checksum tell when nothing changed.
    """
    spark = edges.sparkSession

    def write(df, old):
        path = scratch(spark, "edges")
        df.write.parquet(path)
        if old:
            drop_paths(spark, old)
        return spark.read.schema("a long, b long").parquet(path), path

    def least(df):
        return df.groupBy("a").agg(F.min("b").alias("m"))

    edges, path = write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), None)
    seen = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(least(both), "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        edges, path = write(large, path)
        small = edges.join(least(edges), "a").where("b <> m").select("b", "m").union(least(edges)).toDF("a", "b")
        edges, path = write(small.distinct(), path)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    # every node that isn't a root has one edge, to its root
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct()), path


def linked(sizes: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """[n, n] booleans: den * |A and B| >= num * |A or B|, exactly."""
    n = len(sets)
    member = np.repeat(np.arange(n), [len(s) for s in sets])
    everything = np.concatenate(sets)
    order = np.argsort(everything, kind="stable")
    everything, member = everything[order], member[order]
    first = np.flatnonzero(np.append(True, everything[1:] != everything[:-1]))
    count = np.diff(np.append(first, len(everything)))
    shared = count > 1
    # sums of whole numbers up to the largest set's size are exact in these types
    kind = np.float32 if sizes.max() < 1 << 24 else np.float64
    common = np.zeros((n, n), np.float64)
    if shared.any():
        # elements held by the same members count as one column, weighted by their number
        with np.errstate(over="ignore"):
            pattern = np.add.reduceat(mix64(member.astype(np.uint64) + np.uint64(1)), first)[shared]
        _, one, weight = np.unique(pattern, return_index=True, return_counts=True)
        start, length = first[shared][one], count[shared][one]
        step = max(1, (8 << 20) // n)
        for a in range(0, len(start), step):
            s, c = start[a : a + step], length[a : a + step]
            col = np.repeat(np.arange(len(s)), c)
            at = np.repeat(s - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(c.sum())
            has = np.zeros((n, len(s)), kind)
            has[member[at], col] = 1
            common += (has * weight[a : a + step].astype(kind)) @ has.T
    union = sizes[:, None] + sizes[None, :] - common
    return den * common >= num * union


def forest(link: np.ndarray, nodes: list[int]) -> list[tuple[int, int]]:
    """Edges from each member of a component to the component's first member."""
    left, out = np.ones(len(nodes), bool), []
    while left.any():
        root = int(left.argmax())
        seen = np.zeros(len(nodes), bool)
        front = np.zeros(len(nodes), bool)
        front[root] = True
        while front.any():
            seen |= front
            front = link[front].any(0) & ~seen
        left &= ~seen
        out += [(nodes[i], nodes[root]) for i in np.flatnonzero(seen) if i != root]
    return out


def set_rows(docs: DataFrame, classes: DataFrame, plan: DataFrame, *, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(node, own, and the fields of ``units``) for each unit of each class: its set as sorted 64-bit hashes. plan: (node,
    units); a class's text is read and cut into shingles once, whatever the number of its units. Of a class's equal rows
    one is taken."""
    small_batches(docs.sparkSession)
    wanted = classes.select(F.col("rep").alias("node"), "h").join(plan, "node").withColumnsRenamed({"h": "h2"})
    rows = texts_of(docs, id_col, text_col).join(wanted, (F.col("k") == F.col("node")) & (F.col("h") == F.col("h2"))).select("node", "h", "t", "units")
    kind = rows.schema["units"].dataType

    def sets(batches):
        last = None
        for batch in batches:
            for part in slices(batch, "t", 2 << 20):
                # rows of one text stand together after the join; the same set twice would be work, never an error
                keep = []
                for one in zip(part.column("node").to_pylist(), part.column("h").to_pylist()):
                    keep.append(one != last)
                    last = one
                part = part.filter(pa.array(keep))
                elements, where = shingle_sets(part.column("t"), shingle)
                cuts = np.searchsorted(where, np.arange(part.num_rows + 1))
                own = [elements[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("units"), pa.array(own, pa.binary())], names=["node", "units", "own"])

    out = rows.mapInArrow(sets, T.StructType([T.StructField("node", T.LongType()), T.StructField("units", kind), T.StructField("own", T.BinaryType())]))
    return out.select("node", "own", F.inline("units"))


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _grouped(batches, keys: tuple[str, ...], start, add, close):
    """Edges from rows sorted by ``keys``: ``start()`` at each new key, ``add(row)`` gives edges or none, ``close()`` too."""
    group = None
    for batch in batches:
        found = []
        for row in batch.to_pylist():
            now = tuple(row[k] for k in keys)
            if now != group:
                found += close() if group else []
                group = now
                start()
            found += add(row)
        yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in found], schema=_EDGE)
    yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in (close() if group else [])], schema=_EDGE)


def star_links(docs: DataFrame, classes: DataFrame, ties: DataFrame, *, shingle: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b): the ties (a, first) whose sets reach the similarity."""
    pairs = durable(ties.select("a", "first").distinct(), "pairs")
    sizes = durable(pairs.groupBy("first").agg(F.ceil(F.count("*") / STAR).cast("int").alias("salts")), "stars")
    members = pairs.join(sizes, "first").select(F.col("a").alias("node"), F.struct(F.col("first").alias("of"), F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role")).alias("u"))
    centres = sizes.select(F.col("first").alias("node"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).select("node", F.struct(F.col("node").alias("of"), "salt", F.lit(0).alias("role")).alias("u"))
    plan = members.union(centres).groupBy("node").agg(F.collect_list("u").alias("units"))

    def link(batches):
        centre: list[np.ndarray] = []

        def add(row):
            own = np.frombuffer(row["own"], np.uint64)
            if row["role"] == 0:
                centre.append(own)
                return []
            return [(row["node"], row["of"])] if any(similar(own, c, num, den) for c in centre) else []

        return _grouped(batches, ("of", "salt"), centre.clear, add, list)

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = set_rows(docs, classes, plan, shingle=shingle, id_col=id_col, text_col=text_col)
    return rows.repartition(n, "of", "salt").sortWithinPartitions("of", "salt", "role").mapInArrow(link, "a long, b long")


def similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """den * |X and Y| >= num * |X or Y|, of sorted distinct elements."""
    if min(len(x), len(y)) * den < num * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return den * common >= num * (len(both) - common)


def verified_links(docs: DataFrame, classes: DataFrame, units: DataFrame, *, shingle: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b): a spanning forest of the links inside each unit. units: (node, unit)."""
    units = units.join(classes.groupBy(F.col("rep").alias("node")).agg(F.sum("n").alias("n")), "node")
    size = durable(units.groupBy("unit").agg(F.count("*").alias("members"), F.sum("n").alias("elements")), "units")
    chunks = F.greatest(F.ceil(F.col("members") / CHUNK), F.ceil(F.col("elements") / CHUNK_SHINGLES)).cast("int")
    # a member of chunk c meets those of every chunk
    mine = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    dealt = units.join(size, "unit").withColumn("chunks", chunks).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    plan = dealt.select("node", F.struct(F.col("unit").alias("of"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")).alias("u"))
    plan = plan.groupBy("node").agg(F.collect_list("u").alias("units"))

    def link(batches):
        nodes: list[int] = []
        own: list[bytes] = []

        def start():
            nodes.clear()
            own.clear()

        def add(row):
            nodes.append(row["node"])
            own.append(row["own"])
            return []

        def close():
            if len(nodes) < 2:
                return []
            sizes = np.array([len(x) // 8 for x in own], np.float64)
            return forest(linked(sizes, [np.frombuffer(x, np.uint64) for x in own], num, den), nodes)

        return _grouped(batches, ("of", "i", "j"), start, add, close)

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = set_rows(docs, classes, plan, shingle=shingle, id_col=id_col, text_col=text_col)
    return rows.repartition(n, "of", "i", "j").sortWithinPartitions("of", "i", "j").mapInArrow(link, "a long, b long")


def mixed_buckets(ties: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, unit): the members but the smallest of buckets where these lie in several components; of buckets with the
    same members one."""
    placed = ties.where("size > 2").join(roots.withColumnRenamed("node", "a"), "a", "left").withColumn("root", F.coalesce("root", "a"))
    mixed = placed.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n"), F.sum(F.xxhash64("a").cast("decimal(38,0)")).alias("s"), F.sum(F.hash("a").cast("long")).alias("s2")).where("x < y")
    mixed = durable(mixed.groupBy("n", "s", "s2").agg(F.min("band").alias("band")).select("band"), "mixed")
    return durable(ties.join(mixed, "band").select(F.col("a").alias("node"), F.col("band").alias("unit")), "mixed-members")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, num: int = 80, den: int = 100, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for each row: documents with den * |A and B| >= num * |A or B| are linked,
    and the document with the smallest id of each component is kept."""
    spark = docs.sparkSession
    how = {"shingle": shingle, "num": num, "den": den, "id_col": id_col, "text_col": text_col}
    marked = durable(signatures(docs, shingle=shingle, bands=bands, rows=rows, id_col=id_col, text_col=text_col), "signatures")
    who = F.min(F.struct("k", "h"))
    classes = durable(marked.where("n > 0 AND k IS NOT NULL").groupBy("key", "n", "bands").agg(who.alias("w")).select("key", "n", "bands", F.col("w.k").alias("rep"), F.col("w.h").alias("h")), "classes")
    banded = classes.select(F.explode("bands").alias("band"), "rep")
    buckets = durable(banded.groupBy("band").agg(F.min("rep").alias("first"), F.count("*").alias("size")).where("size > 1"), "buckets")
    ties = durable(banded.join(buckets, "band").where("rep <> first").select("band", F.col("rep").alias("a"), "first", "size"), "ties")
    links = durable(star_links(docs, classes, ties, **how), "links")
    roots, _ = components(links)
    units = mixed_buckets(ties, roots)
    if units.limit(1).count():
        roots, _ = components(links.union(durable(verified_links(docs, classes, units, **how), "more-links")))
    named = classes.select("key", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("root", "rep").alias("root"))
    out = marked.select("k", "n", "key").join(named, "key", "left")
    component = F.when(F.col("k").isNotNull(), F.coalesce("root", "k"))
    return out.select(F.col("k").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("k") == component, F.lit(True)).alias("kept"))
