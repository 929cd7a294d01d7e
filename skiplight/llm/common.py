"""Helpers shared by the operators: the shared folder, durable tables, word arrays and bounded caches."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space, tab, LF, VT, FF, CR.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a folder of our own where that is unset and the
    master is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_dir:
            _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="skiplight-")
            spark.sparkContext.setCheckpointDir(_own_dir[app])
        found = _own_dir[app]
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/skiplight/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and a lost executor costs nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_small(df: DataFrame, small: DataFrame, key: str, *, how: str = "left", most: int = 10_000) -> DataFrame:
    """Join a table that should be small. It is written first and its rows are counted: up to ``most`` it is
    broadcast, beyond them both sides are shuffled and Spark splits skewed partitions."""
    small = durable(small, "small")
    return df.join(F.broadcast(small) if small.count() <= most else small, key, how)


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ...: whatever they are called, columns of our own don't clash with them."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def place(df: DataFrame, name: str) -> str:
    """What ``numbered`` calls a column: the one of exactly this name, or else that of the same letters in any case."""
    found = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if not found:
        raise ValueError(f"no column {name}")
    return f"c{found[0]}"


def restored(df: DataFrame, like: DataFrame, *more: str) -> DataFrame:
    """``df``, which has the columns of ``numbered(like)`` and then ``more`` of ours, under the names of ``like``; ours
    get underscores after their names where an input column has that name, in any case."""
    taken = {c.lower() for c in like.columns}
    names = []
    for name in more:
        while name.lower() in taken:
            name += "_"
        names.append(name)
        taken.add(name.lower())
    return df.select(*numbered(like).columns, *more).toDF(*like.columns, *names)


def small_batches(spark: SparkSession, most_bytes: int = 8 << 20) -> None:
    """Have the session send at most about ``most_bytes`` to Python at once: whole texts go there, and several batches
    stand in memory on both sides of the pipe. A smaller setting of the session's own stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.match(r"-?\d+", spark.conf.get(key))[0]) not in range(1, most_bytes):
        spark.conf.set(key, str(most_bytes))


def drop_paths(spark: SparkSession, *paths: str) -> None:
    """Delete finished intermediate folders through Hadoop's file system API."""
    jvm = spark._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), elementwise."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS = np.ones(0, np.uint64)


def _powers(n: int) -> np.ndarray:
    """The first n powers of an odd multiplier mod 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.full(max(n, 2 * len(_POWERS), 4096), 0xD6E8FEB86659FD93, np.uint64))
    return _POWERS


def word_hashes(data: np.ndarray, lower: bool, at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in a byte array, and each word's first byte position.

    A word's hash is a keyed polynomial of its bytes, mixed; only A-Z are lowered. Long arrays are taken in pieces that
    end before white space, since the work needs many times a piece's bytes.
    """
    if len(data) > at_once:
        hashes, firsts, a = [], [], 0
        while a < len(data):
            b = min(a + at_once, len(data))
            while b < len(data) and not (gap := _IS_SPACE[data[b : b + at_once]]).any():
                b += len(gap)
            b += int(gap.argmax()) if b < len(data) else 0
            h, f = word_hashes(data[a:b], lower, b - a)
            hashes.append(h)
            firsts.append(f + a)
            a = b
        return np.concatenate(hashes), np.concatenate(firsts)
    if lower:
        data = _LOWER[data]
    word = ~_IS_SPACE[data]
    edge = np.diff(word.view(np.int8), prepend=np.int8(0))
    starts = np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    at = np.flatnonzero(word)
    first = np.cumsum(edge[at] == 1) - 1
    offset = at - starts[first]
    with np.errstate(over="ignore"):
        terms = _BYTE[data[at]] * _powers(int(offset.max()) + 1)[offset]
        sums = np.add.reduceat(terms, np.searchsorted(at, starts))
    return mix64(sums), starts


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string column (null: empty) joined by newlines, and where each row's bytes start.

    The newline between rows keeps words of neighbours apart.
    """
    rows = [b"" if x is None else x.encode() for x in column.to_pylist()]
    lengths = np.fromiter((len(x) + 1 for x in rows), np.int64, len(rows))
    return np.frombuffer(b"\n".join(rows) + b"\n", np.uint8), np.concatenate([[0], np.cumsum(lengths)])


def slices(batch, column: str, most_bytes: int = 4 << 20):
    """Cut an Arrow batch into runs of rows with about ``most_bytes`` of text; one longer text stands alone."""
    import pyarrow.compute as pc

    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
    run = np.cumsum(size) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


class PartCache:
    """Ids of recurring parts of texts. Beyond ``most`` parts it keeps those of the current batch alone: losing a part
    costs time, never a result."""

    def __init__(self, learn, most: int = 200_000):
        self.learn, self.most, self.known = learn, most, {}

    def join(self, cut: list[list[str]]) -> list[bytes]:
        """For each list of parts the ids of all, packed; ``learn`` gives those of parts not yet known."""
        now = set().union(*cut)
        fresh = now.difference(self.known)
        if len(self.known) + len(fresh) > self.most:
            self.known = {p: self.known[p] for p in now.difference(fresh)}
        if fresh:
            self.known.update(self.learn(fresh))
        get = self.known.__getitem__
        return [b"".join(map(get, parts)) for parts in cut]
