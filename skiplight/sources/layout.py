"""The managed layout of a table, and the catalog of managed tables.

A table is a folder of row groups, each one Parquet file sorted by row id in ``__v=<write>/__rg=<group>``, with pages of
one vector's rows. Hidden columns give row ids, group and vector numbers, so that group terms prune partitions and
vector terms prune pages. A snapshot names the folder of each live group; a write makes new folders and then moves the
snapshot, so readers of an older one are never disturbed and a failed write leaves nothing behind but unnamed folders.
"""

from __future__ import annotations

import json
import threading
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, MapType, StringType, StructField, StructType, VariantType

from ..geometry import Geometry
from ..plans.pruning import GROUP, RID, VECTOR
from ..plans.rewrite import column, handle

WRITE = "__v"
HIDDEN = (RID, VECTOR, WRITE, GROUP)

#: Bytes of rows that one task of an ordered write sorts, so that it needn't spill; it holds them twice, by keys and by
#: groups. LEAST_BYTES, or more where OWN groups are larger: a group that two tasks share is written again. Up to BYPASS
#: tasks, Spark deals rows out without sorting them on the map side; more are made only beyond twice SORT_BYTES.
LEAST_BYTES, SORT_BYTES, OWN, BYPASS = 32 << 20, 128 << 20, 8, 200
#: Keys sampled to balance an ordered write: for each task, and in all.
SAMPLED, LEAST_SAMPLE, MOST_SAMPLE = 100, 20_000, 400_000


@dataclass
class Table:
    """A managed table. ``next_rid`` is the append high-water mark; ``groups`` maps live groups to write numbers."""

    name: str
    oid: int
    path: str
    schema: StructType
    geometry: Geometry
    next_rid: int = 0
    version: int = 0
    writes: int = 0
    indexed: bool = False
    keys: list[str] = field(default_factory=list)
    #: the last batch that each stream has appended
    streams: dict[str, int] = field(default_factory=dict)
    groups: dict[int, int] = field(default_factory=dict)
    lock: threading.RLock = field(default_factory=threading.RLock)

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    def stored_schema(self) -> StructType:
        return StructType([*self.schema.fields, StructField(RID, LongType()), StructField(VECTOR, LongType()), StructField(WRITE, IntegerType()), StructField(GROUP, IntegerType())])


def rows_of(spark: SparkSession, table: Table, groups=None) -> DataFrame:
    """All rows of a table (or of some groups) with the hidden columns."""
    return rows_at(spark, table, {g: w for g, w in table.groups.items() if groups is None or g in groups})


def rows_at(spark: SparkSession, table: Table, live: dict[int, int]) -> DataFrame:
    """Rows of groups as certain writes left them."""
    if not live:
        return spark.createDataFrame([], table.stored_schema())
    paths = [f"{table.path}/{WRITE}={w}/{GROUP}={g}" for g, w in sorted(live.items())]
    return spark.read.schema(table.stored_schema()).option("basePath", table.path).parquet(*paths)


def write_groups(table: Table, rows: DataFrame) -> int:
    """Write rows that have ``__rid``: one file for each group, one page for each vector. Returns the write's number."""
    return _write(table, _placed(table, rows).repartition(F.col(GROUP)))


def _placed(table: Table, rows: DataFrame) -> DataFrame:
    g = table.geometry
    return rows.select(*(F.col(f"`{c}`") for c in table.columns), RID, F.floor(F.col(RID) / g.vector_size).cast("long").alias(VECTOR), F.floor(F.col(RID) / g.row_group_size).cast("int").alias(GROUP))


def _write(table: Table, placed: DataFrame) -> int:
    g = table.geometry
    table.writes += 1
    while _exists(table, placed.sparkSession):  # what a failed write of an earlier session left
        table.writes += 1
    writer = placed.sortWithinPartitions(GROUP, RID).write.partitionBy(GROUP)
    writer.option("parquet.page.row.count.limit", g.vector_size).option("parquet.block.row.count.limit", max(g.row_group_size, 1)).parquet(f"{table.path}/{WRITE}={table.writes}")
    return table.writes


def write_ordered(table: Table, rows: DataFrame, order_by: list[str]) -> tuple[dict[int, int], int]:
    """Write rows by contiguous row ids in the order of ``order_by``, after those the table has. Returns the write of each
    group and how many rows there are.

    Rows are shuffled once. Bounds, taken from a sample of keys, deal them to tasks; only balance depends on the sample.
    The rows of each task are counted before from the keys, so that a task knows its first row id and writes its groups
    as it sorts. A group that two tasks share, or that the table holds a part of already, is put together afterwards.
    The write counts again: if the rows were dealt otherwise than counted, as an input may whose rows change from one
    evaluation to the next, it is thrown away and the rows are materialised first.
    """
    total = rows.count()
    if not total:
        return {}, 0
    done = _write_ordered(table, rows, order_by, total)
    if done is None:
        held = rows.checkpoint()
        total = held.count()
        done = _write_ordered(table, held, order_by, total) if total else {}
    if done is None:
        raise RuntimeError(f"rows of {table.name} could not be numbered")
    return done, total


def _write_ordered(table: Table, rows: DataFrame, order_by: list[str], total: int) -> dict[int, int] | None:
    """Groups and their writes, or None if the rows written are not those that were counted."""
    spark, size = rows.sparkSession, table.geometry.row_group_size
    bucket, place = (f"__{x}_{uuid.uuid4().hex}" for x in ("bucket", "place"))  # any other name may be a column's
    bounds = _bounds(rows, order_by, total, size)
    key = F.struct(*(F.col(k) for k in order_by))
    found = InternalFunction.array_binary_search(bounds, key) if bounds is not None else F.lit(-1)
    dealt = rows.withColumn(bucket, F.when(found >= 0, found + 1).otherwise(-1 - found).cast("int"))
    counts = dict(dealt.groupBy(bucket).count().collect())
    n = max(counts, default=0) + 1
    offsets = [table.next_rid]
    for b in range(n):
        offsets.append(offsets[-1] + counts.get(b, 0))
    if offsets[-1] != table.next_rid + total:
        return None
    at = F.split(F.lit(",".join(map(str, offsets))), ",").cast("array<bigint>")
    # the id's low 33 bits count the rows of a task, which has one bucket
    ordered = dealt.repartitionById(n, F.col(bucket)).sortWithinPartitions(bucket, *order_by)
    ordered = ordered.withColumn(place, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    numbered, seen = ordered.withColumn(RID, F.element_at(at, F.col(bucket) + 1) + F.col(place)), Observation()
    numbered = numbered.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(F.col(RID) >= F.element_at(at, F.col(bucket) + 2)).alias("beyond"))
    write = _write(table, _placed(table, numbered))
    if seen.get["n"] != total or seen.get["beyond"]:
        return None
    made = dict.fromkeys(table.geometry.groups_of_range(table.next_rid, total), write)
    shared = sorted({table.geometry.group_of(o) for o in offsets[:-1] if o % size} & made.keys())
    if shared:
        parts = rows_at(spark, table, dict.fromkeys(shared, write)).unionByName(rows_of(spark, table, shared))
        made |= dict.fromkeys(shared, write_groups(table, parts.select(*(F.col(f"`{c}`") for c in table.columns), RID)))
    return made


def _bounds(rows: DataFrame, order_by: list[str], total: int, group: int) -> Column | None:
    """Ascending keys that deal rows to tasks evenly, as an array of structs; None if one task does."""
    if total <= group:
        return None
    spark = rows.sparkSession
    wanted = min(MOST_SAMPLE, max(LEAST_SAMPLE, SAMPLED * total // max(group, 1 << 20)))
    wide = (StringType, BinaryType, ArrayType, MapType, StructType, VariantType)
    width = F.lit(8 * (len(rows.columns) + len(HIDDEN) + 2))
    for f in rows.schema:
        if isinstance(f.dataType, wide):
            own = F.col(f"`{f.name}`")
            width += 8 + F.coalesce(F.octet_length(own if isinstance(f.dataType, BinaryType) else own.cast("string")), F.lit(0))
    key = F.struct(*(F.col(k) for k in order_by))
    keys = rows.select(key.alias("k"), width.alias("w")).sample(min(1.0, wanted / total), 7).agg(F.sort_array(F.collect_list("k")).alias("k"), F.avg("w").alias("w"))
    row = keys._jdf.head()
    sample, drawn = row.get(0), row.get(0).size()
    if not drawn:
        return None
    size = total * row.get(1)
    each = min(max(LEAST_BYTES, OWN * group * row.get(1)), SORT_BYTES)
    n = max(min(-(-size // each), BYPASS), -(-size // (2 * SORT_BYTES)), min(spark.sparkContext.defaultParallelism, total // (4 * group)))
    n = int(min(n, -(-total // group), drawn))
    if n < 2:
        return None
    picked = [sample.apply(drawn * i // n) for i in range(1, n)]
    literal = handle(spark, "org.apache.spark.sql.catalyst.expressions.Literal").create(handle(spark, "PythonUtils").toSeq(picked), keys._jdf.schema().apply("k").dataType())
    return F.array_distinct(F.sort_array(column(spark, literal)))


def _exists(table: Table, spark: SparkSession) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{table.path}/{WRITE}={table.writes}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def written_groups(spark: SparkSession, table: Table, write: int) -> list[int]:
    """Groups that a write made, from the names of its folders."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{table.path}/{WRITE}={write}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{GROUP}="))


def with_row_ids(rows: DataFrame, first: int) -> tuple[DataFrame, int]:
    """``rows`` with contiguous ``__rid`` from ``first``, and how many there are.

    Rows keep their partitions' order. They are materialised first: counts of partitions give each its offset, and a second
    evaluation must not deal rows differently. The driver gets one count for each partition.
    """
    numbered = rows.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    held = numbered.checkpoint()
    counts = dict(held.groupBy("__p").count().collect())
    offsets, before = [], first
    for p in sorted(counts):
        offsets.append((p, before))
        before += counts[p]
    if not offsets:
        return rows.limit(0).withColumn(RID, F.lit(0).cast("long")), 0
    offsets = F.broadcast(rows.sparkSession.createDataFrame(offsets, "__p int, __at long"))
    # the id's low 33 bits count the rows of a partition
    inside = F.col("__i").bitwiseAND(F.lit((1 << 33) - 1))
    return held.join(offsets, "__p").withColumn(RID, F.col("__at") + inside).drop("__p", "__i", "__at"), before - first


class Catalog:
    """Managed tables by name; object ids only grow, so a table made anew under an old name is another one."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")
        self.tables: dict[str, Table] = {}
        self._last_oid = 0
        self._lock = threading.RLock()

    def next_oid(self) -> int:
        with self._lock:
            self._last_oid += 1
            return self._last_oid

    def add(self, name: str, schema: StructType, geometry: Geometry) -> Table:
        oid = self.next_oid()
        table = Table(name, oid, f"{self.root}/{name}-{oid}-{uuid.uuid4().hex[:8]}", schema, geometry)
        with self._lock:
            self.tables[name] = table
        return table

    def get(self, name: str) -> Table | None:
        return self.tables.get(name)

    def drop(self, name: str) -> Table | None:
        with self._lock:
            return self.tables.pop(name, None)


def save_manifest(spark: SparkSession, table: Table) -> None:
    """Write the snapshot beside the data, so that a table can be opened again by ``load_manifest``."""
    body = {"name": table.name, "schema": table.schema.jsonValue(), "row_group_size": table.geometry.row_group_size, "vector_size": table.geometry.vector_size, "next_rid": table.next_rid, "version": table.version, "writes": table.writes, "indexed": table.indexed, "keys": table.keys, "streams": table.streams, "groups": sorted(table.groups.items())}
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{table.path}/_snapshot-{table.version:08d}.json")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(json.dumps(body).encode()))
    out.close()


def load_manifest(spark: SparkSession, catalog: Catalog, path: str) -> Table:
    """Open a table from its newest snapshot, under a new object id."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().startswith("_snapshot-"))
    if not names:
        raise ValueError(f"no snapshot under {path}")
    body = json.loads(_read(spark, f"{path}/{names[-1]}"))
    table = Table(body["name"], catalog.next_oid(), path.rstrip("/"), StructType.fromJson(body["schema"]), Geometry(body["row_group_size"], body["vector_size"]), body["next_rid"], body["version"], body["writes"], body["indexed"], body.get("keys", []), body.get("streams", {}), {g: w for g, w in body["groups"]})
    catalog.tables[table.name] = table
    return table


def _read(spark: SparkSession, path: str) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
