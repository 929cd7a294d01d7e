"""Changes to managed tables: copy-on-write of the row groups they touch, and what that makes of cached entries."""

from __future__ import annotations

from collections.abc import Iterable
from contextlib import contextmanager
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.pruning import GROUP, RID
from ..sources.layout import Table, rows_of, save_manifest, with_row_ids, write_groups, write_ordered, written_groups
from .store import CacheStore


class Mode(Enum):
    """What a change makes of cached groups: those of changed rows go, those that rows are appended to, or both."""

    INVALIDATE = "INVALIDATE"
    INSERT = "INSERT"
    MERGE = "MERGE"


class Changes:
    """DML on the tables of one session. Entries are invalidated before and after the snapshot moves, under the table's
    lock: a failure can only forget too much."""

    def __init__(self, spark: SparkSession, store: CacheStore, on_change):
        self.spark, self.store, self.on_change = spark, store, on_change

    @contextmanager
    def _moving(self, table: Table, groups: Iterable[int]):
        groups = list(groups)
        before = table.groups, table.next_rid, table.version, dict(table.streams)
        self.store.remove_groups(table.oid, groups)
        try:
            yield
            table.version += 1
            save_manifest(self.spark, table)
        except BaseException:
            table.groups, table.next_rid, table.version, table.streams = before
            raise
        finally:
            self.store.remove_groups(table.oid, groups)
            self.on_change(table)

    def _groups_of(self, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(GROUP).distinct().collect()]

    def _replace(self, table: Table, groups: list[int], rows: DataFrame) -> None:
        """New contents for some groups; a group that is left without rows is no longer live."""
        write = write_groups(table, rows)
        made = written_groups(self.spark, table, write)
        live = {g: w for g, w in table.groups.items() if g not in groups}
        table.groups = live | {g: write for g in made}

    def insert(self, table: Table, rows: DataFrame, order_by: list[str] | None = None, *, batch: tuple[str, int] | None = None) -> int:
        """Append rows; columns are taken by name. Returns how many; none if the table already holds this batch of a
        stream."""
        with table.lock:
            if batch and table.streams.get(batch[0], -1) >= batch[1]:
                return 0
            typed = rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in table.schema))
            if order_by:
                made, n = write_ordered(table, typed, order_by)
            else:
                numbered, n = with_row_ids(typed, table.next_rid)
            if not n:
                return 0
            touched = list(table.geometry.groups_of_range(table.next_rid, n))
            tail = [g for g in touched if g in table.groups]
            if tail and not order_by:
                numbered = rows_of(self.spark, table, tail).select(*table.columns, RID).unionByName(numbered)
            with self._moving(table, touched):
                if order_by:
                    table.groups = table.groups | made
                else:
                    self._replace(table, tail, numbered)
                table.next_rid += n
                if batch:
                    table.streams[batch[0]] = batch[1]
            return n

    def delete(self, table: Table, condition: Column | None) -> int:
        """Delete the rows for which the condition is true (all rows without one). Returns the number of groups touched."""
        with table.lock:
            rows = rows_of(self.spark, table).alias(table.name)
            groups = sorted(table.groups) if condition is None else self._groups_of(rows.where(condition))
            if not groups:
                return 0
            own = rows_of(self.spark, table, groups).alias(table.name)
            kept = own.where(F.lit(False)) if condition is None else own.where(~F.coalesce(condition, F.lit(False)))
            with self._moving(table, groups):
                self._replace(table, groups, kept.select(*table.columns, RID))
            return len(groups)

    def update(self, table: Table, assignments: dict[str, Column], condition: Column | None) -> int:
        """Set columns of the rows for which the condition is true; rows keep their ids."""
        with table.lock:
            condition = F.lit(True) if condition is None else condition
            groups = self._groups_of(rows_of(self.spark, table).alias(table.name).where(condition))
            if not groups:
                return 0
            hit = F.coalesce(condition, F.lit(False))
            rows = rows_of(self.spark, table, groups).alias(table.name)
            columns = [F.when(hit, assignments[f.name].cast(f.dataType)).otherwise(F.col(f"{table.name}.`{f.name}`")).alias(f.name) if f.name in assignments else F.col(f"{table.name}.`{f.name}`") for f in table.schema]
            with self._moving(table, groups):
                self._replace(table, groups, rows.select(*columns, RID))
            return len(groups)

    def merge(self, table: Table, source: DataFrame, on: Column, *, matched=(), not_matched=(), target_alias: str | None = None, source_alias: str = "src") -> tuple[int, int]:
        """Merge a source. ``matched``: (condition or None, assignments or None for delete) in order; ``not_matched``:
        (condition or None, values). The first clause whose condition holds counts. A target row that several source
        rows match is an error. The source is evaluated once, and both parts become visible by one move of the snapshot.
        Returns groups touched and rows inserted."""
        name = target_alias or table.name
        with table.lock:
            source = source.checkpoint().alias(source_alias)
            target = rows_of(self.spark, table).alias(name)
            groups, inserted = [], None
            if not_matched:
                fresh = source.join(target, on, "left_anti")
                which = F.lit(None).cast("int")
                for i, (condition, _) in reversed(list(enumerate(not_matched))):
                    which = F.when(F.lit(True) if condition is None else condition, F.lit(i)).otherwise(which)
                fresh = fresh.withColumn("__clause", which).where(F.col("__clause").isNotNull())
                columns = []
                for f in table.schema:
                    value = F.lit(None)
                    for i, (_, values) in enumerate(not_matched):
                        value = F.when(F.col("__clause") == i, values.get(f.name, F.lit(None))).otherwise(value)
                    columns.append(value.cast(f.dataType).alias(f.name))
                inserted = fresh.select(*columns)
            if matched:
                hits = target.join(source, on).select(F.col(f"{name}.{RID}").alias(RID), F.col(f"{name}.{GROUP}").alias(GROUP))
                counts = hits.groupBy(RID, GROUP).count()
                if counts.where("count > 1").limit(1).count():
                    raise ValueError("a target row is matched by more than one source row")
                groups = self._groups_of(hits)
            parts, touched, tail, n = [], [], [], 0
            if groups:
                own = rows_of(self.spark, table, groups).alias(name)
                joined = own.join(source.withColumn("__hit", F.lit(True)).alias(source_alias), on, "left")
                clause = F.lit(None).cast("int")
                for i, (condition, _) in reversed(list(enumerate(matched))):
                    clause = F.when(F.lit(True) if condition is None else F.coalesce(condition, F.lit(False)), F.lit(i)).otherwise(clause)
                joined = joined.withColumn("__clause", F.when(F.col(f"{source_alias}.__hit"), clause))
                gone = [i for i, (_, a) in enumerate(matched) if a is None]
                if gone:
                    joined = joined.where(F.coalesce(~F.col("__clause").isin(gone), F.lit(True)))
                columns = []
                for f in table.schema:
                    value = F.col(f"{name}.`{f.name}`")
                    for i, (_, a) in enumerate(matched):
                        if a and f.name in a:
                            value = F.when(F.col("__clause") == i, a[f.name].cast(f.dataType)).otherwise(value)
                    columns.append(value.alias(f.name))
                parts.append(joined.select(*columns, F.col(f"{name}.{RID}").alias(RID)))
            if inserted is not None:
                numbered, n = with_row_ids(inserted, table.next_rid)
            if n:
                touched = list(table.geometry.groups_of_range(table.next_rid, n))
                tail = [g for g in touched if g in table.groups and g not in groups]
                parts.append(numbered)
                if tail:
                    parts.append(rows_of(self.spark, table, tail).select(*table.columns, RID))
            if parts:
                rows = parts[0]
                for part in parts[1:]:
                    rows = rows.unionByName(part)
                with self._moving(table, sorted({*groups, *touched})):
                    self._replace(table, [*groups, *tail], rows)
                    table.next_rid += n
            return len(groups), n

    def upsert(self, table: Table, source: DataFrame, keys: list[str], *, update: dict[str, Column] | None = None, ignore: bool = False) -> tuple[int, int]:
        """Insert rows, or where the keys exist already update them (all other columns, or ``update``) or ignore them."""
        on = F.lit(True)
        for k in keys:
            on &= F.col(f"{table.name}.`{k}`") == F.col(f"excluded.`{k}`")
        values = {c: F.col(f"excluded.`{c}`") for c in source.columns if c in table.columns}
        sets = update if update is not None else {c: v for c, v in values.items() if c not in keys}
        return self.merge(table, source, on, matched=() if ignore or not sets else [(None, sets)], not_matched=[(None, values)], source_alias="excluded")

    def truncate(self, table: Table, oid: int) -> None:
        """Forget all rows. The table becomes another one for the cache."""
        with table.lock:
            self.store.remove_table(table.oid)
            table.oid, table.groups, table.next_rid = oid, {}, 0
            table.version += 1
            save_manifest(self.spark, table)
            self.on_change(table)
