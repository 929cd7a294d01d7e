"""The engine: managed tables, SQL with predicate skipping, and the cache's functions and setting."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections import OrderedDict

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType, _parse_datatype_json_string

from .geometry import Geometry
from .operators.build import build_entry
from .operators.dml import Changes, Mode
from .operators.store import CacheEntry, CacheKey, CacheStore
from .plans.keys import Uncacheable, children, kind
from .plans.pruning import GROUP, IN_LIMIT, RID, VECTOR, pruning_predicate
from .plans.rewrite import Match, closed, column, dataset, key_of, rewrite
from .sources.layout import Catalog, Table, load_manifest, rows_of, save_manifest

#: The setting, the two table functions, and their result columns.
SETTING = "use_query_condition_cache"
BUILD, INFO = "condition_cache_build", "condition_cache_info"
INFO_COLUMNS = ("cached_row_groups", "total_row_groups", "qualifying_vectors", "total_vectors")

#: Statements whose rewritten plans are kept, and the session settings that analysis depends on.
STATEMENTS = 256
SESSION = ("spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.caseSensitive")

_LITERAL = r"'((?:[^']|'')*)'"
_CALL = re.compile(rf"\b({BUILD}|{INFO})\s*\(\s*{_LITERAL}\s*,\s*{_LITERAL}\s*\)", re.I)
_TRUNCATE = re.compile(r"^\s*truncate\s+(?!table\b)", re.I)
_INSERT_VALUES = re.compile(r"\binsert\s+values\s*\(", re.I)
_CONFLICT = re.compile(r"^(\s*insert\s+into\s+.*?)\s+on\s+conflict\s*(?:\(([^)]*)\))?\s*do\s+(nothing|update\s+set\s+(.*?))\s*;?\s*$", re.I | re.S)
_REPLACE = re.compile(r"^\s*insert\s+or\s+replace\s+into\s+", re.I)


class EngineError(ValueError):
    """A statement that names what doesn't exist, or a predicate that can't be used."""


class Engine:
    """One session's tables and cache.

    ``sql`` and ``accelerate`` skip blocks that a cached predicate has no match in; plain ``spark.sql`` over the same
    views gives the same rows without skipping. A DataFrame reads the snapshot it was made on.
    """

    def __init__(self, spark: SparkSession, *, root: str | None = None, geometry: Geometry | None = None, budget_bytes: int = 256 << 20, catalog: str = "memory", schema: str = "main"):
        self.spark = spark
        self.geometry = geometry or Geometry()
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise EngineError("set spark.checkpoint.dir to a folder that all executors share")
        if not spark.sparkContext.getCheckpointDir() and not shared:
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="skiplight-checkpoint-"))
        elif shared and not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(shared)
        base = root or (f"{shared.rstrip('/')}/skiplight-tables" if shared else "file://" + tempfile.mkdtemp(prefix="skiplight-tables-"))
        self.catalog = Catalog(f"{base.rstrip('/')}/{uuid.uuid4().hex[:12]}" if not root else base)
        self.names = (catalog, schema)
        self.store = CacheStore(budget_bytes)
        self.changes = Changes(spark, self.store, self._register)
        self.keys: dict[str, list[str]] = {}
        self._plans: OrderedDict[str, tuple] = OrderedDict()
        # Parquet tests a pushed IN list by value up to this many
        spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(max(IN_LIMIT, int(spark.conf.get("spark.sql.parquet.pushdown.inFilterThreshold")))))

    # ---- tables

    def create_table(self, name: str, rows: DataFrame, *, order_by: list[str] | None = None, geometry: Geometry | None = None, primary_key: list[str] | None = None, indexed: bool = False) -> Table:
        """Ingest rows under contiguous row ids, in the order of ``order_by`` or as they come."""
        name = self._plain(name)
        if name in self.catalog.tables:
            raise EngineError(f"Table with name {name} already exists")
        clash = {RID, VECTOR, GROUP, "__v"} & set(rows.columns)
        if clash:
            raise EngineError(f"columns {sorted(clash)} are reserved")
        table = self.catalog.add(name, rows.schema, geometry or self.geometry)
        # a primary key is an index, and automatic caching leaves indexed tables alone
        table.indexed = indexed or bool(primary_key)
        self.keys[name] = table.keys = list(primary_key or [])
        if not self.changes.insert(table, rows, order_by):
            save_manifest(self.spark, table)
            self._register(table)
        return table

    def open_table(self, path: str) -> Table:
        """Open a table that an earlier session wrote."""
        table = load_manifest(self.spark, self.catalog, path)
        self.keys[table.name] = table.keys
        self._register(table)
        return table

    def drop_table(self, name: str, *, if_exists: bool = False) -> None:
        if if_exists and self.catalog.get(self._plain(name)) is None:
            return
        table = self._table(name)
        self.catalog.drop(table.name)
        self.store.remove_table(table.oid)
        self.spark.catalog.dropTempView(table.name)

    def alter_table(self, name: str, rows: DataFrame) -> Table:
        """Replace a table's columns and rows, as any ALTER does: it becomes a new table for the cache."""
        self.drop_table(name)
        return self.create_table(name, rows)

    def insert(self, name: str, rows: DataFrame, *, batch: tuple[str, int] | None = None) -> int:
        """Append rows. A ``batch`` (stream, number) that the table already holds isn't appended again."""
        return self.changes.insert(self._table(name), rows, batch=batch)

    def upsert(self, name: str, rows: DataFrame, keys: list[str] | str) -> tuple[int, int]:
        return self.changes.upsert(self._table(name), rows, [keys] if isinstance(keys, str) else keys)

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self._table(name).name)

    def _plain(self, name: str) -> str:
        """The table's own name of ``t``, ``schema.t`` or ``catalog.schema.t``."""
        parts = [p.strip("`\" ") for p in name.split(".")]
        for given, own, what in zip(parts[-2::-1], self.names[::-1], ('schema "{}" does not exist', 'Catalog "{}" does not exist')):
            if given.lower() != own:
                raise EngineError(what.format(given))
        return parts[-1].lower()

    def _table(self, name: str) -> Table:
        found = self.catalog.get(self._plain(name))
        if found is None:
            raise EngineError(f"Table with name {self._plain(name)} does not exist")
        return found

    def _register(self, table: Table, with_rowid: bool = False) -> None:
        rows = rows_of(self.spark, table)
        extra = [F.col(RID).alias("rowid")] if with_rowid else []
        rows.select(*(F.col(f"`{c}`") for c in table.columns), *extra).createOrReplaceTempView(table.name)

    # ---- the cache

    @property
    def enabled(self) -> bool:
        return str(self.spark.conf.get(SETTING, "true")).lower() == "true"

    def set_enabled(self, on: bool) -> None:
        """Turning the cache off forgets all entries."""
        self.spark.conf.set(SETTING, str(on).lower())
        if not on:
            self.store.clear()
            self._plans.clear()

    def _bound(self, table: Table, predicate: str):
        """(key, condition as a Column over the hidden rows) of a predicate's text; the key is '' for a blank one."""
        if not predicate.strip():
            return "", None
        view = f"__bound_{table.name}_{uuid.uuid4().hex[:8]}"
        rows = rows_of(self.spark, table)
        rows.select(*(F.col(f"`{c}`") for c in table.columns)).createOrReplaceTempView(view)
        try:
            picked = self.spark.sql(f"SELECT ({predicate}) AS p FROM {view}")._jdf.queryExecution().analyzed()
            expr = children(picked.projectList().apply(0))[0]
            if expr.dataType().simpleString() == "boolean":
                condition = column(self.spark, expr)
            else:
                condition = column(self.spark, expr).cast("int").cast("boolean")
                if kind(expr) == "Cast" and expr.dataType().simpleString() == "int":
                    expr = children(expr)[0]
            relation = picked
            while children(relation):
                relation = children(relation)[0]
            return key_of([expr]), (dataset(self.spark, relation), condition)
        except AnalysisException as e:
            name = re.search(r"column, variable, or function parameter with name `?([^` ]+)`?", str(e))
            if name:
                raise EngineError(f'Table "{table.name}" does not contain column {name[1]}') from e
            raise EngineError(f"failed to parse predicate: {e}") from e
        finally:
            self.spark.catalog.dropTempView(view)

    def condition_cache_build(self, name: str, predicate: str) -> DataFrame:
        """Build and store the entry of a predicate, also while the setting is off."""
        table = self._table(name)
        try:
            key, bound = self._bound(table, predicate)
        except Uncacheable as e:
            raise EngineError(f"the predicate can't be cached: {e}") from e
        if bound is None:
            raise EngineError("failed to parse predicate")
        try:
            entry = build_entry(*bound, table.geometry)
        except PySparkException as e:
            if "CAST_INVALID_INPUT" in str(e):
                raise EngineError("Could not convert string to INT32") from e
            raise
        self.store.upsert(CacheKey(table.oid, key), entry)
        s = entry.stats(table.next_rid)
        status = f"Cache Built: {s.qualifying_vectors}/{s.total_vectors} vectors, {s.qualifying_row_groups}/{s.total_row_groups} row groups"
        return self.spark.createDataFrame([(status,)], StructType([StructField("status", StringType())]))

    def condition_cache_info(self, name: str, predicate: str) -> DataFrame:
        """What the entry of a predicate holds; zeros where there is none."""
        table = self._table(name)
        try:
            key, _ = self._bound(table, predicate)
        except Uncacheable:
            key = ""
        entry = self.store.lookup(CacheKey(table.oid, key))
        row = (0, 0, 0, 0)
        if entry is not None:
            s = entry.stats(table.next_rid)
            row = (s.qualifying_row_groups, s.total_row_groups, s.qualifying_vectors, s.total_vectors)
        return self.spark.createDataFrame([row], StructType([StructField(c, IntegerType()) for c in INFO_COLUMNS]))

    def _entry_for(self, m: Match) -> tuple[Table, CacheEntry] | None:
        """The entry of a match, built on a miss."""
        table = self.catalog.get(m.table)
        if table is None or table.indexed:
            return None
        try:
            key = CacheKey(table.oid, key_of(m.conditions))
        except Uncacheable:
            return None
        entry = self.store.lookup(key)
        if entry is None:
            version = table.version
            condition = F.lit(True)
            for c in m.conditions:
                condition &= column(self.spark, c)
            entry = build_entry(dataset(self.spark, m.relation), condition, table.geometry)
            with table.lock:
                if table.version == version:  # else a change came in between
                    self.store.upsert(key, entry)
        return table, entry

    def _predicate_for(self, m: Match) -> str | None:
        found = self._entry_for(m)
        return pruning_predicate(found[1].snapshot(), found[0].groups, found[0].geometry) if found else None

    def accelerate(self, df: DataFrame) -> DataFrame:
        """The same query with pruning filters at the scans of managed tables. Never fails: what can't be rewritten runs
        as it is."""
        if not self.enabled:
            return df
        try:
            views = {t: t for t in self.catalog.tables}
            plan, n = rewrite(self.spark, df._jdf.queryExecution().analyzed(), views, self._predicate_for)
            return dataset(self.spark, plan) if n else df
        except Exception:
            return df

    # ---- SQL

    def sql(self, text: str) -> DataFrame:
        """Run a statement. Changes, settings and the cache's functions take effect at once; a query's rows come from the
        DataFrame returned."""
        conflict = _CONFLICT.match(text)
        if conflict:
            return self._insert_on_conflict(conflict)
        if _REPLACE.match(text):
            return self._insert_on_conflict(None, _REPLACE.sub("INSERT INTO ", text))
        text = _TRUNCATE.sub("TRUNCATE TABLE ", text)
        text = self._with_functions(text)
        plan = self._parse(self._with_merge_columns(text))
        run = {"SetCommand": self._set, "CreateTableAsSelect": self._create, "CreateTable": self._create, "InsertIntoStatement": self._insert, "DeleteFromTable": self._delete, "UpdateTable": self._update, "MergeIntoTable": self._merge, "TruncateTable": self._truncate, "DropTable": self._drop}.get(kind(plan))
        if run is not None:
            done = run(plan, text)
            return self.spark.createDataFrame([], "Success string") if done is None else done
        return self._query(text)

    def _query(self, text: str) -> DataFrame:
        """A query's DataFrame. The rewritten plan of a statement that reads managed tables alone is kept while no table
        changes, so that a recurring statement is neither analyzed nor matched again; it is optimized and run anew."""
        if not self.enabled:
            return self._select(text)
        state = (tuple((t.oid, t.version) for t in self.catalog.tables.values()), *(self.spark.conf.get(c) for c in SESSION))
        held = self._plans.get(text)
        if held and held[0] == state:
            self._plans.move_to_end(text)
            return dataset(self.spark, held[1])
        df = self._select(text)
        fast = self.accelerate(df)
        if fast is not df:
            try:
                if closed(df._jdf.queryExecution().analyzed(), {t: t for t in self.catalog.tables}):
                    self._plans[text] = (state, fast._jdf.queryExecution().analyzed())
                    while len(self._plans) > STATEMENTS:
                        self._plans.popitem(last=False)
            except Exception:
                pass  # a plan that can't be told to be closed is not kept
        return fast

    def _parse(self, text: str):
        return self.spark._jsparkSession.sessionState().sqlParser().parsePlan(text)

    def _select(self, text: str) -> DataFrame:
        try:
            return self.spark.sql(text)
        except AnalysisException as e:
            if "rowid" not in str(e).lower():
                raise
            # the hidden row id was asked for
            for t in list(self.catalog.tables.values()):
                self._register(t, with_rowid="rowid" not in t.columns)
            try:
                return self.spark.sql(text)
            finally:
                for t in list(self.catalog.tables.values()):
                    self._register(t)

    def _with_functions(self, text: str) -> str:
        """Calls of the cache's table functions, replaced by views of their one row."""

        def call(m):
            args = [m[i].replace("''", "'") for i in (2, 3)]
            run = self.condition_cache_build if m[1].lower() == BUILD else self.condition_cache_info
            view = f"__call_{uuid.uuid4().hex[:12]}"
            run(*args).createOrReplaceTempView(view)
            return view

        return _CALL.sub(call, text)

    def _with_merge_columns(self, text: str) -> str:
        """``INSERT VALUES (...)`` of a MERGE names the target's columns."""
        if not _INSERT_VALUES.search(text):
            return text
        target = re.search(r"\bmerge\s+into\s+([\w.`\"]+)", text, re.I)
        if not target:
            return text
        names = ", ".join(f"`{c}`" for c in self._table(target[1]).columns)
        return _INSERT_VALUES.sub(lambda _: f"INSERT ({names}) VALUES (", text)

    def _managed(self, node) -> tuple[Table | None, str | None]:
        """The managed table that a parsed relation names, and its alias."""
        alias = None
        while kind(node) == "SubqueryAlias":
            alias = node.alias()
            node = children(node)[0]
        parts = node.nameParts() if kind(node) == "UnresolvedIdentifier" else node.multipartIdentifier()
        name = ".".join(parts.apply(i) for i in range(parts.size()))
        plain = name.rpartition(".")[2].lower()
        return (self._table(name) if plain in self.catalog.tables else None), alias

    def _plain_sql(self, text: str) -> DataFrame:
        return self.spark.sql(text)

    def _set(self, plan, text):
        pair = plan.kv()
        if pair.isDefined() and pair.get()._1() == SETTING and pair.get()._2().isDefined():
            self.set_enabled(pair.get()._2().get().strip("'\" ").lower() in ("true", "1", "on"))
            return None
        return self._plain_sql(text)

    def _create(self, plan, text):
        parts = plan.name().nameParts()
        name = ".".join(parts.apply(i) for i in range(parts.size()))
        if kind(plan) == "CreateTableAsSelect":
            rows = dataset(self.spark, plan.query())
        else:
            columns = plan.columns()
            fields = [columns.apply(i) for i in range(columns.size())]
            rows = self.spark.createDataFrame([], StructType([StructField(c.name(), _parse_datatype_json_string(c.dataType().json())) for c in fields]))
        if plan.ignoreIfExists() and self.catalog.get(self._plain(name)) is not None:
            return None
        self.create_table(name, rows)

    def _insert(self, plan, text):
        table, _ = self._managed(plan.table())
        if table is None:
            return self._plain_sql(text)
        self.changes.insert(table, self._incoming(plan, table))

    def _incoming(self, plan, table: Table) -> DataFrame:
        """The rows of an INSERT under the table's column names; columns that aren't named are null."""
        rows = dataset(self.spark, plan.query())
        given = plan.userSpecifiedCols()
        names = [given.apply(i) for i in range(given.size())] or table.columns
        if len(names) != len(rows.columns):
            raise EngineError(f"table {table.name} takes {len(names)} columns, {len(rows.columns)} were given")
        rows = rows.toDF(*names)
        return rows.select(*(F.col(f"`{c}`") if c in names else F.lit(None).alias(c) for c in table.columns))

    def _insert_on_conflict(self, m, replaced: str | None = None):
        plan = self._parse(replaced or m[1])
        table, _ = self._managed(plan.table())
        if table is None:
            raise EngineError("ON CONFLICT needs a managed table")
        rows = self._incoming(plan, table)
        keys = [k.strip(" `\"") for k in (m[2] if m and m[2] else "").split(",") if k.strip()] or self.keys.get(table.name)
        if not keys:
            raise EngineError("ON CONFLICT needs key columns")
        ignore, update = bool(m and m[3].lower().startswith("nothing")), None
        if m and not ignore:
            parsed = self._parse(f"UPDATE {table.name} SET {m[4]}")
            update = self._assignments(parsed.assignments())
        self.changes.upsert(table, rows, keys, update=update, ignore=ignore)
        return self.spark.createDataFrame([], "Success string")

    def _assignments(self, seq) -> dict:
        out = {}
        for i in range(seq.size()):
            a = seq.apply(i)
            parts = a.key().nameParts()
            out[parts.apply(parts.size() - 1)] = column(self.spark, a.value())
        return out

    def _delete(self, plan, text):
        table, alias = self._managed(plan.table())
        if table is None:
            return self._plain_sql(text)
        self.changes.delete(table, column(self.spark, plan.condition()))

    def _update(self, plan, text):
        table, alias = self._managed(plan.table())
        if table is None:
            return self._plain_sql(text)
        condition = column(self.spark, plan.condition().get()) if plan.condition().isDefined() else None
        self.changes.update(table, self._assignments(plan.assignments()), condition)

    def _merge(self, plan, text):
        table, alias = self._managed(plan.targetTable())
        if table is None:
            return self._plain_sql(text)
        source = plan.sourceTable()
        source_alias = source.alias() if kind(source) == "SubqueryAlias" else source.multipartIdentifier().last()
        rows = dataset(self.spark, source)
        if plan.notMatchedBySourceActions().size():
            raise EngineError("WHEN NOT MATCHED BY SOURCE is not supported")

        def clauses(seq):
            for i in range(seq.size()):
                action = seq.apply(i)
                condition = column(self.spark, action.condition().get()) if action.condition().isDefined() else None
                name = kind(action)
                if name == "DeleteAction":
                    yield condition, None
                elif "Star" in name:
                    yield condition, {c: F.col(f"{source_alias}.`{c}`") for c in table.columns}
                else:
                    yield condition, self._assignments(action.assignments())

        self.changes.merge(table, rows, column(self.spark, plan.mergeCondition()), matched=list(clauses(plan.matchedActions())), not_matched=list(clauses(plan.notMatchedActions())), target_alias=alias, source_alias=source_alias)

    def _truncate(self, plan, text):
        table, _ = self._managed(plan.table())
        if table is None:
            return self._plain_sql(text)
        self.changes.truncate(table, self.catalog.next_oid())

    def _drop(self, plan, text):
        table, _ = self._managed(plan.child())
        if table is None:
            return self._plain_sql(text)
        self.drop_table(table.name)

    # ---- explanations

    def explain_dml(self, text: str) -> str:
        """What a change would do to the cache, without running it."""
        text = _TRUNCATE.sub("TRUNCATE TABLE ", text)
        conflict = _CONFLICT.match(text)
        plan = self._parse(conflict[1] if conflict else self._with_merge_columns(text))
        mode = {"DeleteFromTable": Mode.INVALIDATE, "UpdateTable": Mode.INVALIDATE, "InsertIntoStatement": Mode.MERGE if conflict else Mode.INSERT, "MergeIntoTable": Mode.MERGE}.get(kind(plan))
        if mode is None:
            return kind(plan)
        table, _ = self._managed(plan.targetTable() if kind(plan) == "MergeIntoTable" else plan.table())
        if table is None:
            return kind(plan)
        lines = ["CACHE_INVALIDATOR", f"Table OID: {table.oid}", f"Mode: {mode.value}"]
        if mode is not Mode.INSERT:
            lines.append(f"Row ID Column: {RID}")
        if mode is not Mode.INVALIDATE:
            lines.append(f"Pre-insert Rows: {table.next_rid}")
        return "\n".join(lines)

    def pruning_of(self, text: str) -> list[str]:
        """The pruning filters that a query would get."""
        out = []

        def note(m):
            sql = self._predicate_for(m)
            out.append(sql)
            return sql

        rewrite(self.spark, self._select(text)._jdf.queryExecution().analyzed(), {t: t for t in self.catalog.tables}, note)
        return [x for x in out if x]


def scan_metrics(df: DataFrame) -> dict[str, int]:
    """Files and rows that the scans of an executed query read."""
    out = {"numFiles": 0, "numOutputRows": 0}
    stack = [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        name = kind(node)
        if name == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            stack.append(node.plan())
            continue
        if name == "FileSourceScanExec":
            for k in out:
                out[k] += node.metrics().apply(k).value()
        stack += children(node)
    return out
