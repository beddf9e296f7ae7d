"""Data folders as catalog tables with column statistics, and schema graphs over them."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.IntegralType, T.FractionalType, T.DecimalType)
TEXT = (T.StringType, T.CharType, T.VarcharType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def database_name(folder: str) -> str:
    """The database that a folder's tables are registered in."""
    return "sq_" + hashlib.md5(folder.encode()).hexdigest()[:12]


def register_folder(spark: SparkSession, folder: str, tables: tuple[str, ...], analyze: bool = True) -> str:
    """A database of external tables over the folder's parquet files; its name.

    With ``analyze``, row counts and column statistics are computed for tables that have none,
    so that the cost-based optimizer has estimates: a full scan of each, once. Idempotent. The
    log is no table of it.
    """
    database = database_name(folder)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name in tables:
        full = f"{database}.{name}"
        if not spark.catalog.tableExists(full):
            spark.sql(f"CREATE TABLE {full} USING parquet LOCATION '{folder}/{name}.parquet'")
    if analyze:
        refresh_statistics(spark, database)
    return database


def table_names(spark: SparkSession, database: str) -> list[str]:
    """The tables of a database, without the session's temporary views."""
    return [t.name for t in spark.catalog.listTables(database) if not t.isTemporary]


def refresh_statistics(spark: SparkSession, database: str, only_missing: bool = True) -> list[str]:
    """Compute row counts and column statistics, of all tables or of those that have none; their names."""
    done = []
    for name in table_names(spark, database):
        full = f"{database}.{name}"
        if not only_missing or row_count(spark, full) is None:
            spark.catalog.refreshTable(full)
            spark.sql(f"ANALYZE TABLE {full} COMPUTE STATISTICS FOR ALL COLUMNS")
            done.append(name)
    return done


def row_count(spark: SparkSession, table: str) -> int | None:
    """Rows of a table by its statistics in the catalog; None without."""
    stats = _metadata(spark, table).stats()
    rows = stats.get().rowCount() if stats.isDefined() else None
    return int(str(rows.get())) if rows is not None and rows.isDefined() else None


def cardinalities(spark: SparkSession, database: str) -> dict[str, int]:
    """Rows of each table, at least 1; counted where there are no statistics."""
    out = {}
    for name in table_names(spark, database):
        rows = row_count(spark, f"{database}.{name}")
        out[name] = max(1, spark.table(f"{database}.{name}").count() if rows is None else rows)
    return out


@dataclass(frozen=True)
class ForeignKey:
    """``table.column`` refers to ``target.target_column``."""

    table: str
    column: str
    target: str
    target_column: str
    inferred: bool = False


@dataclass
class SchemaGraph:
    """Tables with columns and rows, and the edges between them."""

    columns: dict[str, dict[str, T.DataType]]
    rows: dict[str, int]
    keys: list[ForeignKey] = field(default_factory=list)

    def neighbours(self, table: str) -> list[str]:
        """Tables joined to ``table`` in either direction, in name order."""
        ends = {k.target for k in self.keys if k.table == table} | {k.table for k in self.keys if k.target == table}
        return sorted(ends - {table})

    def join_condition(self, a: str, b: str, names: dict[str, str] | None = None) -> str | None:
        """The first edge between two tables as SQL, with aliases."""
        names = names or {}
        for k in self.keys:
            if {k.table, k.target} == {a, b}:
                return f"{names.get(k.table, k.table)}.{k.column} = {names.get(k.target, k.target)}.{k.target_column}"
        return None

    def connected_subsets(self, size: int, limit: int = 50) -> list[tuple[str, ...]]:
        """Up to ``limit`` connected sets of tables, in depth first from the largest table on."""
        found: list[tuple[str, ...]] = []
        seen: set[frozenset] = set()
        waiting = [(t,) for t in sorted(self.columns, key=lambda t: (self.rows.get(t, 0), t))]  # the last goes first
        while waiting and len(found) < limit:
            part = waiting.pop()
            if frozenset(part) in seen:
                continue
            seen.add(frozenset(part))
            if len(part) == size:
                found.append(part)
            else:
                near = sorted({n for t in part for n in self.neighbours(t)} - set(part), reverse=True)
                waiting += [(*part, n) for n in near]
        return found

    def summary(self) -> dict:
        """Counts and the ten largest tables."""
        top = sorted(self.rows.items(), key=lambda r: (-r[1], r[0]))[:10]
        total = sum(self.rows.values())
        return {"n_tables": len(self.columns), "n_foreign_keys": len(self.keys), "inferred": any(k.inferred for k in self.keys), "total_rows": total, "largest": [{"table": t, "rows": n, "share": n / total if total else 0.0} for t, n in top]}

    def edges(self, spark: SparkSession) -> DataFrame:
        """The edges as rows."""
        return spark.createDataFrame([(k.table, k.column, k.target, k.target_column, k.inferred) for k in self.keys], "src_table string, src_column string, tgt_table string, tgt_column string, inferred boolean")


def infer_keys(columns: dict[str, dict[str, T.DataType]], known: list[ForeignKey] | None = None) -> list[ForeignKey]:
    """Edges that names suggest, between integral columns only.

    ``<t>_id`` refers to ``<t>.id``, or to the id of the only table whose name begins ``<t>_``
    or is the plural of ``<t>``; a column ``x_<name>key`` refers to ``y_<name>key`` of the only
    table that begins with this column and whose name begins ``<name>``.
    """
    integral = {(t, c) for t, cs in columns.items() for c, k in cs.items() if isinstance(k, T.IntegralType)}
    out = list(known or [])
    have = {(k.table, k.column) for k in out}
    heads: dict[str, list[tuple[str, str]]] = {}
    for t, cs in columns.items():
        for c in list(cs)[:1]:
            name = c.split("_", 1)[-1]
            if "_" in c and name.endswith("key") and t.startswith(name.removesuffix("key")):
                heads.setdefault(name, []).append((t, c))
    for t, c in sorted(integral):
        if (t, c) in have:
            continue
        target = None
        if c.endswith("_id"):
            stem = c[:-3]
            with_id = [n for n in columns if (n, "id") in integral]
            fits = [n for n in with_id if n in (stem, stem + "s", stem + "es")] or [n for n in with_id if n.startswith(stem + "_")]
            if len(fits) == 1:
                target = (fits[0], "id")
        elif "_" in c and len(heads.get(c.split("_", 1)[1], ())) == 1:
            target = heads[c.split("_", 1)[1]][0]
            target = target if target in integral else None
        if target and target[0] != t:
            out.append(ForeignKey(t, c, *target, inferred=True))
    return out


#: The table property that declares foreign keys: "column -> table.column, ...".
KEYS_PROPERTY = "sparquill.foreign_keys"


def _metadata(spark: SparkSession, table: str):
    session = spark._jsparkSession.sessionState()
    return session.catalog().getTableMetadata(session.sqlParser().parseTableIdentifier(table))


def declared_keys(spark: SparkSession, database: str) -> list[ForeignKey]:
    """The edges that table properties declare; what is not of their form is passed over."""
    out = []
    for t in table_names(spark, database):
        found = _metadata(spark, f"{database}.{t}").properties().get(KEYS_PROPERTY)
        for part in found.get().split(",") if found.isDefined() else ():
            m = re.fullmatch(r"\s*(\w+)\s*->\s*(\w+)\.(\w+)\s*", part)
            if m:
                out.append(ForeignKey(t, *m.groups()))
    return out


def layout_columns(spark: SparkSession, table: str) -> list[str]:
    """The columns that a table is partitioned, bucketed and, within buckets, sorted by."""
    found = [c.name for c in spark.catalog.listColumns(table) if c.isPartition or c.isBucket]
    spec = _metadata(spark, table).bucketSpec()
    names = spec.get().sortColumnNames() if spec.isDefined() else None
    return found + ([names.apply(i) for i in range(names.size())] if names is not None else [])


def discover(spark: SparkSession, database: str, declared: list[ForeignKey] | None = None) -> SchemaGraph:
    """The graph of a database; edges are inferred only where none are declared, be it here or by
    table properties."""
    columns = {t: {f.name: f.dataType for f in spark.table(f"{database}.{t}").schema} for t in table_names(spark, database)}
    known = [k for k in declared or declared_keys(spark, database) if k.table in columns and k.target in columns]
    return SchemaGraph(columns, cardinalities(spark, database), known or infer_keys(columns))


def unclustered_keys(spark: SparkSession, database: str, graph: SchemaGraph) -> list[ForeignKey]:
    """Edges whose column is no part of its table's layout."""
    layouts = {k.table: layout_columns(spark, f"{database}.{k.table}") for k in graph.keys}
    return [k for k in graph.keys if k.column not in layouts[k.table]]


def without_layout(edges: DataFrame, layouts: DataFrame) -> DataFrame:
    """Edges whose column does not lead the layout (src_table, columns) of its table: rows of one
    value are then spread over the table."""
    leads = layouts.select("src_table", F.get("columns", 0).alias("src_column"))
    return edges.join(leads, ["src_table", "src_column"], "left_anti")


def laid_out_by(layouts: DataFrame, column: str) -> DataFrame:
    """The layouts that hold a column at any place."""
    return layouts.where(F.array_contains("columns", column))


def orphan_rows(spark: SparkSession, folder: str, key: ForeignKey) -> DataFrame:
    """Rows of an edge's column whose value the target lacks: evidence against the edge."""
    left = spark.read.parquet(f"{folder}/{key.table}.parquet").select(F.col(key.column).alias("value")).where(F.col("value").isNotNull())
    right = spark.read.parquet(f"{folder}/{key.target}.parquet").select(F.col(key.target_column).alias("value"))
    return left.join(right, "value", "left_anti").agg(F.count(F.lit(1)).alias("n_orphans"))
