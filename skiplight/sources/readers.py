"""Inputs that are ingested into managed tables: CSV, Parquet, raw log lines, and ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The parts of a log4j line and their column names; milliseconds are dropped.
LOG_LINE = r"^(\d{4}-\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2}),\d{3}\s+(\w+)\s+([^:]+):\s+(.*)$"
LOG_COLUMNS = ("Date", "Time", "Level", "Component", "Content")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header; lines that don't fit the schema are left out."""
    return spark.read.schema(schema).csv(path, header=True, mode="DROPMALFORMED")


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def parse_log(lines: DataFrame, *, value: str = "value", file: str | None = None) -> DataFrame:
    """Columns of log lines; lines of another form are left out. ``file`` names a column of source files to keep."""
    parts = [F.regexp_extract(value, LOG_LINE, i + 1).alias(c) for i, c in enumerate(LOG_COLUMNS)]
    source = [F.regexp_extract(F.col(file), r"([^/]*)$", 1).alias("SourceFile")] if file else []
    return lines.where(F.col(value).rlike(LOG_LINE)).select(*parts, *source)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log files as a table of Date, Time, Level, Component, Content and SourceFile."""
    return parse_log(spark.read.text(path).withColumn("__file", F.col("_metadata.file_path")), file="__file")


def with_event_times(hits: DataFrame, *, day: str, times: dict[str, str]) -> DataFrame:
    """A date column from days since 1970 and timestamps from seconds since then (``times``: column to source)."""
    out = hits.withColumn(day, F.date_add(F.make_date(F.lit(1970), F.lit(1), F.lit(1)), F.col(day).cast("int")))
    for name, source in times.items():
        out = out.withColumn(name, F.timestamp_millis(F.col(source).cast("long") * 1000))
    return out
