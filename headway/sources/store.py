"""Stored tables and files: legacy databases, snapshots, timetables, checked readers and writers."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from headway.errors import SchemaMismatchError


class SqliteSource(DataSource):
    """``spark.read.format("headway_sqlite")`` with options path, table, and partitions (ranges of row ids, default 8).

    The file must be at the same path on every executor; it is opened read-only.  With a schema given, a file
    that is not there is an empty table.
    """

    @classmethod
    def name(cls) -> str:
        return "headway_sqlite"

    def schema(self) -> str:
        import sqlite3

        kinds = {"INTEGER": "long", "REAL": "double", "BLOB": "binary"}
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            columns = db.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
        if not columns:
            raise SchemaMismatchError(f"{self.options['path']} has no table {self.options['table']}")
        return ", ".join(f"`{c[1]}` {kinds.get(c[2].upper(), 'string')}" for c in columns)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(self.options, schema)


class _SqliteReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.table, self.n, self.columns = options["path"], options["table"], int(options.get("partitions", 8)), schema.fieldNames()

    def partitions(self):
        """Ranges of row ids, the first and the last without a bound; one whole range for a table without row ids."""
        import os
        import sqlite3

        if not os.path.exists(self.path):
            return []
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            try:
                low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
            except sqlite3.OperationalError:
                return [InputPartition(None)]
        if low is None:
            return []
        n = max(1, min(self.n, high - low + 1))
        cuts = [low + (high - low + 1) * i // n for i in range(1, n)]
        return [InputPartition(x) for x in zip([None, *cuts], [*cuts, None], strict=True)]

    def read(self, partition) -> Iterator[tuple]:
        import sqlite3

        if partition is None:  # there is nothing to read
            return
        names = ", ".join(f'"{c}"' for c in self.columns)
        bounds = [(f"rowid {op} ?", x) for op, x in zip((">=", "<"), partition.value or (), strict=False) if x is not None]
        where = f" WHERE {' AND '.join(b for b, _ in bounds)}" if bounds else ""
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            yield from db.execute(f'SELECT {names} FROM "{self.table}"{where}', [x for _, x in bounds])


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str | None = None) -> DataFrame:
    """A table of a database file; with a schema, an empty one if there is no file."""
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("headway_sqlite").option("path", path).option("table", table)
    return (reader.schema(schema) if schema else reader).load()


def read_snapshots(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All CSV snapshots below ``folder`` but poll logs, as one table; -1 in stop_sequence is NULL."""
    df = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "[!_]*.csv").csv(folder)
    return df.withColumn("stop_sequence", F.nullif("stop_sequence", F.lit(-1))) if "stop_sequence" in df.columns else df


def _members(zipped: DataFrame, member: str, row_schema: str) -> DataFrame:
    """Rows of a CSV member of zip files (of ``binaryFile``), with bundle and file_row."""

    def run(batches):
        import csv

        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    inside = [n for n in z.namelist() if n.rpartition("/")[2] == member]
                    if not inside:
                        continue
                    with z.open(inside[0]) as f:
                        block = []
                        for i, row in enumerate(csv.DictReader(io.TextIOWrapper(f, "utf-8-sig", newline=""))):
                            block.append((path.rpartition("/")[2], i, {k: v for k, v in row.items() if k and v is not None}))
                            if len(block) == 20_000:
                                yield pd.DataFrame(block, columns=["bundle", "file_row", "fields"])
                                block = []
                        yield pd.DataFrame(block, columns=["bundle", "file_row", "fields"])

    fields = [f.strip().split(" ")[0] for f in row_schema.split(",")]
    rows = zipped.select("path", "content").mapInPandas(run, "bundle string, file_row long, fields map<string,string>")
    return rows.select("bundle", "file_row", *[F.try_element_at("fields", F.lit(c)).alias(c) for c in fields])


def timetable(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """stop_times, stops and routes of timetable zips: write them as Parquet once and read that."""
    zipped = spark.read.format("binaryFile").load(path)
    return {
        "stop_times": _members(zipped, "stop_times.txt", "trip_id string, arrival_time string, departure_time string, stop_id string, stop_sequence string"),
        "stops": _members(zipped, "stops.txt", "stop_id string, stop_name string, parent_station string, location_type string"),
        "routes": _members(zipped, "routes.txt", "route_id string, route_short_name string"),
    }


def distinct_bundles(spark: SparkSession, path: str) -> DataFrame:
    """One file of each content, the first by name."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
    return files.groupBy("length", "sha256").agg(F.min("path").alias("path"))


def new_bundles(found: DataFrame, kept: DataFrame) -> DataFrame:
    return found.join(kept.select("sha256").distinct(), "sha256", "left_anti")


def read_checked(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV in which a malformed row is an error."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def write_partitioned(df: DataFrame, path: str, by: list[str], mode: str = "append", kind: str = "parquet") -> None:
    """Files by partition folder; the rows of a folder come from as many tasks as adaptive execution gives them."""
    out = df.hint("rebalance", *[F.col(c) for c in by]) if by else df
    writer = out.write.mode(mode).partitionBy(*by)
    if kind == "csv":
        writer = writer.option("header", True)
    writer.format(kind).save(path)


def stop_events(observations: DataFrame, lines: list[str]) -> DataFrame:
    """Observations of some lines, with the arrival's delay or else the departure's; rows with neither stay."""
    return observations.filter(F.col("route_short_name").isin(lines)).withColumn("delay_s", F.coalesce("arrival_delay_s", "departure_delay_s"))


def ok_polls(log: DataFrame) -> DataFrame:
    """Times of the polls that went well, each once, in order."""
    return log.filter("status = 'ok'").select("poll_time_utc").distinct().orderBy("poll_time_utc")


def tracked_statuses(statuses: DataFrame, lines: list[str]) -> DataFrame:
    """Trips of some lines that are cancelled or skip stops."""
    return statuses.filter(F.col("route_short_name").isin(lines) & ((F.col("trip_relationship") == "CANCELED") | (F.size("skipped_stop_ids") > 0)))


def write_route_lookup(routes: DataFrame, path: str) -> None:
    """route_id and its short name, one row a route, as CSV."""
    names = routes.filter("route_id IS NOT NULL").groupBy("route_id").agg(F.max("route_short_name").alias("route_short_name"))
    names.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_route_lookup(spark: SparkSession, path: str) -> DataFrame:
    return read_checked(spark, path, "route_id string, route_short_name string")


def copy_table(spark: SparkSession, source: str, target: str) -> int:
    """A copy of a Parquet table as it is when the copy begins (a scan lists its files once); the number of rows."""
    spark.read.parquet(source).write.mode("errorifexists").parquet(target)
    return spark.read.parquet(target).count()


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows as JSON lines (answers, judged statements, transcripts); what is there already is not written over."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_blind_sheet(sample: DataFrame, path: str, keep=("statement_id", "system", "statement", "evidence"), blank: str = "human_supported") -> None:
    """A labelling sheet: what a rater needs, in order, and a column to fill in; no verdict is in it."""
    rows = sample.select(*keep, F.lit("").alias(blank)).orderBy(keep[0])
    rows.write.mode("errorifexists").option("header", True).option("emptyValue", "").option("quoteAll", True).option("escape", '"').csv(path)


def read_sheet(spark: SparkSession, path: str, blank: str = "human_supported") -> DataFrame:
    """statement_id and the rater's yes or no; anything else is an error."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if "statement_id" not in rows.columns or blank not in rows.columns:
        raise SchemaMismatchError(f"{path} needs columns statement_id and {blank}")
    said = F.lower(F.trim(F.coalesce(F.col(blank), F.lit(""))))
    wrong = F.raise_error(F.concat(F.lit(f"{blank} must be yes or no: "), "statement_id"))
    return rows.select("statement_id", F.when(said == "yes", True).when(said == "no", False).otherwise(wrong.cast("boolean")).alias(blank))
