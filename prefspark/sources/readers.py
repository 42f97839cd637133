"""Readers: triples with their order, pair records in three formats, metric reports."""

from collections.abc import Mapping, Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefspark.operators.filters import union_parts
from prefspark.operators.ranking import sum_before
from prefspark.schema import (
    CONVERSATION,
    PAIR,
    PAIR_COLUMNS,
    REPORT,
    free_names,
    require_columns,
)
from prefspark.sources.publishing import read_published

# The suffixes that name a format.
FORMAT_OF_SUFFIX = {".json": "json", ".jsonl": "json", ".csv": "csv", ".parquet": "parquet"}

# ``ord`` of a row is its file's number times 2**40 plus its place in the file.
FILE_BITS = 40


def _as_text(columns: Sequence[str]) -> list:
    # Ids may be stored as numbers. Casting text to text vanishes from the plan.
    return [F.col(name).cast("string").alias(name) for name in columns]


def read_triples(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Only the named columns of a Parquet table, as text."""
    return spark.read.parquet(path).select(_as_text(columns))


def _one_slash(uri: str) -> str:
    """File listings and row metadata write a URI without authority in two ways."""
    return uri.replace(":///", ":/")


def read_ordered(
    spark: SparkSession, paths: Sequence[str], columns: Sequence[str], first_file: int = 0
) -> DataFrame:
    """The named columns of several Parquet tables as text, with ``source`` and a unique ``ord``.

    ``ord`` grows with the place of the path in the list, then with the file name inside a
    path, then with the row in the file, however the files are split into tasks. Files are
    numbered from ``first_file``, for tables that continue others.
    """
    part, name, row, number = free_names([*columns, "source", "ord"], "_part", "_file", "_row", "_number")
    parts, numbers = [], []
    for source, path in enumerate(paths):
        table = spark.read.parquet(path)
        for file in sorted(_one_slash(file) for file in table.inputFiles()):
            numbers.append((source, file, first_file + len(numbers)))
        parts.append(
            table.select(
                *_as_text(columns),
                F.lit(source).alias(part),
                F.replace(F.col("_metadata.file_path"), F.lit(":///"), F.lit(":/")).alias(name),
                F.col("_metadata.row_index").alias(row),
            )
        )
    # Sent to all tasks, one row per file. Left to itself Spark may send the rows instead, or
    # bring those of a file into one task.
    files = F.broadcast(spark.createDataFrame(numbers, f"{part} int, {name} string, {number} long"))
    ordinal = F.shiftleft(number, FILE_BITS) + F.col(row)
    return (
        union_parts(parts)
        .join(files, [part, name])
        .select(*columns, F.col(part).alias("source"), ordinal.alias("ord"))
    )


def read_positions(
    spark: SparkSession, path: str, fmt: str = "parquet", position: str = "position"
) -> DataFrame:
    """A Parquet table with the 0-based place of each row: files by name, rows as they lie.

    Rows are counted by file, and the counts before a file are added to the row's number in it:
    no sort and no checkpoint, whatever the size of the table, and the same numbers however the
    files are cut into tasks. What is summed in order has one row for each file.
    """
    if fmt != "parquet":
        raise ValueError(f"rows have numbers in Parquet files only, not in {fmt}")
    table = spark.read.parquet(path)
    name, number, rows, before = free_names([*table.columns, position], "_file", "_row", "_rows", "_before")
    placed = table.select(
        "*",
        F.replace(F.col("_metadata.file_path"), F.lit(":///"), F.lit(":/")).alias(name),
        F.col("_metadata.row_index").alias(number),
    )
    counts = placed.groupBy(name).agg(F.count(F.lit(1)).alias(rows))
    starts = counts.select(name, sum_before(W.orderBy(name), rows).alias(before))
    # Sent to all tasks, one row per file, as in ``read_ordered``.
    return placed.join(F.broadcast(starts), name).select(
        (F.col(before) + F.col(number)).alias(position), *table.columns
    )


def _read_json(spark, path, schema, multi_line):
    """JSON lines, or with ``multi_line`` files that hold one document or list each."""
    reader = spark.read.option("mode", "FAILFAST").option("multiLine", bool(multi_line))
    return (reader.schema(schema) if schema else reader).json(path)


def _read_parquet(spark, path, schema, multi_line):
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def _read_csv(spark, path, schema, multi_line):
    """Columns by the names in the header, nested ones from JSON text.

    All files need the same header; one that differs fails the job instead of giving its
    values to other columns. An empty field is null, a quoted empty one an empty text. Values
    may hold line breaks unless ``multi_line`` is false, which lets Spark split files.
    """
    table = (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .option("nullValue", _NO_TEXT)
        .option("multiLine", multi_line is not False)
        .option("escape", '"')
        .option("mode", "FAILFAST")
        .csv(path)
    )
    if schema is None:
        return table
    require_columns(table, schema.fieldNames(), path)
    nested = (T.ArrayType, T.StructType, T.MapType)
    return table.select(
        *[
            F.from_json(f.name, f.dataType, {"mode": "FAILFAST"}).alias(f.name)
            if isinstance(f.dataType, nested)
            else F.col(f.name).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


# Stands for an empty field while a file is read, so that a quoted empty text is not null.
_NO_TEXT = "\x00null\x00"

_READERS = {"json": _read_json, "csv": _read_csv, "parquet": _read_parquet}


def format_of(path: str, fmt: str | None = None) -> str:
    """The format asked for, else the one the suffix names."""
    found = fmt or FORMAT_OF_SUFFIX.get(PurePosixPath(path).suffix)
    if found not in _READERS:
        raise ValueError(f"cannot tell the format of {path}; name one of {sorted(_READERS)}")
    return found


def read_any(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    schema: T.StructType | None = PAIR,
    multi_line: bool | None = None,
) -> DataFrame:
    """A table in any of the formats. Without a schema the file tells its own."""
    return _READERS[format_of(path, fmt)](spark, path, schema, multi_line)


def load_split(spark: SparkSession, data: Mapping, split: str) -> DataFrame | None:
    """A split as configured: ``{split}_path`` first, else ``{split}_split`` of what is published
    below ``published_path`` (its newest ``version`` unless one is set), else the rows of table
    ``dataset_name`` whose ``split`` is ``{split}_split``; None when none is set."""
    path, name, wanted = (
        data.get(f"{split}_path"), data.get("dataset_name"), data.get(f"{split}_split")
    )
    if not path and wanted and data.get("published_path"):
        return read_published(
            spark, data["published_path"], wanted, pair_schema(data.get("columns")), data.get("version")
        )
    if path:
        fmt = format_of(path, data.get("format"))
        # A Parquet file knows its columns; a declared schema would hide that one is missing.
        schema = None if fmt == "parquet" else pair_schema(data.get("columns"))
        return read_any(spark, path, fmt, schema, data.get("multi_line"))
    if name and wanted:
        return spark.table(name).where(F.col("split") == wanted).drop("split")
    return None


def pair_schema(columns: Mapping[str, str] | None = None) -> T.StructType:
    """The pair schema under source column names (canonical -> source)."""
    if not columns:
        return PAIR
    return T.StructType([T.StructField(columns[c], CONVERSATION) for c in PAIR_COLUMNS])


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Metric reports, one JSON document per file below ``path``."""
    return spark.read.schema(REPORT).option("multiLine", True).option("mode", "FAILFAST").json(path)
