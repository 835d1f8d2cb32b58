"""Delimited-text sources and sinks.

All columns are read as strings (no schema inference pass over the data), then
typed in one projection with ``try_cast`` / ``try_to_date``: a bad value becomes
NULL instead of failing the job under ANSI mode.
"""
from __future__ import annotations

import csv
import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from shipshape.functions.columns import to_date_fmt, to_double


def string_schema(names: list[str]) -> StructType:
    return StructType([StructField(n, StringType(), True) for n in names])


def _headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The files at a path by their header lines. The first line of a file comes from the task that
    reads its first block; the driver gets one line per file."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    first = lines.where("file_block_start = 0").groupBy("file_path").agg(F.first("value").alias("header")).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(first):
        out.setdefault(r.header, []).append(r.file_path)
    return out


def read_table(spark: SparkSession, path: str, names: list[str], sep: str = ",") -> DataFrame:
    """Header CSV (file, folder or glob): the columns ``names``, found by name in each file's own
    header, so files may order them differently and hold others too; a missing one is an error
    that names the file. As in the reference, lines equal to the header in the file's first
    column, or without a value there, are dropped (repeated headers of concatenated files)."""
    tables = []
    for line, paths in _headers(spark, path).items():
        header = next(csv.reader([line.lstrip("\ufeff")], delimiter=sep))
        missing = [n for n in names if n not in header]
        if missing:
            raise ValueError(f"no column {', '.join(missing)} in {paths[0]}")
        df = (spark.read.schema(string_schema(header)).option("header", True).option("sep", sep)
              .option("mode", "PERMISSIVE").csv(paths))
        first = F.col(f"`{header[0]}`")
        tables.append(df.filter(first.isNotNull() & (first != F.lit(header[0]))).select(*[F.col(f"`{n}`") for n in names]))
    if not tables:
        return spark.createDataFrame([], string_schema(names))
    return functools.reduce(DataFrame.unionByName, tables)


def read_parts(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A folder of (gzip) part files as one table; the codec follows the file suffix."""
    return read_table(spark, path, names)


def typed(df: DataFrame, types: dict[str, str | tuple[str, str]]) -> DataFrame:
    """Cast columns in one select: 'double' / 'int' / 'long' via try_cast, ('date', fmt) via
    try_to_date. Columns not named stay as they are."""
    cols = []
    for c in df.columns:
        t = types.get(c)
        if t is None:
            cols.append(F.col(c))
        elif isinstance(t, tuple) and t[0] == "date":
            cols.append(to_date_fmt(c, t[1]).alias(c))
        elif t == "double":
            cols.append(to_double(c).alias(c))
        else:
            cols.append(F.col(c).try_cast(t).alias(c))
    return df.select(*cols)


def as_text(df: DataFrame, date_formats: dict[str, str] | None = None, missing: dict[str, str] | None = None) -> DataFrame:
    """All columns to text, dates in the given patterns; optional text for NULLs."""
    date_formats, missing = date_formats or {}, missing or {}
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        v = F.date_format(c, date_formats[f.name]) if f.name in date_formats else c.cast("string")
        if f.name in missing:
            v = F.coalesce(v, F.lit(missing[f.name]))
        cols.append(v.alias(f.name))
    return df.select(*cols)


def write_csv_gz(df: DataFrame, path: str, mode: str = "overwrite", max_rows: int = 0) -> str:
    """Header + gzip CSV parts, one per task or, with ``max_rows``, as many as hold no more rows each; no coalesce
    to one file."""
    df.write.option("maxRecordsPerFile", max_rows).csv(path, header=True, mode=mode, compression="gzip")
    return path


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.csv(path, header=True, mode=mode)
    return path
