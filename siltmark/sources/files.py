"""Readers: delimited text, JSON, Parquet, and dispatch by format."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DELIMITED = ("csv", "tsv", "txt")
JSON = ("json", "jsonl", "ndjson")

# Separators in the order they are tried.
SEPARATORS = (",", ";", "\t")

_BOM = "\ufeff"


class UnsupportedFormat(ValueError):
    """The format is none of the readable ones."""


def first_line(spark: SparkSession, paths: str | Sequence[str]) -> str:
    rows = spark.read.text(paths).limit(1).collect()
    return rows[0][0].lstrip(_BOM) if rows else ""


def not_utf8(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``uri`` of the files that hold bytes which are not UTF-8, wherever they stand."""
    bad = spark.read.text(paths).filter(~F.is_valid_utf8("value"))
    return bad.select(F.col("_metadata.file_path").alias("uri")).distinct()


def encoding_of(spark: SparkSession, paths: str | Sequence[str]) -> str:
    """UTF-8 unless any line holds bytes that are not UTF-8; the scan ends at the first such line."""
    return "ISO-8859-1" if not not_utf8(spark, paths).isEmpty() else "UTF-8"


def separator_of(line: str) -> str:
    """First separator that parses the header to more than one column; comma for a single column."""
    return next((s for s in SEPARATORS if len(next(csv.reader([line], delimiter=s), [])) > 1), ",")


def read_delimited(
    spark: SparkSession, path: str | Sequence[str], schema: str | None = None, encoding: str | None = None
) -> DataFrame:
    """CSV, TSV or TXT with a header line, which decides the separator. The encoding is decided on all
    bytes unless given; pass ``schema`` to skip type inference on large inputs."""
    reader = spark.read.options(
        header=True, sep=separator_of(first_line(spark, path)), encoding=encoding or encoding_of(spark, path), multiLine=False
    )
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(path)


def whole_documents(spark: SparkSession, paths: str | Sequence[str]) -> bool:
    """Whether JSON files hold one document each: the first line opens a list, or an object it doesn't close."""
    text = F.trim("value")
    ends = spark.read.text(paths).select(F.substring(text, 1, 1), F.right(text, F.lit(1))).limit(1).collect()
    return bool(ends) and (ends[0][0] == "[" or (ends[0][0] == "{" and ends[0][1] != "}"))


def read_json_any(
    spark: SparkSession, path: str | Sequence[str], schema: str | None = None
) -> DataFrame:
    """JSON Lines, or whole JSON documents when the file opens with ``[``. A malformed line fails the
    read; it never becomes a record of NULLs."""
    reader = spark.read.options(multiLine=whole_documents(spark, path), mode="FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet table; the JSONL table of the same name when there is no Parquet one."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) or not path.endswith(".parquet"):
            raise
        return spark.read.json(path[: -len(".parquet")] + ".jsonl")


def format_of(path: str, fmt: str | None = None) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return (fmt or (name.rsplit(".", 1)[-1] if "." in name else "")).lower()


def read_any(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    columns: Sequence[str] | None = None,
    schema: str | None = None,
) -> DataFrame:
    """Read by explicit format or file extension."""
    kind = format_of(path, fmt)
    if kind in DELIMITED:
        df = read_delimited(spark, path, schema)
    elif kind in JSON:
        df = read_json_any(spark, path, schema)
    elif kind == "parquet":
        df = read_parquet(spark, path)
    else:
        raise UnsupportedFormat(f"unsupported format {kind!r} of {path}")
    return project_available(df, columns)


def project_available(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """The wanted columns that exist; all when none are named."""
    return df if not columns else df.select(*[c for c in columns if c in df.columns])
