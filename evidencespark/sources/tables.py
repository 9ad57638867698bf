"""Readers: the analytics tables, and raw objects (files) as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parsers by file suffix.
SUFFIXES = {
    "txt": "text", "md": "markdown", "py": "python", "go": "go", "js": "javascript", "ts": "typescript",
    "java": "java", "pdf": "pdf", "pptx": "pptx", "chm": "chm", "chi": "chi",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require_schema(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """``df`` if it has exactly the expected columns and types; a ValueError that names the differences if not."""
    found = dict(df.dtypes)
    if found != expected:
        wrong = sorted(set(found.items()) ^ set(expected.items()))
        raise ValueError(f"SEARCH_SCHEMA_MISMATCH: {wrong}")
    return df


def objects(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """``(path, modified_at, size, content)`` of all files below ``path``; unused columns are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    return files.select("path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("size"), "content")


def routed(files: DataFrame, name_col: str = "path") -> DataFrame:
    """Files with the ``parser`` of their suffix (any case), or an ``error`` for suffixes without one."""
    suffix = F.lower(F.regexp_extract(name_col, r"\.([^./\\]+)$", 1))
    parsers = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    parser = F.try_element_at(parsers, suffix)
    return files.withColumns({"parser": parser, "error": F.when(parser.isNull(), "UNSUPPORTED_SOURCE_TYPE")})


def plain_text(files: DataFrame) -> DataFrame:
    """Decoded files: UTF-8 without its byte-order mark, line ends as one line feed, bad bytes an error."""
    text = F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), "^﻿", "")
    text = F.regexp_replace(text, "\r\n?", "\n")
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1
    return files.withColumns({"text": text, "end_line": lines, "decode_error": F.when(text.isNull(), "INVALID_UTF8")}).drop("content")
