"""SQL scripts: discovery, text, statements."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that a statement separator may stand in without separating.
_OPAQUE = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|;", re.S)


def split_statements(text: str) -> list[str]:
    """The statements of a script; separators in quotes and comments do not count, empty statements are left out."""
    out, at = [], 0
    for m in _OPAQUE.finditer(text):
        if m.group() == ";":
            out.append(text[at : m.start()])
            at = m.end()
    out.append(text[at:])
    bare = lambda s: re.sub(r"--[^\n]*|/\*.*?\*/", "", s, flags=re.S).strip()
    return [s for s in out if bare(s)]


def local_name(path: Column) -> Column:
    """A local file's plain path; other paths stay as they are."""
    return F.regexp_replace(path, "^file:/+", "/")


def read_scripts(spark: SparkSession, folder: str) -> DataFrame:
    """file, text of every .sql file below a folder, by path."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.sql").option("wholetext", "true").text(folder)
    return rows.select(local_name(F.col("_metadata.file_path")).alias("file"), F.col("value").alias("text")).orderBy("file")


def read_lineage(spark: SparkSession, path: str) -> DataFrame:
    """Lineage rows of a CSV file with a header: six trimmed texts, null as empty."""
    rows = spark.read.csv(path, header=True, escape='"', multiLine=True)
    names = ("source_table", "source_column", "expression", "target_column", "target_table", "file")
    return rows.select(*[F.coalesce(F.trim(F.col(c)), F.lit("")).alias(c) for c in names])
