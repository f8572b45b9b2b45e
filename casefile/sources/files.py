"""Directories of opaque files as DataFrames (Spark's ``binaryFile`` source).

The reader lists files in Spark's file index (parallel listing for large
trees), and loads bytes only when the ``content`` column is selected:
a projection of ``path, length`` reads no file data.  Predicates on
``length`` / ``modificationTime`` are pushed into the listing.

Large files are not loaded as one value: ``split_by_length`` routes files
above a size threshold (64 MiB by default, never above the reader's own
``spark.sql.sources.binaryFile.maxLength``) to the chunked reader in
``casefile.operators.hashing``.  Zero-length files and names starting with
``.`` or ``_`` are skipped by the reader; ``casefile.sources.inventory``
lists zero-length files when they must be included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from casefile.functions.columns import base_name

MAX_BINARY_LENGTH = 2**31 - 1  # the binaryFile reader's own hard limit


def binary_files(spark: SparkSession, path: str, recursive: bool = True,
                 path_glob: str | None = None) -> DataFrame:
    """``(path, modificationTime, length, content)`` for every file under ``path``.

    Recursive lookup also switches off ``key=value`` partition discovery, which
    would otherwise reject mixed directory layouts.
    """
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if path_glob:
        reader = reader.option("pathGlobFilter", path_glob)
    return reader.load(path)


def max_binary_length(spark: SparkSession) -> int:
    value = spark.conf.get("spark.sql.sources.binaryFile.maxLength", None)
    return int(value) if value else MAX_BINARY_LENGTH


def keyed_by_name(files: DataFrame) -> DataFrame:
    """Add ``id`` = file name (the external store names files by row id)."""
    return files.withColumn("id", base_name("path"))


def external_content(spark: SparkSession, directory: str) -> DataFrame:
    """External large-file store keyed by file name: ``(id, path, length)``.

    Content is not selected here; callers that need bytes go through
    ``casefile.operators.hashing.summarize_files``.
    """
    return keyed_by_name(binary_files(spark, directory)).select("id", "path", "length")


def directory_files(spark: SparkSession, directory: str) -> DataFrame:
    """Raw directory listing keyed by full path: ``(path, length, modification_time)``."""
    return binary_files(spark, directory).select(
        "path", "length", F.col("modificationTime").alias("modification_time"))


def split_by_length(files: DataFrame, max_length: int) -> tuple[DataFrame, DataFrame]:
    """Split a binary-file DataFrame into loadable and oversized files.

    The second frame has no ``content`` column, so its scan reads no bytes.
    """
    small = files.where(F.col("length") <= max_length)
    large = files.where(F.col("length") > max_length).select("path", "length")
    return small, large
