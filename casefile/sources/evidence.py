"""The evidence table and its scans.

One row per seized file.  Small files carry their bytes inline in
``file_content``; large files live in an external directory and the row only
names them in ``external_path`` (the file name there is the row id).  All
columns but ``id`` are nullable: a missing cell is NULL.

Each scan is a projection plus a predicate over the table, so Catalyst pushes
the predicate into the Parquet reader and prunes every column not selected
(the binary column is only read by scans that return it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from casefile.functions.columns import content_size, nonempty, parse_file_size

DATA_FILE = "DATA_FILE"

METADATA_COLUMNS = [
    "id", "file_path", "file_type", "file_size", "owner", "group", "permissions",
    "last_modified", "last_changed", "last_accessed", "created",
]

EVIDENCE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("file_path", T.StringType()),
    T.StructField("file_type", T.StringType()),
    T.StructField("file_size", T.StringType()),
    T.StructField("owner", T.StringType()),
    T.StructField("group", T.StringType()),
    T.StructField("permissions", T.StringType()),
    T.StructField("last_modified", T.StringType()),
    T.StructField("last_changed", T.StringType()),
    T.StructField("last_accessed", T.StringType()),
    T.StructField("created", T.StringType()),
    T.StructField("file_hash", T.StringType()),
    T.StructField("media_type", T.StringType()),
    T.StructField("file_content", T.BinaryType()),
    T.StructField("external_path", T.StringType()),
])


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Read an evidence table stored as Parquet with the canonical schema."""
    return spark.read.schema(EVIDENCE_SCHEMA).parquet(path)


def conform(df: DataFrame) -> DataFrame:
    """Add missing evidence columns as NULL and order them canonically."""
    cols = []
    for field in EVIDENCE_SCHEMA.fields:
        if field.name in df.columns:
            cols.append(F.col(field.name).cast(field.dataType).alias(field.name))
        else:
            cols.append(F.lit(None).cast(field.dataType).alias(field.name))
    return df.select(*cols)


# --- scans ---------------------------------------------------------------

def file_metadata(evidence: DataFrame) -> DataFrame:
    """All rows with the eleven metadata fields; size parsed to bigint."""
    return evidence.select(
        "id", "file_path", "file_type",
        parse_file_size("file_size").alias("file_size"),
        "owner", "group", "permissions",
        "last_modified", "last_changed", "last_accessed", "created",
    )


def data_file_content(evidence: DataFrame) -> DataFrame:
    """Data files only (directories, links, rows without a type dropped).

    Returns id, path, external path and the inline content.
    """
    return (evidence.where(F.col("file_type") == DATA_FILE)
            .select("id", "file_path", "external_path", "file_content"))


def inline_content(evidence: DataFrame) -> DataFrame:
    """``(id, file_content)`` of rows with non-empty inline content."""
    return evidence.where(nonempty("file_content")).select("id", "file_content")


def inline_content_with_path(evidence: DataFrame) -> DataFrame:
    """``(id, file_path, file_content)`` of rows with non-empty inline content."""
    return evidence.where(nonempty("file_content")).select("id", "file_path", "file_content")


def external_paths(evidence: DataFrame) -> DataFrame:
    """``(id, external_path)`` of rows whose content lives outside the table."""
    return evidence.where(nonempty("external_path")).select("id", "external_path")


def external_original_paths(evidence: DataFrame) -> DataFrame:
    """``(id, file_path)`` of externally stored files; the tested column is dropped."""
    return evidence.where(nonempty("external_path")).select("id", "file_path")


def external_data_files(evidence: DataFrame) -> DataFrame:
    """Data files whose content is stored externally."""
    return data_file_content(evidence).where(nonempty("external_path"))


def hash_and_path(evidence: DataFrame) -> DataFrame:
    """``(id, file_path, file_hash)`` of rows that already carry a hash."""
    return evidence.where(nonempty("file_hash")).select("id", "file_path", "file_hash")


def media_types(evidence: DataFrame) -> DataFrame:
    """``(id, media_type)`` of rows that already carry a media type."""
    return evidence.where(nonempty("media_type")).select("id", "media_type")


# --- small derived views used by the test job -----------------------------

def content_sizes(evidence: DataFrame) -> DataFrame:
    """``(id, content_size)`` in bytes for every non-empty inline content."""
    return inline_content(evidence).select("id", content_size("file_content").alias("content_size"))


def evidence_counts(evidence: DataFrame) -> DataFrame:
    """One row: number of evidence rows and of rows with inline content."""
    return evidence.agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count(F.when(nonempty("file_content"), F.lit(1))).alias("n_inline"),
    )


# Fixed value: the per-file message of the original test job, kept verbatim.
CONTENT_MESSAGE = ("Entry = %s with relativePath = %s and hdfsPath = %s "
                   "and hbase content size =%d.")


def content_messages(evidence: DataFrame) -> DataFrame:
    """Formatted line per externally stored data file; absent values print ``null``.

    A missing inline content prints size -1.
    """
    rows = external_data_files(evidence)
    return rows.select(
        "id",
        F.format_string(
            CONTENT_MESSAGE,
            F.col("id"),
            F.coalesce("file_path", F.lit("null")),
            F.coalesce("external_path", F.lit("null")),
            content_size("file_content", missing=-1),
        ).alias("message"),
    )


def metadata_preview(evidence: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` metadata rows by id (the preview is the feature)."""
    return (file_metadata(evidence).select("id", "file_path", "file_size")
            .orderBy("id").limit(n))
