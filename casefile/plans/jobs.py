"""End-to-end jobs: read evidence, compute, write annotations and reports.

These are the user-facing entry points; each is a short composition of the
operators and ends in a write (never a collect).  Paths may be local or on
shared storage (HDFS, object stores); annotation tables are written as
Parquet next to the immutable evidence table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casefile.functions.digest import DEFAULT_BITS
from casefile.operators import annotate, duplicates, hashing, mediatypes, reports
from casefile.sources import evidence as ev
from casefile.sources.inventory import file_inventory


def load_evidence(spark: SparkSession, evidence_path: str, *annotation_paths: str) -> DataFrame:
    """Evidence table with previously written annotation tables merged in."""
    table = ev.read_evidence(spark, evidence_path)
    anns = {}
    for path in annotation_paths:
        df = spark.read.parquet(path)
        column = [c for c in df.columns if c != "id"][0]
        anns[column] = df
    return annotate.merge_annotations(table, **anns)


def hash_job(spark: SparkSession, evidence_path: str, external_dir: str | None, out_path: str,
             bits: int = DEFAULT_BITS, mode: str = "errorifexists", listing: str = "index") -> None:
    """Hash inline and external content; write ``(id, file_hash)``.

    ``listing="inventory"`` lists the external folder on executors (for folders
    too big to list on the driver); so in the other jobs.
    """
    table = ev.read_evidence(spark, evidence_path)
    summaries = hashing.summarize_directory(spark, external_dir, bits, listing=listing) if external_dir else None
    annotate.write_annotation(hashing.file_hashes(table, summaries, bits), out_path, "file_hash", mode)


def media_type_job(spark: SparkSession, evidence_path: str, external_dir: str | None, out_path: str,
                   mode: str = "errorifexists", listing: str = "index") -> None:
    """Detect media types of inline and external content; write ``(id, media_type)``.

    External files are read only as far as their verdict needs (``read_types``).
    """
    table = ev.read_evidence(spark, evidence_path)
    types = hashing.read_types(spark, external_dir, listing=listing) if external_dir else None
    annotate.write_annotation(mediatypes.file_media_types(table, types), out_path, "media_type", mode)


def annotate_job(spark: SparkSession, evidence_path: str, external_dir: str | None, out_dir: str,
                 bits: int = DEFAULT_BITS, mode: str = "errorifexists", listing: str = "index") -> None:
    """Hash and classify with one read of every file's bytes.

    Inline content and external files are each reduced once to summaries
    ``(.., file_hash, content_type)``, written under ``out_dir/inline_summary`` and
    ``out_dir/external_summary``.  Both annotation tables (``out_dir/file_hash``,
    ``out_dir/media_type``) are derived from those narrow tables.
    """
    table = ev.read_evidence(spark, evidence_path)
    inline_path = f"{out_dir}/inline_summary"
    hashing.inline_summaries(table, bits).write.mode(mode).parquet(inline_path)
    inline = spark.read.parquet(inline_path)
    summaries = None
    if external_dir:
        summary_path = f"{out_dir}/external_summary"
        hashing.summarize_directory(spark, external_dir, bits, listing=listing).write.mode(mode).parquet(summary_path)
        summaries = spark.read.parquet(summary_path)
    annotate.write_annotation(hashing.combine_hashes(inline, summaries), f"{out_dir}/file_hash", "file_hash", mode)
    types = mediatypes.combine_media_types(mediatypes.media_types_of(inline), table, summaries)
    annotate.write_annotation(types, f"{out_dir}/media_type", "media_type", mode)


def duplicate_report_job(spark: SparkSession, evidence_path: str, hash_path: str, out_dir: str,
                         bits: int = DEFAULT_BITS, mode: str = "errorifexists",
                         members_out: str | None = None) -> None:
    """Group hashed evidence by digest and write the duplicate report.

    ``members_out`` also writes the long form ``(file_hash, id, file_path,
    label, n)`` as Parquet, from the same materialised member list.
    """
    table = load_evidence(spark, evidence_path, hash_path)
    members = duplicates.materialize(duplicates.label_members(ev.hash_and_path(table)))
    reports.write_duplicate_report(reports.duplicate_report(members, bits=bits, materialized=True), out_dir, mode=mode)
    if members_out:
        duplicates.duplicate_members(members, materialized=True).write.mode(mode).parquet(members_out)


def media_type_histogram(spark: SparkSession, evidence_path: str, media_type_path: str) -> DataFrame:
    """``(media_type, n)`` over the evidence with its media-type annotation."""
    values = annotate.merged_values(ev.read_evidence(spark, evidence_path), "media_type",
                                    spark.read.parquet(media_type_path))
    return mediatypes.media_type_counts(values)


def directory_members(spark: SparkSession, directory: str, bits: int = DEFAULT_BITS,
                      include_empty: bool = True, listing: str = "index") -> DataFrame:
    """``(file_hash, label)`` of every file of a raw directory, labelled by path.

    ``listing="inventory"`` lists on executors (for trees too big to list on the driver).
    """
    summaries = hashing.summarize_directory(spark, directory, bits, include_empty, listing=listing)
    return summaries.select("file_hash", summaries["path"].alias("label"))


def directory_duplicates(spark: SparkSession, directory: str, bits: int = DEFAULT_BITS,
                         include_empty: bool = True, listing: str = "index") -> DataFrame:
    """Files of a raw directory that share their digest, one row per file."""
    return duplicates.duplicate_files(directory_members(spark, directory, bits, include_empty, listing))


def directory_duplicate_report_job(spark: SparkSession, directory: str, out_dir: str,
                                   bits: int = DEFAULT_BITS, mode: str = "errorifexists",
                                   listing: str = "index") -> None:
    """Raw-directory mode: write the duplicate report of ``directory``."""
    members = directory_members(spark, directory, bits, listing=listing)
    reports.write_duplicate_report(reports.duplicate_report(members, bits=bits), out_dir, mode=mode)


def inventory_report_job(spark: SparkSession, directory: str, out_dir: str, mode: str = "errorifexists") -> None:
    """Raw-directory mode: write the file-attribute report of ``directory``."""
    reports.write_text_report(reports.inventory_report(file_inventory(spark, directory)), out_dir, mode)


def register_evidence_views(spark: SparkSession, evidence_path: str, *annotation_paths: str,
                            prefix: str = "") -> list[str]:
    """Temporary views for SQL users: ``<prefix>evidence`` (as stored) and
    ``<prefix>evidence_merged`` (the given annotation tables laid over it, without
    ``file_content``: no file's bytes take part in the merge join)."""
    ev.read_evidence(spark, evidence_path).createOrReplaceTempView(f"{prefix}evidence")
    load_evidence(spark, evidence_path, *annotation_paths).drop("file_content").createOrReplaceTempView(f"{prefix}evidence_merged")
    return [f"{prefix}evidence", f"{prefix}evidence_merged"]


def bucket_tables(spark: SparkSession, evidence_path: str, out_dir: str, buckets: int,
                  annotation_paths: tuple[str, ...] = (), prefix: str = "cf_",
                  mode: str = "errorifexists") -> dict[str, str]:
    """Write the evidence metadata (no content bytes) and the annotation tables
    bucketed by ``id`` into ``buckets`` buckets; returns column/role -> table name.

    Merging these tables (``merged_tables``) then needs no shuffle.
    """
    names = {"evidence": f"{prefix}evidence_meta"}
    meta = ev.read_evidence(spark, evidence_path).drop("file_content")
    annotate.write_bucketed(meta, names["evidence"], f"{out_dir}/evidence_meta", buckets, mode)
    for path in annotation_paths:
        df = spark.read.parquet(path)
        column = [c for c in df.columns if c != "id"][0]
        names[column] = f"{prefix}{column}"
        annotate.write_bucketed(annotate.annotation(df, column), names[column], f"{out_dir}/{column}", buckets, mode)
    return names


def merged_tables(spark: SparkSession, names: dict[str, str]) -> DataFrame:
    """Merged view over tables written by ``bucket_tables`` (content column absent)."""
    from casefile.sources.evidence import conform

    meta = conform(spark.table(names["evidence"]))
    anns = {col: spark.table(name) for col, name in names.items() if col != "evidence"}
    return annotate.merge_annotations_copartitioned(meta, **anns)
