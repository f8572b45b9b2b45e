"""Media-type jobs: detect, count, and compare detection with/without names.

Inline files are classified in the scan projection itself (content and
path are columns of the same row, no join).  External files are first
reduced to ``(id, content_type)`` where their bytes are read, and only that
small row is joined with the evidence paths, so bytes never cross a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from casefile.functions.columns import base_name
from casefile.functions.mediatype import with_content_type, with_media_type
from casefile.operators.duplicates import materialize
from casefile.sources.evidence import external_original_paths, inline_content_with_path


def inline_media_types(evidence: DataFrame) -> DataFrame:
    """``(id, media_type)`` of non-empty inline content, refined by the path."""
    return media_types_of(with_content_type(inline_content_with_path(evidence), "file_content"))


def media_types_of(rows: DataFrame) -> DataFrame:
    """``(id, media_type)`` for rows ``(id, file_path, content_type)``.

    Non-empty content always gets a verdict, so no NULL filter is needed.
    """
    return _once(with_media_type(rows, "content_type", "file_path"))


def _once(typed: DataFrame) -> DataFrame:
    """``(id, media_type)`` through a one-row generator: filters on generated columns are
    not pushed below it, so the rules are evaluated once per row and not again in each filter."""
    return typed.select("id", F.inline(F.array(F.struct("media_type"))))


def external_content_types(summaries: DataFrame) -> DataFrame:
    """``(id, content_type)`` per external file name from a ``(path, content_type)`` frame
    (``summarize_files`` or ``read_types`` output).

    A name listed twice keeps the verdict of the largest path, matching the
    choice made for hashes; the aggregation leaves the frame partitioned by id.
    """
    return (summaries.groupBy(base_name("path").alias("id"))
            .agg(F.max_by("content_type", F.col("path")).alias("content_type")))


def _external_pairs(evidence: DataFrame, summaries: DataFrame) -> DataFrame:
    """Evidence paths of external files joined with their content verdict."""
    return external_original_paths(evidence).join(external_content_types(summaries), "id", "inner")


def external_media_types(evidence: DataFrame, summaries: DataFrame) -> DataFrame:
    """``(id, media_type)`` of external files that have an evidence row."""
    return (_once(with_media_type(_external_pairs(evidence, summaries), "content_type", "file_path"))
            .where(F.col("media_type").isNotNull()))


def file_media_types(evidence: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """``(id, media_type)`` of every classified file; external verdict wins."""
    return combine_media_types(inline_media_types(evidence), evidence, summaries)


def combine_media_types(inline: DataFrame, evidence: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """Merge inline ``(id, media_type)`` with the external verdicts (external wins).

    The external verdicts are used twice, so they are written once, when this is called.
    """
    if summaries is None:
        return inline
    outside = materialize(external_media_types(evidence, summaries), "external-types")
    return inline.join(outside.select("id"), "id", "left_anti").unionByName(outside)


def media_type_counts(typed: DataFrame) -> DataFrame:
    """``(media_type, n)``, most frequent first (name breaks ties)."""
    return (typed.where(F.col("media_type").isNotNull())
            .groupBy("media_type").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc("media_type")))


def _mismatch(typed: DataFrame, name_path) -> DataFrame:
    out = with_media_type(typed, "content_type", name_path, out="type_with_name")
    # both verdicts go through a one-row generator, for the reason given in _once
    pair = F.struct(F.col("content_type").alias("type_by_content"), F.col("type_with_name"))
    return (out.select("id", "file_path", F.inline(F.array(pair)))
            .where(~F.col("type_by_content").eqNullSafe(F.col("type_with_name"))))


def inline_media_type_mismatch(evidence: DataFrame) -> DataFrame:
    """Inline files whose verdict changes when the file name is considered."""
    return _mismatch(with_content_type(inline_content_with_path(evidence), "file_content"), "file_path")


def external_media_type_mismatch(evidence: DataFrame, summaries: DataFrame) -> DataFrame:
    """External files whose verdict changes when their base name is considered."""
    return _mismatch(_external_pairs(evidence, summaries), base_name("file_path"))
