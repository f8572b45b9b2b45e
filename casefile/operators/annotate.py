"""Results written next to the evidence table, and the merged view.

The evidence table (with its large binary column) stays immutable.  Each
job writes a narrow annotation table ``(id, value)``; the merged view is a
full outer join on ``id``, so an annotation for an id without an evidence
row becomes a new row carrying only that value (a cell-level upsert).

When both annotations come from aggregations keyed by ``id`` they are
already hash-partitioned alike and join without a shuffle; the evidence side
is shuffled once, pruned to the columns the caller selects.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from casefile.functions.columns import nonempty
from casefile.sources.evidence import EVIDENCE_SCHEMA

ANNOTATION_COLUMNS = ("file_hash", "media_type")


def annotation(df: DataFrame, column: str) -> DataFrame:
    """Normalise to ``(id, <column>)`` with NULL values dropped (nothing to write)."""
    if column not in ANNOTATION_COLUMNS:
        raise ValueError(f"unknown annotation column {column!r}")
    return df.select("id", F.col(column).cast("string").alias(column)).where(F.col(column).isNotNull())


def write_annotation(df: DataFrame, path: str, column: str, mode: str = "errorifexists") -> None:
    """Write an annotation table as Parquet (never onto a path being read)."""
    annotation(df, column).write.mode(mode).parquet(path)


def merge_annotations(evidence: DataFrame, **annotations: DataFrame) -> DataFrame:
    """Evidence with annotation values laid over it (``file_hash=``, ``media_type=``).

    A new value replaces the stored one; ids present only in an annotation
    produce rows holding just ``id`` and that value.
    """
    if not annotations:
        return evidence
    anns = [annotation(df, col).withColumnRenamed(col, f"_new_{col}") for col, df in annotations.items()]
    combined = reduce(lambda a, b: a.join(b, "id", "full_outer"), anns)
    merged = evidence.join(combined, "id", "full_outer")
    cols = []
    for field in EVIDENCE_SCHEMA.fields:
        if field.name in annotations:
            cols.append(F.coalesce(F.col(f"_new_{field.name}"), F.col(field.name)).alias(field.name))
        else:
            cols.append(F.col(field.name))
    return merged.select(*cols)


def merged_values(evidence: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """``(id, <column>)`` rows of the merged view that hold a non-empty value.

    Equal to scanning ``merge_annotations(evidence, <column>=values)`` for
    non-empty values, without joining the whole evidence table: new values
    (non-empty ones) plus stored values whose id received no new value.  The
    stored branch is pre-filtered at the scan, so when the evidence carries
    no stored values it is empty and the job reads only the annotation.
    """
    new = annotation(values, column)
    stored = evidence.where(nonempty(column)).select("id", column)
    return (new.where(nonempty(column))
            .unionByName(stored.join(new.select("id"), "id", "left_anti")))


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int, mode: str = "errorifexists") -> None:
    """Write ``df`` as a table bucketed and sorted by ``id`` at ``path``.

    Tables bucketed alike (same ``buckets``) join on ``id`` without a
    shuffle and without a sort, so repeated merges of the evidence metadata
    with its annotation tables stay map-side.
    """
    (df.write.mode(mode).bucketBy(buckets, "id").sortBy("id")
     .option("path", path).saveAsTable(table))


def merge_annotations_copartitioned(evidence: DataFrame, **annotations: DataFrame) -> DataFrame:
    """Same result as ``merge_annotations``, built only from joins that keep
    the ``id`` partitioning of their inputs.

    Evidence rows take their new values through left joins; ids known only
    to annotations (B7) come from anti joins and are combined among
    themselves.  When every input is bucketed alike by ``id``
    (``write_bucketed``), no step shuffles.
    """
    if not annotations:
        return evidence
    anns = {col: annotation(df, col).withColumnRenamed(col, f"_new_{col}") for col, df in annotations.items()}
    with_values = evidence
    for df in anns.values():
        with_values = with_values.join(df, "id", "left")
    ids = evidence.select("id")
    orphans = reduce(lambda a, b: a.join(b, "id", "full_outer"),
                     [df.join(ids, "id", "left_anti") for df in anns.values()])

    def shaped(df: DataFrame, from_evidence: bool) -> DataFrame:
        cols = []
        for field in EVIDENCE_SCHEMA.fields:
            new = f"_new_{field.name}"
            if field.name in anns:
                old = F.col(field.name) if from_evidence else F.lit(None).cast(field.dataType)
                cols.append(F.coalesce(F.col(new), old).alias(field.name))
            elif from_evidence or field.name == "id":
                cols.append(F.col(field.name))
            else:
                cols.append(F.lit(None).cast(field.dataType).alias(field.name))
        return df.select(*cols)

    return shaped(with_values, True).unionByName(shaped(orphans, False))
