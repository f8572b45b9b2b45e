"""Exact duplicate files: group files by content digest.

Input is a "members" DataFrame with a key column (the digest) and a label
column (``<id>_<path>`` for evidence rows, the path for raw directories).
Every result is in long form, one row per file, so a group of any size is
never one row, one array or one task's work.

* Members are written once, as Parquet in the shared checkpoint folder: only
  the narrow ``(key, label, ...)`` rows, so counting reads the key column
  alone and upstream work such as hashing runs once.  The group sizes (one
  small row per duplicate digest) are written, too, and used by every step.
  These two writes run when an operator is called; the rest is lazy.
* Counting per key is a partial + final hash aggregate (map-side combine),
  so a key held by a third of all files costs one small row per map task.
* Group sizes are joined back without a hot partition.  Keys with more than
  ``HOT_GROUP_ROWS`` files, at most ``MAX_HOT_KEYS`` of them (counted before
  the broadcast; the threshold rises until it holds), are broadcast and
  joined map-side; the others take a shuffle join in which no key is larger.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from casefile.functions.columns import file_label
from casefile.session import checkpoint_dir

HOT_GROUP_ROWS = 1_000_000
MAX_HOT_KEYS = 10_000


def label_members(hashes: DataFrame, key: str = "file_hash") -> DataFrame:
    """Evidence ``(id, file_path, <key>)`` -> members ``(key, id, file_path, label)``."""
    return hashes.select(key, "id", "file_path", file_label("id", "file_path").alias("label"))


def hash_counts(members: DataFrame, key: str = "file_hash", label: str | None = None) -> DataFrame:
    """``(key, n)`` for every key, plus ``first_file`` (smallest label) if ``label`` is given.

    Counting alone is a hash aggregate with a fixed-width buffer; the string
    minimum needs a sort-based aggregate, so it is only computed on request.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    if label:
        aggs.append(F.min(label).alias("first_file"))
    return members.groupBy(key).agg(*aggs)


def duplicate_counts(members: DataFrame, key: str = "file_hash") -> DataFrame:
    """``(key, n)`` of keys held by more than one file."""
    return hash_counts(members, key).where(F.col("n") > 1)


def materialize(df: DataFrame, label: str = "members") -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder as Parquet and read it back.

    Files on shared storage, so losing an executor afterwards costs no
    recomputation, and readers prune columns.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/casefile/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def attach_group_stats(members: DataFrame, stats: DataFrame, key: str,
                       hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """Inner-join per-key ``stats`` (one row per key, with ``n``; cheap to read twice) onto members.

    Keys with more than ``hot_rows`` rows go through a broadcast join, after a
    count has shown that they are at most ``MAX_HOT_KEYS``; otherwise the
    threshold is raised tenfold until they are.
    """
    def hot_keys():
        return stats.where(F.col("n") > hot_rows)

    while (few := hot_keys().limit(MAX_HOT_KEYS + 1).count()) > MAX_HOT_KEYS:
        hot_rows *= 10
    if not few:
        return members.join(stats, on=key, how="inner")
    hot = F.broadcast(hot_keys())
    cold_members = members.join(hot.select(key), on=key, how="left_anti").join(
        stats.where(F.col("n") <= hot_rows), on=key, how="inner")
    return members.join(hot, on=key, how="inner").unionByName(cold_members)


def duplicate_members(members: DataFrame, key: str = "file_hash", hot_rows: int = HOT_GROUP_ROWS,
                      materialized: bool = False) -> DataFrame:
    """Every member of a duplicate group with its group size ``n``.

    ``materialized=True`` declares that ``members`` is already cheap to read
    twice (e.g. a Parquet table); otherwise it is written first.
    """
    if not materialized:
        members = materialize(members)
    return attach_group_stats(members, materialize(duplicate_counts(members, key), "sizes"), key, hot_rows)


def duplicate_groups(members: DataFrame, key: str = "file_hash", label: str = "label") -> DataFrame:
    """``(key, n, first_file)`` of every duplicate group; ``first_file`` is its smallest label."""
    return hash_counts(members, key, label).where(F.col("n") > 1)


def duplicate_files(members: DataFrame, key: str = "file_hash", label: str = "label",
                    hot_rows: int = HOT_GROUP_ROWS, materialized: bool = False) -> DataFrame:
    """``duplicate_members`` plus ``first_file``, which names the group without its digest."""
    if not materialized:
        members = materialize(members)
    return attach_group_stats(members, materialize(duplicate_groups(members, key, label), "groups"), key, hot_rows)


def duplicate_preview(members: DataFrame, n: int = 20, key: str = "file_hash", label: str = "label",
                      materialized: bool = False) -> DataFrame:
    """All files of the ``n`` largest groups (a top-k report; ties go by the smallest label)."""
    if not materialized:
        members = materialize(members)
    top = duplicate_groups(members, key, label).orderBy(F.desc("n"), F.asc("first_file")).limit(n)
    return members.join(F.broadcast(top), on=key, how="inner")  # n rows
