"""Annotation tables that take batch after batch.

The table is Parquet with one folder for each bucket of the id's hash.  ``upsert`` merges a
batch by copy on write: the buckets that the batch touches are read, merged and written
anew; files of other buckets stay as they are.  Spark stages the new files and puts them in
the place of the old only when the job commits, so a lost task is run again, and a job that
fails leaves the old state.  Within a batch the row with the greatest ``seq`` wins, over
batches the last batch; ids unknown so far become new rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from casefile.operators.annotate import ANNOTATION_COLUMNS
from casefile.operators.duplicates import materialize

BUCKETS = 256


def bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))


def schema_of(column: str) -> str:
    return f"id string, {column} string, bucket int"


def read(spark: SparkSession, path: str, column: str) -> DataFrame:
    """``(id, <column>)`` of the table below ``path``."""
    return _table(spark, path, column).drop("bucket")


def _table(spark: SparkSession, path: str, column: str) -> DataFrame:
    return spark.read.schema(schema_of(column)).option("basePath", path).parquet(path)


def create(spark: SparkSession, path: str, column: str) -> None:
    """An empty table below ``path``, which must not exist."""
    if column not in ANNOTATION_COLUMNS:
        raise ValueError(f"unknown annotation column {column!r}")
    spark.createDataFrame([], schema_of(column)).write.partitionBy("bucket").parquet(path)


def last_rows(batch: DataFrame, column: str, seq: str | None) -> DataFrame:
    """One ``(id, <column>)`` row an id: that with the greatest ``seq``, then value; rows without id or value are left out."""
    given = batch.where(F.col("id").isNotNull() & F.col(column).isNotNull())
    order = F.struct(*([F.col(seq)] if seq else []), F.col(column).cast("string").alias("value"))
    return given.groupBy("id").agg(F.max(order).alias("last")).select("id", F.col("last.value").alias(column))


def upsert(batch: DataFrame, path: str, column: str, seq: str | None = None, buckets: int = BUCKETS) -> int:
    """Merge a batch ``(id, <column>)`` into the table below ``path``; returns how many buckets were rewritten.

    ``buckets`` must be the same in every call for one table.  One writer at a time.
    """
    spark = batch.sparkSession
    new = materialize(bucketed(last_rows(batch, column, seq), buckets), "upsert")
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` rows
    if not touched:
        return 0
    old = _table(spark, path, column).where(F.col("bucket").isin(touched))
    merged = old.join(new.select("id", "bucket"), ["id", "bucket"], "left_anti").unionByName(new)
    (merged.repartition(min(len(touched), int(spark.conf.get("spark.sql.shuffle.partitions"))), "bucket")
     .sortWithinPartitions("bucket", "id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("bucket").parquet(path))
    return len(touched)
