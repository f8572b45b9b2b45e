"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casefile.session import checkpoint_dir

#: Fixed value: what separates words in every operator (blank, tab ... carriage return).
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_PATTERN = f"[^{SPACE_CLASS}]+"

#: Rows handed to a Python worker at once; texts can be long, so batches are short.
ARROW_ROWS = 256
#: Bytes of text a Python function works on at once (a longer text is worked on alone).
BATCH_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the rows of one Arrow batch, so that a worker holds few texts at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/casefile-llm/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    # shuffle files of what is now written are dropped when the driver's garbage is
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


#: Rows up to which a written side table is broadcast; beyond it Spark joins by a shuffle.
BROADCAST_ROWS = 100_000


def broadcast_if_few(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only where a count of the (narrow) side shows at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value, body):
    """Bind ``value`` once and use it in ``body`` (a higher-order function keeps it from being evaluated again)."""
    return F.transform(F.array(value), body)[0]


def batches_by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slice record batches so that the bytes of ``column`` stay near ``limit`` (one row may exceed it)."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for row, size in enumerate(sizes.tolist()):
            if held and held + size > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def id_bounds(df: DataFrame, id_col: str, parts: int) -> list:
    """At most ``parts - 1`` ascending ids that cut ``df`` into ranges of about equal row counts.

    Only these bounds reach the driver; their number is the number of partitions.
    """
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    row = df.agg(F.percentile_approx(F.col(id_col), shares, 10_000).alias("b")).first()
    return sorted({b for b in (row["b"] or []) if b is not None})


def with_range_bucket(df: DataFrame, id_col: str, bounds: list, name: str) -> DataFrame:
    """Add ``name``: the number of bounds that are at most the id (a null id: 0), by binary search in the JVM.

    Ids are compared as doubles, which keeps their order; ids that share a double share a bucket.
    """
    from pyspark.ml.feature import Bucketizer

    raw, number = f"__{name}_raw", f"__{name}_id"
    cuts = sorted({float(b) for b in bounds})
    if not cuts:
        return df.withColumn(name, F.lit(0))
    keyed = df.withColumn(number, F.col(id_col).cast("double"))
    out = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol=number, outputCol=raw,
                     handleInvalid="keep").transform(keyed)
    return out.withColumn(name, F.when(F.col(id_col).isNull(), 0).otherwise(F.col(raw).cast("int"))) \
        .drop(raw, number)
