"""The corpus pipeline: stages over ``documents``, each written as Parquet and read back.

Every stage but the last returns the columns of ``documents``.  A stage sees all that its
predecessor kept, and only that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casefile.llm import language_id, pareto_mix, pattern_packing, simhash, suffix_dedup
from casefile.llm.common import materialize, short_batches, table
from casefile.llm.tokens import public_tokenizer


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model does not reject (no letters, or no language it has learned)."""
    short_batches(spark)
    return language_id.accepted(docs, language_id.fit(docs))


def near_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by at most 4 of 64 SimHash bits."""
    short_batches(spark)
    return simhash.keep_one(docs, 4, 4)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the characters covered by 200-byte strings that occur twice; texts used up go."""
    short_batches(spark)
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    marked = docs.withColumn("__has_text", F.col("text").isNotNull())
    found = suffix_dedup.remove_repeats(marked, 200, whole_characters=True, carry=[*others, "__has_text"])
    rows = (found.where("n_bytes = 0 or octet_length(kept) > 0")
            .select("carried.*", F.decode("kept", "UTF-8").alias("text"))
            .withColumn("text", F.when(F.col("__has_text"), F.col("text")))
            .withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return rows.select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to weights 1, 2, 3: each document as often as the mix takes it, at most three times."""
    return pareto_mix.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents and their places in sequences of at most 2048 tokens."""
    short_batches(spark)
    return pattern_packing.pack(docs, public_tokenizer(), 2048, 0).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language ID", known_language),
    ("SimHash near-dedup", near_distinct),
    ("suffix-array dedup", without_repeats),
    ("mixing sources", source_mix),
    ("best-fit packing", packed),
]

#: The stages train a model, link near copies and tokenize, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
