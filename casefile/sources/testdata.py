"""Derive an evidence table from the generated benchmark tables.

Text-bearing tables become "files": documents, web pages, event payloads and
chat turns are data files, regions are directories.  Content longer than
``INLINE_LIMIT`` bytes is stored externally (``external_path`` set, inline
content NULL) and served by ``external_store`` as a binary-file-like
DataFrame ``(path, length, content)`` whose file name is the row id.

Some chat turns begin with a file signature (``PREFIXES``), hold a NUL far
inside, or start with a byte-order mark; document paths vary their extension;
some external files come twice under one name.

The same derivation is written as DuckDB SQL in ``casefile.plans.oracle`` so
every query over it can be checked against an independent engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from casefile.sources.evidence import DATA_FILE, conform

# Fixed values of the test-data layout (our choice, mirrored in the oracle SQL).
INLINE_LIMIT = 4096
EXTERNAL_DIR = "/external/"


# What the n-th of every 40 chat turns begins with (signatures of public formats that are text).
PREFIXES = [
    "%PDF-1.7\n", "GIF89a", "PK\x03\x04", "%!PS-Adobe", "{\\rtf1 ", "BZh9", "Rar!\x1a\x07", "\x7fELF", "MZ",
    "SQLite format 3\x00", "OggS", "fLaC", "ID3", "RIFF0000WEBP", "RIFF0000WAVE", "RIFF0000AVI ", "0000ftypqt  ",
    "0000ftypheic", "0000ftypM4A ", "0000ftypisom", "II*\x00", "BM0000" + 4 * "\x00", '<?xml version="1.0"?>',
    " \n<SVG ", "\ufeff<html>", "\ufeff", 600 * "x" + "\x00", 257 * "y" + "ustar",
    "".join(c + "\x00" for c in "Secret wide text ") + "\x00\x00",
    600 * " " + "<html>", "<!-- " + 2000 * "c" + " -->\n<svg ", '<?xml version="1.0"?><!-- a --><rss version="2.0">',
    '<html xmlns="http://www.w3.org/1999/xhtml">', '<feed xmlns="http://www.w3.org/2005/Atom">',
]
# Fixed value: which of every 40 chat turns is UTF-16LE throughout (if it is ASCII).
WIDE_TURN = 34
PREFIX_EVERY = 40

_TABLES: dict[tuple[str, str, str], DataFrame] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``spark.read.parquet`` of one generated table, reused per session.

    Reading a Parquet path infers its schema with a small Spark job; the
    generated tables are read-only, so the frame (schema and file listing)
    is built once per session and folder.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _TABLES:
        _TABLES[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return _TABLES[key]


def _s(name: str):
    return F.col(name).cast("string")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the text tables as one file.

    The ``%`` expressions below only shape edge cases into the data (a NULL
    path, empty content, a wrong extension); no row is ever filtered out.
    """
    read = lambda t: read_table(spark, sf_dir, t)
    docs = read("documents").select(
        F.concat(F.lit("doc-"), _s("doc_id")).alias("id"),
        F.concat("source", F.lit("/"), "lang", F.lit("/"), _s("doc_id"),
                 F.when(F.col("doc_id") % 7 == 0, F.lit(".csv")).when(F.col("doc_id") % 7 == 1, F.lit(".json"))
                 .otherwise(F.lit(".txt"))).alias("file_path"),
        F.lit(DATA_FILE).alias("file_type"),
        F.col("lang").alias("owner"), F.col("source").alias("group"), F.col("text").alias("t"))
    pages = read("pages").select(
        F.concat(F.lit("page-"), _s("page_id")).alias("id"),
        # every tenth page carries a wrong extension
        F.concat(F.lit("web/"), _s("page_id"),
                 F.when(F.col("page_id") % 10 == 0, F.lit(".txt")).otherwise(F.lit(".html"))).alias("file_path"),
        F.lit(DATA_FILE).alias("file_type"),
        F.lit("web").alias("owner"), F.lit("web").alias("group"), F.col("html").alias("t"))
    events = read("events").select(
        F.concat(F.lit("evt-"), _s("event_id")).alias("id"),
        F.when(F.col("event_id") % 50 != 0,
               F.concat(F.lit("events/"), "event_type", F.lit("/"), _s("event_id"), F.lit(".json"))).alias("file_path"),
        F.lit(DATA_FILE).alias("file_type"),
        _s("user_id").alias("owner"), F.col("event_type").alias("group"),
        F.when(F.col("event_id") % 97 == 0, F.lit("")).otherwise(F.col("props")).alias("t"))
    nth = ((F.col("conv_id") + F.col("turn")) % PREFIX_EVERY).cast("int")
    chats = read("conversations").select(
        F.concat(F.lit("chat-"), _s("conv_id"), F.lit("-"), _s("turn")).alias("id"),
        F.concat(F.lit("chat/"), _s("conv_id"), F.lit("/"), _s("turn"), F.lit(".txt")).alias("file_path"),
        F.lit(DATA_FILE).alias("file_type"),
        F.col("role").alias("owner"), F.lit("chat").alias("group"),
        F.when((nth == WIDE_TURN) & F.col("text").rlike(r"\A[\x00-\x7F]*\z"),
               F.regexp_replace("text", "(?s)(.)", "$1\x00"))
        .otherwise(F.concat(F.coalesce(F.get(F.array(*[F.lit(p) for p in PREFIXES]), nth), F.lit("")), "text")).alias("t"))
    dirs = read("region").select(
        F.concat(F.lit("dir-"), _s("r_regionkey")).alias("id"),
        F.col("r_name").alias("file_path"),
        F.lit("DIRECTORY").alias("file_type"),
        F.lit("root").alias("owner"), F.lit("root").alias("group"),
        F.lit(None).cast("string").alias("t"))
    return (docs.unionByName(pages).unionByName(events).unionByName(chats).unionByName(dirs)
            .withColumn("n_bytes", F.octet_length("t").cast("bigint")))


def _memo(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Reuse a derived frame per session and folder (immutable plan; every
    action still scans and computes from the tables)."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _TABLES:
        _TABLES[key] = build()
    return _TABLES[key]


def evidence_from_testdata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence table (canonical schema) derived from the generated tables."""
    return _memo(spark, sf_dir, "#evidence", lambda: _evidence(spark, sf_dir))


def external_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External large-file store as ``(path, length, content)``; file name = row id."""
    return _memo(spark, sf_dir, "#external", lambda: _external(spark, sf_dir))


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir)
    return conform(f.select(
        "id", "file_path", "file_type",
        F.col("n_bytes").cast("string").alias("file_size"),
        "owner", "group",
        F.when(F.col("n_bytes") > INLINE_LIMIT, F.concat(F.lit(EXTERNAL_DIR), "id")).alias("external_path"),
        F.when(F.col("n_bytes") <= INLINE_LIMIT, F.col("t").cast("binary")).alias("file_content"),
    ))


def _external(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir).where(F.col("n_bytes") > INLINE_LIMIT)
    stored = f.select(F.concat(F.lit(EXTERNAL_DIR), "id").alias("path"), F.col("n_bytes").alias("length"),
                      F.col("t").cast("binary").alias("content"))
    # every fifth is stored a second time, with one more byte, in a folder that sorts before the first
    again = f.where(F.col("n_bytes") % 5 == 0).select(
        F.concat(F.lit(EXTERNAL_DIR + "again/"), "id").alias("path"), (F.col("n_bytes") + 1).alias("length"),
        F.concat("t", F.lit("!")).cast("binary").alias("content"))
    return stored.unionByName(again)


def _raw(files: DataFrame) -> DataFrame:
    return files.select(F.concat(F.lit("/raw/"), "group", F.lit("/"), "id").alias("path"),
                        F.col("n_bytes").alias("length"), F.col("t").cast("binary").alias("content"))


def directory_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with text, events and zero-length files included, as a raw directory ``(path, length, content)``."""
    return _raw(_files(spark, sf_dir).where("t is not null"))
