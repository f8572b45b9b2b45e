"""Content hashing of inline and externally stored files.

Bytes are reduced to a small summary ``(path, length, file_hash,
content_type)`` in the first projection over the content; nothing downstream
(joins, shuffles, name refinement) ever sees the bytes.

Files above the binary reader's size limit are read in chunks
(``mapInPandas`` over paths, constant memory per file); Spark partitions that
work by file length like any other scan.  Both routes give equal summaries.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from casefile.functions.columns import base_name, nonempty
from casefile.functions.digest import DEFAULT_BITS, check_bits, digest, empty_digest
from casefile.functions.contentscan import PrologScanner, TextScanner
from casefile.functions.mediatype import HEAD_BYTES, OCTET_STREAM, with_content_type, with_head_type
from casefile.operators.duplicates import materialize
from casefile.sources.files import binary_files, max_binary_length, split_by_length
from casefile.sources.inventory import zero_length_files

# What the chunked reader returns; the rules then run as column expressions.
_READ_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("length", T.LongType()),
    T.StructField("file_hash", T.StringType()),
    T.StructField("head", T.BinaryType()),
    T.StructField("markup", T.StringType()),
    T.StructField("is_text", T.BooleanType()),
])

CHUNK_BYTES = 1 << 20
# Files above this size are streamed in chunks instead of loaded as one value,
# so no task holds a large file in memory (the binary reader's own limit is 2 GiB).
STREAM_ABOVE_BYTES = 64 << 20


def summarize_content(files: DataFrame, bits: int = DEFAULT_BITS) -> DataFrame:
    """``(path, length, file_hash, content_type)`` from a frame that carries ``content``."""
    rows = files.select("path", F.col("length").cast("bigint").alias("length"),
                        digest("content", bits).alias("file_hash"), "content")
    return with_content_type(rows, "content").drop("content")


_FILE_SYSTEMS: dict[tuple[str, str], object] = {}
_URI = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*)://([^/]*)(/.*)", re.S)


def split_uri(path: str) -> tuple[str, str, str]:
    """Scheme, authority and plain path of a listed path; nothing in it is decoded."""
    found = _URI.fullmatch(path)
    if found is None:
        local = path[len("file:"):] if path.startswith("file:") else path
        return "file", "", "/" + local.lstrip("/")
    scheme, authority, plain = found.groups()
    return ("s3" if scheme in ("s3a", "s3n") else scheme), authority, plain


def open_path(path: str):
    """Open a listed path through one file system per (scheme, authority) and worker."""
    scheme, authority, plain = split_uri(path)
    if scheme == "file":
        return open(plain, "rb")
    from pyarrow import fs as pafs

    key = (scheme, authority)
    if key not in _FILE_SYSTEMS:
        _FILE_SYSTEMS[key] = pafs.FileSystem.from_uri(f"{scheme}://{authority}/")[0]
    return _FILE_SYSTEMS[key].open_input_stream(authority + plain if scheme == "s3" else plain)


def _chunked_reader(bits: int | None, head_bytes: int, chunk_bytes: int):
    """Digest (unless ``bits`` is None), head, markup type, and whether the content is text."""
    def run(batches):
        import hashlib

        import pandas as pd

        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                h = hashlib.new(f"sha{bits}") if bits else None
                head, text, prolog = b"", TextScanner(), PrologScanner()
                with open_path(path) as fh:
                    while chunk := fh.read(chunk_bytes):
                        if len(head) < head_bytes:
                            head += chunk[: head_bytes - len(head)]
                        text.feed(chunk)
                        prolog.feed(chunk)
                        if h:
                            h.update(chunk)
                rows.append((h.hexdigest() if h else None, head, prolog.verdict(), text.is_text()))
            found = pd.DataFrame(rows, columns=["file_hash", "head", "markup", "is_text"])
            yield pd.DataFrame({"path": pdf["path"].to_numpy(), "length": pdf["length"].astype("int64").to_numpy(),
                                **{c: found[c] for c in found}})
    return run


def summarize_paths(listing: DataFrame, bits: int | None = DEFAULT_BITS,
                    chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Summaries of ``(path, length)`` rows, each file read in constant memory inside
    the task that holds its row; without ``bits`` the digest is NULL."""
    if bits:
        check_bits(bits)
    read = listing.select("path", F.col("length").cast("bigint").alias("length")).mapInPandas(
        _chunked_reader(bits, HEAD_BYTES, chunk_bytes), _READ_SCHEMA)
    return with_head_type(read, "head", F.col("markup"), F.col("is_text")).drop("head", "markup", "is_text")


def _inventory_paths(spark: SparkSession, directory: str) -> DataFrame:
    """``(path, length)`` of every file, dealt out by path so that reading spreads however the listing was split.

    Entries that could not be listed have no content; ``inventory.unreadable_files`` gives them with their reason.
    """
    from casefile.sources.inventory import file_inventory

    tasks = max(spark.sparkContext.defaultParallelism * 4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    files = file_inventory(spark, directory).where("error is null")
    return files.select("path", "length").repartition(tasks, "path")


def summarize_files(files: DataFrame, bits: int = DEFAULT_BITS,
                    max_length: int | None = None) -> DataFrame:
    """Summaries for a binary-file frame ``(path, length, content)`` read from
    storage (``binary_files``), whose paths the chunked route can open.

    Files longer than ``max_length`` (default: 64 MiB, never above the
    session's binary reader limit) take the chunked route; their content
    column is never read, so task memory does not grow with file size.
    """
    reader_limit = max_binary_length(files.sparkSession)
    limit = min(STREAM_ABOVE_BYTES if max_length is None else max_length, reader_limit)
    small, large = split_by_length(files, limit)
    return summarize_content(small, bits).unionByName(summarize_paths(large, bits))


def empty_file_summaries(zero_length: DataFrame, bits: int = DEFAULT_BITS) -> DataFrame:
    """Summaries for zero-length files (``path`` rows), which the binary reader skips."""
    return zero_length.select(
        "path", F.lit(0).cast("bigint").alias("length"),
        F.lit(empty_digest(bits)).alias("file_hash"),
        F.lit(OCTET_STREAM).alias("content_type"))


def inline_hashes(evidence: DataFrame, bits: int = DEFAULT_BITS) -> DataFrame:
    """``(id, file_hash)`` of non-empty inline content; empty content gets no hash."""
    return evidence.where(nonempty("file_content")).select(
        "id", digest("file_content", bits).alias("file_hash"))


def external_hashes(summaries: DataFrame) -> DataFrame:
    """``(id, file_hash)`` of external files, id = file name; of equal names the largest path wins.

    External files are few beside the evidence rows, so this is the only aggregation.
    """
    return (summaries.groupBy(base_name("path").alias("id"))
            .agg(F.max_by("file_hash", "path").alias("file_hash")))


def inline_summaries(evidence: DataFrame, bits: int = DEFAULT_BITS) -> DataFrame:
    """``(id, file_path, file_hash, content_type)`` of non-empty inline content, one read of the bytes."""
    rows = evidence.where(nonempty("file_content")).select(
        "id", "file_path", digest("file_content", bits).alias("file_hash"), "file_content")
    return with_content_type(rows, "file_content").drop("file_content")


def file_hashes(evidence: DataFrame, external: DataFrame | None = None,
                bits: int = DEFAULT_BITS) -> DataFrame:
    """Digest of every inline and external file: ``(id, file_hash)``.

    ``external`` is a summary frame (``summarize_files``).  One hash per id
    (ids are unique in the evidence): the external copy wins over inline
    content, and of external files with one name the largest path wins.
    """
    return combine_hashes(inline_hashes(evidence, bits), external)


def combine_hashes(inline: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """Merge inline ``(id, file_hash)`` with external summaries (see ``file_hashes``).

    Inline rows are neither aggregated nor sorted: those that an external
    file replaces are dropped by an anti join, for which Spark broadcasts the
    external ids if they prove few.
    """
    inline = inline.select("id", "file_hash")
    if external is None:
        return inline
    outside = materialize(external_hashes(external), "external-hashes")  # used twice
    return inline.join(outside.select("id"), "id", "left_anti").unionByName(outside)


def hashed_paths(evidence: DataFrame, external: DataFrame | None = None, bits: int = DEFAULT_BITS) -> DataFrame:
    """``(id, file_path, file_hash)`` of every file with a hash, new or stored.

    Equal to ``hash_and_path`` over the evidence merged with ``file_hashes``,
    but the path travels with the digest, so the evidence is shuffled once
    (not at all without external files).
    """
    new = F.when(nonempty("file_content"), digest("file_content", bits))
    rows = evidence.select("id", "file_path", F.coalesce(new, "file_hash").alias("file_hash"))
    if external is not None:
        outside = external_hashes(external).withColumnRenamed("file_hash", "new_hash")
        rows = rows.join(outside, "id", "full_outer").select(
            "id", "file_path", F.coalesce("new_hash", "file_hash").alias("file_hash"))
    return rows.where(nonempty("file_hash"))


def external_id_collisions(external: DataFrame) -> DataFrame:
    """External files whose name is listed more than once: ``(id, path, n)``.

    Long form (one row per colliding file), so a name shared by very many
    files never becomes one row; such a hot name is joined back through the
    bounded broadcast branch of ``attach_group_stats``.
    """
    from casefile.operators.duplicates import attach_group_stats

    named = materialize(external.select(base_name("path").alias("id"), "path"), "names")
    counts = materialize(named.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "sizes")
    return attach_group_stats(named, counts, "id").select("id", "path", "n")


def summarize_directory(spark: SparkSession, directory: str, bits: int = DEFAULT_BITS,
                        include_empty: bool = True, max_length: int | None = None,
                        listing: str = "index") -> DataFrame:
    """Summaries of every file below ``directory``.

    ``listing="index"`` lists with Spark's file index and hashes in the JVM;
    zero-length files, which that reader skips, are added from the file
    inventory when ``include_empty`` is set.  ``listing="inventory"`` lists
    with the executor-side inventory source (no file list on the driver, for
    very large trees), deals the paths out and hashes every file with the chunked reader.

    On both routes, an entry that cannot be listed (a dangling link) has no row; ``inventory.unreadable_files``
    reports it.  A file that fails while it is read fails its task.
    """
    if listing == "inventory":
        return summarize_paths(_inventory_paths(spark, directory), bits)
    if listing != "index":
        raise ValueError("listing must be 'index' or 'inventory'")
    out = summarize_files(binary_files(spark, directory), bits, max_length)
    if include_empty:
        out = out.unionByName(empty_file_summaries(zero_length_files(spark, directory), bits))
    return out


# Files up to this size are typed by the JVM reader, larger ones by the chunked reader.
SMALL_FILE_BYTES = 64 * 1024


def read_types(spark: SparkSession, directory: str, include_empty: bool = True,
               small_file_bytes: int = SMALL_FILE_BYTES, listing: str = "index") -> DataFrame:
    """``(path, length, content_type)`` of every file below ``directory``.

    Small files (one read either way) are loaded by the JVM binary reader;
    larger ones are read by their task, only as far as the verdict needs.
    Both branches filter the same listing on ``length``, which the reader
    applies before loading any bytes.  ``listing`` as in ``summarize_directory``.
    """
    columns = ["path", "length", "content_type"]
    if listing == "inventory":
        return summarize_paths(_inventory_paths(spark, directory), None).select(*columns)
    files = binary_files(spark, directory)
    small = files.where(F.col("length") <= small_file_bytes).select(
        "path", F.col("length").cast("bigint").alias("length"), "content")
    large = files.where(F.col("length") > small_file_bytes).select("path", "length")
    types = with_content_type(small, "content").select(*columns).unionByName(
        summarize_paths(large, None).select(*columns))
    if include_empty:
        types = types.unionByName(zero_length_files(spark, directory).select(
            "path", F.lit(0).cast("bigint").alias("length"), F.lit(OCTET_STREAM).alias("content_type")))
    return types
