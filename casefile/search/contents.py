"""What is searched: the content of every file, and the strings in it.

Inline content and external files are read where they lie; only strings, or what is made
of them, move on.  The external copy of a file wins over inline content, and of external
files with one name the largest path wins, as for digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from casefile.functions import strings
from casefile.functions.columns import base_name, nonempty
from casefile.operators.duplicates import materialize
from casefile.operators.hashing import CHUNK_BYTES, open_path

#: Bytes of content that a Python worker scans at once (a longer content is scanned alone).
BATCH_BYTES = 1 << 22
#: Rows up to which a side table is broadcast.
BROADCAST_ROWS = 100_000

_STRINGS = "offset long, encoding string, text string"


def broadcast_if_few(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only where a count shows at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def by_bytes(batches: Iterator[pa.RecordBatch], *columns: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slice record batches so that the bytes of some columns stay near ``limit`` (one row may exceed it)."""
    import pyarrow.compute as pc

    for batch in batches:
        ends = np.cumsum(sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy().astype(np.int64)
                             for c in columns))
        start = 0
        while start < batch.num_rows:
            held = int(ends[start - 1]) if start else 0
            stop = max(int(np.searchsorted(ends, held + limit, side="right")), start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def from_sources(evidence: DataFrame, store: DataFrame | None, derive) -> DataFrame:
    """``derive(frame)`` over both sources: inline content first, then ``store`` ``(path, length, content)``.

    ``derive`` gets (id, content) and keeps the ``id``; ids that the store replaces are dropped from the inline
    result, and names listed twice keep their largest path.  These joins see ``derive``'s rows, never the content.
    """
    inline = derive(evidence.where(nonempty("file_content")).select("id", F.col("file_content").alias("content")))
    if store is None:
        return inline
    listed = materialize(store.select(base_name("path").alias("id"), "path"), "store-names")
    best = listed.groupBy("id").agg(F.max("path").alias("best"))
    lost = materialize(listed.join(best, "id").where("path < best").select("path"), "store-lost")
    outside = derive(store.where(F.col("length") > 0).select(F.col("path").alias("id"), "content"))
    kept = outside.join(broadcast_if_few(lost), outside["id"] == lost["path"], "left_anti").withColumn("id", base_name("id"))
    names = materialize(best.select("id"), "store-ids")
    return inline.join(broadcast_if_few(names), "id", "left_anti").unionByName(kept)


def strings_of_contents(contents: DataFrame, least: int = strings.LEAST, longest: int = strings.LONGEST) -> DataFrame:
    """(id, offset, encoding, text) of every string in ``(id, content)`` rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "content"):
            rows, found = [], []
            for row, data in enumerate(batch.column("content").to_pylist()):
                made = strings.strings_of(data or b"", least, longest)
                found += made
                rows += [row] * len(made)
            yield _record(batch.column("id").take(pa.array(rows, pa.int64())), found)

    return contents.select("id", "content").mapInArrow(run, "id string, " + _STRINGS)


def _record(ids: pa.Array, found: list) -> pa.RecordBatch:
    offsets, encodings, texts = zip(*found) if found else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [ids.cast(pa.string()), pa.array(offsets, pa.int64()), pa.array(encodings, pa.string()),
         pa.array(texts, pa.string())], names=["id", "offset", "encoding", "text"])


def strings_of_files(listing: DataFrame, least: int = strings.LEAST, longest: int = strings.LONGEST,
                     chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, offset, encoding, text) of every string in listed files; ``id`` is the path.

    Files of any size are read in chunks; runs are joined across chunk seams.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                scanner = strings.RunScanner(least, longest)
                with open_path(path) as file:
                    while chunk := file.read(chunk_bytes):
                        found = scanner.feed(chunk)
                        yield _record(pa.array([path] * len(found), pa.string()), found)
                found = scanner.close()
                yield _record(pa.array([path] * len(found), pa.string()), found)

    return listing.select("path").mapInArrow(run, "id string, " + _STRINGS)


def content_strings(evidence: DataFrame, store: DataFrame | None = None, least: int = strings.LEAST) -> DataFrame:
    """(id, offset, encoding, text): the strings of every inline and external file.

    Files without a string have no row.  ``store`` carries its content; for files too large to load,
    use ``strings_of_files``.
    """
    return from_sources(evidence, store, lambda contents: strings_of_contents(contents, least))
