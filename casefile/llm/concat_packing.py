"""Packing by concatenating and cutting.

All documents' tokens, each with its end id, form one stream, cut into windows of
``window`` tokens.  Where a document stands in the stream follows from two passes of
prefix sums:

1. Each task encodes its part of the table, keeps a running token count and writes
   (part, tokens of the part before the document, ids).
2. The parts' totals, one number a part, are summed up in order; a document's global
   offset is its part's sum plus its place in the part.  The written ids are then cut where
   the stream crosses a window's border.

No document moves between tasks: nothing is shuffled but the parts' totals.  The order of
the stream is that of the written parts.  Only committed tasks' output is read, so a task
that runs again leaves no second count.

The stream ends somewhere inside a window.  ``tail="powers"`` cuts these last tokens into
sequences of falling powers of two, which need no padding; ``tail="one"`` leaves one
sequence that is padded to the window.

Defined results: a null or empty text has the end id alone; rows with one id, also equal
rows, are documents of their own; an empty table gives an empty result; a text of any
length is one run of tokens over as many windows as it needs; extra columns are not read;
ids of any type are kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from casefile.llm.byte_tokens import byte_encoder
from casefile.llm.common import batches_by_bytes, broadcast_if_few, materialize
from casefile.llm.tokens import with_end

#: Bytes of text encoded at once; the more, the more of its chunks are equal.
ENCODE_BYTES = 1 << 21
#: Bytes of written ids cut at once.
CUT_BYTES = 1 << 20


def window_of(offsets: np.ndarray, total: int, window: int, tail: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sequence that holds each stream offset, and where that sequence begins and ends."""
    whole = total // window
    number = offsets // window
    begin, end = number * window, np.minimum((number + 1) * window, total)
    if tail == "powers":
        left = total - whole * window
        sizes = [1 << bit for bit in range(left.bit_length() - 1, -1, -1) if left >> bit & 1]
        borders = whole * window + np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)
        late = np.flatnonzero(number >= whole)
        place = np.searchsorted(borders, offsets[late], side="right") - 1
        number[late], begin[late], end[late] = whole + place, borders[place], borders[place + 1]
    return number, begin, end


def cut_points(starts: np.ndarray, lengths: np.ndarray, total: int, window: int, tail: str):
    """Cut stream intervals at the borders of sequences: (interval, offset, length, sequence, place there)."""
    row, at, size, number, place = [], [], [], [], []
    here, left, rows = starts.copy(), lengths.copy(), np.arange(len(starts))
    aligned = (total // window) * window
    # the whole windows inside an interval at once, the borders of the tail one by one
    while len(rows):
        sequence, begin, end = window_of(here, total, window, tail)
        inner = np.where((here == begin) & (end - begin == window), np.minimum(left, aligned - here) // window, 0)
        many = np.maximum(inner, 1)
        of = np.repeat(np.arange(len(rows)), many)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        taken = np.where(inner > 0, window, np.minimum(end - here, left))
        row.append(rows[of])
        at.append(here[of] + nth * window)
        size.append(taken[of])
        number.append(sequence[of] + nth)
        place.append((here - begin)[of])
        here, left = here + many * taken, left - many * taken
        more = left > 0
        here, left, rows = here[more], left[more], rows[more]
    if not row:
        return (np.zeros(0, np.int64),) * 5
    found = [np.concatenate(x) for x in (row, at, size, number, place)]
    order = np.lexsort((found[1], found[0]))
    return tuple(x[order] for x in found)


def _filled(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Join short record batches until the bytes of ``column`` reach ``limit``; slice long ones."""
    held, size = [], 0
    for batch in batches_by_bytes(batches, column, limit):
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= limit:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def token_stream(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Return (part, place, id, n_tokens, ids): each document's ids and its place in its part of the stream."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        coder = byte_encoder(tokenizer_path)
        kind = np.dtype("<u2" if max(coder.highest, end_id) < 1 << 16 else "<u4")
        for batch in _filled(batches, "text", ENCODE_BYTES):
            ids, stops = with_end(*coder.encode(batch.column(1)), end_id)
            sizes = np.diff(stops, prepend=0)
            raw = ids.astype(kind).tobytes()
            ends = (stops * kind.itemsize).tolist()
            begins = [0, *ends[:-1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(sizes), part, np.int32)), pa.array(place + stops - sizes),
                 batch.column(0), pa.array(sizes), pa.array([raw[b:e] for b, e in zip(begins, ends)], pa.binary())],
                names=schema.names)
            place += int(stops[-1])

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = StructType([StructField("part", IntegerType()), StructField("place", LongType()),
                         StructField("id", given.schema["id"].dataType), StructField("n_tokens", LongType()),
                         StructField("ids", BinaryType())])
    return given.mapInArrow(encode, schema)


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id",
         text_col: str = "text", with_ids: bool = False, tail: str = "powers") -> DataFrame:
    """Return (id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) for every piece."""
    if tail not in ("powers", "one"):
        raise ValueError("tail must be 'powers' or 'one'")
    if window < 1:
        raise ValueError("a window holds at least one token")
    stream = materialize(token_stream(docs, tokenizer_path, end_id, id_col, text_col), "token-stream")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row a part of the input
    bases = materialize(stream.groupBy("part").agg(F.sum("n_tokens").alias("n"))
                        .withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "stream-parts")
    total = int(bases.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, "ids", CUT_BYTES):
            sizes = batch.column("n_tokens").to_numpy()
            starts = batch.column("begin").to_numpy()
            raw = batch.column("ids").to_pylist()
            rows, at, length, sequence, place = cut_points(starts, sizes, total, window, tail)
            first = at - starts[rows]
            arrays = [np.frombuffer(r, f"<u{len(r) // n}").astype("<u4") for r, n in zip(raw, sizes.tolist())]
            parts = [arrays[r][b:b + n] for r, b, n in zip(rows.tolist(), first.tolist(), length.tolist())]
            columns = [batch.column("id").take(pa.array(rows)), pa.array(first), pa.array(length),
                       pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(sizes[rows]),
                       pa.array(sequence), pa.array(place)]
            if with_ids:
                columns.append(pa.array([p.tobytes() for p in parts], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    schema = StructType([StructField("id", stream.schema["id"].dataType)]
                        + [StructField(name, LongType()) for name in
                           ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
                        + ([StructField("ids", BinaryType())] if with_ids else []))
    placed = stream.join(broadcast_if_few(bases.select("part", "base")), "part").select(
        "id", "n_tokens", (F.col("base") + F.col("place")).alias("begin"), "ids")
    return placed.mapInArrow(cut, schema)


def boundaries(packed: DataFrame) -> DataFrame:
    """One record a sequence: (sequence_id, id, start), the document and the token in it that the sequence begins with."""
    return packed.where("offset = 0").select("sequence_id", "id", "start")


def sequences(packed: DataFrame) -> DataFrame:
    """Packed pieces with ids -> (sequence_id, n_tokens, ids); a sequence has at most ``window`` tokens."""
    piece = F.struct("offset", "ids")
    return (packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"),
                                              F.array_sort(F.collect_list(piece)).alias("parts"))
            .select("sequence_id", "n_tokens",
                    F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids")))
