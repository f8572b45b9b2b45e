"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases, the phrases into phrases of phrases, and so on.  On each
level runs of one symbol become one symbol; then deterministic coin tossing (the lowest
bit in which a symbol differs from its left neighbour, and that bit) shrinks the symbols
to labels below 6 whose local maxima begin the phrases.  Where a phrase begins depends on
a few symbols around it only, so equal substrings get equal phrase names inside,
wherever they stand.  A phrase's name is a hash of its symbols' names.

A fingerprint is a sketch of the names from level ``FIRST_LEVEL`` up (of the top level
of shorter texts): in each of ``SLOTS`` classes of names, 16 bits of the smallest.  The
likeness of two fingerprints, the share of classes that agree, estimates the share of
names that the texts have in common.

Defined results: null counts as empty, whose fingerprint is all ``0``; equal texts have
equal fingerprints and likeness 1; an empty text is unlike any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from casefile.llm.common import BATCH_BYTES, batches_by_bytes, id_bounds, partitions, with_range_bucket

SLOTS = 128
#: Names of this level and above are sketched; its phrases have about 6 code points.
FIRST_LEVEL = 2
#: Rounds of coin tossing: 64 bits -> 128 labels -> 14 -> 8 -> 6.
ROUNDS = 4
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (a fixed permutation)."""
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


def _toss(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels twice the place of the lowest bit that differs from the left neighbour, plus that bit."""
    left = np.empty_like(symbols)
    left[1:] = symbols[:-1]
    left[first] = ~symbols[first]
    differ = symbols ^ left
    low = differ & (~differ + symbols.dtype.type(1))
    place = np.bitwise_count(low - symbols.dtype.type(1))
    return 2 * place + ((symbols & low) != 0).view(np.uint8)


def _phrases(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: names (all texts, one after the other; ``first``: where each begins) -> the next level's."""
    size = len(names)
    opens = np.empty(size, bool)
    opens[0] = True
    np.not_equal(names[1:], names[:-1], out=opens[1:])
    opens[first] = True
    starts = np.flatnonzero(opens)
    symbols = names
    if len(starts) < size:  # a run becomes one symbol
        runs = np.diff(starts, append=size)
        symbols = names[starts].astype(np.uint64)
        longer = runs > 1
        symbols[longer] = _mix(symbols[longer] * _ODD[0] + runs[longer].astype(np.uint64))
        first = np.searchsorted(starts, first)
        size = len(symbols)
    labels = _toss(symbols, first)
    for _ in range(ROUNDS - 1):
        labels = _toss(labels, first)
    begin = np.zeros(size, bool)
    begin[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
    begin[first[1:] - 1] = False  # a text's last symbol has no right neighbour
    begin[first] = True
    heads = np.flatnonzero(begin)
    lengths = np.diff(heads, append=size)
    inside = np.arange(size) - np.repeat(heads, lengths)
    weights = np.multiply.accumulate(np.full(int(lengths.max()), _ODD[0], np.uint64))
    sums = np.add.reduceat(_mix(symbols.astype(np.uint64) + _ODD[0]) * weights[inside], heads)
    return _mix(sums + lengths.astype(np.uint64)), np.searchsorted(heads, first)


def _sketch(names: np.ndarray, owners: np.ndarray, texts: int) -> np.ndarray:
    """``texts x SLOTS`` 16-bit values: of the smallest name in each slot, 0 where there is none.

    A text's second, third ... phrase of one name counts as a name of its own.
    """
    order = np.lexsort((names, owners))
    names, owners = names[order], owners[order]
    fresh = np.ones(len(names), bool)
    fresh[1:] = (names[1:] != names[:-1]) | (owners[1:] != owners[:-1])
    at = np.flatnonzero(fresh)
    nth = np.arange(len(names)) - np.repeat(at, np.diff(at, append=len(names)))
    spread = _mix(names + _ODD[1] + nth.astype(np.uint64) * _ODD[0])
    slot = owners * SLOTS + (spread % np.uint64(SLOTS)).astype(np.int64)
    value = spread >> np.uint64(7)
    order = np.lexsort((value, slot))
    slot, value = slot[order], value[order]
    least = np.flatnonzero(np.diff(slot, prepend=-1))
    out = np.zeros(texts * SLOTS, np.uint16)
    out[slot[least]] = (value[least] % np.uint64(65535)).astype(np.uint16) + 1
    return out.reshape(texts, SLOTS)


def sketches(texts: Sequence[str]) -> np.ndarray:
    """The fingerprints of texts as an array ``texts x SLOTS``."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.zeros((len(texts), SLOTS), np.uint16)
    where = np.flatnonzero(sizes)  # empty texts have no symbols
    if not len(where):
        return out
    names = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    first = np.cumsum(sizes[where]) - sizes[where]
    found, owners = [], []
    level, at = 0, np.arange(len(where))
    while len(at):
        names, first = _phrases(names, first)
        level += 1
        counts = np.diff(first, append=len(names))
        done = counts == 1
        if level >= FIRST_LEVEL or done.any():
            keep = np.ones(len(at), bool) if level >= FIRST_LEVEL else done
            found.append(names[np.repeat(keep, counts)])
            owners.append(np.repeat(at[keep], counts[keep]))
        if done.any():
            names = names[np.repeat(~done, counts)]
            at, counts = at[~done], counts[~done]
            first = np.cumsum(counts) - counts
    out[where] = _sketch(np.concatenate(found), np.concatenate(owners), len(where))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of slots that agree, among those that either fingerprint fills; 1 for equal fingerprints."""
    used = ((a != 0) | (b != 0)).sum(axis=1)
    agree = ((a == b) & (a != 0)).sum(axis=1)
    return np.where(used == 0, 1.0, agree / np.maximum(used, 1))


def digits(sketch: np.ndarray) -> list[str]:
    """Fingerprints as hexadecimal strings, four digits a slot; all ``0`` for an empty text."""
    return [row.tobytes().hex() for row in np.ascontiguousarray(sketch.astype(">u2"))]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (id, fingerprint) for every document; needs no shuffle."""
    given = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, "text", BATCH_BYTES):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digits(sketches(batch.column(1).to_pylist())), pa.string())],
                names=["id", "fingerprint"])

    return given.mapInArrow(run, StructType([given.schema["id"], StructField("fingerprint", StringType())]))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (part, after, id, text) laid out so that each row's next document follows it in its partition.

    Documents are dealt into id ranges; each range also gets the next range's first
    document (the last range the very first), marked ``after``.  Only the ranges'
    bounds and first ids reach the driver.  Null ids come first; rows of one id go by text.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    count = partitions(spark)
    keyed = with_range_bucket(given, "id", id_bounds(given, "id", count), "part")
    firsts = sorted((r["part"], r["has_null"], r["id"]) for r in keyed.groupBy("part").agg(
        F.min("id").alias("id"), F.max(F.col("id").isNull()).alias("has_null")).collect())
    if not firsts:
        return keyed.select("part", F.lit(False).alias("after"), "id", "text")
    links = [(part, None if null else first, firsts[n - 1][0]) for n, (part, null, first) in enumerate(firsts)]
    table = F.broadcast(spark.createDataFrame(links, f"part int, first_id {given.schema['id'].dataType.simpleString()},"
                                                     " before int"))
    here = F.struct(F.col("part").alias("part"), F.lit(False).alias("after"))
    there = F.struct(F.col("before").alias("part"), F.lit(True).alias("after"))
    both = F.when(F.col("id").eqNullSafe(F.col("first_id")), F.array(here, there)).otherwise(F.array(here))
    return (keyed.join(table, "part").select(F.explode(both).alias("to"), "id", "text")
            .select("to.part", "to.after", "id", "text")
            .repartitionById(count, F.col("part")).sortWithinPartitions("part", "after", "id", "text"))


def edited(text: str, following: str) -> str:
    """The last quarter replaced by the first as many code points of the following text."""
    quarter = len(text) // 4
    return text[:len(text) - quarter] + following[:quarter]


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    rows = with_next(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, texts, marks = None, [], [], np.zeros((0, SLOTS), np.uint16)
        for batch in batches_by_bytes(batches, "text", BATCH_BYTES):
            parts = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            all_ids, all_texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            all_marks = sketches(all_texts)
            for low, high in zip(cuts, cuts[1:]):
                if parts[low] != part:  # the row held back is the next range's first document
                    part, ids, texts, marks = parts[low], [], [], marks[:0]
                ids, texts = ids[-1:] + all_ids[low:high], texts[-1:] + all_texts[low:high]
                marks = np.concatenate([marks[-1:], all_marks[low:high]])
                after = batch.column("after").slice(low, high - low).to_pylist()
                whole = len(texts) - 1 - max(0, sum(after) - 1)  # of rows marked ``after`` the first is used
                if whole > 0:
                    yield compared(ids, texts, marks, whole)
                if after[-1]:
                    part = None

    def compared(ids, texts, marks, count):
        changed = [edited(texts[k], texts[k + 1]) for k in range(count)]
        others = sketches(changed)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[:count], arrow_id), pa.array([len(t) for t in texts[:count]], pa.int64()),
             pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
             pa.array(digits(marks[:count])), pa.array(digits(others)),
             pa.array(likeness(marks[:count], others)), pa.array(likeness(marks[:count], marks[1:count + 1]))],
            names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_id = to_arrow_type(rows.schema["id"].dataType)
    schema = StructType([StructField("id", rows.schema["id"].dataType), StructField("n_chars", LongType()),
                         StructField("edited_sha256", StringType()), StructField("fingerprint", StringType()),
                         StructField("edited_fingerprint", StringType()), StructField("near_edited", DoubleType()),
                         StructField("near_next", DoubleType())])
    return rows.mapInArrow(run, schema)
