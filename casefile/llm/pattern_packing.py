"""Best-fit packing: pattern packing by non-negative least squares.

Documents become token pieces of at most ``capacity`` ids.  Only the histogram of piece
lengths (at most ``capacity`` numbers) reaches the driver.  There, patterns of two or
three lengths that fill a sequence exactly are enumerated, their repeat counts are
fitted to the histogram by non-negative least squares and rounded, and what is left
is packed by best fit over the histogram, a whole class of equal lengths at a time.
The plan says how often each pattern is used; its size depends on ``capacity`` only.

Every piece then finds its place by its rank among the pieces of its length.  Ranks
come from salted counts, so a length that a third of all pieces share spreads over
many tasks.

Defined results: a null or empty text is the end id alone; repeated rows are packed as
rows of their own; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from casefile.llm.common import batches_by_bytes, broadcast_if_few, materialize
from casefile.llm.tokens import TOKEN_BYTES, encoder, with_end

#: Three-length patterns tried for each shortest length.
TRIPLES_PER_LENGTH = 8
FIT_ROUNDS = 400
#: Pieces ranked in one group, about; a length with more is salted.
RANK_GROUP = 1000

Pattern = tuple[tuple[int, int], ...]  # runs: (length, how many)


def enumerate_patterns(lengths: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """Patterns of one to three of the given lengths that fill ``capacity`` exactly."""
    present = np.zeros(capacity + 1, bool)
    present[lengths] = True
    found = [(capacity,)] if present[capacity] else []
    for a in lengths.tolist():
        if 2 * a <= capacity and present[capacity - a]:
            found.append((capacity - a, a))
        if 3 * a <= capacity:
            b = np.arange(a, (capacity - a) // 2 + 1)
            b = b[present[b] & present[capacity - a - b]]
            if len(b) > TRIPLES_PER_LENGTH:
                b = b[np.linspace(0, len(b) - 1, TRIPLES_PER_LENGTH).astype(int)]
            found += [(capacity - a - x, x, a) for x in b.tolist()]
    return found


def fit_counts(patterns: list[tuple[int, ...]], histogram: np.ndarray) -> np.ndarray:
    """Non-negative least squares by multiplicative updates: x <- x * (A'h) / (A'Ax)."""
    row = np.array([length for p in patterns for length in p])
    col = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    up = np.bincount(col, histogram[row], len(patterns))
    x = up / np.maximum(1, np.bincount(col, minlength=len(patterns))) / 8 + 1e-9
    for _ in range(FIT_ROUNDS):
        made = np.bincount(row, x[col], len(histogram))
        x *= up / np.maximum(np.bincount(col, made[row], len(patterns)), 1e-12)
    return x


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit, longest first, over a histogram: equal lengths move together."""
    groups: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)
    room = np.zeros(capacity + 1, np.int64)  # open sequences by what is left in them

    def put(pattern: Pattern, count: int, space: int) -> None:
        if count:
            groups[space].append((pattern, count))
            room[space] += count

    for length in np.flatnonzero(left)[::-1].tolist():
        due = int(left[length])
        while due:
            fits = np.flatnonzero(room[length:])
            if len(fits):
                space = int(fits[0]) + length
                pattern, have = groups[space].pop()
                room[space] -= have
            else:
                space, pattern, have = capacity, (), due  # new sequences, as many as are needed
            each = space // length
            full = min(have, due // each)
            put((*pattern, (length, each)), full, space - each * length)
            due -= full * each
            if due and full < have:
                some = min(due, each)
                put((*pattern, (length, some)), 1, space - some * length)
                due -= some
                full += 1
            if pattern:
                put(pattern, have - full, space)
    return [(p, n) for members in groups.values() for p, n in members]


def plan_patterns(histogram: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """``histogram[length]`` pieces -> patterns with repeat counts that hold every piece once."""
    left = histogram.astype(np.int64).copy()
    plan: list[tuple[Pattern, int]] = []
    patterns = enumerate_patterns(np.flatnonzero(left), capacity)
    if patterns:
        fitted = fit_counts(patterns, left.astype(float))
        for k in np.argsort(-fitted, kind="stable").tolist():
            runs: dict[int, int] = {}
            for length in patterns[k]:
                runs[length] = runs.get(length, 0) + 1
            times = min(int(np.floor(fitted[k] + 0.5)), *(int(left[n]) // c for n, c in runs.items()), 1 << 62)
            if times > 0:
                for length, many in runs.items():
                    left[length] -= times * many
                plan.append((tuple(runs.items()), times))
    return plan + best_fit(left, capacity)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str = "doc_id",
                 text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Return (id, piece, start, length, ids_crc32[, ids]): the pieces of every document."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        for batch in batches_by_bytes(batches, "text", TOKEN_BYTES):
            ids, stops = with_end(*encode(batch.column(1).cast(pa.binary()).to_pylist()), end_id)
            begins = np.concatenate([[0], stops])[:-1]
            pieces = -(-(stops - begins) // capacity)
            rows = np.repeat(np.arange(len(stops)), pieces)
            number = np.arange(len(rows)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            at = begins[rows] + number * capacity
            to = np.minimum(at + capacity, stops[rows])
            parts = [ids[b:e] for b, e in zip(at.tolist(), to.tolist())]
            columns = [batch.column(0).take(pa.array(rows)), pa.array(number.astype(np.int32)),
                       pa.array(number * capacity), pa.array(to - at),
                       pa.array([zlib.crc32(p) for p in parts], pa.int64())]
            if with_ids:
                columns.append(pa.array([p.tobytes() for p in parts], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = StructType([StructField("id", given.schema["id"].dataType), StructField("piece", IntegerType()),
                         StructField("start", LongType()), StructField("length", LongType()),
                         StructField("ids_crc32", LongType())]
                        + ([StructField("ids", BinaryType())] if with_ids else []))
    names = schema.names
    return given.mapInArrow(cut, schema)


def _slots(spark, plan: list[tuple[Pattern, int]]) -> DataFrame:
    """Per length, into how many groups its pieces are salted, and its slots in rank order: (first rank, slots a
    sequence, first sequence, offset there)."""
    slots = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, times in plan:
        offset = 0
        for length, many in pattern:
            slots[length].append((used[length], many, sequence, offset))
            used[length] += times * many
            offset += length * many
        sequence += times
    return spark.createDataFrame(
        [(length, -(-used[length] // RANK_GROUP), places) for length, places in sorted(slots.items())],
        "length long, salts long, slots array<struct<first: long, many: long, sequence: long, offset: long>>")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id",
         text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Return (id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) for every piece."""
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, with_ids), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        histogram[length] = n
    slots = F.broadcast(_slots(spark, plan_patterns(histogram, capacity)))  # at most ``capacity`` rows

    salted = pieces.join(slots.select("length", "salts"), "length").withColumn(
        "salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.col("salts")))
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
              .withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n"))
    firsts = broadcast_if_few(materialize(firsts, "piece-ranks"))
    within = Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")
    ranked = (salted.withColumn("nth", F.row_number().over(within) - 1)
              .join(firsts, ["length", "salt"])
              .withColumn("rank", F.col("first") + F.col("nth")))
    place = F.filter("slots", lambda s: s["first"] <= F.col("rank"))
    put = (ranked.join(slots.drop("salts"), "length")
           .withColumn("slot", F.element_at(place, -1))
           .withColumn("turn", F.col("rank") - F.col("slot.first")))
    sequence = F.col("slot.sequence") + F.floor(F.col("turn") / F.col("slot.many")).cast("long")
    return put.select("id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"),
                      (F.col("slot.offset") + F.col("turn") % F.col("slot.many") * F.col("length")).alias("offset"),
                      *(["ids"] if with_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """Packed pieces with ids -> (sequence_id, n_tokens, ids): each sequence's pieces joined in order."""
    piece = F.struct("offset", "ids")
    return (packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"),
                                              F.array_sort(F.collect_list(piece)).alias("parts"))
            .select("sequence_id", "n_tokens",
                    F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids")))
