"""Suffix-array dedup by bucket-pointer refinement.

Removes every byte covered by a ``length``-byte string that also starts anywhere else
in the corpus, the same document included.  Strings are judged on the input.

Suffixes start in q-gram buckets and are refined by the bucket identifiers found at
later offsets, until buckets agree in ``length`` bytes:

1. Each window of ``length`` bytes falls into the bucket of its anchor's gram
   (``anchors``), chosen by the window's bytes alone; neighbouring windows with one
   anchor are one row.  A bucket with a single row holds no repeat.  In a bucket whose
   rows agree in all their bytes every window is repeated.
2. The buckets left over, a few per cent of the rows, are refined exactly.  One copy of
   each different row's bytes meets the rest of its bucket in one task, where
   ``repeated`` sorts all positions by 8-byte grams and then refines the buckets with
   two or more members by the pointers 8, 16, 32 ... bytes on, using the pointers just
   updated for the next round.
3. A bucket with more than ``WHOLE_BUCKET`` different rows is not taken whole: its
   windows are told apart by 128 bits of hash and counted.

Only rows of fixed size and the bytes of step 2 are shuffled by bucket; counts are
summed before they move, so a passage that a third of all documents share is no heavy
task.  Texts are shuffled twice, to take the bytes of step 2 and to cut the result.

Defined results: a null text has no bytes; a text shorter than ``length`` keeps all; a
row given twice repeats itself, so both lose all they can; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from casefile.llm.anchors import Sums, segments
from casefile.llm.common import batches_by_bytes, broadcast_if_few, materialize, partitions

#: Bytes of the gram that anchors a window.
GRAM = 32
#: Different rows of one bucket that are refined in one task.
WHOLE_BUCKET = 20_000
#: Bytes of text, or of rows to refine, that numpy works on at once.
WORK_BYTES = 1 << 18
REFINE_BYTES = 1 << 19
_NO_ID = -(1 << 63)

_SEGMENT = "id long, mark binary, lo long, hi long, at long, gram long, whole long"


def _keyed(docs: DataFrame, id_col: str, text_col: str, carry: Sequence[str]) -> DataFrame:
    """(id, text, carried, mark): rows that share an id are told apart by 128 bits of hash of their text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    carried = F.struct(*carry) if carry else F.lit(None).cast("struct<none: int>")
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), text.alias("text"),
                       carried.alias("carried")).withColumn("mark", F.unhex(F.md5(F.col("text").cast("binary"))))


def _segments(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, "text", WORK_BYTES):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            stops = np.cumsum([len(t) for t in texts])
            text, lo, hi, at, gram, whole = segments(np.frombuffer(b"".join(texts), np.uint8), stops, length, GRAM)
            base = np.concatenate([[0], stops])[text]
            rows = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(rows), batch.column("mark").take(rows), pa.array(lo - base),
                 pa.array(hi - base), pa.array(at - base), pa.array(gram.view(np.int64)),
                 pa.array(whole.view(np.int64))], names=["id", "mark", "lo", "hi", "at", "gram", "whole"])

    return docs.select("id", "mark", "text").mapInArrow(run, _SEGMENT)


def repeated(data: np.ndarray, stops: np.ndarray, length: int) -> np.ndarray:
    """For texts laid one after the other: which positions start ``length`` bytes that start elsewhere, too.

    Bucket-pointer refinement: a pointer is the first rank of a position's bucket, so
    splitting a bucket leaves all others' pointers valid.  ``length`` is at least 8.
    """
    size = len(data)
    ends = np.repeat(stops, np.diff(stops, prepend=0))
    place = np.arange(size)
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(size, np.uint64)
    for k in range(8):
        key |= wide[k:k + size].astype(np.uint64) << np.uint64(8 * k)
    # positions whose text ends before the bytes compared are buckets of their own
    inner = place + 8 <= ends
    order = place[inner][np.argsort(key[inner], kind="stable")]
    same = np.zeros(size, bool)
    same[1:len(order)] = key[order][1:] == key[order][:-1]
    order = np.concatenate([order, place[~inner]])
    pointer = np.empty(size, np.int64)
    heads = np.flatnonzero(~same)
    pointer[order] = np.repeat(heads, np.diff(heads, append=size))
    depth = 8
    active = place[place + length <= ends]
    members = np.bincount(pointer, minlength=size)
    while depth < length:
        step = min(depth, length - depth)
        # only buckets with two or more members are refined; all their members are
        live = place[(members[pointer] > 1) & (place + depth + step <= ends)]
        late = place[(members[pointer] > 1) & (place + depth + step > ends)]
        both = np.concatenate([live, late])
        onward = np.concatenate([pointer[live + step], size + late])  # too near the end: unlike all others
        packed = np.lexsort((onward, pointer[both]))
        both, onward, old = both[packed], onward[packed], pointer[both][packed]
        new_bucket = np.ones(len(both), bool)
        new_bucket[1:] = (old[1:] != old[:-1]) | (onward[1:] != onward[:-1])
        old_head = np.ones(len(both), bool)
        old_head[1:] = old[1:] != old[:-1]
        rank = np.arange(len(both))
        inside = rank - np.repeat(rank[old_head], np.diff(rank[old_head], append=len(both)))
        firsts = np.flatnonzero(new_bucket)
        pointer[both] = np.repeat(old[firsts] + inside[firsts], np.diff(firsts, append=len(both)))
        members = np.bincount(pointer, minlength=size)
        depth += step
    found = np.zeros(size, bool)
    found[active] = members[pointer[active]] > 1
    return found


def _refine(rows: DataFrame, length: int) -> DataFrame:
    """(gram, whole, many, data) -> (gram, whole, runs): runs of repeated windows of rows that are not repeated whole."""
    spark = rows.sparkSession
    dealt = rows.repartition(partitions(spark), "gram").sortWithinPartitions("gram")

    def solve(gram: list, whole: list, many: list, data: list[bytes]) -> pa.RecordBatch:
        stops = np.cumsum([len(d) for d in data])
        found = repeated(np.frombuffer(b"".join(data), np.uint8), stops, length)
        names, runs = [], []
        for *name, repeats, stop, size in zip(gram, whole, many, stops.tolist(), np.diff(stops, prepend=0).tolist()):
            if repeats:
                continue
            turns = np.diff(found[stop - size:stop].astype(np.int8), prepend=0, append=0)
            if turns.any():
                names.append(name)
                runs.append([{"from": int(a), "to": int(b) - 1} for a, b in
                             zip(np.flatnonzero(turns == 1), np.flatnonzero(turns == -1))])
        return pa.RecordBatch.from_arrays([*(pa.array([n[k] for n in names], pa.int64()) for k in (0, 1)),
                                           pa.array(runs, kind)], names=["gram", "whole", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, weight = None, ([], [], [], []), 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "whole", "many", "data"))):
                if row[0] != last and weight >= REFINE_BYTES:  # whole buckets only
                    yield solve(*held)
                    held, weight = ([], [], [], []), 0
                last = row[0]
                for column, value in zip(held, row):
                    column.append(value)
                weight += len(row[3])
        if weight:
            yield solve(*held)

    kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
    return dealt.mapInArrow(run, "gram long, whole long, runs array<struct<from: long, to: long>>")


def _taken(docs: DataFrame, picked: DataFrame, length: int) -> DataFrame:
    """The bytes of the picked rows, from their documents: (gram, whole, many, data, at, code).

    Rows of a very large bucket give a row for each window instead: its number ``at`` and ``code``, 128 bits
    of hash, without the bytes.
    """
    lists = picked.groupBy("id", "mark").agg(F.collect_list(
        F.struct("lo", "hi", "gram", "whole", "many", "hot")).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, "text", WORK_BYTES):
            out = []
            for text, rows in zip(batch.column("text").cast(pa.binary()).to_pylist(),
                                  batch.column("rows").to_pylist()):
                hot = [r for r in rows if r["hot"]]
                if hot:
                    data = np.frombuffer(text, np.uint8)
                    sums = Sums(data, 0), Sums(data, 1)
                for r in rows:
                    row = {"gram": r["gram"], "whole": r["whole"], "many": r["many"]}
                    if not r["hot"]:
                        out.append(row | {"data": text[r["lo"]:r["hi"] + length]})
                        continue
                    begins = np.arange(r["lo"], r["hi"] + 1)
                    code = np.stack([s.hashes(begins, begins + length) for s in sums], 1)
                    out += [row | {"at": k, "code": c.tobytes()} for k, c in enumerate(code)]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    arrow = pa.schema([("gram", pa.int64()), ("whole", pa.int64()), ("many", pa.bool_()), ("data", pa.binary()),
                       ("at", pa.int64()), ("code", pa.binary())])
    return docs.select("id", "mark", "text").join(lists, ["id", "mark"]).select("text", "rows").mapInArrow(
        run, "gram long, whole long, many boolean, data binary, at long, code binary")


def repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """(id, mark, text) -> (id, mark, lo, hi): runs of windows that start elsewhere, too."""
    rows = _segments(docs, length)
    buckets = rows.groupBy("gram").agg(F.count("*").alias("n"), F.min("whole").alias("a"), F.max("whole").alias("b"))
    shared = materialize(buckets.where("n > 1").select("gram", (F.col("a") != F.col("b")).alias("open")), "buckets")
    members = materialize(rows.join(shared, "gram"), "members")
    alike = members.where("not open").select("id", "mark", "lo", "hi")

    open_rows = members.where("open")
    kinds = open_rows.groupBy("gram", "whole").agg(F.count("*").alias("n"),
                                                   F.min(F.struct("id", "mark", "lo", "hi")).alias("one"))
    kinds = materialize(kinds.select("gram", "whole", (F.col("n") > 1).alias("many"), "one.*"), "kinds")
    large = materialize(kinds.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > WHOLE_BUCKET)
                        .select("gram", F.lit(True).alias("hot")), "large")
    picked = kinds.join(broadcast_if_few(large), "gram", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    taken = materialize(_taken(docs, picked, length), "taken")
    runs = _refine(taken.where("data is not null").select("gram", "whole", "many", "data"), length) \
        .select("gram", "whole", F.explode("runs").alias("run")).select("gram", "whole", "run.from", "run.to")
    if large.head(1):
        windows = taken.where("data is null")
        again = windows.groupBy("code").agg(F.count("*").alias("n"), F.max("many").alias("any")).where("n > 1 or any")
        hits = windows.where("not many").join(again.select("code"), "code")
        # neighbouring windows of a row (a few hundred at most) become one run again
        island = F.col("at") - F.row_number().over(Window.partitionBy("gram", "whole").orderBy("at"))
        runs = runs.unionByName(hits.withColumn("island", island).groupBy("gram", "whole", "island")
                                .agg(F.min("at").alias("from"), F.max("at").alias("to")).drop("island"))
    runs = materialize(runs, "runs")
    every = open_rows.join(kinds.where("many").select("gram", "whole"), ["gram", "whole"], "left_semi").select("id", "mark", "lo", "hi")
    some = open_rows.join(runs, ["gram", "whole"]).select("id", "mark", (F.col("lo") + F.col("from")).alias("lo"),
                                                (F.col("lo") + F.col("to")).alias("hi"))
    return alike.unionByName(every).unionByName(some)


def spans(lo: np.ndarray, hi: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Runs of windows -> maximal runs of bytes they cover."""
    order = np.argsort(lo, kind="stable")
    out: list[list[int]] = []
    for a, b in zip(lo[order].tolist(), hi[order].tolist()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + length)
        else:
            out.append([a, b + length])
    return [(a, b) for a, b in out]


def cut(text: bytes, removed: list[tuple[int, int]], whole_characters: bool) -> bytes:
    """The bytes outside the spans; with ``whole_characters`` a character goes only if all its bytes do."""
    kept, at = [], 0
    for a, b in removed:
        if whole_characters:
            while a < b and text[a] & 0xC0 == 0x80:
                a += 1
            while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
                b -= 1
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def remove_repeats(docs: DataFrame, length: int = 200, whole_characters: bool = False, id_col: str = "doc_id",
                   text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Return (id, n_bytes, n_removed, spans, kept, carried) for every document.

    ``kept``: the remaining bytes; with ``whole_characters`` a character that is only partly repeated stays.
    ``carried``: a struct of the columns named in ``carry``.
    """
    keyed = _keyed(docs, id_col, text_col, carry)
    lists = repeats(keyed, length).groupBy("id", "mark").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, "text", WORK_BYTES):
            found, kept, size = [], [], []
            for text, runs in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("runs")):
                values = runs.values
                pairs = [] if values is None else spans(values.field("lo").to_numpy(), values.field("hi").to_numpy(),
                                                        length)
                found.append([{"start": a, "end": b} for a, b in pairs])
                kept.append(cut(text, pairs, whole_characters))
                size.append(len(text))
            removed = [sum(s["end"] - s["start"] for s in f) for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(found, kind), pa.array(kept, pa.binary()), batch.column("carried")], names=schema.names)

    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    span = StructType([StructField("start", LongType()), StructField("end", LongType())])
    schema = StructType([StructField("id", LongType()), StructField("n_bytes", LongType()),
                         StructField("n_removed", LongType()), StructField("spans", ArrayType(span)),
                         StructField("kept", BinaryType()), keyed.schema["carried"]])
    cut_up = keyed.join(lists, ["id", "mark"], "left").select("id", "text", "runs", "carried") \
        .mapInArrow(run, schema)
    return cut_up.withColumn("id", F.when(F.col("id") != _NO_ID, F.col("id")))
