"""SimHash near-dedup: tiled exact comparison of fingerprints.

``fingerprints`` gives every text 64 bits.  ``near_links`` compares fingerprints tile
against tile with exclusive-or and bit counts in numpy.  Tiles are in order of
population count, and a pair of tiles is skipped when the counts differ by more than
the radius, as such fingerprints cannot be near.

Which fingerprints share tiles at all is settled without loss beforehand: two that
differ in at most r bits agree in one of r + 1 blocks of bits, so each block value is a
group.  A large group is divided the same way by the bits that are left, and what
is still large is dealt out as pairs of tiles with near population counts.  No pair
within the radius is missed at any size, and no task holds more than ``TILE_GROUP``
rows of a group.

Defined results: a null, empty or wordless text has fingerprint zero and links like any
other; equal texts have equal fingerprints; an empty table gives an empty result; rows
with one id are separate rows; extra columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from casefile.llm.common import BATCH_BYTES, batches_by_bytes, broadcast_if_few, materialize, partitions
from casefile.llm.components import components

BITS = 64
SEED = 42
#: Fingerprints compared in one numpy operation: TILE x TILE.
TILE = 1024
#: Rows of a group that go to one task whole; larger groups are divided.
TILE_GROUP = 8192
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes, shingle_words: int) -> int:
    """Bit i is one if more than half of the shingles' XXH64 have it; 0 without words."""
    import xxhash

    words = text.translate(_LOWER).split()  # bytes.split parts at blank and tab to carriage return
    if not words:
        return 0
    joined = b" ".join(words)
    stops = np.cumsum([len(w) + 1 for w in words])
    wide = min(shingle_words, len(words))
    begins = np.concatenate([[0], stops])[:len(words) - wide + 1].tolist()
    ends = (stops[wide - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(begins), 1 << 15):
        part = zip(begins[at:at + (1 << 15)], ends[at:at + (1 << 15)])
        hashes = np.array([digest(joined[b:e], SEED) for b, e in part], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    set_bits = np.packbits(2 * counts > len(begins), bitorder="little")
    return int(set_bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 4, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Return (id, fp): the fingerprint as a signed long."""
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, "text", BATCH_BYTES):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            marks = np.array([fingerprint(t or b"", shingle_words) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], names=["id", "fp"])

    return given.mapInArrow(run, StructType([given.schema["id"], StructField("fp", LongType())]))


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among n things -> links of each to the least of its component (at most n - 1)."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[i], least[j])
        before = least.copy()
        np.minimum.at(least, i, low)
        np.minimum.at(least, j, low)
        least = least[least]
        if np.array_equal(before, least):
            other = np.flatnonzero(least != np.arange(n))
            return other, least[other]


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs among ``left``, or between ``left`` and ``right``, as links that connect what they connect."""
    same = right is None
    points = left if same else np.concatenate([left, right])
    ones = np.bitwise_count(points)

    def ordered(low: int, high: int) -> list[np.ndarray]:
        order = low + np.argsort(ones[low:high], kind="stable")
        return [order[k:k + TILE] for k in range(0, len(order), TILE)]

    a = ordered(0, len(left))
    b = a if same else ordered(len(left), len(points))
    found_i, found_j = [], []
    for x, rows in enumerate(a):
        for cols in b[x:] if same else b:
            if int(ones[cols[0]]) - int(ones[rows[-1]]) > radius:
                break  # later tiles have more ones still
            if int(ones[rows[0]]) - int(ones[cols[-1]]) > radius:
                continue
            near = np.bitwise_count(points[rows][:, None] ^ points[cols][None, :]) <= radius
            i, j = np.nonzero(near)
            i, j = rows[i], cols[j]
            keep = i != j
            i, j = i[keep], j[keep]
            if len(i) > 2 * TILE:
                members, ij = np.unique(np.concatenate([i, j]), return_inverse=True)
                i, j = (members[k] for k in _forest(ij[:len(i)], ij[len(i):], len(members)))
            found_i.append(i)
            found_j.append(j)
    i = np.concatenate([np.zeros(0, np.int64), *found_i])
    j = np.concatenate([np.zeros(0, np.int64), *found_j])
    if len(i) >= len(points):
        i, j = _forest(i, j, len(points))
    return points[i], points[j]


def _blocks(mask: int, count: int) -> list[int]:
    """Divide the set bits of ``mask`` into ``count`` masks of about equal size."""
    bits = [k for k in range(BITS) if mask >> k & 1]
    return [sum(1 << bits[k] for k in range(n * len(bits) // count, (n + 1) * len(bits) // count))
            for n in range(count)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _groups(points: DataFrame, radius: int) -> DataFrame:
    """(fp) -> (grp, side, fp): rows that must meet.  Within a group side 0 meets side 0, and 1 meets 2."""
    every = (1 << BITS) - 1
    first = _blocks(every, radius + 1)

    def key(mask: int, *path: int):
        return F.xxhash64(*[F.lit(p) for p in path], F.col("fp").bitwiseAND(F.lit(_signed(mask))))

    level1 = points.select("fp", F.posexplode(F.array(*[key(m, n) for n, m in enumerate(first)])).alias("block", "grp"))
    sizes = materialize(level1.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > TILE_GROUP), "large")
    if not sizes.head(1):
        return level1.select("grp", F.lit(0).alias("side"), "fp")
    large = broadcast_if_few(sizes.select("grp"))
    small = level1.join(large, "grp", "left_anti").select("grp", F.lit(0).alias("side"), "fp")
    # the bits outside the block hold all differences: divide them again
    deeper = []
    for n, mask in enumerate(first):
        rest = _blocks(every & ~mask, radius + 1)
        keys = F.array(*[F.xxhash64(F.col("grp"), key(m, n, k)) for k, m in enumerate(rest)])
        deeper.append(level1.join(large, "grp", "left_semi").where(F.col("block") == n)
                      .select("fp", F.explode(keys).alias("grp")))
    level2 = materialize(_union(deeper), "blocks").withColumn("ones", F.bit_count("fp"))
    # what is still large is dealt out by population count, in parts of half a group
    per_count = level2.groupBy("grp", "ones").agg(F.count("*").alias("n"))
    tiles = (per_count.groupBy("grp").agg(F.sum("n").alias("total"), F.collect_list(F.struct(
        "ones", F.ceil(F.col("n") / (TILE_GROUP // 2)).cast("int").alias("parts"))).alias("tiles"))
        .where(F.col("total") > TILE_GROUP))  # at most 65 population counts a group
    tiles = broadcast_if_few(materialize(tiles, "tiles"), 10_000)
    mid = level2.join(tiles.select("grp"), "grp", "left_anti").select("grp", F.lit(0).alias("side"), "fp")
    hot = level2.join(tiles, "grp")
    parts = F.filter("tiles", lambda t: t["ones"] == F.col("ones"))[0]["parts"]
    hot = hot.withColumn("part", F.pmod(F.xxhash64("fp", F.lit(1)), parts).cast("int"))
    others = F.explode(F.flatten(F.transform(
        F.filter("tiles", lambda t: F.abs(t["ones"] - F.col("ones")) <= radius),
        lambda t: F.transform(F.sequence(F.lit(0), t["parts"] - 1),
                              lambda p: F.struct(t["ones"].alias("ones"), p.alias("part"))))))
    mine = F.struct("ones", "part")
    dealt = hot.withColumn("other", others).withColumn("mine", mine)
    pair = F.xxhash64("grp", F.least("mine", "other"), F.greatest("mine", "other"))
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    return _union([small, mid, dealt.select(pair.alias("grp"), side.alias("side"), "fp")])


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def near_links(points: DataFrame, radius: int) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that connect exactly what pairs within the radius connect."""
    spark = points.sparkSession
    dealt = _groups(points, radius).repartition(partitions(spark), "grp").sortWithinPartitions("grp", "side")

    def links(groups: np.ndarray, sides: np.ndarray, fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        edges = np.flatnonzero(np.diff(groups)) + 1
        for low, high in itertools.pairwise([0, *edges.tolist(), len(groups)]):
            if high - low < 2:
                continue
            f, s = fps[low:high], sides[low:high]
            alone, left, right = f[s == 0], f[s == 1], f[s == 2]
            if len(alone) > 1:
                out.append(tile_links(alone, None, radius))
            if len(left) and len(right):
                out.append(tile_links(left, right, radius))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def batch_of(found):
            a = np.concatenate([np.zeros(0, np.uint64), *(x for x, _ in found)]).view(np.int64)
            b = np.concatenate([np.zeros(0, np.uint64), *(y for _, y in found)]).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))],
                                              names=["a", "b"])

        for batch in batches:
            columns = [batch.column(k).to_numpy() for k in range(3)]
            columns[2] = columns[2].view(np.uint64)
            last = int(np.flatnonzero(np.diff(columns[0]))[-1]) + 1 if columns[0][0] != columns[0][-1] else 0
            if last or (held and held[0][0][0] != columns[0][0]):  # a group ends in this batch
                held.append(tuple(c[:last] for c in columns))
                yield batch_of(links(*(np.concatenate(c) for c in zip(*held))))
                held = []
            held.append(tuple(c[last:] for c in columns))
        if held:
            yield batch_of(links(*(np.concatenate(c) for c in zip(*held))))

    return dealt.mapInArrow(run, "a long, b long")


def _classes(marks: DataFrame, radius: int) -> DataFrame:
    """(id, fp) -> (fp, first_id, root): per distinct fingerprint its smallest id and its component."""
    distinct = materialize(marks.groupBy("fp").agg(F.min("id").alias("first_id")), "simhash-distinct")
    roots = components(near_links(distinct.select("fp"), radius), "a", "b")
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))


def near_groups(docs: DataFrame, shingle_words: int = 4, radius: int = 4, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Return (id, fp, component_id): the smallest id reachable by links of at most ``radius`` bits."""
    marks = materialize(fingerprints(docs, shingle_words, id_col, text_col), "simhash")
    joined = _classes(marks, radius)
    named = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = joined.join(named, "root").select("fp", "component_id")
    return marks.join(classes, "fp").select("id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle_words: int = 4, radius: int = 4, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of each component the one with the smallest id.

    Of rows that share that id and fingerprint one stays.
    """
    marks = materialize(fingerprints(docs, shingle_words, id_col, text_col), "simhash")
    classes = _classes(marks, radius)
    # a null id is the smallest, as in the order of structs
    first = marks.groupBy("fp").agg(F.min(F.struct(F.col("id"), F.col("fp").alias("mark"))).alias("one"))
    stay = classes.select("fp", "root").join(first, "fp").groupBy("root").agg(F.min("one").alias("one"))
    stay = materialize(stay.select(F.col("one.id").alias("__stay_id"), F.col("one.mark").alias("__stay_fp")), "stay")
    if not marks.groupBy("id").count().where("count > 1").head(1):
        return docs.join(stay, F.col(id_col).eqNullSafe(F.col("__stay_id")), "left_semi")
    # ids are shared: rows are told apart by their fingerprint, too
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, text_col, BATCH_BYTES):
            texts = batch.column(text_col).cast(pa.binary()).to_pylist()
            found = np.array([fingerprint(t or b"", shingle_words) for t in texts], np.uint64).view(np.int64)
            yield batch.append_column("__fp", pa.array(found))

    marked = docs.mapInArrow(mark, StructType([*docs.schema.fields, StructField("__fp", LongType())]))
    kept = marked.join(stay, F.col(id_col).eqNullSafe(F.col("__stay_id")) & (F.col("__fp") == F.col("__stay_fp")),
                       "left_semi")
    one = Window.partitionBy(id_col, "__fp").orderBy(F.col(text_col))
    return kept.withColumn("__nth", F.row_number().over(one)).where("__nth = 1").drop("__nth", "__fp")


def hex_digits(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
