"""Token ids as wavelet matrices: one compressed file per shard.

A shard holds the documents of an id range.  Its token sequence is stored as bit
planes, most significant bit first; each plane is the bits of the sequence as ordered
by the planes above it (zeros first, both halves in order).  Counts of ones every 512
bits make rank a lookup.  The file gives back any token, how often a token occurs
before a place, and where it occurs, without decoding the rest: per plane a lookup
decompresses the rank directory and one or two chunks of words, and keeps them.

File: 8 bytes magic, the length of the head (unsigned 64-bit), then zstd frames.  The
head: tokens, levels, documents, length of the ids (unsigned 64-bit), ids as JSON,
document starts, zeros per plane, and where each later frame begins, counted from the
end of the head, and where the last ends.  Then per plane a frame with its rank
directory (32-bit) and frames of ``CHUNK`` packed words each (64-bit, lowest bit first).

Defined results: a null or empty text is the end id alone; documents are in ascending
id order (null first, equal ids by text); an empty table writes no file and gives an
empty result; extra columns are not read.  Files are named by id range and part and
moved into place whole, so a task that runs twice leaves the same files.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from casefile.llm.common import (batches_by_bytes, broadcast_if_few, id_bounds, materialize, new_folder,
                                 partitions, with_range_bucket)
from casefile.llm.tokens import TOKEN_BYTES, encoder, with_end

MAGIC = b"WMTOK02\n"
BLOCK = 512  # bits between two entries of the rank directory
CHUNK = 1 << 13  # words of a frame, a multiple of those of a block
#: Tokens after which a shard goes on in another file (a document is never split).
FILE_TOKENS = 1 << 22


def _pack(bits: np.ndarray) -> np.ndarray:
    packed = np.packbits(bits, bitorder="little")
    out = np.zeros(-(-len(bits) // BLOCK) * (BLOCK // 8), np.uint8)
    out[:len(packed)] = packed
    return out.view("<u8")


def _directory(words: np.ndarray) -> np.ndarray:
    """Ones before each block, and all of them at the end."""
    ones = np.bitwise_count(words).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
    return np.concatenate([np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)])


def build(tokens: np.ndarray, starts: np.ndarray, ids: list) -> bytes:
    """Tokens of a shard, where each document starts, and the documents' ids -> a file."""
    import zstandard

    levels = max(1, int(tokens.max()).bit_length()) if len(tokens) else 1
    rest = tokens.astype(np.uint16 if levels <= 16 else np.uint32)
    zeros, planes = [], []
    for level in range(levels - 1, -1, -1):
        mask = (rest & rest.dtype.type(1 << level)) != 0
        planes.append(_pack(mask))
        low = np.compress(~mask, rest)  # faster than a mask as index
        zeros.append(len(low))
        rest = np.concatenate([low, np.compress(mask, rest)])
    names = json.dumps(ids).encode()
    pack = zstandard.ZstdCompressor(level=1).compress
    frames = []
    for words in planes:
        frames.append(pack(_directory(words).astype("<u4").tobytes()))
        frames += [pack(words[at:at + CHUNK].tobytes()) for at in range(0, len(words), CHUNK)]
    places = np.cumsum([0, *map(len, frames)])
    head = pack(b"".join([np.array([len(tokens), levels, len(starts), len(names)], "<u8").tobytes(), names,
                          np.asarray(starts, "<u8").tobytes(), np.array(zeros, "<u8").tobytes(),
                          places.astype("<u8").tobytes()]))
    return b"".join([MAGIC, np.array([len(head)], "<u8").tobytes(), head, *frames])


class WaveletFile:
    """Reads a file made by ``build``."""

    def __init__(self, data: bytes):
        import zstandard

        if data[:len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        self._unpack = zstandard.ZstdDecompressor().decompress
        first = len(MAGIC) + 8
        self._data = memoryview(data)
        self._base = first + int(np.frombuffer(data, "<u8", 1, len(MAGIC))[0])
        body = self._unpack(self._data[first:self._base])
        self.n, self.levels, docs, names = np.frombuffer(body, "<u8", 4).astype(int).tolist()
        at = 32
        self.ids = json.loads(body[at:at + names])
        at += names
        self.starts = np.frombuffer(body, "<u8", docs, at).astype(np.int64)
        at += 8 * docs
        self.zeros = np.frombuffer(body, "<u8", self.levels, at).astype(np.int64)
        at += 8 * self.levels
        self.chunks = -(-(-(-self.n // BLOCK) * (BLOCK // 64)) // CHUNK)
        self._places = np.frombuffer(body, "<u8", self.levels * (1 + self.chunks) + 1, at).astype(np.int64)
        self._held: dict[int, np.ndarray] = {}

    def _frame(self, number: int, kind: str, keep: bool = True) -> np.ndarray:
        found = self._held.get(number)
        if found is None:
            begin, end = (self._places[number:number + 2] + self._base).tolist()
            found = np.frombuffer(self._unpack(self._data[begin:end]), kind)
            if keep:
                self._held[number] = found
        return found

    def _ranks(self, level: int) -> np.ndarray:
        """Rank directory of a plane."""
        return self._frame(level * (1 + self.chunks), "<u4")

    def _words(self, level: int, begin: int, end: int) -> np.ndarray:
        """Words of one block of a plane."""
        if begin == end:
            return np.zeros(0, "<u8")
        chunk = self._frame(level * (1 + self.chunks) + 1 + begin // CHUNK, "<u8")
        return chunk[begin % CHUNK:begin % CHUNK + end - begin]

    def _plane(self, level: int) -> np.ndarray:
        """All bits of a plane; its frames are not kept."""
        first = level * (1 + self.chunks) + 1
        words = [self._frame(first + k, "<u8", keep=False) for k in range(self.chunks)]
        packed = np.concatenate([np.zeros(0, "<u8"), *words]).view(np.uint8)
        return np.unpackbits(packed, count=self.n, bitorder="little").view(bool)

    def _rank1(self, level: int, at: int) -> int:
        """Ones before place ``at`` of a plane."""
        block, whole = at // BLOCK, at // 64
        out, first = int(self._ranks(level)[block]), block * BLOCK // 64
        words = self._words(level, first, -(-at // 64))
        out += int(np.bitwise_count(words[:whole - first]).sum())
        if at % 64:
            out += (int(words[whole - first]) & ((1 << (at % 64)) - 1)).bit_count()
        return out

    def _select(self, level: int, one: bool, nth: int) -> int:
        """Place of the ``nth`` (from 0) one or zero of a plane."""
        ranks = self._ranks(level).astype(np.int64)
        if not one:
            ranks = np.arange(len(ranks)) * BLOCK - ranks
        block = int(np.searchsorted(ranks, nth, side="right")) - 1
        words = self._words(level, block * BLOCK // 64, (block + 1) * BLOCK // 64)
        bits = np.unpackbits(words.view(np.uint8), bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == one)[nth - int(ranks[block])])

    def access(self, at: int) -> int:
        """The token at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        token = 0
        for level in range(self.levels):
            one = int(self._words(level, at // 64, at // 64 + 1)[0]) >> (at % 64) & 1
            ones = self._rank1(level, at)
            at = int(self.zeros[level]) + ones if one else at - ones
            token = token << 1 | one
        return token

    def _range(self, token: int, begin: int, end: int) -> tuple[int, int]:
        if token >> self.levels:
            return 0, 0
        for level in range(self.levels):
            b, e = self._rank1(level, begin), self._rank1(level, end)
            if token >> (self.levels - 1 - level) & 1:
                begin, end = int(self.zeros[level]) + b, int(self.zeros[level]) + e
            else:
                begin, end = begin - b, end - e
        return begin, end

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        """How often a token occurs in [begin, end)."""
        low, high = self._range(token, begin, self.n if end is None else end)
        return high - low

    def find(self, token: int, nth: int) -> int:
        """Place of the ``nth`` (from 0) occurrence of a token."""
        low, high = self._range(token, 0, self.n)
        if not 0 <= nth < high - low:
            raise IndexError(nth)
        at = low + nth
        for level in range(self.levels - 1, -1, -1):
            one = bool(token >> (self.levels - 1 - level) & 1)
            at = self._select(level, one, at - int(self.zeros[level]) if one else at)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.find(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All tokens: the planes are undone from the last one up."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        for level in range(self.levels - 1, -1, -1):
            mask = self._plane(level)
            zeros = int(self.zeros[level])
            back = np.empty(self.n, kind)
            back[np.flatnonzero(~mask)] = values[:zeros]
            back[np.flatnonzero(mask)] = values[zeros:] | kind(1 << (self.levels - 1 - level))
            values = back
        return values


def _file_system(folder: str):
    from pyarrow import fs

    uri = folder.replace("s3a://", "s3://", 1)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def _store(folder: str, name: str, data: bytes) -> str:
    """Write a file under another name and move it into place."""
    import uuid

    system, root = _file_system(folder)
    system.create_dir(root, recursive=True)
    draft = f"{root}/_{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        out.write(data)
    try:
        system.move(draft, f"{root}/{name}")
    except OSError:  # some stores do not move onto a file: a first attempt has left the same one
        from pyarrow import fs

        if system.get_file_info(f"{root}/{name}").type == fs.FileType.NotFound:
            raise
        system.delete_file(draft)
    return f"{folder}/{name}"


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, shards: int | None = None,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all documents into files in ``folder``; return (shard, part, path, n_docs, n_tokens), one row a file."""
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    count = shards or partitions(spark)
    keyed = with_range_bucket(given, "id", id_bounds(given, "id", count), "shard")
    dealt = keyed.repartitionById(count, F.col("shard")).sortWithinPartitions("shard", "id", "text")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        shard, part, total, held, ids, sizes = None, 0, 0, [], [], []

        def flush():
            tokens = np.concatenate(held)
            lengths = np.array(sizes, np.int64)
            path = _store(folder, f"shard-{shard:06d}-{part:04d}.wm",
                          build(tokens, np.cumsum(lengths) - lengths, ids))
            return pa.RecordBatch.from_pylist([{"shard": shard, "part": part, "path": path, "n_docs": len(ids),
                                                "n_tokens": len(tokens)}], schema=arrow)

        for batch in batches_by_bytes(batches, "text", TOKEN_BYTES):
            tokens, stops = with_end(*encode(batch.column("text").cast(pa.binary()).to_pylist()), end_id)
            keys = batch.column("shard").to_numpy()
            edges = np.flatnonzero(np.diff(keys)) + 1
            names = batch.column("id").to_pylist()
            for low, high in zip([0, *edges], [*edges, len(keys)]):  # rows of one shard
                if ids and (keys[low] != shard or total >= FILE_TOKENS):
                    yield flush()
                    part += 1
                    total, held, ids, sizes = 0, [], [], []
                if keys[low] != shard:
                    shard, part = int(keys[low]), 0
                first = int(stops[low - 1]) if low else 0
                held.append(tokens[first:stops[high - 1]])
                ids += names[low:high]
                sizes += np.diff(stops[low:high], prepend=first).tolist()
                total += int(stops[high - 1]) - first
        if ids:
            yield flush()

    schema = StructType([StructField("shard", IntegerType()), StructField("part", IntegerType()),
                         StructField("path", StringType()), StructField("n_docs", LongType()),
                         StructField("n_tokens", LongType())])
    arrow = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("path", pa.string()),
                       ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
    return dealt.mapInArrow(save, schema)


def read(spark, folder: str, files: DataFrame) -> DataFrame:
    """Read the files back: (id, start, n_tokens, ids_crc32) for every document.

    ``files`` is what ``write`` returned; it has a row for each file, and its running
    sum gives each file's first token.
    """
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                file = WaveletFile(content.as_py())
                tokens = file.decode().astype("<u4")
                ends = np.append(file.starts[1:], file.n)
                name = path.as_py().rsplit("/", 1)[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(file.ids)), pa.array(file.ids, pa.int64()), pa.array(file.starts),
                     pa.array(ends - file.starts),
                     pa.array([zlib.crc32(tokens[b:e]) for b, e in zip(file.starts, ends)], pa.int64())],
                    names=schema.names)

    schema = StructType([StructField("name", StringType()), StructField("id", LongType()),
                         StructField("local_start", LongType()), StructField("n_tokens", LongType()),
                         StructField("ids_crc32", LongType())])
    whole = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(folder)
    rows = whole.select("path", "content").mapInArrow(decode, schema)
    earlier = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select(F.element_at(F.split("path", "/"), -1).alias("name"),
                        F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("base"))
    return rows.join(broadcast_if_few(base), "name").select(
        "id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def save_and_read(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Write all documents to a fresh shared folder and read them back from the files."""
    spark = docs.sparkSession
    folder = new_folder(spark, "wavelet")
    files = materialize(write(docs, f"{folder}/files", tokenizer_path, end_id, id_col=id_col, text_col=text_col),
                        "wavelet-files")
    if not files.head(1):
        return spark.createDataFrame([], "id long, start long, n_tokens long, ids_crc32 long")
    return read(spark, f"{folder}/files", files)
