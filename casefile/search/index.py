"""Inverted keyword index as Parquet tables.

``write_index`` lays out two tables below a folder:

* ``documents``: (doc_no, id, n_terms), one row a file, numbers from 0;
* ``blocks``: (term, first_doc, last_doc, n_postings, n_terms, docs, counts, positions), in
  one folder for each ``bucket`` of the term's CRC-32.  A look-up lists its terms' buckets
  only, and within their files the row groups whose terms can match.

Contents move nowhere: a file's terms are one narrow row, written in the file's place.
Document numbers are places in these written rows: two passes of prefix sums over the parts.
The files that a task holds are then turned into chunks, one row for each of their terms, so
that what is shuffled grows with the bytes of the postings and not with their number.
Chunks are sorted by (bucket, term, document) over all tasks, so a frequent term is split over
as many tasks as its postings fill, and cut into blocks inside a task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from casefile.functions import strings
from casefile.operators.duplicates import materialize
from casefile.search import postings
from casefile.search.contents import broadcast_if_few, by_bytes

BUCKETS = 64
BLOCK = 128
#: Bytes of content whose terms are found at once: the arrays made of them take many times as much.
SCAN_BYTES = 1 << 20
#: Bytes of packed terms that a task turns into chunks at once: the more, the fewer chunks a term has.
TERMS_BYTES = 1 << 24
#: Bytes of a term that are compared as a number before the term itself is.
LEAD = 5

_FILE = "id string, n_terms long, names string, counts binary, positions binary"
_CHUNK = "part string, first_row long, n_postings long, term string, lead long, postings binary"
_BLOCK = ("bucket int, term string, first_doc long, last_doc long, n_postings long, n_terms long, docs binary, "
          "counts binary, positions binary")


def bucket_of(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


@dataclass(frozen=True)
class Index:
    """An index on shared storage.  Its tables' files are listed once."""

    spark: SparkSession
    path: str
    buckets: int

    @cached_property
    def _documents(self) -> DataFrame:
        return self.spark.read.schema("doc_no long, id string, n_terms long").parquet(f"{self.path}/documents")

    @cached_property
    def _blocks(self) -> DataFrame:
        return self.spark.read.schema(_BLOCK).parquet(f"{self.path}/blocks")

    def documents(self) -> DataFrame:
        return self._documents.select("*")

    def blocks(self, terms: Sequence[str] | None = None) -> DataFrame:
        """All blocks, or those of some terms: only these terms' buckets are listed and read."""
        every = self._blocks.select("*")
        if terms is None:
            return every
        wanted = sorted(set(terms))
        return every.where(F.col("bucket").isin(sorted({bucket_of(t, self.buckets) for t in wanted}))
                           & F.col("term").isin(wanted))


def file_terms(contents: DataFrame, least: int = strings.LEAST) -> DataFrame:
    """(id, n_terms, names, counts, positions): one row a file, also for a file without a term.

    ``names`` are its different terms between blanks, the other two their packed counts and positions.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "content", limit=SCAN_BYTES):
            file, code, position, words, n_terms = postings.coded_terms(
                [c or b"" for c in batch.column("content").to_pylist()], least)
            fresh = (np.diff(file, prepend=-1) != 0) | (np.diff(code, prepend=-1) != 0)
            begins = np.flatnonzero(fresh)
            cuts = np.searchsorted(file[begins], np.arange(batch.num_rows + 1))
            names = words.take(pa.array(code[begins]))
            coded = [postings.pack_numbers(np.diff(begins, append=len(file))),
                     postings.pack_numbers(postings.gaps(position, begins))]
            places = [cuts, np.append(begins, len(file))[cuts]]  # of postings, and of positions
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").cast(pa.string()), pa.array(n_terms.astype(np.int64)),
                 pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), names), " "),
                 *(postings.slices(raw, np.append(0, ends)[at]) for (raw, ends), at in zip(coded, places))],
                names=["id", "n_terms", "names", "counts", "positions"])

    return contents.select("id", "content").mapInArrow(run, _FILE)


def _term_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of (part, row, names, counts, positions) rows: each term's postings in consecutive files of one part."""
    for batch in by_bytes(batches, "names", "counts", "positions", limit=TERMS_BYTES):
        parts = batch.column("part").dictionary_encode().indices.to_numpy()
        begins = np.flatnonzero(np.diff(parts, prepend=-1))
        for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(parts)]):
            yield _chunks_of(batch.slice(begin, end - begin))


def _chunks_of(files: pa.RecordBatch) -> pa.RecordBatch:
    listed = pc.split_pattern(files.column("names"), " ")
    names = listed.flatten().dictionary_encode()
    code = names.indices.to_numpy()
    row = np.repeat(files.column("row").to_numpy(), pc.list_value_length(listed).to_numpy())
    counts = postings.unpack_numbers(postings.joined(files.column("counts"))[0])
    raw = postings.joined(files.column("positions"))[0]
    order = postings.grouped(code, len(names.dictionary))  # rows ascend, so each term's do
    begins = np.flatnonzero(np.diff(code[order], prepend=-1))
    placed = postings.slices(raw, postings.posting_cuts(raw, counts)).take(pa.array(order))
    coded = postings.encode(row[order], counts[order], *postings.joined(placed), begins)
    terms = names.dictionary.take(pa.array(code[order][begins]))
    return pa.RecordBatch.from_arrays(
        [pa.array([files.column("part")[0].as_py()] * len(begins), pa.string()), pa.array(row[order][begins]),
         pa.array(np.diff(begins, append=len(order))), terms, pa.array(postings.leads(terms, LEAD)),
         pc.binary_join_element_wise(*coded, pa.scalar(b"", pa.binary()))],
        names=["part", "first_row", "n_postings", "term", "lead", "postings"])


def _cut_blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Cut sorted chunks (bucket, term, first_doc, n_postings, postings) into blocks.

    A block may span chunks and record batches; of the last term, less than a block is held back.
    """
    held = None  # bucket, term, documents, counts, positions, and where each posting's positions end
    for batch in by_bytes(batches, "postings"):
        if not batch.num_rows:
            continue
        sizes = batch.column("n_postings").to_numpy()
        relative, counts, raw = postings.part_chunks(batch.column("postings"), sizes)
        docs = postings.sums(relative, sizes) + np.repeat(batch.column("first_doc").to_numpy(), sizes)
        cuts = postings.posting_cuts(raw, counts)
        buckets, terms = batch.column("bucket"), batch.column("term")
        if held is not None:
            buckets = pa.concat_arrays([held[0], buckets])
            terms = pa.concat_arrays([held[1], terms])
            sizes = np.append(len(held[2]), sizes)
            docs, counts = np.append(held[2], docs), np.append(held[3], counts)
            raw, cuts = np.append(held[4], raw), np.append(held[5], held[5][-1] + cuts[1:])
        code = np.repeat(terms.dictionary_encode().indices.to_numpy(), sizes)
        chunk = np.repeat(np.arange(len(sizes)), sizes)
        first = np.flatnonzero(np.diff(code, prepend=-1))
        size = np.diff(first, append=len(code))
        many = -(-size // block)
        begins = np.repeat(first, many) + block * (np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many))
        stop = len(code) if len(code) - begins[-1] == block else int(begins[-1])  # the last block may go on
        held = None
        if stop < len(code):
            of = int(chunk[stop])
            held = (buckets.slice(of, 1), terms.slice(of, 1), docs[stop:], counts[stop:], raw[cuts[stop]:],
                    cuts[stop:] - cuts[stop])
            begins = begins[:-1]
        if stop:
            yield _blocks(buckets, terms, chunk, docs[:stop], counts[:stop], raw, cuts[:stop + 1], begins)
    if held is not None:
        buckets, terms, docs, counts, raw, cuts = held
        yield _blocks(buckets, terms, np.zeros(len(docs), np.int64), docs, counts, raw, cuts, np.zeros(1, np.int64))


def _blocks(buckets, terms, chunk, docs, counts, raw, cuts, begins) -> pa.RecordBatch:
    ends = np.append(begins[1:], len(docs))
    of = pa.array(chunk[begins])
    return pa.RecordBatch.from_arrays(
        [buckets.take(of), terms.take(of), pa.array(docs[begins]), pa.array(docs[ends - 1]), pa.array(ends - begins),
         pa.array(np.add.reduceat(counts, begins)), *postings.encode(docs, counts, raw, cuts, begins)],
        names=["bucket", "term", "first_doc", "last_doc", "n_postings", "n_terms", "docs", "counts", "positions"])


def write_index(contents_by_file: DataFrame, path: str, buckets: int = BUCKETS, block: int = BLOCK) -> Index:
    """Write the index of ``file_terms`` rows below ``path`` (which must not exist)."""
    spark = contents_by_file.sparkSession
    contents_by_file.write.option("compression", "zstd").parquet(f"{path}/terms")
    files = spark.read.schema(_FILE).parquet(f"{path}/terms")
    place = [F.col("_metadata.file_name").alias("part"), F.col("_metadata.row_index").alias("row")]
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = files.select(place[0]).groupBy("part").agg(F.count("*").alias("n"))  # one row a written file
    bases = materialize(counts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")), "index-parts")
    bases = broadcast_if_few(bases)
    (files.select(*place, "id", "n_terms").join(bases, "part")
     .select((F.col("base") + F.col("row")).alias("doc_no"), "id", "n_terms").write.parquet(f"{path}/documents"))

    made = files.where("names <> ''").select(*place, "names", "counts", "positions").mapInArrow(_term_chunks, _CHUNK)
    made.write.option("compression", "zstd").parquet(f"{path}/chunks")  # the range partitioning reads them twice
    bucket = F.crc32(F.col("term").cast("binary")) % buckets
    chunks = spark.read.schema(_CHUNK).parquet(f"{path}/chunks").join(bases, "part").select(
        (F.shiftleft(bucket, 8 * LEAD) + F.col("lead")).alias("place"), "term",
        (F.col("base") + F.col("first_row")).alias("first_doc"), "n_postings", "postings")
    order = ["place", "term", "first_doc"]  # by bucket and term; one number settles most comparisons
    dealt = chunks.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    (dealt.sortWithinPartitions(*order)
     .select(F.shiftright("place", 8 * LEAD).cast("int").alias("bucket"), "term", "first_doc", "n_postings", "postings")
     .mapInArrow(lambda batches: _cut_blocks(batches, block), _BLOCK)
     .write.partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/blocks"))
    return Index(spark, path, buckets)


def decode(blocks: DataFrame, positions: bool = True) -> DataFrame:
    """(term, doc_no, count[, positions]) of every posting in blocks; without positions, these are not read."""
    def give(at: np.ndarray, many: np.ndarray) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)), pa.int32()), pa.array(at))]

    return _decoded(blocks, "positions array<long>", give) if positions else _decoded(blocks)


def summaries(blocks: DataFrame) -> DataFrame:
    """(term, doc_no, count, first_position, last_position, sum_positions) of every posting in blocks."""
    def give(at: np.ndarray, many: np.ndarray) -> list[pa.Array]:
        ends = np.cumsum(many)  # positions ascend
        return [pa.array(at[ends - many]), pa.array(at[ends - 1]), pa.array(np.add.reduceat(at, ends - many))]

    return _decoded(blocks, "first_position long, last_position long, sum_positions long", give)


def _decoded(blocks: DataFrame, more: str = "", give=None) -> DataFrame:
    """(term, doc_no, count) of every posting in blocks, and the columns ``more`` by ``give(positions, counts)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, *names[2:]):
            if not batch.num_rows:
                continue
            sizes = batch.column("n_postings").to_numpy()
            docs = postings.sums(postings.unpack_numbers(postings.joined(batch.column("docs"))[0]), sizes)
            many = postings.unpack_numbers(postings.joined(batch.column("counts"))[0])
            of = np.repeat(np.arange(len(sizes)), sizes)
            columns = [batch.column("term").take(pa.array(of)),
                       pa.array(docs + batch.column("first_doc").to_numpy()[of]), pa.array(many)]
            if give:
                at = postings.sums(postings.unpack_numbers(postings.joined(batch.column("positions"))[0]), many)
                columns += give(at, many)
            yield pa.RecordBatch.from_arrays(columns, names=schema)

    names = ["first_doc", "n_postings", "docs", "counts"] + (["positions"] if give else [])
    kinds = "term string, doc_no long, count long" + (f", {more}" if more else "")
    schema = [kind.split()[0] for kind in kinds.split(", ")]
    return blocks.select("term", *names).mapInArrow(run, kinds)
