"""Registered queries over the generated test tables.

Each query takes ``(spark, sf_dir)``, derives the evidence table and the
external store from the tables in ``sf_dir`` (``casefile.sources.testdata``),
and returns a DataFrame.  Directory queries run over the derived store
``(path, length, content)``, whose content is the tables' text.  Binary columns
are never returned; sizes and digests of the whole content stand in for them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from casefile.functions.columns import content_size
from casefile.functions.digest import digest
from casefile.functions.mediatype import with_content_type
from casefile.operators import annotate, browse, duplicates, hashing, mediatypes, reports, upsert
from casefile.search import contents, index, lookup, types
from casefile.session import new_folder
from casefile.sources import evidence as ev
from casefile.sources import files, testdata

ORACLE_BITS = 256  # digest width whose text DuckDB can also compute


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testdata.evidence_from_testdata(spark, sf_dir)


def _summaries(spark: SparkSession, sf_dir: str, bits: int = 512) -> DataFrame:
    # the derived external store carries its bytes as a column (no files to stream)
    return hashing.summarize_content(testdata.external_store(spark, sf_dir), bits)


def _hashed_evidence(spark: SparkSession, sf_dir: str, bits: int) -> DataFrame:
    evidence = _evidence(spark, sf_dir)
    hashes = hashing.file_hashes(evidence, _summaries(spark, sf_dir, bits), bits)
    return annotate.merge_annotations(evidence, file_hash=hashes)


def _members(spark: SparkSession, sf_dir: str, bits: int = 512) -> DataFrame:
    return duplicates.label_members(_hashed_paths(spark, sf_dir, bits))


def _hashed_paths(spark: SparkSession, sf_dir: str, bits: int) -> DataFrame:
    return hashing.hashed_paths(_evidence(spark, sf_dir), _summaries(spark, sf_dir, bits), bits)


def _typed_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = _evidence(spark, sf_dir)
    types = mediatypes.file_media_types(evidence, _summaries(spark, sf_dir))
    return annotate.merge_annotations(evidence, media_type=types)


# --- scans and predicates ---------------------------------------------------

def q_file_metadata(spark, sf_dir):
    """All rows with the metadata fields."""
    return ev.file_metadata(_evidence(spark, sf_dir))


def q_data_file_content(spark, sf_dir):
    """Data files with their inline content size (-1 when absent)."""
    return ev.data_file_content(_evidence(spark, sf_dir)).select(
        "id", "file_path", "external_path", content_size("file_content", missing=-1).alias("content_size"),
        digest("file_content", ORACLE_BITS).alias("content_sha256"))


def q_inline_content(spark, sf_dir):
    """Non-empty inline content (size and digest of the whole)."""
    return ev.inline_content(_evidence(spark, sf_dir)).select(
        "id", content_size("file_content").alias("content_size"),
        digest("file_content", ORACLE_BITS).alias("content_sha256"))


def q_inline_content_with_path(spark, sf_dir):
    """Inline content with its path."""
    return ev.inline_content_with_path(_evidence(spark, sf_dir)).select(
        "id", "file_path", content_size("file_content").alias("content_size"),
        digest("file_content", ORACLE_BITS).alias("content_sha256"))


def q_external_paths(spark, sf_dir):
    """Where external content lives."""
    return ev.external_paths(_evidence(spark, sf_dir))


def q_external_original_paths(spark, sf_dir):
    """Original paths of externally stored files."""
    return ev.external_original_paths(_evidence(spark, sf_dir))


def q_external_data_files(spark, sf_dir):
    """Data files stored externally."""
    return ev.external_data_files(_evidence(spark, sf_dir)).select("id", "file_path", "external_path")


def q_content_sizes(spark, sf_dir):
    """Inline content sizes."""
    return ev.content_sizes(_evidence(spark, sf_dir))


def q_metadata_preview(spark, sf_dir):
    """O3: first ten metadata rows by id."""
    return ev.metadata_preview(_evidence(spark, sf_dir))


def q_content_messages(spark, sf_dir):
    """P10: formatted line per external data file."""
    return ev.content_messages(_evidence(spark, sf_dir))


def q_evidence_counts(spark, sf_dir):
    """A4: row counts."""
    return ev.evidence_counts(_evidence(spark, sf_dir))


# --- hashing ----------------------------------------------------------------

def q_file_hashes(spark, sf_dir):
    """SHA-512 of every inline and external file; the digest itself, which DuckDB lacks, is
    shown as the smallest id and the number of files that have it."""
    evidence = _evidence(spark, sf_dir)
    hashes = duplicates.materialize(hashing.file_hashes(evidence, _summaries(spark, sf_dir, 512), 512), "hashes")
    groups = duplicates.materialize(duplicates.hash_counts(hashes, label="id"), "groups")
    return duplicates.attach_group_stats(hashes, groups, "file_hash").select(
        "id", F.col("first_file").alias("first_id"), "n")


def q_file_hashes_sha256(spark, sf_dir):
    """T1 with SHA-256 (oracle-checkable twin)."""
    evidence = _evidence(spark, sf_dir)
    return hashing.file_hashes(evidence, _summaries(spark, sf_dir, ORACLE_BITS), ORACLE_BITS)


def q_hash_and_path(spark, sf_dir):
    """S9 over the evidence merged with fresh hashes."""
    return _hashed_paths(spark, sf_dir, ORACLE_BITS)


def q_merged_hashes(spark, sf_dir):
    """Merged view with hashes."""
    return _hashed_evidence(spark, sf_dir, ORACLE_BITS).select("id", "file_path", "file_type", "file_hash")


def q_external_summaries_sha256(spark, sf_dir):
    """one read of each external file gives its digest and its content verdict."""
    return _summaries(spark, sf_dir, ORACLE_BITS)


def q_external_id_collisions(spark, sf_dir):
    """External file names listed more than once."""
    return hashing.external_id_collisions(testdata.external_store(spark, sf_dir))


# --- duplicates (SHA-512; digest column left out so DuckDB can check) ---------

def q_hash_counts(spark, sf_dir):
    """A1: files per digest (digest itself left out for the oracle)."""
    return duplicates.hash_counts(_members(spark, sf_dir), label="label").select("first_file", "n")


def q_duplicate_files(spark, sf_dir):
    """Files of duplicate groups; ``first_file`` names the group."""
    return duplicates.duplicate_files(_members(spark, sf_dir)).select("n", "first_file", "label")


def q_duplicate_members(spark, sf_dir):
    """Duplicate groups with ids and paths (one row per file)."""
    return duplicates.duplicate_members(_members(spark, sf_dir)).select("n", "id", "file_path", "label")


def q_duplicate_preview(spark, sf_dir):
    """O2: the files of the 20 largest duplicate groups."""
    return duplicates.duplicate_preview(_members(spark, sf_dir)).select("n", "first_file", "label")


def q_duplicate_report(spark, sf_dir):
    """Duplicate report lines (SHA-512, with the digest left out for the oracle)."""
    lines = reports.duplicate_report(_members(spark, sf_dir, 512), bits=512)
    return lines.select("first_file", "line", F.replace("value", "file_hash", F.lit("")).alias("value"))


def q_duplicate_report_sha256(spark, sf_dir):
    """W3 with SHA-256 (oracle-checkable twin)."""
    lines = reports.duplicate_report(_members(spark, sf_dir, ORACLE_BITS), bits=ORACLE_BITS)
    return lines.select("file_hash", "line", "value")


# --- media types --------------------------------------------------------------

def q_file_media_types(spark, sf_dir):
    """Media type of every inline and external file."""
    evidence = _evidence(spark, sf_dir)
    return mediatypes.file_media_types(evidence, _summaries(spark, sf_dir))


def _media_type_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S10 over the evidence merged with fresh media types (no full evidence join)."""
    evidence = _evidence(spark, sf_dir)
    types = mediatypes.file_media_types(evidence, _summaries(spark, sf_dir))
    return annotate.merged_values(evidence, "media_type", types)


def q_media_types(spark, sf_dir):
    """S10 over the evidence merged with fresh media types."""
    return _media_type_values(spark, sf_dir)


def q_media_type_counts(spark, sf_dir):
    """T4, A3, O1: media-type histogram."""
    return mediatypes.media_type_counts(_media_type_values(spark, sf_dir))


def q_inline_media_type_mismatch(spark, sf_dir):
    """Inline files whose type changes with the name."""
    return mediatypes.inline_media_type_mismatch(_evidence(spark, sf_dir))


def q_inline_content_types(spark, sf_dir):
    """Content-only verdict of every inline file (no file name)."""
    rows = ev.inline_content(_evidence(spark, sf_dir))
    return with_content_type(rows, "file_content").select("id", "content_type")


def q_external_media_types(spark, sf_dir):
    """External files typed by content, refined by the original name."""
    return mediatypes.external_media_types(_evidence(spark, sf_dir), _summaries(spark, sf_dir))


def q_external_media_type_mismatch(spark, sf_dir):
    """External files whose type changes with the name."""
    return mediatypes.external_media_type_mismatch(_evidence(spark, sf_dir), _summaries(spark, sf_dir))


def q_merged_media_types(spark, sf_dir):
    """Merged view with media types."""
    return _typed_evidence(spark, sf_dir).select("id", "file_path", "media_type")


# --- directories of opaque files (the derived store, listed by path) ------------

def q_external_content(spark, sf_dir):
    """External store keyed by file name."""
    return files.keyed_by_name(testdata.external_store(spark, sf_dir)).select("id", "path", "length")


def q_directory_files(spark, sf_dir):
    """Raw directory listing, all levels."""
    return testdata.directory_store(spark, sf_dir).select("path", "length")


def q_directory_hashes_sha256(spark, sf_dir):
    """T6 input: digest and verdict of every file of a raw directory."""
    return hashing.summarize_content(testdata.directory_store(spark, sf_dir), ORACLE_BITS)


def q_directory_duplicates_sha256(spark, sf_dir):
    """T6, T8, B1 fixed: duplicate report lines of a raw directory, labelled by path."""
    summaries = hashing.summarize_content(testdata.directory_store(spark, sf_dir), ORACLE_BITS)
    members = summaries.select("file_hash", F.col("path").alias("label"))
    return reports.duplicate_report(members, bits=ORACLE_BITS).select("file_hash", "line", "value")


def q_whole_directory_files(spark, sf_dir):
    """Raw directory listing with all events and zero-length files."""
    return testdata.directory_store(spark, sf_dir).select("path", "length")


def q_whole_directory_hashes_sha256(spark, sf_dir):
    """T6 input, B10: digest and verdict of every file, events and zero-length files included."""
    return hashing.summarize_content(testdata.directory_store(spark, sf_dir), ORACLE_BITS)


def q_whole_directory_duplicates_sha256(spark, sf_dir):
    """Duplicate report lines with the hot digests of the events and of the zero-length files."""
    summaries = hashing.summarize_content(testdata.directory_store(spark, sf_dir), ORACLE_BITS)
    members = summaries.select("file_hash", F.col("path").alias("label"))
    return reports.duplicate_report(members, bits=ORACLE_BITS).select("file_hash", "line", "value")


# --- strings and keyword search -----------------------------------------------------

SEARCHES = ["the of and", "en on", "from was by", "der und", "les de la", "secret wide text", "the nosuchword"]
PHRASES = ["of the", "the of", "in the on", "de la", "a secret", "secret wide text", "the the", "nosuchword the"]
RANKED = ["the", "of and", "en in on", "der die und", "les de la", "secret wide text", "tion from", "is are be was",
          "nosuchword", "the nosuchword k"]


def _index(spark: SparkSession, sf_dir: str) -> index.Index:
    """The keyword index over all files, written anew."""
    terms = contents.from_sources(_evidence(spark, sf_dir), testdata.external_store(spark, sf_dir),
                                  index.file_terms)
    return index.write_index(terms, new_folder(spark, "keyword-index"))


def _each(texts: list[str], search) -> DataFrame:
    """The results of several searches, with the number of each."""
    found = [search(text).withColumn("query", F.lit(n)) for n, text in enumerate(texts)]
    return reduce(DataFrame.unionByName, found)


def q_content_strings(spark, sf_dir):
    """Strings (ASCII and UTF-16LE) of every inline and external file, with byte offsets."""
    return contents.content_strings(_evidence(spark, sf_dir), testdata.external_store(spark, sf_dir))


def q_keyword_index(spark, sf_dir):
    """The stored posting blocks, decoded: each term's files, counts and positions."""
    made = _index(spark, sf_dir)
    rows = index.summaries(made.blocks()).withColumnRenamed("count", "n")  # numbers, not arrays, meet the documents
    return rows.join(made.documents().select("doc_no", "id"), "doc_no").drop("doc_no")


def q_keyword_search(spark, sf_dir):
    """Files that hold all words, for each search."""
    made = _index(spark, sf_dir)
    return _each(SEARCHES, lambda text: lookup.search_all(made, text))


def q_phrase_search(spark, sf_dir):
    """Files that hold a phrase within one string, for each search."""
    made = _index(spark, sf_dir)
    return _each(PHRASES, lambda text: lookup.search_phrase(made, text))


def q_ranked_search(spark, sf_dir):
    """The ten best files of each of ten searches, by BM25."""
    return lookup.search_ranked(_index(spark, sf_dir), RANKED, 10)


# --- media-type search, duplicate pages, repeated upsert -------------------------------

TYPE_SEARCHES = ["text/*", "application/xml", "archive", "image/*", "application/ogg", "program", "text/html",
                 "application/x-nosuch"]
PAGE_SIZE = 20
PAGE = 3


def q_media_type_search(spark, sf_dir):
    """Files by media type, specialisations included, from a table clustered by type."""
    evidence = _evidence(spark, sf_dir)
    found = mediatypes.file_media_types(evidence, _summaries(spark, sf_dir))
    path = new_folder(spark, "typed-files")
    types.write_typed(found.select("id", "media_type"), path)
    return types.search_types(types.read_typed(spark, path, "id string, media_type string, type_no int"), TYPE_SEARCHES)


def _groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    members = duplicates.materialize(_members(spark, sf_dir, ORACLE_BITS))
    return members, duplicates.materialize(duplicates.duplicate_groups(members), "groups")


def q_duplicate_pages(spark, sf_dir):
    """All pages of duplicate groups, largest groups first."""
    return browse.numbered_groups(_groups(spark, sf_dir)[1], PAGE_SIZE).select(
        "page", "place", "n", "file_hash", "first_file")


def q_duplicate_page(spark, sf_dir):
    """One page of duplicate groups, with their files."""
    members, groups = _groups(spark, sf_dir)
    page = browse.page_of_groups(groups, PAGE, PAGE_SIZE)
    return browse.page_members(members.select("file_hash", "label"), page).select(
        "page", "place", "n", "file_hash", "first_file", "label")


def q_upserted_media_types(spark, sf_dir):
    """W2, three batches one after the other: types by content, types of inline files by name, external files."""
    evidence, summaries = _evidence(spark, sf_dir), _summaries(spark, sf_dir)
    path = new_folder(spark, "media-types")
    upsert.create(spark, path, "media_type")
    by_content = with_content_type(ev.inline_content(evidence), "file_content", "media_type")
    upsert.upsert(by_content.select("id", "media_type"), path, "media_type", buckets=16)
    upsert.upsert(mediatypes.inline_media_types(evidence), path, "media_type", buckets=16)
    upsert.upsert(mediatypes.external_media_types(evidence, summaries), path, "media_type", buckets=16)
    return upsert.read(spark, path, "media_type")


def q_attribute_report(spark, sf_dir):
    """The attribute report of every evidence row, as numbered lines."""
    return reports.evidence_report(_evidence(spark, sf_dir)).select("id", "line", "value")


QUERIES = {name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_")}
