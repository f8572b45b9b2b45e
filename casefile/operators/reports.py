"""Human-readable text reports.

The duplicate report is a table of lines: one header per group, one line per
file, one blank line.  It is range-partitioned and sorted by (digest, line,
label) before Spark's text writer puts out one part file per partition, so a
group of any size has one header and spreads over as many tasks as it needs.
The original tool forced a single output file through one task; here a reader
concatenates the part files in order.  The attribute report has one record of
several lines per file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from casefile.functions.columns import parse_file_size
from casefile.functions.digest import DEFAULT_BITS, report_label
from casefile.operators import duplicates

# Report line formats, kept as the original tool prints them.
HASH_HEADER = "{label}-Hash: "
INVENTORY_FIELDS = [
    ("Owner =", "owner"),
    ("Group =", "group"),
    ("Permissions =", "permissions"),
    ("File Length =", "length"),
    ("Block Size =", "block_size"),
    ("# Replications =", "replication"),
    ("Access Time =", "access_time"),
    ("Modification Time =", "modification_time"),
]


def _text(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit("null"))


HEADER, MEMBER, BLANK = 0, 1, 2


def duplicate_report(members: DataFrame, key: str = "file_hash", label: str = "label",
                     bits: int = DEFAULT_BITS, materialized: bool = False) -> DataFrame:
    """``(key, first_file, line, label, value)``: the report's lines, in no order yet.

    ``line`` is HEADER, MEMBER or BLANK; ``write_duplicate_report`` orders them.
    """
    if not materialized:
        members = duplicates.materialize(members)
    groups = duplicates.materialize(duplicates.duplicate_groups(members, key, label), "groups")
    header = F.concat(F.lit(HASH_HEADER.format(label=report_label(bits))), F.col(key), F.lit(" "))
    frame = F.array(F.struct(F.lit(HEADER).alias("line"), header.alias("value")),
                    F.struct(F.lit(BLANK).alias("line"), F.lit("").alias("value")))
    around = (groups.select(key, "first_file", F.explode(frame).alias("l"))
              .select(key, "first_file", "l.line", F.lit("").alias("label"), "l.value"))
    rows = duplicates.attach_group_stats(members.select(key, F.col(label).alias("label")), groups, key)
    files = rows.select(key, "first_file", F.lit(MEMBER).alias("line"), "label", F.col("label").alias("value"))
    return around.unionByName(files)


def write_duplicate_report(lines: DataFrame, path: str, key: str = "file_hash",
                           mode: str = "errorifexists") -> None:
    """Write the lines in report order: groups by digest, the header first, files by label, a blank line."""
    order = [key, "line", "label"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode(mode).text(path)


def inventory_report(inventory: DataFrame) -> DataFrame:
    """One ``value`` per file: ``File Path =<path>`` and its attribute lines."""
    lines = [F.lit("File Path ="), _text("path"), F.lit("\n")]
    for title, column in INVENTORY_FIELDS:
        lines += [F.lit(title), _text(column), F.lit("\n")]
    lines += [F.lit("Checksum ("), _text("checksum_algorithm"), F.lit(") ="), _text("checksum"), F.lit("\n")]
    xattr_lines = F.array_join(
        F.transform(F.array_sort(F.map_entries(F.coalesce("xattrs", F.create_map().cast("map<string,string>")))),
                    lambda e: F.concat(F.lit("XAttr "), e["key"], F.lit(" ="), F.coalesce(e["value"], F.lit("")),
                                       F.lit("\n"))),
        "")
    lines += [xattr_lines, F.lit("\n")]
    return inventory.select(F.concat(*lines).alias("value"))


#: What the attribute report shows of an evidence row; the evidence has no block size, replication or checksum.
EVIDENCE_FIELDS = [
    ("Owner =", "owner"),
    ("Group =", "group"),
    ("Permissions =", "permissions"),
    ("File Length =", "file_size"),
    ("Access Time =", "last_accessed"),
    ("Modification Time =", "last_modified"),
    ("Change Time =", "last_changed"),
    ("Creation Time =", "created"),
]


def evidence_report(evidence: DataFrame) -> DataFrame:
    """``(id, file_path, line, value)``: the attribute report's lines of every evidence row, from its own columns.

    Line 0 is the path, a blank line ends a file; a missing attribute reads ``null``, a missing size 0.
    ``write_evidence_report`` orders them.
    """
    rows = evidence.withColumn("file_size", parse_file_size("file_size"))
    lines = [F.concat(F.lit("File Path ="), _text("file_path"))]
    lines += [F.concat(F.lit(title), _text(column)) for title, column in EVIDENCE_FIELDS] + [F.lit("")]
    return rows.select("id", "file_path", F.posexplode(F.array(*lines)).alias("line", "value"))


def write_evidence_report(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write the lines by path, then id: part files in order, however many files there are."""
    order = ["file_path", "id", "line"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode(mode).text(path)


def write_text_report(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write report records as text part files under ``path``."""
    lines.select("value").write.mode(mode).text(path)
