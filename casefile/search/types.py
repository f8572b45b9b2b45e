"""Search by media type over a table laid out by type.

The type hierarchy (``functions.mediatype``) is numbered in depth-first order, so a type
with all its specialisations is one interval of numbers.  ``write_typed`` clusters files by
that number: a folder for each type.  A search turns its types into intervals, and only the
folders within are listed and read.

A search names a type (with its specialisations), ``text/*`` (the types of that name and
their specialisations) or a group such as ``archive``.  Types outside the hierarchy share
the number after the last and are told apart by name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casefile.functions import mediatype

# Groups of types that can be asked for by name.
GROUPS: dict[str, list[str]] = {
    "archive": ["application/zip", "application/gzip", "application/x-bzip2", "application/x-xz", "application/zstd",
                "application/x-7z-compressed", "application/x-rar-compressed", "application/x-tar"],
    "office": ["application/x-tika-msoffice", "application/x-tika-ooxml", "application/rtf", "application/pdf",
               "application/vnd.oasis.opendocument.text", "application/vnd.oasis.opendocument.spreadsheet",
               "application/vnd.oasis.opendocument.presentation"],
    "program": ["application/x-executable", "application/x-msdownload", "application/java-vm"],
}


def numbering() -> dict[str, tuple[int, int]]:
    """Each type's first and last number: its own, and the last one of its specialisations."""
    children: dict[str, list[str]] = {}
    for name in mediatype.known_types():
        chain = mediatype.ancestors(name)
        for child, parent in zip(chain, chain[1:]):
            children.setdefault(parent, [])
            if child not in children[parent]:
                children[parent].append(child)
    out: dict[str, tuple[int, int]] = {}

    def visit(name: str, number: int) -> int:
        last = number
        for child in sorted(children.get(name, [])):
            last = visit(child, last + 1)
        out[name] = (number, last)
        return last

    visit(mediatype.OCTET_STREAM, 0)
    return out


def intervals(search: str) -> list[tuple[int, int]]:
    """The disjoint number intervals of a search, ascending; none for a type outside the hierarchy."""
    numbers = numbering()
    if search in GROUPS:
        names = GROUPS[search]
    elif search.endswith("/*"):
        names = [n for n in numbers if n.startswith(search[:-1])]
    else:
        names = [search]
    out: list[tuple[int, int]] = []
    for low, high in sorted(numbers[n] for n in names if n in numbers):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def type_number(media_type: Column) -> Column:
    """The number of a type; those outside the hierarchy get the one after the last."""
    numbers = numbering()
    pairs = [F.lit(x) for name, (first, _) in sorted(numbers.items()) for x in (name, first)]
    return F.coalesce(F.element_at(F.create_map(*pairs), media_type), F.lit(len(numbers)))


def write_typed(files: DataFrame, path: str) -> None:
    """Write files (with a ``media_type``; those without one are left out) clustered by type below ``path``.

    Spark's rebalancing splits the rows of a frequent type over several tasks and files, and gives
    rare types to one task together.
    """
    numbered = files.where(F.col("media_type").isNotNull()).withColumn("type_no", type_number(F.col("media_type")))
    numbered.hint("rebalance", "type_no").write.partitionBy("type_no").parquet(path)


def read_typed(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table of ``write_typed``; ``schema`` is that of the files written."""
    return spark.read.schema(schema).parquet(path)


def of_types(typed: DataFrame, search: str) -> DataFrame:
    """The rows of a clustered table whose type a search means."""
    number = F.col("type_no")
    within = F.lit(False)
    for low, high in intervals(search):
        within = within | number.between(low, high)
    other = len(numbering())
    if search.endswith("/*"):
        within = within | ((number == other) & F.col("media_type").startswith(search[:-1]))
    elif search not in GROUPS and search not in numbering():
        within = (number == other) & (F.col("media_type") == search)
    return typed.where(within)


def search_types(typed: DataFrame, searches: Sequence[str]) -> DataFrame:
    """(query, id, media_type) for each search."""
    found = [of_types(typed, s).select(F.lit(s).alias("query"), "id", "media_type") for s in searches]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
