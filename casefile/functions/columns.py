"""Column predicates and small scalar expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nonempty(c: Column | str) -> Column:
    """Value present and not zero bytes long (strings and binary alike).

    A missing cell and an empty cell are both rejected, as the evidence
    store's "value is not null" filter does.
    """
    c = _c(c)
    return c.isNotNull() & (F.octet_length(c) > 0)


def base_name(path: Column | str) -> Column:
    """Last segment of a ``/``-separated path or URI (``a/b/c.txt`` -> ``c.txt``)."""
    return F.element_at(F.split(_c(path), "/"), -1)


def extension(path: Column | str) -> Column:
    """Lower-cased extension of the last path segment, NULL when there is none."""
    ext = F.regexp_extract(base_name(path), r"\.([^./]+)$", 1)
    return F.when(ext != "", F.lower(ext))


def file_label(id_col: Column | str = "id", path_col: Column | str = "file_path") -> Column:
    """``<id>_<path>`` label of a file; a missing path renders as ``null``."""
    return F.concat(_c(id_col), F.lit("_"), F.coalesce(_c(path_col), F.lit("null")))


def parse_file_size(c: Column | str) -> Column:
    """File size stored as decimal text -> bigint; missing or empty -> 0.

    Malformed text raises (ANSI cast), as the original long parser does.
    """
    c = _c(c)
    return F.when(nonempty(c), c.cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def content_size(c: Column | str, missing: int | None = None) -> Column:
    """Byte length of a binary column as bigint; ``missing`` replaces NULL."""
    size = F.octet_length(_c(c)).cast("bigint")
    return size if missing is None else F.coalesce(size, F.lit(missing).cast("bigint"))



def path_from_uri(c: Column | str) -> Column:
    """Strip a ``file:`` scheme so listed paths compare with plain paths."""
    return F.regexp_replace(_c(c), r"^file:(//)?", "")
