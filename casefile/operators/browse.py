"""Pages of duplicate groups, largest first, without sorting all groups.

Groups are ordered by size, largest first, then by digest.  A group's place is the sum of
three counts: groups of larger sizes (first histogram, one row a size; there are at most
about ``sqrt(2 * files)`` different sizes), groups of its size with a smaller digest prefix
(second histogram, at most ``65536`` prefixes a size), and groups before it in that bin.
Digests spread evenly, so a bin is a 65,536th of the groups of its size: only bins are
sorted, each by itself.  A single page sorts the bins that it touches and no other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from casefile.operators.duplicates import materialize

#: Leading digits of the digest that name a bin.
PREFIX_DIGITS = 4


def _binned(groups: DataFrame, digits: int) -> DataFrame:
    return groups.withColumn("prefix", F.substring("file_hash", 1, digits))


def bins(groups: DataFrame, digits: int = PREFIX_DIGITS) -> DataFrame:
    """(n, prefix, first_place, many): where each bin's groups begin in the order, and how many they are."""
    second = materialize(_binned(groups, digits).groupBy("n", "prefix").agg(F.count("*").alias("many")), "page-bins")
    larger = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    first = second.groupBy("n").agg(F.sum("many").alias("of_size")).select(
        "n", F.coalesce(F.sum("of_size").over(larger), F.lit(0)).alias("larger"))
    smaller = Window.partitionBy("n").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    placed = second.withColumn("smaller", F.coalesce(F.sum("many").over(smaller), F.lit(0)))
    return placed.join(first, "n").select("n", "prefix", (F.col("larger") + F.col("smaller")).alias("first_place"), "many")


def _ranked(groups: DataFrame, placed_bins: DataFrame, page_size: int, digits: int) -> DataFrame:
    inside = Window.partitionBy("n", "prefix").orderBy("file_hash")
    place = F.col("first_place") + F.row_number().over(inside) - 1
    return (_binned(groups, digits).join(placed_bins, ["n", "prefix"]).withColumn("place", place)
            .withColumn("page", F.floor(F.col("place") / page_size)).drop("prefix", "first_place", "many"))


def numbered_groups(groups: DataFrame, page_size: int = 20, digits: int = PREFIX_DIGITS) -> DataFrame:
    """Duplicate groups ``(file_hash, n, ...)`` with their ``place`` in the order and their ``page``, both from 0."""
    if page_size < 1:
        raise ValueError("a page holds at least one group")
    return _ranked(groups, bins(groups, digits), page_size, digits)


def page_of_groups(groups: DataFrame, page: int, page_size: int = 20, digits: int = PREFIX_DIGITS) -> DataFrame:
    """The groups of one page; only the bins that it touches are sorted (a page touches at most ``page_size`` bins)."""
    if page_size < 1 or page < 0:
        raise ValueError("pages are counted from 0 and hold at least one group")
    low, high = page * page_size, (page + 1) * page_size
    touched = bins(groups, digits).where((F.col("first_place") < high) & (F.col("first_place") + F.col("many") > low))
    return _ranked(groups, F.broadcast(touched), page_size, digits).where(F.col("page") == page)


def page_members(members: DataFrame, page: DataFrame) -> DataFrame:
    """The files of a page's groups: ``members`` with the page's columns."""
    return members.join(F.broadcast(page), "file_hash")  # a page of groups
