"""Mixing sources to target weights by Pareto order sampling.

A source whose target is ``f`` times its size gives every document floor(f) certain
whole copies; the rest of the target is filled by a sample without replacement.  For
it, documents are ranked by random odds divided by inclusion odds,
``(u / (1 - u)) / (p / (1 - p))`` with ``p = f - floor(f)``, and taken in this order
while the sample is nearer to the words still due with them than without.  ``p`` is one
number per source, so inclusion odds differ between sources only; within one they are
equal, the order is that of ``u``, and the size is fixed in words, not in documents.

Whole documents are taken, so a source's words miss the target by at most half of one
document, the one that crosses the words due.  The order ends there, whether that document
is taken or not: if it is long and left out, later ones that would fit are left out too.
``u`` is the MD5 of seed and document id, so reruns agree.  The cut in each
source's order is found from histograms of the rank (``BINS`` bins, twice); only the
rows of one bin of one bin are ever put in order, so a source of any size spreads over
all tasks.

Defined results: a null text has size 0 and, like any document without words, no
words are taken from it (its copies count as 0 words); a null source is a source of its
own, last in order.  Rows with the same id and size share a rank and are taken in
turn.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casefile.llm.common import WORD_PATTERN, broadcast_if_few, materialize

#: Histogram bins a source's rank is divided into, at each of two levels.
BINS = 4096
#: Hexadecimal digits of the MD5 that make the random number (52 bits: exact as a double).
DIGITS = 13
SCALE = float(1 << (4 * DIGITS))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], max_copies: int) -> DataFrame:
    """(source, source_size) -> plus ``target``: shares by weight, none above ``max_copies`` times its size.

    Water filling in closed form: with sources in ascending order of cap / weight, the
    first k are full, and every other one gets ``weight`` times the level that spends
    the rest.  One row per source, so the windows without partition are small.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("cap_level", "n").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    rated = (sizes
             .withColumn("n", F.row_number().over(by_name))
             .withColumn("weight", F.element_at(pattern, ((F.col("n") - 1) % len(weights) + 1).cast("int")))
             .withColumn("cap", F.lit(float(max_copies)) * F.col("source_size"))
             .withColumn("cap_level", F.col("cap") / F.col("weight"))
             .withColumn("total", F.sum(F.col("source_size").cast("double")).over(everything))
             .withColumn("spent", F.coalesce(F.sum("cap").over(by_cap), F.lit(0.0)))
             .withColumn("weight_left", F.sum("weight").over(everything)
                         - F.coalesce(F.sum("weight").over(by_cap), F.lit(0.0)))
             .withColumn("level", (F.col("total") - F.col("spent")) / F.col("weight_left")))
    # the first source that its level does not fill; those before it are full
    reached = F.when(F.col("level") <= F.col("cap_level"), F.struct("cap_level", "n", "level"))
    water = F.min(reached).over(everything)["level"]
    return (rated.withColumn("water", water)
            .withColumn("target", F.when(F.col("water").isNull(), F.col("cap"))
                        .otherwise(F.least("cap", F.col("water") * F.col("weight"))))
            .select("source", "source_size", "target"))


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Add the columns of ``plan`` (one row per source) to ``rows``; null is a source like any other."""
    side = plan.withColumnRenamed("source", "plan_source")
    return rows.join(broadcast_if_few(side), F.col("source").eqNullSafe(F.col("plan_source")), "left") \
        .drop("plan_source")


def _cut(rows: DataFrame, plan: DataFrame, level: str, label: str) -> DataFrame:
    """Per source: the bin of ``level`` in which the words due run out, and the words that come before it.

    All documents in lower bins are taken, none in higher ones.
    """
    up_to = Window.partitionBy("source").orderBy(level)
    words = (rows.groupBy("source", level).agg(F.sum("size").alias("words"))
             .withColumn("above", F.sum("words").over(up_to))
             .withColumn("below", F.col("above") - F.col("words")))
    crossing = (_with_plan(words, plan.select("source", "due", "base"))
                .where((F.col("base") + F.col("below") <= F.col("due"))
                       & (F.col("due") < F.col("base") + F.col("above"))))
    found = crossing.select("source", F.col(level).alias(f"cut_{level}"),
                            (F.col("base") + F.col("below")).alias("new_base"))
    out = _with_plan(plan, found).withColumn("base", F.coalesce("new_base", "base")).drop("new_base")
    return materialize(out.withColumn(f"cut_{level}", F.coalesce(f"cut_{level}", F.lit(BINS))), label)


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_copies: int = 3, seed: str = "mix",
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Return (id, size, source, source_size, target, copies, taken) for every document."""
    sized = materialize(docs.select(F.col(id_col).alias("id"), word_count(F.col(text_col)).alias("size"),
                                    F.col(source_col).cast("string").alias("source")), "mix-sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = materialize(source_targets(sizes, weights, max_copies)
                       .withColumn("rate", rate)
                       .withColumn("whole", F.floor("rate").cast("int"))
                       .withColumn("p", F.col("rate") - F.floor("rate"))
                       .withColumn("due", F.col("target") - F.floor("rate") * F.col("source_size"))
                       .withColumn("base", F.lit(0).cast("long")), "mix-plan")
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null")))
                               .cast("binary")), 1, DIGITS)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / SCALE

    def ranked(with_plan: DataFrame) -> DataFrame:
        fine = F.floor(F.col("q") / (1 + F.col("q")) * (BINS * BINS)).cast("long")
        return (with_plan.withColumn("u", u)
                .withColumn("q", F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u")))
                                        / (F.col("p") / (1 - F.col("p")))))
                .withColumn("bin", F.floor(fine / BINS).cast("int"))
                .withColumn("sub", (fine % BINS).cast("int")))

    # q / (1 + q) orders as q does and lies in (0, 1): bins on it can be set beforehand
    plan = _cut(ranked(_with_plan(sized, plan)).where("p > 0"), plan, "bin", "mix-bin")
    plan = _cut(ranked(_with_plan(sized, plan)).where("p > 0 and bin = cut_bin"), plan, "sub", "mix-sub")
    rows = ranked(_with_plan(sized, plan))
    open_rows = F.coalesce((F.col("p") > 0) & (F.col("bin") == F.col("cut_bin"))
                           & (F.col("sub") == F.col("cut_sub")), F.lit(False))
    in_order = Window.partitionBy("source").orderBy("q", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("base") + F.coalesce(F.sum("size").over(in_order), F.lit(0))
    last = rows.where(open_rows).withColumn("extra", (before + F.col("size") / 2 <= F.col("due")).cast("int"))
    rest = rows.where(~open_rows).withColumn("extra", F.coalesce(
        (F.col("p") > 0) & ((F.col("bin") < F.col("cut_bin"))
                            | ((F.col("bin") == F.col("cut_bin")) & (F.col("sub") < F.col("cut_sub")))),
        F.lit(False)).cast("int"))
    return (rest.unionByName(last)
            .withColumn("copies", F.col("whole") + F.col("extra"))
            .select("id", "size", "source", "source_size", "target", "copies",
                    (F.col("size") * F.col("copies")).cast("long").alias("taken")))


def mixed(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_copies: int = 3, seed: str = "mix",
          id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it."""
    size = word_count(F.col(text_col))
    found = materialize(mix(docs, weights, max_copies, seed, id_col, text_col, source_col), "mix")
    # rows of one id, size and source differ by one copy at most
    taken = found.groupBy(F.col("id").alias("__id"), F.col("size").alias("__size"), F.col("source").alias("__source")) \
        .agg(F.min("copies").alias("__least"), F.sum("copies").alias("__all"), F.count("*").alias("__rows"))
    rows = docs.withColumn("__n", size).join(
        taken, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__n") == F.col("__size"))
        & F.col(source_col).cast("string").eqNullSafe(F.col("__source")))
    copies = F.col("__least")
    if taken.where("__rows > 1").head(1):
        turn = F.row_number().over(Window.partitionBy("__id", "__size", "__source").orderBy(text_col))
        rows = rows.withColumn("__turn", turn)
        copies = copies + (F.col("__turn") <= F.col("__all") - F.col("__least") * F.col("__rows")).cast("int")
    return (rows.withColumn("__copies", F.array_repeat(F.lit(1), copies.cast("int")))
            .withColumn("__copy", F.explode("__copies")).select(*docs.columns))
