"""Search in a keyword index: all words, a phrase, and ranked search.

Only the buckets of the words' terms are read (``Index.blocks``).  For several terms, the
rarest one's postings come first; of each further term only those blocks are decoded whose
document range holds a document still in question.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from casefile.search.contents import BROADCAST_ROWS, broadcast_if_few
from casefile.search.index import Index, decode

# The usual parameters of BM25.
K1, B = 1.2, 0.75


def terms_in(text: str) -> list[str]:
    """The terms of a query text, as the index has them."""
    return re.findall("[0-9a-z]+", text.lower())


def _statistics(index: Index, terms: Sequence[str]) -> dict:
    """Each term's number of documents and of blocks, and its first and last document; a row a term."""
    rows = index.blocks(terms).groupBy("term").agg(
        F.sum("n_postings").alias("n"), F.count("*").alias("blocks"), F.min("first_doc").alias("first"),
        F.max("last_doc").alias("last")).collect()
    return {r.term: r for r in rows}


def blocks_of_candidates(index: Index, term: str, statistics, candidates: DataFrame) -> DataFrame:
    """The blocks of ``term`` whose document range holds a ``doc_no`` of ``candidates``.

    Ranges meet documents in bins about as wide as a block, so a block falls in two bins on average.
    Only block borders take part; then the chosen blocks are read.
    """
    width = max(1, (statistics.last - statistics.first + 1) // statistics.blocks)
    borders = index.blocks([term]).select("first_doc", "last_doc")
    binned = borders.withColumn("bin", F.explode(F.sequence(F.floor(F.col("first_doc") / width),
                                                            F.floor(F.col("last_doc") / width))))
    points = candidates.select(F.floor(F.col("doc_no") / width).alias("at_bin"), F.col("doc_no").alias("at"))
    hit = binned.join(points, (F.col("bin") == F.col("at_bin")) & F.col("at").between(F.col("first_doc"), F.col("last_doc")),
                      "left_semi").select("first_doc").distinct()
    # not more rows than the term has blocks
    few = F.broadcast(hit) if statistics.blocks <= BROADCAST_ROWS else broadcast_if_few(hit)
    return index.blocks([term]).join(few, "first_doc", "left_semi")


def matches(index: Index, words: Sequence[str], positions: bool = False) -> DataFrame:
    """(doc_no, p0, p1, ...) of the files that hold all words; with ``positions``, ``p`` of the n-th different word."""
    terms = list(dict.fromkeys(words))
    if not terms:
        raise ValueError("a search needs at least one word")
    found = _statistics(index, terms)
    columns = [f"p{n}" for n in range(len(terms))] if positions else []
    if len(found) < len(terms):
        return index.spark.range(0).select(  # no rows from Python: a list would start workers of its own
            F.col("id").alias("doc_no"), *(F.lit(None).cast("array<long>").alias(c) for c in columns))
    out = None
    for term in sorted(terms, key=lambda t: (found[t].n, t)):
        blocks = index.blocks([term]) if out is None else blocks_of_candidates(index, term, found[term], out)
        each = decode(blocks, positions)
        each = each.select("doc_no", *([F.col("positions").alias(f"p{terms.index(term)}")] if positions else []))
        out = each if out is None else out.join(each, "doc_no")
    return out.select("doc_no", *columns)


def search_all(index: Index, text: str) -> DataFrame:
    """(id) of the files that hold all words of ``text``."""
    return matches(index, terms_in(text)).join(index.documents(), "doc_no").select("id")


def _shifted(positions: Column, n: int) -> Column:
    return F.transform(positions, lambda p: p - n)


def search_phrase(index: Index, text: str) -> DataFrame:
    """(id, n_hits) of the files in which the words of ``text`` follow each other within one string."""
    words = terms_in(text)
    terms = list(dict.fromkeys(words))
    rows = matches(index, words, positions=True)
    places = [_shifted(F.col(f"p{terms.index(w)}"), n) for n, w in enumerate(words)]
    both = places[0]
    for more in places[1:]:
        both = F.array_intersect(both, more)
    return (rows.withColumn("n_hits", F.size(both).cast("long")).where("n_hits > 0")
            .join(index.documents(), "doc_no").select("id", "n_hits"))


def search_ranked(index: Index, texts: Sequence[str], k: int = 10) -> DataFrame:
    """(query, rank, id, score): the best ``k`` files for each query text, by BM25; ties go to the smaller id.

    A file's score sums its words'; a word given twice counts once.  Scores are rounded to six digits
    before ranking.  Each task keeps the best ``k`` of its files before they meet.
    """
    spark = index.spark
    asked = [(n, t) for n, text in enumerate(texts) for t in dict.fromkeys(terms_in(text))]
    found = _statistics(index, [t for _, t in asked])
    documents = index.documents()
    total = documents.agg(F.count("*").alias("n"), F.avg("n_terms").alias("length")).first()
    weights = [(n, t, math.log(1 + (total.n - found[t].n + 0.5) / (found[t].n + 0.5))) for n, t in asked if t in found]
    words = [F.struct(F.lit(n).alias("query"), F.lit(t).alias("term"), F.lit(w).alias("weight")) for n, t, w in weights]
    none = "array<struct<query: int, term: string, weight: double>>"
    wanted = F.broadcast(spark.range(1).select(F.inline(F.array(*words).cast(none) if words else F.array().cast(none))))
    hits = decode(index.blocks([t for _, t, _ in weights]), positions=False).join(documents, "doc_no")
    count = F.col("count").cast("double")
    length = F.col("n_terms") / F.lit(total.length if total.length else 1.0)
    each = hits.join(wanted, "term").select(
        "query", "doc_no", "id", (F.col("weight") * count * (K1 + 1) / (count + K1 * (1 - B + B * length))).alias("s"))
    scores = each.groupBy("doc_no", "query").agg(F.first("id").alias("id"), F.round(F.sum("s"), 6).alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return (scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query", "rank", "id", "score"))
