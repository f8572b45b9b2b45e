"""Quality rules: a bitmask ledger.

``ledger`` evaluates every rule once per document and stores one bit per failed rule
beside the measurements the rules compare.  A policy is a versioned mask: ``verdicts``
applies any policy to a stored ledger without reading a text again, and ``ablations``
counts, by bitwise aggregation, what each rule of a policy rejects alone and what the
policy would keep without it.  Write the ledger before filtering on a verdict: a filter
on one that is still to be computed makes Spark compute the measurements twice.

Everything is a DataFrame expression: no Python runs on the executors.

Defined results: a null or wordless text has zero measurements and fails TOO_SHORT.
Each row is judged by itself, so repeated rows get equal results; an empty table gives
an empty ledger; columns beside the id and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefile.llm.common import SPACE_CLASS, let

#: Bit of each rule, in the order of the ledger; a bit is never given to another rule.
TOO_SHORT, REPEATED_WORDS, SYMBOLS, DUPLICATE_LINES, SHOUTING, WORD_LENGTH, FEW_LETTERS = range(7)
RULES = {
    "too_short": TOO_SHORT,              # n_words < 50
    "repeated_words": REPEATED_WORDS,    # 100 * n_repeat_words > 50 * n_words
    "symbols": SYMBOLS,                  # 100 * n_symbols > 30 * n_words
    "duplicate_lines": DUPLICATE_LINES,  # 100 * n_dup_lines > 50 * n_lines
    "shouting": SHOUTING,                # 100 * n_shouts > 50 * n_words
    "word_length": WORD_LENGTH,          # word_chars outside 2 to 20 times n_words
    "few_letters": FEW_LETTERS,          # 100 * n_letters < 40 * word_chars
}
#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base-1": ("too_short", "repeated_words"),
    "clean-1": tuple(RULES),
}
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def policy_mask(name: str) -> int:
    return sum(1 << RULES[r] for r in POLICIES[name])


def _squeezed(text: Column) -> Column:
    """The text without white space."""
    for space in SPACES:
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def _words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE_CLASS}]+"), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words inside a 3-word window that the text holds twice or more, the first included.

    Each window becomes one number, a hash followed by its place.  Sorting brings equal
    windows together; neighbours with equal hashes and equal words are repeated, and
    their sorted places give the words covered (overlaps once).  Neighbours with equal
    hashes and other words show that the hash does not tell the text's windows apart;
    only then are they sorted by their words.  ``words`` must be a column or a bound
    variable, as it is read many times.
    """
    long = "long"
    span = F.size(words).cast(long)
    room = F.floor(F.lit(float(1 << 62)) / span).cast(long)

    def window(word: Column, at: Column) -> Column:
        code = F.xxhash64(word, F.get(words, at + 1), F.get(words, at + 2))
        return F.pmod(code, room) * span + at.cast(long)

    def place(code: Column) -> Column:
        return (code % span).cast("int")

    def neighbours(items: Column, each) -> Column:
        return F.zip_with(F.slice(items, 1, F.size(items) - 1), F.slice(items, 2, F.size(items) - 1), each)

    def equal_hash(a: Column, b: Column) -> Column:
        return (a - a % span) == (b - b % span)

    def equal_words(a: Column, b: Column) -> Column:
        out = F.lit(True)
        for k in range(3):
            out = out & (F.get(words, place(a) + k) == F.get(words, place(b) + k))
        return out

    def by_hash(codes: Column) -> Column:
        # a pair of places, or -1 for two windows of one hash; null for all others
        pairs = neighbours(codes, lambda a, b: F.when(equal_hash(a, b), F.when(
            equal_words(a, b), F.array(place(a), place(b))).otherwise(F.array(F.lit(-1)))))
        return F.flatten(F.filter(pairs, lambda pair: pair.isNotNull()))

    def by_words() -> Column:
        rows = F.sort_array(F.transform(F.slice(words, 1, F.size(words) - 2), lambda word, at: F.struct(
            word.alias("a"), F.get(words, at + 1).alias("b"), F.get(words, at + 2).alias("c"), at.alias("at"))))
        pairs = neighbours(rows, lambda x, y: F.when((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]),
                                                     F.array(x["at"], y["at"])))
        return F.flatten(F.filter(pairs, lambda pair: pair.isNotNull()))

    def covered(places: Column) -> Column:
        gaps = neighbours(places, lambda a, b: F.least(b - a, F.lit(3)))
        return F.when(F.size(places) > 0, F.aggregate(gaps, F.lit(3).cast(long), lambda t, g: t + g)) \
            .otherwise(F.lit(0).cast(long))

    codes = F.sort_array(F.transform(F.slice(words, 1, F.size(words) - 2), window))
    hits = let(let(codes, by_hash), lambda h: F.when(F.array_contains(h, -1), by_words()).otherwise(h))
    places = let(hits, lambda h: F.sort_array(F.array_distinct(h)))
    return F.when(F.size(words) > 3, let(places, covered)).otherwise(F.lit(0).cast(long))


def _removed(text: Column, marks: str) -> Column:
    """How many of the (one-byte) characters ``marks`` the text holds."""
    rest = text
    for mark in marks:
        rest = F.replace(rest, F.lit(mark), F.lit(""))
    return (F.octet_length(text) - F.octet_length(rest)).cast("long")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_letters, n_shouts, failures)."""
    text = F.col("__text")
    base = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    split = base.select("*", _words(text).alias("__words"),
                        F.filter(F.split(text, "\n"), lambda s: s.rlike(f"[^{SPACE_CLASS}]")).alias("__lines"))
    long = "long"
    measured = split.select(
        id_col,
        F.size("__words").cast(long).alias("n_words"),
        F.char_length(_squeezed(text)).cast(long).alias("word_chars"),
        _removed(text, "#*$%&|<>").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast(long).alias("n_dup_lines"),
        _repeat_words(F.col("__words")).alias("n_repeat_words"),
        F.size("__lines").cast(long).alias("n_lines"),
        F.char_length(F.regexp_replace(text, r"\P{L}+", "")).cast(long).alias("n_letters"),
        _removed(text, "!").alias("n_shouts"))
    n = F.col("n_words")
    fails = {
        TOO_SHORT: n < 50,
        REPEATED_WORDS: 100 * F.col("n_repeat_words") > 50 * n,
        SYMBOLS: 100 * F.col("n_symbols") > 30 * n,
        DUPLICATE_LINES: 100 * F.col("n_dup_lines") > 50 * F.col("n_lines"),
        SHOUTING: 100 * F.col("n_shouts") > 50 * n,
        WORD_LENGTH: (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n),
        FEW_LETTERS: 100 * F.col("n_letters") < 40 * F.col("word_chars"),
    }
    bits = F.lit(0).cast(long)
    for bit, failed in fails.items():
        bits = bits.bitwiseOR(F.when(failed, F.lit(1 << bit)).otherwise(F.lit(0)).cast(long))
    return measured.withColumn("failures", bits)


def _failed(mask: int) -> Column:
    return F.col("failures").bitwiseAND(F.lit(mask).cast("long"))


def verdicts(rows: DataFrame, policy: str) -> DataFrame:
    """Apply a policy to a ledger: adds ``policy`` and ``kept``."""
    return rows.withColumn("policy", F.lit(policy)).withColumn("kept", _failed(policy_mask(policy)) == 0)


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: documents it fails, those only it fails, and those kept with and without it."""
    mask = policy_mask(policy)
    counts = []
    for rule in POLICIES[policy]:
        bit = 1 << RULES[rule]
        counts += [F.count_if(_failed(bit) != 0).alias(f"{rule}_fails"),
                   F.count_if(_failed(mask) == bit).alias(f"{rule}_only"),
                   F.count_if(_failed(mask & ~bit) == 0).alias(f"{rule}_kept_without")]
    sums = rows.agg(F.count_if(_failed(mask) == 0).alias("kept"), *counts)
    line = F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(f"{rule}_fails").alias("fails"),
                                        F.col(f"{rule}_only").alias("only_this"), F.col("kept"),
                                        F.col(f"{rule}_kept_without").alias("kept_without"))
                               for rule in POLICIES[policy]]))
    return sums.select(line.alias("line")).select(F.lit(policy).alias("policy"), "line.*")
