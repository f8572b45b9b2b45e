"""The operators bound to the test tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casefile.llm import concat_packing, html_lstm, language_id, pareto_mix, parsing, pattern_packing, rule_ledger, simhash, suffix_dedup, turn_trie, url_automaton, wavelet, word_runs
from casefile.llm.common import SPACE_CLASS, let, short_batches, table
from casefile.llm.tokens import public_tokenizer

#: The URL rules of the contract.
URL_RULES = (
    url_automaton.Rule("allow", "org", "/"),
    url_automaton.Rule("block", "example.org", "/es/"),
    url_automaton.Rule("block", "example.org", "/en/1"),
    url_automaton.Rule("allow", "com", "/fr/"),
    url_automaton.Rule("block", "com", "/de/"),
)


def op1_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1: fingerprints of every text and of its edited text, and their likeness."""
    short_batches(spark)
    return parsing.compare_with_next(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2: link documents whose 4-word SimHash differs in at most 4 bits."""
    short_batches(spark)
    found = simhash.near_groups(table(spark, sf_dir, "documents"), 4, 4)
    return found.select(F.col("id").alias("doc_id"), simhash.hex_digits(F.col("fp")).alias("fingerprint"),
                        "component_id")


def op3_html_lstm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3: the main text of every page, by the recurrent block labeller."""
    short_batches(spark)
    return html_lstm.extract(table(spark, sf_dir, "pages"))


def op4_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4: mix all sources to weights 1, 2, 3, at most three copies of a document."""
    return pareto_mix.mix(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "copies")


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """7: judge every page URL by the wildcard automaton."""
    short_batches(spark, 4096)
    return url_automaton.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8: predict every document's language; a third of the ids is held out from the fit."""
    short_batches(spark)
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = language_id.fit(docs, may_train=~held_out)
    found = language_id.predict(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op9_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """9: measurements, failure bits and the verdict of the policy in force."""
    rows = rule_ledger.verdicts(rule_ledger.ledger(table(spark, sf_dir, "documents")), "clean-1")
    base = rule_ledger.policy_mask("base-1")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (F.col("failures").bitwiseAND(F.lit(base).cast("long")) != 0).alias("base_failed"),
                       "kept", "failures")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5: remove all bytes covered by 200-byte strings that start elsewhere, too."""
    short_batches(spark)
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), 200)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed",
                        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """6: pack all documents into sequences of at most 2048 tokens."""
    short_batches(spark)
    return pattern_packing.pack(table(spark, sf_dir, "documents"), public_tokenizer(), 2048, 0) \
        .withColumnRenamed("id", "doc_id")


def op10_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10: write all token ids as wavelet matrix files and read the documents back."""
    short_batches(spark)
    return wavelet.save_and_read(table(spark, sf_dir, "documents"), public_tokenizer(), 1) \
        .withColumnRenamed("id", "doc_id")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """11: every node of the trie of all conversations, rebuilt with up to five turns of their block's first."""
    return turn_trie.prefix_trie(table(spark, sf_dir, "conversations"), heads=6, block=100)


def planted_runs(doc_id: Column, text: Column) -> Column:
    """The contract's edit: every tenth text (by its id's hash) repeats its words from some place on.

    A null id has no hash; its text stays as it is.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / F.lit(10))

    def edited(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (F.floor((n - a) / (g % 8 + 3)) + 1).cast("int")
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(
            F.get(words, a + (i - a) % p))), " ")

    words = F.filter(F.split(text, f"[{SPACE_CLASS}]+"), lambda w: w != "")
    return F.when(h % 10 == 0, let(words, lambda ws: F.when(F.size(ws) > 0, edited(ws)).otherwise(text))).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """12: the periodic runs of every text, after the contract's edit, and the text without them."""
    short_batches(spark)
    docs = table(spark, sf_dir, "documents")
    found = word_runs.periodic_runs(docs.select("doc_id", planted_runs(F.col("doc_id"), F.col("text")).alias("text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"], (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return (found.withColumn("best", longest).select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))


def op13_concat_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """13: concatenate all documents' tokens and cut them into windows of 2048."""
    short_batches(spark)
    return concat_packing.pack(table(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.json"), 2048, 1) \
        .withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (op1_parsing, op2_simhash, op3_html_lstm, op4_pareto_mix, op5_suffix_dedup,
                                   op6_pattern_packing, op7_url_rules, op8_language_id, op9_rule_ledger,
                                   op10_wavelet_shards, op11_prefix_trie, op12_periodic_runs, op13_concat_cut)}
