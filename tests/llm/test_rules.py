"""Operators 7 (URL automaton) and 9 (rule ledger); the DuckDB SQL of 4, 7 and 9."""

import re
import time
from collections import Counter

import duckdb
import pandas as pd
import pytest

from casefile.llm import rule_ledger, url_automaton
from casefile.llm.common import materialize
from casefile.llm.oracle import ORACLE_SQL
from casefile.llm.queries import QUERIES, URL_RULES
from tests.llm.conftest import SF, odd_rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_match_duckdb(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.execute(ORACLE_SQL[name]).fetchdf()
    found = QUERIES[name](spark, SF).toPandas()
    key = list(found.columns[:2])  # a node is told by conversation and depth
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    pd.testing.assert_frame_equal(found.sort_values(key)[columns].reset_index(drop=True),
                                  want.sort_values(key)[columns].reset_index(drop=True), check_dtype=False)


def glob_regex(glob):
    out = ""
    for part in re.split(r"(\*\*|\*)", glob):
        out += {"**": "(?s:.*)", "*": "[^/]*"}.get(part, re.escape(part))
    return re.compile(out)


def test_automaton_equals_regular_expressions():
    globs = ["org/**", "*.org/**", "a*b", "**x**", "*", "", "ex*le.com/*/p", "é*/**", "a" * 70 + "*/**", "**.js"]
    texts = ["", "org/", "x.org/a/b", "org", "ab", "a/b", "axxb", "x", "example.com/q/p", "example.com/q/r/p", "é1/ü",
             "a" * 70 + "zz/1", "a/b.js", "a/b.jsx"]
    fits = url_automaton.run(url_automaton.compile_globs(globs), [t.encode() for t in texts])
    for t, row in zip(texts, fits.tolist()):
        assert row == [bool(glob_regex(g).fullmatch(t)) for g in globs], t
    assert url_automaton.run(url_automaton.compile_globs(globs), []).shape == (0, len(globs))


def test_long_texts_settle_early():
    automaton = url_automaton.compile_globs([g for r in URL_RULES for g in r.globs()] + ["**z", "a*b"])
    tail = "x/y.org/fr" * 40
    texts = ["org/" + tail, "a.example.org/es/" + tail, "b.com/de/z" + tail + "z", "acom/" + tail, "", "a" + "c" * 99 + "b"]
    globs = [g for r in URL_RULES for g in r.globs()] + ["**z", "a*b"]
    for t, row in zip(texts, url_automaton.run(automaton, [t.encode() for t in texts]).tolist()):
        assert row == [bool(glob_regex(g).fullmatch(t)) for g in globs], t
    plain = url_automaton.compile_globs([g for r in URL_RULES for g in r.globs()])
    begun = time.monotonic()
    fits = url_automaton.run(plain, [b"org/" + b"p/" * 500_000, b"nowhere.net/" + b"p" * 1_000_000])
    assert fits.any(axis=1).tolist() == [True, False] and time.monotonic() - begun < 2


def test_urls_of_all_kinds(spark):
    urls = [None, "", "no scheme.org/", "http://ORG", "http://org/", "HTTP://A.Example.ORG/es/x?q=/fr/", "x://example.org/en/12",
            "x://example.org/en/2#/", "http://a.com/fr/", "http://com/de/", "http://acom/de/", "http://a.com?/fr/",
            "http://org/" + "p" * 5000, "http://Éa.com/FR/", "http://evil.net/x.org/"]
    pages = spark.createDataFrame([(n, u, "x", "y") for n, u in enumerate([*urls, urls[4]])],
                                  "page_id long, url string, host string, rule string")
    found = {r.page_id: r for r in url_automaton.judge_urls(pages, URL_RULES, default="block").collect()}
    rules = [found[n].rule for n in range(len(urls))]
    assert rules == [None, None, None, None, "org/", "example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/",
                     None, None, "org/", None, None]
    assert found[5].host == "a.example.org" and found[5].path == "/es/x" and found[5].verdict == "block"
    assert found[0].host == found[1].host == found[2].host == "" and found[0].verdict == "block"
    assert found[len(urls)].rule == "org/"
    assert url_automaton.judge_urls(pages.where("page_id < 0"), URL_RULES).count() == 0
    assert {r.verdict for r in url_automaton.judge_urls(pages, []).collect()} == {"allow"}


def brute_ledger(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    count = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if count[w] > 1 for j in range(3)}
    lines = [s for s in text.split("\n") if re.search("[^\x20\x09-\x0D]", s)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered))


def test_ledger_of_odd_rows(spark, odd, empty):
    rows = rule_ledger.ledger(odd).collect()
    found = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert found == Counter((r[0], *brute_ledger(r[1])) for r in odd_rows())
    assert rule_ledger.ledger(empty).count() == 0
    for r in rows:
        failed = r.n_words < 50
        assert bool(r.failures >> rule_ledger.TOO_SHORT & 1) == failed


def test_repeated_windows(spark):
    texts = ["a b c a b c", "a b c d", "a a a a", "a b c x a b c y b c x", "x " * 5 + "y", "one two", "a b c\na b c\n\na b c "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in rule_ledger.ledger(docs).collect()}
    for n, t in enumerate(texts):
        r = rows[n]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_ledger(t), t


def test_policies_and_ablations(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = materialize(rule_ledger.ledger(docs), "ledger")  # policies are applied to a stored ledger
    ledger = rows.collect()
    masks = [r.failures for r in ledger]
    for policy in rule_ledger.POLICIES:
        mask = rule_ledger.policy_mask(policy)
        kept = rule_ledger.verdicts(rows, policy).where("kept").count()
        assert kept == sum(m & mask == 0 for m in masks)
        for line in rule_ledger.ablations(rows, policy).collect():
            bit = 1 << rule_ledger.RULES[line.rule]
            assert (line.fails, line.only_this, line.kept, line.kept_without) == (
                sum(m & bit > 0 for m in masks), sum(m & mask == bit for m in masks), kept,
                sum(m & mask & ~bit == 0 for m in masks))
