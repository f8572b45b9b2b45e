"""Repeated windows are found even if other windows have their hash."""

import random

import pytest
from pyspark.sql import functions as F

from casefile.llm import rule_ledger
from tests.llm.test_rules import brute_ledger


@pytest.mark.parametrize("hashes", [1, 3])
def test_windows_that_share_a_hash(spark, monkeypatch, hashes):
    real = F.xxhash64
    monkeypatch.setattr(rule_ledger.F, "xxhash64", lambda *cols: F.pmod(real(*cols), F.lit(hashes).cast("long")))
    dice = random.Random(7)
    texts = ["a b c x y z a b c", "a b c d a b c e f a b c", "a a a a a a", "a b c", "", "p q r s t u v w"]
    texts += [" ".join(dice.choice("abcd") for _ in range(n)) for n in range(0, 120, 7)]
    rows = rule_ledger.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_repeat_words for r in rows} == {n: brute_ledger(t)[4] for n, t in enumerate(texts)}
