"""Operator 5."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from casefile.llm import suffix_dedup
from casefile.llm.anchors import segments, sliding_least
from casefile.llm.queries import QUERIES
from tests.llm.conftest import SF, odd_rows, utf8


def brute(texts, length):
    seen = Counter(t[k:k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        turns = np.zeros(len(t) + 1, np.int64)
        for k in range(len(t) - length + 1):
            if seen[t[k:k + length]] > 1:
                turns[k] += 1
                turns[k + length] -= 1
        out.append(np.cumsum(turns)[:-1] > 0)
    return out


def check(found, ids, texts, length):
    want = []
    for i, t, gone in zip(ids, texts, brute(texts, length)):
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes() if t else b""
        starts = int((np.diff(gone.astype(int), prepend=0) == 1).sum()) if t else 0
        want.append((str(i), len(t), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest()))
    assert sorted(found) == sorted(want)


@pytest.mark.parametrize("whole", [suffix_dedup.WHOLE_BUCKET, 2])
def test_query_matches_brute_force(spark, documents, whole, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "WHOLE_BUCKET", whole)
    rows = QUERIES["op5_suffix_dedup"](spark, SF).collect()
    check([(str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows],
          documents.doc_id.tolist(), [utf8(t) for t in documents.text], 200)


def test_odd_rows(spark, odd, empty):
    rows = suffix_dedup.remove_repeats(odd, 200).collect()
    check([(str(r.id), r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in rows],
          [r[0] for r in odd_rows()], [utf8(r[1]) for r in odd_rows()], 200)
    assert suffix_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("whole", [suffix_dedup.WHOLE_BUCKET, 2])
def test_rows_of_equal_hash_in_two_buckets(spark, monkeypatch, whole):
    """``whole`` tells rows apart within a bucket only: one value for all rows that differ there changes nothing."""
    monkeypatch.setattr(suffix_dedup, "WHOLE_BUCKET", whole)
    texts = [("ab" * 110 + f"{n % 3} " * 80 + "xyz" * 90)[n % 5:] for n in range(12)]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string")
    rows = suffix_dedup._segments(suffix_dedup._keyed(docs, "doc_id", "text", ()), 200)
    assert rows.groupBy("whole").agg({"gram": "count"}).count() > 1
    real = suffix_dedup._segments

    def equal_hashes(keyed, length):
        # the n-th different row of each bucket gets n, in every bucket
        from pyspark.sql import Window
        from pyspark.sql import functions as F
        return real(keyed, length).withColumn("whole", F.dense_rank().over(Window.partitionBy("gram").orderBy("whole")).cast("long"))

    monkeypatch.setattr(suffix_dedup, "_segments", equal_hashes)
    found = suffix_dedup.remove_repeats(docs, 200).collect()
    check([(str(r.id), r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in found],
          list(range(12)), [t.encode() for t in texts], 200)


def test_many_texts_under_one_id(spark):
    """Rows without an id, or of one id, are told apart by 128 bits of their text."""
    passage = "a passage that some of them share, word for word, and that is long enough to be taken " * 3
    texts = [f"text {n} " * 20 + (passage if n % 4 == 0 else f"{n}" * 300) for n in range(60)]
    docs = spark.createDataFrame([(None if n % 2 else 7, t) for n, t in enumerate(texts)], "doc_id long, text string")
    keyed = suffix_dedup._keyed(docs, "doc_id", "text", ())
    assert {len(r.mark) for r in keyed.collect()} == {16} and keyed.select("mark").distinct().count() == 60
    found = suffix_dedup.remove_repeats(docs, 200).collect()
    check([(str(r.id), r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in found],
          [None if n % 2 else 7 for n in range(60)], [t.encode() for t in texts], 200)


def test_whole_characters():
    text = "aéß".encode()
    assert suffix_dedup.cut(text, [(2, 4)], False) == b"a\xc3\x9f"
    assert suffix_dedup.cut(text, [(2, 4)], True) == text
    assert suffix_dedup.cut(text, [(1, 4)], True) == "aß".encode()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=60).map(lambda b: bytes(97 + c % 2 for c in b)), min_size=1, max_size=5),
       st.integers(8, 40))
def test_bucket_pointer_refinement(texts, length):
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(data):
        return
    seen = Counter(t[k:k + length] for t in texts for k in range(len(t) - length + 1))
    want = [k + length <= len(t) and seen[t[k:k + length]] > 1 for t in texts for k in range(len(t))]
    assert suffix_dedup.repeated(data, np.cumsum([len(t) for t in texts]), length).tolist() == want


def test_every_window_has_one_segment():
    random = np.random.default_rng(1)
    texts = [bytes(random.integers(97, 99, n).astype(np.uint8)) for n in (0, 199, 200, 201, 900, 50, 3000)] + [b"a" * 700]
    text, lo, hi, at, _, _ = segments(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]),
                                      200, 32)
    base = np.cumsum([0] + [len(t) for t in texts])
    windows = [(t, w - base[t]) for t, a, b in zip(text, lo, hi) for w in range(a, b + 1)]
    assert windows == [(n, k) for n, t in enumerate(texts) for k in range(len(t) - 199)]
    assert all(a >= h and a + 32 <= low + 200 for low, h, a in zip(lo, hi, at))


def test_sliding_least():
    values = np.random.default_rng(2).integers(0, 1 << 40, 500).astype(np.uint64)
    assert sliding_least(values, 37).tolist() == [values[k:k + 37].min() for k in range(464)]
