"""Operators 4 (Pareto mixing), 6 (pattern packing) and 10 (wavelet shards)."""

import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from casefile.llm import pareto_mix, pattern_packing, tokens, wavelet
from casefile.llm.queries import QUERIES
from casefile.llm.tokens import Encoder, public_tokenizer
from tests.llm.conftest import SF, odd_rows, utf8


@pytest.fixture(scope="module")
def coder():
    return Encoder(public_tokenizer())


def test_memo_equals_the_library(coder, documents):
    texts = [*documents.text, "a\x1cb c", "It's <|endoftext|>x <|startoftext|> İstanbul ΣΑΣ ﬁ é ́x   ½ x²", "", "  ",
             "日本語 テスト", "a_b __ 'tis 'S don't'S!!", "ŒUVRE ÿ ß ẞ µ ª º×÷", " a\u0085b\u180e", "x" * 5000 + " y"]
    assert coder.direct
    for _ in range(2):  # new chunks, then known ones
        ids, stops = coder.encode([t.encode() for t in texts])
        for t, part in zip(texts, np.split(ids, stops[:-1])):
            assert part.tolist() == coder._whole(t).tolist()
    coder._forget()
    assert coder.encode([None, b""])[1].tolist() == [0, 0] and coder.encode([])[1].tolist() == []


def test_memo_table_grows_and_tells_keys_apart(monkeypatch, coder):
    monkeypatch.setattr(tokens, "MEMO_SLOTS", 8)
    small = Encoder(public_tokenizer())
    texts = [f"word{n} w{n % 7}, and{n}".encode() for n in range(300)]
    for part in (texts[:2], texts[:40], texts, texts[::-1]):
        assert [x.tolist() for x in small.encode(part)] == [x.tolist() for x in coder.encode(part)]
    assert len(small.slot_key) >= 2 * small.known > 600 and (small.slot_entry >= 0).sum() == small.known
    keys = small.slot_key[small.slot_entry >= 0]
    assert small._entries(keys).tolist() == small.slot_entry[small.slot_entry >= 0].tolist()
    assert (small._entries(keys + np.uint64(1)) < 0).all()


def water(sizes, weights, most):
    total, full, target = sum(sizes), set(), {}
    while True:
        left = total - sum(most * sizes[k] for k in full)
        spread = sum(w for k, w in enumerate(weights) if k not in full)
        target = {k: most * sizes[k] if k in full else left * weights[k] / spread for k in range(len(sizes))}
        over = {k for k in target if k not in full and target[k] > most * sizes[k]}
        if not over:
            return [target[k] for k in range(len(sizes))]
        full |= over


def check_mix(rows, most=3):
    sources = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(r.size for r in rows if r.source == s) for s in sources]
    targets = water(sizes, [k % 3 + 1 for k in range(len(sources))], most)
    for s, size, target in zip(sources, sizes, targets):
        mine = [r for r in rows if r.source == s]
        assert all(np.isclose(r.target, target) and r.source_size == size for r in mine)
        assert all(0 <= r.copies <= most and r.taken == r.copies * r.size for r in mine)
        assert {r.copies for r in mine} <= {int(target // max(size, 1)), int(target // max(size, 1)) + 1}
        assert abs(sum(r.taken for r in mine) - target) <= max([r.size for r in mine], default=0) / 2 + 1e-6


@pytest.mark.parametrize("bins", [4096, 4])
def test_mix_meets_targets(spark, bins, monkeypatch):
    monkeypatch.setattr(pareto_mix, "BINS", bins)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = pareto_mix.mix(docs).collect()
    check_mix(rows)
    assert sorted(rows) == sorted(pareto_mix.mix(docs).collect())
    assert Counter(r.doc_id for r in pareto_mix.mixed(docs).collect()) == Counter(
        {r.id: r.copies for r in rows if r.copies})


def test_mix_caps_small_sources(spark):
    rows = [(n, "w " * (1 if n < 3 else 100), "abcd"[min(n, 3)]) for n in range(40)]
    found = pareto_mix.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    check_mix(found)
    assert [r.target for r in found if r.source == "a"] == [3.0]


def test_mix_of_odd_rows(spark, odd, empty):
    found = pareto_mix.mix(odd).collect()
    check_mix(found)
    assert len(found) == len(odd_rows())
    rows = pareto_mix.mixed(odd)
    assert rows.columns == odd.columns and rows.count() == sum(r.copies for r in found)
    assert pareto_mix.mix(empty).count() == 0 and pareto_mix.mixed(empty).count() == 0


def check_packed(rows, texts, coder, capacity, end_id):
    ids = {i: np.append(coder._whole(t or ""), end_id).astype("<u4") for i, t in texts.items()}
    assert Counter((r.doc_id, r.piece) for r in rows) == Counter(
        (i, k) for i, x in ids.items() for k in range(-(-len(x) // capacity)))
    for r in rows:
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert r.start == capacity * r.piece and r.length == len(part) and zlib.crc32(part.tobytes()) == r.ids_crc32
    check_places(rows, capacity)


def check_places(rows, capacity):
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_query(spark, documents, coder):
    rows = QUERIES["op6_pattern_packing"](spark, SF).collect()
    check_packed(rows, dict(zip(documents.doc_id, documents.text)), coder, 2048, 0)
    used = len({r.sequence_id for r in rows})
    assert used <= 1.02 * -(-sum(r.length for r in rows) // 2048)


def test_packing_with_salted_ranks_and_ids(spark, monkeypatch):
    monkeypatch.setattr(pattern_packing, "RANK_GROUP", 5)
    docs = spark.createDataFrame([(n, "same words here" if n % 3 else "w " * (n % 40)) for n in range(300)],
                                 "doc_id long, text string")
    packed = pattern_packing.pack(docs, public_tokenizer(), 32, 0, with_ids=True)
    rows = packed.collect()
    check_places(rows, 32)
    made = {r.sequence_id: r for r in pattern_packing.sequences(packed).collect()}
    for r in rows:
        whole = made[r.sequence_id].ids
        assert whole[4 * r.offset:4 * (r.offset + r.length)] == r.ids
        assert made[r.sequence_id].n_tokens * 4 == len(whole)


def test_packing_of_odd_rows(spark, odd, empty):
    rows = pattern_packing.pack(odd, public_tokenizer(), 2048, 0).collect()
    assert Counter(r.id for r in rows if r.piece == 0) == Counter(r[0] for r in odd_rows())
    check_places(rows, 2048)
    assert [r.length for r in rows if r.id == 0] == [1]
    assert pattern_packing.pack(empty, public_tokenizer(), 2048, 0).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_plan_holds_every_piece(lengths):
    histogram = np.bincount(lengths, minlength=65) if lengths else np.zeros(65, np.int64)
    plan = pattern_packing.plan_patterns(histogram, 64)
    held = np.zeros(65, np.int64)
    for pattern, times in plan:
        assert sum(n * c for n, c in pattern) <= 64 and times > 0
        for n, c in pattern:
            held[n] += c * times
    assert (held == histogram).all()
    plain = sum(n for _, n in pattern_packing.best_fit(histogram.copy(), 64))
    assert sum(n for _, n in plan) <= plain * 1.1 + 1


def test_wavelet_file():
    random = np.random.default_rng(1)
    tokens = (random.zipf(1.3, 20_000) % 49_000).astype("<u4")
    file = wavelet.WaveletFile(wavelet.build(tokens, np.array([0, 5, 9000]), [3, None, 9]))
    assert (file.decode() == tokens).all() and file.ids == [3, None, 9] and file.starts.tolist() == [0, 5, 9000]
    for at in random.integers(0, len(tokens), 50).tolist():
        assert file.access(at) == tokens[at]
    for token in (0, 1, 2, 48_999, 60_000, 1 << 20):
        where = np.flatnonzero(tokens == token)
        assert file.count(token) == len(where)
        assert file.count(token, 700, 9000) == ((where >= 700) & (where < 9000)).sum()
        if len(where) < 500:
            assert file.occurrences(token) == where.tolist()
    assert file.find(1, 77) == np.flatnonzero(tokens == 1)[77]
    with pytest.raises(IndexError):
        file.access(len(tokens))
    for few in ([7], [0, 0, 0], [1 << 17, 3]):
        assert wavelet.WaveletFile(wavelet.build(np.array(few, "<u4"), np.zeros(1, int), [1])).decode().tolist() == few


@pytest.mark.parametrize("limit", [wavelet.FILE_TOKENS, 1000])
def test_wavelet_query_reads_back_all_ids(spark, documents, coder, limit, monkeypatch):
    monkeypatch.setattr(wavelet, "FILE_TOKENS", limit)
    found = {r.doc_id: r for r in QUERIES["op10_wavelet_shards"](spark, SF).collect()}
    start = 0
    for doc, text in zip(documents.doc_id, documents.text):
        ids = np.append(coder._whole(text), 1).astype("<u4")
        row = found.pop(doc)
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not found


def test_wavelet_of_odd_rows(spark, odd, empty, coder):
    rows = wavelet.save_and_read(odd, public_tokenizer(), 1).collect()
    order = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, utf8(r[1])))
    assert len(rows) == len(order)
    start = 0
    for row, (doc, text, *_) in zip(sorted(rows, key=lambda r: r.start), order):
        ids = np.append(coder._whole(text or ""), 1).astype("<u4")
        assert (row.id, row.start, row.n_tokens, row.ids_crc32) == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert wavelet.save_and_read(empty, public_tokenizer(), 1).count() == 0
