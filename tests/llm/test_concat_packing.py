"""Operator 13 (concatenate and cut) and the byte-level encoder."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from casefile.llm import byte_tokens, concat_packing
from casefile.llm.byte_tokens import ByteEncoder
from casefile.llm.queries import QUERIES
from casefile.llm.tokens import public_tokenizer
from tests.llm.conftest import SF, odd_rows

BYTES = public_tokenizer("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def coder():
    return ByteEncoder(BYTES)


def check_encoder(coder, texts):
    ids, stops = coder.encode(pa.array(texts, pa.string()))
    assert len(stops) == len(texts) and (not len(stops) or stops[-1] == len(ids))
    for text, part in zip(texts, np.split(ids, stops[:-1])):
        assert part.tolist() == coder.whole(text or "").tolist(), text


def test_chunks_equal_the_library(coder, documents, monkeypatch):
    assert coder.direct
    texts = [*documents.text, None, "", " ", "  ", "a  b", "a \n b", "x <|endoftext|> y", "<|endoftext|>", "tail ",
             "\nx", " \n x", "日本語 テスト 。 a", "a\n\n b\t c", "it's I'LL we're 'tis", "　 a 　b",
             "a​ ​b", "x\x1c \x1cy", "1 2  3   4", "x" * 5000 + " y", "a   b", "e ́x"]
    for _ in range(2):  # new chunks, then known ones
        check_encoder(coder, texts)
    monkeypatch.setattr(byte_tokens, "MEMO_CHUNKS", 5)
    check_encoder(coder, texts)
    check_encoder(coder, [])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from(" \n\t 　\x1cabé1.'<|>日́"))), max_size=4))
def test_chunks_of_odd_white_space(coder, texts):
    check_encoder(coder, texts)


def test_other_tokenizers_get_whole_texts():
    other = ByteEncoder(public_tokenizer())
    assert not other.direct
    check_encoder(other, ["It's A test", None, "b  c"])


def check_stream(rows, texts, coder, window, tail="powers"):
    """Every id is in one piece, sequences have no gap, and only the stream's tail is shorter than a window."""
    want = Counter()
    for text in texts:
        ids = np.append(coder.whole(text or ""), 1).astype("<u4")
        want[(len(ids), zlib.crc32(ids))] += 1
    pieces = {}
    for r in rows:
        pieces.setdefault(r.sequence_id, []).append(r)
    sizes = {}
    for number, members in pieces.items():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        sizes[number] = at
    total = sum(n for (n, _), k in want.items() for _ in range(k))
    assert sorted(sizes) == list(range(len(sizes))) and sum(sizes.values()) == total
    short = [sizes[n] for n in sorted(sizes)][total // window:]
    assert all(sizes[n] == window for n in range(total // window))
    if tail == "powers":
        assert all(n & (n - 1) == 0 for n in short) and short == sorted(set(short), reverse=True)
    else:
        assert len(short) == (total % window > 0)
    assert sum(r.doc_tokens for r in rows if r.start == 0) == total
    return sizes


def test_query(spark, documents, coder):
    rows = QUERIES["op13_concat_cut"](spark, SF).collect()
    check_stream(rows, documents.text, coder, 2048)
    texts = dict(zip(documents.doc_id, documents.text))
    for doc, text in texts.items():
        ids = np.append(coder.whole(text or ""), 1).astype("<u4")
        mine = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start)
        assert [r.start for r in mine] == np.cumsum([0] + [r.length for r in mine[:-1]]).tolist()
        assert sum(r.length for r in mine) == len(ids) and {r.doc_tokens for r in mine} == {len(ids)}
        assert all(zlib.crc32(ids[r.start:r.start + r.length]) == r.ids_crc32 for r in mine)


@pytest.mark.parametrize("window,tail", [(7, "powers"), (64, "one"), (1, "powers"), (2048, "one")])
def test_many_parts(spark, window, tail, coder):
    texts = ["some words here " * (n % 23) if n % 5 else None for n in range(120)] + ["long text " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(9)
    packed = concat_packing.pack(docs, BYTES, window, 1, with_ids=True, tail=tail)
    rows = packed.collect()
    sizes = check_stream(rows, texts, coder, window, tail)
    made = {r.sequence_id: r for r in concat_packing.sequences(packed).collect()}
    assert {n: r.n_tokens for n, r in made.items()} == sizes
    for r in rows:
        assert made[r.sequence_id].ids[4 * r.offset:4 * (r.offset + r.length)] == r.ids
        assert zlib.crc32(r.ids) == r.ids_crc32
    first = concat_packing.boundaries(packed).collect()
    assert sorted(r.sequence_id for r in first) == sorted(sizes)


def test_odd_rows(spark, odd, empty, coder):
    rows = concat_packing.pack(odd, BYTES, 2048, 1).collect()
    check_stream(rows, [r[1] for r in odd_rows()], coder, 2048)
    assert Counter(r.id for r in rows if r.start == 0) == Counter(r[0] for r in odd_rows())
    assert concat_packing.pack(empty, BYTES).count() == 0
    with pytest.raises(ValueError):
        concat_packing.pack(odd, BYTES, tail="none")


def test_text_ids_are_kept(spark, coder):
    docs = spark.createDataFrame([("x", "a b"), ("y", None)], "doc_id string, text string")
    assert {r.id: r.doc_tokens for r in concat_packing.pack(docs, BYTES).collect()} == {"x": 3, "y": 1}
