"""Operator 12: periodic runs against their definition."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from casefile.llm import word_runs
from casefile.llm.queries import QUERIES
from tests.llm.conftest import SF, odd_rows, utf8


def brute(words, least=12):
    """All maximal stretches by comparing each word with the one a period on."""
    found = set()
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            stretch = words[i:i + length]
            if length >= max(least, 2 * q) and not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                found.add((i, length, q))
            i = j + 1 if j == i else j
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


word_lists = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40)
texts = st.builds(lambda a, b, n, c: a + b * n + c, word_lists, st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=9),
                  st.integers(1, 7), word_lists)


@settings(max_examples=300, deadline=None)
@given(st.lists(texts, max_size=4), st.sampled_from([2, 5, 12]))
def test_runs_equal_brute_force(docs, least):
    found = word_runs.runs_of_texts(docs, least)
    assert found == [brute(d, least) for d in docs]
    assert [word_runs.collapse(d, r) for d, r in zip(docs, found)] == [kept(d, r) for d, r in zip(docs, found)]


@settings(max_examples=200, deadline=None)
@given(texts)
def test_automaton_alone(words):
    """Without setting stretches aside: the same runs."""
    assert sorted(word_runs.runs_in(words), key=lambda r: (r[0], r[2])) == brute(words)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 8), min_size=1, max_size=30), st.lists(st.integers(0, 29), max_size=60))
def test_access_equals_recolouring(parents, accesses):
    """Link-cut access on a random tree reports each colour on the way to the root with its deepest node."""
    up = [0, 0] + [1 + p % (n + 1) for n, p in enumerate(parents)]
    paths, colours = word_runs.Paths(up), {}
    for turn, pick in enumerate(accesses):
        node = 1 + pick % (len(up) - 1)
        way = [node]
        while up[way[-1]]:
            way.append(up[way[-1]])
        want, seen = [], set()
        for v in way:
            if v in colours and colours[v] not in seen:
                want.append((v, colours[v]))
                seen.add(colours[v])
        assert list(paths.access(node, turn)) == want
        colours.update(dict.fromkeys(way, turn))


def test_long_texts():
    rng = np.random.default_rng(3)
    part = [b"%d" % n for n in rng.integers(0, 10**6, 5000)]
    (runs,) = word_runs.runs_of_texts([[b"x"] + part * 4 + part[:100]])
    assert runs == [(1, 20100, 5000)]
    (runs,) = word_runs.runs_of_texts([[b"a"] * 50_000])
    assert runs == [(0, 50_000, 1)]


def edited(doc_id, text):
    words = utf8(text).split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def check_rows(rows, docs):
    left = {}
    for doc_id, text in docs:
        words = edited(doc_id, text)
        runs = word_runs.runs_of_texts([words])[0]
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        row = (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2],
               hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
               hashlib.sha256(kept(words, runs)).hexdigest())
        left[row] = left.get(row, 0) + 1
    for r in rows:
        left[tuple(r)] = left.get(tuple(r), 0) - 1
    assert not any(left.values())


def test_query(spark, documents):
    rows = QUERIES["op12_periodic_runs"](spark, SF).collect()
    assert rows[0].asDict().keys() == {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                                       "collapsed_sha256"}
    check_rows(rows, zip(documents.doc_id, documents.text))
    assert sum(r.n_runs > 0 for r in rows) >= 10
    for doc_id, text in list(zip(documents.doc_id, documents.text)):
        words = edited(doc_id, text)
        if len(words) < 300:
            assert word_runs.runs_of_texts([words])[0] == brute(words)


def test_odd_rows(spark, odd, empty, tmp_path):
    found = word_runs.periodic_runs(odd)
    rows = {(r.id, r.collapsed): r for r in found.collect()}
    assert found.count() == len(odd_rows())
    by_id = {}
    for r in found.collect():
        by_id.setdefault(r.id, []).append(r)
    assert by_id[0][0].n_words == 0 and by_id[0][0].collapsed == "" and by_id[0][0].runs == []
    assert [tuple(x) for x in by_id[4][0].runs] == [(0, 120, 4)] and by_id[4][0].collapsed == "the of and thing"
    assert [tuple(x) for x in by_id[8][0].runs] == [(0, 40_000, 1)] and by_id[8][0].collapsed == "wort"
    assert len(rows) and word_runs.periodic_runs(empty).count() == 0
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    check_rows(QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect(), [r[:2] for r in odd_rows()])
    with pytest.raises(ValueError):
        word_runs.periodic_runs(odd, 1)
