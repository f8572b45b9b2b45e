"""Operators 1 (locally consistent parsing) and 2 (SimHash)."""

import hashlib
import re

import numpy as np
import xxhash

from casefile.llm import parsing, simhash
from casefile.llm.components import components
from casefile.llm.queries import QUERIES
from tests.llm.conftest import SF, odd_rows


def test_parsing_query_matches_brute_force(spark, documents):
    found = QUERIES["op1_parsing"](spark, SF).toPandas().set_index("doc_id")
    rows = list(zip(documents.doc_id, documents.text))
    assert len(found) == len(rows)
    for n, (doc, text) in enumerate(rows):
        following = rows[(n + 1) % len(rows)][1]
        quarter = len(text) // 4
        changed = text[:len(text) - quarter] + following[:quarter]
        one, two, three = parsing.sketches([text]), parsing.sketches([changed]), parsing.sketches([following])
        row = found.loc[doc]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert (row.fingerprint, row.edited_fingerprint) == (parsing.digits(one)[0], parsing.digits(two)[0])
        assert np.isclose(row.near_edited, parsing.likeness(one, two)[0])
        assert np.isclose(row.near_next, parsing.likeness(one, three)[0])
    assert (found.near_edited > found.near_next).mean() > 0.95
    assert found.near_edited.median() > 0.5 and found.near_next.median() < 0.05


def test_equal_substrings_share_interior_phrases(documents):
    core = max(documents.text, key=len)[:3000]
    seen = []
    for before in ("", "z", "other words before ", "é" * 41):
        names, first = np.frombuffer((before + core + "!end").encode("utf-32-le"), np.uint32), np.array([0])
        levels = []
        for _ in range(4):
            names, first = parsing._phrases(names, first)
            levels.append(set(names.tolist()))
        seen.append(levels)
    for levels in seen[1:]:
        for here, there in zip(levels, seen[0]):
            assert len(here & there) / len(there) > 0.85


def test_parsing_of_runs_and_batches():
    texts = ["", "a", "aaaa" * 100, "ab" * 300, "b" * 99 + "c", "x" * 100_000]
    together = parsing.sketches(texts)
    for n, text in enumerate(texts):
        assert (parsing.sketches([text])[0] == together[n]).all()
    assert len({row.tobytes() for row in together}) == len(texts)
    assert parsing.likeness(together[:1], together[1:2])[0] == 0 and parsing.likeness(together[:1], together[:1])[0] == 1


def test_parsing_of_odd_rows(spark, odd, empty):
    found = parsing.compare_with_next(odd).collect()
    assert sorted((r.id is not None, r.id or 0, r.n_chars) for r in found) == sorted(
        (r[0] is not None, r[0] or 0, len(r[1] or "")) for r in odd_rows())
    order = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    shas = sorted(hashlib.sha256(parsing.edited(a[1] or "", b[1] or "").encode()).hexdigest()
                  for a, b in zip(order, [*order[1:], order[0]]))
    assert sorted(r.edited_sha256 for r in found) == shas
    assert parsing.compare_with_next(empty).count() == 0
    assert len({r.fingerprint for r in parsing.fingerprints(odd).where("id in (4, 5)").collect()}) == 1


def brute_simhash(text, wide=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    wide = min(wide, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k:k + wide]).encode(), seed=42) for k in
              range(len(words) - wide + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, marks, radius):
    root = list(range(len(ids)))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in range(len(ids)):
        for b in range(a):
            if (marks[a] ^ marks[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    groups = {}
    for n, i in enumerate(ids):
        groups.setdefault(find(n), []).append(i)
    return [min((i for i in groups[find(n)] if i is not None), default=None) for n in range(len(ids))]


def test_simhash_query_matches_brute_force(spark, documents):
    found = QUERIES["op2_simhash"](spark, SF).toPandas().sort_values("doc_id")
    marks = [brute_simhash(t) for t in documents.text]
    assert found.fingerprint.tolist() == [f"{m:016x}" for m in marks]
    assert found.component_id.tolist() == brute_components(documents.doc_id.tolist(), marks, 4)


def test_simhash_divides_large_groups_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE_GROUP", 16)
    random = np.random.default_rng(3)
    centres = random.integers(0, 1 << 62, 3)
    points = {int(c) ^ sum(1 << int(b) for b in random.choice(62, random.integers(0, 7), replace=False))
              for c in centres for _ in range(120)} | {int(x) for x in random.integers(0, 1 << 62, 200)}
    points = sorted(points)
    links = simhash.near_links(spark.createDataFrame([(p,) for p in points], "fp long"), 4)
    roots = {r.node: r.root for r in components(links, "a", "b").collect()}
    assert [roots.get(p, p) for p in points] == brute_components(points, points, 4)


def test_components_of_chains_and_stars(spark):
    links = [(n, n + 1) for n in range(300)] + [(1000, n) for n in range(1001, 1100)] + [(5, 5), (7, 6)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert found == {n: 0 for n in range(301)} | {n: 1000 for n in range(1000, 1100)}


def test_simhash_of_odd_rows(spark, odd, empty):
    rows = odd_rows()
    marks = [brute_simhash(r[1]) for r in rows]
    want = brute_components([r[0] for r in rows], marks, 4)
    found = simhash.near_groups(odd).collect()
    assert sorted((str(r.id), r.fp % (1 << 64), str(r.component_id)) for r in found) == sorted(
        (str(r[0]), m, str(c)) for r, m, c in zip(rows, marks, want))
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len({(c, m) if i is None else c for i, m, c in zip([r[0] for r in rows], marks, [
        min(m2 for m2, c2 in zip(marks, _roots(marks)) if c2 == c) for c in _roots(marks)])})
    assert simhash.near_groups(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def _roots(marks):
    return brute_components(marks, marks, 4)
