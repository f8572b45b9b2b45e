"""Strings, posting blocks, the keyword index and its searches."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from casefile.functions import strings
from casefile.plans import inspect
from casefile.search import contents, index, lookup, postings
from tests.conftest import make_evidence

PIECES = st.lists(st.sampled_from([b"ab", b"\t x", b"word", b"w\0i\0d\0e\0", b"x\0", b"\0", b"\n", b"\x7f", b"\xc3\xa9"]),
                  max_size=14).map(b"".join)


def brute(data, least=4, longest=1 << 20):
    """Runs character by character."""
    def good(b):
        return 0x20 <= b <= 0x7E or b == 9

    out = []
    for step, begins in ((1, [0]), (2, [0, 1])):
        for at in begins:
            while at < len(data):
                end = at
                while end < len(data) and good(data[end]) and (step == 1 or data[end + 1:end + 2] == b"\0"):
                    end += step
                if (end - at) // step >= least:
                    out += strings.pieces(at, data[at:end:step].decode(), step == 2, longest)
                at = end + step
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(PIECES, st.sampled_from([1, 3, 4]), st.sampled_from([1, 3, 1 << 20]))
def test_strings_equal_brute_force(data, least, longest):
    assert sorted(strings.strings_of(data, least, longest)) == brute(data, least, longest)


@settings(max_examples=150, deadline=None)
@given(PIECES, st.sampled_from([1, 4]), st.sampled_from([2, 1 << 20]))
def test_a_seam_at_any_position_changes_nothing(data, least, longest):
    want = sorted(strings.strings_of(data, least, longest))
    scanner = strings.RunScanner(least, longest)
    for cut in range(len(data) + 1):
        found = scanner.feed(data[:cut]) + scanner.feed(data[cut:]) + scanner.close()
        assert sorted(found) == want
    found = [s for n in range(len(data)) for s in scanner.feed(data[n:n + 1])] + scanner.close()
    assert sorted(found) == want


def test_a_long_run_is_given_in_pieces():
    scanner = strings.RunScanner(longest=10)
    found = [s for _ in range(7) for s in scanner.feed(b"abcde")]
    assert len(found) == 3 and len(scanner.open_ascii) < 10  # held back: less than a piece
    found += scanner.close()
    assert [s[0] for s in found] == [0, 10, 20, 30] and "".join(s[2] for s in found) == "abcde" * 7


def test_files_are_read_in_chunks(spark, tmp_path):
    data = b"\0one string\n" + "wide string".encode("utf-16le") + b"\n\nanother one" + b"\xff" * 9 + b"abc"
    (tmp_path / "f").write_bytes(data)
    (tmp_path / "empty").write_bytes(b"")
    listing = spark.createDataFrame([(str(tmp_path / n),) for n in ("f", "empty")], "path string")
    for chunk in (1, 2, 5, 1 << 20):
        found = contents.strings_of_files(listing, chunk_bytes=chunk).collect()
        assert sorted((r.offset, r.encoding, r.text) for r in found) == brute(data)


def test_sources_of_strings(spark):
    """Inline content gives way to an external file; of equal names the largest path wins."""
    evidence = make_evidence(spark, [{"id": "a", "file_content": b"inline a"}, {"id": "b", "file_content": b"inline b"},
                                     {"id": "c", "file_content": b""}, {"id": "d"}])
    store = spark.createDataFrame([("/x/1/b", 7, b"first b"), ("/x/2/b", 8, b"second b"), ("/x/e", 6, b"orphan"),
                                   ("/x/f", 0, b"")], "path string, length long, content binary")
    found = contents.content_strings(evidence, store).collect()
    assert sorted((r.id, r.text) for r in found) == [("a", "inline a"), ("b", "second b"), ("e", "orphan")]
    assert contents.content_strings(evidence).count() == 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1 << 62), max_size=30))
def test_numbers_round_trip(values):
    raw, ends = postings.pack_numbers(np.array(values, np.int64))
    assert postings.unpack_numbers(raw.tobytes()).tolist() == values
    assert np.diff(ends, prepend=0).tolist() == [max(1, -(-v.bit_length() // 7)) for v in values]


def words_of(data):
    """(term, position) of a content, string by string."""
    out = []
    for n, (_, _, text) in enumerate(strings.strings_of(data)):
        out += [(w, len(out) + k + n) for k, w in enumerate(re.findall("[0-9a-z]+", text.lower()))]
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"The cat", b" sat", b"\n", b"\xc3\xa9", b"a1-b2", b"w\0i\0 \0d\0e\0", b"\0"]),
                         max_size=9).map(b"".join), max_size=5))
def test_terms_equal_brute_force(files):
    file, code, position, words, n_terms = postings.terms_of(files)
    found = [[] for _ in files]
    for f, c, p in zip(file, code, position):
        found[f].append((words[c], p))
    assert [sorted(x) for x in found] == [sorted(words_of(x)) for x in files]
    assert n_terms.tolist() == [len(words_of(x)) for x in files]


@pytest.fixture(scope="module")
def files():
    rng = random.Random(7)
    vocabulary = ["the"] * 8 + ["of", "and", "cat"] * 2 + [f"w{n}" for n in range(40)]
    made = {}
    for n in range(400):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 25)))
        made[f"f{n:03d}"] = text.replace(" cat", "\ncat").encode()
    made["none"] = b"\0\0"
    made["rare"] = b"needle in the haystack"
    return made


@pytest.fixture(scope="module")
def made_index(spark, files, tmp_path_factory):
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "id string, content binary").repartition(5)
    return index.write_index(index.file_terms(rows), str(tmp_path_factory.mktemp("index") / "i"), buckets=16, block=7)


def test_blocks_decode_to_the_postings(made_index, files):
    rows = index.decode(made_index.blocks()).join(made_index.documents(), "doc_no").collect()
    found = {(r.term, r.id): list(r.positions) for r in rows}
    want = {}
    for name, data in files.items():
        for w, p in words_of(data):
            want.setdefault((w, name), []).append(p)
    assert found == want and len(rows) == len(want) and all(r["count"] == len(r.positions) for r in rows)
    lengths = {r.id: r.n_terms for r in made_index.documents().collect()}
    assert lengths == {name: len(words_of(data)) for name, data in files.items()}


def test_blocks_are_full_and_a_frequent_term_is_split(spark, tmp_path):
    rows = spark.range(500).selectExpr("cast(id as string) id", "cast(concat('the only file ', id) as binary) content")
    made = index.write_index(index.file_terms(rows.repartition(3)), str(tmp_path / "i"), buckets=4, block=7)
    rows = sorted(made.blocks(["the"]).collect(), key=lambda r: r.first_doc)
    assert sum(r.n_postings for r in rows) == 500 and max(r.n_postings for r in rows) == 7
    assert all(a.last_doc < b.first_doc for a, b in zip(rows, rows[1:]))
    files = {r.path for r in made.blocks(["the"]).selectExpr("_metadata.file_path as path").collect()}
    assert len(files) > 1  # several tasks wrote this term
    assert sum(r.n_postings < 7 for r in rows) <= len(files)


def test_search_all_and_phrase(made_index, files):
    said = {name: [strings_ for _, _, strings_ in strings.strings_of(data)] for name, data in files.items()}
    for text in ("the", "the of", "and cat w3", "needle", "w1 w2 w3", "absent the", "THE Of"):
        want = {n for n, d in files.items() if set(lookup.terms_in(text)) <= {w for w, _ in words_of(d)}}
        assert {r.id for r in lookup.search_all(made_index, text).collect()} == want
    for text in ("the of", "the the", "the the the", "in the haystack", "of the and", "needle haystack", "absent the"):
        asked = lookup.terms_in(text)
        want = {}
        for name, runs in said.items():
            for run in runs:
                ws = re.findall("[0-9a-z]+", run.lower())
                n = sum(ws[k:k + len(asked)] == asked for k in range(len(ws)))
                if n:
                    want[name] = want.get(name, 0) + n
        assert {r.id: r.n_hits for r in lookup.search_phrase(made_index, text).collect()} == want
    with pytest.raises(ValueError):
        lookup.search_all(made_index, "--")


def test_only_blocks_in_question_are_decoded(made_index):
    every = made_index.blocks(["the"]).count()
    statistics = lookup._statistics(made_index, ["the"])["the"]
    needle = index.decode(made_index.blocks(["needle"])).select("doc_no")
    chosen = lookup.blocks_of_candidates(made_index, "the", statistics, needle).collect()
    (at,) = [r.doc_no for r in needle.collect()]
    assert every > 30 and len(chosen) == 1 and chosen[0].first_doc <= at <= chosen[0].last_doc
    far = needle.selectExpr("doc_no + 1000000 as doc_no")
    assert lookup.blocks_of_candidates(made_index, "the", statistics, far).count() == 0


def test_only_the_terms_buckets_are_read(made_index):
    plan = made_index.blocks(["needle"])
    scan = next(n for n in inspect.plan_nodes(plan) if n.nodeName().startswith("Scan"))
    assert "bucket" in scan.metadata().get("PartitionFilters").get()
    assert "term" in scan.metadata().get("PushedFilters").get()
    read = {r.path for r in plan.selectExpr("_metadata.file_path as path").collect()}
    bucket = index.bucket_of("needle", made_index.buckets)
    assert read and all(f"/bucket={bucket}/" in p for p in read)
    plan.collect()
    assert scan.metrics().get("numFiles").get().value() <= len(made_index.blocks().where(f"bucket = {bucket}")
                                                              .selectExpr("_metadata.file_path as p").distinct().collect())


def bm25(files, text):
    words = {n: [w for w, _ in words_of(d)] for n, d in files.items()}
    mean = sum(map(len, words.values())) / len(words)
    scores = {}
    for term in dict.fromkeys(lookup.terms_in(text)):
        df = sum(term in ws for ws in words.values())
        for name, ws in words.items():
            tf = ws.count(term)
            if tf:
                idf = np.log(1 + (len(words) - df + .5) / (df + .5))
                scores[name] = scores.get(name, 0) + idf * tf * 2.2 / (tf + 1.2 * (.25 + .75 * len(ws) / mean))
    return sorted(((-round(s, 6), n) for n, s in scores.items()))


def test_ranked_search(made_index, files):
    asked = ["the", "needle the", "w1 w2 w2", "absent", "of and cat w7 w8"]
    found = lookup.search_ranked(made_index, asked, 5)
    # each task keeps its best k before the shuffle
    assert "WindowGroupLimit" in [n.nodeName() for n in inspect.plan_nodes(found)]
    rows = found.collect()
    for n, text in enumerate(asked):
        mine = sorted((r["rank"], r.id, r.score) for r in rows if r.query == n)
        assert mine == [(k + 1, name, -s) for k, (s, name) in enumerate(bm25(files, text)[:5])]


def test_an_index_of_nothing(spark, tmp_path):
    rows = spark.createDataFrame([], "id string, content binary")
    made = index.write_index(index.file_terms(rows), str(tmp_path / "i"))
    assert made.documents().count() == 0 and made.blocks().count() == 0
    assert lookup.search_all(made, "the").count() == 0 and lookup.search_phrase(made, "a b").count() == 0
    assert lookup.search_ranked(made, ["the"]).count() == 0

def test_summaries_of_postings(made_index, files):
    rows = index.summaries(made_index.blocks()).join(made_index.documents(), "doc_no").collect()
    want = {}
    for name, data in files.items():
        for w, p in words_of(data):
            want.setdefault((w, name), []).append(p)
    found = {(r.term, r.id): (r["count"], r.first_position, r.last_position, r.sum_positions) for r in rows}
    assert found == {k: (len(ps), min(ps), max(ps), sum(ps)) for k, ps in want.items()}
    nodes = [n.nodeName() for n in inspect.plan_nodes(index.summaries(made_index.blocks()))]
    assert not any("ExistingRDD" in n for n in nodes)


def test_tables_are_listed_once(made_index):
    made = index.Index(made_index.spark, made_index.path, made_index.buckets)
    made.blocks(["the"]).count()
    jobs = made_index.spark.sparkContext.statusTracker()
    made_index.spark.sparkContext.setJobGroup("listed-once", "")
    made.blocks(["needle"])  # planned anew: no job that lists the buckets
    made.documents()
    made_index.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not jobs.getJobIdsForGroup("listed-once") and made._blocks is made._blocks


def test_ranked_search_starts_no_workers_for_its_words(made_index):
    for texts in (["the", "needle"], ["absent"]):
        found = lookup.search_ranked(made_index, texts, 3)
        found.collect()
        assert not any("ExistingRDD" in n.nodeName() for n in inspect.plan_nodes(found))


@pytest.mark.parametrize("search", [lookup.search_all, lookup.search_phrase])
def test_an_absent_word_starts_no_workers(made_index, search):
    found = search(made_index, "the absent")
    assert found.collect() == []
    assert not any("ExistingRDD" in n.nodeName() for n in inspect.plan_nodes(found))


def test_batches_are_bounded_by_all_their_columns():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a"] * 10), pa.array([b"x" * 100] * 10)], names=["names", "positions"])
    parts = list(contents.by_bytes(iter([batch]), "names", "positions", limit=250))
    assert [p.num_rows for p in parts] == [2] * 5


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("0z9a", max_size=8), max_size=12))
def test_leads_order_like_terms(terms):
    import pyarrow as pa

    lead = postings.leads(pa.array(terms, pa.string()), 5).tolist()
    assert sorted(terms) == [t for _, t in sorted(zip(lead, terms))]
    assert all(x < 1 << 40 for x in lead)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=30))
def test_grouped_is_a_stable_order(keys):
    want = sorted(range(len(keys)), key=lambda n: keys[n])
    for n_keys in (7, 1 << 61):
        assert postings.grouped(np.array(keys, np.int64), n_keys).tolist() == want
