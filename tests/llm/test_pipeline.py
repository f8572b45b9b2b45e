"""The corpus pipeline, against what its operators give on each stage's own input."""

import duckdb
import numpy as np

import corpus_pipeline
from casefile.llm import language_id, suffix_dedup
from casefile.llm.common import materialize
from casefile.llm.tokens import Encoder, public_tokenizer
from tests.llm.conftest import SF, odd_rows, utf8
from tests.llm.test_fingerprints import brute_components, brute_simhash
from tests.llm.test_mixing_packing import check_mix, check_places
from tests.llm.test_suffix_dedup import brute


def test_stages_on_the_documents(spark, documents):
    columns = documents.columns.tolist()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "SimHash near-dedup", "suffix-array dedup", "mixing sources",
                            "best-fit packing"]
    given = {r.doc_id: r.text for r in docs.collect()}

    known = materialize(stages["language ID"](spark, docs, SF), "test")
    assert known.columns == columns
    rejected = language_id.judge(list(given.values()), language_id.fit(docs))[2]
    here = {r.doc_id: r.text for r in known.collect()}
    assert here == {d: t for (d, t), bad in zip(given.items(), rejected) if not bad}

    ids = sorted(here)
    classes = brute_components(ids, [brute_simhash(here[d]) for d in ids], 4)
    distinct = materialize(stages["SimHash near-dedup"](spark, known, SF), "test")
    here = {r.doc_id: r.text for r in distinct.collect()}
    assert distinct.columns == columns and sorted(here) == sorted(set(classes))

    cut = materialize(stages["suffix-array dedup"](spark, distinct, SF), "test")
    assert cut.columns == columns
    texts = [utf8(t) for t in here.values()]
    want = {}
    for d, t, gone in zip(here, texts, brute(texts, 200)):
        edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).reshape(-1, 2).tolist()
        kept = suffix_dedup.cut(t, edges, True).decode()
        if kept or not t:
            want[d] = kept
    assert {r.doc_id: r.text for r in cut.collect()} == want
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    mixed = materialize(stages["mixing sources"](spark, cut, SF), "test")
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} <= set(want)

    rows = stages["best-fit packing"](spark, mixed, SF).collect()
    check_places(rows, 2048)
    coder = Encoder(public_tokenizer())
    assert sum(r.length for r in rows) == sum(len(coder._whole(r.text)) + 1 for r in mixed.collect())


def test_stages_on_odd_rows(spark, odd, empty):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, SF).columns == odd.columns
        stage(spark, odd, SF).count()
        assert stage(spark, empty, SF).count() == 0
    check_places(corpus_pipeline.STAGES[-1][1](spark, odd, SF).collect(), 2048)


def test_run_is_registered(spark):
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries()
    assert sum(name.startswith("op") for name in __spark_entry__.queries()) == 13
