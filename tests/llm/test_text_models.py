"""Operators 3 (block labeller) and 8 (language ID)."""

import zlib

import duckdb
import numpy as np
import pytest

from casefile.llm import html_layouts, html_lstm, language_id
from casefile.llm.html_blocks import blocks
from casefile.llm.queries import QUERIES
from tests.llm.conftest import SF, odd_rows


@pytest.fixture(scope="module")
def net():
    return html_lstm.trained()


def test_labeller_on_unseen_layouts(net):
    random = np.random.default_rng(12345)
    made = [html_layouts.page(random) for _ in range(120)]
    parsed = [blocks(source) for source, _ in made]
    right = total = 0
    for page, kept, (_, main) in zip(parsed, html_lstm.label(net, parsed), made):
        right += sum((b[1] in main) == bool(k) for b, k in zip(page, kept))
        total += len(page)
    assert right / total > 0.98


def test_query_gives_the_articles(spark, net):
    pages = duckdb.connect().execute(f"select page_id, url, html from '{SF}/pages.parquet' order by page_id").fetchall()
    found = {r.page_id: r for r in QUERIES["op3_html_lstm"](spark, SF).collect()}
    assert len(found) == len(pages)
    right = 0
    for page, url, source in pages:
        row = found[page]
        assert row.url == url and row.n_chars == len(row.text)
        want = "\n".join(b[1] for b in blocks(source) if any(n[0] == "article" for n in b[0]))
        right += row.text == want
        assert "track(" not in row.text and "&amp;" not in row.text
    assert right / len(pages) >= 0.96


def test_blocks():
    page = ("<!DOCTYPE html><head><title>T</title><script>var t='</p><p>';</script></head><body><!-- <p>no</p> -->"
            "<p>one &amp; two&nbsp;&#233;<br>three<p><b>four<br><p>five <i>six</i>seven</p><ul><li>a<li>b</ul>"
            "<div class='Main-Nav'>x < y</div><table><tr><td>1<td>2</table>last")
    assert [b[1] for b in blocks(page)] == ["one & two é three", "four", "five sixseven", "a", "b", "x < y", "1", "2",
                                            "last"]
    assert ("div", ".main", ".nav") in blocks(page)[5][0]
    assert blocks("") == [] and blocks("<p>") == [] and blocks("<script>x") == []
    assert blocks("<a href='/x'>abc</a> d")[0][1:] == ("abc d", 3)
    assert len(blocks("<div>" * 5000 + "deep")) == 1
    assert blocks('<p title="a > b">t</p>')[0][1] == "t" and blocks("<p title='a>t</p>")[0][1] == "t"


def test_pages_of_all_kinds(spark, net):
    rows = [(1, None, None, 7), (2, "u", "", 7), (3, "u", "<nav><a>x</a></nav>", 7), (None, "u", "<p>a b.</p>" * 3000, 7),
            (3, "u", "<nav><a>x</a></nav>", 7), (5, "u", "\x00 text <", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    found = html_lstm.extract(pages, net=net).collect()
    assert len(found) == 6
    assert [(r.text, r.n_chars) for r in found if r.page_id in (1, 2, 3)] == [("", 0)] * 4
    assert html_lstm.extract(pages.where("page_id = 99"), net=net).count() == 0


def test_language_query_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.01")
    rows = {d: (t, y) for d, t, y in duckdb.connect().execute(
        f"select doc_id, text, lang from '{sf}/documents.parquet'").fetchall()}
    found = QUERIES["op8_language_id"](spark, sf).collect()
    assert {r.doc_id for r in found} == set(rows) and len(found) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    assert np.mean([r.lang_pred == rows[r.doc_id][1] for r in held]) > 0.97
    assert np.mean([r.rejected for r in found]) < 0.02


def test_languages_not_learned_are_rejected(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    model = language_id.fit(docs)
    langs, score, rejected = language_id.judge(
        ["Καλημέρα κόσμε, πώς είστε σήμερα;", "Быстрая коричневая лиса прыгает", None, "", "12 # 34", "the of and thing"],
        model)
    assert rejected.tolist() == [True] * 5 + [False]
    assert langs[2:5] == ["und"] * 3 and score[2:5].tolist() == [0, 0, 0] and langs[5] == "en"
    again = language_id.fit(docs)
    assert np.array_equal(model.logits, again.logits) and model.reject_below == again.reject_below


def test_language_of_odd_rows(spark, odd, empty):
    model = language_id.fit(odd)
    found = language_id.predict(odd, model).collect()
    assert len(found) == len(odd_rows())
    for want in (None, "", " \t\n", "12 34 56 #### %%%%"):
        n = [r[1] for r in odd_rows()].index(want)
        assert [(r.lang_pred, r.score, r.rejected) for r in found if r.id == n] == [("und", 0.0, True)]
    assert language_id.accepted(odd, model).columns == odd.columns
    assert language_id.fit(empty) is None and language_id.predict(empty, None).count() == 0
    assert {r.lang_pred for r in language_id.predict(odd, None).collect()} == {"und"}
