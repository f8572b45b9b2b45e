"""Blocks: formulas, elements that are never closed, and deep paths."""

import pytest

from casefile.llm.html_blocks import blocks


def test_formulas_are_text():
    assert [b[1] for b in blocks("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>")] == ["so x=2 holds"]
    assert [b[1] for b in blocks("<p>a <math><mi>x</mi> b</p><p>c</p>")] == ["a x b", "c"]


@pytest.mark.parametrize("tag", ["svg", "object", "canvas", "template"])
def test_an_element_without_an_end_tag_takes_no_article_text(tag):
    page = f"<p>one <{tag} class=icon><path d='M0'></p><p>two</p><div>three <{tag}>in</{tag}> four</div>"
    assert [b[1] for b in blocks(page)] == ["one", "two", "three four"]
    assert [b[1] for b in blocks(f"<p>a</p><{tag}><p>b</p>" * 300)] == ["a", "b"] * 300
    assert [b[1] for b in blocks(f"<p>a <{tag}>x<{tag}>y</{tag}>z</{tag}> b</p>")] == ["a b"]


@pytest.mark.parametrize("depth", [0, 15, 16, 17, 400])
def test_a_path_names_every_ancestor(depth):
    page = '<article class="story"><section id="comments">' + "<div class=wrap>" * depth + "text"
    (path, text, _), = blocks(page)
    assert text == "text" and {n for names in path for n in names} == {
        "article", ".story", "section", ".comments"} | ({"div", ".wrap"} if depth else set())
    assert len(path) <= 17 and path[-1][0] == ("div" if depth else "section")
    after = blocks(page + "</div>" * depth + "</section></article><p>end")[-1]
    assert after[:2] == ((("p",),), "end")
