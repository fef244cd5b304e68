import itertools
import re
from html import unescape
from pathlib import Path

import numpy as np
import pytest

from wardspark.llm import html_text
from wardspark.llm.dom import Page

SF = Path("/root/testdata/sf0.01")


def test_marginals_against_all_states():
    r = np.random.default_rng(1)
    model = html_text.Model(r.normal(size=html_text.BUCKETS), r.normal(size=(2, 2, 2)))
    page = Page("<body><nav><a href=x>menu</a></nav><article><h1>t</h1><p>one two</p></article></body>")
    forest = html_text.Forest([page])
    marginal, both = forest.messages(model)
    n, total, sums, pairs = len(page.parent), 0.0, np.zeros(len(page.parent)), np.zeros((len(page.parent), 2, 2))
    own = [sum(model.weights[html_text.bucket(f, {})] for f in fs) for fs in page.features]
    for states in itertools.product((0, 1), repeat=n):
        x = sum(own[i] * states[i] for i in range(n))
        x += sum(model.edges[int(page.text[i] is not None), states[page.parent[i]], states[i]] for i in range(1, n))
        p = np.exp(x)
        total += p
        sums += p * np.array(states)
        for i in range(1, n):
            pairs[i, states[page.parent[i]], states[i]] += p
    assert np.allclose(marginal, sums / total)
    assert np.allclose(both[1:], pairs[1:] / total)


def blocks(source):
    return [t for t in Page(source).text if t]


def test_reading():
    assert blocks("<p>a<br>b  &amp; c&copy <b>d</b>e<p>f<script>x='<p>no</p>'</script>g") == ["a b & c© de", "fg"]
    assert blocks("<!-- <p>no --><ul><li>x<li>y</ul>z < 3 <td title='a>b'>q") == ["x", "y", "z < 3", "q"]
    assert blocks("<p>open <b>bold<p>next</b> more</div></p>end") == ["open bold", "next more", "end"]
    assert blocks("") == blocks("<html><head><title>t</title><style>s") == blocks("<p> \n&nbsp;</p>") == []
    assert blocks("<textarea>no</textarea>a<style>b") == ["a"]


def test_only_raw_text_is_skipped():
    assert blocks("<datalist><option value=a><option value=b></datalist><article><p>all of it</article>") == ["all of it"]
    for tag in ("option", "select", "object", "svg", "math", "iframe", "noscript", "template", "xmp"):
        assert blocks(f"<div><{tag}><p>the rest</p><p>of it</p>") == ["the rest", "of it"], tag
        assert blocks(f"<div><{tag}>a<{tag}>b</{tag}>c</{tag}><p>d</p></div><p>e") [-2:] == ["d", "e"], tag
        assert "".join(blocks(f"<div><{tag}>a<{tag}>b</{tag}>c</{tag}><p>d</p></div>")) == "abcd", tag
    assert blocks("<p>if <math><mi>x</mi><mo>=</mo><mn>1</mn></math> <svg><g><path d=x /><text>then</text></g></svg> so") == ["if x=1 then so"]
    assert blocks("<p>a<noscript><img src=x></noscript>b<object data=x>c</object></p>d") == ["abc", "d"]
    assert blocks("<select><option>a<option>b<optgroup label=x><option>c</select>d") == ["a", "b", "c", "d"]
    assert blocks("<p>a<select><option>b</select>c<p>d") == ["a", "b", "c", "d"]


def article_of(source):
    found = re.search(r"<article>(.*?)(</article>|\Z)", source, re.S)
    parts = re.split(r"</?(?:h1|p)>", found[1] if found else "")
    texts = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>?", "", p))).strip() for p in parts]
    return "\n".join(t for t in texts if t)


@pytest.fixture(scope="module")
def pages(spark):
    if not SF.exists():
        pytest.skip("test tables not present")
    return spark.read.parquet(f"{SF}/pages.parquet")


@pytest.fixture(scope="module")
def model(pages):
    return html_text.train(pages)


def test_given_pages(pages, model):
    got = {r.page_id: r.text for r in html_text.extract(pages, model).collect()}
    assert got == {r.page_id: article_of(r.html) for r in pages.collect()}


LAYOUTS = [
    '<body><div id="header"><h1>Site</h1><a href=a>x</a></div><div class="content"><h2>Title here</h2><p>{0}</p><p>{1}</p></div><div class="sidebar"><h3>More</h3><ul><li><a href=q>l</a></li></ul></div><div class="comments"><p>{2}</p></div></body>',
    '<body><table><tr><td class="sidebar"><a href=a>x</a></td><td class="content"><p>{0}</p><blockquote>{1}</blockquote></td></tr></table><div class="cookie-banner">We use cookies<button>OK</button></div><footer>&copy; {2}</footer></body>',
    '<body><nav><ul><li><a href=a>x</a></li></ul></nav><main><p>{0}</p><aside class="ad">{2}</aside><p>{1}</p></main><form action=s><p>Sign up</p><input></form></body>',
]


def test_other_layouts(spark, model):
    text = ["The first of two paragraphs, which goes on for some while. It has sentences.", "Another long paragraph follows here, and it ends as well.", "Some other words that stand elsewhere, nobody asked for them."]
    frame = spark.createDataFrame([(n, None, s.format(*text)) for n, s in enumerate(LAYOUTS)], "page_id long, url string, html string")
    for r in html_text.extract(frame, model).collect():
        assert text[0] in r.text and text[1] in r.text and text[2] not in r.text
        assert not re.search("Site|More|cookies|Sign up|x", r.text.replace("text", ""))


def test_labelled_pages_are_learnt(model):
    made = html_text.Layouts(["Some words of a text, one after the other. More words.", "Short one.", "A third block with a few words in it, and more."], 99)
    right = total = 0
    for page, labels in (made.page() for _ in range(200)):
        marginal, _ = html_text.Forest([page]).messages(model)
        leaf = np.array([t is not None for t in page.text])
        right += int(((marginal >= 0.5) == labels)[leaf].sum())
        total += int(leaf.sum())
    assert right / total > 0.97


def test_odd_rows(spark, model):
    rows = [(1, None, None, "x"), (1, "u", "", ""), (None, None, "<div>" * 2000 + "deep", ""), (2, "u", "plain words", ""), (2, "u", "plain words", "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(frame, model).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(frame.limit(0), model).collect() == []
    assert html_text.train(frame.limit(0)).weights.any()


def test_sample_takes_copies_of_a_page_once(spark, monkeypatch):
    class Drawn(Exception):
        pass

    def stop(blocks, seed):
        raise Drawn(blocks)

    monkeypatch.setattr(html_text, "Layouts", stop)
    rows = [(n, None, f"<p>page {max(0, n - 60)}</p>") for n in range(70)]
    with pytest.raises(Drawn) as drawn:
        html_text.train(spark.createDataFrame(rows, "page_id long, url string, html string"), most=70)
    assert drawn.value.args[0] == sorted(f"page {n}" for n in range(10))


def test_a_slash_does_not_end_raw_text():
    from wardspark.llm.dom import Page

    def texts(source):
        return [t for t in Page(source).text if t]

    for tag in ("<script data-u=/a/>", "<script/>", '<script src="a"/>', "<script async />", "<style media=/x/>", "<textarea/>", "<title/>"):
        name = re.match(r"<([a-z]+)", tag)[1]
        assert texts(f"<p>one</p>{tag}var x=1;</{name}><p>two</p>") == ["one", "two"], tag
    assert texts("<p>a<svg><title/><path d=x /></svg>b</p><p>c</p>") == ["ab", "c"]
    assert texts("<p>a<svg><script href=/u/>x</script></svg>b</p>") == ["ab"]
