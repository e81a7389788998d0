import html
import random
import re
import time

import numpy as np
import pytest

from voxframe.llm import extraction as X
from voxframe.llm.q_extraction import op7_extraction


def article(page):
    """The main text of the synthetic pages, which have one article of headings and paragraphs."""
    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    parts = (" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(p for p in parts if p)


def test_query_against_page_structure(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = op7_extraction(spark, sf_dir).collect()
    assert {r.page_id for r in got} == pages.keys()
    for r in got:
        assert r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_held_out_accuracy():
    model, rng = X.built_in_model(), random.Random(31337)
    right = total = 0
    for _ in range(120):
        page, marks = X.labelled_page(rng)
        found = X.blocks(page)
        right += (model.decode(X.features(found, [len(found)]), np.array([len(found)])) == np.array(marks)).sum()
        total += len(marks)
    assert right / total > 0.97


def extract_one(page):
    found = X.blocks(page)
    label = X.built_in_model().decode(X.features(found, [len(found)]), np.array([len(found)]))
    return "\n".join(b[0] for b, k in zip(found, label) if k)


BODY = "".join(f"<p>Paragraph number {k} tells a story of some length, with commas, and it ends here.</p>" for k in range(5))
STORY = "\n".join(f"Paragraph number {k} tells a story of some length, with commas, and it ends here." for k in range(5))


@pytest.mark.parametrize(
    "around",
    [
        "<nav><a href=/>Home</a><a href=/n>News</a></nav>{}<footer>&copy; 2024 site</footer>",
        "<header><h1>Site</h1><p>A slogan for you</p></header>{}<aside><h3>Related</h3><p>Other story of the day</p></aside>",
        '<div class="cookie-notice"><p>We use cookies to give you the best experience.</p></div>{}<div class="ad">Buy now and save money today.</div>',
        '{}<section class="comments"><h2>Comments</h2><div class="comment"><p>I liked this story a lot, thank you for it.</p></div></section>',
        '{}<form><label>Mail</label><input name=m><button>Send</button></form><div class="sidebar"><ul><li><a href=/x>Most read story</a></li></ul></div>',
    ],
)
def test_what_surrounds_the_article_goes(around):
    page = "<html><head><title>T</title><script>var a = '<p>no</p>'</script></head><body>" + around.format(f"<article><h1>Title of it</h1>{BODY}</article>") + "</body></html>"
    assert extract_one(page) == "Title of it\n" + STORY


def test_blocks_of_odd_markup():
    text = lambda page: [b[0] for b in X.blocks(page)]
    assert text("a  b\n\tc") == ["a b c"]
    assert text("<p>one<p>two</b></p></div>three") == ["one", "two", "three"]
    assert text("x &lt;b&gt; &eacute;&#233;&amp;amp; &am") == ["x <b> éé&amp; &am"]
    assert text("<ul><li>a<li>b <i>c</i>d</ul>") == ["a", "b cd"]
    assert text("<!-- x <p>no --><p>y<!-- z") == ["y"]
    assert text("<SCRIPT>if (a<b) x('</p>')</SCRIPT>t<style>p</style>") == ["t"]
    assert text('<p title="a>b">c</p>1 < 2 <br>3') == ["c", "1 < 2 3"]
    assert text("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert text("") == [] and text("<p></p><div> </div>") == []
    nested = X.blocks("<article><div class=comments><p>x</p></div><p>y</p></article>")
    assert nested[0][1] >> 24 & 1 and not nested[1][1] >> 24 & 1


def test_edge_cases(spark):
    long_ = "<article>" + "<p>Some words of a long story that goes on.</p>" * 20000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>x</p>"), (3, "u", long_), (3, "u", long_), (4, "u", "<<<>>" * 99), (5, "u", "<a" * 3000), (6, "u", "plain text and no tags")]
    df = spark.createDataFrame([(*r, "t", "k") for r in rows], "page_id long, url string, html string, text string, label string")
    got = X.extract(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == "" and by[3].count("\n") == 19999
    assert X.extract(df.where("1 = 0")).count() == 0


def test_labels_must_fit_the_blocks():
    with pytest.raises(ValueError):
        X.train([("<p>a</p>", [1, 0])])


@pytest.mark.parametrize("tag", ["div", "section"])
@pytest.mark.parametrize("word", ["sidebar", "comment", "ad"])
def test_long_names_count(tag, word):
    long_ = " ".join(f"px-{k} md:w-{k}" for k in range(40))
    body = lambda names: f'<{tag} class="{names}"><p>Some words that stand beside the story, and they end here.</p></{tag}>'
    short, wide, last = (X.blocks(body(n))[0][1] for n in (word, f"{word} {long_}", f"{long_} {word}"))
    assert len(long_) >= 200 and wide == last == short != 0
    page = f"<html><body><article><h1>Title of it</h1>{BODY}</article>{body(f'{word} {long_}')}</body></html>"
    assert extract_one(page) == "Title of it\n" + STORY


def test_only_raw_text_and_hidden_content_is_skipped():
    text = lambda page: [b[0] for b in X.blocks(page)]
    assert text("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>") == ["so x=2 holds"]
    assert text("<object data=a><p>fallback</p></object><canvas>drawn</canvas>") == ["fallback", "drawn"]
    assert text("<p>a<svg><title>icon</title><text>label</text></svg>b</p>") == ["ab"]
    assert text("<p>a<template><div>t</div></template>b<noscript><p>n</p></noscript>c</p>") == ["abc"]
    assert text("<p>a<svg><foreignObject><div>f</div></foreignObject></svg>b</p>") == ["ab"]
    assert text("<p>a<svg/>b</p>") == ["ab"]
    assert text("a<script>var x = 1") == ["a"]


@pytest.mark.parametrize("tag", ["object", "canvas", "math", "svg", "template", "noscript"])
def test_what_is_not_closed_does_not_end_the_page(tag):
    text = lambda page: [b[0] for b in X.blocks(page)]
    assert text(f"<div><p>a</p><{tag}></div><p>b</p><p>c</p>") == ["a", "b", "c"]
    assert text(f"<div><{tag}><p>in</p></div><p>b</p>") == (["b"] if tag in ("template", "noscript") else ["in", "b"])
    assert text(f"<p>a</p><{tag}><p>b<p>c") == ["a", "b", "c"]
    assert text(f"<{tag}>a<{tag}>b") == ["ab"] and text(f"a<{tag}>") == ["a"]
    page = f"<html><body><article><h1>Title of it</h1><div><{tag}></div>{BODY}</article><footer>&copy; 2024 site</footer></body></html>"
    assert extract_one(page) == "Title of it\n" + STORY


def test_many_unclosed_elements_take_linear_time():
    import time

    start = time.monotonic()
    for tag in ("svg", "template", "noscript"):
        assert X.blocks(f"<{tag}>" * 50_000 + "x")[0][0] == "x"
    assert time.monotonic() - start < 20


P1 = "The harbour was quiet when the first boats came in, and nobody on the pier spoke of the storm."
P2 = "By noon the market had opened; fishermen sold what they had, and the rest went to the smokehouse."
HAND_WRITTEN = [
    # a plain old page without classes
    (f"<html><head><title>t</title></head><body><p>{P1}<p>{P2}</body></html>", f"{P1}\n{P2}"),
    # utility classes of any length around a marked article
    (f"<body><div class='{'x1 ' * 90}sidebar'><p>Most read</p><p>Ten boats</p></div><article class='{'p-4 ' * 90}'><h1>Harbour news</h1><p>{P1}</p><p>{P2}</p></article></body>", f"Harbour news\n{P1}\n{P2}"),
    # menus and a footer in lists, comments below
    (f"<body><nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul></nav><main><h1>Harbour news</h1><p>{P1}</p><ul><li>three boats</li><li>two crews</li></ul><p>{P2}</p></main><section class='comments'><h2>Comments</h2><div class='comment'><p>I was there too.</p></div></section><footer><p>&copy; 2020 Harbour Post. All rights reserved.</p></footer></body>", f"Harbour news\n{P1}\nthree boats\ntwo crews\n{P2}"),
    # a consent box and a form inside the article's wrapper
    (f"<body><div id='content'><h1>Harbour news</h1><p>{P1}</p><div class='cookie-banner'><p>We use cookies.</p><button>Accept</button></div><form class='newsletter'><label>Subscribe</label><button>Go</button></form><p>{P2}</p></div></body>", f"Harbour news\n{P1}\n{P2}"),
]


def test_pages_written_by_hand():
    model = X.built_in_model()
    for html, want in HAND_WRITTEN:
        found = X.blocks(html)
        label = model.decode(X.features(found, [len(found)]), np.array([len(found)]))
        assert "\n".join(b[0] for b, k in zip(found, label) if k) == want


def test_a_word_of_the_site_in_a_long_paragraph_does_not_lose_it():
    """Paragraphs of every length, at both sides of any bound, with a word like those of notices in them."""
    model = X.built_in_model()
    for n in (1, 3, 4, 5, 8, 30):
        body = " ".join([P1, P2] * n) + " The council asked for comments and would share the answers."
        found = X.blocks(f"<body><article><h1>Harbour news</h1><p>{body}</p><p>{P2}</p></article></body>")
        assert model.decode(X.features(found, [len(found)]), np.array([len(found)])).tolist() == [1, 1, 1]


def test_deep_pages_take_time_in_proportion_to_their_length():
    n = 60_000  # searching the open elements for each end tag would take minutes
    for page in ("<div>" * n + "</section>x" * n, "<div>" * n + "<svg>" + "</section>" * n, "<td><table>" + "<div>" * n + "<td></td>x" * n):
        begin = time.monotonic()
        X.blocks(page)
        assert time.monotonic() - begin < 20
