import random

import numpy as np
import pytest

from obsengine.llm import html

SCHEMA = "page_id long, url string, html string, text string"


@pytest.fixture(scope="module")
def model():
    return html.fitted(700)


def test_blocks_by_hand():
    page = "<head><title>t</title></head><p>A &amp;&lt;b&gt;\n  c<b>d</b>e<br>f<p>g<script>if (a</b>'</p>') x</script>h<!-- <p>no --><ul><li>i<li>j</ul>k<style>p{}</style> l < m &nbsp; n"
    assert [b.text for b in html.blocks(page)] == ["A &<b> cde f", "gh", "i", "j", "k l < m n"]
    assert [b.text for b in html.blocks("<table><tr><td>a</td> <td>b</td></tr><tr><td>c")] == ["a b", "c"]
    for broken in (None, "", "<", "<a href='x", "<!-- open", "<script>never ends", "</div></p>", "<p" * 2000, "<div>" * 3000 + "x"):
        html.blocks(broken)
    b = html.blocks("<div class='a'><p id=B-c>x")[0]
    assert b.tag == html.hashed("=p")
    want = 0
    for part in ("div", "div.a", ".a", "p", "p.b", ".b", "p.c", ".c"):
        want |= 1 << html.hashed(part)
    assert b.path == want


def test_head_may_stay_open_and_slashes_close():
    said = lambda page: [b.text for b in html.blocks(page)]
    for head in ("<head><title>x</title><style>p{}</style><body>", "<HEAD class=a>\n<meta charset=utf-8><title>x</title><script>if (a</b>'</p>') x</script>", "<head><title>x</title></head><body>"):
        assert said(f"<html>{head}<article><p>One.</p><p>Two.</p></article>") == ["One.", "Two."]
    for own in ("<svg/>", "<svg />", "<math class='a>b' hidden/>", '<svg a="/"\n/>', "<svg a=b/c />", "<svg a=b/>no</svg>", "<svg><path d='x'/><title>no</title></svg>", "<math><mi/>no</math>"):
        assert said(f"<p>One {own} two.</p><p>Three.</p>") == ["One two.", "Three."]


def test_unseen_elements_take_their_own_content_alone():
    said = lambda page: [b.text for b in html.blocks(page)]
    for name in ("svg-icon", "video-player", "template-x", "head-line", "math-inline", "iframe-lite", "style-guide", "scripted"):
        assert said(f"<{name} a=b>One</{name}><p>Two.</p>") == ["One", "Two."]
        assert said(f"<{name}><p>Two.</p>") == ["Two."]
    for name in ("template", "noscript", "svg", "object", "select", "title", "iframe", "textarea"):
        assert said(f"<p>One.</p><{name}><p>no</p></{name}><p>Two.</p>") == ["One.", "Two."]
        assert said(f"<p>One.</p><{name}>no <{name} class='x>y'>no</{name}> no</{name}><p>Two.</p>") == ["One.", "Two."]
        assert said(f"<p>One.</p><{name}><p>Two.</p>") == ["One.", "Two."]  # nothing closes it
        assert said(f"<p>One.</p></{name}><p>Two.</p>") == ["One.", "Two."]
    assert said("<template>no<script>'<template>'</script>no<!-- <template> --></template><p>Two.") == ["Two."]
    assert said("<p>One.<!-- > no") == said("<p>One.<script>if (a > b) no") == ["One."]
    assert said("<p>One.</p>Two <a" + " <a b" * 200000)[0] == "One."
    assert said("<script>a</script x><p>One.<style>p{}") == ["One."]


def test_long_pages_in_stretches(model):
    page = html.blocks("".join(html.training_page(random.Random(i))[0] for i in range(15)))
    at_once = model.label([html.features(page)])[0]
    assert np.allclose(model.label_blocks(page, 17), at_once, atol=1e-4)
    assert len(html.blocks("<div>" * 5000 + "<p>x" * 20000)) == 20000
    assert [len(g) for g in html.grouped(["a" * 10, None, "b" * 50, "c"] * 2, 3, 40)] == [3, 3, 1, 1]


# pages written by hand, not by the generator; what a reader would call the article is marked by stars
PAGES = [
    """<html><head><title>Bread</title></head><body><div id="top-nav"><a href="/">Home</a> <a href="/r">Recipes</a> <a href="/a">About us</a></div>
<article class="recipe"><h1>*Bread without kneading*</h1><p>*Mix the flour, the salt and the yeast in a large bowl, then stir in the water until no dry flour is left.*</p>
<p>*Cover the bowl and leave it for eighteen hours at room temperature. The surface should be dotted with bubbles by then.*</p><h2>*Baking*</h2><p>*Heat the oven with a heavy pot in it. Turn the dough into the hot pot, cover it and bake for half an hour.*</p></article>
<div class="comments"><h3>2 comments</h3><div class="comment"><p>Made this on Sunday, it was lovely!</p></div><div class="comment"><p>How much salt do you use?</p></div></div>
<footer><p>&copy; 2020 The Bread Site. All rights reserved.</p></footer></body></html>""",
    """<!doctype html><body class=page><header class="site-header"><div class=logo>The Valley Paper</div><nav><ul><li><a href=/n>News</a><li><a href=/s>Sport</a></ul></nav></header>
<div class="cookie-notice"><p>We use cookies to improve this site. <button>Accept</button></p></div><main><div class="post-body"><h1>*Bridge over the Arn to reopen in May*</h1>
<p>*The old stone bridge will open to walkers again on the first of May, the council said on Monday, two years after the flood.*<p>*Repairs cost more than planned because the middle pier had to be rebuilt from the river bed.*
<blockquote>*We wanted it to look as it did before, and I think it does.*</blockquote><p>*Cars will have to wait until autumn.*</div></main>
<aside class="sidebar"><h3>Most read</h3><ul><li><a href=/1>Bakery closes after ninety years</a><li><a href=/2>Choir wins prize</a></ul></aside><form class="newsletter"><label>Your email</label><input name=e><button>Subscribe</button></form>""",
    """<body><ul class="menu"><li><a href="a">Start</a></li><li><a href="b">Kontakt</a></li></ul><div class="content"><h1>*Der Garten im März*</h1><p>*Wenn der Boden nicht mehr gefroren ist, kann man die ersten Erbsen säen. Sie vertragen leichten Frost gut.*</p>
<p>*Obstbäume werden jetzt geschnitten, bevor die Knospen aufgehen. Ein scharfes Messer ist dabei wichtig.*</p></div><div class="ad-banner">Werbung: Gartenscheren jetzt günstig kaufen</div><div id="footer"><a href="i">Impressum</a> | <a href="d">Datenschutz</a></div></body>""",
]


def test_pages_by_hand(model):
    import re

    wrong = n = 0
    for page in PAGES:
        own = html.blocks(page)
        for b, p in zip(own, model.label([html.features(own)])[0], strict=True):
            n += 1
            wrong += (p >= 0.5) != bool(re.search(r"\*", b.text))
    assert n > 30 and wrong <= 2


def test_gradient_is_that_of_differences():
    rng = np.random.default_rng(0)
    pages = [(rng.standard_normal((n, 7)).astype(np.float32), (rng.random(n) < 0.5).astype(np.float32)) for n in (1, 4, 6)]
    small = html.train(pages, hidden=3, passes=200, batch=3, rate=0.03)
    x, mask = html.padded([p[0] for p in pages])
    z = small.states(x, mask)[0] @ small.out + small.bias
    for row, (_, y) in zip(z, pages, strict=True):
        assert ((row[: len(y)] > 0) == (y > 0)).all()  # it can learn any labels of a few blocks by heart


def test_padding_and_batches_change_nothing(model):
    pages = [html.features(html.blocks(html.training_page(random.Random(i))[0])) for i in range(12)] + [np.zeros((0, html.PATH + html.WORDS + html.MEASURES), np.float32)]
    together = model.label(pages)
    for p, q in zip(pages, together, strict=True):
        assert np.allclose(model.label([p])[0], q, atol=1e-4)


def test_held_out_pages(model):
    rng, right, n = random.Random(99), 0, 0
    for _ in range(150):
        x, y = html.labelled(*html.training_page(rng))
        if len(y):
            right += ((model.label([x])[0] >= 0.5) == (y > 0)).sum()
            n += len(y)
    assert right / n > 0.97


def test_table(spark, model):
    page = '<html><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="ad">Buy now.</div><article><h1>A title of words.</h1><p>First paragraph with some words in it.</p><p>Second &amp; last paragraph, with more words.</p></article><div class="comments"><p>I agree with this.</p></div><footer>&copy; someone</footer></body></html>'
    rows = [(1, "u", page, "clash"), (1, "u", page, ""), (2, None, None, ""), (3, "", "", ""), (None, "x", "<p>", "")]
    got = html.extract(spark.createDataFrame(rows, SCHEMA), model).collect()
    assert len(got) == 5
    for r in got:
        want = "A title of words.\nFirst paragraph with some words in it.\nSecond & last paragraph, with more words." if r.page_id == 1 else ""
        assert (r.text, r.n_chars) == (want, len(want))
    assert html.extract(spark.createDataFrame([], SCHEMA), model).collect() == []


def _shown(page: str) -> list[str]:
    return [b.text for b in html.blocks(page)]


@pytest.mark.parametrize(
    ("page", "shown"),
    [
        ("<p title=it's>Hello world</p><p>I don't know</p><p>more</p>", ["Hello world", "I don't know", "more"]),
        ('<p class="a"">Hello</p><p>a 5" screen</p><p>more</p>', ["Hello", 'a 5" screen', "more"]),
        ("<img alt=l'eau><p>Texte</p><p>l'autre</p><p>fin</p>", ["Texte", "l'autre", "fin"]),
        ("<p>x</p><!-->y<p>z</p>", ["x", "y", "z"]),
        ("<p>x</p><!--->y<p>z</p>", ["x", "y", "z"]),
        ("<p>x</p><!-- a --!>y<p>z</p>", ["x", "y", "z"]),
        ("<p a = 'x > y' b>one</p>", ["one"]),
        ('<p a=>one</p><p ="x>two</p><p>"three</p>', ["one", "two", '"three']),
        ("<script data-x=it's>no</script><p>yes</p>", ["yes"]),
        ("<svg a='1'/><p>one</p><svg a=b/>no</svg><p>two</p>", ["one", "two"]),
        ('<p a="x"b=\'>\'>one</p>', ["one"]),
    ],
)
def test_quotes_and_comments_as_browsers_have_them(page, shown):
    assert _shown(page) == shown


def test_mangled_pages_keep_their_text():
    """Against the standard library's parser: attributes with stray quotes, slashes and equals signs."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self) -> None:
            super().__init__()
            self.out: list[str] = []

        def handle_data(self, data: str) -> None:
            self.out.append(data)

    r = random.Random(11)
    parts = ["a", " b", " c=d", " e='f'", ' g="h>i"', " j=k'l", ' m=n"o', " p", " q=", " r = s", "'", '"', " /"]
    for _ in range(600):
        page = "".join(f"<p {''.join(r.choice(parts) for _ in range(r.randrange(5)))} z>w{i} it's 5\" \n</p>" for i in range(4))
        plain = Plain()
        plain.feed(page)
        plain.close()
        assert " ".join(_shown(page)).split() == "".join(plain.out).split(), page
