"""HTML extraction: pages written and labelled by hand, block parsing and the chain's gradient by brute force."""

import itertools
import random

import numpy as np
import pytest

from quilt.llm import html_crf
from quilt.llm.html_blocks import Block, blocks

#: Family: (html, main text). Written by hand, apart from the generator of training pages.
LAYOUTS = {
    "news": (
        """<!DOCTYPE html><html lang="en"><head><title>Bridge reopens | Daily Courier</title><link rel="stylesheet" href="/a.css"></head><body>
<header class="site-header"><a href="/">Daily Courier</a><nav><ul><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li><li><a href="/w">Weather</a></li></ul></nav></header>
<main><article><h1>Bridge reopens after two years of repairs</h1><p>The old stone bridge over the river was opened to traffic again on Monday, after two years in which drivers had to take a detour of nine miles.</p>
<figure><img src="b.jpg" alt="The bridge"></figure><p>Engineers replaced four of its seven arches. &ldquo;It will stand for another century,&rdquo; the head of the works said.</p>
<aside class="related"><h3>Related</h3><ul><li><a href="/1">Tunnel plans shelved</a></li><li><a href="/2">Ferry fares up</a></li></ul></aside>
<p>The town council hopes that shops on the eastern bank, which lost a third of their customers, will now recover.</p></article></main>
<footer><p>&copy; 2023 Daily Courier. All rights reserved.</p><p><a href="/privacy">Privacy</a> <a href="/terms">Terms</a></p></footer></body></html>""",
        ["Bridge reopens after two years of repairs", "The old stone bridge over the river was opened to traffic again on Monday, after two years in which drivers had to take a detour of nine miles.", "Engineers replaced four of its seven arches. “It will stand for another century,” the head of the works said.", "The town council hopes that shops on the eastern bank, which lost a third of their customers, will now recover."],
    ),
    "blog": (
        """<html><body><div id="wrapper"><div id="top"><span>Kitchen notes</span></div><div class="menu"><a href="/">Home</a> <a href="/about">About</a> <a href="/archive">Archive</a></div>
<div class="post-content"><h1>How I bake rye bread</h1><p>Rye behaves quite unlike wheat: there is little gluten, so kneading does next to nothing, and the dough stays sticky.</p>
<p>Mix the sourdough the evening before, keep it somewhere warm, and add the salt only in the morning.<br>Then wait.</p><ul><li>500 g of whole rye flour.</li><li>400 g of water, lukewarm.</li></ul>
<blockquote><p>Bread needs time more than it needs work, my grandmother used to say.</p></blockquote></div>
<div class="share"><a href="#">Tweet</a> <a href="#">Pin it</a></div>
<div class="comments"><h3>2 comments</h3><div class="comment"><b>Ann</b><p>I tried it and it came out very well, thank you for sharing this.</p></div><div class="comment"><b>Joe</b><p>What about caraway?</p></div></div>
<div class="sidebar"><h4>Popular</h4><p>My ten best soups for cold winter days, with pictures.</p></div><div class="footer">Powered by flour</div></div></body></html>""",
        ["How I bake rye bread", "Rye behaves quite unlike wheat: there is little gluten, so kneading does next to nothing, and the dough stays sticky.", "Mix the sourdough the evening before, keep it somewhere warm, and add the salt only in the morning. Then wait.", "500 g of whole rye flour.", "400 g of water, lukewarm.", "Bread needs time more than it needs work, my grandmother used to say."],
    ),
    "docs": (
        """<!doctype html><html><body><div role="navigation" class="toc"><ol><li><a href="#a">Install</a></li><li><a href="#b">Configure</a></li></ol></div>
<main role="main"><section><h1>Installing the server</h1><p>Download the archive for your platform and unpack it into a folder that only the service account may write to.</p>
<pre>tar xf server.tar.gz
./server --init</pre><h2>Configuring ports</h2><p>The server listens on port 8080 unless the settings say otherwise; change this before the first start.</p>
<table><tr><td>port</td><td>8080</td></tr></table></section></main><div class="cookie-banner"><p>We use cookies to improve the manual. Accept?</p><button>Yes</button></div><footer>Version 4</footer></body></html>""",
        ["Installing the server", "Download the archive for your platform and unpack it into a folder that only the service account may write to.", "tar xf server.tar.gz ./server --init", "Configuring ports", "The server listens on port 8080 unless the settings say otherwise; change this before the first start.", "port", "8080"],
    ),
    "bare": (
        """<body><nav><a href=/>start</a> | <a href=/l>list</a></nav><h1>On the tides of the inner bay</h1><p>The tide comes in twice a day, though in the inner bay the second flood is hardly seen at all.
<p>Fishermen have known this for ages; only lately have gauges shown why. The two branches of the channel cancel out.
<p>A map of both is kept in the harbour office.<footer>Copyright 1999 Harbour society</footer></body>""",
        ["On the tides of the inner bay", "The tide comes in twice a day, though in the inner bay the second flood is hardly seen at all.", "Fishermen have known this for ages; only lately have gauges shown why. The two branches of the channel cancel out.", "A map of both is kept in the harbour office."],
    ),
    "broken": (
        """<div class=header>City library</div><article><h1>Opening hours in summer</h1><p>From June to August the reading room is open from ten to four.</p><svg width=9><path/></svg><p>On Sundays it stays closed.</p><select name=branch><option>North<option>South
<p>Loans are prolonged by two weeks, and no fees fall due.</p><video src=v.mp4><p>Returned books go into the box beside the door.</p></article><form><label>Search</label><input><select><option>All</select></form><div class="legal">Imprint</div>""",
        ["Opening hours in summer", "From June to August the reading room is open from ten to four.", "On Sundays it stays closed.", "Loans are prolonged by two weeks, and no fees fall due.", "Returned books go into the box beside the door."],
    ),
}


@pytest.mark.parametrize("family", LAYOUTS)
def test_pages_labelled_by_hand(family):
    html, want = LAYOUTS[family]
    got = html_crf.default_chain().extract(html).split("\n")
    hit = len(set(got) & set(want))
    score = 2 * hit / (len(got) + len(want))
    assert score >= 0.85, (family, score, [x for x in got if x not in want], [x for x in want if x not in got])


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<article><p>A</p><svg/><p>B</p></article>", ["A", "B"]),
        ("<article><p>A</p><svg><g><svg></svg></g>x</svg><p>B</p></article>", ["A", "B"]),
        ("<article><p>A</p><select><option>x<p>B</p></article><p>C</p>", ["A", "B", "C"]),
        ("<article><p>A<video src=x></p><p>B</p></article>", ["A", "B"]),
        ("<div><object><div>x</div></object>B</div>", ["B"]),
        ("<p>A</p><script>if (a<b) '</p>'</script><p>B</p>", ["A", "B"]),
        ("<p>x<y and z>w</p>", ["xw"]),
        ("<p>one <my-mark>two</my-mark> three</p>", ["one two three"]),
        ("<p>a &lt; b &amp;amp; c&nbsp;d</p>", ["a < b &amp; c d"]),
        ("<p>A</p></svg><p>B", ["A", "B"]),
        ("", []),
        (None, []),
    ],
)
def test_blocks_of_odd_markup(html, want):
    assert [b.text for b in blocks(html)] == want


def test_blocks_of_random_trees():
    """Well-formed pages: blocks are the text between the ends of block elements, in order."""
    rng = random.Random(2)

    def build(depth: int) -> tuple[str, list]:
        """Markup, and its text runs with None at block boundaries."""
        html, runs = "", []
        for _ in range(rng.randint(0, 4)):
            kind = rng.random()
            if kind < 0.45 or depth > 4:
                word = f"w{rng.randrange(1000)} "
                html, runs = html + word, [*runs, word]
            elif kind < 0.65:
                inner, own = build(5)
                tag = rng.choice(("b", "em", "span", "x-tag"))
                html, runs = f"{html}<{tag} title='a > b'>{inner}</{tag}>", runs + own
            elif kind < 0.75:
                html += rng.choice(("<!-- <p>no</p> -->", "<script>'<p>'</script>", "<svg><text>no</text></svg>", "<style>p{}</style>"))
            else:
                inner, own = build(depth + 1)
                tag = rng.choice(("div", "section", "ul", "blockquote", "td"))
                html, runs = f"{html}<{tag} class=c{depth}>{inner}</{tag}>", [*runs, None, *own, None]
        return html, runs

    for _ in range(500):
        html, runs = build(0)
        want = [" ".join("".join(x for x in group).split()) for inside, group in itertools.groupby(runs, lambda x: x is not None) if inside]
        assert [b.text for b in blocks(html)] == [w for w in want if w], html


def test_gradient_against_all_label_sequences():
    rng = random.Random(9)
    word = lambda: rng.choice(("a b c.", "Read more", "x | y", "long text, with commas, and an end."))
    path = lambda: rng.choice(((("article", ()), ("p", ())), (("nav", ()), ("li", ())), (("div", ("foot",)),)))
    pages = []
    for n in (1, 3, 4):
        found = [Block(word(), path(), 0) for _ in range(n)]
        pages.append((found, [rng.randint(0, 1) for _ in found]))
    evidence = html_crf.Evidence(pages)
    w, t = np.array([rng.uniform(-1, 1) for _ in evidence.names]), np.array([[rng.uniform(-1, 1) for _ in "01"] for _ in "01"])

    def plain(w, t):
        chain, total = html_crf.Chain({f: w[i] for f, i in evidence.names.items()}, t.tolist()), 0.0
        for found, gold in pages:
            scores = chain.scores(found)
            value = lambda p: sum(s for s, y in zip(scores, p) if y) + sum(t[a][b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
            total += value(gold) - np.log(sum(np.exp(value(p)) for p in itertools.product((0, 1), repeat=len(found))))
        return total

    got, grad_w, grad_t = evidence.likelihood(w, t)
    assert got == pytest.approx(plain(w, t))
    step = 1e-5
    for i in range(len(w)):
        e = np.eye(len(w))[i] * step
        assert grad_w[i] == pytest.approx((plain(w + e, t) - plain(w - e, t)) / (2 * step), abs=1e-6)
    for a, b in itertools.product((0, 1), repeat=2):
        e = np.zeros((2, 2))
        e[a, b] = step
        assert grad_t[a, b] == pytest.approx((plain(w, t + e) - plain(w, t - e)) / (2 * step), abs=1e-6)
