"""Labelled pages for the chain: layouts put together at random, with known main text.

Texts are made-up words, so the chain can only learn marks of structure and
shape. Layouts cover semantic elements, class-named containers and bare ones.
"""

from __future__ import annotations

import random

from quilt.llm.html_blocks import Block, blocks

SEED, PAGES = 20, 500
#: Stands at the start of each main block while a page is built, so that labels survive parsing.
_MARK = "\x02"

#: Phrases of licences, notices and footers; articles hold them as well, though seldom.
_PHRASES = (
    "All rights reserved.", "Copyright (c) 2019.", "Released under the MIT License.", "We use cookies.", "Read more", "Share this",
    "Privacy policy", "Terms of use", "Subscribe to our newsletter.", "Sign in to reply.", "Posted by admin, 2 days ago.", "Licensed under CC BY 4.0.",
)


class _Page:
    def __init__(self, rng: random.Random):
        self.rng = rng

    def words(self, low: int, high: int) -> str:
        r = self.rng
        return " ".join("".join(r.choice(("ka", "lor", "mi", "té", "sun", "vel", "dra", "o", "ni", "pe", "üs", "ß", "ña")) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high)))

    def prose(self, low: int = 1, high: int = 6) -> str:
        r = self.rng
        text = " ".join(self.words(1, 18).capitalize() + r.choice((".", ".", ".", "!", "?", ", " + self.words(2, 6) + ".")) for _ in range(r.randint(low, high)))
        if r.random() < 0.1:
            text += f' <a href="/x">{self.words(1, 3)}</a>.'
        if r.random() < 0.1:
            text = text.replace(" ", " &amp; ", 1)
        return text.rstrip(".") if r.random() < 0.08 else text

    def chrome(self) -> str:
        return " ".join(self.rng.choice(_PHRASES) for _ in range(self.rng.randint(1, 3)))

    def links(self, tag: str = "ul", low: int = 3, high: int = 9) -> str:
        return f"<{tag}>" + "".join(f'<li><a href="/{i}">{self.words(1, 3)}</a></li>' for i in range(self.rng.randint(low, high))) + f"</{tag}>"

    def named(self, *choices: str) -> str:
        """An element with one of the names, as (tag, attributes) text; a bare name is a tag."""
        pick = self.rng.choice(choices)
        if pick.startswith("."):
            return self.rng.choice(('div class="%s"', 'section class="box %s"', 'div id="%s"', 'div class="c-%s__inner"')) % pick[1:]
        return pick

    def wrap(self, element: str, inner: str) -> str:
        return f"<{element}>{inner}</{element.split()[0]}>"

    def article(self) -> str:
        r, out = self.rng, []
        title = self.words(2, 10)
        head = f"<h1>{_MARK}{title}</h1>"
        out.append(f"<header>{head}</header>" if r.random() < 0.2 else head)
        if r.random() < 0.2:
            out.append(f'<div class="{r.choice(("share", "social-links", "ad", "advert"))}">{self.words(1, 6)}</div>')
        for i in range(r.choice((1, 1, 2, 3, 5, 8, 14))):
            kind, text = r.random(), _MARK + self.prose()
            if i == 0 and r.random() < 0.4:
                mark = r.choice(("b", "i", "em", "strong", "span"))
                out.append(r.choice((f"<p><{mark}>{text}<br>", f"<p><{mark}>{text}</{mark}><br/>{self.words(2, 9)}.</p>", f"<p class=\"lead\"><{mark}>{text}")))
            elif kind < 0.06:
                out.append(f"<p>{_MARK}{r.choice(_PHRASES)}</p>")
            elif kind < 0.09:
                out.append(f"<p>{_MARK}{' | '.join(self.words(1, 2) for _ in range(r.randint(3, 20)))}</p>")
            elif kind < 0.72:
                out.append(f"<p>{text}</p>" if r.random() < 0.85 else f"<p>{text}")
            elif kind < 0.78:
                out.append(f"<h2>{_MARK}{self.words(1, 6)}</h2>")
            elif kind < 0.84:
                out.append("<ul>" + "".join(f"<li>{_MARK}{self.words(2, 12)}{r.choice(('', '.'))}</li>" for _ in range(r.randint(2, 4))) + "</ul>")
            elif kind < 0.88:
                out.append(f"<blockquote><p>{text}</p></blockquote>")
            elif kind < 0.91:
                out.append(f"<p>{_MARK}{self.words(1, 2).capitalize()}.</p>")
            elif kind < 0.94:
                out.append("<table><tr>" + "".join(f"<td>{_MARK}{self.words(1, 4)}</td>" for _ in range(3)) + "</tr></table>")
            elif kind < 0.97:
                out.append(self.wrap(self.named("aside", ".ad", ".related-posts", ".newsletter-signup", ".promo"), f"<p>{self.words(2, 20)}.</p>"))
            else:
                out.append(f"<pre>{_MARK}{self.words(3, 20)}</pre>")
        return "".join(out)

    def comment(self) -> str:
        r = self.rng
        return r.choice(("<p><b>{0}</b></p><p>{1}</p>", "<h4>{0}</h4><p>{1}</p>", "<li><p>{1}</p></li>", '<article class="comment"><p>{1}</p></article>', '<div class="comment-body">{1}</div>', "<p>{1}</p>")).format(self.words(1, 2), self.prose(1, 4))

    def before(self) -> list[str]:
        r, out = self.rng, []
        if r.random() < 0.4:
            out.append(self.wrap(self.named("header", ".masthead", ".site-header", ".topbar"), r.choice(("<h1>%s</h1>", "<p>%s</p>", "%s")) % self.words(1, 4) + (f"<nav>{self.links()}</nav>" if r.random() < 0.4 else "")))
        if r.random() < 0.8:
            out.append(self.wrap(self.named("nav", "nav", ".menu", ".navbar", ".breadcrumbs"), self.links() if r.random() < 0.8 else " &raquo; ".join(self.words(1, 2) for _ in range(3))))
        if r.random() < 0.25:
            out.append(self.wrap(self.named(".cookie-notice", ".consent", ".alert", ".popup-overlay"), f"<p>{r.choice((self.prose(1, 2), self.chrome()))}</p><button>{self.words(1, 1)}</button>"))
        if r.random() < 0.6:
            remark = r.choice(("", "<!-- slot -->", f"<!-- {self.words(1, 3)} -->"))
            out.append(remark + self.wrap(self.named(".ad", ".ad", ".advert", ".sponsored", ".banner-ad"), r.choice(("{}", "{}", "<p>{}</p>", '<a href="/x">{}</a>')).format(self.prose(1, 1))))
        if r.random() < 0.2:
            out.append(f'<form action="/s"><label>{self.words(1, 2)}</label><input name="q"><button>{self.words(1, 1)}</button></form>')
        if r.random() < 0.2:
            out.append(self.aside())
        return out

    def aside(self) -> str:
        inner = self.links() if self.rng.random() < 0.5 else f"<h3>{self.words(1, 3)}</h3><p>{self.prose(1, 3)}</p>"
        return self.wrap(self.named("aside", ".sidebar", ".widget", ".related", ".trending"), inner)

    def after(self) -> list[str]:
        r, out = self.rng, []
        if r.random() < 0.3:
            out.append(self.aside())
        if r.random() < 0.2:
            out.append(self.wrap(self.named(".share", ".social"), self.links()))
        if r.random() < 0.35:
            inner = f"<h3>{self.words(1, 2)}</h3>" + "".join(self.comment() for _ in range(r.randint(1, 6)))
            out.append(self.wrap(self.named(".comments", ".comment-list", ".responses", ".discussion"), inner))
        if r.random() < 0.2:
            out.append(f'<form class="newsletter"><p>{self.prose(1, 1)}</p><input name="e"></form>')
        if r.random() < 0.2:
            out.append(f'<div class="ad banner">{self.prose(1, 1)}</div>')
        if r.random() < 0.85:
            out.append(self.wrap(self.named("footer", "footer", ".footer", ".site-footer", ".copyright"), self.imprint()))
        return out

    def imprint(self) -> str:
        r = self.rng
        owner, more = self.words(1, 2), r.choice((self.prose(1, 1), self.chrome()))
        sign, between = r.choice(("&copy;", "\u00a9", "(c)", "Copyright", "&#169; 2021")), r.choice((" &middot; ", " | ", " &bull; ", " - ", "<br>", ". "))
        return r.choice((f"{sign} {owner}{between}{more}", f"{sign} {owner}{between}{more}", f"<p>{more}</p>", f"<p>{sign} 2020 {owner}</p><p>{more}</p>", f"<ul><li>{owner}</li><li>{more}</li></ul>"))

    def head(self) -> str:
        r = self.rng
        parts = [f"<title>{self.words(2, 6)}</title>", r.choice(('<meta charset="utf-8">', '<meta name="viewport" content="width=device-width">', ""))]
        parts += [f"<style>.{self.words(1, 1)} {{ color: #{r.randrange(1 << 24):06x} }}</style>"] * r.randint(0, 1) + [f'<script src="/{r.randrange(99)}.js"></script>'] * r.randint(0, 1)
        r.shuffle(parts)
        return r.choice(("<head>{}</head>", "{}")).format("".join(parts))

    def noise(self) -> str:
        """What isn't text wherever it stands."""
        return self.rng.choice((f"<script>if (a < {self.rng.randrange(9)}) {{ show('<div>') }}</script>", "<svg><path d='M0 0'/></svg>", f"<noscript>{self.words(2, 6)}</noscript>", f"<select><option>{self.words(1, 2)}</select>"))

    def html(self) -> str:
        r = self.rng
        main = self.wrap(self.named("article", "article", "article", "main", ".post-content", ".entry", ".article-body", ".content", "div", "section"), self.article())
        if r.random() < 0.3:
            main = self.wrap(self.named("main", ".content", ".wrapper", "div"), main + (self.aside() if r.random() < 0.4 else ""))
        inner = "".join([*self.before(), main, *self.after()])
        if r.random() < 0.2:
            inner = f'<div id="page">{inner}</div>'
        if r.random() < 0.2:
            inner = self.noise() + inner
        return r.choice(("<!doctype html>", "", "<?xml version='1.0'?>")) + f"<html>{self.head()}<body>{inner}</body></html>"


def labelled_pages(n: int = PAGES, seed: int = SEED) -> list[tuple[list[Block], list[int]]]:
    """(blocks, labels) of n generated pages."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        found = blocks(_Page(rng).html())
        labels = [int(_MARK in b.text) for b in found]
        for b in found:
            b.text = b.text.replace(_MARK, "") or "-"
        out.append((found, labels))
    return out
