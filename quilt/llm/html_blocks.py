"""Leaf blocks of a page's DOM: their text, ancestors and features."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

_TAG = re.compile(r"""<(?:(!--)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)>|[!?/][^>]*+>)""")
_NAME = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_WORD = re.compile(r"[a-z]+")
#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template iframe svg math object canvas audio video title textarea select head".split())
#: Their content is text to the end tag, whatever it looks like; without one, script, style and textarea go on to the end of the page, as in browsers.
PLAIN = frozenset("script style textarea title iframe".split())
TO_THE_END = frozenset("script style textarea".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q ruby rp rt s samp small span strike strong sub sup time tt u var wbr input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Other elements that stand for blocks; tags that are in no list are inline, unless a word of their name or attributes tells something.
BLOCK = frozenset("html p h1 h2 h3 h4 h5 h6 pre li dt dd tr td th thead tbody tfoot caption colgroup figcaption details summary dialog address fieldset legend option optgroup button center dir menu hgroup search frameset noframes marquee embed".split())
#: A start tag closes an open element of its own set, up to the nearest of the outer ones.
CLOSES = {t: frozenset([t]) for t in ("p", "li", "option", "tr")} | {t: frozenset(["td", "th"]) for t in ("td", "th")} | {t: frozenset(["dt", "dd"]) for t in ("dt", "dd")}
SCOPE = frozenset("article aside body div footer form header main nav ol section table ul dl blockquote figure".split())
#: What class names, ids and roles tell, by their words.
MEANINGS = {
    "adv": "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner adsense",
    "nav": "nav navigation navbar menu breadcrumb breadcrumbs pagination pager toolbar tabs toc",
    "side": "sidebar aside side widget widgets related recommended recommendations trending popular rail more tags",
    "cmt": "comment comments commentlist reply replies disqus respond discussion responses feedback",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login paywall dialog",
    "share": "share sharing social follow",
    "foot": "footer copyright legal colophon contentinfo bottom",
    "head": "header masthead logo brand topbar top site",
    "main": "article post entry content main story body text prose hentry",
    "form": "form search field",
}
_MEANING = {w: m for m, words in MEANINGS.items() for w in words.split()}


#: Where a raw element without an end tag is taken to end.
_NEXT_BLOCK = re.compile(rf"</?(?:{'|'.join(sorted(SCOPE | {'p', 'h1', 'h2', 'h3', 'h4', 'h5', 'h6', 'li', 'tr', 'td', 'th', 'dt', 'dd'}))})\b", re.I)


def _after_raw(html: str, name: str, pos: int, outer: str | None) -> int:
    """Where the page goes on after a raw element whose start tag ends at pos; outer: the element around it.

    Elements of the same name may nest. An end tag of outer before the
    element's own means that its own is missing; the element then ends where
    the next block starts.
    """
    if name in PLAIN:
        close = re.compile(rf"</{name}\s*>", re.I).search(html, pos)
        if close or name in TO_THE_END:
            return close.end() if close else len(html)
    else:
        depth, around = 1, 0
        names = name if outer is None or outer == name else f"{name}|{re.escape(outer)}"
        for m in re.compile(rf"<(/?)({names})(?=[\s/>])[^>]*?(/?)>", re.I).finditer(html, pos):
            if m[2].lower() == name:
                depth += -1 if m[1] else not m[3]
                if not depth:
                    return m.end()
            elif not m[1]:
                around += 1
            elif around:
                around -= 1
            else:
                break
    following = _NEXT_BLOCK.search(html, pos)
    return following.start() if following else len(html)


def _meanings(attributes: str) -> tuple:
    words = [w for a in _NAME.findall(attributes) for w in _WORD.findall("".join(a).lower())]
    found = {_MEANING[w] for w in words if w in _MEANING}
    if _HIDDEN.search(attributes):
        found.add("hidden")
    return tuple(sorted(found))


@dataclass(slots=True)
class Block:
    text: str
    path: tuple  # ((tag, meanings), ...) from the outermost element
    linked: int  # characters inside links


def blocks(html: str | None) -> list[Block]:
    """Leaf blocks in page order; white space in a block is one space, empty blocks are left out."""
    html = html or ""
    out: list[Block] = []
    stack: list[tuple] = []
    parts: list[str] = []
    linked = in_link = 0
    pos, n = 0, len(html)

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append(Block(text, tuple(stack), linked))
            parts.clear()
        linked = 0

    while pos < n:
        m = _TAG.search(html, pos)
        end = m.start() if m else n
        if end > pos:
            parts.append(html[pos:end])
            if in_link:
                linked += end - pos
        if not m:
            break
        pos = m.end()
        if m[1]:
            close = html.find("-->", m.start() + 4)
            pos = close + 3 if close >= 0 else n
            continue
        name = m[3] or m[6]
        if not name:
            continue
        name, closing, attributes = name.lower(), m[2] or m[5], m[4] or m[7] or ""
        if name in INLINE:
            if name == "br":
                parts.append(" ")
            elif name == "a":
                in_link = not closing
            continue
        if name in RAW and not closing:
            if name == "head":
                close = re.compile(r"</head\s*>|<body\b", re.I).search(html, pos)
                pos = (close.start() if close else pos) if not close or close[0][1] != "/" else close.end()
            elif not (name in ("svg", "math") and attributes.rstrip().endswith("/")):
                pos = _after_raw(html, name, pos, stack[-1][0] if stack else None)
            continue
        if name in RAW:  # an end tag without a start
            continue
        meanings = _meanings(attributes) if attributes else ()
        if name not in BLOCK and name not in SCOPE and name not in VOID:
            own = tuple(sorted({_MEANING[w] for w in _WORD.findall(name) if w in _MEANING} | set(meanings)))
            if not own and not (closing and any(t == name for t, _ in stack)):
                continue
            meanings = own
        flush()
        in_link = 0
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name in VOID:
            continue
        if name in CLOSES or name in SCOPE or name in ("h1", "h2", "h3", "h4", "h5", "h6", "pre", "hr"):
            closes = CLOSES.get(name, frozenset(["p"]))
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in closes:
                    del stack[k:]
                    break
                if stack[k][0] in SCOPE:
                    break
        stack.append((name, meanings))
    flush()
    return out


_SENTENCE = re.compile(r"[.!?…。！？](?:[\s\"'”’)]|$)")
_CHROME = re.compile(r"©|\(c\) ?\d{4}|all rights reserved|cookie|privacy|subscribe|sign (?:in|up)|log ?in\b|read more|share|advertis|sponsored|related|powered by|terms of", re.I)
_BYLINE = re.compile(r"^(?:by|von|por|par) |\breply\b|\bago\b|\d{4}-\d\d-\d\d|\d\d?:\d\d", re.I)


def _bucket(n: int, edges: tuple) -> int:
    return sum(n >= e for e in edges)


def path_features(path: tuple) -> list[str]:
    """Features of a block's ancestors."""
    tags = [t for t, _ in path]
    meanings = {m for _, found in path for m in found}
    inner = tags[-1] if tags else "none"
    held = {t for t in tags if t in SCOPE or t in ("li", "td", "th", "figcaption", "button", "h1", "h2", "h3", "pre", "details")} - {"body"}
    out = [f"tag={inner}", *(f"anc={t}" for t in sorted(held)), *(f"mean={m}" for m in sorted(meanings))]
    article = max((i for i, (t, found) in enumerate(path) if t in ("article", "main") or "main" in found), default=-1)
    out.append("in-main" if article >= 0 else "not-in-main")
    # What stands inside the innermost main part says more than what stands around it.
    after = {t for t in tags[article + 1 :] if article >= 0} & {"header", "footer", "aside", "nav", "form"}
    around = {t for t in (tags[: article + 1] if article >= 0 else tags)} & {"header", "footer", "aside", "nav", "form"}
    out += [f"inside-main={t}" for t in sorted(after)] + [f"around={t}" for t in sorted(around)]
    own = {m for _, found in path[article + 1 :] for m in found}
    out += [f"own={m}" for m in sorted(own)]
    return out


def text_features(block: Block, index: int, total: int, before: Block | None) -> list[str]:
    """Features of a block's text and place."""
    text = block.text
    words = text.count(" ") + 1
    out = [
        f"words={_bucket(words, (2, 4, 8, 15, 30, 60))}",
        f"links={_bucket(100 * block.linked // max(1, len(text)), (1, 30, 60, 90))}",
        f"sentences={_bucket(len(_SENTENCE.findall(text)), (1, 2, 4))}",
        f"commas={_bucket(text.count(','), (1, 3))}",
        f"place={10 * index // max(1, total)}",
    ]
    if text[-1] in ".!?…。！？":
        out.append("ends")
    if _CHROME.search(text):
        out.append("chrome-short" if words < 25 else "chrome-long")
    if words < 20 and _BYLINE.search(text):
        out.append("byline")
    if "|" in text or "»" in text or "·" in text:
        out.append("separators")
    if before is None:
        out.append("first")
    elif before.path[:-1] == block.path[:-1]:
        out.append("same-parent")
    return out
