"""Flat text blocks of a web page with what surrounds them."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass

_ATTRS = r"""(?:[^>"'<]++|"[^"<]*+"|'[^'<]*+'|["'])*+"""
_SCAN = re.compile(
    rf"""(?isx)
    <!--.*?(?:-->|\Z) | <[!?][^>]*(?:>|\Z)
    | <(?P<raw>script|style|title|textarea|noscript|template|iframe|svg|canvas|object|select)\b{_ATTRS}>.*?(?:</(?P=raw)\s*>|\Z)
    | <(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*){"(?P<attrs>" + _ATTRS + ")"}>"""
)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
_VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
_SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
#: Elements and roles that hold no main text, and words of class or id that hint at it.
_ASIDE_TAGS = frozenset({"nav", "aside", "footer", "form", "dialog", "menu", "button", "fieldset"})
_ASIDE_ROLES = frozenset({"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "form"})
_ASIDE_WORDS = frozenset({
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay",
    "newsletter", "subscribe", "subscription", "signup", "login", "comment", "comments", "disqus", "respond", "reply", "replies",
    "share", "sharing", "social", "related", "recommended", "tags", "breadcrumb", "breadcrumbs", "sidebar", "aside", "widget",
    "menu", "nav", "navbar", "navigation", "footer", "masthead", "toolbar", "pagination", "pager", "skip",
})
_CONTENT_TAGS = frozenset({"article", "main"})
_WORDS = re.compile(r"[A-Za-z]+")
_ATTR = re.compile(r"""(?i)\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


@dataclass(slots=True)
class Block:
    """``text`` has its white space collapsed; ``linked`` counts its words inside links.

    ``hint``: 0 outside of elements whose class or id hints at something else than main
    text; inside, how small a part of the page's or article's words the element holds
    (near 1 for a small box, 0 for a wrapper of everything or of an article).
    """

    text: str
    words: int
    linked: int
    inside: bool
    aside: bool
    heading: bool
    item: bool
    hint: float = 0.0


@dataclass(slots=True)
class _Hinted:
    """An element whose class or id hints, or an article or main element (``content``)."""

    parent: int
    scope: int
    content: bool
    start: int
    words: int = 0
    holds_content: bool = False


def _described(tag: str, attrs: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element holds no main text for certain, and whether its class or id hints at it."""
    hinted = False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value) or name == "role" and value in _ASIDE_ROLES:
            return True, False
        hinted |= name in ("class", "id") and not _ASIDE_WORDS.isdisjoint(_WORDS.findall(value))
    return tag in _ASIDE_TAGS or tag == "header" and not inside, hinted and tag not in ("body", "html", "article", "main")


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in order, those with text only.

    Block-level tags end a block, inline ones don't, ``<br>`` is white space. Comments,
    scripts, styles and the head's title are no text. Tags that are never closed end
    with what they are in. Elements may be nested to any depth.
    """
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, int]] = []  # tag, aside, content, number of its _Hinted or -1
    opened: Counter[str] = Counter()
    marks: list[_Hinted] = []
    under: list[int] = []  # for each block, the innermost of ``marks`` around it
    parts: list[str] = []
    linked: list[str] = []
    inside = aside = total = 0
    mark = scope = -1
    link = -1  # depth at which a link was opened

    def flush() -> None:
        nonlocal total
        if parts:
            words = entities.unescape("".join(parts)).split()
            if words:
                tags = {t[0] for t in stack[-3:]}
                out.append(Block(" ".join(words), len(words), min(len(words), len(entities.unescape(" ".join(linked)).split())), inside > 0, aside > 0, bool(tags & {"h1", "h2", "h3", "h4", "h5", "h6"}), bool(tags & {"li", "td", "th", "dt", "dd"})))
                under.append(mark)
                total += len(words)
            parts.clear()
            linked.clear()

    def close(number: int) -> None:
        nonlocal mark, scope
        m = marks[number]
        m.words = total - m.start
        mark, scope = m.parent, m.scope
        if mark >= 0:
            marks[mark].holds_content |= m.content or m.holds_content

    def pop_to(depth: int) -> None:
        nonlocal inside, aside, link
        while len(stack) > depth:
            tag, was_aside, was_content, number = stack.pop()
            opened[tag] -= 1
            aside -= was_aside
            inside -= was_content
            if number >= 0:
                close(number)
        if link > depth:
            link = -1

    at = 0
    for m in _SCAN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if link >= 0:
                linked.append(piece)
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            link = -1 if m["close"] else len(stack)
        elif tag in _INLINE:
            continue
        elif m["close"]:
            flush()
            if opened[tag]:
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                pop_to(depth)
        else:
            flush()
            if tag in _VOID:
                continue
            closes = _SELF_CLOSING.get(tag)
            if closes and stack and stack[-1][0] in closes:
                pop_to(len(stack) - 1)
            elif stack and stack[-1][0] == "p":
                pop_to(len(stack) - 1)
            (certain, hinted), content = _described(tag, m["attrs"], inside > 0), tag in _CONTENT_TAGS
            number = -1
            if hinted or content:
                number = len(marks)
                marks.append(_Hinted(mark, scope, content, total))
                mark = number
                scope = number if content else scope
            stack.append((tag, certain, content, number))
            opened[tag] += 1
            aside += certain
            inside += content
    parts.append(page[at:])
    flush()
    pop_to(0)
    hints: list[float] = []
    for number, m in enumerate(marks):
        own = 0.0
        if not m.content and not m.holds_content:
            around = marks[m.scope].words if m.scope >= 0 else total
            own = 1 - m.words / around if around else 0.0
        hints.append(max(own, hints[m.parent] if m.parent >= 0 else 0.0))
    for block, number in zip(out, under):
        block.hint = hints[number] if number >= 0 else 0.0
    return out


def declared_language(page: str) -> str | None:
    """The primary subtag of the markup's own ``lang``, lower-cased."""
    m = re.search(r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?\s*([a-z]{2,8})""", page)
    return m[1].lower() if m else None
