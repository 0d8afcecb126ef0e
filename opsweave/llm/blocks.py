"""Text blocks of a web page, in page order, with the features that a block labeller reads.

Markup is read leniently, in one pass and in time linear in the page: unclosed comments, scripts and
tags run to the end of the page, unknown end tags are ignored, a block start closes an open paragraph.
"""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass

import numpy as np

#: Elements that do not end a block; the others do.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code del dfn em font i img input ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr br data meter output picture source".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
SILENT = frozenset("script style title noscript template iframe object svg math select textarea canvas audio video".split())
CLOSES_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: Words of tags, classes, ids and roles that a path vector counts; others share one place.
BOILERPLATE_WORDS = (
    "nav navigation navbar menu menubar breadcrumb breadcrumbs pagination pager toc header masthead topbar "
    "footer colophon copyright legal aside sidebar complementary widget related recommended trending popular "
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner notice notices alert cookie "
    "cookies consent gdpr popup modal overlay newsletter subscribe signup login search form button share "
    "sharing social follow comment comments commentlist respond reply replies disqus discussion feedback hidden "
    "skip toolbar contentinfo head tags"
).split()
NEUTRAL_WORDS = (
    "html body article main content contents post entry story text prose page wrapper container section row "
    "column inner div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tr td th blockquote pre figure "
    "figcaption center details summary address fieldset title headline lead paragraph copy body-text"
).split()
PATH_WORDS = {w: i for i, w in enumerate(dict.fromkeys(BOILERPLATE_WORDS + NEUTRAL_WORDS))}
LAST_BOILERPLATE = len(dict.fromkeys(BOILERPLATE_WORDS))
OTHER = len(PATH_WORDS)
PATH_SIZE = OTHER + 1
HASHED = 32
SCALARS = 7
SIZE = PATH_SIZE + HASHED + SCALARS

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_CUT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"\w+")


@dataclass
class Block:
    text: str
    path: tuple[int, ...]  # distinct places in the path vector, outermost first
    linked: float  # share of the text inside links


def _words_of(tag: str, attributes: str) -> tuple[int, ...]:
    words = [tag]
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "style" and "display:none" in value.replace(" ", "").lower():
            words.append("hidden")
        elif name != "style":
            words += [w for w in _CUT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()) if w]
    return tuple(dict.fromkeys(PATH_WORDS.get(w, OTHER) for w in words))


def blocks(page: str | None) -> list[Block]:
    if not page:
        return []
    out: list[Block] = []
    stack: list[tuple[str, tuple[int, ...]]] = []
    open_: dict[str, int] = {}
    parts: list[str] = []
    state = {"linked": 0, "links": 0}
    cache: dict[tuple[str, str], tuple[int, ...]] = {}

    def end_block() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                path = stack[-1][1] if stack else ()
                out.append(Block(text, path, min(1.0, state["linked"] / len(text))))
            parts.clear()
        state["linked"] = 0

    def say(text: str) -> None:
        if text:
            parts.append(text)
            if state["links"]:
                state["linked"] += len(text.strip())

    def pop(tag: str) -> None:
        while stack:
            top = stack.pop()[0]
            open_[top] -= 1
            if top == "a":
                state["links"] -= 1
            if top == tag:
                return

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        say(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        m = _TAG.match(page, lt)
        if not m:
            if page[lt + 1 : lt + 2] in ("!", "?", "/"):
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                say("<")
                at = lt + 1
            continue
        tag = m[2].lower()
        rest = _REST.match(page, m.end())
        end = rest.end() if rest else page.find(">", m.end()) + 1
        if not end:
            break
        attributes, at = page[m.end() : end - 1], end
        inline = tag in INLINE
        if not inline:
            end_block()
        if m[1]:
            if open_.get(tag):
                pop(tag)
            continue
        if tag in SILENT and not attributes.endswith("/"):
            parts.append(" ")
            close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            at = n if not close else page.find(">", close.start()) + 1 or n
            continue
        if tag == "br":
            parts.append(" ")
        if tag in VOID or attributes.endswith("/"):
            continue
        if not inline:
            while stack and (stack[-1][0] in INLINE or stack[-1][0] == "p") and open_.get("p"):
                pop(stack[-1][0])
        for other in CLOSES_ITSELF.get(tag, ()):
            if stack and stack[-1][0] == other:
                pop(other)
        key = (tag, attributes)
        if key not in cache:
            cache[key] = _words_of(tag, attributes)
        above = stack[-1][1] if stack else ()
        own = tuple(i for i in cache[key] if i not in above)
        stack.append((tag, above + own if own else above))
        open_[tag] = open_.get(tag, 0) + 1
        if tag == "a":
            state["links"] += 1
    end_block()
    return out


class _Places(dict):
    """Word to hashed place; the second half of the places counts negatively."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 400_000:
            self.clear()
        self[word] = place = zlib.crc32(word.encode("utf-8", "surrogatepass")) % (2 * HASHED)
        return place


_PLACES = _Places()


def vectors(found: list[Block]) -> np.ndarray:
    """Per block: its path (1 where a word is present), signed hashes of its distinct words, a few numbers."""
    x = np.zeros((len(found), SIZE), dtype=np.float32)
    for i, b in enumerate(found):
        x[i, list(b.path)] = 1
        words = set(_WORD.findall(b.text.lower()))
        places = np.bincount(np.array([_PLACES[w] for w in words], dtype=np.int64), minlength=2 * HASHED)
        x[i, PATH_SIZE : PATH_SIZE + HASHED] = (places[:HASHED] - places[HASHED:]) / np.sqrt(len(words) + 1)
        x[i, PATH_SIZE + HASHED :] = (
            np.log1p(len(b.text)) / 5, np.log1p(len(words)) / 4, b.linked,
            b.text[-1] in ".!?:;\"'", i / len(found), len(b.path) / 10, min(3, sum(k < LAST_BOILERPLATE for k in b.path)),
        )
    return x
