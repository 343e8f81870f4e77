"""The main text of a parsed page, by three ways of which the first that finds enough counts.

density    blocks of text in order of the page, scored by how many words they have outside links; the best contiguous run
parents    parts that hold many small pieces of text, none of which would stand alone in the first way
heuristic  the longest text of a container
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate
from typing import Protocol

from . import constants as C

#: Characters that a way has to find for its text to count (a fixed value).
ENOUGH = 100
#: Elements that end one block of text and begin another.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SILENT = frozenset("script style noscript template svg button select option textarea head title".split())
#: Words that a block has to have, outside links, to be worth more than nothing; a heading owes fewer, since text follows it.
PRICE, HEADING_PRICE = 10.0, 2.0
#: Shares by which a block's score is taken from the one before, itself and the one after.
SMOOTH = (0.25, 0.5, 0.25)
#: Above this share of its words in links, a block is a list of links.
LINKED = 0.5

_NOISE = re.compile(C.EXTRACT_NOISE_CLASSES)
_BANNER = re.compile("(?i)cookie|gdpr|consent|banner")
_HIDDEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")


class Element(Protocol):
    tag: str
    attrs: dict[str, str]
    children: list
    parent: Element | None


@dataclass
class Block:
    """A stretch of text between two borders of block elements: what it says, and how many of its words are in links."""

    home: Element
    parts: list[str] = field(default_factory=list)
    words: int = 0
    linked: int = 0

    @property
    def text(self) -> str:
        return " ".join(" ".join(self.parts).split())

    @property
    def worth(self) -> float:
        price = HEADING_PRICE if self.home.tag in HEADINGS else PRICE
        free = 1 - self.linked / self.words
        return self.words * free * free - price


def is_noise(node: Element) -> bool:
    """Navigation and the like by element or class, or not shown at all.  A page's own body is never noise."""
    if node.tag in ("html", "body"):
        return False
    names = node.attrs.get("class", "")
    if node.tag in C.EXTRACT_NOISE_TAGS or node.tag in SILENT or "hidden" in node.attrs or node.attrs.get("aria-hidden") == "true":
        return True
    return bool(names and (_NOISE.search(names) or _BANNER.search(names)) or _HIDDEN.search(node.attrs.get("style", "")))


def blocks_of(root: Element) -> tuple[list[Block], dict[int, tuple[int, int]]]:
    """(the page's blocks in order without what is noise, which of them each block element holds).  One walk, no recursion:
    depth is the page's to choose."""
    out: list[Block] = []
    spans: dict[int, tuple[int, int]] = {}
    now: Block | None = None
    # What is still to come: a string or an element, the block element that it is in, links it is in, and whether it is left.
    stack: list[tuple[str | Element, Element, int, bool]] = [(root, root, 0, False)]
    while stack:
        item, home, links, leave = stack.pop()
        if isinstance(item, str):
            if n := len(item.split()):
                if now is None:
                    now = Block(home)
                now.parts.append(item)
                now.words += n
                now.linked += n * (links > 0)
            continue
        border = item.tag in BLOCKS or item is root
        if border and now is not None:
            out.append(now)
            now = None
        if leave:
            spans[id(item)] = (spans[id(item)][0], len(out))
            continue
        if is_noise(item):
            continue
        if border:
            spans[id(item)] = (len(out), len(out))
            stack.append((item, home, links, True))
            home = item
        stack += [(c, home, links + (item.tag == "a"), False) for c in reversed(item.children)]
    return out, spans


def _above(node: Element) -> Iterator[Element]:
    """Block elements around a node, from the inside out."""
    while node.parent is not None:
        node = node.parent
        if node.tag in BLOCKS or node.parent is None:
            yield node


def best_run(scores: list[float]) -> tuple[int, int]:
    """(first, end) of the contiguous run with the largest sum, the longest of equal ones; (0, 0) if no sum is over 0."""
    best, low, low_at, run = (0.0, 0, 0), 0.0, 0, (0, 0)
    for end, total in enumerate(accumulate(scores), 1):
        if (total - low, end - low_at, -low_at) > best and total > low:
            best, run = (total - low, end - low_at, -low_at), (low_at, end)
        if total < low:
            low, low_at = total, end
    return run


def by_density(blocks: list[Block]) -> str:
    """The run of blocks with most free words for its length.  A block's score is smoothed over its neighbours, so that a short
    line within a text stays and a long one within a menu doesn't count; lists of links inside the run go, headings right before it stay."""
    own = [b.worth for b in blocks]
    if not blocks:
        return ""
    before, after = [0.0, *own[:-1]], [*own[1:], 0.0]
    first, end = best_run([SMOOTH[0] * a + SMOOTH[1] * x + SMOOTH[2] * b for a, x, b in zip(before, own, after, strict=True)])
    while first < end and own[first] < 0:  # smoothing reaches one block too far
        first += 1
    while first < end and own[end - 1] < 0:
        end -= 1
    while 0 < first < end and blocks[first - 1].home.tag in HEADINGS:
        first -= 1
    return " ".join(b.text for b in blocks[first:end] if b.linked <= LINKED * b.words)


def by_parents(blocks: list[Block], spans: dict[int, tuple[int, int]]) -> str:
    """The text of the element whose pieces earn it most.  A piece earns the element around its own one point, one for every comma
    and up to three for its length, and half as much for the next one, less the share of words in links, its own and the element's."""
    points: defaultdict[int, float] = defaultdict(float)
    for b in blocks:
        text = b.text
        earned = (1 + text.count(",") + min(len(text) / 100, 3.0)) * (1 - b.linked / b.words)
        for share, node in zip((1.0, 0.5), _above(b.home), strict=False):
            points[id(node)] += earned * share
    if not points:
        return ""
    words, linked = [0, *accumulate(b.words for b in blocks)], [0, *accumulate(b.linked for b in blocks)]

    def fair(node: int) -> float:
        first, end = spans[node]
        return points[node] * (1 - (linked[end] - linked[first]) / (words[end] - words[first]))

    first, end = spans[max(points, key=fair)]  # the first of equals
    return " ".join(b.text for b in blocks[first:end] if b.linked <= LINKED * b.words)


def cascade(root: Element, longest: Callable[[], str]) -> Iterator[tuple[str, str]]:
    blocks, spans = blocks_of(root)
    yield "density", by_density(blocks)
    yield "parents", by_parents(blocks, spans)
    yield "heuristic", longest()


def main_text(root: Element, longest: Callable[[], str]) -> tuple[str, str]:
    """(text, way) of a parsed page; longest() gives the last way's text, which counts however short it is."""
    way, text = "heuristic", ""
    for way, text in cascade(root, longest):
        if len(text) > ENOUGH:
            break
    return text, way
