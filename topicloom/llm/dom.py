"""A forgiving HTML reader: the blocks of a page and the elements that hold them."""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache

import xxhash

#: Elements nested deeper, as browsers nest none, count as their ancestor at this depth in the site's tree; a page's own blocks and marks know no bound.
MAX_DEPTH = 512

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_LINK = re.compile(r"""(?:^|\s)href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

# How HTML treats its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")),
    "dt": ("dt dd", ("dl",)),
    "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th", ("table", "tbody", "thead", "tfoot")),
    "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")),
    "option": ("option", ("select",)),
}
#: Landmarks: what a page says of its own parts, before any statistics.
MAIN_TAGS = frozenset(["article", "main"])
NOISE_TAGS = frozenset("head nav header footer aside form menu dialog button select input object embed audio video canvas map".split()) | RAW
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: Whole names of classes or ids that say as much as a tag does; parts of longer names do not count.
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead "
    "comment comments cookie-notice notice newsletter share social widget disqus".split()
)
OUTER_NAMES = frozenset(["header", "banner"])


@lru_cache(1 << 16)
def _marks(tag: str, attrs: str) -> tuple[str, bool, bool, bool, bool]:
    """Key of an element among its siblings; main, noise, noise only outside main, noise by its name alone."""
    found = {}
    for name, a, b, c in _ATTR.findall(attrs):
        found.setdefault(name.lower(), (a or b or c).lower())
    names = set(found.get("class", "").split()) | {found.get("id", "")}
    label = " ".join(sorted(found.get("class", "").split()))
    role = found.get("role", "")
    main = tag in MAIN_TAGS or role == "main"
    noise = tag in NOISE_TAGS and tag != "header" or role in NOISE_ROLES or bool(names & (NOISE_NAMES - OUTER_NAMES))
    outer = tag == "header" or bool(names & OUTER_NAMES)
    may = not main and tag not in ("html", "body")
    return f"{tag}.{label}", main, noise and may, outer and may, tag not in NOISE_TAGS and role not in NOISE_ROLES


@lru_cache(1 << 16)
def _path(parent: int, key: str) -> int:
    return xxhash.xxh64_intdigest(f"{parent:x}/{key}") - (1 << 63)


class Element:
    __slots__ = ("tag", "path", "parent", "depth", "noise", "within", "main", "holds", "kids", "worded", "dropped", "links")

    def __init__(self, tag: str, attrs: str, parent: Element | None, landmarks: bool = True):
        key, self.main, noise, outer, self.worded = _marks(tag, attrs)
        if not landmarks:
            self.main = noise = outer = False
        inside = parent is not None and parent.main
        self.noise = noise or outer and not inside
        #: Inside an inline element that is noise, however deep.
        self.within = tag in INLINE and self.noise or parent is not None and parent.within
        self.tag, self.parent, self.holds, self.kids = tag, parent, False, []
        #: A noise landmark here or above, save one that holds the main part; set when the page has been read.
        self.dropped = False
        self.links: list[str] = []
        self.main |= inside
        if parent is None:
            self.depth, self.path = 0, _path(0, key)
        elif parent.depth + 1 >= MAX_DEPTH:
            self.depth, self.path = parent.depth, parent.path
        else:
            self.depth, self.path = parent.depth + 1, _path(parent.path, key)

    def chain(self) -> list[int]:
        out, e = [], self
        while e is not None:
            if not out or out[-1] != e.path:
                out.append(e.path)
            e = e.parent
        return out[::-1]


class Page:
    """``elements`` in page order; ``blocks``: (element, text) with white space collapsed.

    ``landmarks`` false reads the page without what it says of its own parts.  The time is
    linear in the page's length, however deep it nests.
    """

    def __init__(self, source: str | None, landmarks: bool = True):
        self.elements: list[Element] = []
        self.blocks: list[tuple[Element, str]] = []
        self.root = Element("#page", "", None)
        self.elements.append(self.root)
        stack, text = [self.root], []
        opened: Counter = Counter()
        source = source or ""

        def flush():
            if text:
                whole = " ".join(html.unescape("".join(text)).split())
                text.clear()
                if whole:
                    self.blocks.append((self._holder(stack[-1]), whole))

        def leave(to: int):
            while len(stack) > to:
                if stack[-1].tag not in INLINE:
                    flush()
                opened[stack.pop().tag] -= 1

        pos = 0
        while True:
            m = _TOKEN.search(source, pos)
            piece = source[pos : m.start() if m else len(source)]
            if piece and not stack[-1].within:
                text.append(piece)
            if not m:
                break
            pos = m.end()
            tag = m[2] or m[5]
            if not tag:
                continue
            tag, close = tag.lower(), m[1] or m[4]
            attrs = m[3] if m[2] else m[6]
            if not m[2] and not m[0].endswith(">"):
                break  # a tag that the end of the page cuts off is no text
            if close:
                if tag == "br":
                    flush()
                for i in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                    if stack[i].tag == tag:
                        leave(i)
                        break
                    if tag in INLINE and stack[i].tag not in INLINE:
                        break  # an inline end tag closes nothing outside its block
                continue
            if tag in INLINE:
                inline = Element(tag, attrs, stack[-1], landmarks)
                if tag == "a" and not inline.within and (link := _LINK.search(attrs)):
                    self._holder(stack[-1]).links.append(link[1] or link[2] or link[3] or "")
                if tag not in VOID and not attrs.endswith("/"):
                    stack.append(inline)  # its text is its block's; it is no node of the tree
                    opened[tag] += 1
                continue
            flush()
            if tag in VOID:
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, pos)
                pos = end.end() if end else len(source)
                continue
            if tag in CLOSES:
                ends, within = CLOSES[tag]
                ends = ends.split()
                for i in range(len(stack) - 1, 0, -1) if any(opened[t] for t in ends) else ():
                    if stack[i].tag in within:
                        break
                    if stack[i].tag in ends:
                        leave(i)
                        if len(ends) == 1 or not any(opened[t] for t in ends):
                            break
            else:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        leave(i)
                        break
                    if stack[i].tag not in INLINE:
                        break
            noisy = stack[-1].within
            while not noisy and stack[-1].tag in INLINE:
                leave(len(stack) - 1)
            e = Element(tag, attrs, stack[-1], landmarks)
            if landmarks and (tag in MAIN_TAGS or e.main and not stack[-1].main):
                for x in reversed(stack):
                    if x.holds:
                        break  # and so does all above
                    x.holds = True
            stack[-1].kids.append(e.path)
            stack.append(e)
            opened[tag] += 1
            self.elements.append(e)
        leave(1)
        flush()
        self._wrappers()
        for e in self.elements:  # parents come first
            e.dropped = e.noise and not e.holds or e.parent is not None and self._holder(e.parent).dropped

    @staticmethod
    def _holder(e: Element) -> Element:
        """The block that an element's text belongs to."""
        while e.tag in INLINE and e.parent is not None:
            e = e.parent
        return e

    def _wrappers(self):
        """Without a main landmark, an element with a noise name that holds the page's
        heading and over half of its text is a wrapper, not noise."""
        if any(e.main for e in self.elements) or not any(e.noise for e in self.elements):
            return
        named, size, titled = {}, Counter(), set()  # by element: all marks from the root on are names; text below; a heading below
        for e in self.elements:
            named[e] = (not e.noise or e.worded) and (e.parent is None or named[self._holder(e.parent)])
        for e, t in self.blocks:
            if named[e]:
                size[e] += len(t)
                if e.tag == "h1":
                    titled.add(e)
        whole = sum(size.values())
        for e in reversed(self.elements):
            if e.parent is not None:
                above = self._holder(e.parent)
                size[above] += size[e]
                if e in titled:
                    titled.add(above)
        for e in titled:
            if e.noise and size[e] * 2 > whole:
                e.noise = False

    def main_text(self, noise: frozenset[int] = frozenset(), body: frozenset[int] = frozenset()) -> str:
        """Blocks that stay, in page order.

        Noise landmarks go, and branches whose path is in ``noise``.  Where a main
        landmark has text, blocks outside it stay if their path is in ``body``.  If
        nothing is left, what the landmarks alone leave stays.
        """
        low: dict[Element, bool] = {}
        for e in self.elements:  # below what holds a main landmark, a path of ``noise`` here or above
            low[e] = not e.holds and (e.path in noise or e.parent is not None and low[self._holder(e.parent)])
        kept = [(e, t) for e, t in self.blocks if not e.dropped]
        inner = any(e.main for e, _ in kept)
        left = [t for e, t in kept if (not inner or e.main or e.path in body) and not low[e]]
        return " ".join(left or [t for e, t in kept if e.main or not inner])
