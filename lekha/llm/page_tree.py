"""Block trees of web pages: a forgiving reader, node features, and the text of chosen nodes."""

from __future__ import annotations

import bisect
import html
import re
import zlib
from collections.abc import Iterator

import numpy as np

BLOCKS = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption "
    "nav header footer aside form fieldset address details summary center hr hgroup search dialog menu".split()
)
#: Elements whose content is never text of the page's body.
_RAW = frozenset("script style noscript template iframe svg textarea title select button object canvas audio video".split())
#: Of these the ones that hold code: without an end tag they take all that follows. Of others only the tag goes.
_CODE = frozenset("script style".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Other elements. What stands in angle brackets under another name is an element as well, but for bare words that nothing closes, as in `x<y and y>z`.
_INLINE = frozenset(
    "html head body a abbr acronym applet b basefont bdi bdo big blink cite code command data datalist del dfn dir em font frame frameset i ins kbd keygen label legend map mark "
    "marquee math meter nobr noembed noframes optgroup option output picture progress q rb rp rt rtc ruby s samp slot small span strike strong sub sup time tt u var xmp "
    "mi mn mo ms mtext mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mtable mtr mtd menclose semantics annotation".split()
)
#: A start tag of the key ends open elements of the value, up to the next of its bounds.
_ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table")}
_ENDS = {k: (a.split(), b.split()) for k, (a, b) in _ENDS.items()}
_NAME = re.compile(r"/?([a-zA-Z][^\s/><]*)")
_CLOSED = re.compile(r"</([a-zA-Z][^\s/><]*)")
_STOP = re.compile(r">|=\s*+[\"']")
_RAW_TAG = re.compile(rf"<(/?)({'|'.join(sorted(_RAW))})(?=[\s/>])", re.I)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

TOKEN_BUCKETS, TAGS = 48, 16
NUMERIC = 20
FEATURES = NUMERIC + TAGS + 2 * TOKEN_BUCKETS


class _Ends:
    """Where tags end. What has been looked for in vain is not looked for again, so a page is read in time in proportion."""

    def __init__(self, page: str):
        self.page, self.last = page, {q: page.rfind(q) for q in "\"'>"}

    def __call__(self, at: int) -> int:
        """The `>` of the tag whose name ends at `at`, outside quoted values; -1 where there is none, or a value is never closed and no `>` follows."""
        while (m := _STOP.search(self.page, at)) is not None:
            if m[0] == ">":
                return m.start()
            quote = m[0][-1]
            if self.last[quote] < m.end():  # a value that is never closed ends with the tag
                return self.page.find(">", m.end()) if self.last[">"] >= m.end() else -1
            at = self.page.find(quote, m.end()) + 1
        return -1


#: Raw elements whose content is characters alone: the first end tag ends them.
_CHARACTERS = _CODE | {"textarea", "title", "noscript", "iframe"}


def _raw_ends(page: str) -> dict[int, int]:
    """Where the end tag of each raw element stands, by where its start tag does; elements of one name lie in each other, but for buttons and selects, which a further one ends."""
    open_: dict[str, list[int]] = {}
    out: dict[int, int] = {}
    for m in _RAW_TAG.finditer(page):
        name = m[2].lower()
        stack = open_.setdefault(name, [])
        if m[1]:
            if stack:
                out[stack.pop()] = m.start()
        elif not stack or name not in _CHARACTERS:
            if name in ("button", "select"):
                stack.clear()
            stack.append(m.start())
    return out


def _tokens(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text, "", False, "") and ("", name, whether an end tag, attributes) in page order, in one pass; raw elements and comments left out.

    A `<` before a letter, or before `/` and a letter, begins a tag, whatever its name (but see _INLINE).
    """
    at, seek, far, tag_end, raw_end = 0, 0, page.rfind("-->"), _Ends(page), _raw_ends(page)
    last, closed = page.rfind(">"), None
    while True:
        i = page.find("<", seek)
        if i < 0 or i > last:
            break
        name, closing, attributes = "", False, ""
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4) + 3 if i + 4 <= far else page.find(">", i) + 1
        elif page[i + 1 : i + 2] in ("!", "?"):
            end = page.find(">", i) + 1
        else:
            m = _NAME.match(page, i + 1)
            name = m[1].lower() if m else ""
            end = tag_end(m.end()) + 1 if name else 0
            if end and not (name in BLOCKS or name in _RAW or name in _VOID or name in _INLINE or "-" in name or ":" in name):
                if closed is None:
                    closed = {x.lower() for x in _CLOSED.findall(page)}
                rest = page[m.end() : end - 1].strip(" \t\r\n\f/")
                end = end if name in closed or not rest or "=" in rest else 0
            if not end:  # no tag: text
                seek = i + 1
                continue
            closing, attributes = page[i + 1] == "/", page[m.end() : end - 1]
        if i > at:
            yield page[at:i], "", False, ""
        at = seek = end
        if name in _RAW:
            if not closing and not attributes.endswith("/"):
                if i in raw_end:
                    at = seek = page.find(">", raw_end[i]) + 1 or len(page)
                elif name in _CODE:
                    at = seek = len(page)
        elif name:
            yield "", name, closing, attributes
    if at < len(page):
        yield page[at:], "", False, ""


class Tree:
    """Nodes are block elements in page order; texts are (node, block, string, in a link)."""

    __slots__ = ("attributes", "parent", "tag", "texts")

    def __init__(self, page: str):
        self.tag, self.parent, self.attributes = ["html"], [-1], [""]
        self.texts: list[tuple[int, int, str, bool]] = []
        open_, places, block, links, head = [0], {}, 0, 0, False

        def cut(k: int) -> None:
            for node in open_[k:]:
                places[self.tag[node]].pop()
            del open_[k:]

        for text, name, closing, attributes in _tokens(page):
            if text:
                if not head:
                    self.texts.append((open_[-1], block, text, links > 0))
                continue
            if name == "head":
                head = not closing
            elif name == "br":
                self.texts.append((open_[-1], block, " ", False))
            elif name == "a":
                links = 0 if closing else 1
            elif name == "body":
                head = False
            elif name in BLOCKS and name != "html":
                head = head and closing
                block += 1
                if closing:
                    if places.get(name):
                        cut(places[name][-1])
                    continue
                if name in _ENDS:
                    ends, bounds = _ENDS[name]
                    k = max((places[x][-1] for x in bounds if places.get(x)), default=0)
                    inner = [places[x][i] for x in ends if (i := bisect.bisect_right(places.get(x, ()), k)) < len(places.get(x, ()))]
                    if inner:
                        cut(min(inner))
                elif len(open_) > 1 and (self.tag[open_[-1]] == "p" or name in _HEADINGS and self.tag[open_[-1]] in _HEADINGS):
                    cut(len(open_) - 1)
                self.tag.append(name)
                self.parent.append(open_[-1])
                self.attributes.append(attributes)
                if name not in _VOID and not attributes.endswith("/"):
                    places.setdefault(name, []).append(len(open_))
                    open_.append(len(self.tag) - 1)

    def names(self, node: int) -> list[str]:
        """Lower-case letter runs of class, id and role."""
        found = _NAMES.findall(self.attributes[node]) if self.attributes[node] else ()
        return [p for x in found for p in _PART.findall((x[0] or x[1] or x[2]).lower())]

    def features(self) -> np.ndarray:
        """A row for each node: density, depth, sibling and position figures, then tag and attribute-token bits, own and inherited."""
        n = len(self.tag)
        own = np.zeros((n, 6))  # characters, in links, stops, words, texts, paragraphs
        first, last = np.full(n, len(self.texts)), np.zeros(n)
        for i, (node, _, text, linked) in enumerate(self.texts):
            size = len(text)
            if not size or text.isspace():
                continue
            r = own[node]
            r[0] += size
            r[1] += size if linked else 0
            r[2] += text.count(".") + text.count(",")
            r[3] += text.count(" ") + 1
            r[4] += 1
            first[node], last[node] = min(first[node], i), i
        parent = self.parent
        depth, child, index = np.zeros(n), np.zeros(n), np.zeros(n)
        for i in range(1, n):
            p = parent[i]
            depth[i] = depth[p] + 1
            index[i] = child[p]
            child[p] += 1
        total, nodes, para = own.copy(), np.ones(n), np.array([t == "p" for t in self.tag], float)
        for i in range(n - 1, 0, -1):
            p = parent[i]
            total[p] += total[i]
            nodes[p] += nodes[i]
            para[p] += para[i]
            first[p], last[p] = min(first[p], first[i]), max(last[p], last[i])
        page, up = max(1.0, total[0, 0]), np.array([max(p, 0) for p in parent])
        size = np.maximum(1.0, total[:, 0])
        out = np.zeros((n, FEATURES), np.float32)
        span = max(1, len(self.texts))
        numbers = (
            np.log1p(total[:, 0]), np.log1p(own[:, 0]), total[:, 0] / page, total[:, 1] / size, total[:, 2] / size, nodes / size * 100, np.log1p(nodes), para / nodes,
            depth, index, child[up], index / np.maximum(1, child[up]), np.minimum(first, span) / span, last / span, total[:, 3] / size, size / np.maximum(1, nodes),
            (total[:, 1] / size)[up], total[:, 0] / size[up], np.log1p(total[up, 0]), child,
        )
        for k, x in enumerate(numbers):
            out[:, k] = x
        inherited = NUMERIC + TAGS + TOKEN_BUCKETS
        for i in range(n):
            out[i, NUMERIC + zlib.crc32(self.tag[i].encode()) % TAGS] = 1
            if i:
                out[i, inherited:] = out[parent[i], inherited:]
            for name in (f"<{self.tag[i]}", *self.names(i)) if self.tag[i] not in ("p", "li", "div") or self.attributes[i] else ():
                bucket = zlib.crc32(name.encode()) % TOKEN_BUCKETS
                out[i, NUMERIC + TAGS + bucket] = out[i, inherited + bucket] = 1
        return out

    def text(self, inside: np.ndarray) -> str:
        """Blocks of the nodes marked inside, white space made one space, joined by an empty line."""
        out, current, parts = [], -1, []
        for node, block, string, _ in [*self.texts, (0, -2, "", False)]:
            if block != current:
                if parts and (line := " ".join(html.unescape("".join(parts)).split())):
                    out.append(line)
                current, parts = block, []
            if block >= 0 and inside[node]:
                parts.append(string)
        return "\n\n".join(out)


def decode(parent: list[int], gain: np.ndarray) -> np.ndarray:
    """Which nodes are inside, given each node's log-odds.

    Along every path from the root nodes lie outside, then inside, then cut out, and never come
    back; of all such choices the one with the highest sum is taken.
    """
    n = len(parent)
    score = np.zeros((n, 3))  # outside, inside, cut out
    score[:, 1] = gain
    for i in range(n - 1, 0, -1):
        a, b, c = score[i]
        s = score[parent[i]]
        s[0] += a if a >= b else b
        s[1] += b if b >= c else c
        s[2] += c
    state = np.zeros(n, np.int8)
    state[0] = 1 if score[0, 1] > score[0, 0] else 0
    for i in range(1, n):
        s = state[parent[i]]
        state[i] = 2 if s == 2 else s + (score[i, s + 1] > score[i, s])
    return state == 1
