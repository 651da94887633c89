"""Main text of HTML pages by wrapper induction: pages of a host are aligned, constant nodes are template, varying slots content.

Alignment. Every page becomes a tree of its blocks (name: tag and classes; a hash of the text below). Pages of a host are
sorted by their outline, so that pages of one layout are neighbours, and each different page is aligned with the one before
it by simple tree matching: the largest order-preserving matching of nodes of equal names whose parents match, of equal ones
that with more equal texts. So all pages are aligned, large ones too, no host is sampled or gathered, and a host with a third
of all pages is cut between tasks like any other run of sorted rows.

Vote. For each host, path (names from the root) and block, three numbers are added up over all its different pages: on how
many the block stands there, on how many its node was aligned with one of equal text only, and on how many with one of other text.
A block is template if it stands on LEAST pages at least, on more than half of those that have its parent's path, on one page
in RARE of the host's, and its slot is constant: aligned with equal ones more than SURE times as often as with others. A text
that is common in a slot that varies (the "yes" of a table) is content, and so is what only few pages share.

Reading. A page's text is that of its outermost article and main elements that hold any text outside template, with h1
titles beside them; of a page without such, all text; less template, less regions that HTML itself names as no main text
(REGIONS, header outside an article, the roles in ROLES, forms that hold neither article, title nor most text), and less what
TIES names: as names of nav, ad and comment regions vary from page to page, a container whose class or id consists of these
words is taken as one, unless it holds most of the text and no article stands beside it. Classes of paragraphs, headings,
lists' items and inline elements mean nothing. A page of which nothing is left is read without template and ties.

Defined results: null or empty html, or html without text, gives "" and 0; a null url, or one without a host, has no
template; repeated rows each get a row and vote once; an empty table gives an empty result; further columns are not looked
at. Malformed markup is read as far as it goes: unknown end tags are passed over, open elements end with their parents; time
is linear in a page's length, and no depth is too deep.
"""

from __future__ import annotations

import re
from collections.abc import Generator, Iterable, Iterator
from hashlib import blake2b
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: A template block stands on so many pages at least, on one page in RARE of its host's, and has so many equal counterparts for each other one.
LEAST, RARE, SURE = 3, 100, 4
#: Cells of a table of one matching that are held at once; lists with more are halved. Trees with less of the smaller in common aren't aligned.
CELLS, ALIKE = 4_000_000, 0.5
#: Pages of a host that may meet in one task, where the join shuffles.
SLICE = 1_000_000
#: Cells up to which a table is faster without arrays.
SHORT = 200
#: Weights that are kept from one matching to the next, and within one.
KEPT, MEMO = 200_000, 1_000_000
#: Fixed values of HTML: elements without an end, with raw text, that stand as blocks, and that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption option body html".split())
INLINE_END = frozenset("p b i a span em strong u li".split())
#: Elements and roles that never hold main text.
REGIONS = frozenset("script style noscript iframe template textarea title head nav footer aside button select option input svg canvas object embed menu dialog audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar".split())
#: The tie-break: words that name a region, words that may stand beside them, and the elements that can be one.
TIES = frozenset("ad ads advert adverts advertisement sponsored promo comment comments replies disqus cookie cookies consent notice newsletter sidebar breadcrumb breadcrumbs related share pagination".split())
BESIDE = frozenset("area bar block box container content list section slot unit widget wrapper".split())
HOLDERS = frozenset("div section article ul ol dl table center fieldset".split())
#: Where an open paragraph, list item or cell isn't looked for any further.
P_WALL, LIST_WALL, CELL_WALL, WALL = frozenset("article section div main td li blockquote aside nav form".split()), frozenset("ul ol dl table select menu".split()), frozenset(("tr", "table")), frozenset(("article", "main", "td"))
SCOPED = P_WALL | LIST_WALL | CELL_WALL | WALL | frozenset("p li dt dd tr option td th".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>?", re.S)
ATTR = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPACES = re.compile(r"\s+")
_MASK = (1 << 64) - 1


class Node:
    __slots__ = ("kids", "name", "tag", "text", "tie")

    def __init__(self, tag: str, name: str = "", tie: bool | None = None, text: str = ""):
        #: tie: None, or whether role (True) or class and id (False) name a region.
        self.tag, self.name, self.tie, self.text = tag, name, tie, text
        self.kids: list[Node] = []


def _tied(value: str) -> bool:
    """Whether a word of a class or id consists of words that name a region."""
    for word in value.lower().split():
        parts = [p for p in re.split(r"[-_0-9]+", word) if p]
        if parts and any(p in TIES for p in parts) and all(p in TIES or p in BESIDE for p in parts):
            return True
    return False


def parse(html: str) -> Node:
    root = Node("#root")
    stack, at, low = [root], 0, None
    opens: dict[str, list[int]] = {}  # where elements of a name are open
    scopes = [(0, 0, 0, 0, 0, 0, 0)]  # for each open element: the p, li, dt or dd, tr, option, td or th in scope, and the wall

    def shut(i: int) -> None:
        while len(stack) > i:
            opens[stack.pop().tag].pop()
            scopes.pop()

    while m := TAG.search(html, at):
        if m.start() > at:
            stack[-1].kids.append(Node("#", text=unescape(html[at : m.start()])))
        at = m.end()
        if not (tag := m[2]):
            continue
        tag = tag.lower()
        if m[1]:
            if (own := opens.get(tag)) and (tag not in INLINE_END or own[-1] > scopes[-1][6]):
                shut(own[-1])
            continue
        if tag in CLOSES_P and scopes[-1][0]:
            shut(scopes[-1][0])
        slot = {"li": 1, "dt": 2, "dd": 2, "tr": 3, "option": 4, "td": 5, "th": 5}.get(tag)
        if slot and scopes[-1][slot]:
            shut(scopes[-1][slot])
        attrs = [(k.lower(), a or b or c) for k, a, b, c in ATTR.findall(m[3])] if m[3] else ()
        tie = None
        for k, v in attrs:
            if k == "role" and not ROLES.isdisjoint(v.lower().split()):
                tie = True
            elif k != "role" and tie is None and tag in HOLDERS and _tied(v):
                tie = False
        node = Node(tag, ".".join([tag, *sorted(v for k, v in attrs if k == "class")]) if attrs else tag, tie)
        stack[-1].kids.append(node)
        if tag in VOID or (m[3] or "").endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            low = html.lower() if low is None else low
            end = low.find(f"</{tag}", at)
            at = (html.find(">", end) + 1 or len(html)) if end >= 0 else len(html)
            continue
        i = len(stack)
        if tag in SCOPED:
            p, li, dd, tr, option, td, wall = scopes[-1]
            listed = tag in LIST_WALL
            scopes.append((
                i if tag == "p" else 0 if tag in P_WALL else p, i if tag == "li" else 0 if listed else li, i if slot == 2 else 0 if listed else dd, i if tag == "tr" else 0 if listed else tr,
                i if tag == "option" else 0 if listed else option, i if slot == 5 else 0 if tag in CELL_WALL else td, i if tag in WALL else wall,
            ))
        else:
            scopes.append(scopes[-1])
        opens.setdefault(tag, []).append(i)
        stack.append(node)
    if at < len(html):
        stack[-1].kids.append(Node("#", text=unescape(html[at:])))
    return root


class Page:
    """A parsed page in document order: nodes, their parents, which are out of the main text, and the blocks."""

    def __init__(self, html: str):
        self.nodes: list[Node] = []
        self.up: list[int] = []
        stack = [(parse(html), -1)]
        while stack:
            n, up = stack.pop()
            i = len(self.nodes)
            self.nodes.append(n)
            self.up.append(up)
            stack += [(k, i) for k in reversed(n.kids)]
        self.words = [SPACES.sub(" ", n.text).strip() if n.tag == "#" else "" for n in self.nodes]
        self.out = self._regions()

    def below(self, own: list[int]) -> list[int]:
        """Sums of own over whole subtrees."""
        total = list(own)
        for i in range(len(total) - 1, 0, -1):
            total[self.up[i]] += total[i]
        return total

    def _regions(self) -> list[bool]:
        """Which nodes are, or lie, in a region that isn't main text."""
        size = [len(w) for w in self.words]
        inside, fixed = [False] * len(size), [False] * len(size)
        for i, n in enumerate(self.nodes):
            up = self.up[i]
            if up >= 0:
                inside[i] = inside[up] or self.nodes[up].tag in ("article", "main")
                fixed[i] = fixed[up] or n.tag in REGIONS or n.tie is True or (n.tag == "header" and not inside[i])
        left = self.below([0 if f else s for f, s in zip(fixed, size, strict=True)])
        # text of articles and mains that aren't themselves named as a region, and titles, below each node
        prose = self.below([s if a and not f else 0 for s, a, f in zip(size, self._prose(), fixed, strict=True)])
        titles = self.below([1 if n.tag == "h1" or n.tag in ("article", "main") and n.tie is None else 0 for n in self.nodes])
        out = list(fixed)
        for i, n in enumerate(self.nodes):
            if out[i] or i == 0:
                continue
            if out[self.up[i]]:
                out[i] = True
            elif n.tag == "form":
                out[i] = not titles[i] and (prose[0] > prose[i] or left[i] * 2 <= left[0])
            elif n.tie is False:
                out[i] = prose[0] > prose[i] or (left[i] * 2 <= left[0] and not prose[i])
        return out

    def _prose(self) -> list[bool]:
        """What lies in an article or main, and in nothing there that is named as a region."""
        out = [False] * len(self.nodes)
        for i, n in enumerate(self.nodes):
            if i:
                out[i] = n.tie is None and (out[self.up[i]] or n.tag in ("article", "main"))
        return out

    def blocks(self) -> tuple[list[int], list[int], list[int], list[int]]:
        """Of each block with text, in document order: its node, its parent block's place here (-1: none), a hash of its name, and one of its text."""
        chosen, own, above = [], [], [0] * len(self.nodes)
        parts: list[list] = []
        for i, n in enumerate(self.nodes):
            near = above[self.up[i]] if i else -1
            above[i] = near
            if self.out[i]:
                continue
            if n.tag == "#":
                if self.words[i] and near >= 0:
                    parts[near].append(self.words[i])
            elif n.tag in BLOCK or i == 0:
                above[i] = len(chosen)
                if near >= 0:
                    parts[near].append(len(chosen))
                chosen.append((i, near))
                parts.append([])
        own = [0] * len(chosen)
        for k in range(len(chosen) - 1, -1, -1):
            told = [x.encode("utf-8", "surrogatepass") if isinstance(x, str) else own[x].to_bytes(8) for x in parts[k] if isinstance(x, str) or own[x]]
            if told:
                own[k] = _hash(self.nodes[chosen[k][0]].name.encode("utf-8", "surrogatepass"), *told)
        place = np.cumsum([o != 0 for o in own]) - 1
        kept = [k for k in range(len(chosen)) if own[k]]
        return [chosen[k][0] for k in kept], [int(place[chosen[k][1]]) if chosen[k][1] >= 0 else -1 for k in kept], [_hash(self.nodes[chosen[k][0]].name.encode("utf-8", "surrogatepass")) for k in kept], [own[k] for k in kept]


def _hash(*parts: bytes) -> int:
    h = blake2b(digest_size=8)
    for x in parts:
        h.update(len(x).to_bytes(8))
        h.update(x)
    return int.from_bytes(h.digest()) or 1


def _mix(a: int, b: int) -> int:
    x = ((a ^ b * 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9) & _MASK
    return (x ^ x >> 31) * 0x94D049BB133111EB & _MASK


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Tree:
    """The blocks of a page as a tree: names, texts, paths, children, and the size and kind of each subtree."""

    def __init__(self, up: list[int], name: list[int], text: list[int]):
        n = len(up)
        self.name, self.text = name, text
        self.path, self.kids, self.size, self.kind = [1] * n, [[] for _ in range(n)], [1] * n, list(name)
        for i in range(1, n):
            self.path[i] = _mix(self.path[up[i]], name[i])
            self.kids[up[i]].append(i)
        self.above = [self.path[u] if u >= 0 else 0 for u in up]
        for i in range(n - 1, -1, -1):
            for k in self.kids[i]:
                self.size[i] += self.size[k]
                self.kind[i] = _mix(self.kind[i], self.kind[k])

    def outline(self) -> int:
        """Pages of one layout mostly agree in it: the paths that hold further blocks."""
        out = 0
        for p in sorted({self.path[i] for i, k in enumerate(self.kids) if k}):
            out = _mix(out, p)
        return out


Steps = Generator[tuple[int, int], int | None, object]


class Matching:
    """Simple tree matching: the largest order-preserving matching of two trees whose matched nodes have matched parents."""

    def __init__(self) -> None:
        self.memo: dict[tuple[int, int], int] = {}  # by kinds, so pages of one layout share it

    def _known(self, a: Tree, x: int, b: Tree, y: int) -> int | None:
        """The weight of two nodes, unless their children have to be matched for it."""
        if a.name[x] != b.name[y]:
            return 0
        if a.kind[x] == b.kind[y]:
            return a.size[x]
        return self.memo.get((a.kind[x], b.kind[y])) if a.kids[x] and b.kids[y] else 1

    def _solve(self, a: Tree, x: int, b: Tree, y: int) -> Steps:
        xs, ys = a.kids[x], b.kids[y]
        if len(xs) * len(ys) > SHORT:
            return 1 + int(self._last((yield from self._weights(a, xs, b, ys, False)))[-1])
        row = [0] * (len(ys) + 1)  # the same without arrays
        for p in xs:
            above, row, best = row, [0], 0
            for n, q in enumerate(ys):
                got = self._known(a, p, b, q)
                best = max(best, above[n + 1], above[n] + ((yield p, q) if got is None else got))
                row.append(best)
        return 1 + row[-1]

    def weight(self, a: Tree, i: int, b: Tree, j: int) -> int:
        if (got := self._known(a, i, b, j)) is not None:
            return got
        stack = [(i, j, self._solve(a, i, b, j))]
        while stack:
            x, y, steps = stack[-1]
            try:
                p, q = steps.send(got)
            except StopIteration as end:
                got = end.value
                stack.pop()
                if len(self.memo) >= MEMO:  # it only saves work: what a step waits for is handed to it
                    self.memo.clear()
                self.memo[(a.kind[x], b.kind[y])] = got
            else:
                got = None
                stack.append((p, q, self._solve(a, p, b, q)))
        return got

    def _weights(self, a: Tree, xs: list[int], b: Tree, ys: list[int], texts: bool) -> Steps:
        """Weights by kinds; the kind of each of xs and ys; and their texts, where equal ones decide between equal weights. Yields pairs of nodes and is sent their weights."""
        own, other = {a.kind[x]: x for x in xs}, {b.kind[y]: y for y in ys}
        w = np.zeros((len(own), len(other)), np.int64)
        for r, p in enumerate(own.values()):
            for c, q in enumerate(other.values()):
                got = self._known(a, p, b, q)
                w[r, c] = (yield p, q) if got is None else got
        row, col = {k: n for n, k in enumerate(own)}, {k: n for n, k in enumerate(other)}
        rows, cols = [row[a.kind[x]] for x in xs], np.array([col[b.kind[y]] for y in ys])
        if not texts:
            return w, rows, cols, None, None
        return w * (min(len(xs), len(ys)) + 1), rows, cols, np.array([a.text[x] for x in xs], np.uint64), np.array([b.text[y] for y in ys], np.uint64)

    def _table(self, a: Tree, xs: list[int], b: Tree, ys: list[int]) -> tuple[np.ndarray, list[int], np.ndarray, np.ndarray, np.ndarray]:
        steps, got = self._weights(a, xs, b, ys, True), None
        while True:
            try:
                p, q = steps.send(got)
            except StopIteration as end:
                return end.value
            got = self.weight(a, p, b, q)

    @staticmethod
    def _rows(table: tuple, x0: int, x1: int, y0: int, y1: int, back: bool = False) -> Iterator[np.ndarray]:
        w, rows, cols, own, other = table
        last = np.zeros(y1 - y0 + 1, np.int64)
        yield last
        ys = slice(y0, y1)
        for x in range(x1 - 1, x0 - 1, -1) if back else range(x0, x1):
            gain = w[rows[x], cols[ys]]
            if own is not None:
                gain = gain + ((other[ys] == own[x]) & (gain > 0))
            if back:
                gain = gain[::-1]
            row = np.zeros_like(last)
            np.maximum.accumulate(np.maximum(last[1:], last[:-1] + gain), out=row[1:])
            last = row
            yield last

    def _last(self, table: tuple) -> np.ndarray:
        for row in self._rows(table, 0, len(table[1]), 0, len(table[2])):  # noqa: B007
            pass
        return row

    def _match(self, a: Tree, xs: list[int], b: Tree, ys: list[int]) -> list[tuple[int, int]]:
        """The matched ones of two lists of children: of the largest matchings the one whose partners of xs, from the last on, stand last."""
        out, table = [], self._table(a, xs, b, ys)
        w, kinds, cols, own, other = table
        todo = [(0, len(xs), 0, len(ys))]
        while todo:
            x0, x1, y0, y1 = todo.pop()
            if x1 == x0 or y1 == y0:
                continue
            if (x1 - x0) * (y1 - y0) > CELLS and x1 - x0 > 1:  # halved: the last of the best places to cut the other list follows from both halves
                mid = (x0 + x1) // 2
                for ahead in self._rows(table, x0, mid, y0, y1):  # noqa: B007
                    pass
                for behind in self._rows(table, mid, x1, y0, y1, True):  # noqa: B007
                    pass
                cut = y1 - int(np.argmax((ahead + behind[::-1])[::-1]))
                todo += [(x0, mid, y0, cut), (mid, x1, cut, y1)]
                continue
            rows = list(self._rows(table, x0, x1, y0, y1))
            i, j = x1 - x0, y1 - y0
            while i and j:
                here, x, y = rows[i][j], x0 + i - 1, y0 + j - 1
                gain = w[kinds[x], cols[y]]
                if here == rows[i - 1][j]:
                    i -= 1
                elif here == rows[i - 1][j - 1] + gain + (gain > 0 and own[x] == other[y]):
                    i, j = i - 1, j - 1
                    out.append((xs[x], ys[y]))
                else:
                    j -= 1
        return out

    def pairs(self, a: Tree, b: Tree) -> list[tuple[int, int]]:
        """The matched nodes of two trees."""
        if not a.name or not b.name or not self.weight(a, 0, b, 0):
            return []
        out, stack = [], [(0, 0)]
        while stack:
            i, j = stack.pop()
            out.append((i, j))
            if a.kids[i] and b.kids[j]:
                if a.text[i] == b.text[j]:  # equal to the last letter
                    stack += zip(a.kids[i], b.kids[j], strict=True) if a.kind[i] == b.kind[j] else self._match(a, a.kids[i], b, b.kids[j])
                else:
                    stack += self._match(a, a.kids[i], b, b.kids[j])
        if len(self.memo) > KEPT:
            self.memo.clear()
        return out


def votes(tree: Tree, before: Tree | None, matching: Matching) -> dict[tuple[int, int], tuple[int, int]]:
    """(path of the parent, text) of each block of a page, with whether its nodes are aligned with equal ones, or one with another.

    Also (path, 0), for a page that has the path, and (0, 0) for the page.
    """
    found: dict[tuple[int, int], tuple[int, int]] = {(0, 0): (0, 0)}
    found.update({(p, 0): (0, 0) for p in tree.above[1:]})
    found.update({(p, t): (0, 0) for p, t in zip(tree.above[1:], tree.text[1:], strict=True)})
    if before is not None and tree.name and matching.weight(before, 0, tree, 0) >= ALIKE * min(len(tree.name), len(before.name)):
        for i, j in matching.pairs(before, tree):
            if j:
                key = (tree.above[j], tree.text[j])
                same, other = found[key]
                found[key] = (1 - other, other) if before.text[i] == tree.text[j] else (0, 1)
    return found


def decide(n: int, same: int, other: int, of_path: int, of_host: int) -> bool:
    """Whether a block is template; the query says the same in SQL."""
    return n >= LEAST and n * 2 > of_path and n * RARE >= of_host and same > SURE * other


def induce(pages: Iterable[str]) -> frozenset[tuple[int, int]]:
    """The template of one host's pages, all at hand: what the query does with all hosts."""
    trees = {}
    for html in pages:
        page = Page(html or "")
        _, up, name, text = page.blocks()
        if name:
            trees[text[0]] = Tree(up, name, text)
    total: dict[tuple[int, int], list[int]] = {}
    before, matching = None, Matching()
    for _, _, tree in sorted(((signed(t.outline()), signed(key), t) for key, t in trees.items()), key=lambda x: x[:2]):
        _add(total, votes(tree, before, matching))
        before = tree
    of_host = total.get((0, 0), [0])[0]
    return frozenset((p, t) for (p, t), (n, same, other) in total.items() if t and decide(n, same, other, total[(p, 0)][0], of_host))


def extract(html: str | None, template: frozenset[tuple[int, int]] = frozenset()) -> str:
    """The page's main text, one line for each block, given its host's template."""
    if not html:
        return ""
    page = Page(html)
    constant: set[int] = set()
    if template:
        at, up, name, text = page.blocks()
        tree = Tree(up, name, text)
        constant = {at[k] for k in range(1, len(at)) if (tree.above[k], text[k]) in template}
    return _read(page, constant) or (_read(page, set()) if constant else "") or _read(page, set(), False)


def _read(page: Page, constant: set[int], ties: bool = True) -> str:
    """The text of articles and mains with titles beside them, or of the whole page; without template (constant) and other regions."""
    nodes, up = page.nodes, page.up
    off = [False] * len(nodes)
    prose = [False] * len(nodes)  # in an article or main that is read
    for i, n in enumerate(nodes):
        if i:
            region = page.out[i] if ties else n.tag in REGIONS
            off[i] = off[up[i]] or region or i in constant
            prose[i] = not off[i] and (prose[up[i]] or n.tag in ("article", "main"))
    if any(prose[i] and page.words[i] for i in range(len(nodes))):
        title = [False] * len(nodes)
        for i, n in enumerate(nodes):
            if i:
                title[i] = title[up[i]] or n.tag == "h1"
        off = [o or not (p or t) for o, p, t in zip(off, prose, title, strict=True)]
    lines: list[str] = []
    held: list[str] = []

    def end() -> None:
        if held:
            if line := SPACES.sub(" ", "".join(held)).strip():
                lines.append(line)
            held.clear()

    size = page.below([1] * len(nodes))
    ends: list[int] = []  # where open blocks end
    for i, n in enumerate(nodes):
        while ends and i >= ends[-1]:
            ends.pop()
            end()
        if n.tag == "#":
            if not off[i]:
                held.append(n.text)
        elif n.tag == "br":
            held.append(" ")
        elif n.tag in BLOCK:
            end()
            ends.append(i + size[i])
    end()
    return "\n".join(lines)


def host(url: str):
    return F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def trees(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """h, outline, page (hash of the text) and tree of the pages that have a host and text; a task sends equal ones once."""
    named = pages.select(host(url).alias("host"), F.col(html).alias("html")).filter((F.col("host") != "") & (F.octet_length("html") > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            rows = []
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, *columns = Page(text).blocks()
                if columns[1] and (h, columns[2][0]) not in sent:
                    sent.add((h, columns[2][0]))
                    rows.append((h, signed(Tree(*columns).outline()), signed(columns[2][0]), _packed(*columns)))
            if len(sent) > 500_000:
                sent.clear()
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(4)], names=["h", "outline", "page", "tree"])

    return named.select(F.xxhash64("host").alias("h"), "html").mapInArrow(run, "h bigint, outline bigint, page bigint, tree binary")


def _packed(up: list[int], name: list[int], text: list[int]) -> bytes:
    return np.array(up, "<i4").tobytes() + np.array(name, "<u8").tobytes() + np.array(text, "<u8").tobytes()


def _unpacked(raw: bytes) -> Tree:
    n = len(raw) // 20
    return Tree(np.frombuffer(raw, "<i4", n).tolist(), np.frombuffer(raw, "<u8", n, 4 * n).tolist(), np.frombuffer(raw, "<u8", n, 12 * n).tolist())


VOTES = "h bigint, p bigint, b bigint, n bigint, same bigint, other bigint"
EDGE = "outline bigint, page bigint, tree binary"


def _add(total: dict[tuple[int, int], list[int]], found: dict[tuple[int, int], tuple[int, int]], n: int = 1) -> None:
    for key, (same, other) in found.items():
        sums = total.setdefault(key, [0, 0, 0])
        sums[0] += n
        sums[1] += same
        sums[2] += other


def _batch(rows: list[tuple], more: list[tuple] | None = None) -> pa.RecordBatch:
    """Votes; and, where more is given, pages, whose rows have no votes."""
    kinds = [pa.int64()] * 8 + [pa.binary()] if more is not None else [pa.int64()] * 6
    names = ["h", "p", "b", "n", "same", "other", "outline", "page", "tree"][: len(kinds)]
    every = [(*r, None, None, None) for r in rows] + [(h, *[None] * 5, *rest) for h, *rest in more] if more is not None else rows
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in every], k) for i, k in enumerate(kinds)], names=names)


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pages, each aligned with the one before: the votes of each host, added up. Then the task's first and last page, whose other neighbours are elsewhere."""
    matching, at, before = Matching(), None, None
    total: dict[tuple[int, int], list[int]] = {}
    first = last = None

    def out() -> list[tuple]:
        rows = [(at[0], signed(p), signed(t), *v) for (p, t), v in total.items()]
        total.clear()
        return rows

    for batch in batches:
        for h, outline, page, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if at == (h, page):
                continue
            if at and (at[0] != h or len(total) > 200_000):
                yield _batch(out(), [])
            tree = _unpacked(raw)
            _add(total, votes(tree, before if at and at[0] == h else None, matching))
            at, before = (h, page), tree
            last = (h, outline, page, raw)
            first = first or last
    if at:
        yield _batch(out(), [first] if first == last else [first, last])


def _bridge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last pages of all tasks, sorted: the votes that the first ones have by the last ones before them. They are counted already."""
    matching, before = Matching(), None
    for batch in batches:
        for h, _, page, raw, opens in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            tree = _unpacked(raw)
            if opens and before and before[0] == h and before[1] != page:
                total: dict[tuple[int, int], list[int]] = {}
                _add(total, {k: v for k, v in votes(tree, before[2], matching).items() if any(v)}, 0)
                yield _batch([(h, signed(p), signed(t), *v) for (p, t), v in total.items()])
            before = (h, page, tree)


def counts(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """h, p, b, n, same, other: the votes on block b below path p, from all different pages of host h; with b 0, on how many the path is; with p 0 too, how many there are."""
    known = written(trees(pages, url, html), "wrapper-trees")
    order = ["h", "outline", "page"]
    found = written(known.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_align, f"{VOTES}, {EDGE}").withColumn("task", F.spark_partition_id()), "wrapper-votes")
    mine = F.row_number().over(Window.partitionBy("task").orderBy(*order)) == 1
    edges = found.filter(F.col("tree").isNotNull()).select(*order, "tree", mine.alias("opens"))  # two pages a task
    bridged = edges.repartition(1).sortWithinPartitions(*order).mapInArrow(_bridge, VOTES)
    return found.filter(F.col("tree").isNull()).select(*bridged.columns).union(bridged).groupBy("h", "p", "b").agg(*[F.sum(c).alias(c) for c in ("n", "same", "other")])


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """h (hash of the host), of_host (its different pages), template (path:block, ...)."""
    known = written(counts(pages, url, html).filter((F.col("b") == 0) | (F.col("n") >= LEAST) & (F.col("same") > SURE * F.col("other"))), "wrapper-counts")
    hosts = known.filter((F.col("p") == 0) & (F.col("b") == 0)).select("h", F.col("n").alias("of_host"))
    paths = known.filter((F.col("p") != 0) & (F.col("b") == 0)).select("h", "p", F.col("n").alias("of_path"))
    often = known.filter(F.col("b") != 0).join(paths, ["h", "p"]).join(hosts, "h").filter((F.col("n") * 2 > F.col("of_path")) & (F.col("n") * RARE >= F.col("of_host")))
    template = often.groupBy("h").agg(F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws(":", "p", "b")))).alias("template"))
    return hosts.join(template, "h").select("h", "of_host", "template")


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page. Spark broadcasts the wrappers if their table is small; else hosts of more than SLICE pages are dealt into slices."""
    learned = written(wrappers(pages, url, html).withColumn("slices", F.ceil(F.col("of_host") / SLICE).cast("int")), "wrappers")

    @F.pandas_udf("string")
    def text(htmls: pd.Series, templates: pd.Series) -> pd.Series:
        known: dict[str, frozenset] = {}
        out = []
        for h, t in zip(htmls, templates, strict=True):
            template = frozenset()
            if isinstance(t, str):
                if t not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[t] = frozenset(tuple(int(y) & _MASK for y in x.split(":")) for x in t.split(","))
                template = known[t]
            out.append(extract(h if isinstance(h, str) else None, template))
        return pd.Series(out, dtype=object)

    df = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), F.xxhash64(host(url)).alias("h"))
    large = learned.filter("slices > 1").select("h", "slices")  # at most one host for each SLICE pages
    df = df.join(F.broadcast(large), "h", "left").withColumn("slice", F.when(F.col("slices").isNotNull(), F.pmod(F.xxhash64("html", "page_id"), "slices")).otherwise(0).cast("int"))
    dealt = learned.select("h", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "template")
    df = df.join(dealt, ["h", "slice"], "left").select("page_id", "url", text("html", "template").alias("text"))
    return df.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
