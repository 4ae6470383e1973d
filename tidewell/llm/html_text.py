"""Main text of web pages by wrapper induction (operator 6).

Pages are parsed into whole trees of block elements with runs of text; nothing
is left out but what is never shown (scripts, styles and the like) and buttons
and such inside of a run. Pages of one host with the same outline (the paths of
their upper elements) share a layout. Reference pages of a layout are aligned by
simple tree matching: children in order, equal signatures, equal subtrees at
once. Runs whose aligned counterparts say the same on most references are
constant and become the template. What varies fills slots, the aligned elements,
and each slot is judged by what it holds on all references: the container is
the aligned element, from the root down, that has nearly all of the varying
text; slots in it stay unless they are mostly links or marked as something
else; outside of it stay headings and blocks of plain text that stand next to
the container or next to what holds it, such as a lead. One reference carries
these roles. A page is aligned with it, its elements take over the roles of
their partners, and elements without a partner those of their parent.

Marks (tag, role, class or id) are evidence about a slot, and decide alone only
where nothing is aligned. Inside an article or a container only strong marks
count (navigation, forms, adverts, reader comments); a class such as "related"
or "notice" drops nothing there that is not mostly links. Pages without a
template go by their article or main element, or else by runs that are not
mostly links, without bare text outside of the element that holds all
paragraphs. The result says what decided (`decided`: template, article or runs).

Matching is bounded for a pair of pages, not for a level: subtrees are compared
exactly until CELLS * 2 cells are spent, then by their number of children; two
very long lists of children are aligned between equal children.

References are chosen by hash, from REFERENCES slices of the pages of a host and
outline (sliced twice), in one aggregation with partial results, so a host with
a third of all pages costs no task more than another. Copies among them count
once (else an article copied within a host would look constant): references
whose runs, without those on more than half of the references, are the same or
say much the same by sketches of word pairs. Two references are enough if more
than half of either varies. Templates go to the tasks as a broadcast while they
are small (checked), otherwise by a join on host, outline and a salt. Every page
is extracted whole.

Defined cases: a null or empty html has the text ""; a null or broken url has
no host and no template; repeated rows keep one row each; unclosed and stray
tags, deep nesting and missing ends are tolerated; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import zlib
from bisect import bisect_left
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

REFERENCES = 8
OUTLINE = 3  # levels of elements that tell layouts apart
DEEP = 150  # levels that are aligned as such; what is deeper counts as there
CELLS = 10_000  # children times children that are aligned by all pairs
HELD = 0.8  # of the varying text, in the container
LINKS = 0.6  # of a text, from where it is a list of links
BROADCAST_KEYS = 500_000
SALTS = 16
SKETCH = 8  # word pairs kept of a reference's run

# Elements by what they mean for extraction.
RAW = frozenset("script style title noscript template textarea iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header html hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
DROPPED = frozenset("nav footer aside form menu dialog button select option svg object canvas audio video head".split())
ARTICLE = frozenset("article main".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption caption summary".split())
BESIDE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure table dl ul ol details".split())
NEVER_DROPPED = frozenset("html body article main".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIER = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu sidebar rail footer comment comments disqus respond replies "
    "cookie cookies consent gdpr notice notices alert share sharing social related recommended breadcrumb breadcrumbs newsletter subscribe subscription signup login popup modal overlay "
    "pagination pager widget masthead topbar toolbar skip tags byline copyright".split()
)
PAGE_HINTS = frozenset("header".split())  # outside of an article only
#: Of the hints, those that count outside of an article only, and tags alike.
WEAK = frozenset("promo promotion banner rail notice notices alert social related recommended widget masthead topbar toolbar skip tags byline copyright overlay".split())
WEAK_TAGS = frozenset("aside".split())
FRAME = frozenset("content main article post body wrapper container page layout has with no text entry story".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|\Z)",
    re.DOTALL,
)
_ATTR = re.compile(r"([a-zA-Z_:@][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("sig", "children")

    def __init__(self, sig: str):
        self.sig = sig
        self.children: list = []


class Run:
    """A run of text of one block: its text, characters of it in links,
    whether it stands in an article, and whether its element is marked as
    something else (1 weakly, 2 strongly)."""

    __slots__ = ("text", "linked", "article", "marked")

    def __init__(self, text: str, linked: int, article: bool, marked: int):
        self.text, self.linked, self.article, self.marked = text, linked, article, marked


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)} if raw.strip() else {}


def _marked(tag: str, attrs: dict[str, str], in_article: bool) -> int:
    """0, 1 (weakly marked) or 2."""
    if tag in NEVER_DROPPED:
        return 2 * ("hidden" in attrs or any(p.lower() in ("comment", "comments", "reply") for p in _PART.findall(attrs.get("class", "") + " " + attrs.get("id", ""))) and tag == "article")
    if tag in DROPPED or tag == "header" and not in_article:
        return 1 if tag in WEAK_TAGS else 2
    if not attrs:
        return 0
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in ROLES:
        return 2
    if "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return 2
    parts = {p.lower() for p in _PART.findall(attrs.get("class", "") + " " + attrs.get("id", ""))}
    if parts & FRAME:
        return 0
    hints = parts & HINTS or not in_article and parts & PAGE_HINTS
    return 0 if not hints else 2 if hints - WEAK else 1


class _Open:
    """Open elements, with what is needed to find one without a scan."""

    def __init__(self, root: Node):
        # (tag, node, marked, article, link, whether its block is marked)
        self.stack = [("", root, 0, False, False, 0)]
        self.blocks: list[int] = []
        self.places: dict[str, list[int]] = {}

    def push(self, tag: str, *rest):
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, *rest))

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def pop_to(self, index: int):
        while len(self.stack) > index:
            tag = self.stack.pop()[0]
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()


def parse(page: str) -> Node:
    """The tree of a page's block elements with all text that is shown."""
    root = Node("")
    opened = _Open(root)
    stack = opened.stack
    run: list[str] = []
    linked = 0

    def flush():
        nonlocal linked
        if run:
            text = _SPACE.sub(" ", "".join(run)).strip()
            if text:
                _, node, _, article, _, marked = stack[-1]
                node.children.append(Run(text, linked, article, marked))
            run.clear()
        linked = 0

    def close(index: int):
        if opened.blocks and opened.blocks[-1] >= index:
            flush()
        opened.pop_to(index)

    def say(text: str):
        nonlocal linked
        _, _, marked, _, link, block = stack[-1]
        if text and marked == block:  # marked parts of a block's text go
            if "&" in text:
                text = entities.unescape(text)
            run.append(text)
            if link:
                linked += len(text)

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if m["start"]:
            tag = m["start"].lower()
            if tag in RAW:
                end = re.compile(rf"</{tag}[^>]*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else n
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                elif tag in ("br", "wbr"):
                    say(" " if tag == "br" else "")
                continue
            if tag in BLOCK:
                if tag in CLOSED_BY:
                    open_ = opened.last(CLOSED_BY[tag])
                    if open_ > opened.last(BARRIER[tag]):
                        close(open_)
                if opened.blocks and stack[opened.blocks[-1]][0] == "p":
                    close(opened.blocks[-1])
            _, node, marked, article, link, block = stack[-1]
            attrs = _attributes(m["attrs"])
            marked = max(marked, _marked(tag, attrs, article))
            if tag in BLOCK:
                flush()
                block = marked
                kind = " ".join(sorted(attrs.get("class", "").split()))
                child = Node(f"{tag}.{kind}" if kind else tag)
                node.children.append(child)
                node = child
                article = article or tag in ARTICLE or attrs.get("role") == "main" or attrs.get("itemprop") == "articleBody"
            opened.push(tag, node, marked, article, link or tag == "a", block)
        elif m["end"]:
            tag = m["end"].lower()
            open_ = opened.last((tag,))
            if open_ and (tag in BLOCK or open_ > (opened.blocks[-1] if opened.blocks else 0)):
                close(open_)
    flush()
    return root


def runs(root: Node) -> list[tuple[str, Run]]:
    """(path, run) in page order."""
    out, todo = [], [("", root)]
    while todo:
        path, node = todo.pop()
        if isinstance(node, Run):
            out.append((path, node))
            continue
        here = f"{path}/{node.sig}" if node.sig else path
        todo.extend((here, c) for c in reversed(node.children))
    return out


def outline(root: Node) -> int:
    """Names the layout: the paths of the elements of the upper levels."""
    paths, level = set(), [("", c) for c in root.children]
    for _ in range(OUTLINE):
        level = [(f"{path}/{c.sig}", c) for path, c in level if isinstance(c, Node)]
        paths.update(path for path, _ in level)
        level = [(path, d) for path, c in level for d in c.children]
    return key("", "\n".join(sorted(paths)))


def key(path: str, text: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{path}\0{text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


# ---------------------------------------------------------------- alignment


def sketch(text: str) -> list[int]:
    """The SKETCH least hashes of a text's word pairs: an edited text keeps
    most of them, another text has few."""
    w = text.lower().split()
    return sorted({zlib.crc32(f"{a} {b}".encode("utf-8", "surrogatepass")) for a, b in zip(w, w[1:] or [""])})[:SKETCH]


def tree(root: Node, named: bool = True) -> list:
    """The page for alignment. An element is [signature, name of what it holds,
    children]; a run is ["#", key, sketch, characters, of these in links, mark,
    the run]. Deeper levels than DEEP count as there, in page order. Without
    names (and keys and sketches) it is good for loose matching only."""
    top: list = ["", 0, []]
    todo, order = [("", c, top, 0) for c in reversed(root.children)], [("", top)]
    while todo:
        path, node, out, depth = todo.pop()
        if isinstance(node, Run):
            text = node.text
            out[2].append(["#", key(path, text) if named else 0, sketch(text) if named else (), len(text), node.linked, node.marked, node])
            continue
        here = f"{path}/{node.sig}" if named else ""
        if depth < DEEP:
            new: list = [node.sig, 0, []]
            out[2].append(new)
            if named:
                order.append((here, new))
        else:
            new = out
        todo.extend((here, c, new, depth + 1) for c in reversed(node.children))
    if named:
        for path, out in reversed(order):
            out[1] = key(path, " ".join(str(c[1]) for c in out[2]))
    return top


def skeleton(root: Node) -> str:
    """tree() without the runs, as JSON."""
    return json.dumps(tree(root), default=lambda run: None)


def leaves(tree: list) -> dict[int, list[int]]:
    """Key and sketch of each run."""
    out, todo = {}, [tree]
    while todo:
        t = todo.pop()
        if t[0] == "#":
            out[t[1]] = t[2]
        else:
            todo += t[2]
    return out


def different(trees: list[list]) -> list[list]:
    """The trees without copies of earlier ones, told by the runs that vary:
    those that are not on more than half of the trees."""
    own = [leaves(t) for t in trees]
    on = Counter(k for o in own for k in o)
    kept: list[tuple[list, set[int], set[int]]] = []
    for t, o in zip(trees, own):
        vary = {k for k in o if 2 * on[k] <= len(trees)}
        said = {h for k in vary for h in o[k]}
        if o and not any(vary == v or alike(vary, v, 0.6) or alike(said, s, 0.5) for _, v, s in kept):
            kept.append((t, vary, said))
    return [t for t, _, _ in kept]


def alike(a: set[int], b: set[int], share: float) -> bool:
    return len(a | b) >= 4 and len(a & b) > share * len(a | b)


def flat(a: list) -> bool:
    """Whether an element holds runs only."""
    return all(c[0] == "#" for c in a[2])


class Matcher:
    """Simple tree matching of two trees. Scores of pairs of subtrees are kept;
    when the cells are spent, a pair counts as many children as either has.
    Loose matching is for pages and templates, whose slots hold other texts: it
    takes no names, and elements without elements in them (paragraphs, list
    items) are aligned in order from both ends as long as their signatures are
    the same."""

    def __init__(self, loose: bool = False):
        self.left, self.loose = 2 * CELLS, loose
        self.scores: dict[tuple[int, int], int] = {}
        self.sizes: dict[int, int] = {}

    def size(self, a: list) -> int:
        """Runs of a subtree."""
        if a[0] == "#":
            return 1
        n = self.sizes.get(id(a))
        if n is None:
            n = self.sizes[id(a)] = sum(map(self.size, a[2]))
        return n

    def score(self, a: list, b: list) -> int:
        """Elements of the best alignment, equal runs counted double."""
        if a[0] != b[0]:
            return 0
        if a[0] == "#":
            return 2 if a[1] == b[1] else 1
        if a[1] == b[1] and not self.loose:
            return self.whole(a)
        known = self.scores.get((id(a), id(b)))
        if known is None:
            same, x, y = self.trimmed(a[2], b[2])
            known = 1 + (2 * len(same) if self.loose else sum(self.whole(c) for c, _ in same))
            if len(x) * len(y) > min(CELLS, self.left):
                known += min(len(x), len(y))
            else:
                self.left -= len(x) * len(y)
                known += self.table(x, y)[-1][-1]
            self.scores[id(a), id(b)] = known
        return known

    def trimmed(self, x: list, y: list) -> tuple[list, list, list]:
        """Pairs of children at both ends that are equal (loosely: flat and of
        one signature), and what is left between them."""
        if self.loose:
            alike = lambda c, d: c[0] == d[0] and (c[0] == "#" or flat(c) and flat(d))
        else:
            alike = lambda c, d: c[1] == d[1] and c[0] == d[0]
        first, most = 0, min(len(x), len(y))
        while first < most and alike(x[first], y[first]):
            first += 1
        last = 0
        while last < most - first and alike(x[-1 - last], y[-1 - last]):
            last += 1
        ends = [*zip(x[:first], y[:first]), *zip(x[len(x) - last :], y[len(y) - last :])]
        return ends, x[first : len(x) - last], y[first : len(y) - last]

    def whole(self, a: list) -> int:
        """The score of a subtree with its equal."""
        return 2 if a[0] == "#" else 1 + 2 * self.size(a)

    def table(self, x: list, y: list) -> list[list[int]]:
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, c in enumerate(x):
            row, up = best[i + 1], best[i]
            for j, d in enumerate(y):
                n = self.score(c, d)
                row[j + 1] = max(up[j + 1], row[j], up[j] + n) if n else max(up[j + 1], row[j])
        return best

    def pairs(self, a: list, b: list):
        """Aligned (element or run of a, of b), parents before children."""
        todo = [(a, b)]
        while todo:
            c, d = todo.pop()
            if c[0] != d[0]:
                continue
            yield c, d
            if c[0] == "#":
                continue
            if c[1] == d[1] and not self.loose:
                todo.extend(zip(c[2], d[2]))
                continue
            same, x, y = self.trimmed(c[2], d[2])
            todo += same
            if not x or not y:
                continue
            if len(x) * len(y) > CELLS:
                todo += between_equal(x, y)
                continue
            best, i, j = self.table(x, y), len(x), len(y)
            while i and j:
                n = self.score(x[i - 1], y[j - 1])
                if n and best[i][j] == best[i - 1][j - 1] + n:
                    i, j = i - 1, j - 1
                    todo.append((x[i], y[j]))
                elif best[i][j] == best[i - 1][j]:
                    i -= 1
                else:
                    j -= 1


def between_equal(x: list, y: list) -> list[tuple]:
    """Long lists of children: the longest ascending chain of children that
    are equal and occur once in either list is aligned, and what lies between
    two of them in order."""
    once = lambda cs: {k: i for k, i in ((c[1], i) for i, c in enumerate(cs)) if counts[k] == 1}
    counts = Counter(c[1] for c in x)
    left = once(x)
    counts = Counter(c[1] for c in y)
    right = once(y)
    pairs = sorted((i, right[k]) for k, i in left.items() if k in right)
    tails: list[int] = []
    chain: list[tuple[int, int | None]] = []
    for n, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j, key=lambda m: pairs[m][1])
        chain.append((n, tails[at - 1] if at else None))
        tails[at : at + 1] = [n]
    picked, n = [], tails[-1] if tails else None
    while n is not None:
        picked.append(pairs[n])
        n = chain[n][1]
    out, i, j = [], 0, 0
    for a, b in [*reversed(picked), (len(x), len(y))]:
        out += [(c, d) for c, d in zip(x[i:a], y[j:b]) if c[0] == d[0]]
        if a < len(x):
            out.append((x[a], y[b]))
        i, j = a + 1, b + 1
    return out


def same_runs(a: list, b: list, out: set[int]) -> int:
    """The score of two trees; keys of aligned equal runs go to `out`."""
    m = Matcher()
    out.update(c[1] for c, d in m.pairs(a, b) if c[0] == "#" and c[1] == d[1])
    return m.score(a, b)


# ---------------------------------------------------------------- slots

#: Roles of aligned elements: kept, dropped inside the container, holding the
#: container, and outside of it.
KEPT, DROPPED_SLOT, HOLDER, OUTSIDE = "k", "d", "h", "o"


def tag_of(sig: str) -> str:
    return sig.split(".")[0]


class Slot:
    """What an element holds on all references: characters, those in links,
    those marked strongly or at all, and the weight of what varies."""

    __slots__ = ("chars", "linked", "strong", "marked", "volume")

    def __init__(self):
        self.chars = self.linked = self.strong = self.marked = 0
        self.volume = 0.0

    def add(self, other: "Slot") -> None:
        for f in self.__slots__:
            setattr(self, f, getattr(self, f) + getattr(other, f))

    def links(self) -> bool:
        return self.linked > LINKS * self.chars


def measured(base: list, others: list[list], constant: set[int]) -> dict[int, Slot]:
    """The slots of base's elements, by id: runs of a reference count for the
    element that they or the nearest element around them are aligned with."""
    slots: dict[int, Slot] = {}
    for other in [base, *others]:
        partner = {id(d): c for c, d in Matcher().pairs(base, other)} if other is not base else None
        todo = [(other, base, "")]
        while todo:
            t, around, tag = todo.pop()
            here = t if partner is None else partner.get(id(t), around)
            if t[0] != "#":
                todo += [(c, here, tag_of(t[0])) for c in t[2]]
                continue
            s = slots.setdefault(id(here), Slot())
            s.chars += t[3]
            s.linked += t[4]
            s.strong += t[3] * (t[5] == 2)
            s.marked += t[3] * (t[5] > 0)
            if t[1] not in constant and not t[5] and t[4] <= LINKS * t[3]:
                s.volume += t[3] * (1.0 if tag in TEXTUAL else 0.25)
    order, todo = [], [base]
    while todo:
        t = todo.pop()
        order.append(t)
        if t[0] != "#":
            todo += t[2]
    for t in reversed(order):
        s = slots.setdefault(id(t), Slot())
        if t[0] != "#":
            for c in t[2]:
                s.add(slots[id(c)])
    return slots


def roles(base: list, slots: dict[int, Slot]) -> dict[int, str]:
    """The role of each of base's elements, by id."""
    out, here = {id(base): HOLDER}, base
    while True:
        volume = slots[id(here)].volume
        down = [c for c in here[2] if c[0] != "#" and len(c[2]) > 1 and slots[id(c)].volume >= HELD * volume > 0]
        if not down:
            # An element that holds but one other passes for it.
            down = [c for c in here[2] if c[0] != "#" and slots[id(c)].volume >= HELD * volume > 0 and any(k[0] != "#" and k[2] for k in c[2])]
        if not down:
            break
        here = max(down, key=lambda c: slots[id(c)].volume)
        out[id(here)] = HOLDER
    todo = [(base, None)]
    while todo:
        t, above = todo.pop()
        held = out.get(id(t)) == HOLDER
        if t is here:
            role = KEPT
        elif held:
            role = HOLDER
        elif above == KEPT:
            s = slots[id(t)]
            role = DROPPED_SLOT if t[0] != "#" and s.chars and (2 * s.strong > s.chars or s.links()) else KEPT
        elif above == HOLDER:
            s = slots[id(t)]
            role = KEPT if (t[0] == "#" or tag_of(t[0]) in BESIDE) and beside(t, s) else OUTSIDE
        else:
            role = OUTSIDE if above == OUTSIDE and tag_of(t[0]) != "h1" else DROPPED_SLOT if above == DROPPED_SLOT else KEPT
        out[id(t)] = role
        if t[0] != "#":
            todo += [(c, role) for c in t[2]]
    return out


def beside(t: list, s: Slot) -> bool:
    """Whether something next to the container belongs to it: text that is no
    list of links and not marked."""
    return t[0] != "#" and s.chars > 0 and not 2 * s.marked > s.chars and not s.links()


def induce(skeletons: list[str]) -> tuple[list[int], str]:
    """Keys of the runs that are constant over a layout's reference pages, and
    the reference that carries the roles, as JSON; ([], "") where pages are too
    few."""
    trees = different([json.loads(s) for s in sorted(set(skeletons))])
    if len(trees) < 2:
        return [], ""
    agree: Counter = Counter()
    total = [0] * len(trees)
    for i in range(len(trees)):
        for j in range(i):
            same: set[int] = set()
            n = same_runs(trees[i], trees[j], same)
            agree.update((k, a) for a in same for k in (i, j))
            total[i], total[j] = total[i] + n, total[j] + n
    need = max(min(2, len(trees) - 1), len(trees) // 2)
    constant = {a for (_, a), n in agree.items() if n >= need}
    if len(trees) == 2:  # a copy or a template: half of either must vary
        for t in trees:
            sizes = lengths(t)
            if 2 * sum(n for k, n in sizes.items() if k in constant) > sum(sizes.values()):
                return [], ""
    at = max(range(len(trees)), key=lambda i: (total[i], -i))
    base = trees[at]
    role = roles(base, measured(base, trees[:at] + trees[at + 1 :], constant))

    def slim(t: list) -> list:
        return ["#", t[1], role[id(t)]] if t[0] == "#" else [t[0], t[1], [slim(c) for c in t[2]], role[id(t)]]

    return sorted(constant), json.dumps(slim(base))


def lengths(tree: list) -> dict[int, int]:
    """Characters of each run, 0 of those that are marked."""
    out, todo = {}, [tree]
    while todo:
        t = todo.pop()
        if t[0] == "#":
            out[t[1]] = 0 if t[5] else t[3]
        else:
            todo += t[2]
    return out


# ---------------------------------------------------------------- extraction


@lru_cache(256)
def _loaded(template: str) -> list:
    return json.loads(template)


def _runs(page: list):
    """(run, tag of its element, elements above it) of a tree, in page order."""
    todo = [(page, "", ())]
    while todo:
        t, tag, above = todo.pop()
        if t[0] == "#":
            yield t, tag, above
        else:
            todo += [(c, tag_of(t[0]), (*above, id(t))) for c in reversed(t[2])]


def taken_over(page: list, template: list) -> dict[int, str]:
    """Roles of a page's elements and runs by id: their partners' in the
    template, else what their parent's role makes of them."""
    partner = {id(d): c[-1] for c, d in Matcher(loose=True).pairs(template, page)}
    out: dict[int, str] = {}
    todo = [(page, HOLDER)]
    while todo:
        t, above = todo.pop()
        role = partner.get(id(t))
        if role is None:
            role = above
            if t[0] != "#" and above in (HOLDER, KEPT):
                s = Slot()
                for r, _, _ in _runs(t):
                    s.chars, s.linked, s.strong, s.marked = s.chars + r[3], s.linked + r[4], s.strong + r[3] * (r[5] == 2), s.marked + r[3] * (r[5] > 0)
                if above == HOLDER:
                    role = KEPT if tag_of(t[0]) in BESIDE and beside(t, s) else OUTSIDE
                elif s.chars and (2 * s.strong > s.chars or s.links()):
                    role = DROPPED_SLOT
        out[id(t)] = role
        if t[0] != "#":
            todo += [(c, role) for c in t[2]]
    return out


def _bare(page: list, kept: list[tuple]) -> list[tuple]:
    """Runs without bare text outside of the element that holds all paragraphs,
    where paragraphs and the like are most of the text."""
    plain = [(r, above) for r, tag, above in kept if tag in TEXTUAL]
    if not plain or 2 * sum(r[3] for r, _ in plain) < sum(r[3] for r, _, _ in kept):
        return kept
    inside = set(plain[0][1][:-1]).intersection(*(above[:-1] for _, above in plain[1:]))
    depth = len(inside)
    return [(r, tag, above) for r, tag, above in kept if tag in TEXTUAL or depth and len(above) >= depth and above[depth - 1] in inside]


def extract(page: str, templates: dict | None = None) -> tuple[str, str]:
    """(main text, what decided it: template, article or runs); templates:
    outline -> (constant keys, the reference with roles)."""
    root = parse(page)
    constant, template = (templates or {}).get(outline(root), ((), "")) if templates else ((), "")
    whole = tree(root, named=bool(constant))
    found = [(r, tag, above) for r, tag, above in _runs(whole) if not constant or r[1] not in constant]
    role = taken_over(whole, _loaded(template)) if template else {}
    by_slots = any(role.get(id(r)) == KEPT and not r[5] for r, _, _ in found)
    if by_slots:
        kept = [x for x in found if x[0][5] < 2 and role[id(x[0])] in (KEPT, HOLDER)]
    else:
        kept = [x for x in found if not x[0][5]]
    # A page may be a list of which one short item is an article. Inside an
    # article weak marks drop links only.
    article = [x for x in found if x[0][6].article and x[0][5] < 2 and role.get(id(x[0])) != DROPPED_SLOT and not (x[0][5] and x[0][4] > LINKS * x[0][3])]
    decided = "template" if by_slots else "runs"
    if article and 4 * sum(r[3] for r, _, _ in article) >= sum(r[3] - r[4] for r, _, _ in kept if not r[6].article):
        kept, decided = article, "template" if by_slots else "article"
    elif not by_slots:
        kept = _bare(whole, [x for x in kept if x[0][4] <= LINKS * x[0][3]])
    return "\n\n".join(r[6].text for r, _, _ in kept), decided


def host(url):
    """Lower-case host of a url, "" without one."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def templates(pages: DataFrame, references: int = REFERENCES, html: str = "html", url: str = "url") -> DataFrame:
    """host, layout, constant (keys of the constant runs), container (the
    reference with the roles of its slots): of each layout of a host that has a
    template."""
    rows = pages.select(host(F.col(url)).alias("host"), C.text_of(html).alias("_text")).where("host <> ''")

    def layouts(batch: pa.RecordBatch) -> dict:
        return dict(zip(batch.schema.names, batch.columns)) | {"layout": [outline(parse(t)) for t in batch.column(1).to_pylist()]}

    drawn = C.map_arrow(rows.withColumn("rank", F.xxhash64("_text")), layouts, "host string, _text string, rank long, layout long", "_text")
    # Two slicings: pages of a small layout that meet in one seldom meet in both.
    one, two = F.pmod("rank", F.lit(references)), F.pmod(F.shiftright("rank", 32), F.lit(references)) + references
    slices = drawn.withColumn("slice", F.explode(F.array(one, two))).groupBy("host", "layout", "slice").agg(F.min_by("_text", "rank").alias("page"), F.min("rank").alias("rank"))

    def per_layout(table: pa.Table) -> pa.Table:
        pages_ = dict(sorted(zip(table.column("rank").to_pylist(), table.column("page").to_pylist())))  # twice `references` at most
        constant, inside = induce([skeleton(parse(p)) for p in list(pages_.values())[:references]])
        return table.select(["host", "layout"]).slice(0, 1).append_column("constant", pa.array([constant], pa.list_(pa.int64()))).append_column("container", pa.array([inside], pa.string()))

    found = slices.groupBy("host", "layout").applyInArrow(per_layout, "host string, layout long, constant array<long>, container string")
    return found.where("container <> ''")


def main_text(pages: DataFrame, references: int = REFERENCES, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html", url: str = "url") -> DataFrame:
    """`keep`, text and decided: the main text of each page and whether a
    template, the article's mark or the runs alone decided it."""
    types = dict(pages.dtypes)
    found = C.staged(templates(pages, references, html, url), "templates")
    rows = pages.select(*keep, host(F.col(url)).alias("_host"), C.text_of(html).alias("_text"))
    schema = ", ".join([f"`{k}` {types[k]}" for k in keep] + ["text string", "decided string"])
    size = found.agg(F.coalesce(F.sum(F.size("constant") + F.length("container") / 16), F.lit(0))).first()[0]
    n = len(keep)

    def done(batch: pa.RecordBatch, own) -> dict:
        out = [extract(t, o) for t, o in zip(batch.column(n + 1).to_pylist(), own)]
        return {k: batch.column(i) for i, k in enumerate(keep)} | {"text": [t for t, _ in out], "decided": [d for _, d in out]}

    if size <= BROADCAST_KEYS:
        known: dict[str, dict] = {}
        for r in found.collect():
            known.setdefault(r.host, {})[r.layout] = frozenset(r.constant), r.container
        return C.map_arrow(rows, lambda batch: done(batch, [known.get(h) for h in batch.column(n).to_pylist()]), schema, "_text")

    def with_layout(batch: pa.RecordBatch) -> dict:
        return dict(zip(batch.schema.names, batch.columns)) | {"_layout": [outline(parse(t)) for t in batch.column(n + 1).to_pylist()]}

    salted = found.select(F.col("host").alias("_host"), F.col("layout").alias("_layout"), F.struct("constant", "container").alias("_template"), F.explode(F.array(*map(F.lit, range(SALTS)))).alias("_salt"))
    full = ", ".join([f"`{k}` {types[k]}" for k in keep] + ["_host string, _text string, _layout long"])
    dealt = C.map_arrow(rows, with_layout, full, "_text").withColumn("_salt", F.pmod(F.xxhash64("_text"), F.lit(SALTS)).cast("int"))
    joined = dealt.join(salted, ["_host", "_layout", "_salt"], "left").select(*keep, F.when(F.col("_template").isNotNull(), F.struct("_layout", "_template.constant", "_template.container")).alias("_own"), "_text")

    def with_own(batch: pa.RecordBatch) -> dict:
        return done(batch, [o and {o["_layout"]: (frozenset(o["constant"]), o["container"])} for o in batch.column(n).to_pylist()])

    return C.map_arrow(joined, with_own, schema, "_text")


def op6_html_text(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
