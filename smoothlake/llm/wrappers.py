"""HTML extraction by wrapper induction.

A page is reduced to its tree of blocks: inline elements dissolve into text, and children of one
kind become one node. The trees of a host's pages are aligned by simple tree matching and folded
into one template. Then each page is aligned to its host's template, and the pages that have a text
at a node are counted exactly: a text on nearly all pages of its node is constant, so it is template,
and what is left are the varying slots. From the root on, the way goes down to the slot that holds
most of the host's varying running text; that slot is the content. Neither names of elements nor
class names are needed for this. They are used only beside it: an article element on the way is taken
whole; inside the content, an element or hint may name comments, adverts or menus; and on hosts of too
few pages, or without a slot that stands out, article and main elements come first.

Trees are flat arrays and no walk recurses, so the depth of a page is not bounded. Equal trees of a
host are counted as one; they are folded in the order of their hash, first by parts of a host and
then together, so a template does not depend on how pages are dealt, and no task holds a host's pages.
"""

from __future__ import annotations

import hashlib
import html
import marshal
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import html_tree, scratch


@dataclass(frozen=True)
class Settings:
    """least_pages, constant: a text on this share of so many pages or more is template. links: a share of link text that makes a menu. slot: the share of a node's running text that leads down, as long as it is half of all. rare: names of elements on less than this share of a host's pages lose their class. parts: of a host, folded apart first. broadcast_bytes: rules of up to so many bytes go to all tasks, more are joined."""

    least_pages: int = 5
    constant: float = 0.9
    links: float = 0.6
    slot: float = 0.6
    rare: float = 0.01
    parts: int = 64
    broadcast_bytes: int = 16 << 20


# Elements that never hold an article's text, those that hold none of it inside an article either, and words in a class, id or role that say the same.
NEVER = frozenset("form button select textarea template head script style noscript iframe object svg math audio video canvas".split())
BESIDE = frozenset("nav aside footer menu dialog".split())
HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adverti[sz]e\w*|sponsor\w*|promo\w*|banner|nav\w*|menu|sidebar|side-bar|footer|header|masthead|cookies?|consent|gdpr|notice|notices|alert|comment(?!ar)\w*|respond|replies|reply|disqus|"
    r"related|recommended|share|sharing|social|subscribe|newsletter|signup|breadcrumbs?|pagination|pager|popup|modal|overlay|widget|toolbar|complementary|contentinfo|search)(?:$|[\s_-])"
)
MAIN = ("article", "main")
COMMENT = re.compile(r"(?:^|[\s_-])(?:comment(?!ar)\w*|replies|reply|related|recommended)(?:$|[\s_-])")
SPACE = re.compile(r"\s+")
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements that are a part of a text and not a slot for one.
PART_OF_TEXT = HEADING | frozenset("p li ul ol dl dt dd tr td th tbody thead table blockquote pre figure figcaption address details summary".split())


@dataclass(slots=True)
class Tree:
    """Nodes in page order, parents first: a key and the children of each."""

    keys: list[str]
    kids: list[list[int]]

    def packed(self) -> bytes:
        return marshal.dumps((self.keys, self.kids))

    @staticmethod
    def unpacked(raw: bytes) -> Tree:
        return Tree(*marshal.loads(raw))


@dataclass(slots=True)
class Page:
    """A reduced page: keys and parents of its blocks, and its texts in order, each with its block and characters of links."""

    keys: list[str]
    parents: list[int]
    at: list[int]
    texts: list[str]
    links: list[int]

    def packed(self) -> bytes:
        return marshal.dumps((self.keys, self.parents, self.at, self.texts, self.links))

    @staticmethod
    def unpacked(raw: bytes) -> Page:
        return Page(*marshal.loads(raw))


def _tag(key: str) -> str:
    return key.partition(".")[0]


def _hints(key: str) -> str:
    return key.partition(".")[2]


def reduce(page: str) -> Page:
    """The blocks of a page with their own texts; scripts, forms and the like are left out."""
    out = Page(["#root"], [-1], [], [], [])
    held: list[str] = []
    linked = 0

    def flush(block: int) -> None:
        nonlocal linked
        if held:
            text = SPACE.sub(" ", html.unescape("".join(held))).strip()
            if text:
                out.at.append(block)
                out.texts.append(text)
                out.links.append(min(linked, len(text)))
            held.clear()
        linked = 0

    # children still to come, their block, whether they stand in a link, whether the block ends with them
    stack = [(iter(html_tree.parse(page).children), 0, False, True)]
    while stack:
        rest, block, link, ends = stack[-1]
        child = next(rest, None)
        if child is None:
            if ends:
                flush(block)
            stack.pop()
        elif child.key == "#text":
            held.append(child.text)
            linked += len(child.text) * link
        elif child.tag == "br":
            held.append(" ")
        elif child.tag in html_tree.INLINE:
            if not HINT.search(child.hints):
                stack.append((iter(child.children), block, link or child.tag == "a", False))
        elif child.key != "#raw":
            flush(block)
            if child.tag not in NEVER:
                out.keys.append(child.tag + re.sub(r"\d+", "#", child.key[len(child.tag) :]))
                out.parents.append(block)
                stack.append((iter(child.children), len(out.keys) - 1, link, True))
    return out


def _alike(a: set[str], b: set[str]) -> bool:
    return not a and not b or 2 * len(a & b) >= len(a | b)


def settle(page: Page, frequent: frozenset[int] | None = None) -> tuple[Tree, list[int]]:
    """The page's tree with children of one kind as one node, and the node there of each block.

    Children are of one kind if their keys are equal and half of the keys below them are. A key that
    is not among the frequent ones of the host loses its class.
    """
    n = len(page.keys)
    keys = page.keys if frequent is None else [k if name(k) in frequent else _tag(k) for k in page.keys]
    kids: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        kids[page.parents[i]].append(i)
    into = list(range(n))
    below: list[set[str]] = [set()] * n

    def absorb(a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            into[b] = a
            mine: dict[tuple[str, int], int] = {}
            count: dict[str, int] = {}
            for x in kids[a]:
                count[keys[x]] = count.get(keys[x], 0) + 1
                mine[keys[x], count[keys[x]]] = x
            count = {}
            for y in kids[b]:
                count[keys[y]] = count.get(keys[y], 0) + 1
                x = mine.get((keys[y], count[keys[y]]))
                if x is None:
                    kids[a].append(y)
                else:
                    todo.append((x, y))
            below[a] = below[a] | below[b]

    for i in range(n - 1, -1, -1):
        if len(kids[i]) > 1:
            kept: dict[str, list[int]] = {}
            order = []
            for c in kids[i]:
                same = next((x for x in kept.get(keys[c], ()) if _alike(below[x], below[c])), None)
                if same is None:
                    kept.setdefault(keys[c], []).append(c)
                    order.append(c)
                else:
                    absorb(same, c)
            kids[i] = order
        if kids[i]:
            below[i] = {keys[c] for c in kids[i]}
    number, out, todo = [-1] * n, Tree([], []), [(0, -1)]
    while todo:
        i, parent = todo.pop()
        number[i] = len(out.keys)
        out.keys.append(keys[i])
        out.kids.append([])
        if parent >= 0:
            out.kids[parent].append(number[i])
        todo += [(c, number[i]) for c in reversed(kids[i])]
    for i in range(n):
        j = i
        while into[j] != j:
            j = into[j]
        number[i] = number[j]
    return out, number


Pairs = list[tuple[int, int]]


def _matching(a: Tree, b: Tree, x: int, y: int):
    """Simple tree matching of the children of two nodes: a generator that asks for the weights of pairs of nodes and returns the number of matching nodes below and the pairs of children matched.

    The heaviest chain of pairs with equal keys, found by prefix maxima in a binary indexed tree, so children whose key the other list lacks cost next to nothing.
    """
    mine, theirs = a.kids[x], b.kids[y]
    if not mine or not theirs:
        return 0, []
    if [a.keys[c] for c in mine] == [b.keys[c] for c in theirs]:
        weight = len(mine)
        for pair in zip(mine, theirs, strict=True):
            weight += yield pair
        return weight, list(zip(mine, theirs, strict=True))
    wanted = {a.keys[c] for c in mine}
    places = [c for c in theirs if b.keys[c] in wanted]
    at: dict[str, list[int]] = {}
    for k, c in enumerate(places):
        at.setdefault(b.keys[c], []).append(k)
    best: list[tuple[int, tuple | None]] = [(0, None)] * (len(places) + 1)

    def before(k: int) -> tuple[int, tuple | None]:
        found = best[0]
        while k:
            if best[k][0] > found[0]:
                found = best[k]
            k &= k - 1
        return found

    for c in mine:
        for k in reversed(at.get(a.keys[c], ())):
            weight, chain = before(k)
            below = yield c, places[k]
            new = (weight + 1 + below, (c, places[k], chain))
            k += 1
            while k < len(best):
                if best[k][0] < new[0]:
                    best[k] = new
                k += k & -k
    weight, chain = before(len(places))
    pairs = []
    while chain:
        pairs.append(chain[:2])
        chain = chain[2]
    return weight, pairs[::-1]


def align(a: Tree, b: Tree) -> Pairs:
    """The pairs of nodes of two trees, roots first, that simple tree matching aligns."""
    known: dict[tuple[int, int], tuple[int, Pairs]] = {}

    def solve(pair: tuple[int, int]) -> Pairs:
        running = [] if pair in known else [(pair, _matching(a, b, *pair))]
        answer = None
        while running:
            at, work = running[-1]
            try:
                asked = work.send(answer)
            except StopIteration as end:
                known[at] = end.value
                answer = end.value[0]
                running.pop()
                continue
            answer = known[asked][0] if asked in known else None
            if answer is None:
                running.append((asked, _matching(a, b, *asked)))
        return known[pair][1]

    out, todo = [], [(0, 0)]
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        mine, theirs = a.kids[x], b.kids[y]
        if [a.keys[c] for c in mine] == [b.keys[c] for c in theirs]:
            todo += zip(mine, theirs, strict=True)
        elif mine and theirs:
            todo += solve((x, y))
    return out


@dataclass(slots=True)
class Template:
    """A host's tree. Of each node: the pages that have it, the characters of its own texts, and those in links."""

    tree: Tree
    pages: list[int]
    size: list[int]
    links: list[int]

    def packed(self) -> bytes:
        return marshal.dumps((self.tree.keys, self.tree.kids, self.pages, self.size, self.links))

    @staticmethod
    def unpacked(raw: bytes) -> Template:
        keys, kids, *rest = marshal.loads(raw)
        return Template(Tree(keys, kids), *rest)


def fold(t: Template, other: Template) -> Template:
    """Both templates as one; t is changed."""
    pairs = dict(align(other.tree, t.tree))
    for i in range(len(other.tree.keys)):
        if i not in pairs:
            pairs[i] = len(t.tree.keys)
            t.tree.keys.append(other.tree.keys[i])
            t.tree.kids.append([])
            for x in (t.pages, t.size, t.links):
                x.append(0)
    for i, mine in pairs.items():
        t.pages[mine] += other.pages[i]
        t.size[mine] += other.size[i]
        t.links[mine] += other.links[i]
    for i, theirs in enumerate(other.tree.kids):
        kids = t.tree.kids[pairs[i]]
        have = {c: k for k, c in enumerate(kids)}
        new: dict[int, list[int]] = {}
        last = -1
        for c in theirs:
            if pairs[c] in have:
                last = have[pairs[c]]
            else:
                new.setdefault(last, []).append(pairs[c])
        if new:
            t.tree.kids[pairs[i]] = [x for k in range(-1, len(kids)) for x in (kids[k : k + 1] if k >= 0 else []) + new.get(k, [])]
    return t


def template(pages: list[Page], frequent: frozenset[int] | None = None) -> Template:
    """The template of some pages, folded in their order."""
    out = None
    for page in pages:
        tree, node = settle(page, frequent)
        size, links = _sums(page, node, len(tree.keys))
        one = Template(tree, [1] * len(tree.keys), size, links)
        out = fold(out, one) if out else one
    return out


def _sums(page: Page, node: list[int], n: int) -> tuple[list[int], list[int]]:
    size, links = [0] * n, [0] * n
    for block, text, link in zip(page.at, page.texts, page.links, strict=True):
        size[node[block]] += len(text)
        links[node[block]] += link
    return size, links


def hash64(*parts: str) -> int:
    """A number of 64 bits, with a sign."""
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode(errors="replace"), digest_size=8).digest(), "little", signed=True)


_names: dict[str, int] = {}


def name(key: str) -> int:
    """A key's hash."""
    if key not in _names:
        if len(_names) > 100_000:
            _names.clear()
        _names[key] = hash64(key)
    return _names[key]


@dataclass
class Wrapper:
    """What a host's pages have in common: its tree, the constant texts of each node, and the labels. content: nodes below which the content is. outside: nodes below these that are none of it. menu: nodes whose texts are links."""

    tree: Tree
    pages: int
    frequent: frozenset[int] | None = None
    constant: dict[int, frozenset[int]] = field(default_factory=dict)
    inside: list[bool] = field(default_factory=list)
    menu: list[bool] = field(default_factory=list)
    aligned: dict[bytes, list[int]] = field(default_factory=dict)

    def nodes(self, page: Page) -> list[int]:
        """The template's node of each block, or -1."""
        tree, number = settle(page, self.frequent)
        key = tree.packed()
        if key not in self.aligned:
            if len(self.aligned) > 1000:
                self.aligned.clear()
            found = [-1] * len(tree.keys)
            for x, y in align(tree, self.tree):
                found[x] = y
            self.aligned[key] = found
        return [self.aligned[key][i] for i in number]


def wrapper(t: Template, constant: list[tuple[int, int, int]], s: Settings, frequent: frozenset[int] | None = None) -> Wrapper:
    """The wrapper of a template and its constant texts, each a node, a hash and the characters on all pages."""
    tree = t.tree
    n = len(tree.keys)
    out = Wrapper(tree, t.pages[0], frequent)
    running = [max(0, a - b) for a, b in zip(t.size, t.links, strict=True)]
    varying = list(running)
    held: dict[int, set[int]] = {}
    for node, text, size in constant:
        held.setdefault(node, set()).add(text)
        varying[node] = max(0, varying[node] - size)
    out.constant = {k: frozenset(v) for k, v in held.items()}
    if sum(varying) < 0.2 * sum(running):  # copies of one page, not a template
        varying = running
    order, parent, todo = [], [-1] * n, [0]
    while todo:
        i = todo.pop()
        order.append(i)
        for c in tree.kids[i]:
            parent[c] = i
        todo += reversed(tree.kids[i])
    mass, depth = list(varying), [0] * n
    for i in reversed(order):
        if i:
            mass[parent[i]] += mass[i]
    tags = [_tag(k) for k in tree.keys]
    # down to the slot that holds most of the varying text
    node, roots, sure = 0, [], t.pages[0] >= s.least_pages
    while tags[node] != "article" or COMMENT.search(_hints(tree.keys[node])):  # an article that lies on the way is taken whole
        kids = [c for c in tree.kids[node] if mass[c]]
        best = max(kids, key=lambda c: mass[c], default=None)
        if best is None or not tree.kids[best] and tags[best] in PART_OF_TEXT:
            break
        if mass[best] < max(s.slot * mass[node], 0.5 * mass[0]):
            sure = sure and varying[node] + sum(mass[c] for c in kids if tags[c] in PART_OF_TEXT) >= s.slot * mass[node]
            break
        if tags[best] in PART_OF_TEXT:
            break
        roots += [c for c in kids[: kids.index(best)] if tags[c] in HEADING]
        node = best
    roots.append(node)
    for i in order[1:]:
        depth[i] = depth[parent[i]] + 1
    if not sure:
        named = [i for i in order if tags[i] in MAIN and mass[i] and not COMMENT.search(_hints(tree.keys[i]))]
        if named:
            roots = [max(named, key=lambda i: (mass[i], -depth[i]))]
    above = set()
    for i in roots:
        while i >= 0:
            above.add(i)
            i = parent[i]
    # for each node: whether it is content, and whether an article element holds it
    out.inside, article = [False] * n, [False] * n
    holds = [False] * n
    for i in reversed(order):
        holds[i] |= tags[i] == "main" or tags[i] == "article" and not COMMENT.search(_hints(tree.keys[i]))
        if holds[i] and i:
            holds[parent[i]] = True
    beside = [False] * n
    for i in order:
        up = parent[i]
        hints = _hints(tree.keys[i])
        beside[i] = i not in above and (
            up >= 0 and beside[up] or tags[i] in BESIDE or bool(COMMENT.search(hints)) and tags[i] not in ("html", "body", "main") or tags[i] not in MAIN and bool(HINT.search(hints)) and not holds[i] and mass[i] <= 0.5 * mass[roots[-1]]
        )
        article[i] = tags[i] == "article" or up >= 0 and article[up]
        out.inside[i] = not beside[i] and (i in roots or up >= 0 and out.inside[up])
    if 2 * sum(x for x, y in zip(varying, out.inside, strict=True) if y) < sum(x for x, y in zip(running, out.inside, strict=True) if y):
        out.constant = {}  # the content is nearly the same on all pages: copies, not a template
    out.menu = [not article[i] and t.size[i] > 0 and t.links[i] >= s.links * t.size[i] for i in range(n)]
    return out


def own_wrapper(page: Page, s: Settings = Settings()) -> Wrapper:
    """The wrapper of a page alone."""
    return wrapper(template([page]), [], s)


def text_of(page: Page, rules: Wrapper) -> str:
    """The page's text by a wrapper."""
    nodes = rules.nodes(page)
    taken: list[str] = []
    constant: list[str] = []
    for block, text in zip(page.at, page.texts, strict=True):
        node = nodes[block]
        while node < 0:  # what only this page has goes with what it stands in
            block = page.parents[block]
            node = nodes[block]
        if rules.inside[node] and not rules.menu[node]:
            fixed = rules.constant.get(node)
            (constant if fixed and hash64(text) in fixed else taken).append(text)
    return " ".join(taken or constant)  # a page whose whole content is constant keeps it


def extract(page: Page, rules: Wrapper | None, s: Settings = Settings()) -> str:
    """The text of a page by its host's wrapper; by its own if there is none, or if it has no content there."""
    return rules and text_of(page, rules) or text_of(page, own_wrapper(page, s))


def induce(pages: list[Page], s: Settings = Settings()) -> Wrapper:
    """The wrapper of one host's pages, held together: what main_text() does over tables."""
    keys: dict[int, int] = {}
    for p in pages:
        for k in {name(k) for k in p.keys}:
            keys[k] = keys.get(k, 0) + 1
    least = max(2, s.rare * len(pages)) if len(pages) >= s.least_pages else 0
    frequent = frozenset(k for k, c in keys.items() if c >= least)
    trees = sorted(pages, key=lambda p: _order(settle(p, frequent)[0].packed()))
    t = template(trees, frequent)
    counts: dict[tuple[int, int], tuple[int, int]] = {}
    rules = Wrapper(t.tree, len(pages), frequent)
    for p in pages:
        nodes = rules.nodes(p)
        for (node, text), size in _distinct(p, nodes).items():
            c, total = counts.get((node, text), (0, 0))
            counts[node, text] = c + 1, total + size
    return wrapper(t, [(node, text, size) for (node, text), (c, size) in counts.items() if c >= _least(t, node, s)], s, frequent)


def _order(packed: bytes) -> tuple[int, bytes]:
    return int.from_bytes(hashlib.blake2b(packed, digest_size=8).digest(), "little", signed=True), packed


def _least(t: Template, node: int, s: Settings) -> int:
    """Pages on which a text of this node is constant."""
    return max(s.least_pages, int(np.ceil(s.constant * t.pages[node] - 1e-9)))


def _distinct(page: Page, nodes: list[int]) -> dict[tuple[int, int], int]:
    """Node and hash of the page's texts, with the running characters of each."""
    out: dict[tuple[int, int], int] = {}
    for block, text, link in zip(page.at, page.texts, page.links, strict=True):
        if nodes[block] >= 0:
            key = nodes[block], hash64(text)
            out[key] = out.get(key, 0) + len(text) - link
    return out


def _host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[f for f, _ in fields])


def _attached(rows: DataFrame, rules: DataFrame, s: Settings) -> DataFrame:
    """rows with what their host has in rules, a row per host of a written table; a host of very many rows is split by the adaptive join."""
    names = [F.coalesce(F.octet_length(c), F.lit(0)) if kind in ("binary", "string") else F.lit(16) * F.greatest(F.size(c), F.lit(1)) if kind.startswith("array") else F.lit(8) for c, kind in rules.dtypes]
    size = rules.agg(F.sum(sum(names, F.lit(0)))).first()[0] or 0
    return rows.join(F.broadcast(rules) if size <= s.broadcast_bytes else rules, "host", "left")


REDUCED = "page_id long, url string, host long, page binary, names array<long>"


def reduced(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """A row per row of pages with its host's hash, its reduced page and the hashes of the keys there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for id_, url, host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                found = reduce(page.as_py() or "")
                out.append((id_, url, host, found.packed(), sorted({name(k) for k in found.keys})))
                held += len(out[-1][3])
                if held > 8 << 20:
                    yield _batch(REDUCED, out)
                    out, held = [], 0
            yield _batch(REDUCED, out)

    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.xxhash64(_host(url)).alias("host"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, REDUCED)


def _frequent(rows: DataFrame, hosts: DataFrame, s: Settings) -> DataFrame:
    """host and the hashes of the keys on enough of its pages; no more of them than a page has on average, over the share."""
    counts = rows.select("host", F.explode("names").alias("name")).groupBy("host", "name").agg(F.count("*").alias("n"))
    least = F.when(F.col("pages") >= s.least_pages, F.greatest(F.lit(2.0), F.col("pages") * s.rare)).otherwise(0.0)
    return counts.join(hosts, "host").where(F.col("n") >= least).groupBy("host").agg(F.sort_array(F.collect_list("name")).alias("frequent"))


PART = "host long, part long, place long, template binary"


def _templates(rows: DataFrame, s: Settings) -> DataFrame:
    """The template of each host: equal trees are added up, then trees fold by part, then parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], list] = {}

        def out() -> Iterator[pa.RecordBatch]:
            found = []
            for (host, packed), (n, size, links) in held.items():
                tree, place = Tree.unpacked(packed), _order(packed)[0]
                found.append((host, place % s.parts, place, Template(tree, [n] * len(tree.keys), size.tolist(), links.tolist()).packed()))
            held.clear()
            yield _batch(PART, found)

        kept: dict[int, frozenset[int]] = {}
        for batch in batches:
            for host, raw, frequent in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if host not in kept:
                    if len(kept) > 10_000:
                        kept.clear()
                    kept[host] = frozenset(frequent.as_py() or ())
                page = Page.unpacked(raw.as_py())
                tree, node = settle(page, kept[host])
                size, links = _sums(page, node, len(tree.keys))
                x = held.setdefault((host, tree.packed()), [0, np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)])
                x[0] += 1
                x[1] += size
                x[2] += links
                if len(held) > 20_000:
                    yield from out()
        yield from out()

    def folded(keys: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, t = None, None
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("host", "part", "place")]
                for host, part, place, raw in zip(*columns, batch.column("template"), strict=True):
                    group = (host, part)[: len(keys)]
                    one = Template.unpacked(raw.as_py())
                    if group == now:
                        t = fold(t, one)
                        continue
                    if now is not None:
                        yield _batch(PART, [(now[0], now[-1], 0, t.packed())])
                    now, t = group, one
            if now is not None:
                yield _batch(PART, [(now[0], now[-1], 0, t.packed())])

        return run

    parts = rows.select("host", "page", "frequent").mapInArrow(run, PART)
    parts = parts.repartition("host", "part").sortWithinPartitions("host", "part", "place", "template").mapInArrow(folded(("host", "part")), PART)
    return parts.repartition("host").sortWithinPartitions("host", "part").mapInArrow(folded(("host",)), PART).select("host", "template")


class _Rules:
    """The wrappers that a task has loaded."""

    def __init__(self, s: Settings):
        self.s, self.held = s, {}

    def get(self, host: int, frequent, raw, constant=None) -> tuple[Template, Wrapper]:
        if host not in self.held:
            if len(self.held) > 2000:
                self.held.clear()
            t, names = Template.unpacked(raw.as_py()), frozenset(frequent.as_py() or ())
            fixed = [(x["node"], x["text"], x["size"]) for x in (constant.as_py() if constant is not None else None) or ()]
            self.held[host] = t, wrapper(t, fixed, self.s, names)
        return self.held[host]


CONSTANT = "host long, node int, text long, size long, least long"


def _constant(rows: DataFrame, s: Settings) -> DataFrame:
    """host and its constant texts: node, hash and characters of running text on all pages, counted exactly. At most pages' average texts over the share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = _Rules(s)
        for batch in batches:
            out = []
            for k, host in enumerate(batch.column(0).to_pylist()):
                t, w = rules.get(host, batch.column(2)[k], batch.column(3)[k])
                if w.pages >= s.least_pages:
                    page = Page.unpacked(batch.column(1)[k].as_py())
                    out += [(host, node, text, size, _least(t, node, s)) for (node, text), size in _distinct(page, w.nodes(page)).items()]
            yield _batch(CONSTANT, out)

    found = rows.select("host", "page", "frequent", "template").mapInArrow(run, CONSTANT).groupBy("host", "node", "text").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.max("least").alias("least"))
    return found.where("n >= least").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("node", "text", "size"))).alias("constant"))


SCHEMA = "page_id long, url string, text string, n_chars long"


def main_text(pages: DataFrame, s: Settings = Settings(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row per row of pages with its main text, empty if it has none.

    Null or empty pages have an empty text. Pages without a host in their address share a wrapper.
    Null ids and addresses stay null; repeated rows each get a row and count as pages of their own;
    very long and very deep pages are read whole; other columns are not read.
    """
    rows = scratch.save(reduced(pages, id_col, url_col, html_col), "reduced")
    hosts = rows.groupBy("host").agg(F.count("*").alias("pages"))
    rules = scratch.save(_frequent(rows, hosts, s), "frequent")
    rules = scratch.save(rules.join(_templates(_attached(rows.select("host", "page"), rules, s), s), "host"), "templates")
    constant = _constant(_attached(rows.select("host", "page"), rules, s), s)
    rules = scratch.save(rules.join(constant, "host", "left"), "wrappers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Rules(s)
        for batch in batches:
            out = []
            for k, host in enumerate(batch.column(2).to_pylist()):
                _, w = known.get(host, *(batch.column(c)[k] for c in (4, 5, 6)))
                out.append(extract(Page.unpacked(batch.column(3)[k].as_py()), w, s))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    columns = ["page_id", "url", "host", "page", "frequent", "template", "constant"]
    return _attached(rows.drop("names"), rules, s).select(*columns).mapInArrow(run, SCHEMA)
