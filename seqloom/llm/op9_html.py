"""Main text of web pages by wrappers inferred from pages of the same host.

Union-free regular-expression inference: a page is a stream of block elements and runs of text.
Runs of equal neighbours become repeated groups; the pages of a host are aligned one after the
other with the wrapper so far, and each mismatch is resolved: differing texts become a text slot, an
element on one side only becomes optional, a repeated element a repeated group.  The result
is an expression of sequence, slot, optional and repetition, without unions.

The wrapper decides what is read.  Its content group is the least element outside of which all
running text is the same on different pages (or is noise); where several elements vary, an
<article> or <main> that holds at least half of the varying text is gone on to.  A page is matched
against the wrapper along the way to that group; what lies outside is template and goes.  Inside,
text that differs between pages (the slots) stays, and so does what only some pages have; an
element that most of at least MIN_PAGES different pages repeat word for word is template text
and goes too, unless it is a heading or such text is a large part of the pages (copies of one
article).  Pages that haven't got the group are read inside their own article, main or body.

Left out inside the group: scripts, styles, forms and their controls, menus, asides, footers,
hidden parts, by their tags, roles or states.  Names (a class or id that says advert, notice, side bar,
reader comments ...) count only together with what the page shows: such an element goes
if the text outside of all such elements is at least as long, or if it is a list of comments beside other
text.  So a name alone never takes the larger part of a page.  Blocks are joined by a blank line;
white space in a block is one space; character references are decoded once.

Pages of a host with the same structure (containers down to the second level of the body) have one
wrapper, from all of them and their whole streams.  Each partition gives partial wrappers, which
are merged in salted groups and then for the whole, so a hot host is spread over tasks like all others.
Children too long to be aligned are gathered by label into repeated groups, and by tag alone where even the
labels are too many, so a wrapper doesn't grow with the pages.  A page is read in one forward scan and in
time linear in its length, at any depth.

Defined results: null or empty html gives an empty text; a null or odd url is a host of its own ("")
and uses the same rules; repeated rows give repeated rows; extra columns are ignored.
"""
from __future__ import annotations

import hashlib
import html as htmllib
import itertools
import json
import re
import sys
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, table

#: Partial wrappers of a page structure are merged in so many groups first.
SALTS = 64
#: More children than this that differ are gathered by label instead of aligned.
LONG = 200
#: Nodes of partial wrappers that a task holds before it gives them out.
HELD_NODES = 200_000
#: Pages on which template text inside the content group has to be the same.
MIN_PAGES = 3
#: Share of a page's text that such template text may have.
MOST_TEMPLATE = 0.25
#: How much longer than the rest of the text an element may be that goes by its name.
NAMED_RATIO = 4

_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
# An attribute's value is quoted only right after =, as browsers read it.
_REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+")
_ATTR = re.compile(r"([A-Za-z_:][-\w:.]*+)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?")
_USEFUL = re.compile(r"class|id|role|hidden|style", re.I)
_RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu",
    "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "xmp",
}
#: Never running text: scripts, styles, what isn't shown, menus, side bars, footers, forms and their controls.
_DROP = {"script", "style", "template", "head", "title", "iframe", "noembed", "noframes", "nav", "menu", "aside", "footer", "form", "button", "select", "textarea", "datalist"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form"}
_NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|menu|nav|navbar|navigation|breadcrumbs?|pagination|side-?bar|footer|masthead|topbar|cookies?|consent|gdpr|notices?|alert|popup|comments?|commentlist|disqus|replies)(?=$|[\s_-])",
    re.I,
)
_COMMENTS = re.compile(r"comment|disqus|replies", re.I)
_CLOSES_P = _BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "summary", "legend"}
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "body", "html"}
_P_SCOPE = _SCOPE | {"td", "th", "li"}
_CELLS = {"td", "th"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_HOLDS = {"html", "body", "div", "section", "article", "main", "center", "table", "tbody", "tr", "td"}

#: What an element is besides running text: nothing, named like noise, a list of comments, a header.
PLAIN, NAMED, COMMENTS, HEADER = 0, 1, 2, 3


# ------------------------------------------------------------------ reading

def tokens(page: str):
    """('open', name, attributes), ('close', name) and ('text', text) of a page, in one forward scan."""
    at, end = 0, len(page)
    quotes = True  # until a tag's quotes swallow the rest of the page
    while at < end:
        if page[at] != "<":
            cut = page.find("<", at)
            cut = end if cut < 0 else cut
            yield "text", htmllib.unescape(page[at:cut]), None
            at = cut
            continue
        m = _NAME.match(page, at)
        if m is None:
            if page.startswith("<!--", at):
                cut = page.find("-->", at + 4)
                at = end if cut < 0 else cut + 3
            elif page.startswith("<![CDATA[", at):
                cut = page.find("]]>", at)
                yield "text", page[at + 9: end if cut < 0 else cut], None
                at = end if cut < 0 else cut + 3
            elif page.startswith(("<!", "<?"), at):
                cut = page.find(">", at)
                at = end if cut < 0 else cut + 1
            else:
                yield "text", "<", None
                at += 1
            continue
        name, begin = m[2].lower(), m.end()
        stop = _REST.match(page, begin).end() if quotes else page.find(">", begin)
        if quotes and stop >= end:
            quotes = False
            stop = page.find(">", begin)
        if stop < 0:  # no tag closes any more: the rest is text
            yield "text", htmllib.unescape(page[at:]), None
            return
        at = stop + 1
        if m[1]:
            yield "close", name, None
            continue
        rest = page[begin:stop]
        attrs = {k.lower(): htmllib.unescape(v.strip("\"'")) for k, v in _ATTR.findall(rest)} if _USEFUL.search(rest) else {}
        yield "open", name, attrs
        if name in _RAW:
            close = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
            yield "close", name, None
            if close is None:
                return
            cut = page.find(">", close.end())
            at = end if cut < 0 else cut + 1


class Open:
    """The open elements of a page, with the closings that HTML implies; each step in constant time."""

    def __init__(self):
        self.names: list[str] = []
        self.at: defaultdict[str, list[int]] = defaultdict(list)
        self.scope, self.p_scope, self.cells, self.blocks = [-1], [-1], [-1], [-1]
        self._kinds = ((_SCOPE, self.scope), (_P_SCOPE, self.p_scope), (_CELLS, self.cells), (_BLOCK, self.blocks))

    def push(self, name: str) -> None:
        i = len(self.names)
        self.names.append(name)
        self.at[name].append(i)
        for kind, places in self._kinds:
            if name in kind:
                places.append(i)

    def pop(self) -> None:
        name = self.names.pop()
        self.at[name].pop()
        for kind, places in self._kinds:
            if name in kind:
                places.pop()

    def last(self, name: str) -> int:
        places = self.at.get(name)
        return places[-1] if places else -1

    def implied(self, name: str) -> int:
        """How many elements a start tag closes."""
        low = len(self.names)
        if name in _CLOSES_P and (p := self.last("p")) > self.p_scope[-1]:
            low = p
        if name in _SAME:
            own = [i for i in map(self.last, _SAME[name]) if i > self.scope[-1]]
            if own:
                low = min(low, min(own) if name == "tr" else max(own))
        return len(self.names) - low

    def closed(self, name: str) -> int:
        """How many elements an end tag closes; 0 if it matches none that it may close."""
        i = self.last(name)
        if i < 0 or (name not in _BLOCK and self.blocks[-1] > i) or (name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") and self.cells[-1] > i):
            return 0
        return len(self.names) - i


def _hard(name: str, attrs: dict) -> bool:
    """Whether an element is no running text by its tag, role or state."""
    if name in _DROP:
        return True
    return bool(attrs) and ("hidden" in attrs or attrs.get("role", "").lower() in _ROLES or bool(re.search(r"display\s*:\s*none", attrs.get("style", ""))))


def _kind(name: str, attrs: dict) -> int:
    if name not in ("html", "body"):
        for k in ("class", "id"):
            if k in attrs and (m := _NAMED.search(attrs[k])):
                return COMMENTS if _COMMENTS.search(m[0]) else NAMED
    return HEADER if name == "header" else PLAIN


def key(name: str, attrs: dict) -> str:
    """An element as the alignment sees it: its tag and its first class, long numbers left out."""
    first = attrs.get("class", "").split() if attrs else ()
    return f"{name}.{re.sub('[0-9]{3,}', '0', first[0])}" if first else name


def parsed(page: str) -> list:
    """A page as a flat list: '<' + kind + key opens an element, '>' closes it, a number (the block,
    negative inside links, from 1) comes before its text.  What is never running text is left out."""
    out: list = []
    walk = Open()
    marks: list[tuple[bool, bool, bool]] = []  # (silent, shown as an element, link) of each open element
    silent = links = 0
    block, used = 1, False
    now: list[str] = []

    def flush():
        nonlocal used
        if now:
            text = "".join(now)
            now.clear()
            if not text.isspace() or used:
                out.extend((-block if links else block, text))
                used = True

    def cut():
        nonlocal block, used
        flush()
        if used:
            block, used = block + 1, False

    def pop(n):
        nonlocal silent, links
        for _ in range(n):
            name = walk.names[-1]
            walk.pop()
            quiet, shown, link = marks.pop()
            if name in _BLOCK:
                cut()
            elif shown or link:
                flush()
            if shown:
                out.append(">")
            silent -= quiet
            links -= link

    for what, x, attrs in tokens(page):
        if what == "text":
            if not silent:
                now.append(x)
        elif what == "open":
            pop(walk.implied(x))
            if x in _BLOCK:
                cut()
            elif x == "br" and not silent:
                now.append(" ")
            if x in _VOID:
                continue
            quiet = _hard(x, attrs)
            kind = _kind(x, attrs)
            shown = not silent and not quiet and (x in _BLOCK or kind != PLAIN)
            link = x == "a" and not silent
            if shown or link:
                flush()
            if shown:
                out.append(f"<{kind}{key(x, attrs)}")
            walk.push(x)
            marks.append((quiet, shown, link))
            silent += quiet
            links += link
        else:
            n = walk.closed(x)
            if n:
                pop(n)
            elif x == "p":
                cut()
    pop(len(marks))
    cut()
    return out


def structure(flat: list) -> str:
    """The structure of a page: the paths of its containers down to the second level of the body."""
    out = set()
    path: list[str] = []
    levels: list[int] = []  # levels below html and body of each open element, past 2 if not followed
    it = iter(flat)
    for x in it:
        if x.__class__ is int:
            next(it)
        elif x == ">":
            path.pop()
            levels.pop()
        else:
            name = x[2:].split(".")[0]
            up = levels[-1] if levels else 0
            level = up if name in ("html", "body") else up + 1
            if x[1] != "0" or name not in _HOLDS or level > 2 or up > 2:
                level = 3
            path.append(x[2:])
            levels.append(level)
            if level <= 2:
                out.add("/".join(path))
    return f"{_digest(*sorted(out)):x}"


def _digest(*parts) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode("utf-8", "surrogatepass"), digest_size=7).digest())


# ------------------------------------------------------------------ trees and wrappers

class Node:
    """An element, or a run of text ("#"), of a page or a wrapper.

    ``own`` is the digest of its running text, 0 without any, None where pages differ (a slot);
    ``page`` is the digest of the page's, None where the node is of different pages; ``size`` is
    the length of its running text in all ``count`` pages, a link's letter being a thousandth.
    """

    __slots__ = ("label", "kind", "kids", "own", "size", "page", "count", "repeat", "optional", "pieces")

    def __init__(self, label, kind=PLAIN, kids=None, own=0, size=0.0, page=0, count=1, repeat=False, optional=False):
        self.label, self.kind, self.kids, self.own, self.size, self.page, self.count, self.repeat, self.optional = label, kind, kids if kids is not None else [], own, size, page, count, repeat, optional
        self.pieces = None  # of a page's text: (block, text)

    @property
    def tag(self) -> str:
        return self.label.split(".")[0]


def tree(flat: list, folded: bool) -> Node:
    """The tree of a flat page; ``folded``: with runs of equal neighbours as repeated groups."""
    root = Node("^")
    stack, every = [root], [root]

    def done(node):
        below = [k.own for k in node.kids if k.own]
        node.own = _digest(*below) if below and node.kind == PLAIN else 0
        node.size = sum([k.size for k in node.kids]) if node.kind == PLAIN else 0.0
        if folded:
            node.kids = fold(node.kids)

    it = iter(flat)
    for x in it:
        if x.__class__ is int:
            text = next(it)
            top = stack[-1].kids
            if not (top and top[-1].label == "#" and abs(top[-1].pieces[-1][0]) == abs(x)):
                top.append(Node("#"))
                top[-1].pieces = []
                every.append(top[-1])
            top[-1].pieces.append((x, text))
        elif x == ">":
            stack.pop()
        else:
            node = Node(x[2:], int(x[1]))
            stack[-1].kids.append(node)
            stack.append(node)
            every.append(node)
    for node in reversed(every):  # elements after what they hold
        if node.label == "#":
            _weigh(node)
        else:
            done(node)
    for node in every:
        node.page = root.own
    return root


def _weigh(node: Node) -> None:
    words = " ".join("".join([t for _, t in node.pieces]).split())
    node.own = _digest(words) if words else 0
    node.size = sum([len(t.strip()) * (1.0 if b > 0 else 0.001) for b, t in node.pieces])


def fold(kids: list[Node]) -> list[Node]:
    """Runs of equal neighbours as repeated groups."""
    out: list[Node] = []
    for k in kids:
        if out and out[-1].label == k.label:
            a = out[-1]
            both = _digest(a.own, k.own) if a.own or k.own else 0
            out[-1] = Node(k.label, max(a.kind, k.kind), align(a.kids, k.kids), both, a.size + k.size, k.page, 1, k.label != "#")
        else:
            out.append(k)
    return out


def _same(x, y):
    return x if x == y else None


def merge(a: Node, b: Node) -> Node:
    """The union-free expression of two nodes of the same label, of different pages."""
    return Node(a.label, max(a.kind, b.kind), align(a.kids, b.kids), _same(a.own, b.own), a.size + b.size, _same(a.page, b.page), a.count + b.count, a.repeat or b.repeat, a.optional or b.optional)


def _option(x: Node) -> Node:
    x.optional = True
    return x


def align(a: list[Node], b: list[Node]) -> list[Node]:
    """Children aligned by their longest common subsequence of labels; the rest is optional."""
    head, least = 0, min(len(a), len(b))
    while head < least and a[head].label == b[head].label:
        head += 1
    tail = 0
    while tail < least - head and a[-1 - tail].label == b[-1 - tail].label:
        tail += 1
    n, m = len(a) - head - tail, len(b) - head - tail
    if max(n, m) > LONG:
        return _joined(gathered(a), gathered(b))
    out = [merge(x, y) for x, y in zip(a[:head], b[:head])]
    i, j = head, head
    if n and m:
        la, lb = [x.label for x in a[head: head + n]], [x.label for x in b[head: head + m]]
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for p in range(n - 1, -1, -1):
            for q in range(m - 1, -1, -1):
                best[p][q] = best[p + 1][q + 1] + 1 if la[p] == lb[q] else max(best[p + 1][q], best[p][q + 1])
        p = q = 0
        while p < n and q < m:
            if la[p] == lb[q]:
                out.append(merge(a[head + p], b[head + q]))
                p, q = p + 1, q + 1
            elif best[p + 1][q] >= best[p][q + 1]:
                out.append(_option(a[head + p]))
                p += 1
            else:
                out.append(_option(b[head + q]))
                q += 1
        i, j = head + p, head + q
    out += [_option(x) for x in a[i: head + n]] + [_option(x) for x in b[j: head + m]]
    if tail:
        out += [merge(x, y) for x, y in zip(a[-tail:], b[-tail:])]
    return out


def gathered(nodes: list[Node]) -> list[Node]:
    """One node for each label (each tag, if the labels are too many): what repeats is a repeated group."""
    name = (lambda x: x.label) if len({x.label for x in nodes}) <= LONG else (lambda x: x.tag)
    groups: dict[str, list] = {}
    for x in nodes:
        groups.setdefault(name(x), []).append(x)
    out = []
    for label, own in groups.items():
        node = own[0]
        if len(own) > 1:
            seen = [x.own for x in own]
            both = None if None in seen else _digest(*filter(None, seen)) if any(seen) else 0
            pages = {x.page for x in own}
            for x in own[1:]:
                node = merge(node, x)
            node.own, node.page, node.count, node.repeat = both, pages.pop() if len(pages) == 1 else None, max([x.count for x in own]), label != "#"
        node.label = label
        out.append(node)
    return out


def _joined(a: list[Node], b: list[Node]) -> list[Node]:
    """Gathered children of two pages, aligned by label (or tag)."""
    if len({x.label for x in a} | {x.label for x in b}) > LONG:
        for x in (*a, *b):
            x.label = x.tag
        a, b = gathered(a), gathered(b)
    right = {x.label: x for x in b}
    left = {x.label for x in a}
    return [merge(x, right[x.label]) if x.label in right else _option(x) for x in a] + [_option(x) for x in b if x.label not in left]


def written(root: Node) -> str:
    """A wrapper as a flat list in JSON."""
    out: list = []
    stack: list = [root]
    while stack:
        x = stack.pop()
        if x is None:
            out.append("/")
            continue
        out += [x.label, x.kind, x.own, x.size, x.page, x.count, x.repeat, x.optional]
        stack.append(None)
        stack += reversed(x.kids)
    return json.dumps(out)


def read(text: str) -> Node:
    flat = json.loads(text)
    top = Node("")
    stack, i = [top], 0
    while i < len(flat):
        if flat[i] == "/":
            stack.pop()
            i += 1
        else:
            label, kind, own, size, page, count, repeat, optional = flat[i: i + 8]
            node = Node(label, kind, None, own, size, page, count, repeat, optional)
            stack[-1].kids.append(node)
            stack.append(node)
            i += 8
    return top.kids[0]


class deep:
    """Room for recursion over trees of any depth (calls between Python functions need no C stack)."""

    def __enter__(self):
        self.old = sys.getrecursionlimit()
        sys.setrecursionlimit(10_000_000)

    def __exit__(self, *_):
        sys.setrecursionlimit(self.old)


def infer(pages: list[str]) -> Node | None:
    """The wrapper of pages of one host."""
    out = None
    with deep():
        for page in pages:
            t = tree(parsed(page), True)
            out = t if out is None else merge(out, t)
    return out


def expression(x: Node) -> str:
    """A wrapper as text: #text, #slot, (x)? and (x)+."""
    if x.label == "#":
        body = "#slot" if x.own is None else "#text"
    else:
        body = " ".join([expression(k) for k in x.kids])
        body = body if x.label == "^" else f"<{x.label}>{body}</{x.tag}>"
    body = f"({body})+" if x.repeat else body
    return f"({body})?" if x.optional else body


def constant(x: Node) -> bool:
    """Whether a node has no running text but what different pages share."""
    return x.kind != PLAIN or x.own == 0 or (x.own is not None and x.page is None)


def group(wrapper: Node) -> tuple[list[str], Node]:
    """The content group: the keys on the way to it, and its node."""
    node, path = wrapper, []
    while True:
        inner = [k for k in node.kids if not constant(k)]
        labels = {k.label for k in inner}
        rest = sum([k.size for k in node.kids if constant(k)])
        if len(labels) != 1 or inner[0].tag not in _HOLDS or rest > sum([k.size for k in inner]):
            break
        # elements of the same label are all read; the largest one shows the way on
        node = max(inner, key=lambda k: k.size)
        path.append(node.label)
    best = None
    stack: list = [(node, None)]
    while stack:
        x, way = stack.pop()
        for k in x.kids:
            if k.kind == PLAIN and k.label != "#" and k.size * 2 >= node.size and k.size:
                here = (k.label, way)
                if k.tag in ("article", "main"):
                    best = (k, here)
                stack.append((k, here))
    if best is not None and node.tag != "article":
        node, way = best
        below = []
        while way is not None:
            label, way = way
            below.append(label)
        path += reversed(below)
    return path, node


def content(wrapper: Node) -> list[str]:
    return group(wrapper)[0]


def rule(wrapper: Node) -> dict:
    """What extraction needs: the way to the content group, and the template text inside it.

    ``drop`` holds [key, digest] of elements that most of MIN_PAGES or more different pages repeat
    word for word.
    """
    path, node = group(wrapper)
    found, size = [], 0.0
    stack = [node]
    while stack:
        x = stack.pop()
        for k in x.kids:
            if k.label == "#" or k.kind != PLAIN:
                continue
            if k.own and constant(k) and k.count >= MIN_PAGES and 2 * k.count > node.count and k.tag not in _HEADINGS:
                found.append([k.label, k.own])
                size += k.size
            elif k.own is None:
                stack.append(k)
    return {"path": path, "drop": found if size <= MOST_TEMPLATE * node.size else []}


# ------------------------------------------------------------------ extraction

def _leaves(node: Node, drop, out: list) -> None:
    """Text nodes below ``node`` in page order, those of named elements with that element."""
    stack = [(node, None)]
    while stack:
        x, inside = stack.pop()
        if x.label == "#":
            out.append((x, inside))
            continue
        if inside is None and x is not node and x.kind in (NAMED, COMMENTS):
            inside = x
        kids = x.kids
        if drop:
            kept = []
            for label, run in itertools.groupby(kids, key=lambda k: k.label):
                run = list(run)
                own = run[0].own
                for k in run[1:]:
                    own = _digest(own, k.own) if own or k.own else 0
                if (label, own) not in drop:
                    kept += run
            kids = kept
        for k in reversed(kids):
            stack.append((k, inside))


def _text(nodes: list[Node], drop=(), headers: bool = True) -> str:
    """The text of page nodes.  ``headers``: whether header elements belong to it."""
    found: list = []
    for node in nodes:
        _leaves(node, drop, found)
    if not headers:
        # a header at the top of the page, outside of any article
        out_of = set()
        for node in nodes:
            stack = [node]
            while stack:
                x = stack.pop()
                for k in x.kids:
                    if k.kind == HEADER:
                        below: list = []
                        _leaves(k, (), below)
                        out_of.update(id(t) for t, _ in below)
                    elif k.tag not in ("article", "main"):
                        stack.append(k)
        found = [f for f in found if id(f[0]) not in out_of]
    size: dict[int, int] = {}
    rest = 0
    for leaf, inside in found:
        n = sum(len(t) for _, t in leaf.pieces)
        if inside is None:
            rest += n
        else:
            size[id(inside)] = size.get(id(inside), 0) + n
    blocks: dict[int, list] = {}
    for leaf, inside in found:
        if inside is not None and rest and (size[id(inside)] <= NAMED_RATIO * rest or (inside.kind == COMMENTS and _records(inside))):
            continue
        for b, t in leaf.pieces:
            blocks.setdefault(abs(b), []).append(t)
    lines = (" ".join("".join(x).split()) for x in blocks.values())
    return "\n\n".join(x for x in lines if x)


def _records(node: Node) -> bool:
    """Whether an element is a list: two children of a label, here or one level down."""
    return any(len({k.label for k in x.kids}) < len(x.kids) for x in (node, *node.kids))


def _named(root: Node, tag: str) -> list[Node]:
    """The outermost elements of a tag."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        if x.tag == tag and x.kind == PLAIN:
            out.append(x)
        else:
            stack += reversed(x.kids)
    return out


def main_of(flat: list, how: dict | None) -> str:
    """Main text of a flat page; ``how`` is the rule of its wrapper."""
    root = tree(flat, False)
    if how is not None:
        nodes = [root]
        for label in how["path"]:
            nodes = [k for x in nodes for k in x.kids if k.label == label]
        whole = not how["path"] or how["path"][-1].split(".")[0] in ("html", "body")
        drop = {(label, own) for label, own in how["drop"]}
        if text := _text(nodes, drop, not whole) or _text(nodes, (), not whole):
            return text
    for tag in ("article", "main"):
        if text := _text(_named(root, tag)):
            return text
    return _text([root], (), False) or _text([root])


def extract(page: str | None, how: dict | None = None) -> str:
    return main_of(parsed(page), how) if page else ""


# ------------------------------------------------------------------ tables

def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


SCANNED = "page_id long, url string, host string, structure string, flat string, wrapper string"


def _scan(batches):
    """Rows of pages (with ``flat``) and, now and then, of partial wrappers (with ``wrapper``)."""
    found: dict[tuple[str, str], Node] = {}
    names = [x.split()[0] for x in SCANNED.split(", ")]
    kinds = [pa.int64()] + [pa.string()] * 5
    rows: list = []
    held = size = 0

    def given():
        nonlocal rows, size
        cols = list(zip(*rows)) if rows else [()] * 6
        rows, size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    for batch in batches:
        for page_id, url, html, host in zip(*(c.to_pylist() for c in batch.columns)):
            flat = parsed(html) if html else []
            k = (host, structure(flat)) if flat else (host, None)
            if flat:
                with deep():
                    t = tree(flat, True)
                    found[k] = merge(found[k], t) if k in found else t
                held += len(flat)
            text = json.dumps(flat, ensure_ascii=True)
            rows.append((page_id, url, *k, text, None))
            size += len(text)
            if size > 8_000_000:
                yield given()
            if held > HELD_NODES:
                rows += [(None, None, *k, None, written(w)) for k, w in found.items()]
                found.clear()
                held = 0
                yield given()
    rows += [(None, None, *k, None, written(w)) for k, w in found.items()]
    yield given()


def _merged(t: pa.Table) -> Node:
    out = None
    with deep():
        for text in sorted(t["wrapper"].to_pylist()):
            w = read(text)
            out = w if out is None else merge(out, w)
    return out


def _some(t: pa.Table) -> pa.Table:
    return pa.table({**{k: [t[k][0].as_py()] for k in ("host", "structure")}, "wrapper": [written(_merged(t))]})


def _last(t: pa.Table) -> pa.Table:
    return pa.table({**{k: [t[k][0].as_py()] for k in ("host", "structure")}, "how": [json.dumps(rule(_merged(t)))]})


def wrappers(scanned: DataFrame) -> DataFrame:
    """SCANNED rows to (host, structure, how): the rule of each page structure of a host."""
    parts = scanned.filter("wrapper is not null").select("host", "structure", "wrapper")
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS))).groupBy("host", "structure", "salt").applyInArrow(_some, "host string, structure string, wrapper string")
    return stored(salted.groupBy("host", "structure").applyInArrow(_last, "host string, structure string, how string"), "wrappers")


def main_text(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) to (page_id, url, text, n_chars), one row for each row."""

    def run(batches):
        for batch in batches:
            rules: dict = {}
            text = []
            for flat, how in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if how is not None and how not in rules:
                    rules[how] = json.loads(how)
                text.append(main_of(json.loads(flat), rules.get(how)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = small_batches(pages).select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    scanned = stored(rows.mapInArrow(_scan, SCANNED), "pages")
    joined = scanned.filter("flat is not null").join(wrappers(scanned), ["host", "structure"], "left")
    return joined.select("page_id", "url", "flat", "how").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return main_text(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")))
