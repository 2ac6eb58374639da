"""Main text of web pages by wrapper induction.

A page becomes a tree of its block elements, menus, footers and the like included; consecutive siblings with one
label and no blocks inside are the items of one repeated slot, so trees stay small.  Every page is aligned by simple
tree matching with a reference page of its host and layout (the smallest page id with text) and with the one of the
host's most usual layout.  An item of the reference that reads the same on most pages that differ in their main slot is
part of the host's template, wherever it stands: menus, footers, notices and set phrases inside articles alike.  Slots
that vary are content unless their element or class says otherwise or, outside of the article, their text is mostly
links.  What is learned from a host are counts by item, summed before they are shuffled; no host's pages meet in one
task.
"""

from __future__ import annotations

import html
import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import drop_stage, small_batches, stage

#: Share of the compared pages on which a template item reads the same, and the fewest pages compared.
CONSTANT_SHARE, LEAST_PAGES, LINK_SHARE = 0.6, 3, 0.5
#: Counts the compared pages of a host, beside the numbers of its items.
PAGE = -1
#: Slots wider than this (children times children) are aligned row by row, with the same result.
WIDE, ROWS = 10_000, 256
#: Hosts and bytes of (compressed) reference pages up to which they are broadcast; beyond, pages are shuffled by host.
SMALL_HOSTS, SMALL_BYTES = 100_000, 32 << 20
# fixed values: the elements of HTML by their part in a page
_BLOCK = frozenset("html body main article section div header footer nav aside form fieldset table thead tbody tfoot tr td th caption ul ol li dl dt dd p pre blockquote figure figcaption h1 h2 h3 h4 h5 h6 hr address details summary dialog center menu hgroup search".split())
_DROP = frozenset("head script style noscript template iframe object embed applet svg canvas video audio picture map nav footer aside form fieldset button select textarea input label dialog menu search".split())
_RAW = frozenset("script style noscript template iframe svg canvas textarea title xmp noembed noframes select button".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_P = _BLOCK - {"html", "body"}
_SIBLINGS = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "tbody": frozenset(["thead", "tbody", "tfoot", "tr", "td", "th"]), "tfoot": frozenset(["thead", "tbody", "tfoot", "tr", "td", "th"])}
_HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
_RUNS = _HEADS | frozenset("p pre blockquote ul ol li dl dt dd".split())
_FRAME = frozenset("div section article main header table center".split())
_NUMBER = re.compile(r"\d{2,}")
_HOLDERS = frozenset("ul ol dl table thead tbody tfoot tr div section article main body".split())
#: Words of class, id and role that name a part of the page other than its article.
_PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted nav navbar navigation menu breadcrumb breadcrumbs sidebar rail widget widgets footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social comment comments commentlist disqus reply replies respond related recommended recommendations pagination pager tags copyright legal disclaimer skip hidden contentinfo complementary".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form".split())
_OPEN = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_REST = re.compile(r"""(?:[^>"']|"[^"]*+"|'[^']*+')*+>""")
_CONTENT_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in _RAW}
_ATTRS = re.compile(r"""(?:"[^"]*"|'[^']*')|([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)")


class Node:
    """A block element: label, own text runs and child blocks in order, and whether it is set aside (``doubtful``: by its name alone)."""

    __slots__ = ("tag", "label", "parts", "drop", "links", "doubtful")

    def __init__(self, tag: str, label: str, drop: bool, doubtful: bool = False) -> None:
        self.tag, self.label, self.drop, self.parts, self.links, self.doubtful = tag, label, drop, [], 0, doubtful

    def children(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node)]


def _attributes(raw: str, inside: bool = False) -> tuple[str, bool]:
    """First class (for the label) and whether a name sets the element aside: whole words of class, id and role, no parts of them.

    Inside an article or main one word among others does not: there all words of a class must say so, but for ``hidden``,
    which tells how an element is shown and not what it is about.
    """
    first, aside = "", False
    if raw and ("=" in raw or "hidden" in raw.lower()):
        found: dict[str, str] = {}
        for name, value in _ATTRS.findall(raw):
            found.setdefault(name.lower(), value.strip("\"'").lower())  # of a repeated attribute the first counts
        aside = found.get("hidden", "no") in ("", "hidden", "true") or found.get("aria-hidden") in ("", "true")
        words = found.get("class", "").split()
        first = words[0] if words else ""
        aside |= any(w in _PARTS for w in found.get("id", "").split())
        aside |= bool(words) and ("hidden" in words or (all if inside else any)(w in _PARTS for w in words))
        aside |= any(w in _ROLES for w in found.get("role", "").split())
    return first, aside


def tokens(page: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """(start, end, tag, attributes, whether it closes) of every tag, in time that grows with the page's length.

    Comments have no tag; CDATA sections have the tag ``#text`` and their text; an element whose content is no text reaches
    to its end tag.  From the first tag on whose quotes never close, tags end at the next ``>``; where none is left, text goes on.
    """
    at, quotes, sections = 0, True, True
    while m := _OPEN.search(page, at):
        if m[1]:
            end = page.find("-->", m.start() + 2)
            yield m.start(), (at := len(page) if end < 0 else end + 3), "", "", False
            continue
        if m[2] and sections:
            end = page.find("]]>", m.end())
            sections = end >= 0
            if sections:
                yield m.start(), (at := end + 3), "#text", page[m.end() : end], False
                continue
        close = page.find(">", m.end())
        if close < 0:
            return
        if m[2] or m[3]:
            yield m.start(), (at := close + 1), "", "", False
            continue
        rest = _REST.match(page, m.end()) if quotes else None
        quotes = rest is not None
        at = rest.end() if rest else close + 1
        tag, raw = m[5].lower(), page[m.end() : at - 1]
        if tag in _RAW and not m[4] and not raw.endswith("/"):
            end_tag = _CONTENT_END[tag].search(page, at)
            at = end_tag.end() if end_tag else len(page)
        yield m.start(), at, tag, raw, bool(m[4])


def parse(page: str) -> Node:
    """The tree of block elements, of any depth.  Unclosed and wrongly nested tags are mended as browsers mend the common cases."""
    root = Node("#root", "#root", False)
    stack, at, link, deepest = [root], 0, 0, 1
    opened: Counter = Counter()  # open elements by tag

    def cut(k: int) -> None:
        for node in stack[k:]:
            opened[node.tag] -= 1
        del stack[k:]

    for start, end, tag, raw, closes in tokens(page):
        if start > at:
            _text(stack[-1], page[at:start], link)
        at = end
        if tag == "#text":
            _text(stack[-1], raw.replace("&", "&amp;"), link)
            continue
        if closes:
            if tag == "a":
                link = 0
            elif opened[tag] > 0:
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                cut(k)
            continue
        if tag in _RAW:
            if tag in _BLOCK:
                stack[-1].parts.append(Node(tag, tag, True))
            continue
        if tag == "br" or tag == "hr":
            stack[-1].parts.append(" ")
        if tag in _VOID:
            continue
        if tag == "a":
            link = 1
        if tag not in _BLOCK and tag not in _DROP:
            continue
        if tag in _ENDS_P and stack[-1].tag == "p":
            cut(len(stack) - 1)
        if tag in _SIBLINGS and any(opened[x] > 0 for x in _SIBLINGS[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _SIBLINGS[tag]:
                    cut(k)
                    break
                if stack[k].tag in _HOLDERS:
                    break
        first, aside = _attributes(raw, opened["article"] + opened["main"] > 0)
        # the page's skeleton is never set aside by its classes
        drop = tag in _DROP or (aside and tag not in ("html", "body", "main", "article", "h1"))
        node = Node(tag, f"{tag}.{first}" if first else tag, drop, drop and (tag not in _DROP or tag in ("form", "fieldset")))
        link = 0 if tag in _BLOCK and link else link
        stack[-1].parts.append(node)
        if not raw.endswith("/"):
            stack.append(node)
            opened[tag] += 1
            deepest = max(deepest, len(stack))
    if at < len(page):
        _text(stack[-1], page[at:], link)
    # trees are walked by recursion, which takes heap, not stack
    if 4 * deepest + 1000 > sys.getrecursionlimit():
        sys.setrecursionlimit(4 * deepest + 1000)
    _restore(root)
    return root


def _restore(root: Node) -> None:
    """Nodes set aside by name alone (and forms) come back where they hold the page's main text, its only article or all of an article."""
    best: dict[bool, tuple[int, tuple | None]] = {}  # an article or main, or a slot outside: the longest text that is no link, and the doubtful nodes above
    doubts: list[Node] = []
    stands: list[int] = []  # articles outside of what is set aside
    shown: list[int] = []  # those with more than headings
    back: list[Node] = []

    def above(path: tuple | None, until: tuple | None = None) -> list[Node]:
        found = []
        while path is not until:
            found.append(path[0])
            path = path[1]
        return found

    def visit(node: Node, path: tuple | None, article: dict | None) -> int:
        """``path``: the doubtful nodes above, innermost first, each with the path above it."""
        if node.drop and not node.doubtful:
            return 0
        if node.doubtful:
            doubts.append(node)
            path = (node, path)
        top = article is None and node.tag in ("article", "main")
        if top:
            article = {"path": path, "kept": 0, "most": (0, path)}
        own = max(0, sum([len(p.strip()) for p in node.parts if isinstance(p, str)]) - 2 * node.links)
        if article is not None and node.tag not in _HEADS:
            if path is article["path"]:
                article["kept"] += own
            elif own > article["most"][0]:
                article["most"] = own, path
        size = own
        for p in node.children():
            size += visit(p, path, article)
        if size and top:
            if path is None:
                stands.append(size)
                shown.extend([article["kept"]] if article["kept"] else [])
            if not article["kept"]:
                back.extend(above(article["most"][1], article["path"]))
        if (top or article is None) and size > best.get(top, (0,))[0]:
            best[top] = size, path
        # runs of text count for what they stand in, an article for all of its text
        return size if article is not None and not top or node.tag in _RUNS else 0

    visit(root, None, None)
    if doubts and best and not shown:
        back += above(max(best.values(), key=lambda x: x[0])[1])
        if True in best and not stands:
            back += above(best[True][1])
    if doubts:
        for node in back:
            node.drop = False


def _text(node: Node, raw: str, link: int) -> None:
    node.parts.append(raw)
    if link:
        node.links += len(raw)


def _clean(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


def blocks(node: Node, out: list[str] | None = None) -> list[str]:
    """The texts under a node in page order: runs of text between block borders; ``out`` takes them."""
    out = [] if out is None else out
    run: list[str] = []
    for p in node.parts:
        if isinstance(p, Node):
            if run and (t := _clean(run)):
                out.append(t)
            run = []
            if not p.drop:
                blocks(p, out)
        else:
            run.append(p)
    if run and (t := _clean(run)):
        out.append(t)
    return out


class Slot:
    """A node of the compressed tree: a label, the nodes it stands for and their texts (items), its child slots.

    Slots of one shape have the same labels below them.  ``key`` is the number of the first item, the others follow.
    """

    __slots__ = ("label", "tag", "nodes", "items", "slots", "text", "links", "key", "shape", "drop")

    def __init__(self, node: Node, text: str) -> None:
        self.label, self.tag, self.nodes, self.items, self.slots, self.text, self.links = node.label, node.tag, [node], [text], [], text, node.links
        self.key, self.shape, self.drop = -1, 0, node.drop


def compress(node: Node) -> Slot:
    """Siblings with one label that hold no further blocks become one slot."""
    if not node.children():
        return Slot(node, " ".join(blocks(node)))
    slot = Slot(node, _clean([p for p in node.parts if not isinstance(p, Node)]))
    for child in node.children():
        last = slot.slots[-1] if slot.slots else None
        if last and not child.children() and last.label == child.label and last.drop == child.drop and not last.slots:
            last.nodes.append(child)
            last.items.append(" ".join(blocks(child)))
            last.links += child.links
        else:
            slot.slots.append(compress(child))
    for s in slot.slots:
        if len(s.items) > 1:
            s.text = " ".join(filter(None, s.items))
    return slot


def number(slot: Slot, start: int = 0) -> int:
    """Number the items in preorder; the next free number."""
    slot.key = start
    start += len(slot.items)
    for s in slot.slots:
        start = number(s, start)
    slot.shape = hash((slot.label, *[s.shape for s in slot.slots]))
    return start


def match(a: Slot, b: Slot) -> tuple[int, list[tuple[Slot, Slot]]]:
    """Simple tree matching: the most pairs of equally labelled slots that keep order and parents."""
    if a.label != b.label:
        return 0, []
    n, m = len(a.slots), len(b.slots)
    if not n or not m:
        return 1, [(a, b)]
    if n * m > WIDE:
        total, pairs = 1, [(a, b)]
        for i, j in _wide(a.slots, b.slots):
            w, got = match(a.slots[i], b.slots[j])
            total += w
            pairs += got
        return total, pairs
    found = {}
    score = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            w = 0
            if a.slots[i].label == b.slots[j].label:
                found[i, j] = got = match(a.slots[i], b.slots[j])
                w = got[0]
            score[i + 1][j + 1] = max(score[i][j + 1], score[i + 1][j], score[i][j] + w)
    pairs, i, j = [(a, b)], n, m
    while i and j:
        if score[i][j] == score[i - 1][j]:
            i -= 1
        elif score[i][j] == score[i][j - 1]:
            j -= 1
        else:
            pairs += found[i - 1, j - 1][1]
            i, j = i - 1, j - 1
    return 1 + score[n][m], pairs


def _wide(a: list[Slot], b: list[Slot]) -> Iterator[tuple[int, int]]:
    """The pairs that the recurrence of ``match`` chooses, last first, without a whole table.

    Equal shapes at both ends pair with each other, as no other pairing weighs more.  Each ROWS-th row of the rest is
    kept and the rows between are computed again on the way back; weights are by pairs of shapes.
    """
    lo, n, m = 0, len(a), len(b)
    while lo < min(n, m) and a[lo].shape == b[lo].shape:
        lo += 1
    while min(n, m) > lo and a[n - 1].shape == b[m - 1].shape:
        n, m = n - 1, m - 1
        yield n, m
    ends = [(i, i) for i in range(lo - 1, -1, -1)]
    x, y = a[lo:n], b[lo:m]
    shapes: dict[int, int] = {}
    of = np.array([shapes.setdefault(s.shape, len(shapes)) for s in y], np.int64)
    kinds = list({s.shape: s for s in y}.values())
    weights: dict[int, np.ndarray] = {}

    def row(before: np.ndarray, s: Slot) -> np.ndarray:
        if s.shape not in weights:
            weights[s.shape] = np.array([match(s, t)[0] for t in kinds], np.int32)
        after = np.maximum(before[1:], before[:-1] + weights[s.shape][of])
        return np.concatenate([before[:1], np.maximum.accumulate(after)])

    if x and y:
        kept, last = [], np.zeros(len(y) + 1, np.int32)
        for i, s in enumerate(x):
            if i % ROWS == 0:
                kept.append(last)
            last = row(last, s)
        i, j = len(x), len(y)
        while i and j:
            first = (i - 1) // ROWS * ROWS
            rows = [kept[first // ROWS]]
            for s in x[first:i]:
                rows.append(row(rows[-1], s))
            while i > first and j:
                now, up = rows[i - first], rows[i - first - 1]
                if now[j] == up[j]:
                    i -= 1
                elif now[j] == now[j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    yield lo + i, lo + j
    yield from ends


def _walk(slot: Slot) -> Iterator[tuple[Slot, bool]]:
    """The slots in page order, without what is set aside, and whether they are in an article or main."""
    stack = [(slot, False)]
    while stack:
        s, inside = stack.pop()
        if not s.drop:
            inside = inside or s.tag in ("article", "main")
            yield s, inside
            stack += [(x, inside) for x in reversed(s.slots)]


def tree(page: str) -> Slot:
    root = compress(parse(page))
    number(root)
    return root


_trees: dict[bytes, Slot] = {}


def reference_tree(page: bytes) -> Slot:
    """The tree of a reference page (compressed); a worker remembers some of moderate size."""
    if page not in _trees:
        whole = unpack(page)
        root = tree(whole)
        if len(whole) > 1 << 20:
            return root
        if len(_trees) >= 64:
            _trees.clear()
        _trees[page] = root
    return _trees[page]


def pack(page: str | None) -> bytes | None:
    """A page compressed for its way between tasks; nothing for no text."""
    return zstandard.compress(page.encode("utf-8", "surrogatepass"), 3) if page else None


def unpack(page: bytes | None) -> str:
    return zstandard.decompress(page).decode("utf-8", "surrogatepass") if page else ""


def _mark(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1


def main_slot(root: Slot) -> tuple[Slot, bool]:
    """The slot with most text that is not links, and whether it is in an article or main: that counts with all of its text."""
    weigh = lambda s: len(s.text) - 2 * s.links
    best, inside, most = root, False, weigh(root)
    stack = [root]
    while stack:
        s = stack.pop()
        if s.drop:
            continue
        if s.tag in ("article", "main"):
            own = [x for x, _ in _walk(s) if x.text]
            size, top = sum(max(0, weigh(x)) for x in own), True
        else:
            own, size, top = [s], weigh(s), False
            stack += s.slots
        if own and (size > most or (top and not inside and size == most)):
            best, inside, most = max(own, key=weigh), top, size
    return best, inside


def layout(page: str | None) -> int | None:
    """A hash of the labels of a page's frame: body's children that are containers, and the containers with a class in
    them, outside of article and main, three levels deep.  Numbers in labels do not count.  A page without text has none."""
    labels: set[str] = set()
    said = False
    stack = [(parse(page or ""), 0, True)]
    while stack:
        node, depth, frame = stack.pop()
        if node.drop:
            continue
        said = said or any(isinstance(p, str) and p.strip() for p in node.parts)
        if frame and node.tag in _FRAME and (depth == 1 or "." in node.label):
            labels.add(_NUMBER.sub("#", node.label))
        frame = frame and depth < 3 and node.tag not in ("article", "main")
        stack += [(c, 0 if c.tag in ("html", "body") else depth + 1, frame) for c in node.children()]
    return _mark(" ".join(sorted(labels))) if said else None


def _leads(root: Slot) -> tuple[str, str]:
    """Texts of the main slot and of the longest slot in an article or main, which are one on most pages."""
    inside = [s for s, inside in _walk(root) if inside]
    return main_slot(root)[0].text, max(inside, key=lambda s: len(s.text) - 2 * s.links).text if inside else ""


def compare(page: str, reference: bytes) -> list[tuple[int, bool]]:
    """For a page whose main slot differs from the reference's: (reference item, reads the same) of each aligned slot's items.

    The longest slot in an article or main counts as a main slot too, so a long notice does not make all pages one.
    Pages that share more than half of the reference's article are copies, which tell nothing about a template.
    """
    a, b = reference_tree(reference), tree(page)
    if _leads(a) == _leads(b):
        return []
    inside = {s.key for s, within in _walk(a) if within}
    found, shared, whole = [], 0, sum(len(s.text) for s, within in _walk(a) if within)
    for x, y in match(a, b)[1]:
        if x.text and y.text:
            there = set(y.items)
            same = [t in there for t in x.items]
            found += [(x.key + i, s) for i, (t, s) in enumerate(zip(x.items, same)) if t]
            if x.key in inside:
                shared += sum(len(t) for t, s in zip(x.items, same) if s)
    return [] if 2 * shared > whole else found


def _template_items(x: Slot, y: Slot, template: frozenset[int], inside: bool, equal: bool) -> Iterator[int]:
    """Numbers of ``y``'s items that are template, as items of the aligned reference slot ``x`` are.

    Items that read the same as a template item are; outside of article and main, and unless ``equal`` is asked, so are
    all items where all of ``x`` is template.
    """
    known = {t for i, t in enumerate(x.items) if x.key + i in template}
    if known:
        every = not inside and not equal and all(x.key + i in template for i, t in enumerate(x.items) if t)
        yield from (y.key + i for i, t in enumerate(y.items) if every or t in known)


def extract(page: str | None, reference: bytes | None = None, template: frozenset[int] = frozenset(), learned: bool = False, base: bytes | None = None, base_template: frozenset[int] = frozenset()) -> str:
    """The article's text.  ``template``: items of ``reference``, a (packed) page of the same layout, that belong to its template;
    ``base_template``: those of ``base``, a page of the host's usual layout: of them, items that read the same go.
    ``learned``: enough pages of the host were compared, so that slots outside of article and main are content unless
    they are template."""
    if not page:
        return ""
    root = tree(page)
    shown = list(_walk(root))
    within = {s.key: inside for s, inside in shown}
    out_of: set[int] = set()
    for ref, items, equal in ((reference, template, False), (base if base != reference else None, base_template, True)):
        if ref and items:
            for x, y in match(reference_tree(ref), root)[1]:
                if y.key in within:
                    out_of.update(_template_items(x, y, items, within[y.key], equal))
    keep: set[int] = set()
    skip: set[int] = set()
    main, articles = main_slot(root)
    titled = any(inside and s.tag == "h1" for s, inside in shown)
    for s, inside in shown:
        plain = s.label in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "article", "main")
        linked = not inside and s.links > LINK_SHARE * max(1, len(s.text)) and not plain
        # without evidence from the host, elements decide
        if s.tag == "header" and not inside and not learned and all(x is not main for x, _ in _walk(s)):
            skip.add(s.key)  # with all that is in it
        elif s.text and not linked and not (articles and not inside and not learned and (titled or s.tag != "h1")):
            keep.update(s.key + i for i in range(len(s.items)) if s.key + i not in out_of)
    return " ".join(_gather(root, keep, skip, []))


def _gather(slot: Slot, keep: set[int], skip: set[int], out: list[str]) -> list[str]:
    """Texts of kept items in page order, into ``out``."""
    if slot.key in skip or slot.drop:
        return out
    if not slot.slots:
        for i, n in enumerate(slot.nodes):
            if slot.key + i in keep:
                blocks(n, out)
        return out
    run: list[str] = []
    by_node = {id(n): s for s in slot.slots for n in s.nodes}
    done = set()
    for p in slot.nodes[0].parts:
        if isinstance(p, Node):
            if slot.key in keep and run and (t := _clean(run)):
                out.append(t)
            run = []
            s = by_node[id(p)]
            if s.key not in done:
                done.add(s.key)
                _gather(s, keep, skip, out)
        else:
            run.append(p)
    if slot.key in keep and run and (t := _clean(run)):
        out.append(t)
    return out


def host(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", small_hosts: int = SMALL_HOSTS, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """One row for each row of ``pages``: page_id, url, text, n_chars (code points).

    Null or empty html: empty text.  A null url or one without a host shares the host ''.  Rows may repeat; a
    null id or a page without text never makes a page the reference.  Every layout of a host with enough pages has a
    reference; that of the layout with most pages serves the whole host too.  Pages of any length, width and depth are
    read whole, in time that grows with their length, and, where pages are aligned, with the product of the numbers of
    different neighbours on one level (20,000 mixed blocks beside each other: some seconds a page).  Other columns are not read.  Pages are not shuffled while hosts
    (``small_hosts``) and reference pages (``small_bytes``) are few enough to be broadcast, which is counted first; beyond, they
    are joined by shuffle, compressed.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = rows.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = batch.column("html").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in (0, 1, 3)] + [pa.array([layout(x) for x in found], pa.int64()), pa.array([pack(x) for x in found], pa.binary())], ["page_id", "url", "host", "layout", "page"])

    signed = stage(rows.mapInArrow(sign, "page_id long, url string, host string, layout long, page binary"), "signed")
    layouts = signed.where("page_id IS NOT NULL AND layout IS NOT NULL").groupBy("host", "layout").agg(F.min("page_id").alias("rid"), F.count(F.lit(1)).alias("n"))
    layouts = stage(layouts, "layouts")
    usual = layouts.groupBy("host").agg(F.max_by("layout", F.struct("n", -F.col("rid"), "layout")).alias("usual"))
    # fewer pages of a layout teach nothing
    first = layouts.join(usual, "host").withColumn("usual", F.col("layout") == F.col("usual")).where(F.col("usual") | (F.col("n") > LEAST_PAGES)).select("host", "layout", "rid", "usual")
    first = stage(first, "first-pages")
    few = F.broadcast if first.count() <= small_hosts else lambda x: x
    found = signed.withColumnRenamed("page_id", "rid").join(few(first), ["host", "layout", "rid"])
    reference = stage(found.groupBy("host", "layout", "usual").agg(F.min("page").alias("reference")), "references")  # one, if a page id repeats
    drop_stage(layouts)
    drop_stage(first)
    size = reference.agg(F.sum(F.octet_length("reference"))).first()[0] or 0
    small = F.broadcast if size <= small_bytes else lambda x: x
    base = reference.where("usual").select("host", F.col("reference").alias("base"))
    reference = reference.drop("usual")
    paired = signed.join(small(reference), ["host", "layout"], "left").join(small(base), "host", "left")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, int | None, int], list[int]] = {}
            for part in small_batches([batch]):
                for h, own, page, ref, usual_page in zip(*(c.to_pylist() for c in part.columns)):
                    if own is None:
                        continue
                    whole = unpack(page)
                    pairs = compare(whole, ref) if ref and page != ref else []
                    wide = pairs if usual_page == ref else compare(whole, usual_page) if usual_page and page != usual_page else []
                    for key, counted in ((own, pairs), (None, wide)):
                        for slot, same in [(PAGE, True), *counted] if counted else ():
                            got = found.setdefault((h, key, slot), [0, 0])
                            got[0] += 1
                            got[1] += same
            columns = [[k[i] for k in found] for i in range(3)] + [[v[i] for v in found.values()] for i in range(2)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i else pa.string()) for i, c in enumerate(columns)], ["host", "layout", "slot", "n", "same"])

    counts = paired.select("host", "layout", "page", "reference", "base").mapInArrow(learn, "host string, layout long, slot long, n long, same long")
    fixed = counts.groupBy("host", "layout", "slot").agg(F.sum("n").alias("n"), F.sum("same").alias("same")).where((F.col("n") >= LEAST_PAGES) & (F.col("same") >= CONSTANT_SHARE * F.col("n")))
    # a layout, or a host (no layout), has a row here, if with no item but PAGE, where enough pages were compared
    fixed = stage(fixed.groupBy("host", "layout").agg(F.sort_array(F.collect_list("slot")).alias("template")), "templates")
    wrapper = reference.join(fixed, ["host", "layout"])
    whole = base.join(fixed.where("layout IS NULL").select("host", F.col("template").alias("base_template")), "host")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = []
            for page, ref, t, usual_page, u in zip(*(batch.column(i).to_pylist() for i in range(2, 7))):
                own, wide = frozenset(t or ()), frozenset(u or ())
                texts.append(extract(unpack(page), ref, own - {PAGE}, PAGE in own or PAGE in wide, usual_page, wide - {PAGE}))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    # layouts and hosts with too few pages need no alignment, so their reference is not carried along
    paired = signed.join(small(wrapper), ["host", "layout"], "left").join(small(whole), "host", "left")
    return paired.select("page_id", "url", "page", "reference", "template", "base", "base_template").mapInArrow(apply, "page_id long, url string, text string, n_chars long")
