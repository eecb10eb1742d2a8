"""Small helpers on one web page: tolerant parsing into a tree, its outline, and tree matching."""

from __future__ import annotations

import functools
import re
from html import unescape

import numpy as np

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math".split())
#: Elements that do not begin a block of text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
#: Elements whose text is never main text.
OUTSIDE = frozenset(
    "head script style noscript iframe template svg math textarea title nav footer aside form button select option menu "
    "dialog object".split()
)
#: Words in a class or id that mark such elements too.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar "
    "navigation menu breadcrumb breadcrumbs footer header masthead comment comments disqus cookie cookies consent notice "
    "notices alert newsletter subscribe subscription share sharing social related popup modal overlay widget toolbar "
    "pagination pager login signup search skip".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: What an opening tag ends, if it is open and nothing of the second set lies between.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
        "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
_P = (frozenset(["p"]), frozenset("article section div td th li body blockquote main aside".split()))

#: Words before a mark that say it is not one, and words of a container that may follow it.
NOT = frozenset("no not non has have with without is hide show toggle".split())
CONTAINER = frozenset("area bar block body box button buttons container content group holder icons inner item items link links "
                      "list module outer panel posts row section slot space top unit wrap wrapper zone".split())  # fmt: skip
_OPEN = re.compile("<(?=[a-zA-Z!?]|/[a-zA-Z])")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: A tag without quotes behind its name.
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+)>")
_QUOTE = re.compile("[>\"']")
#: One attribute, with its whole name; a value without its closing quote goes to the end.
_ATTR = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s\"'>][^\s>]*)))?")
_SPLIT = re.compile(r"[^a-z]+")


def _is_mark(token: str) -> bool:
    """Whether one name of a class or id says that the element isn't main text: it is a mark (``sidebar``), or ends with
    one that nothing before denies (``site-footer``, but not ``has-sidebar``), or begins with one and goes on with words
    for containers (``ad-slot``, but not ``notice-board``)."""
    words = [w for w in _SPLIT.split(token) if w]
    if not words or not NOT.isdisjoint(words):
        return False
    return words[-1] in MARKS or (words[0] in MARKS and all(w in MARKS or w in CONTAINER for w in words[1:]))


def _tags(html: str, skip: list[int]):
    """(start, end, name, whether it closes, attributes) of every tag; name None for comments and declarations.

    What lies before ``skip[0]``, which may be moved on meanwhile, is passed over.  Goes forward only.  A tag ends at the
    first ``>`` outside quotes, or, if there is none or a quote is left open, at the first ``>`` at all; without any it is
    text, as is everything after it.
    """
    at, size = 0, len(html)
    led_nowhere = None  # opening quotes after which no tag ends; none of them is followed twice
    while True:
        begin = _OPEN.search(html, max(at, skip[0]))
        if begin is None:
            return
        start = begin.start()
        plain = _PLAIN.match(html, start)
        if plain is not None:
            at = plain.end()
            yield start, at, plain[2], plain[1] == "/", plain[3]
            continue
        c = html[start + 1]
        if c in "!?":
            comment = html.startswith("<!--", start)
            k = html.find("-->", start + 4) if comment else html.find(">", start + 2)
            end = size if k < 0 else k + (3 if comment else 1)
            yield start, end, None, False, ""
            at = end
            continue
        closes = c == "/"
        name = _NAME.match(html, start + 1 + closes)
        first = html.find(">", name.end())
        if first < 0:
            return
        end, i = first, name.end()
        while True:
            m = _QUOTE.search(html, i)
            if m is not None and m[0] == ">":
                end = m.start()
                break
            if m is not None and led_nowhere:
                if led_nowhere[m.start()]:
                    break
                led_nowhere[m.start()] = 1  # if a tag ends after it all the same, nothing before that end is read again
            i = 0 if m is None else html.find(m[0], m.end()) + 1
            if not i:
                led_nowhere = led_nowhere or bytearray(size)
                break
        yield start, end + 1, name[0], closes, html[name.end() : end]
        at = end + 1


_LETTER = re.compile(r"[^\W\d_]")
#: Elements of running text, where a link alone makes no menu.
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())


class Link(str):
    """Text in a link; ``number`` tells the page's links apart."""

    __slots__ = ("number",)


class Node:
    """``parts``: in page order, texts (decoded) and child nodes."""

    __slots__ = ("tag", "label", "parts", "outside", "main")

    def __init__(self, tag: str, label: str, outside: bool, main: bool):
        self.tag, self.label, self.outside, self.main = tag, label, outside, main
        self.parts: list = []


def _kind(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """(label, text lies outside the main text, is the article)"""
    return _kept_kind(tag, attributes) if len(attributes) < 1000 else _kept_kind.__wrapped__(tag, attributes)


@functools.lru_cache(4096)
def _kept_kind(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """(label, text lies outside the main text, is the article)"""
    found = {}
    for m in _ATTR.finditer(attributes):
        found.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    names = [w for k in ("class", "id") for w in found.get(k, "").split()]
    words = [w for name in names for w in _SPLIT.split(name) if w]
    main = tag in ("article", "main") or found.get("role") == "main" or found.get("itemprop") == "articlebody"
    outside = (
        tag in OUTSIDE
        or found.get("role") in ROLES
        or "hidden" in found
        or found.get("aria-hidden") == "true"
        or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")))
        or (not main and tag not in ("html", "body") and any(map(_is_mark, names)))
    )
    return f"{tag}.{'.'.join(sorted(set(words)))}", outside, main


def parse(html: str) -> Node:
    root = Node("#root", "#root", False, False)
    stack, at, links, number = [root], 0, 0, 0
    mute, depth = None, 0  # inline element whose text is not shown, and how many of its tag are open
    opened: dict[str, int] = {}  # elements of each tag on the stack

    def close(i: int) -> None:
        for n in stack[i:]:
            opened[n.tag] -= 1
        del stack[i:]

    def put(text: str) -> None:
        if text and mute is None:
            text = unescape(text) if "&" in text else text
            if links:
                text = Link(text)
                text.number = number
            stack[-1].parts.append(text)

    skip = [0]
    for start, end, name, closes, attributes in _tags(html, skip):
        if at < start:
            put(html[at:start])
        at = end
        if not name:
            continue
        tag = name.lower()
        if tag == mute:
            depth += -1 if closes else 1
            mute = mute if depth else None
        elif tag not in INLINE:
            mute = None
        if closes:
            if tag in INLINE:
                links = max(0, links - (tag == "a"))
            elif tag == "p" and not opened.get("p"):
                stack[-1].parts.append(Node("p", "p.", False, False))
            elif opened.get(tag):
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
                links = 0
            continue
        if tag in RAW:
            last = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = skip[0] = last.end() if last else len(html)
            continue
        if tag in INLINE:
            if tag == "br":
                stack[-1].parts.append(" ")
            if tag == "a":
                links, number = links + 1, number + 1
            if mute is None and attributes and tag not in VOID and _kind(tag, attributes)[1]:
                mute, depth = tag, 1
            continue
        label, outside, main = _kind(tag, attributes)
        for ended, scope in ((_P,) if tag not in ENDS else (_P, ENDS[tag])):
            if not any(opened.get(t) for t in ended):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ended:
                    close(i)
                    links = 0
                    break
                if stack[i].tag in scope:
                    break
        node = Node(tag, label, outside, main)
        stack[-1].parts.append(node)
        if tag not in VOID:
            stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1
    if at < len(html):
        put(html[at:])
    return root


def layout(root: Node) -> tuple[str, dict[int, int]]:
    """The page's outline, and the number in it of every node, by ``id``.

    An outline is the tree of labels with runs of equal siblings made one, in pre-order: a line with
    depth and label for each node."""
    lines: list[str] = []
    number: dict[int, int] = {}
    todo = [([root], 0)]
    while todo:
        nodes, depth = todo.pop()
        for n in nodes:
            number[id(n)] = len(lines)
        lines.append(f"{depth} {nodes[0].label}")
        runs: list[list[Node]] = []
        for p in (p for n in nodes for p in n.parts if isinstance(p, Node)):
            if runs and runs[-1][0].label == p.label:
                runs[-1].append(p)
            else:
                runs.append([p])
        todo.extend((r, depth + 1) for r in reversed(runs))
    return "\n".join(lines), number


def size(outline: str) -> int:
    return outline.count("\n") + 1


#: Pairs of children of two nodes up to which a plain loop is the quicker way, and cells whose rows are held at once.
PAIRS, CELLS = 1_000, 4_000_000


def match(a: str, b: str) -> list[tuple[int, int]]:
    """Simple tree matching: pairs of numbers of the largest matching of two outlines that keeps roots,
    parents and the order of siblings."""
    return list(_match(a, b)) if len(a) + len(b) < 100_000 else _match.__wrapped__(a, b)


def _tree(outline: str, kinds: dict) -> tuple[list[list[int]], list[int]]:
    """Children of each node, and a number that equal subtrees share: the place in ``kinds`` of label and children's numbers."""
    labels, children, path = [], [], []
    for i, line in enumerate(outline.split("\n")):
        depth, label = line.split(" ", 1)
        labels.append(label)
        children.append([])
        del path[int(depth) :]
        if path:
            children[path[-1]].append(i)
        path.append(i)
    kind = [0] * len(labels)
    for i in range(len(labels) - 1, -1, -1):
        kind[i] = kinds.setdefault((labels[i], *(kind[c] for c in children[i])), len(kinds))
    return children, kind


@functools.lru_cache(5000)
def _match(a: str, b: str) -> list[tuple[int, int]]:
    kinds: dict = {}
    ca, ka = _tree(a, kinds)
    cb, kb = _tree(b, kinds)
    label, below = [k[0] for k in kinds], [k[1:] for k in kinds]
    if label[ka[0]] != label[kb[0]]:
        return []
    sizes: list[int] = []
    for kids in below:
        sizes.append(1 + sum(sizes[k] for k in kids))
    value: dict[tuple[int, int], int] = {}  # matched nodes of two subtrees whose roots have one label
    chosen: dict[tuple[int, int], list[tuple[int, int]]] = {}  # and, of large ones, the places of the children that give them

    @functools.cache
    def by_label(j: int) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        for k in set(below[j]):
            out.setdefault(label[k], []).append(k)
        return out

    todo = [(ka[0], kb[0], False)]
    while todo:
        i, j, ready = todo.pop()
        if (i, j) in value:
            continue
        if i == j:
            value[i, j] = sizes[i]
        elif ready:
            pairs = _pairs(below[i], below[j], value, sizes)
            value[i, j] = 1 + sum(value[below[i][x], below[j][y]] for x, y in pairs)
            if len(below[i]) * len(below[j]) > PAIRS:
                chosen[i, j] = pairs
        else:
            todo.append((i, j, True))
            where = by_label(j)
            for name, kids in by_label(i).items():
                todo.extend((k, m, False) for k in kids for m in where.get(name, ()) if (k, m) not in value)
    out, todo2 = [], [(0, 0)]
    while todo2:
        i, j = todo2.pop()
        if ka[i] == kb[j]:
            out.extend((i + d, j + d) for d in range(sizes[ka[i]]))
        else:
            out.append((i, j))
            pairs = chosen.get((ka[i], kb[j])) or _pairs(below[ka[i]], below[kb[j]], value, sizes)
            todo2.extend((ca[i][x], cb[j][y]) for x, y in pairs)
    return sorted(out)


def _pairs(u: tuple, v: tuple, value: dict, sizes: list[int]) -> list[tuple[int, int]]:
    """Places of children ``u`` and ``v`` of two nodes that give the largest matching, by ``value`` of two kinds.

    Of matchings as large, the one whose last pair stands first in ``u``, then in ``v``; then the same for the pair
    before it.  All ways below keep to that.
    """
    n, m, same = len(u), len(v), 0
    while same < min(n, m) and u[same] == v[same]:  # nothing is larger than to match equal subtrees at the beginning
        same += 1
    got = [(x, x) for x in range(same)]
    u, v, n, m = u[same:], v[same:], n - same, m - same
    rest = _rows(u, v, value) if n * m <= PAIRS else _long_rows(u, v, value, sizes)
    return got + [(x + same, y + same) for x, y in rest]


def _rows(u: tuple, v: tuple, value: dict) -> list[tuple[int, int]]:
    weights = {k: [value.get((k, j), 0) for j in v] for k in set(u)}
    # best[x][y]: of the first x and the first y, kept row by row where anything can match
    best = [[0] * (len(v) + 1)]
    for k in u:
        last = best[-1]
        if any(weights[k]):
            row, top = [0], 0
            for y, w in enumerate(weights[k]):
                if last[y + 1] > top:
                    top = last[y + 1]
                if w and last[y] + w > top:
                    top = last[y] + w
                row.append(top)
            last = row
        best.append(last)
    x, y, got = len(u), len(v), []
    while x and y:
        if best[x][y] == best[x - 1][y]:
            x -= 1
        elif best[x][y] == best[x][y - 1]:
            y -= 1
        else:
            x, y = x - 1, y - 1
            got.append((x, y))
    return got[::-1]


def _long_rows(u: tuple, v: tuple, value: dict, sizes: list[int]) -> list[tuple[int, int]]:
    """``_rows`` with a row at a time, rows made again from every few that are kept, and near the diagonal only.

    What a matching leaves out of the first x and y is no less than the difference of their sizes; the same holds
    for the rest.  So one that leaves out ``spare`` more nodes than any must stays within a band, and if the best
    one in it leaves out no more, it is the largest of all.  Else the band is widened, at most to what that one leaves out.
    """
    n, m = len(u), len(v)
    su, sv = (np.cumsum([0, *(sizes[k] for k in c)]) for c in (u, v))
    more = int(su[n] - sv[m])
    kinds = {k: y for y, k in enumerate(dict.fromkeys(v))}
    column = np.array([kinds[k] for k in v])
    weights = {k: np.array([value.get((k, j), 0) for j in kinds], np.int32) for k in set(u)}
    weights = {k: w for k, w in weights.items() if w.any()}

    def forward(begin: int, end: int, right: int, row, keep: int | None) -> list:
        """From best[begin], which is changed, to best[end] over the first ``right`` of v: every ``keep``-th row whole,
        as it was before, or the parts of all rows that lie in the band."""
        out = []
        for x in range(begin, end):
            if keep and (x - begin) % keep == 0:
                out.append((x, row.copy()))
            low, high = max(1, int(lows[x + 1])), min(right, int(highs[x + 1]))
            w = weights.get(u[x])
            if w is not None and low <= high:
                with_pair = w[column[low - 1 : high]]
                with_pair += row[low - 1 : high]
                np.maximum(with_pair, row[low : high + 1], out=with_pair)
                np.maximum.accumulate(with_pair, out=row[low : high + 1])
            if not keep:
                out.append((low, row[low : high + 1].copy()))
        return out

    def back(begin: int, end: int, y: int, row) -> int:
        """Follow the best pairs from (end, y) up to ``begin``, where ``row`` is best[begin]; the place reached there."""
        cells = int((np.minimum(highs[begin + 1 : end + 1], y) - lows[begin + 1 : end + 1] + 1).clip(1).sum())
        if cells > CELLS and end - begin > 1:
            keep = max(1, (end - begin) // 16)
            for first, row in reversed(forward(begin, end, y, row[: y + 1], keep)):
                y = back(first, min(first + keep, end), y, row) if y else 0
            return y
        above = (0, row[: y + 1].copy())
        rows = [above, *forward(begin, end, y, row[: y + 1], None)]

        def at(x: int, y: int) -> int:
            low, cells = rows[x - begin]
            return cells[y - low] if 0 <= y - low < len(cells) else 0

        x = end
        while x > begin and y:
            here = at(x, y)
            if here == at(x - 1, y):
                x -= 1
            elif here == at(x, y - 1):
                y -= 1
            else:
                x, y = x - 1, y - 1
                got.append((x, y))
        return y

    spare = 64
    while True:
        lows = np.searchsorted(sv, su - max(0, more) - spare)
        highs = np.searchsorted(sv, su - min(0, more) + spare, side="right") - 1
        row = np.zeros(m + 1, np.int32)
        kept = forward(0, n, m, row, max(1, n // 16))
        beyond = int(su[n] + sv[m]) - 2 * int(row[m]) - abs(more)
        if beyond <= 2 * spare:
            break
        spare = min(4 * spare, (beyond + 1) // 2)
    got: list[tuple[int, int]] = []
    y = m
    for first, row in reversed(kept):
        y = back(first, min(first + max(1, n // 16), n), y, row) if y else 0
    return got[::-1]


def _menu_like(tag: str, text: list[str]) -> bool:
    """Links hold most characters, and two of these hold: there are several links, there are no words
    beside them, the element is no paragraph."""
    length = lambda parts: sum(len("".join(p.split())) for p in parts)
    links = [p for p in text if isinstance(p, Link) and not p.isspace()]
    if not links or 2 * length(links) <= length(text):
        return False
    words = any(_LETTER.search(p) for p in text if not isinstance(p, Link))
    return (len({p.number for p in links}) > 1) + (not words) + (tag not in PARAGRAPH) >= 2


def segments(root: Node) -> list[tuple[Node, str]]:
    """(node, text) of every block of main text in page order: of the articles if the page has any,
    else of the body."""

    todo, within = [root], False
    while todo and not within:
        below = [p for p in todo.pop().parts if isinstance(p, Node) and not p.outside]
        within = any(p.main for p in below)
        todo.extend(below)
    out: list[tuple[Node, str]] = []

    def flush(n: Node, inside: bool, text: list[str]) -> None:
        words = " ".join("".join(text).split())
        if words and inside and (within or not _menu_like(n.tag, text)):
            out.append((n, words))
        text.clear()

    # open elements: (node, inside the main text, parts to come, text since the last block)
    path = [(root, not within, iter(root.parts), [])]
    while path:
        n, inside, parts, text = path[-1]
        for p in parts:
            if isinstance(p, str):
                text.append(p)
                continue
            flush(n, inside, text)
            if not p.outside and not (p.tag == "header" and not (within and inside)):
                path.append((p, inside or p.main, iter(p.parts), []))
                break
        else:
            flush(n, inside, text)
            path.pop()
    return out


def slot_texts(root: Node, number: dict[int, int]) -> dict[int, str]:
    """Main text of each node of the outline that has any, by its number."""
    out: dict[int, list[str]] = {}
    for n, words in segments(root):
        out.setdefault(number[id(n)], []).append(words)
    return {i: "\n".join(t) for i, t in out.items()}


def blocks(root: Node, number: dict[int, int], template: set[int]) -> list[str]:
    """Blocks of main text in page order.

    ``template``: numbers of nodes whose own text is template."""
    return [words for n, words in segments(root) if number[id(n)] not in template]
