"""HTML extraction by union-free regular-expression inference.

A page is read as nested streams of block elements and texts. The streams of one host are aligned one after another into its
wrapper, a regular expression without unions. Where two streams have the same tokens they merge place by place. A mismatch is
resolved by squares: runs that come again, found by looking back from where their first token returns, become repeated
groups; what one side still lacks becomes optional. Texts that differ become slots, those that never differ stay constants.
A stream that stays untidy (more than TIDY items) is generalised to ((A)?(B)?..)*, which is free of unions too and whose size is
that of its alphabet; beyond ALPHABET labels it keeps bare tags.

The wrapper decides per host which region is main text: its article elements, else its main element, else the smallest range that
spans all text that varies between pages and isn't made of links. A constant is template only outside that region and only if
pages that differ have it, so captures of one page are no template, however many. Each page is matched against the wrapper's
spine, from the root to the region (an automaton per stream, so that siblings of one label are told apart by their place), and
the region's slots and constants are read. Inside, only what HTML or a class says to be no main text is dropped: menus, footers,
asides, forms, hidden parts, and elements all of whose class words say so (SAID, with NEUTRAL words beside them), unless
they hold most of the host's text.

Partial wrappers are folded where pages are read, then per (host, salt), then per host, so that a hot host is never gathered in
one place. A page gets only its host's spine, some hundred bytes.

Edge cases: null html: no blocks, empty text. Null url: a host of its own. Broken markup (unclosed or stray tags, cut-off
tags, comments and scripts) is read as browsers do, roughly. An empty article: empty text. A page that lacks the region its host
has elsewhere gives the text of its body without what says to be none. Elements nested deeper than DEPTH count as part of the one
at this depth, their text stays. Repeated rows are pages of their own; a null page_id stays null; an empty table gives no
rows; further columns are ignored; very long pages are read whole.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from hashlib import blake2b
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship_by_value
from .common import limit_batches, map_batches, settle, table, text_column

#: Nodes of partial wrappers that a task holds before it hands them on; partial wrappers of a host are dealt to SALTS.
HELD_NODES, SALTS = 20_000, 64
#: Structure is kept to this depth; items of a stream that stays a sequence; labels of a generalised one that stay apart.
DEPTH, TIDY, ALPHABET = 100, 48, 200

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|textarea|select|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>|<[a-zA-Z/!?][^>]*(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
# HTML's block elements, void elements, roles, and words of classes.
BLOCKS = frozenset(
    "html head body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption form fieldset nav header footer aside details summary address center hr menu dialog hgroup search".split()
)
VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
#: What a start tag closes when it is open.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: Elements that are never main text; a form may wrap a whole page.
ASIDE = frozenset("nav footer aside menu dialog search head button fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar status".split())
#: Page headers are no main text, an article's header is.
HEADS = frozenset({"header", "hgroup"})
SAID = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promotion banner menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars footer masthead cookie cookies consent gdpr notice notices popup modal newsletter subscribe signup login share sharing related comment comments reply replies respond disqus pagination pager paywall hidden".split()
)
NEUTRAL = frozenset(
    "site page global main top bottom left right primary secondary box block bar list item items area section container wrapper wrap inner outer content links link widget form button buttons icon icons post entry article story social mobile desktop sticky small large row col text message policy".split()
)
TEXT, GROUP = "#", "()"


def says_aside(word: str) -> bool:
    """Whether a class or id says that its element is no main text, and nothing else."""
    parts = [p for p in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", word).lower()) if p]
    return any(p in SAID for p in parts) and all(p in SAID or p in NEUTRAL for p in parts)


def label_of(tag: str, attributes: str) -> tuple[str, int]:
    """An element's token without what varies from page to page; 2 if HTML says that it is no main text, 1 if its classes do."""
    found: list[str] = []
    aside = 2 if tag in ASIDE else 1 if tag == "form" else 0
    if attributes and not attributes.isspace():
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                aside = 2
            elif name == "role":
                aside = max(aside, 2 * (value.lower() in ROLES))
                found.append("@" + value.lower())
            elif name in ("class", "id"):
                words = re.sub(r"\d+", "", value).split()
                found += sorted(("." if name == "class" else "#") + w for w in words)
                aside = max(aside, int(tag not in ("html", "body", "article", "main") and any(map(says_aside, words))), int(tag in ("article", "main") and any(w.lower() in ("comment", "comments", "reply") for w in words)))
    return tag + "".join(found), aside


def bare(label: str) -> str:
    return re.split(r"[.#@]", label, maxsplit=1)[0] or label


class Item:
    """A token of a stream with what it holds: an element, a text (TEXT) or a repeated group of several items (GROUP)."""

    __slots__ = ("aside", "chars", "constant", "free", "items", "label", "linked", "optional", "repeats", "seen", "text")

    def __init__(self, label: str, aside: int = 0, items: list[Item] | None = None):
        self.label, self.aside, self.items = label, aside, items or []
        self.optional = self.repeats = self.free = False
        self.constant: int | None = None  # of a text: its digest while all are alike; None: a slot
        self.chars = self.linked = 0
        self.seen: tuple = ()  # of a constant: digests of pages that have it, two at most
        self.text = ""

    @property
    def key(self) -> str:
        """What items are aligned by."""
        return self.label if self.label != GROUP else f"({' '.join(i.key for i in self.items)})"

    @property
    def template(self) -> bool:
        return self.constant is not None and len(self.seen) > 1

    def count(self) -> int:
        return 1 + sum(i.count() for i in self.items)

    def pattern(self) -> str:
        """The expression, squares folded: # is a slot."""
        if self.label == TEXT:
            inner = "#" if self.constant is None else "text"
        elif self.free:
            inner = "(" + "".join(f"({i.pattern()})?" for i in self.items) + ")*"
        else:
            inner = "".join(i.pattern() for i in squash([Item.load(i.dump()) for i in self.items]))
        if self.label not in (TEXT, GROUP):
            inner = f"<{self.label}>{inner}</{bare(self.label)}>"
        mark = ("*" if self.optional else "+") if self.repeats else "?" if self.optional else ""
        return f"({inner}){mark}" if mark else inner

    def dump(self) -> list:
        return [self.label, self.aside, self.optional << 2 | self.repeats << 1 | self.free, self.constant, self.chars, self.linked, self.seen, [i.dump() for i in self.items]]

    @staticmethod
    def load(x: list) -> Item:
        made = Item(x[0], x[1], [Item.load(i) for i in x[7]])
        made.optional, made.repeats, made.free = bool(x[2] & 4), bool(x[2] & 2), bool(x[2] & 1)
        made.constant, made.chars, made.linked, made.seen = x[3], x[4], x[5], tuple(x[6])
        return made


def parse(page: str) -> Item:
    """A page as nested items."""
    root = Item("")
    stack: list[tuple[str, Item]] = []
    text: list[str] = []
    links = inside = 0

    def holder() -> Item:
        return stack[min(len(stack), DEPTH) - 1][1] if stack else root

    def flush() -> None:
        nonlocal text, links
        words = " ".join(entities.unescape("".join(text)).split()) if text else ""
        if words:
            made = Item(TEXT)
            made.text, made.chars, made.linked, made.constant = words, len(words), min(links, len(words)), crc32(words.encode())
            holder().items.append(made)
        text, links = [], 0

    for m in TOKEN.finditer(page):
        tag = m[3]
        if tag is None:
            if m[1] is not None:
                text.append(" ")
            elif m.group()[0] != "<":
                text.append(m.group())
                if inside:
                    links += len(m.group())
            elif m.group() == "<":
                text.append("<")
            continue
        tag = tag.lower()
        if tag not in BLOCKS:
            if tag == "a":
                inside = 0 if m[2] else 1
            elif tag in ("br", "wbr", "img", "input", "button", "option", "label"):
                text.append("" if tag == "wbr" else " ")
            continue
        flush()
        inside = 0
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        else:
            closes = CLOSES.get(tag, ())
            scope = SCOPES.get(tag, ())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in closes:
                    del stack[k:]
                elif stack[k][0] in scope:
                    break
            if stack and stack[-1][0] == "p":
                stack.pop()
            if tag in ("body", "html") and any(t == tag for t, _ in stack):
                continue
            if tag == "body" and stack and stack[-1][0] == "head":
                stack.pop()
            if tag not in VOID:
                made = Item(*label_of(tag, m[4]))
                if len(stack) < DEPTH:
                    holder().items.append(made)
                stack.append((tag, made))
    flush()
    return root


def page_wrapper(page: str) -> Item:
    """The wrapper of one page: its own tokens, each text a constant of this page."""
    root = parse(page)
    whole, texts, todo = blake2b(digest_size=6), [], [root]
    while todo:
        item = todo.pop()
        todo += reversed(item.items)
        if item.label == TEXT:
            texts.append(item)
            whole.update(item.text.encode() + b"\n")
    mark = (int.from_bytes(whole.digest()),)
    for item in texts:
        item.seen, item.text = mark, ""
    return root


def merge(a: Item, b: Item) -> None:
    """Makes a, of the same key as b, accept what b accepts."""
    a.optional |= b.optional
    a.repeats |= b.repeats
    a.aside = min(a.aside, b.aside)
    a.chars += b.chars
    a.linked += b.linked
    if a.label == TEXT:
        if a.constant != b.constant:
            a.constant, a.seen = None, ()
        elif a.constant is not None and a.seen != b.seen:
            a.seen = tuple(sorted({*a.seen, *b.seen})[:2])
    else:
        align(a, b)


def align(a: Item, b: Item) -> None:
    """Aligns the stream in b with that in a."""
    if not (a.free or b.free):
        x, y = a.items, b.items
        keys = [i.key for i in x], [i.key for i in y]
        if keys[0] == keys[1]:
            for i, j in zip(x, y, strict=True):
                merge(i, j)
            return
        x, y = squash(x), squash(y)
        x, y = wrap(x, y), wrap(y, x)
        if max(len(x), len(y)) <= TIDY:
            a.items = aligned(x, y)
            if len(a.items) <= TIDY:
                return
            b = Item("")
        else:
            a.items, b = x, Item("", 0, y)
    generalise(a, [*a.items, *b.items])


def aligned(x: list[Item], y: list[Item]) -> list[Item]:
    """x and y along their longest common subsequence; what only one side has becomes optional."""
    p, q = [i.key for i in x], [i.key for i in y]
    best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
    for i in range(len(p) - 1, -1, -1):
        for j in range(len(q) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if p[i] == q[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(p) or j < len(q):
        if i < len(p) and j < len(q) and p[i] == q[j]:
            merge(x[i], y[j])
            out.append(x[i])
            i, j = i + 1, j + 1
            continue
        if j == len(q) or i < len(p) and best[i + 1][j] >= best[i][j + 1]:
            out.append(x[i])
            i += 1
        else:
            out.append(y[j])
            j += 1
        out[-1].optional = True
    return out


def alike(a: Item, b: Item) -> bool:
    """Whether neighbours may be repetitions of each other: elements that hold quite other things are not."""
    return a.key == b.key and (not a.items or not b.items or not {i.key for i in a.items}.isdisjoint(i.key for i in b.items))


def squash(items: list[Item]) -> list[Item]:
    """A stream with its squares folded into repeated items and groups."""
    out: list[Item] = []
    for item in items:
        if out and alike(out[-1], item):
            merge(out[-1], item)
            out[-1].repeats = True
        else:
            out.append(item)
    found = len(out) > 3
    while found:
        found = False
        keys, following, seen = [i.key for i in out], {}, {}
        for k in range(len(out) - 1, -1, -1):
            following[k] = seen.get(keys[k])
            seen[keys[k]] = k
        now, k = [], 0
        while k < len(out):
            width = (following[k] or k) - k
            times = 1
            while width > 1 and keys[k : k + width] == keys[k + times * width : k + (times + 1) * width]:
                times += 1
            if times > 1:
                body = out[k : k + width]
                for again in range(1, times):
                    for i, j in zip(body, out[k + again * width :], strict=False):
                        merge(i, j)
                now.append(Item(GROUP, 0, body))
                now[-1].repeats = found = True
                k += times * width
            else:
                now.append(out[k])
                k += 1
        out = now
    return out


def wrap(items: list[Item], others: list[Item]) -> list[Item]:
    """items with what is one iteration of a group among others as that group."""
    for group in others:
        if group.label == GROUP:
            keys, body, k, now = [i.key for i in items], [i.key for i in group.items], 0, []
            while k < len(items):
                if keys[k : k + len(body)] == body:
                    now.append(Item(GROUP, 0, items[k : k + len(body)]))
                    now[-1].repeats = True
                    k += len(body)
                else:
                    now.append(items[k])
                    k += 1
            items = now
    return items


def generalise(a: Item, items: list[Item]) -> None:
    """Makes the stream in a any sequence of the given items."""
    alphabet: dict[str, Item] = {}

    def add(item: Item) -> None:
        if item.label == GROUP:
            for i in item.items:
                add(i)
            return
        item.optional = item.repeats = False
        known = alphabet.setdefault(item.key, item)
        if known is not item:
            merge(known, item)
            known.optional = known.repeats = False

    for item in items:
        add(item)
    if len(alphabet) > ALPHABET:
        wide, alphabet = list(alphabet.values()), {}
        for item in wide:
            item.label = bare(item.label)
            add(item)
    a.items, a.free = list(alphabet.values()), True


# Which region of a wrapper is main text


def weight(item: Item) -> int:
    """Characters that vary between pages and aren't links, in what isn't said to be aside."""
    if item.aside or bare(item.label) in HEADS:
        return 0
    return (0 if item.template else max(0, item.chars - item.linked)) if item.label == TEXT else sum(map(weight, item.items))


def plan_of(root: Item) -> dict:
    """What extraction needs of a wrapper: the spine from the root to the region of the main text.

    A node of the spine is [label, optional and repeats and free as bits, what to do, nodes]: k keeps, d drops, m matches further,
    r is the region or its part.
    """
    whole = sum_of(root)

    def settle_asides(item: Item) -> None:
        # What a class or form says is overruled where most of the host's text lies, an article among it.
        if item.aside == 1 and bare(item.label) not in ("article", "main") and 2 * sum_of(item) > whole and (holds(item, "article") or holds(item, "main")):
            item.aside = 0
        if item.aside < 2:
            for i in item.items:
                settle_asides(i)

    settle_asides(root)
    sure = True
    region = topmost(root, lambda i: bare(i.label) == "article")
    single = [i for i in region if not i.repeats]
    if single and 2 * sum(map(sum_of, single)) >= sum(map(sum_of, region)):
        region = single
    region = region or topmost(root, lambda i: bare(i.label) == "main" or "@main" in i.label)
    if not region:
        sure, region = False, smallest_range(root)
    marked = set(map(id, region))

    def node(item: Item, inside: bool) -> list:
        inside = inside or id(item) in marked
        bits = item.optional << 2 | item.repeats << 1 | item.free
        if item.label == GROUP:
            marked.update(map(id, item.items if id(item) in marked else ()))
            return [GROUP, bits, "", [node(i, inside) for i in item.items]]
        if item.label == TEXT:
            return [TEXT, bits, "r" if inside and id(item) in marked else "k" if inside else "d", []]
        if item.aside or not inside and not any_marked(item, marked):
            return [item.label, bits, "d", []]
        if inside and not overruled(item):
            return [item.label, bits, "r" if id(item) in marked else "k", []]
        return [item.label, bits, "m" if id(item) not in marked else "r", [node(i, inside) for i in item.items]]

    return {"sure": sure, "spine": node(root, False) if region else ["", 0, "d", []]}


def sum_of(item: Item) -> int:
    return max(0, item.chars - item.linked) if item.label == TEXT else sum(map(sum_of, item.items))


def holds(item: Item, tag: str) -> bool:
    return any(not i.aside and (bare(i.label) == tag or holds(i, tag)) for i in item.items)


def any_marked(item: Item, marked: set[int]) -> bool:
    return id(item) in marked or any(any_marked(i, marked) for i in item.items)


def overruled(item: Item) -> bool:
    """Whether something below is kept although its label says otherwise."""
    return any(not i.aside and (label_says(i.label) or overruled(i)) for i in item.items)


def label_says(label: str) -> bool:
    tag = bare(label)
    return tag == "form" or tag not in ("html", "body", "article", "main") and any(says_aside(w) for w in re.split(r"[.#@]", label)[1:])


def topmost(item: Item, wanted) -> list[Item]:
    if item.aside:
        return []
    if wanted(item):
        return [item]
    return [found for i in item.items for found in topmost(i, wanted)]


def smallest_range(root: Item) -> list[Item]:
    """The least range of siblings, as deep as may be, that holds all weight."""
    holder = root
    while heavy := [k for k, i in enumerate(holder.items) if weight(i)]:
        only = holder.items[heavy[0]]
        if len(heavy) > 1 or only.label == TEXT or only.repeats:
            return holder.items if holder.free else holder.items[heavy[0] : heavy[-1] + 1]
        holder = only
    return []


# Matching a page


def automaton(nodes: list) -> tuple[list, list[int], list[set[int]], set[int], bool]:
    """Places, first places, what follows each, last places and whether nothing matches too (Glushkov's construction)."""
    places: list = []
    follow: list[set[int]] = []

    def sequence(some: list) -> tuple[set[int], set[int], bool]:
        first: set[int] = set()
        last: set[int] = set()
        empty = True
        for n in some:
            if n[0] == GROUP:
                f, l, e = sequence(n[3])
            else:
                places.append(n)
                follow.append(set())
                f = l = {len(places) - 1}
                e = False
            if n[1] & 2:
                for p in l:
                    follow[p] |= f
            for p in last:
                follow[p] |= f
            first = first | f if empty else first
            e = e or bool(n[1] & 4)
            last = last | l if e else set(l)
            empty = empty and e
        return first, last, empty

    first, last, empty = sequence(nodes)
    return places, sorted(first), follow, last, empty


def match(nodes: list, free: bool, keys: list[str]) -> list | None:
    """The node that each token of a stream belongs to; None where the stream doesn't match."""
    if free:
        known = {n[0]: n for n in nodes}
        return [known.get(k) or known.get(bare(k)) for k in keys]
    places, first, follow, last, empty = automaton(nodes)
    if not keys:
        return [] if empty else None
    trail: list[dict[int, int]] = [{p: -1 for p in first if places[p][0] == keys[0]}]
    for key in keys[1:]:
        trail.append({q: p for p in sorted(trail[-1], reverse=True) for q in follow[p] if places[q][0] == key})
    ends = sorted(last & trail[-1].keys())
    if not ends:
        return None
    at, out = ends[0], []
    for here in reversed(trail):
        out.append(places[at])
        at = here[at]
    return out[::-1]


def texts_in(item: Item, heads: bool) -> Iterator[str]:
    """Texts without what says of itself that it is no main text."""
    for i in item.items:
        if i.label == TEXT:
            yield i.text
        elif not i.aside and (heads or bare(i.label) not in HEADS):
            yield from texts_in(i, heads)


def main_text(page: str, plan: dict) -> str:
    """The main text of a page by its host's wrapper."""
    root, sure = parse(page), plan["sure"]
    out: list[str] = []
    met = False

    def read(item: Item, node: list, inside: bool) -> None:
        nonlocal met
        found = match(node[3], bool(node[1] & 1), [i.label for i in item.items])
        if found is None:
            known = {n[0]: n for n in reversed(node[3])}
            found = [known.get(i.label) for i in item.items]
        for i, n in zip(item.items, found, strict=True):
            what = n[2] if n and (n[0] == i.label or not i.aside) else "k" if inside and not i.aside else "d"
            met |= what == "r"
            if what == "d" or not sure and bare(i.label) in HEADS:
                continue
            if i.label == TEXT:
                out.extend([i.text] if what != "m" else [])
            elif n and n[3]:
                read(i, n, inside or what == "r")
            elif what != "m":
                out.extend(texts_in(i, sure))

    if plan["spine"][3]:
        read(root, plan["spine"], False)
    return "\n".join(out if met else texts_in(root, False))


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#]*)", url or "")
    return m[1].lower().removeprefix("www.") if m else ""


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON) for page_id, url, html: one aligned wrapper per host, over all its pages."""

    def fold(pieces: Iterator[tuple[str, Item]]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Item] = {}
        sizes: dict[str, int] = {}
        nodes = 0

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array([json.dumps(n.dump()) for n in held.values()], pa.string())], ["host", "wrapper"])
            held.clear()
            sizes.clear()
            return made

        for host, root in pieces:
            if host in held:
                align(held[host], root)
            else:
                held[host] = root
            nodes -= sizes.get(host, 0)
            sizes[host] = held[host].count()
            nodes += sizes[host]
            if nodes > HELD_NODES:
                yield flush()
                nodes = 0
        if held:
            yield flush()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fold((host_of(url), page_wrapper(page)) for b in batches for url, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))

    def merge_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Folds sorted partial wrappers, a host at a time."""
        now, root = None, None
        for b in batches:
            for host, wrapper in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                piece = Item.load(json.loads(wrapper))
                if host != now:
                    if now is not None:
                        yield one(now, root)
                    now, root = host, piece
                else:
                    align(root, piece)
        if now is not None:
            yield one(now, root)

    def one(host: str, root: Item) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([json.dumps(root.dump())], pa.string())], ["host", "wrapper"])

    ship_by_value()
    schema = "host string, wrapper string"
    limit_batches(pages.sparkSession)
    partial = pages.select(F.col("url").cast("string"), text_column("html").alias("html")).mapInArrow(read, schema)
    salted = partial.repartition("host", (F.xxhash64("wrapper") % SALTS)).sortWithinPartitions("host").mapInArrow(merge_sorted, schema)
    return salted.repartition("host").sortWithinPartitions("host").mapInArrow(merge_sorted, schema)


def host_plans(pages: DataFrame) -> DataFrame:
    """host, plan (JSON): what extraction needs of each host's wrapper."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        plans = [json.dumps(plan_of(Item.load(json.loads(w.as_py())))) for w in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(plans, pa.string())], ["host", "plan"])

    return map_batches(infer_wrappers(pages), run, "host string, plan string")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of page_id, url, html.

    Plans are a table; Spark broadcasts it or not by its size on disk, and splits the pages of a hot host when it joins.
    """
    plans = settle(host_plans(pages), "plans")
    uri = F.regexp_extract(F.col("url"), r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)
    host = F.coalesce(F.regexp_replace(F.lower(uri), r"^www\.", ""), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), text_column("html").alias("html"), host.alias("host")).join(plans, "host", "left")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        read: dict[str | None, dict] = {None: {"sure": False, "spine": ["", 0, "d", []]}}
        texts = []
        for page, plan in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if plan not in read:
                read[plan] = json.loads(plan)
            texts.append(main_text(page, read[plan]))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return map_batches(rows.select("page_id", "url", "html", "plan"), run, "page_id long, url string, text string")


def op6_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))
