"""Main text of HTML pages as a maximum-scoring subsequence.

A page becomes a line of items in page order: blocks of words and tags. Words
score by the elements around them, tags negative; one linear scan finds the
contiguous stretch with the greatest sum. The text is what that stretch holds
outside elements learned as boilerplate.

Weights come from labelled pages: pages that mark their main text themselves
(``article`` or ``main`` elements, less the elements in them that HTML sets
apart from main content: ``APART``). Text outside is put down to the outermost
element that holds no main text, by its name and by each ``name.class`` of its
classes, id and role; main text to all elements around it. That gives log-odds
per such mark and per tag name. A mark whose words are almost never main text
is learned as boilerplate: each block of its words counts against a stretch as
a tag does, and is left out inside one. No class or id is known beforehand; ``APART`` elements and
``header`` start as boilerplate and pages may teach otherwise. The marks are
labels only: every page is scored by the learned weights, and ``article`` and
``main`` weigh as ``div`` does. Only what HTML never shows as reading text
(``UNREAD``: scripts, styles, form controls, hidden elements) goes by rule.

Fitting reads at most about ``max_labelled`` labelled pages, picked by a hash
of the page, and keeps the ``max_keys`` commonest keys; both are parameters.
Extraction is per row, in time linear in the page however deep it nests: no
shuffle.

Edge cases: null, empty and text-free pages give an empty text; unclosed,
stray and truncated tags are tolerated; very long and very deep pages are read
whole; repeated rows give repeated results; an empty table, or one without
labelled pages, uses the built-in weights; extra columns pass through, and give
way to a new column of their name.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargoscope.llm.common import annotate

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)"
    r"(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?P<end>/?>|\Z)"
    r"|(?P<text>[^<]+|<)", re.DOTALL)
_MARKS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""",
                    re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=\s|=|/|\Z)|aria-hidden\s*=\s*["']?true"""
                     r"""|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.IGNORECASE)

#: Fixed values of HTML: elements by how they behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q "
    "ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table "
    "ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
            "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements whose text is never shown for reading, and form controls.
UNREAD = frozenset(
    "head script style noscript iframe template svg canvas object embed audio video map "
    "button select option optgroup textarea label legend output datalist".split())
#: Elements that HTML defines as apart from the main content.
APART = frozenset("nav footer aside menu search dialog".split())
#: Elements whose name says nothing where a class, id or role does.
GENERIC = frozenset("div span section".split())
LABELS = frozenset(["article", "main"])
_P_STOPS = ("button", "td", "th", "div", "section", *LABELS)
_LIST_STOPS = ("ul", "ol", "dl", "table", "menu", "select")
BOUND = 3.0  # of learned log-odds


@dataclass
class Weights:
    """Scores of words and tags; ``tags``, ``places`` and ``blocked`` come from the fit.

    Words with a learned place score ``base`` plus what their places add, all
    others ``word``.
    """

    word: float = 1.0
    link: float = -0.5
    tag: float = -0.2
    tags: dict[str, float] = field(default_factory=dict)
    base: float = 1.0
    places: dict[str, float] = field(default_factory=dict)
    blocked: frozenset[str] = APART | {"header"}


@dataclass(slots=True, eq=False)
class Node:
    """An open or closed element; ``fresh`` are its marks that no element around it has."""

    name: str
    parent: Node | None = None
    marks: tuple[str, ...] = ()
    fresh: tuple[str, ...] = ()
    labelled: bool = False  # main text by the page's own marks
    unread: bool = False
    dropped: bool = False  # boilerplate, or unread
    linked: bool = False
    holds: bool = False  # a label stands in it
    top: Node | None = None  # outermost element around it that holds no main text
    words: int = 0
    place: float = 0.0
    known: bool = False


@dataclass(slots=True)
class Item:
    """A block of text (``name`` empty) or a tag, and the element it belongs to."""

    name: str
    node: Node
    text: str = ""
    words: int = 0
    links: int = 0


def _plain(name: str) -> str:
    """The name an element is weighed by."""
    return "div" if name in LABELS else name


def _marks(name: str, attrs: str) -> tuple[str, ...]:
    """What an element is known by: its name and each of its classes, id and role."""
    if name in INLINE and not attrs or name in ("html", "body"):
        return ()
    own = []
    if attrs and name not in LABELS:
        values = [a or b or c for a, b, c in _MARKS.findall(attrs)]
        own = [f"{name}.{v}" for v in dict.fromkeys(" ".join(values).lower().split())]
    if name not in INLINE and not (own and name in GENERIC):
        own.append(_plain(name))
    return tuple(own)


def parse(page: str, blocked: frozenset[str] | None = None) -> tuple[list[Item], list[Node]]:
    """Blocks and tags in page order, and the elements in the order they open.

    Inline elements part a block where they are ``blocked``; without that set,
    where they have marks.
    """
    root = Node("")
    out: list[Item] = []
    nodes = [root]
    stack = [root]
    open_at: dict[str, list[int]] = defaultdict(list)  # places in the stack by name
    around: Counter[str] = Counter()  # marks of the open elements
    buffer: list[str] = []
    linked = [0]  # words of the buffer that stand in links
    at, n = 0, len(page)

    def flush():
        text = " ".join(html.unescape("".join(buffer)).split())
        buffer.clear()
        links, linked[0] = linked[0], 0
        if text and not stack[-1].unread:
            words = text.count(" ") + 1
            out.append(Item("", stack[-1], text, words, min(words, links)))

    def parts(e: Node) -> bool:
        return bool(e.marks) if blocked is None else e.dropped != e.parent.dropped

    def pop_to(depth: int):
        if any(e.name not in INLINE or parts(e) for e in stack[depth:]):
            flush()
        for e in reversed(stack[depth:]):
            open_at[e.name].pop()
            around.subtract(e.marks)
        del stack[depth:]

    def last(names) -> int:
        return max((open_at[x][-1] for x in names if open_at.get(x)), default=-1)

    def close(names, stops):
        found = last(names)
        if found > last(stops):
            pop_to(found)

    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        if m["text"] is not None:
            buffer.append(m["text"])
            if stack[-1].linked:
                linked[0] += len(m["text"].split())
            continue
        if m["name"] is None:
            continue
        name, attrs = m["name"].lower(), m["attrs"]
        if m["close"]:
            depth, node = last([name]), stack[-1]
            if depth >= 0:
                node = stack[depth]
                pop_to(depth)
            elif name not in INLINE:
                flush()
            out.append(Item("/" + name, node))
            continue
        if name in CLOSES_P:
            flush()
            close(("p",), _P_STOPS)
        elif name in SIBLINGS:
            flush()
            close(SIBLINGS[name], _LIST_STOPS)
        up = stack[-1]
        marks = _marks(name, attrs)
        unread = up.unread or name in UNREAD or bool(attrs and _HIDDEN.search(attrs))
        node = Node(name, up, marks, tuple(k for k in marks if not around[k]),
                    (up.labelled or name in LABELS) and name not in APART,
                    unread, up.dropped or unread or any(k in (blocked or ()) for k in marks),
                    up.linked or name == "a")
        if name not in INLINE or unread != up.unread or parts(node):
            flush()
        if name in LABELS:
            held = node
            while held is not None and not held.holds:
                held.holds = True
                held = held.parent
        out.append(Item(name, node))
        nodes.append(node)
        if name in VOID or m["end"] == "/>" and name in ("svg", "path", "img"):
            continue
        if name in RAW:
            end = re.compile(f"</{name}", re.IGNORECASE).search(page, at)
            at = end.start() if end else n
        open_at[name].append(len(stack))
        stack.append(node)
        around.update(marks)
    flush()
    return out, nodes


def weigh(nodes: list[Node], weights: Weights) -> None:
    """Gives every element what the places around its words add."""
    for node in nodes[1:]:
        up = node.parent
        node.place, node.known = up.place, up.known
        for mark in node.fresh:
            more = weights.places.get("@" + mark)
            if more is not None:
                node.place, node.known = node.place + more, True


def score(item: Item, weights: Weights) -> float:
    node = item.node
    if node.dropped:  # against a stretch, but the words behind it are not lost for it
        return 0.0 if item.name else weights.tag
    if item.name:
        return weights.tags.get(_plain(item.name.lstrip("/")), weights.tag)
    word = weights.word
    if node.known:
        word = max(-BOUND, min(BOUND, weights.base + node.place))
    return word * (item.words - item.links) + min(word, weights.link) * item.links


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """First and past-the-end index of the stretch with the greatest sum, the
    earliest and shortest of several; (0, 0) if no sum is positive."""
    best, found = 0.0, (0, 0)
    total, start = 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


def main_text(page: str | None, weights: Weights) -> str:
    if not page:
        return ""
    items, nodes = parse(page, weights.blocked)
    weigh(nodes, weights)
    first, last = best_stretch([score(i, weights) for i in items])
    return "\n".join(i.text for i in items[first:last] if not i.name and not i.node.dropped)


def page_counts(page: str) -> Iterator[tuple[str, int, int]]:
    """(key, count inside, count outside) of a labelled page's main text.

    Keys: ``#word`` for words, ``#link`` for those in links, tag names, and
    ``@mark`` for the words of elements. Outside, words and tags count for the
    outermost element that holds no main text, and not for those in it.
    """
    items, nodes = parse(page)
    for node in nodes[1:]:
        node.top = node.parent.top
        if node.top is None and not node.holds and not node.labelled:
            node.top = node
    counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for item in items:
        node = item.node
        if node.unread:
            continue
        side = 0 if node.labelled else 1
        if item.name:
            if node.labelled or node.top is node:
                counts[_plain(item.name.lstrip("/"))][side] += 1
            continue
        counts["#word"][side] += item.words
        counts["#link"][side] += item.links
        if node.labelled:
            node.words += item.words
        elif node.top is not None:
            for mark in node.top.marks:
                counts["@" + mark][1] += item.words
    for node in reversed(nodes[1:]):
        node.parent.words += node.words
        for mark in node.fresh if node.words else ():
            counts["@" + mark][0] += node.words
    for key, (a, b) in counts.items():
        yield key, a, b


def fit(pages: DataFrame, max_labelled: int = 5000, max_keys: int = 20_000,
        min_words: int = 50, html_col: str = "html") -> Weights:
    """Learns the weights from the pages that mark their main text."""
    marked = pages.select(F.col(f"`{html_col}`").alias("html")).filter(
        F.col("html").rlike(r"(?i)<(article|main)[\s>]"))
    n = marked.count()
    if not n:
        return Weights()
    share = min(1.0, max_labelled / n)
    sample = marked.filter(F.pmod(F.xxhash64("html"), 1 << 20) < round(share * (1 << 20)))
    schema = pa.schema([("key", pa.string()), ("inside", pa.int64()), ("outside", pa.int64())])

    def run(batches):
        total_in, total_out = Counter(), Counter()
        for batch in batches:
            for page in batch.column(0):
                for key, a, b in page_counts(page.as_py()):
                    total_in[key] += a
                    total_out[key] += b
        keys = list(total_in)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([total_in[k] for k in keys], pa.int64()),
             pa.array([total_out[k] for k in keys], pa.int64())], schema=schema)

    rows = (sample.mapInArrow(run, "key string, inside long, outside long").groupBy("key")
            .agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
            .orderBy(F.desc(F.col("inside") + F.col("outside")), "key").limit(max_keys).collect())
    return weights_from({r["key"]: (r["inside"], r["outside"]) for r in rows}, min_words)


def weights_from(counts: dict[str, tuple[int, int]], min_words: int = 50) -> Weights:
    """Log-odds of words, of their places against all words, and of each tag
    against all tags, within ``BOUND``.

    Tags of the main text stay weaker than a word, so that short blocks at its
    ends are not cut off. Rare tags and places are drawn towards all of them.
    """
    def odds(a: float, b: float) -> float:
        return math.log((a + 0.5) / (b + 0.5))

    def bound(x: float) -> float:
        return max(-BOUND, min(BOUND, x))

    counts = dict(counts)
    for name in APART | {"header"}:  # what HTML says of them, for pages to overrule
        a, b = counts.get("@" + name, (0, 0))
        counts["@" + name] = (a, b + min_words)
    tags = {k: v for k, v in counts.items() if k[0] not in "#@"}
    words = counts.get("#word", (1, 1))
    base = bound(odds(*words))

    def against(part: tuple[int, int], whole: tuple[int, int]) -> float:
        share = (whole[0] + 0.5) / (sum(whole) + 1)
        return bound(odds(part[0] + min_words * share, part[1] + min_words * (1 - share))) - bound(
            odds(*whole))

    every = tuple(sum(v[i] for v in tags.values()) for i in (0, 1))
    learned = {k: max(-BOUND, min(-0.1, against(v, every) - 0.1)) for k, v in tags.items()}
    places = {k: against(v, words) for k, v in counts.items() if k[0] == "@"}
    blocked = frozenset(k[1:] for k, (a, b) in counts.items()
                        if k[0] == "@" and a + b >= min_words and a < 0.02 * (a + b))
    word = max(0.5, base)
    link = max(-1.0, min(word, odds(*counts["#link"]))) if any(
        counts.get("#link", ())) else Weights.link
    return Weights(word, link, -0.2, learned, base, places, blocked)


def extract(pages: DataFrame, weights: Weights | None = None, html_col: str = "html",
            keep: list[str] | None = None, **fit_options) -> DataFrame:
    """Adds ``text`` (blocks joined by a line feed) and ``n_chars``."""
    if weights is None:
        weights = fit(pages, html_col=html_col, **fit_options)

    def make():
        def run(texts):
            out = [main_text(t, weights) for t in texts]
            return [out, [len(t) for t in out]]
        return run

    return annotate(pages, make, "text string, n_chars long", html_col, keep)
