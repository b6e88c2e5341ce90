"""Main text extraction: planted pages, brute-force stretch search, edge rows."""

import html
import random
import re

import pytest

from cargoscope.llm import html_extract as hx
from tests.conftest import SMOKE_DIR

W = hx.Weights()
BODY = "<p>The quick brown fox jumps over the lazy dog again and again.</p>"


def test_stretch_equals_brute_force():
    rnd = random.Random(1)
    for _ in range(200):
        s = [rnd.randint(-4, 4) for _ in range(rnd.randrange(12))]
        sums = [sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)]
        i, j = hx.best_stretch(s)
        assert sum(s[i:j]) == max([0, *sums])


PAGES = [
    ("<html><head><title>T</title></head><body><nav><a>Home</a></nav><article><h1>A &amp; B</h1>"
     "<p>One  two\n three<p>four <b>fi</b>ve&nbsp;six</article><footer>&copy; foot</footer>",
     "A & B\nOne two three\nfour five six"),
    ("<div class='Cookie-Notice'>We use cookies</div><main>" + BODY + "<div id=comments><article>"
     "<p>Reader says hello</p></article></div><aside>More</aside><p>End.</p></main>",
     "The quick brown fox jumps over the lazy dog again and again.\nEnd."),
    ("<ul><li><a href=/a>Home</a><li><a href=/b>Other pages of this site</a></ul><div>" + BODY * 2
     + "<script>var a='<p>no</p>';</script><ul><li>item one</li><li>two</ul></div>"
     "<form><label>Name</label><input></form>",
     "\n".join(["The quick brown fox jumps over the lazy dog again and again."] * 2
               + ["item one", "two"])),
    ("<article><p class='notice'>Read me first<p>Text <br>here <!-- <p>x</p> --> and there"
     "<style>p{}</style></p><table><tr><td>1<td>2</table></article", "Text\nhere and there\n1\n2"),
    ("<article><p>a &lt;b&gt; c &amp", "a <b> c &"),
    ("just text", "just text"), ("<p></p>", ""), ("<nav>only menu words</nav>", ""),
    ("<p hidden>no</p><p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
    ("</div></p><article></span>x</article>", "x"), (None, ""), ("", ""),
    ("<article>" + "<div><p>word</p>" * 5000, "\n".join(["word"] * 5000)),
]


def taught():
    """Weights of a site whose classes the pages have taught."""
    return fitted(["<div class='cookie-notice'>We use cookies for this and that</div><article>"
                   + BODY * 4 + "</article><div id=comments>Reader says hello</div>"
                   "<p class=notice>Read me first"] * 30)


@pytest.mark.parametrize("page, want", PAGES)
def test_pages(page, want):
    assert hx.main_text(page, taught() if page and "otice" in page else W) == want


def test_learned_keys_and_weights():
    page = "<div class='x9 zone'>" + "buy " * 30 + "</div><article>" + BODY * 3 + "</article>"
    counts = {k: (a * 4, b * 4) for k, a, b in hx.page_counts(page)}
    got = hx.weights_from(counts)
    assert {"div.x9", "div.zone"} <= got.blocked and "div" not in got.blocked
    assert got.tags["p"] == -0.1 > got.tags["div"]
    assert hx.main_text("<div class=zone>" + "buy " * 99 + "</div>" + BODY, got) == BODY[3:-4]


def test_rows(spark):
    pages = [x for x in PAGES if not (x[0] and "otice" in x[0])]
    rows = [(i, p, "t") for i, (p, _) in enumerate(pages + pages[:2])] + [(None, "<main>q</main>", None)]
    df = spark.createDataFrame(rows, "page_id long, html string, TEXT string")
    out = hx.extract(df)
    assert [c.lower() for c in out.columns].count("text") == 1
    want = [w for _, w in pages + pages[:2]] + ["q"]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    for i, w in enumerate(want[:-1]):
        assert got[i] == (w, len(w))
    assert got[None] == ("q", 1)
    assert hx.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("tag", ["div class='content has-sidebar'", "section id=post-comment-policy",
                                 "div class='share-price-table related'", "div role=main", "form id=f"])
def test_names_of_elements_decide_nothing_untaught(tag):
    """Whole bodies in elements whose class or id holds a word such as sidebar."""
    page = f"<nav><a>Home</a></nav><{tag}>" + BODY * 60 + f"</{tag.split()[0]}><footer>foot</footer>"
    want = "\n".join([BODY[3:-4]] * 60)
    assert hx.main_text(page, W) == hx.main_text(page, taught()) == want
    inner = "<article>" + BODY + f"<{tag}>" + BODY * 2 + f"</{tag.split()[0]}>" + BODY + "</article>"
    assert hx.main_text(inner, taught()) == "\n".join([BODY[3:-4]] * 4)


def test_scan_decides_between_known_and_unknown_elements():
    """Nothing here is boilerplate by name; the stretch leaves the link lists out."""
    links = "<div><span>" + "<a href=x>Some other page of this site</a> " * 9 + "</span></div>"
    page = links + "<div>" + BODY * 9 + "</div>" + links
    for weights in (W, taught()):
        items, nodes = hx.parse(page, weights.blocked)
        hx.weigh(nodes, weights)
        without = [i.text for i in items if not i.name and not i.node.dropped]
        assert len(without) == 11
        assert hx.main_text(page, weights) == "\n".join(without[1:-1]) == "\n".join([BODY[3:-4]] * 9)


def test_inline_classes_do_not_part_a_block():
    page = "<p>one <span class=x>two</span> <a class=y href=z>three</a> <b class=ad>buy</b> four</p>"
    assert hx.main_text(page, W) == "one two three buy four"
    weights = hx.Weights(blocked=frozenset(["b.ad"]))
    assert hx.main_text(page, weights) == "one two three\nfour"


def test_excluded_block_inside_does_not_part_the_text():
    page = "<article>" + BODY * 5 + "<div id=comments>" + "shout " * 500 + "</div>" + BODY * 5
    assert hx.main_text(page, taught()) == "\n".join([BODY[3:-4]] * 10)


def test_deep_pages_take_linear_time():
    import time
    start = time.process_time()
    deep = "<article>" + "".join(f"<div class=c{i}><u>word " for i in range(100_000))
    assert hx.main_text(deep, W).count("word") == 100_000
    assert sum(1 for _ in hx.page_counts(deep)) > 100_000
    assert hx.main_text("<b><i>word " * 100_000 + "</p></div>" * 100_000, W).count("word") == 100_000
    assert time.process_time() - start < 30


def plain(page):
    """The article element by pattern, as these test tables write it."""
    inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.DOTALL)[1]
    parts = re.split(r"</?(?:p|h1|br)[^>]*>", re.sub(r"</?b>", "", inner))
    return "\n".join(t for t in (" ".join(html.unescape(x).split()) for x in parts) if t)


def fitted(pages):
    counts = {}
    for page in pages:
        for k, a, b in hx.page_counts(page):
            x = counts.get(k, (0, 0))
            counts[k] = (x[0] + a, x[1] + b)
    return hx.weights_from(counts)


def renamed(page):
    return re.sub(r"<(/?)article\b", r"<\1div", page)


def test_renamed_articles_extract_alike(spark):
    pages = [r["html"] for r in spark.read.parquet(f"{SMOKE_DIR}/pages.parquet").collect()]
    weights = fitted(pages)
    for page in pages:
        assert hx.main_text(renamed(page), weights) == plain(page)


def test_learned_places_decide_without_marks():
    side = "<section class=box>" + "<li>buy this now" * 8 + "</section>"
    train = [f"{side}<article><h1>Some title</h1>{BODY * 6}</article>{side}"] * 30
    weights = fitted(train)
    weights.blocked = frozenset()  # by weights alone
    want = "\n".join(["Some title"] + [BODY[3:-4]] * 6)
    for page in train[:1]:
        assert hx.main_text(page, weights) == hx.main_text(renamed(page), weights) == want


def test_teaser_in_article_does_not_replace_the_body():
    card = "<article><h3>More</h3><p>One short teaser.</p></article>"
    page = "<div>" + BODY * 9 + "</div>" + card
    for weights in (W, fitted(["<nav>Menu</nav><article>" + BODY * 5 + "</article>"] * 20)):
        assert hx.main_text(page, weights).startswith("\n".join([BODY[3:-4]] * 9))


def test_query_equals_marked_article(spark):
    import __spark_entry__ as E
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SMOKE_DIR}/pages.parquet").collect()}
    rows = E.queries()["op6_html_extract"](spark, SMOKE_DIR).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == plain(pages[r["page_id"]]["html"])
        assert (r["url"], r["n_chars"]) == (pages[r["page_id"]]["url"], len(r["text"]))
