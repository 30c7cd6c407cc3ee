"""HTML extraction on sites whose main text is known."""

import random
import re

import pytest
from llm_helpers import prose, rows_of
from pyspark.sql import functions as F

from tidegraph.llm import wrappers

PAGES = "page_id long, url string, html string"


def paragraphs(k):
    return [prose(100 * k + j, 12 + j) for j in range(1 + k % 4)]


def plain(k):
    """An article element among menus and adverts, with unclosed tags."""
    body = "".join(f"<p><b>{p}<br>" if j % 2 else f"<p>{p}</p>" for j, p in enumerate(paragraphs(k)))
    return (
        f'<!DOCTYPE html><html lang=en><head><title>T &amp; {k}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul>'
        + "".join(f"<li><a href=/{j}>menu {j} {k}</a></li>" for j in range(3))
        + f'</ul></nav><!-- ad {k} --><div class="ad">buy {prose(k, 9)}</div><article><h1>Head &lt;{k}&gt;</h1>{body}</article><footer>&copy; us {k}'
        + ("</footer></body></html>" if k % 3 else "</footer>")
    ), [f"Head <{k}>", *paragraphs(k)]


def busy(k):
    """A main element with sharing links, a line that never changes, and readers' comments that are articles too."""
    body = "".join(f"<div class='text'>{p}</div>" for p in paragraphs(k))
    return (
        f'<html><body class="post-{k} has-sidebar"><header class="site-header"><a href="/">Site</a><h1>Name</h1></header><div id="wrap"><div class="cookie-notice">We use cookies</div>'
        f'<main><header><h2>Story {k}</h2></header>{body}<p class="fine">Reprints by agreement only.</p><ul class="share"><li><a href="#">Share</a></ul>'
        f'<section id="comments"><article class="comment"><p>Nice {prose(k, 30)}</p></article></section></main><aside><p>Related {prose(k + 1, 30)}</p></aside></div>'
        f"<form><label>Mail {k}</label><textarea>x</textarea></form><footer>(c)</footer></body></html>"
    ), [f"Story {k}", *paragraphs(k), "Reprints by agreement only."]


def old(k):
    """Tables, no element that says what it is."""
    return f"<table><tr><td class=menu><a href=1>Home</a> <a href=2>News</a><td><h2>Tale {k}</h2>{prose(k, 40)}<br>second   line&nbsp;here<p>{prose(k + 7, 20)}</table>", [f"Tale {k}", f"{prose(k, 40)} second line here", prose(k + 7, 20)]


SITES = {"plain.example.org": plain, "www.busy.example.org": busy, "old.example.net:8080": old}


@pytest.fixture
def web(spark):
    pages, wanted = [], []
    for host, make in SITES.items():
        for k in range(12):
            page, text = make(k)
            pages.append((len(pages), f"https://{host}/{k}?q#f", page))
            wanted.append((len(wanted), pages[-1][1], "\n".join(text)))
    return spark.createDataFrame(pages, PAGES), wanted


def test_main_text_of_three_sites(spark, put, web):
    pages, wanted = web
    found = wrappers.op6_html_wrappers(spark, put(pages=pages.withColumn("host", F.lit("clash")).withColumn("plan", F.lit("clash"))))
    assert rows_of(found, ["page_id", "url", "text", "n_chars"]) == sorted(((*w, len(w[2])) for w in wanted), key=repr)


def test_the_order_of_alignment_does_not_matter(spark, web):
    rows = [tuple(r) for r in web[0].collect()]
    random.Random(1).shuffle(rows)
    shuffled = spark.createDataFrame(rows, PAGES).repartition(7)
    assert rows_of(wrappers.extract(shuffled), ["page_id", "text"]) == sorted(((i, t) for i, _, t in web[1]), key=repr)


def wrapper_of(pages):
    first, *others = map(wrappers.page_wrapper, pages)
    for other in others:
        wrappers.align(first, other)
    return first


def test_wrappers_are_regular_expressions_without_unions():
    pages = ["<body><h1>A</h1><p>x</p><p>y</p><div>const</div></body>", "<body><h1>B</h1><p>z</p><ul><li>1</ul><div>const</div></body>"]
    wrapper = wrapper_of(pages)
    assert wrapper.pattern() == "<><body><h1>#</h1>(<p>#</p>)+(<ul><li>text</li></ul>)?<div>text</div></body></>"
    assert wrappers.Item.load(wrapper.dump()).pattern() == wrapper.pattern()


def test_squares_become_repeated_groups():
    square = "<h2>{0}</h2><p>{0}x</p>"
    assert wrapper_of(["".join(map(square.format, "ab"))]).pattern() == "<>(<h2>#</h2><p>#</p>)+</>"
    assert wrapper_of(["".join(map(square.format, "ab")), "".join(map(square.format, "cde")), square.format("f")]).pattern() == "<>(<h2>#</h2><p>#</p>)+</>"
    assert wrapper_of(["<h2>a</h2><p>b</p><h2>c</h2><p>d</p><div>e</div><p>f</p>"]).pattern() == "<>(<h2>#</h2><p>#</p>)+<div>text</div><p>text</p></>"
    assert wrapper_of(["<h2>a</h2><p>b</p>", "<p>c</p><h2>d</h2>"]).pattern().count("?") == 2


KEYS = ("p", "h2", "ul", "div", "#")


def as_re(nodes, free):
    """The stream of a wrapper in Python's own regular expressions, a letter for each token."""
    if free:
        return "(?:" + "".join(f"(?:{as_re([[*n[:1], 0, *n[2:]]], False)})?" for n in nodes) + ")*?"
    out = ""
    for key, bits, _, inner in nodes:
        one = as_re(inner, False) if key == wrappers.GROUP else re.escape("phud#"[KEYS.index(key)])
        out += f"(?:{one})" + {0: "", 2: "+", 4: "?", 6: "*"}[bits & 6]
    return out


def spelled(items):
    return "".join("phud#"[KEYS.index(i.label)] for i in items)


def bits(item):
    return [item.label, item.optional << 2 | item.repeats << 1 | item.free, "k", [bits(i) for i in item.items] if item.label == wrappers.GROUP else []]


@pytest.mark.parametrize("tidy", [48, 4])
def test_matching_against_brute_force(monkeypatch, tidy):
    """Wrappers accept all the pages they come from, and their automata what Python's regular expressions accept."""
    monkeypatch.setattr(wrappers, "TIDY", tidy)
    rng = random.Random(5)
    for _ in range(150):
        words = [[rng.choice(KEYS[:4]) for _ in range(rng.randrange(7))] * rng.choice((1, 1, 2)) for _ in range(rng.randrange(1, 5))]
        pages = ["".join(f"<{w}>{rng.random()}</{w}>" for w in word) for word in words]
        halves = [wrapper_of(h) for h in (pages[::2], pages[1::2]) if h]
        for other in halves[1:]:
            wrappers.align(halves[0], other)
        wrapper = halves[0]
        nodes = [bits(i) for i in wrapper.items]
        pattern = re.compile(as_re(nodes, wrapper.free))
        for word in [*words, *([rng.choice(KEYS) for _ in range(rng.randrange(6))] for _ in range(20))]:
            accepted = pattern.fullmatch("".join("phud#"[KEYS.index(w)] for w in word)) is not None
            found = wrappers.match(nodes, wrapper.free, word)
            assert accepted == (found is not None and None not in found) and (accepted or word not in words)
            assert not accepted or [n[0] for n in found] == word


def one_host(spark, pages):
    rows = [(k, f"http://one/{k}", page) for k, page in enumerate(pages)]
    return {r["page_id"]: r["text"] for r in wrappers.extract(spark.createDataFrame(rows, PAGES)).collect()}


def chrome(k, body):
    """A site without any element or class that says what it is."""
    links = "".join(f"<a href=/{j}>Section {j}</a> " for j in range(5))
    return f"<html><body><div>{links}</div><div>The daily news of our town</div><div>{body}</div><div>All rights kept by us</div></body></html>"


def test_boundaries_that_only_the_wrapper_can_tell(spark):
    body = lambda k: f"<h2>Head {k}</h2>" + "".join(f"<p>{prose(10 * k + j, 8)}</p>" for j in range(1 + k % 3)) + f"<h3>Background</h3><p>{prose(k + 500, 5)}</p>"
    found = one_host(spark, [chrome(k, body(k)) for k in range(12)])
    assert found == {k: "\n".join([f"Head {k}", *(prose(10 * k + j, 8) for j in range(1 + k % 3)), "Background", prose(k + 500, 5)]) for k in range(12)}
    # A page alone can't tell.
    assert "All rights kept by us" in one_host(spark, [chrome(1, body(1))])[0]


@pytest.mark.parametrize("copies", [1, 2, 5, 50])
@pytest.mark.parametrize("body", ["<article><h1>One head</h1><p>The only paragraph.</p></article>", "<article>Bare text</article>", "<div><h2>One</h2><blockquote>said so</blockquote><p>lone</p></div>"])
def test_copies_of_one_page_are_no_template(spark, body, copies):
    assert set(one_host(spark, [f"<body>{body}</body>"] * copies).values()) == {"\n".join(t for t in re.split("<[^>]*>", body) if t)}


CASES = {
    '<div class="post category-social"><h2>A</h2><p>b</p></div>': "A\nb",
    '<article><p class="legal-analysis">law</p><p>x</p></article>': "law\nx",
    '<article><p>See</p><ul><li><a href=1>one</a><li><a href=2>two</a></ul></article>': "See\none\ntwo",
    "<article><p>E is <math><mi>m</mi></math> and <object>text</object></p></article>": "E is m and text",
    "<nav>menu</nav><div>chrome</div><article></article>": "",
    '<article><p>a</p><div class="ad">buy</div><div class="cookie-notice">ok</div><form>mail</form><section id="comments"><article class="comment">hi</article></section><p>b</p></article>': "a\nb",
    "<form action=/><div class=x><article><p>all in a form</p></article></div></form>": "all in a form",
}


@pytest.mark.parametrize("page", CASES)
def test_what_stays_and_what_goes(spark, page):
    assert set(one_host(spark, [f"<body>{page}</body>"] * 3).values()) == {CASES[page]}


def test_what_all_articles_have_stays(spark):
    """Texts that are alike on pages that differ are template outside the article only."""
    make = lambda k: f"<body><div>We sell things</div><article><h1>Head {k}</h1><h2>Summary</h2><div class=x>{prose(k, 9)}</div><blockquote>As ever.</blockquote><div class=y>The end</div></article></body>"
    assert one_host(spark, [make(k) for k in range(8)]) == {k: f"Head {k}\nSummary\n{prose(k, 9)}\nAs ever.\nThe end" for k in range(8)}


def test_classes_that_never_recur_dont_swell_the_wrapper():
    pages = ["<body><article>" + "".join(f"<p class='c{chr(97 + k % 26)}{chr(97 + j)}{chr(97 + (k // 26 + j) % 26)}'>{k} {j}</p>" for j in range(20)) + "</article></body>" for k in range(400)]
    wrapper = wrapper_of(pages)
    assert wrapper.count() < 3 * wrappers.ALPHABET
    assert all(wrappers.main_text(p, wrappers.plan_of(wrapper)) == "\n".join(f"{k} {j}" for j in range(20)) for k, p in enumerate(pages))


def test_articles_in_a_list_all_count_and_a_page_without_any_gives_its_body(spark):
    lone = "<body><nav>menu</nav><div>just this</div></body>"
    found = one_host(spark, [*(f"<body><nav>menu</nav><article>a{k}</article><article>b{k}</article></body>" for k in range(3)), lone])
    assert found == {0: "a0\nb0", 1: "a1\nb1", 2: "a2\nb2", 3: "just this"}


def test_odd_pages(spark, put):
    rows = [
        (1, None, None),
        (None, "http://a/b", ""),
        (2, "x", "<p>hi &lt;b&gt; &copy &#x41;"),
        (2, "x", "<p>hi &lt;b&gt; &copy &#x41;"),
        (3, "http://long/", "<article>" + "<p>word </p>" * 20_000 + "</article>"),
        (4, "http://cut/", "<body><article><p>text<!-- open"),
        (5, "http://cut2/", '<p>before</p><script>never closed'),
        (6, "http://deep/", "<div>" * 3000 + "deep" + "</div>" * 3000),
        (7, "http://lt/", "<p>1 < 2 and 3 > 2</p><p"),
    ]
    found = {r["page_id"]: r["text"] for r in wrappers.op6_html_wrappers(spark, put(pages=spark.createDataFrame(rows, PAGES))).collect()}
    assert found[1] == found[None] == "" and found[2] == "hi <b> © A" and found[4] == "text" and found[5] == "before" and found[6] == "deep"
    assert found[3] == "\n".join(["word"] * 20_000) and found[7] == "1 < 2 and 3 > 2"
    assert wrappers.op6_html_wrappers(spark, put(pages=spark.createDataFrame([], PAGES))).count() == 0
