import random

import pytest

from plumbline.llm import html_wrappers as hw
from plumbline.llm.alignment import common

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x="</p><p>no";</script></head><body>
<header class="site-header"><h1>Site</h1></header><nav><ul><li><a href="/a">A</a><li><a>B</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="sidebar-left"><p>side</p></div><form><p>Search <input name=q></p></form>
<article class="post"><header><h1>Head &amp; line {n}</h1></header><p>First <b>bold&nbsp;text {n}
 more</b><br>x<p>Second &lt;{n}&gt; <!-- no <p>comment</p> -->end<ul><li>one<li>two {n}</ul>
<div class="share">Share this</div><p>Read more on our site</p><aside>aside</aside><script>bad()</script></article>
<section id="comments"><article class="comment"><p>reader says a lot of things here, much more than the article says, again and again and again</p></article></section>
<div class="ad">buy</div><footer>&copy; me</footer></body></html>"""


def article(n):
    return f"Head & line {n}\nFirst bold text {n} more x\nSecond <{n}> end\none\ntwo {n}\nRead more on our site"


def test_one_page():
    assert hw.main_text(PAGE.format(n=1)) == article(1)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain text only", "plain text only"),
        ("<p>a<p>b", "a\nb"),
        ("<body><div class=content><p>a &eacute; &unknown; &#x41;</p></div><div class='comments'>c</div>", "a é &unknown; A"),
        ("<div><div><p>The text of this page is long enough</p><p>and goes on.</p></div><div><a>x</a></div></div>", "The text of this page is long enough\nand goes on."),
        ("<article><p>cut off in a ta", "cut off in a ta"),
        ("<article><p>cut off in a <a href='", "cut off in a"),
        ("<article><p>x<!-- never ends", "x"),
        ("<article><p>x<!-- ends --> y", "x y"),
        ("<article><p>x<script>never ends", "x"),
        ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1\n2\n3"),
        ('<article><p title="a > b">q</p></article>', "q"),
        ("<article><p>a < b and c</p></article>", "a < b and c"),
        ("<main><h2>H</h2><nav>n</nav>t</main><div>other</div>", "H\nt"),
        ("<article><p>short</p></article><article><p>the longer one</p></article>", "short\nthe longer one"),
        ("<article><p>a</p><div class=related-work><p>b</p></div><div class='notice-board'>c</div><div class='related-posts'>d</div><div class=share>e</div></article>", "a\nb\nc"),
        ("<div class=main><article><p>a</p></article></div><div class=sidebar><article><p>teaser</p></article></div><aside><article>x</article></aside>", "a"),
        ("<form><article><p>a</p></article><input></form>", "a"),
        ("<article>" + "<div>" * 120 + "<nav>menu</nav>a" + "</div>" * 120 + "</article>", "a"),
        ("<div>" * 120 + "<p>text that is long</p><nav>menu</nav>" + "</div>" * 120, "text that is long"),
        ("<table><tr><td><a>m</a><td><p>The text of the page</p><p>is in a cell</p></table>", "The text of the page\nis in a cell"),
        ("<article><ul><li>1<ul><li>2<li>3</ul><li>4</ul></article>", "1\n2\n3\n4"),
        ("<div>" * 500 + "deep" + "</div>" * 500, "deep"),
        ("<p><b>one<br><p>two</p>", "one\ntwo"),
        ('<div class="page has-sidebar"><p>text</p><div class="sidebar"><p>side</p></div></div>', "text"),
        ('<div class="sidebar"><p>all there is</p><nav>menu</nav></div>', "all there is"),
        ("<nav>menu</nav>", ""),
    ],
)
def test_markup(page, text):
    assert hw.main_text(page) == text


def folded(pages):
    """The wrapper of pages as the operator folds them: structures added up, then in order of their digests."""
    found = {}
    for page in pages:
        own = hw.own_wrapper(hw.parse(page))
        key = hw.digest(hw.flat(own, counts=False))
        if key in found:
            hw.merge(found[key], own)
        else:
            found[key] = own
    whole = None
    for _, w in sorted(found.items()):
        if whole is None:
            whole = w
        else:
            hw.merge(whole, w)
    return hw.weighed(whole)


def test_a_wrapper_finds_slots_groups_and_constants():
    pages = [f"<div class=top>Same</div><ul>{'<li>i' + str(k) + '</li>' * (k % 3 + 1)}</ul>" + ("<div>ad</div>" if k % 2 else "") + f"<p>text {k}</p>" for k in range(6)]
    top, ul, *div, p = folded(pages).stream
    div = next(x for x in folded(pages).stream if x.kind == "div")
    assert (top.kind, top.pages, top.stream[0].weight, top.stream[0].low) == ("div.top", 6, 0, hw.digest("Same"))
    assert (ul.kind, ul.pages) == ("ul", 6) and (div.kind, div.pages) == ("div", 3)  # the latter is optional
    assert p.stream[0].pages == 6 and p.stream[0].low != p.stream[0].high and p.weight == 6 * len("text 0")  # a slot


def test_recurring_tokens_are_a_repeated_group():
    got = hw.own_wrapper(hw.parse("<h1>t</h1>" + "<h2>a</h2><p>b</p>" * 5000 + "<div>c</div>"))
    assert [(t.kind, t.repeated) for t in got.stream] == [("h1", False), ("h2", True), ("p", True), ("div", False)]


def test_alignments_are_longest_common_subsequences():
    r = random.Random(1)
    for _ in range(3000):
        k = r.randint(1, 6)
        a, b = ([r.randint(0, k) for _ in range(r.randint(0, 14))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        for bits in (1 << 20, 4):
            got = common(a, b, bits)
            assert len(got) == table[-1][-1] and all(a[i] == b[j] for i, j in got)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
    assert len(common("1a2b3c4d5eWXY", "WXYabcde")) == 5


def site(r, n, host):
    """Pages without tags that name the article: a varying menu, the article, lines that all pages share; and the article's text."""
    out = []
    for k in range(n):
        words = [" ".join(r.choice("red green blue one two three".split()) for _ in range(r.randint(3, 60))) for _ in range(r.randint(1, 6))]
        body = "".join(f"<h2>Key findings</h2><p>{w}</p>" if r.random() < 0.3 else f"<p>{w}</p>" for w in words) + r.choice(["", "<ul><li>x<li>y</ul>", "<div class=related-work><p>older</p></div>"])
        page = f"<div class=a><div>Menu {k % 4}</div><div>News</div></div><div class=b>{body}</div><div class=c>All rights reserved by the owners of this very site, whoever they may be now or later, in all countries</div>"
        out.append((k, f"http://{host}/{k}", page, body))
    return out


def text_of(body):
    blocks = hw.parse(body)
    hw.weigh(blocks, None, by_marks=False)
    return "\n".join(hw.texts(blocks[0]))


def test_slots_decide_where_the_article_is():
    """Small articles beside a longer constant: the host's pages together show what varies."""
    pages = site(random.Random(2), 40, "x")
    wrapper = folded([p for _, _, p, _ in pages])
    assert [hw.main_text(p, wrapper) for _, _, p, _ in pages] == [text_of(body) for *_, body in pages]
    short = min(pages, key=lambda p: len(p[3]))
    assert hw.main_text(short[2]) != text_of(short[3])  # the page alone does not


def test_shared_headings_stay():
    pages = [f"<article><h2>Key findings</h2><p>text {k} {'x' * k}</p><p>Read more</p></article><div class=x>foot</div>" for k in range(9)]
    wrapper = folded(pages)
    assert [hw.main_text(p, wrapper) for p in pages] == [f"Key findings\ntext {k} {'x' * k}".rstrip() + "\nRead more" for k in range(9)]


def test_constant_proposals_are_no_article():
    pages = [f"<article class=promo-card><p>Buy our things</p></article><article><p>text {k}</p></article>" for k in range(4)]
    assert hw.main_text(pages[1], folded(pages)) == "text 1"
    pages = [f"<article><p>Buy our things</p></article><div><p>the long text of this page has number {k}</p><p>{k}</p></div>" for k in range(4)]
    assert hw.main_text(pages[1], folded(pages)) == "the long text of this page has number 1\n1"


def test_result_does_not_depend_on_how_pages_are_dealt(spark):
    r = random.Random(7)
    rows = [(i, *p[1:3]) for i, p in enumerate(site(r, 60, "one.example") + site(r, 12, "two.example"))]
    rows += [(1000 + k, "http://one.example/copy", rows[3][2]) for k in range(40)] + [(2000 + k, f"http://one.example/q{k}", PAGE.format(n=k)) for k in range(9)]
    results = []
    for parts, seed in ((1, 0), (3, 1), (16, 2)):
        random.Random(seed).shuffle(rows)
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
        results.append({x.page_id: x.text for x in hw.extract(pages).collect()})
    assert results[0] == results[1] == results[2] and len(results[0]) == len(rows)
    assert results[0][2003] == article(3)


def test_repeats_within_a_page_are_no_constant():
    page = "<article>" + "<p>la</p>" * 9 + "</article>"
    assert hw.main_text(page, folded([page])) == "\n".join(["la"] * 9)


def test_many_and_deep_blocks():
    pages = ["".join(f"<h2>h{i}</h2><p>p{i} {k}</p>" for i in range(20_000)) for k in range(2)]
    assert hw.main_text(pages[0], folded(pages)).count("\n") == 39_999
    deep = "<div>" * 3000 + "<p>deep text</p><nav>no</nav>" + "</div>" * 3000
    wrapper = hw.weighed(hw.unflat(hw.flat(folded([deep, deep.replace("deep", "low")]))))
    assert hw.main_text(deep, wrapper) == "deep text"


def test_hard_pages_take_linear_time():
    for page in ("<" * 300_000, "<!--" * 100_000, '<a b="' * 50_000, "<script>" * 50_000, "<p>" * 50_000, "<b>" * 50_000 + "<p></p>" * 50_000, "<x>" * 50_000 + "<p></p>" * 50_000, "<x>" * 50_000 + "</div>" * 50_000, '<a b="' * 50_001 + ">", "&" * 300_000):
        hw.main_text(page)


@pytest.mark.parametrize("small", [True, False])
def test_table(spark, small, monkeypatch):
    if not small:
        monkeypatch.setattr(hw, "BROADCAST_BYTES", 0)
    rows = [(k, f"http://Host.example/{k}", PAGE.format(n=k), 1) for k in range(8)] + [(20, "http://other.example/", PAGE.format(n=5), 1), (21, None, None, 1), (21, None, "", 1), (None, "odd", "<p>x</p>", 1), (None, "odd", "<p>x</p>", 1)]
    rows += [(40 + k, "http://copies.example/", "<p>same</p>", 1) for k in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, wrapper int").repartition(3)
    got = hw.extract(pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert all(by[k].text == article(k) for k in range(8))
    assert by[20].text == article(5) and by[21].text == "" and by[None].text == "x" and by[45].text == "same"
    assert all(r.n_chars == len(r.text) for r in got)
    assert hw.extract(pages.limit(0)).collect() == []
