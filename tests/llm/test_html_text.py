"""Main text: alignment against the textbook recurrence, chosen pages, and the operator against a plain version."""

import html
import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm import html_text as module
from strata.llm.html_text import ARTICLE, FREE, OUT, common_subsequence, extract_text, line_code, line_hash, main_text, page_lines


def plain_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40), st.lists(st.integers(0, 5), max_size=40), st.sampled_from([4, 64, 1 << 27]))
def test_common_subsequence_is_longest(a, b, bits):
    old, module.TRACE_BITS = module.TRACE_BITS, bits
    try:
        pairs = common_subsequence(a, b)
    finally:
        module.TRACE_BITS = old
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    assert len(pairs) == plain_length(a, b)


def text(page, *neighbours, site=()):
    beside = [[line_code(*line) for line in page_lines(n)] for n in neighbours]
    return main_text(page_lines(page), beside, frozenset(line_hash(line) >> 2 for line in site))


MARKUP = st.lists(
    st.sampled_from(
        ["<", ">", "</", "<!", "<!--", "-->", "<![foo[x]]>", "<![CDATA[", "]]>", "<!doctype", "<?php", "?>", "&", "&amp", "&#x", "&#0;", "&#xD800;",
         "<div", "<p>", "</p>", "<b>", "</b>", "<article>", "</article>", "<main", "<script>", "</script", "<title>", "<br/>", "<form>",
         " class='ad'", " id=\"x", '"', "'", "=", "/", " hidden", "text", " ", "\n", "\0", "é", "<span class=nav>", "</span>", "<td>", "</div>"]
    ),
    max_size=60,
)


@settings(max_examples=600, deadline=None)
@given(MARKUP)
def test_no_mark_up_raises(parts):
    for zone, line in page_lines("".join(parts)):
        assert line == " ".join(line.split()) and line and zone in range(4)


def test_hostile_pages_take_time_in_proportion():
    n = 40_000
    pages = [
        "<b>" * n + "</i>" * n, "<b>" * n + "</b>" * n, "<b><div>" + "<i>" * n + "</b>" * n, "<!--" * n, "<div class=ad>" * n + "x",
        "<article><div class=ad>" * (n // 4) + "x" * 9, "<a x='" * n + ">", '<a x="' * n, "<" * n, "</" * n, "&" * n, "<a " * n, "<a" + " " * n,
        "<p>" * n, "<script>" * n, "<![" * n, "<a b=" * n, "<title>" * n, "<div><p>" * n + "</div>" * n,
    ]
    for page in pages:
        begin = time.perf_counter()
        page_lines(page)
        assert time.perf_counter() - begin < 2, page[:40]


def test_unclosed_parts():
    assert page_lines("a<![foo[x]]>b<!-- c") == [(FREE, "ab")]
    assert text("<p>one</p><!-->two<!--->three<!-- x -->four") == "one\ntwothreefour"
    assert text("<article><b>story</article>") == "story"
    assert text("<b><article><p>one</b> two</article>") == "one two"
    assert text("<p class=\"a>one<p>two") == "one\ntwo"
    assert text("<script>var a = '<p>x</p>';</SCRIPT >after<script>never closed<p>x") == "after"


def test_mark_up():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
    <article><header><h1>Title &amp; more</h1></header><p>One <b>bold</b>
      and&nbsp;two<br>three<p>unclosed <i>para<div class="ad">Buy</div><ul><li>a<li>b</ul>
      <form><input><button>Send</button></form><section id="comments"><p>First!</p></section>&copy 3 &lt; 4</article>
    <aside>Side</aside><footer>&copy; site</footer>"""
    assert text(page) == "Title & more\nOne bold and two three\nunclosed para\na\nb\n© 3 < 4"
    assert text(None) == text("") == text("<nav>x</nav>") == ""
    assert text("plain &am text") == "plain &am text"


def test_shared_lines_go_where_mark_up_is_silent():
    page = lambda body: f"<div>Site name</div><div>Home</div><div>{body}</div><div>Imprint</div>"
    one, two = page("first<p>story one"), page("second<p>story two<p>more")
    assert text(one, two) == "first\nstory one"
    assert text(two, one) == "second\nstory two\nmore"
    assert text(one) == "Site name\nHome\nfirst\nstory one\nImprint"
    assert text(one, one) == text(one)
    same = "<article><p>shared story</article>"
    assert text(same, same + "<p>x") == "shared story"


CASES = [
    (1, "http://a.org/x/1", "<div>Top</div><div>one</div><div>End</div>"), (2, "http://a.org/x/2", "<div>Top</div><div>two</div><div>End</div>"),
    (3, "http://a.org/y", "<div>Top</div><div>three</div>"), (4, "http://b.org/", "<div>Top</div><div>four</div>"),
    (5, None, "<p>no address"), (6, None, "<p>no address"), (7, "http://[bad", "<p>bad"), (8, "http://a.org/z", None), (9, "http://a.org/zz", ""),
    (None, "http://c.org/1", "<div>T</div><p>c1"), (10, "http://c.org/2", "<div>T</div><p>c2"), (10, "http://c.org/2", "<div>T</div><p>c2"),
    (11, "http://long.org/1", "<div>same</div>" + "<p>word" * 20_000), (12, "http://long.org/2", "<div>same</div><p>" + "x " * 200_000),
]


def test_operator(spark, sf_dir):
    schema = "page_id long, url string, html string, host string, rank int"
    pages = spark.createDataFrame([(*r, "h", 1) for r in CASES], schema)
    got = sorted((tuple(r) for r in extract_text(pages).collect()), key=str)
    page = {n: html for n, (_, _, html) in enumerate(CASES)}
    beside = {0: (1,), 1: (0, 2), 2: (1, 7), 7: (2, 8), 8: (7,), 9: (10,), 10: (9,), 11: (9,), 12: (13,), 13: (12,)}
    want = []
    for n, (i, url, source) in enumerate(CASES):
        out = text(source, *[page[k] for k in beside.get(n, ())])
        want.append((i, url, out, len(out)))
    assert sorted((r[:4] for r in got), key=str) == sorted(want, key=str)
    assert all(sum(r[4:]) == len(page_lines(dict(zip([c[0] for c in CASES], page.values()))[r[0]])) for r in got if r[0])
    assert extract_text(pages.limit(0)).count() == 0


def test_articles_of_the_table_are_whole(spark, sf_dir):
    """The pages of the table have one article each, without anything foreign in it."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in extract_text(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", article)
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks)
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def test_hints_drop_no_article():
    wrapped = "<div class='{}'><p>Menu</p><article><h1>Title</h1><p>Story</p></article></div>"
    for name in ("has-sidebar", "no-sidebar", "content sidebar", "widget"):
        assert text(wrapped.format(name)) == "Title\nStory"
    assert text("<form><main><p>Story</p></main><input></form>") == "Story"
    parts = "<article><p>a</p><h2 id='related-work'>Related work</h2><p>b</p><h2 id='social-effects'>Effects</h2>{}</article>"
    assert text(parts.format("<section id='discussion'><p>c</p></section>")) == "a\nRelated work\nb\nEffects\nc"
    assert text(parts.format("<div class='related'><p>c</p></div>")) == "a\nRelated work\nb\nEffects"
    cards = "<div class='related'><article class='card'>Card</article></div>"
    assert text(cards + wrapped.format("has-sidebar")) == "Title\nStory"
    assert text("<article class='post has-comments'>Story</article><article class='comment'>First!</article>") == "Story"


def test_zone_with_most_unshared_text():
    card = "<article class='card'><p>Read this too</p></article>"
    assert text(f"<main><p>A long story told in the main part</p>{card}</main>") == "A long story told in the main part"
    assert text(f"<div><p>A long story told in a plain part</p></div>{card}") == "A long story told in a plain part"
    page = lambda n: f"<div>A site with a very long name and motto</div><article><p>Our notice</p><h1>T{n}</h1><p>s{n}</p></article>"
    assert text(page(1), page(2), page(3), site=["Our notice"]) == "T1\ns1"
    assert text(page(1), page(2), page(3)) == "Our notice\nT1\ns1"
    main = lambda n: f"<main><p>Our notice</p><h1>T{n}</h1><p>s{n}</p></main>"
    assert text(main(1), main(2), main(3), site=["Our notice"]) == "T1\ns1"


def test_notice_in_every_article(spark):
    page = "<nav>story 2</nav><article><p>Our notice</p><h1>T{0}</h1><p>story {0}</p></article>"
    rows = [(n, f"http://a.org/{n}", page.format(n)) for n in range(4)] + [(9, "http://b.org/9", page.format(9))]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {n: f"T{n}\nstory {n}" for n in range(4)} | {9: "Our notice\nT9\nstory 9"}


def test_copies_are_told_by_undecided_lines(spark):
    nav = "<nav>" + "".join(f"<p>entry {n}</p>" for n in range(40)) + "</nav>"
    page = lambda n: f"{nav}<div>Top</div><div>Home</div><p>title {n}<p>story {n}<div>End</div>"
    at = {1: 1, 2: 2, 3: 2, 4: 2, 5: 2, 6: 3}
    rows = [(i, f"http://a.org/{i}", page(n)) for i, n in at.items()] + [(7, "http://b.org/1", page(2)), (8, "http://b.org/2", page(2))]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    alone = "Top\nHome\ntitle 2\nstory 2\nEnd"
    assert got == {i: f"title {n}\nstory {n}" for i, n in at.items()} | {7: alone, 8: alone}


def plain(pages, share=0.9):
    """Main texts of pages given as (host, lines (zone, line)), ordered by URL, all lines of a page different."""
    out = []
    for at, (host, lines) in enumerate(pages):
        mine = [p for p in pages if p[0] == host]
        near = [p[1] for p in pages[max(0, at - 1) : at + 2] if p[0] == host and p[1] is not lines]
        k = next(i for i, p in enumerate(mine) if p[1] is lines)
        if len(near) < 2 and len(mine) > 2:
            near.append(mine[2 if k == 0 else -3][1])
        having = lambda x: sum((ARTICLE, x) in p[1] for p in mine)
        left = {ARTICLE: [], FREE: []}
        for zone, x in lines:
            met = any(x in {y for _, y in n} for n in near)
            site = len(mine) > 2 and having(x) > 2 and having(x) >= share * len(mine)
            if zone != OUT and not (met and (zone == FREE or site)):
                left[zone].append(x)
        best = max(left, key=lambda z: sum(map(len, left[z])))
        out.append("\n".join(left[best]))
    return out


def test_operator_against_plain_pages(spark):
    rng = random.Random(8)
    pages, rows = [], []
    for host in ("a.org", "b.org", "c.org", "d.org"):
        size = {"a.org": 12, "b.org": 2, "c.org": 1, "d.org": 5}[host]
        template = [(FREE, f"{host} name"), (OUT, f"{host} menu"), (OUT, f"{host} imprint")]
        for k in range(size):
            body = [(FREE if host == "d.org" else ARTICLE, f"{host} {k} sentence {j} {rng.random()}") for j in range(rng.randint(1, 4))]
            if host == "a.org":
                body += [(ARTICLE, "Summary")] * (k % 3 > 0) + [(ARTICLE, "Subscribe now")] * (k != 3)
            lines = template[:1] + [(FREE, f"teaser {k // 2}")] + template[1:2] + body + template[2:] + [(OUT, f"advert {rng.random()}")]
            pages.append((host, lines))
    tag = {FREE: "<div>{}</div>", OUT: "<nav>{}</nav>", ARTICLE: "<article>{}</article>"}
    for n, (host, lines) in enumerate(pages):
        rows.append((n, f"http://{host}/{n:03}", "".join(tag[z].format(x) for z, x in lines)))
    rng.shuffle(rows)
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert got == dict(enumerate(plain(pages)))
    assert "Summary" in got[1] and not any("Subscribe" in t for t in got.values())


def test_no_article_paragraph_of_the_larger_table_is_lost(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("url like '%tiontion%'")
    got = {r.page_id: r.text for r in extract_text(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert got[r.page_id] == "\n".join(b for b in blocks if b)
