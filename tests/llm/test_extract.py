"""Main text of pages: the driver's pages against their article element, and cases."""

import html
import re
import time

import pytest

from ibidem.llm import extract as X


def test_query(spark, tables):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{tables}/pages.parquet").collect()}
    found = X.op8(spark, tables).collect()
    assert len(found) == len(pages)
    for r in found:
        body = re.search(r"(?s)<article>(.*)</article>", pages[r.page_id])[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)[^>]*>", body)]
        assert r.text == "\n\n".join(filter(None, blocks)) and r.n_chars == len(r.text)


LONG = "A sentence of an article with a good many words in it, so that it is dense. " * 3
OTHER = "Another paragraph with &amp; references, <b>bold</b> words and <a href='x'>a link</a> in its midst. " * 3


@pytest.mark.parametrize("page", [
    f"<body><nav><a href=a>Menu</a></nav><div class='content'><h1>Title</h1><p>{LONG}</p><p>{OTHER}</p></div><div class='sidebar'><p>{LONG}</p></div><footer>Foot</footer></body>",
    f"<html><body><header>Site</header><main><div id=ad-1>Buy</div><article><h1>Title</h1><p>{LONG}<p>{OTHER}</article></main><section id='comments'><p>{LONG}</p></section>",
    f"<body><form><p>Sign up</p><input></form><div><div><h1>Title</h1><p>{LONG}</p><div class=\"cookie-notice\">{LONG}</div><p>{OTHER}</p><script>if (a < b) {{ '</p>' }}</script></div></div><ul><li><a href=1>one</a><li><a href=2>two</a></ul></body>",
    f"<body><article><h1>Title</h1>\n\n<p hidden>{LONG}</p><!-- <p>no</p> --><p>{LONG}</p><div role=\"navigation\"><a>x</a></div><p>{OTHER}</p></article>",
])
def test_cases(page):
    other = re.sub(r"<[^>]+>", "", OTHER).replace("&amp;", "&").strip()
    assert X.main_text(page) == f"Title\n\n{LONG.strip()}\n\n{other}"


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("plain", "plain"), ("<p>one", "one"), ("</div></p><div><div>", ""), ("<p>a&nbsp;b&#x41;&eacute;</p>", "a bAé"), ("<" * 50, "<" * 50), ("<p>a<br>b</p>", "a b")])
def test_odd(page, text):
    assert X.main_text(page) == text


def test_edges(spark):
    deep = "<div>" * 5000 + "deep text" + "</div>" * 5000
    rows = [(1, None), (2, ""), (3, deep), (3, deep), (None, "<p>x</p>"), (4, f"<p>{'word ' * 50_000}</p>")]
    pages = spark.createDataFrame([(k, "u", h, "old", 5) for k, h in rows], "page_id long, url string, html string, text string, extra int")
    found = [(r.page_id, r.n_chars) for r in X.extracted(pages).collect()]
    assert sorted(found, key=str) == sorted([(1, 0), (2, 0), (3, 9), (3, 9), (None, 1), (4, 249_999)], key=str)
    assert X.extracted(pages.limit(0)).count() == 0


INNER = f"<nav><a href=a>Menu</a></nav><div class='text'><h1>Title</h1><p>{LONG}</p><p>{OTHER}</p></div><div class='sidebar-widget'><p>{LONG}</p></div>"
ARTICLE = f"<article><h1>Title</h1><p>{LONG}</p><p>{OTHER}</p></article>"


@pytest.mark.parametrize("page", [
    f"<body><form action=x><input type=hidden>{INNER}</form></body>",
    f"<body><div class='overflow-hidden'><div class='content-sidebar-wrap'>{INNER}</div></div><footer>Foot</footer></body>",
    f"<body><div class='layout has-sidebar'><div class='search'>{INNER}</div></div></body>",
    f"<body><div class='sidebar'>{ARTICLE}</div><div class='comments'><article class='comment-body'><p>{LONG * 5}</p></article></div></body>",
    f"<body><div id=text><h1>Title</h1><p class='lg:overflow-hidden'>{LONG}</p><p>{OTHER}</p></div><div class='comments'><p>{LONG * 5}</p></div><div class='cookie-notice'>{LONG * 4}</div></body>",
])
def test_wrappers_with_such_names(page):
    test_cases(page)


@pytest.mark.parametrize(("page", "text"), [
    (f"<body><div><p class='ad-hoc'>{LONG}</p><p>{LONG}</p></div></body>", [LONG, LONG]),
    (f"<body><nav>Menu</nav><section class='chess-promotion-rules'><h2>Rules</h2><p>{LONG}</p><p>{LONG}</p></section></body>", ["Rules", LONG, LONG]),
    (f"<body><header>Site</header><article><header><h1>Title</h1></header><p>{LONG}</p><table class='share'><tr><td>Shares</td><td>12 %</td></tr></table></article></body>", ["Title", LONG, "Shares", "12 %"]),
    (f"<body><article><p>{LONG}</p><ol><li><a href=1>Smith, J., On the growth of trees, 2001</a></li><li><a href=2>Jones, K., A reply to Smith and others, 2003</a></li><li><a href=3>Brown, T., Trees revisited, in two parts, 2005</a></li></ol></article></body>", [LONG, "Smith, J., On the growth of trees, 2001", "Jones, K., A reply to Smith and others, 2003", "Brown, T., Trees revisited, in two parts, 2005"]),
    (f"<body><article><h1>One</h1><p>{LONG}</p><p>{LONG}</p></article><article><h2>Other</h2><p>Read on.</p></article></body>", ["One", LONG, LONG]),
    (f"<body><h1>Title</h1><div><p>{LONG}</p><p>{LONG}</p><p>Short end.</p></div><div><a href=1>A</a> <a href=2>B</a></div><div>Imprint</div></body>", ["Title", LONG, LONG, "Short end."]),
    (f"<body><p title='hidden'>{LONG}</p></body>", [LONG]),
    (f"<body><div><p>{LONG}</p><p>{LONG}</p><ul><li><a href=1>Home</a><li><a href=2>News</a><li><a href=3>Shop</a></ul></div></body>", [LONG, LONG]),
])
def test_by_density(page, text):
    assert X.main_text(page) == "\n\n".join(x.strip() for x in text)


def test_without_hints(spark, tables):
    """Without article elements, class names and elements for menus and footers, densities find the same text on most pages."""
    right = total = 0
    for r in spark.read.parquet(f"{tables}/pages.parquet").collect():
        bare = re.sub(r"(</?)(?:nav|footer|article)>", r"\1div>", r.html).replace(' class="ad"', "")
        total += 1
        right += X.main_text(bare) == X.main_text(r.html)
    assert right >= 0.9 * total


@pytest.mark.parametrize("piece", ["<p title=\"x>a ", "<div>", "<div></span>", "<a '", "<a '\"'>", "<a \">\" ", "<body><p>x", "<", "<article><div class=comments>", "<!--", "<a href=x>", "</p>", "<li>x"])
def test_long_and_wrong(piece):
    """Time grows in proportion: a page of a megabyte of anything takes seconds."""
    began = time.process_time()
    X.main_text(piece * (1_000_000 // len(piece)))
    assert time.process_time() - began < 20


@pytest.mark.parametrize(("piece", "kept"), [
    ("<p>Energy <math><mi>E</mi><mo>=</mo><mi>m</mi></math> holds.</p>", "Energy E=m holds."),
    ("<p><label>Figure 1</label> of it</p>", "Figure 1 of it"),
    ("<p>see <object data=x>the fallback</object> here</p>", "see the fallback here"),
    (f"<section id='banner'><p>{LONG}</p></section>", LONG.strip()),
    ("<ul><li><a href=1>One</a></li><li><a href=2>Two</a></li><li><a href=3>Three</a></li></ul>", "One\n\nTwo\n\nThree"),
    ("<div id='banner'>Buy now</div>", ""),
    (f"<div class='advert'><p>{LONG}</p></div>", ""),
    ("<form><label>Name</label><input></form>", ""),
])
def test_within_an_article(piece, kept):
    page = f"<body><nav><a href=a>Menu</a></nav><article><p>{LONG}</p>{piece}<p>{LONG}</p></article></body>"
    assert X.main_text(page) == "\n\n".join(filter(None, [LONG.strip(), kept, LONG.strip()]))


@pytest.mark.parametrize("n", [900, 1100, 50_000])
def test_many_attributes(n):
    attributes = " ".join(f'a{i}="x>{i}"' for i in range(n))
    assert X.main_text(f'<body><p {attributes} z="not end" b="z">{LONG}</p></body>') == LONG.strip()


def densities(node):
    """(characters, tags, those in links) of a tree of (name, children), and a list of its nodes' names, densities and density
    sums in page order, as functions of the body's share of link characters: the published formula, by recursion."""
    import math

    name, children = node
    chars = tags = link_chars = link_tags = 0
    below, direct = [], []
    for x in children:
        if isinstance(x, str):
            chars += len(" ".join(x.split()))
            direct.append((len(" ".join(x.split())), 0, len(" ".join(x.split())) if name == "a" else 0, 0))
        else:
            c, t, lc, lt, more = densities(x)
            chars, tags, link_chars, link_tags = chars + c, tags + t + 1, link_chars + lc, link_tags + lt + (x[0] == "a")
            below.append(more)
            direct.append((c, t, lc, lt))
    if name == "a":
        link_chars = chars

    def density(counts, share):
        c, t, lc, lt = counts
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        return c / max(t, 1) * math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1)) / math.log(max(base, 1.1))

    own = (name, lambda share: density((chars, tags, link_chars, link_tags), share), lambda share: sum(density(x, share) for x in direct))
    return chars, tags, link_chars, link_tags, [own, *(x for more in below for x in more)]


def test_densities_a_second_way(spark, tables):
    from html.parser import HTMLParser

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=False)
            self.top = ("html", [])
            self.path = [self.top]

        def handle_starttag(self, tag, attrs):
            node = (tag, [])
            self.path[-1][1].append(node)
            if tag not in ("br", "hr", "img"):
                self.path.append(node)

        def handle_endtag(self, tag):
            while self.path.pop()[0] != tag:
                pass

        def handle_data(self, data):
            self.path[-1][1].append(data)

    n = 0
    for r in spark.read.parquet(f"{tables}/pages.parquet").collect():
        article = re.sub(r"(?s)<!--.*?-->|&[^;]*;", "", re.search(r"(?s)<article>(.*)</article>", r.html)[1])
        blocks = [re.sub(r"</?p>", "", x).replace("<b>", "<em>x</em> ").replace("</b>", "") for x in re.split(r"(?<=</p>)", article)]
        body = f"<body><div><a href=x>one</a><p>{LONG}<a href=y>two words</a></p></div><div>{''.join(f'<p>{x}</p>' for x in blocks if 'h1' not in x)}</div></body>"
        tree = Tree()
        tree.feed(body)
        chars, _, link_chars, _, want = densities(tree.top[1][0])
        got = [x for x in X.weigh(X.parse(body)) if x.name != "html"]
        assert [x.name for x in got] == [x[0] for x in want]
        for x, (_, density, total) in zip(got, want, strict=True):
            assert x.density == pytest.approx(density(link_chars / chars)) and x.total == pytest.approx(total(link_chars / chars))
        n += 1
    assert n > 5
