from __future__ import annotations

import random
import time
from html.parser import HTMLParser

import pytest
from conftest import SF
from vigil.llm import html

PAGE = "page_id long, url string, html string, text string, shared int"


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], PAGE)


def _texts(spark, rows):
    return {r.page_id: r.text for r in html.main_text(_pages(spark, rows)).collect()}


class Article(HTMLParser):
    """Another reader: the blocks of the article element of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.blocks.append("") if tag in ("p", "h1") else None
        self.handle_data(" ") if tag == "br" else None

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.blocks.append("") if tag in ("p", "h1") else None

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data

    @classmethod
    def text(cls, page: str) -> str:
        reader = cls()
        reader.feed(page)
        reader.close()
        return "\n\n".join(b for b in (" ".join(x.split()) for x in reader.blocks) if b)


def test_articles_of_the_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    expected = {r.page_id: Article.text(r.html) for r in pages.collect()}
    found = html.main_text(pages).collect()
    assert {r.page_id: r.text for r in found} == expected
    assert all(r.n_chars == len(r.text) for r in found)


def _site(body: str, i: int) -> str:
    return f"<html><body><div>Site of all</div><p>Read more here</p>{body}<p>Call us {'daily'}</p><p>page {i}</p></body></html>"


def test_lines_of_neighbours_are_deleted(spark):
    rows = [(i, f"http://h/{'a' if i < 3 else 'b'}/{i}", _site(f"<p>story {i} begins</p><p>and story {i} ends with many more words</p>", i)) for i in range(6)]
    rows.append((9, "http://other/a/1", _site("<p>alone on its host</p>", 9)))
    found = _texts(spark, rows)
    for i in range(6):
        assert found[i] == f"story {i} begins\n\nand story {i} ends with many more words\n\npage {i}"
    assert found[9].startswith("Site of all\n\nRead more")


def test_copies_are_not_emptied(spark):
    same = _site("<p>one article that two addresses have, longer than the furniture</p>", 1)
    found = _texts(spark, [(1, "http://h/a", same), (2, "http://h/b", same), (3, "http://h/b", same)])
    assert len(set(found.values())) == 1 and "one article" in found[1]


def test_articles_are_never_deleted(spark):
    page = "<nav>menu</nav><article><h1>T</h1><p>mirrored</p></article>"
    assert _texts(spark, [(1, "http://h/a", page), (2, "http://h/b", page)]) == {1: "T\n\nmirrored", 2: "T\n\nmirrored"}


def test_furniture_by_markup():
    page = (
        '<html><body class="has-sidebar"><header><h1>Site</h1></header><div id="cookie-notice">We use cookies</div><div class="content">'
        "<h2>Title &amp; more</h2><p>One<br>two&nbsp;&#32;three<p>Four <b>bold</b> x<!-- no --></div>"
        '<div class="comments"><article><p>first!</article></div><ul class="menu"><li>a<li>b</ul><form><p>in</form><script>var a="</p>";</script>'
        "<style>p{}</style><aside>s</aside><footer>f</footer>"
    )
    assert [line.text for line in html.lines(page) if not line.furniture] == ["Title & more", "One two three", "Four bold x"]
    page = (
        '<main><div class="layout sidebar-right"><article><header><h1>T</h1><p>by x</p></header><p class="ad">buy<p>Body</p>'
        '<aside>side</aside><section id="comments"><p>c</p></section></article></div></main><p>out'
    )
    assert [line.text for line in html.lines(page) if line.inside] == ["T", "Body"]


def _kept(page: str) -> list[str]:
    return [line.text for line in html.lines(page) if not line.furniture]


def test_names_that_only_mention_furniture():
    for name in ('class="layout has-sidebar"', 'class="content ad-free"', 'id="search-article"', 'class="no-comments with-footer"', "class=comments-open"):
        assert _kept(f"<div {name}><p>text</div>") == ["text"] == _kept(f"<article {name}><p>text</article>"), name
    for name in ('class="site-header"', 'class="x ad"', 'id="cookie-notice"', 'class="ad-slot"', "class=share-buttons", 'class="comments-area"', 'id="comment-42"'):
        assert _kept(f"<div {name}><p>other</div><p>text") == ["text"], name
    assert _kept('<div class="menu"><main><p>text</main></div>') == ["text"]
    assert _kept("<nav><main><p>text</main></nav>") == []


def test_text_beside_teasers(spark):
    teasers = "<article><p>teaser one</article><article><p>teaser two</article>"
    page = lambda i: f"<div>Site of all</div><nav>menu</nav>{teasers}<div><p>story {i} is told in a line longer than the cards beside it</div>"
    found = _texts(spark, [(i, f"http://h/{i}", page(i)) for i in range(3)])
    for i in range(3):
        assert found[i].endswith(f"story {i} is told in a line longer than the cards beside it")
        assert "Site of all" not in found[i] and "menu" not in found[i]
    inside = "<main><article><p>card</article><p>the text of the page</main><div>out</div>"
    assert _kept(inside) == ["card", "the text of the page"]


def test_broken_markup():
    for page in ["<", "<p", "a < b", "<p title='x>y'>z", "<!-- open", "<script>x", "</p></div>t", "<p>" * 3000 + "x", "&", "&#xD800;", "<article><p>a"]:
        html.lines(page)
    assert [line.text for line in html.lines("a < b <p title='x>y'>z")] == ["a < b", "z"]


def test_longest_common_subsequence():
    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row, last = [0], row
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
        return row[-1]

    rng = random.Random(2)
    for _ in range(2000):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 12))] for _ in range(2))
        places = html.shared_lines(a, b)
        rest = iter(b)
        assert len(places) == length(a, b) and places == sorted(places) and all(a[i] in rest for i in places)


def test_awkward_rows(spark):
    rows = [(1, None, None), (2, "http://h/x", ""), (None, "http://h/y", "<p>a"), (4, "no url", "<article>" + "<p>word " * 20_000), (5, "http://h/x", ""), (5, "http://h/x", "")]
    found = html.main_text(_pages(spark, rows)).collect()
    assert len(found) == 6
    by = {r.page_id: r for r in found}
    assert by[1].text == by[2].text == "" and by[1].n_chars == 0 and by[None].text == "a" and by[4].n_chars == 20_000 * 6 - 2


def test_no_rows(spark):
    assert html.main_text(_pages(spark, [])).collect() == []


@pytest.mark.parametrize(
    "page",
    [
        "<p>text</p><div " + " ".join(f'a{i}="x{i}"' for i in range(200)), "<div>x" * 100_000, "<article><nav>x" * 20_000,
        "<p a='\"" * 20_000, '<a b="' * 50_000, "<div></p>" * 50_000, "<" * 100_000,
    ],
)
def test_no_page_takes_long(page):
    started = time.process_time()
    html.lines(page)
    assert time.process_time() - started < 5


def test_a_tag_cut_off_ends_the_page():
    assert [line.text for line in html.lines('<p>one</p><p>two <a href="x" title="y')] == ["one", "two"]
    assert [line.text for line in html.lines('<p title="a>b">one</p><p title=\'c"d\'>two</p>')] == ["one", "two"]
