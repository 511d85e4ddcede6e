"""Main text where the style tree, names of elements and copies of pages meet."""

import pytest

from weftgraph.llm import html_extract


def extracted(spark, pages):
    rows = [(i, f"http://a.example/{i}", p) for i, p in enumerate(pages)]
    return {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_tree_decides_inside_articles(spark):
    pages = [f'<body><article><p>story {i} {i * 7} text</p><div class="author">Written by our staff</div></article></body>' for i in range(20)]
    assert extracted(spark, pages)[3] == "story 3 21 text"


def test_small_articles_are_not_the_page(spark):
    pages = [f'<body><div class="story"><p>{f"long story {i} " * 20}</p></div><article><p>card {i}</p></article></body>' for i in range(20)]
    assert "long story 3" in extracted(spark, pages)[3]


@pytest.mark.parametrize(
    "page",
    [
        '<body class="has-sidebar"><p>story</p></body>', '<body class="single-post comment-open"><p>story</p></body>', '<html class="sidebar"><body><p>story</p></body></html>', '<div class="layout no-sidebar"><p>story</p></div>',
        '<article class="post related-science"><p>story</p></article>', '<div class="sidebar-content-wrap"><p>story</p></div>', '<div class="widget"><main><p>story</p></main></div>', '<div class="notice"><p>story</p></div>',
        '<p>story</p><div class="site-footer">f</div><div class="cookie-notice">ok?</div><div id="comments">me too, and so on</div>', '<article>story</article><div class="sidebar"><article>card</article></div>',
    ],
)
def test_names_do_not_condemn_what_holds_the_main_text(page):
    assert html_extract.main_text(page) == "story"


def test_copies_of_a_page_do_not_hide_the_others(spark):
    body = lambda i: f'<body><div class="top">Acme News</div><div class="body"><p>story {i} {i * 7} text</p></div></body>'
    got = extracted(spark, [body(i if i < 30 else 5) for i in range(100)])
    assert got[3] == "story 3 21 text" and got[99] == got[5] == "story 5 35 text"
