"""op7 on layouts whose class names, ids and nesting are unlike the given pages'."""

import pytest

from marketflow.llm.html_text import Node, blocks, drop_roles, parse
from marketflow.llm.wrapper import extract, skeleton_key

FURNITURE = '<div class="site-header">The site</div><nav>Home News</nav>'
END = '<div class="sidebar">Latest {i} things</div><footer>About us</footer>'


def texts(spark, bodies):
    rows = [(i, f"https://site.example/{i}", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)]
    return {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


@pytest.mark.parametrize("open_, close", [
    ('<main class="layout has-sidebar">', "</main>"), ('<article class="post comments-open">', "</article>"),
    ('<div class="page no-comments"><main id="content">', "</main></div>"), ('<div class="widget"><main>', "</main></div>"),
    ('<div class="banner"><article class="notice">', "</article></div>")])
def test_modifier_classes_and_wrappers_keep_the_article(spark, open_, close):
    got = texts(spark, [f"{FURNITURE}{open_}<h1>Title {i}</h1><p>Body {i} of the page</p>{close}{END.format(i=i)}" for i in range(5)])
    assert got == {i: f"Title {i}\n\nBody {i} of the page" for i in range(5)}


def test_ids_of_headings_and_sections_are_anchors(spark):
    def body(i):
        return (f'{FURNITURE}<article><h1>Title {i}</h1><h2 id="search">Search {i}</h2><p id="related">Related {i}</p><h2 id="notice">Notice {i}</h2>'
                f'<section id="comment"><p>On comment {i}</p></section><div class="alert-levels">Levels {i}</div>'
                f'<p>Euler: <math><mi>e</mi></math> and <label>a label {i}</label></p></article>{END.format(i=i)}')
    got = texts(spark, [body(i) for i in range(5)])
    assert got[2] == "Title 2\n\nSearch 2\n\nRelated 2\n\nNotice 2\n\nOn comment 2\n\nLevels 2\n\nEuler: e and a label 2"


def test_comments_adverts_and_forms_inside_the_article_go(spark):
    def body(i):
        talk = "".join(f'<article class="reply"><p>Reader {i} {k} says much more than the page does</p></article>' for k in range(9))
        return (f'<article><h1>Title {i}</h1><p>Body {i}</p><div class="ad">Buy {i}</div><form>Mail {i} <label>x</label></form>'
                f'<section id="comments">{talk}</section></article>')
    got = texts(spark, [body(i) for i in range(5)])
    assert got[4] == "Title 4\n\nBody 4"


def test_layout_of_divs_alone(spark):
    def body(i):
        return (f'<div id="top"><div class="logo">Site</div><div class="search">Find {i}</div></div><div id="wrap"><div class="entry"><h1>Title {i}</h1>'
                f'<div class="body"><p>Body {i}</p><p>More {i}</p></div><div class="legal">All rights reserved</div></div></div><div class="footer">Contact</div>')
    got = texts(spark, [body(i) for i in range(5)])
    assert got[1] == "Title 1\n\nBody 1\n\nMore 1"


def test_slug_ids_and_numbers_share_a_skeleton(spark):
    page = '<body><article id="post-{i}" class="post post-{i}"><h2 id="history-of-{w}">History {i}</h2><p>Body {i}</p></article></body>'
    assert len({skeleton_key(page.format(i=i, w=w)) for i, w in enumerate(("salt", "iron", "tea"))}) == 1


def test_deep_pages_lose_the_same_furniture(spark):
    deep = "<div>" * 3000 + "<p>Deep text</p>" + "</div>" * 3000
    root = drop_roles(parse(f"<html><body><header>The site</header><main>{deep}</main></body></html>"))
    assert blocks(root, lambda n: isinstance(n, Node)) == ["Deep text"]
    got = texts(spark, [f"<header>The site {i}</header><main><h1>Title {i}</h1>{deep}</main>" for i in range(4)])
    assert got[0] == "Title 0\n\nDeep text"
