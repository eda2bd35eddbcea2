"""op7 keeps link lists of the article, ledes beside the longest container, and blocks that one page repeats."""

from marketflow.llm.wrapper import extract


def texts(spark, bodies):
    rows = [(i, f"https://site.example/{i}", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)]
    return {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_link_lists_stay_without_article(spark):
    def body(i, tag):
        return (f'<div><a href="/x">Home {i}</a></div><{tag}><h1>Title {i}</h1><p>Body {i}</p>'
                f'<ul><li><a href="/s">Source {i}</a></li></ul><div><p><a href="/l">Linked words {i}</a></p></div></{tag}>')
    got = texts(spark, [body(i, "section") for i in range(5)])
    assert got[3] == "Title 3\n\nBody 3\n\nSource 3\n\nLinked words 3"


def test_lede_beside_the_long_container_stays(spark):
    for tag in ("main", "section"):
        got = texts(spark, [f"<{tag}><h1>Title {i}</h1><p>Lede {i}</p><div class=body><p>{f'long {i} ' * 200}</p></div></{tag}>" for i in range(5)])
        assert got[2].startswith("Title 2\n\nLede 2\n\nlong 2")


def test_block_of_one_page_in_three_copies_stays(spark):
    rows = ["<main><h1>Title 0</h1><p>Body 0</p><div class=appendix>The appendix</div></main>"]
    bodies = [f"<main><h1>Title {i}</h1><p>Body {i}</p></main>" for i in range(1, 5)] + rows * 3
    got = texts(spark, bodies)
    assert got[4] == got[5] == got[6] == "Title 0\n\nBody 0\n\nThe appendix" and got[0] == "Title 1\n\nBody 1"
