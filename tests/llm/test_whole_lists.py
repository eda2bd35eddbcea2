"""op7 keeps lists and containers made of links inside the article."""

from marketflow.llm.wrapper import extract


def test_reference_lists_stay(spark):
    rows = [(i, f"https://site.example/{i}", f'''<html><body><div><a href="/x">Home {i}</a></div><article><h1>Title {i}</h1><p>Body {i}</p>
             <ul><li><a href="/s">Source {i}</a></li></ul><div><p><a href="/l">Linked words {i}</a></p></div></article></body></html>''') for i in range(5)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Title 3\n\nBody 3\n\nSource 3\n\nLinked words 3"
