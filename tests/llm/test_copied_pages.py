"""Copies of a page are no template."""

from spanloom.llm.op02_html import main_text

PAGE = "<html><body><div id='top'><a href='/'>Home</a></div><div class='text'><p>{0} story about number {0} and more words here.</p></div></body></html>"


def texts(spark, rows):
    pages = spark.createDataFrame([(i, f"http://c.example/{i}", page) for i, page in enumerate(rows)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in main_text(pages).collect()}


def test_host_of_copies_only(spark):
    rows = texts(spark, [PAGE.format(1)] * 4)
    assert len(rows) == 4 and all("1 story about number 1 and more words here." in t for t in rows.values())


def test_host_with_a_third_of_copies(spark):
    copy = PAGE.format("A").replace("<p>", "<p class='own'>")
    rows = texts(spark, [PAGE.format(i) for i in range(8)] + [copy] * 4)
    assert [rows[i] for i in range(8)] == [f"{i} story about number {i} and more words here." for i in range(8)]
    assert {rows[i] for i in range(8, 12)} == {"A story about number A and more words here."}
