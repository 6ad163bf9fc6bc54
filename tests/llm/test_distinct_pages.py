"""Distinct pages pass one shuffle; they are not written as well, and tokens carry what a host's pages are counted by."""

from spanloom.llm import op02_html

PAGE = "<html><body><div id='top'><a href='/'>Home</a></div><div class='text'><p>{0} story about number {0}.</p></div></body></html>"


def test_only_tokens_and_templates_are_written(spark, monkeypatch):
    labels, write = [], op02_html.written
    monkeypatch.setattr(op02_html, "written", lambda df, label, *by: labels.append((label, set(df.columns))) or write(df, label, *by))
    pages = spark.createDataFrame([(i, f"http://{'ab'[i % 2]}.example/{i}", PAGE.format(i // 4)) for i in range(40)], "page_id long, url string, html string")
    assert op02_html.main_text(pages).count() == 40
    assert labels and not any("html" in columns for _, columns in labels)


def test_pages_of_a_host_are_counted(spark):
    pages = spark.createDataFrame([(1, "a", PAGE.format(1)), (2, "a", PAGE.format(2)), (3, "b", None), (4, "", "x")], "page_id long, host string, html string")
    rows = op02_html.token_counts(pages).where("token IS NULL").collect()
    assert {r.host: r.pages for r in rows} == {"a": 2, "b": 1, "": 1} and all(r.path is None for r in rows)
