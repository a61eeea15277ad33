"""Sections and tables of Markdown and HTML as rows."""

from tessera.sources import structure as T


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_markdown_sections(spark):
    text = "intro\n\n### Deep first\na\n# Top\nb\n\n### Third\n```\n# no\n```\n## Second ##\n\n#no heading\n"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "# only\r\nx\r\n")], "doc_id long, text string")
    got = rows(T.markdown_sections(docs), "doc_id", "section", "level", "title", "path", "text")
    assert got == [
        (1, 0, 0, None, [], "intro"),
        (1, 1, 3, "Deep first", ["Deep first"], "a"),
        (1, 2, 1, "Top", ["Top"], "b"),
        (1, 3, 3, "Third", ["Top", "Third"], "```\n# no\n```"),
        (1, 4, 2, "Second ##", ["Top", "Second ##"], "#no heading"),
        (4, 1, 1, "only", ["only"], "x"),
    ]


def test_markdown_tables(spark):
    text = "| a | b |\n|---|:-:|\n| 1 | x \\| y |\n|  | |\n\n| no | table |\n\n```\n| c |\n|---|\n```\n| d |\n|-|"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "| x |")], "doc_id long, text string")
    assert rows(T.markdown_tables(docs), "doc_id", "table_no", "row_no", "head", "cells") == [
        (1, 1, 0, True, ["a", "b"]), (1, 1, 1, False, ["1", "x | y"]), (1, 1, 2, False, ["", ""]), (1, 2, 0, True, ["d"])
    ]


def test_html_tables(spark):
    html = "a<TABLE><caption>no</caption><tr><th>h&amp;<td>1<tr><td>x<table><tr><td>in</table>y</td>between<td></td></table>b<table><thead><tr><td>t</td></tr></thead></table><!--<table><tr><td>-->"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<td>stray</td></table>"), (4, "")], "page_id long, html string")
    assert rows(T.html_tables(pages), "page_id", "table_no", "row_no", "cell_no", "head", "text") == [
        (1, 1, 1, 1, True, "h&"), (1, 1, 1, 2, False, "1"), (1, 1, 2, 1, False, "x in y"), (1, 1, 2, 2, False, ""), (1, 2, 1, 1, True, "t")
    ]


def test_html_sections_and_meta(spark):
    html = "<html><head><title>T &lt;</title><meta name='Author' content=\"me\"><META charset=utf-8><meta property=og:x content=y><meta name=author content=late></head><body>in<h2>A <b>b</b></h2><p>one</p>two<h1>C</h1><h4></h4>x</body></html>"
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    assert rows(T.html_sections(pages), "page_id", "section", "level", "title", "path", "text") == [
        (1, 0, 0, None, [], "in"), (1, 1, 2, "A b", ["A b"], "one two"), (1, 2, 1, "C", ["C"], ""), (1, 3, 4, "", ["C", ""], "x")
    ]
    assert rows(T.html_meta(pages), "page_id", "name", "content") == [(1, "author", "me"), (1, "charset", "utf-8"), (1, "og:x", "y"), (1, "title", "T <")]
