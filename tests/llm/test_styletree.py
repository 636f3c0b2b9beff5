"""Main text: planted pages with names, hosts whose repeated parts have none, and every awkward row."""

import pytest

from marketloom.llm import styletree
from marketloom.llm.styletree import extract_text, read_page

SCHEMA = "page_id long, url string, html string, row string, host string, text string, nodes int, low int"


def text(page, url="http://a.example/x"):
    return "\n\n".join(read_page(page, url)[4])


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("<html><head><title>T</title><script>var a = '<p>no</p>';</script></head><body><nav>menu</nav><article><h1>A &amp; B</h1><p><b>One<br><p>two\n three&nbsp;x</article><footer>f</footer>", "A & B\n\nOne\n\ntwo three x"),
        ("<div class='layout has-sidebar'><p>kept</p><div class='sidebar'>gone</div><div id='cookieBanner'>gone</div></div>", "kept"),
        ("<article><header class='entry-header'><h1>Title</h1></header><p>body</p><div class='share-links'>gone</div><footer>gone</footer></article><section id='comments'><article class='comment'>gone</article></section>", "Title\n\nbody"),
        ("<h1>Title</h1><div>loose</div><article><p>body</p></article>", "Title\n\nbody"),
        ("<form id='all'><p>one</p><p>two</p></form>", "one\n\ntwo"),
        ("<form>gone</form><p>kept</p>", "kept"),
        ("<p>a <span class=ad>gone<p>b", "a\n\nb"),
        ("<p hidden>gone</p><p style='display: none'>gone</p><p aria-hidden='true'>gone</p><p title='a > b'>kept</p>", "kept"),
        ("<ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul><p>Text with <a href=x>a link</a>.</p>", "Text with a link."),
        ("<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>", "a b\n\nc"),
        ("<b><p>misnested</b> still</p> tail", "misnested still\n\ntail"),
        ("a < b and c > d <3 &lt;p&gt; <!-- gone <p> --> e <![CDATA[x]]> f <!-- unclosed <p>g", "a < b and c > d <3 <p> e f"),
        ("<script>never closed <p>x", ""),
        ("<p>attr <a title=\"x", "attr"),
        ("", ""), (None, ""), ("   \n ", ""), ("<p></p>", ""), ("plain", "plain"),
    ],
)
def test_page(page, expected):
    assert text(page) == expected


def test_malformed_markup_takes_linear_time():
    assert text("<a title='" * 30_000) is not None
    assert text("<p>x" * 30_000).count("x") == 30_000
    assert text("<div>" * 20_000 + "deep").endswith("deep")
    assert text("<b>" * 20_000 + "deep" + "</i>" * 20_000) == "deep"


def site(host, n, first=0):
    """Pages whose parts bear no names: a line on top that all share, an article of its own, a notice in it that all share."""
    body = lambda i: "".join(f"<p>own words {i} {k} {'lorem' * (i % 5 + 1)} {chr(97 + i % 26) * 30}</p>" for k in range(2 + i % 4))
    return [(first + i, f"https://{host}/p{i}", f"<div><p>Welcome to {host}</p></div><div>{body(i)}</div><div><p>All rights 20{i:02d}</p></div>") for i in range(n)]


def run(spark, rows):
    made = spark.createDataFrame([(*r, "r", "h", "t", 1, 2) for r in rows], SCHEMA)
    out = extract_text(made)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    found = {}
    for r in out.collect():
        assert r["n_chars"] == len(r["text"])
        found.setdefault(r["page_id"], []).append(r["text"])
    return found


def test_parts_that_a_host_repeats_go(spark):
    rows = site("a.example", 12)
    found = run(spark, [*rows, *site("b.example", 1, 100), (200, None, rows[0][2]), (201, "https://c.example/", None), (202, "::", ""), (None, "https://a.example/z", "<p>null id</p>")])
    for i in range(12):
        assert found[i][0].startswith(f"own words {i} 0") and "Welcome" not in found[i][0] and "rights" not in found[i][0]
        assert found[i][0].count("own words") == 2 + i % 4
    assert "Welcome" in found[100][0], "one page says nothing about its host"
    assert "Welcome" in found[200][0], "no url, no host"
    assert found[201] == [""] and found[202] == [""] and found[None] == ["null id"]


def test_copies_of_a_page_count_once(spark):
    page = "<article><h1>Head</h1><p>One text that many pages carry</p><p>and its end</p></article>"
    found = run(spark, [(i, f"https://a.example/{i}", page) for i in range(30)] + [(1, "https://a.example/1", page)])
    assert all(x == ["Head\n\nOne text that many pages carry\n\nand its end"] * (2 if i == 1 else 1) for i, x in found.items())


def test_a_notice_in_every_article_goes_and_a_shared_passage_stays(spark):
    rows = []
    for i in range(20):
        shared = "<p>a passage that a few articles share</p>" if i < 6 else f"<p>own passage {chr(97 + i) * 12}</p>"
        rows.append((i, f"https://a.example/{i}", f"<article><div><p>Read our paper daily</p></div><p>{chr(97 + i) * 60}</p>{shared}</article>"))
    found = run(spark, rows)
    for i in range(20):
        assert "Read our paper" not in found[i][0] and found[i][0].startswith(chr(97 + i) * 60)
        assert ("a passage that a few" in found[i][0]) == (i < 6)


def test_a_long_page_and_an_empty_table(spark):
    found = run(spark, [(1, "https://a.example/", "<article>" + "<p>word</p>" * 100_000 + "</article>")])
    assert found[1][0].count("word") == 100_000
    assert run(spark, []) == {}


def test_every_article_of_the_given_pages(spark):
    """The given pages mark their articles; the brute-force version cuts them out by pattern."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r["page_id"]: r["text"] for r in styletree.op12_style_tree_text(spark, "/root/testdata/sf0.01").collect()}
    rows = pages.collect()
    assert len(rows) == len(found)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?p>|</?h1>", article))
        assert found[r["page_id"]] == "\n\n".join(x for x in parts if x)
