"""Long URLs, archives by other names, characters that are no letters, long texts in parts."""

import gzip

import pytest

from marketloom.llm import langid, templates, warc
from tests.llm.cases import prose
from tests.oracle import check


def test_a_page_with_a_url_of_a_megabyte_comes_back(spark, tmp_path):
    long = "data:text/html," + "a" * 1_000_000
    df = spark.createDataFrame([(1, "http://a/1", "<p>one</p>"), (2, long, "<p>two</p>"), (3, "http://a/3" + "b" * 66_000, None), (4, "http://a/4", "<p>four</p>")], "page_id long, url string, html string")
    back = {r["page_id"]: r for r in warc.round_trip(spark, df, f"file://{tmp_path}/w").collect()}
    assert set(back) == {1, 2, 3, 4} and back[2]["url"] == long and back[3]["payload_bytes"] == 0


def test_archives_are_read_whatever_their_names(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://a/{i}", f"<p>{i}</p>") for i in range(20)], "page_id long, url string, html string")
    warc.write_archives(df.coalesce(1), f"file://{tmp_path}/w")
    part = max((tmp_path / "w").glob("part-*"), key=lambda p: p.stat().st_size).read_bytes()
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "x.warc.gz").write_bytes(gzip.compress(part))
    (tmp_path / "x" / "plain.warc").write_bytes(part)
    found = warc.read_archives(spark, f"file://{tmp_path}/x")
    assert found.where("error IS NULL").groupBy("file").count().count() == 2 and found.where("error IS NULL").count() == 40
    assert warc.read_archives(spark, f"file://{tmp_path}/x", names="*.warc").where("error IS NULL").count() == 20


def test_headers_that_never_end_are_one_gap():
    data = b"WARC/1.1\r\nWARC-Type: response\r\n" * 5000
    assert [(a, b, r) for a, b, r in warc.salvage(data)] == [(0, len(data), None)]


@pytest.mark.parametrize(("text", "letter"), [("²", False), ("½", False), ("①", False), ("Ⅷ", False), ("12 _ ٣", False), ("é", True), ("漢", True), ("7ª", True)])
def test_letters(text, letter):
    assert langid.has_letter(text) == letter


def test_a_long_text_in_parts_has_the_same_words(monkeypatch):
    import random

    text = prose(random.Random(1), 3000) + "x" * 500 + " end"
    monkeypatch.setattr(langid, "GROUP", 100)
    parts = list(langid.parts_of(text))
    assert "".join(parts) == text and len(parts) > 50
    assert [w for p in parts for w in langid.words_of(p)] == langid.words_of(text)
    assert list(langid.parts_of("")) == [""] and list(langid.parts_of("y" * 1000)) == ["y" * 1000]


def test_line_templates_equal_their_sql_at_every_size(spark):
    for sf in ("0.001", "0.01"):
        check(spark, templates.op4_line_templates, templates.SQL["op4_line_templates"], f"/root/testdata/sf{sf}")
