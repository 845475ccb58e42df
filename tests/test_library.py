import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.functions import quality
from quillspark.operators import pages, tables
from quillspark.sources import io as sources


def test_page_ranges():
    assert pages.parse_page_range("2-5") == (2, 5)
    for bad in ("5", "5-2", "0-3", "a-b", "1-2-3", "", "-3"):
        with pytest.raises(ValueError):
            pages.parse_page_range(bad)


def test_markdown_and_validity(spark):
    d = spark.createDataFrame([(1, [["a", "bb"], ["ccc", None], ["d", "e"]]), (2, [["x"], ["y"], ["z"]]), (3, []), (4, [["a", "b"], ["c"], ["d", "e"]])], "i int, g array<array<string>>")
    got = {r["i"]: r for r in d.select("i", tables.to_markdown(F.col("g")).alias("m"), tables.is_real_table(F.col("g")).alias("ok")).collect()}
    assert got[1]["m"] == "| a   | bb |\n| --- | -- |\n| ccc |    |\n| d   | e  |" and got[1]["ok"]
    assert not got[2]["ok"] and got[3]["m"] == "" and not got[3]["ok"] and not got[4]["ok"]


def test_insertion(spark):
    d = spark.createDataFrame([("a\nTable 1 x\nb", ["T"]), ("none", ["T"]), ("Table 1\nTable 2", ["T"])], "t string, g array<string>")
    assert [r[0] for r in d.select(tables.insert_tables(F.col("t"), F.col("g"))).collect()] == ["a\nTable 1 x\n\nT\n\nb", "none", "Table 1\n\nT\n\nTable 2"]


def test_captions_reach_the_next_page_only(spark):
    d = spark.createDataFrame([("d", 1, "Table 1"), ("d", 2, "x"), ("d", 3, "y")], "doc_id string, page_number int, text string")
    assert [r["in_scope"] for r in tables.caption_window(d).orderBy("page_number").collect()] == [True, True, False]


def test_quality():
    assert quality.compare("λόγος", "λόγος") == (100.0, 5, 100.0)
    assert quality.compare("λόγος", "λογος") == (100.0, 5, 80.0)
    assert quality.compare("", "") == (100.0, 0, None)
    assert quality.letters_and_marks("́̀") == []


def test_verify_and_summary(spark):
    ocr = spark.createDataFrame([("p1", "a b c"), ("p2", "zzzz"), ("p3", "x"), ("p4", "")], "page string, text string")
    ref = spark.createDataFrame([("p1", "a b c"), ("p2", "abcd"), ("p4", "")], "page string, text string")
    r = quality.verify(ocr, ref)
    got = {x["page"]: x for x in r.collect()}
    assert got["p1"]["passed"] and got["p1"]["overlap"] == 100.0 and not got["p2"]["passed"] and got["p4"]["overlap"] == 100.0
    s = quality.summary(r, quality.missing_reference(ocr, ref)).collect()[0]
    assert (s["pages_evaluated"], s["pages_passed"], s["pages_with_errors"], s["pages_skipped"]) == (3, 2, 1, ["p3"])


def test_docx(spark):
    body = '<w:p ><w:r><w:t>A &amp; b</w:t><w:footnoteReference w:id="2"/></w:r></w:p><w:p><w:t>c</w:t></w:p>'
    notes = '<w:footnote w:id="-1"><w:p><w:t>s</w:t></w:p></w:footnote><w:footnote w:id="2"><w:p><w:t>note</w:t></w:p></w:footnote>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/footnotes.xml", notes)
    d = spark.createDataFrame([(bytearray(buffer.getvalue()),)], "content binary")
    parts = d.select(sources.docx_parts("content").alias("p"))
    assert parts.select(sources.docx_text_udf("p").alias("t")).collect()[0]["t"] == "A & b [note] \nc"


def test_stream(spark, tmp_path):
    from quillspark.streaming.corrections import corrected

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("wor1d , x")
    s = corrected(spark.readStream.schema("value string").text(str(tmp_path / "in"), wholetext=True).withColumnRenamed("value", "text"))
    q = s.writeStream.format("memory").queryName("fixed").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r["text"] for r in spark.table("fixed").collect()] == ["world, x"]
