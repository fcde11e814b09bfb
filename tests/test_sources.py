from __future__ import annotations

import zipfile
from email.message import EmailMessage

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sheetweave.operators import documents, repair
from sheetweave.sources import email, workbook

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


@pytest.fixture
def book(tmp_path):
    path = tmp_path / "a.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{RELS}"><sheets><sheet name="First" sheetId="1" r:id="x1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="x1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}"><si><t>Region</t></si><si><r><t>No</t></r><r><t>rth</t></r></si></sst>')
        z.writestr(
            "xl/worksheets/sheet1.xml",
            f'<worksheet xmlns="{MAIN}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3"><v>5</v></c><c r="C3"><f>SUM(B3:$B$9)+\'My sheet\'!A1&amp;"D4"</f><v>7</v></c></row></sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>',
        )
    return path


def test_workbook(spark, book):
    rows = workbook.read_workbooks(spark, str(book)).orderBy("row_id").collect()
    assert [list(r["cells"]) for r in rows] == [["Region", "Region", ""], ["", "", ""], ["North", "5", "7"]]
    f = workbook.read_formulas(spark, str(book)).first()
    assert (f["coordinate"], f["cached"]) == ("C3", "7")
    assert [tuple(r) for r in f["references"]] == [(None, 3, 9, 2, 2), ("My sheet", 1, 1, 1, 1)]


def test_column_letters():
    assert [workbook.column_letters(n) for n in (1, 26, 27, 703)] == ["A", "Z", "AA", "AAA"]
    assert all(workbook.column_number(workbook.column_letters(n)) == n for n in range(1, 2000))


def test_email(spark, tmp_path):
    m = EmailMessage()
    m["Subject"], m["From"], m["To"] = "Rates", "a@example.com", "b@example.com"
    m.set_content("plain  body\n")
    m.add_alternative("<p>html</p>", subtype="html")
    m.add_attachment(b"x", maintype="application", subtype="octet-stream", filename="rates.csv")
    (tmp_path / "m.eml").write_bytes(bytes(m))
    r = email.read_emails(spark, str(tmp_path), 5).first()
    assert (r["subject"], r["body"], r["body_source"], r["body_chars"], r["truncated"], list(r["attachments"])) == ("Rates", "plain", "plain", 10, True, ["rates.csv"])


def test_html_text(spark):
    t = spark.createDataFrame([("<p>a <b>b</b></p><!-- <i>c</i> --><script>x()</script>&amp;lt; 1 < 2",), (None,), ("",)], "html string")
    assert [r[0] for r in t.select(documents.html_text(F.col("html"))).collect()] == ["a\nb\nx()\n&lt; 1 < 2", None, ""]


def test_visual_lines(spark):
    words = spark.createDataFrame([(1, 50.0, 10.4, "b"), (1, 10.0, 10.0, "a"), (1, 10.0, 20.0, "c"), (2, 1.0, 1.0, "d")], "page int, x0 double, y0 double, text string")
    got = documents.visual_lines(words, ["page"]).orderBy("page", "y").collect()
    assert [(r["page"], r["text"]) for r in got] == [(1, "a b"), (1, "c"), (2, "d")]


def test_repair_hints(spark):
    spark.range(1).selectExpr("id as customer_name", "id as total").createOrReplaceTempView("customer_orders")
    tables = spark.createDataFrame([("customer_orders", "customer_name"), ("customer_orders", "total"), ("other", "total")], "table_name string, column_name string")
    with pytest.raises(AnalysisException) as e:
        spark.sql("select custmer_name from customer_orders").collect()
    assert repair.hint(e.value, tables)["candidates"][0] == {"column": "customer_name", "tables": ["customer_orders"]}
    with pytest.raises(AnalysisException) as e:
        spark.sql("select 1 from customer_order").collect()
    assert repair.hint(e.value, tables)["candidates"] == ["customer_orders", "other"]
    pairs = spark.createDataFrame([("order_id", "orderId"), ("total", "other"), ("a_b", "b_a"), ("", "x")], "a string, b string")
    assert [r[0] for r in pairs.select(repair.similarity(F.col("a"), F.col("b"))).collect()] == pytest.approx([100, 20 * 0.4, 20 * 2 + 20 + 20 * 0.5, 0])
