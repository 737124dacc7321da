"""Facts out of pages, model answers and files."""

import json
import zlib

import pytest
from pyspark.sql import functions as F

from attestry.operators.extract import extract_facts, model_facts, prioritised_pages, prompts
from attestry.sources import pages as P

COLUMNS = "doc_id string, doc_pos int, document_name string, page_ord int, page_number int, text string"
PAGES = [
    ("a", 0, "x.pdf", 0, 1, "Fjord Systems Corp reports\n* Net income was $4.5 million in Q2 2023\nNet income was $9 million in Q2 2023\nShort\nOperating margin: 12.5% or $3\nHeadcount: 1,200 employees and $5 each\nTruck Fleet:: 33 units"),
    ("a", 0, "x.pdf", 1, 2, "Net income was $4.5 million in Q2 2023\nSales fell"),
    ("b", 1, "07_press-release_lumen-works_2023.pdf", 0, 1, None),
    ("b", 1, "07_press-release_lumen-works_2023.pdf", 1, 2, "Total assets: Rs. 40 crore\nas of March 31, 2023"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, COLUMNS).withColumn("line", F.lit("clash")).repartition(2)


def test_rules(pages):
    got = {r["fact_id"]: r for r in extract_facts(pages).collect()}
    assert {k: (r["metric"], r["raw_value"], r["period"]) for k, r in got.items()} == {
        "a_p1_f1": ("Net Income", "$4.5 million", "Q2 FY2023"),
        "a_p1_f2": ("Operating Margin", "12.5%", "Q2 FY2023"),
        "a_p1_f3": ("Headcount", "1,200 employees", "Q2 FY2023"),
        "a_p1_f4": ("Truck Fleet", "33 units", "Q2 FY2023"),
        "a_p2_f5": ("Net Income", "$4.5 million", "Q2 FY2023"),
        "b_p2_f1": ("Total Assets", "Rs. 40 crore", "March 31, 2023"),
    }
    assert got["a_p1_f1"]["entity"] == "Fjord Systems Corp" and got["b_p2_f1"]["entity"] == "Lumen Works 2023"
    assert got["a_p1_f1"]["evidence"].startswith("Net income") and got["a_p1_f3"]["category"] == "workforce"
    assert extract_facts(pages.filter("false")).count() == 0


def test_model(spark, pages):
    rows = [{"pageNumber": 9, "entity": "", "metric": "Revenue", "category": "Odd", "rawValue": "$5", "evidenceText": "IFRS revenue, excluding tax of all kinds"}, None]
    answers = spark.createDataFrame([("a", json.dumps(rows)), ("b", "no json"), (None, None)], "doc_id string, payload string")
    got = {r["fact_id"]: r for r in model_facts(answers, pages).collect()}
    assert set(got) == {"a_p9_f1", "b_p2_f1"} and got["b_p2_f1"]["mode"] == "rules"
    one = got["a_p9_f1"]
    assert (one["page_number"], one["entity"], one["category"], one["basis"], one["statement"]) == (2, "General", "general", "IFRS", "Revenue: $5")
    many = spark.createDataFrame([("d", 0, "d", i, i + 1, f"page {i}" if i % 2 else "none") for i in range(40)], COLUMNS)
    assert sorted(r["page_ord"] for r in prioritised_pages(many).collect()) == [i for i in range(40) if i >= 10 and i % 2]  # two digits are data
    assert prompts(pages).filter("doc_id = 'b'").first()["prompt"].startswith("--- PAGE 1 ---\n\n\n--- PAGE 2 ---\nTotal assets")


def test_files(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.json").write_text(json.dumps({"documents": [{"filename": "one", "pages": [{"pageNumber": 4, "text": " x "}, {"text": None}]}, {"pages": [{"text": "y"}]}]}))
    got = sorted((r["document_name"], r["page_number"], r["text"]) for r in P.read_json(spark, str(tmp_path / "j")).collect())
    assert got == [("Document 2", 1, "y"), ("one", 2, ""), ("one", 4, "x")]
    sizes = {r["total_pages"]: r["file_size"] for r in P.document_sizes(P.read_json(spark, str(tmp_path / "j"))).collect()}
    assert sizes == {2: 1, 1: 1}
    packed = zlib.compress(b"BT <48656C6C6F> Tj 0 -14 Td (there \\(now\\)) Tj ET")
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.pdf").write_bytes(b"%PDF-1.4\n1 0 obj <</Length 9>> stream\nBT (Page  one) Tj ET\nendstream\n2 0 obj <</Filter /FlateDecode>> stream\n" + packed + b"\nendstream")
    (tmp_path / "p/b.PDF").write_bytes(b"nothing \x00\x01 but (text) Tj here")
    (tmp_path / "p/c.txt").write_bytes(b"no")
    read = {(r["document_name"], r["page_number"]): r["text"] for r in P.read_pdf(spark, str(tmp_path / "p")).collect()}
    assert read == {("a.pdf", 1): "Page  one", ("a.pdf", 2): "Hello\nthere (now)", ("b.PDF", 1): "text"}
    assert {r["text"] for r in P.read_pdf(spark, str(tmp_path / "p"), collapse=True).collect()} == {"Page one", "Hello there (now)", "text"}


def test_checks(spark, pages):
    P.check_pages(pages)
    for wrong in (pages.filter("doc_id = 'a'"), pages.filter("page_ord = 0")):
        with pytest.raises(ValueError):
            P.check_pages(wrong)
    files = spark.createDataFrame([("a.pdf", 5, 0), ("a.pdf", 5, 1), ("b.txt", 5, 2), ("c.PDF", 26 << 20, 3)], "name string, size long, place int")
    assert [r["name"] for r in P.accepted_files(files).collect()] == ["a.pdf"]
    with pytest.raises(ValueError):
        P.check_files(files)
