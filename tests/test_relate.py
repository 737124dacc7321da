"""Relationships between facts of different documents, and what no relationship may do."""

import pytest
from pyspark.sql import functions as F

from attestry.operators import views
from attestry.operators.explain import explain, number
from attestry.operators.relate import relate, summary

SCHEMA = "fact_id string, doc_pos int, fact_no int, entity string, metric string, raw_value string, period string, evidence string, statement string"
FACTS = [
    ("income", 1, 1, "Borealis Ltd", "Total Income", "Total income €8.1 million", "FY 2022", "Total income came to €8.1 million"),
    ("profit", 2, 1, "Borealis Ltd", "Net Profit", "€8.1 million", "FY 2022", "a net profit of €8.1 million"),
    ("sales1", 1, 2, "Borealis Ltd", "Net Sales", "€640", "FY 2022", "Net sales were €640 million"),
    ("sales2", 2, 2, "Borealis Ltd", "Revenue", "€642 million", "FY 2022", "Revenue of €642 million"),
    ("sales3", 3, 1, "Borealis Ltd", "Revenue", "€800 million", "FY 2022", "Revenue of €800 million"),
    ("sales4", 4, 1, "Borealis Ltd", "Revenue", "€150 million", "Q3 FY 2022", "Third quarter revenue was €150 million"),
    ("group", 5, 1, "Group Holdings Ltd", "Revenue", "€640 million", "FY 2021", "Revenue of €640 million"),
    ("other", 5, 2, "Zephyr Ltd", "Revenue", "€1 million", "FY 2022", "Revenue of €1 million"),
    (None, 6, 1, "Borealis Ltd", "Revenue", "€1 million", "FY 2022", None),
]


@pytest.fixture(scope="module")
def found(spark):
    return relate(spark.createDataFrame([(*f, "") for f in FACTS], SCHEMA)).cache()


def test_types(found):
    got = {(r["fact_a"], r["fact_b"]): r for r in found.collect()}
    assert len(got) == found.count()
    assert not any("income" in k or "profit" in k for k in got)  # another family, though amount and unit agree
    assert (got["sales1", "sales2"]["type"], got["sales1", "sales2"]["confidence"], got["sales1", "sales2"]["variance_percent"]) == ("CORROBORATED", 0.98, 0.31)
    assert (got["sales1", "sales3"]["type"], got["sales1", "sales3"]["variance_percent"], got["sales1", "sales3"]["difference"]) == ("CONTRADICTED", 20.0, 1.6e8)
    assert (got["sales1", "sales4"]["type"], got["sales1", "sales4"]["confidence"]) == ("RECONCILED BY CONTEXT", 0.92)
    assert got["sales1", "group"]["type"] == "UNCERTAIN"  # the wildcard entity meets every other, once
    assert ("group", "other") not in got and ("sales1", "other") not in got
    totals = {r["type"]: (r["n"], r["percent"]) for r in summary(found).collect()}
    assert sum(n for n, _ in totals.values()) == len(got) and len(totals) == 4


def test_explanations_and_views(found):
    told = explain(found).cache()
    one = {(r["fact_a"], r["fact_b"]): r for r in told.collect()}
    agreed, explained = one["sales1", "sales2"], one["sales1", "sales4"]
    assert agreed["variance_text"] == "0.31%" and len(agreed["steps"]) == 5 and "640,000,000 EUR" in agreed["steps"][0]
    assert [d["dimension"] for d in agreed["dimensions"]] == ["metric", "currency", "period", "scope", "basis", "operations"] and all(d["compatible"] for d in agreed["dimensions"])
    assert explained["factors"] == ["an interim period against the full year"] and [d["dimension"] for d in explained["dimensions"] if not d["compatible"]] == ["period"]
    assert views.search_relationships(told, "CONTRADICTED", "€800 M").count() == told.filter("type = 'CONTRADICTED'").filter(F.contains(F.col("b.raw_value"), F.lit("€800")) | F.contains(F.col("a.raw_value"), F.lit("€800"))).count() > 0
    assert views.search_relationships(told, query=" ").count() == told.count()
    rows = views.report_rows(told).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in rows] == list(range(1, told.count() + 1)) and rows[0]["section"].startswith("### 1 [CONTRADICTED]")


def test_numbers(spark):
    cases = {1234567.0: "1,234,567", 12345.5: "12,345.5", 2.0625: "2.063", -0.5: "-0.5", 100.0: "100", 0.0: "0"}
    df = spark.createDataFrame([(x,) for x in cases], "x double")
    assert {r["x"]: r["t"] for r in df.select("x", number(F.col("x")).alias("t")).collect()} == cases


def test_repeated_ids(spark):
    facts = [("a", 1, 1), ("b", 2, 1), ("b", 3, 1)]
    rows = [(i, d, n, "Borealis Ltd", "Revenue", "€640 million", "FY 2022", "", "") for i, d, n in facts]
    own = spark.createDataFrame(rows, SCHEMA)
    assert relate(own).count() == 3
    assert sorted((r["fact_a"], r["fact_b"]) for r in relate(own, repeated_ids=True).collect()) == [("a", "b"), ("b", "b")]


def test_empty(spark):
    none = relate(spark.createDataFrame([], SCHEMA))
    assert {r["type"]: r["n"] for r in summary(none).collect()} == {"CONTRADICTED": 0, "RECONCILED BY CONTEXT": 0, "CORROBORATED": 0, "UNCERTAIN": 0}
    assert views.report_rows(explain(none)).count() == 0
