"""Amounts of a thousand and more before their groups of three, and the queries that meet them, against their SQL."""

from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from attestry.functions.find import value_in
from attestry.functions.value import normalize_value

CASES = {
    "$1469,230 thousand": ("$1469,230 thousand", 1.46923e9),
    "$12345,678.5 million": ("$12345,678.5 million", 1.23456785e13),
    "$1469,230, up": ("$1469,230", 1469230.0),
    "$1469,2301": ("$146", 146.0),
    "$1469,23 million": ("$146", 146.0e6),
    "$1234.56 million": ("$123", 123.0e6),
    "$469,230 thousand": ("$469,230 thousand", 4.6923e8),
}


def test_amounts(spark):
    texts = spark.createDataFrame([(t,) for t in CASES], "t string")
    value = normalize_value(F.col("t"), F.lit("")).base_value
    got = {r["t"]: (r["raw"], r["v"]) for r in texts.select("t", value_in(F.col("t"), F.lit("Total Revenue"), F.lit("financial")).alias("raw"), value.alias("v")).collect()}
    assert {t: raw for t, (raw, _) in got.items()} == {t: raw for t, (raw, _) in CASES.items()}
    assert [got[t][1] for t in CASES] == pytest.approx([v for _, v in CASES.values()])


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """Two nations with some 15 million a year and order, 100 orders a year."""
    folder = tmp_path_factory.mktemp("large")
    orders = [(i, i % 10, 15e6 + 1000.25 * i, datetime(1995 + i // 100 % 5, 1 + i % 12, 5)) for i in range(1000)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(i, 1 + i % 2) for i in range(10)], "c_custkey long, c_nationkey int").write.parquet(f"{folder}/customer.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["classify_relationships", "extract_facts_dedup", "extracted_relationships", "fact_cards", "incremental_relationships", "page_lookup", "relationship_cards", "relationship_report", "relationship_search"])
def test_queries(spark, large, tmp_path, name):
    con = duckdb.connect()
    for table in ("orders", "customer"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{large}/{table}.parquet/*.parquet'")
    result = __spark_entry__.queries()[name](spark, large)
    result.write.parquet(f"{tmp_path}/got")
    columns = ", ".join(f'"{c}"' for c in result.columns)
    got, want = f"SELECT {columns} FROM '{tmp_path}/got/*.parquet'", f"SELECT {columns} FROM ({__spark_entry__.oracle_sql()[name]})"
    assert con.sql(want).fetchall() and con.sql(f"({got}) EXCEPT ALL ({want})").fetchall() == con.sql(f"({want}) EXCEPT ALL ({got})").fetchall() == []
