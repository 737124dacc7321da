"""Facts stated by a star schema: each nation's yearly order volume, as three documents would report it.

Amounts are integers of 10,000 so that both engines write the same digits. By (nation + year) modulo 5 the second document
repeats the first's figure, is 0.5 % or 5 % off, calls it adjusted, or writes it in thousands; the third reports a fourth quarter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fact_id, doc_pos, fact_no, entity, metric, raw_value, period, evidence, statement)."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", F.year("o_orderdate").alias("y"), (F.col("o_totalprice") * 100 + 0.5).cast("long").alias("cents"))
    nations = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.col("c_nationkey").alias("k"))
    volume = orders.join(nations, F.col("o_custkey") == F.col("c_custkey")).groupBy("k", "y").agg(F.expr("sum(cents) div 1000000").alias("h"))
    kinds = volume.select("k", "y", "h", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("d")).withColumn("m", F.when(F.col("d") == 1, (F.col("k") + F.col("y")) % 5).otherwise(0))
    h = F.expr("CASE WHEN d = 2 THEN h div 4 WHEN m = 1 THEN h + h div 200 WHEN m = 2 THEN h + h div 20 ELSE h END")
    own = kinds.withColumn("h", h)
    millions = F.concat(F.lit("$"), F.expr("CAST(h div 100 AS STRING)"), F.lit("."), F.lpad((F.col("h") % 100).cast("string"), 2, "0"), F.lit(" million"))
    thousands = F.concat(F.lit("$"), F.expr("CAST(h * 10 div 1000 AS STRING)"), F.lit(","), F.lpad((F.col("h") * 10 % 1000).cast("string"), 3, "0"), F.lit(" thousand"))
    raw = F.when((F.col("m") == 4) & (F.col("h") * 10 >= 1000), thousands).otherwise(millions)
    metric = F.when(F.col("m") == 3, "Adjusted Total Revenue").otherwise("Total Revenue")
    period = F.concat(F.when(F.col("d") == 2, "Q4 FY ").otherwise("FY "), F.col("y").cast("string"))
    return own.select(
        F.concat_ws("_", F.lit("f"), "k", "d", "y").alias("fact_id"),
        (F.col("k") * 3 + F.col("d")).alias("doc_pos"),
        F.col("y").alias("fact_no"),
        F.concat(F.lit("NATION "), F.col("k").cast("string"), F.lit(" Holdings Ltd")).alias("entity"),
        metric.alias("metric"), raw.alias("raw_value"), period.alias("period"),
        F.concat(metric, F.lit(" was "), raw).alias("evidence"), F.lit("").alias("statement"),
    )


#: Years are shifted so that they are ones that a bare number may stand for.
SHIFT = 20


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same statements as text: each nation's three documents, two pages each (years up to 2017, and later ones), a sentence a year.

    The first page begins with the company's name. In even years the sentence comes twice; a line without an amount,
    one of employees without a period and short ones stand between.
    """
    said = statements(spark, sf_dir).withColumn("y", F.col("fact_no") + SHIFT)
    period = F.concat(F.when(F.col("period").startswith("Q4"), "Q4 FY ").otherwise("FY "), F.col("y").cast("string"))
    line = F.concat(F.lit("- "), "metric", F.lit(" for "), period, F.lit(" was "), "raw_value", F.lit("."))
    told = said.select("doc_pos", "entity", F.when(F.col("y") <= 2017, 0).otherwise(1).alias("page_ord"), "y", F.when(F.col("y") % 2 == 0, F.concat(line, F.lit("\n  "), line)).otherwise(line).alias("line"))
    page = told.groupBy("doc_pos", "entity", "page_ord").agg(F.array_sort(F.collect_list(F.struct("y", "line"))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x.line), "\n")
    head = F.concat("entity", F.lit("\nsmall\nAn overview of gross profit\n"))
    text = F.when(F.col("page_ord") == 0, F.concat(head, body)).otherwise(F.concat(body, F.lit("\nHeadcount: "), (F.col("doc_pos") + 1000).cast("string"), F.lit(" employees")))
    return page.select(F.concat(F.lit("doc_"), F.col("doc_pos").cast("string")).alias("doc_id"), "doc_pos", F.concat(F.lit("report_"), F.col("doc_pos").cast("string"), F.lit(".pdf")).alias("document_name"), "page_ord", (F.col("page_ord") + 1).alias("page_number"), text.alias("text"))
