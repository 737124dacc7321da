"""Numbers over ranges, wildcards in a grid, nested rows, page choice, SQL functions."""

import random

from pyspark.sql import functions as F

from attestry.functions import sql
from attestry.operators import views
from attestry.operators.extract import NOTICES, extract_facts, extraction_status, extraction_summary, prioritised_keys
from attestry.operators.relate import candidate_pairs, normalize_facts, relate
from attestry.scratch import numbered, written

FACTS = "fact_id string, doc_pos int, fact_no int, entity string, metric string, raw_value string, period string, evidence string, statement string"


def test_numbered_on_skewed_positions(spark):
    rng = random.Random(2)
    rows = [(0 if rng.random() < 0.7 else int(rng.paretovariate(0.5)), i, f"t{i}") for i in range(20_000)]
    df = spark.createDataFrame(rows, "at long, i int, name string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = numbered(df, "n", "at", "i")
        ranges = written(df.repartitionByRange("at", "i").withColumn("p", F.spark_partition_id()), "ranges").groupBy("p").count().toPandas()["count"]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["name"] for r in got.orderBy("n").collect()] == [x[2] for x in sorted(rows)]
    assert sorted(r["n"] for r in got.collect()) == list(range(1, 20_001))
    assert ranges.max() < 3 * ranges.median()
    assert numbered(df.limit(0), "n", "at").count() == 0


def facts(spark, wild, other):
    """Two documents: the first's facts have no company of their own."""
    rows = [(f"w{i}", 0, i, "Group Ltd", "Total Revenue", "$5 million", "FY 2020", "", "") for i in range(wild)]
    rows += [(f"o{i}", 1, i, f"Company Nr {i}", "Total Revenue", "$5 million", "FY 2020", "", "") for i in range(other)]
    return spark.createDataFrame(rows, FACTS)


def test_wildcards_in_a_grid(spark):
    own = written(normalize_facts(facts(spark, 60, 40)), "facts")
    pairs = [{(r["x"], r["y"]) for r in candidate_pairs(own, cell=cell).select(F.col("a.fact_id").alias("x"), F.col("b.fact_id").alias("y")).collect()} for cell in (7, 1000)]
    assert pairs[0] == pairs[1] == {(f"w{i}", f"o{j}") for i in range(60) for j in range(40)}
    old = own.filter("fact_id < 'o3' OR fact_id > 'w3'")
    new = own.join(old.select("fact_id"), "fact_id", "left_anti").select(*own.columns)
    added = [(r["x"], r["y"]) for r in candidate_pairs(written(new, "new"), written(old, "old"), cell=7).select(F.col("a.fact_id").alias("x"), F.col("b.fact_id").alias("y")).collect()]
    fresh = {r["fact_id"] for r in new.collect()}
    assert len(added) == len(set(added)) and set(added) == {p for p in pairs[0] if fresh & set(p)} != set()


def test_many_wildcards_of_one_family(spark):
    """100,000 facts without a company in one family: no task holds twice the median."""
    base = written(normalize_facts(facts(spark, 1, 8)), "facts")
    many = base.filter("fact_id = 'w0'").crossJoin(spark.range(100_000)).withColumn("fact_id", F.concat(F.lit("w"), "id")).drop("id")
    own = written(base.filter("fact_id <> 'w0'").unionByName(many), "facts")
    for key, value in (("spark.sql.adaptive.coalescePartitions.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(key, value)
    try:
        sizes = candidate_pairs(own).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).toPandas()["n"]
    finally:
        for key in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(key)
    assert sizes.sum() == 800_000 and len(sizes) > 1 and sizes.max() < 2 * sizes.median()


def test_nested_rows(spark):
    rng = random.Random(3)
    rows = [(f"doc_{d}", d, f"d{d}.pdf", p, p + 1, "Acme Corp\n" + "\n".join(f"Net income was ${rng.randint(5, 7)} million in FY {2000 + rng.randint(1, 9)}" for _ in range(6))) for d in range(4) for p in range(2 + d)]
    pages = spark.createDataFrame(rows, "doc_id string, doc_pos int, document_name string, page_ord int, page_number int, text string")
    own = written(extract_facts(pages), "facts")
    relationships = written(relate(own), "relationships")
    whole = written(views.nested(pages, own, relationships, part=3), "nested")
    assert max(max(len(r["pages"]), len(r["facts"]), len(r["relationships"])) for r in whole.collect()) == 3
    back = lambda c: whole.select("doc_id", F.explode(c).alias("r")).select("doc_id", "r.*")
    assert sorted(map(tuple, back("pages").select("doc_id", "page_ord", "text").collect())) == sorted(map(tuple, pages.select("doc_id", "page_ord", "text").collect()))
    assert sorted(r["fact_id"] for r in back("facts").collect()) == sorted(r["fact_id"] for r in own.collect())
    assert sorted(map(tuple, back("relationships").select("rel_id", "type", "variance_percent").collect()), key=repr) == sorted(map(tuple, relationships.select("rel_id", "type", "variance_percent").collect()), key=repr) != []


def test_page_choice_leaves_texts_behind(spark):
    rows = [("d", i, f"page {i}" if i % 2 else "none") for i in range(40)] + [("e", i, "none") for i in range(20)] + [("f", 5, None)]
    pages = spark.createDataFrame(rows, "doc_id string, page_ord int, text string").repartition(5)
    keys = prioritised_keys(pages)
    assert sorted(map(tuple, keys.collect())) == [("d", i) for i in range(40) if i >= 10 and i % 2] + [("e", i) for i in range(15)] + [("f", 5)]
    plan = keys._jdf.queryExecution().executedPlan().toString()
    exchanges = [part.split("\n")[0] for part in plan.split("Exchange hashpartitioning")[1:]]
    assert exchanges and not any("text" in e for e in exchanges) and "WindowGroupLimit" in plan


def test_page_views_and_cards(spark):
    pages = spark.createDataFrame([("a", 0, "x.pdf", 0, 3, "Acme Corp\nNet income was $4.5 million in FY 2023"), ("a", 0, "x.pdf", 1, 4, " "), ("b", 1, None, 0, 1, "Acme Corp\nNet income was $9 million in FY 2023")], "doc_id string, doc_pos int, document_name string, page_ord int, page_number int, text string")
    own = extract_facts(pages)
    wanted = spark.createDataFrame([("a", 3), ("a", 4), ("a", 9), ("z", 1)], "doc_id string, page_number int")
    seen = {r["asked"]: (r["page_number"], r["text"], [f["raw_value"] for f in r["facts"]]) for r in views.page_view(pages, own, wanted).collect()}
    assert seen == {3: (3, "Acme Corp\nNet income was $4.5 million in FY 2023", ["$4.5 million"]), 4: (4, views.NO_TEXT, []), 9: (3, "Acme Corp\nNet income was $4.5 million in FY 2023", [])}
    one = spark.range(1).select(views.kilobytes(F.lit(1536)).alias("k"), views.kilobytes(F.lit(51)).alias("z"), views.shortened(F.lit("abcdef"), 3).alias("s")).first()
    assert tuple(one) == ("1.5 KB", "0.0 KB", "abc...")
    assert extraction_summary(extraction_status(pages)).first() == ("rules", NOTICES["no_key"])


def test_sql_functions(spark):
    names = sql.register(spark, "t_", ["normalize_value_known", "token_similarity", "find_period", "concept_fields"])
    assert names == ["t_normalize_value_known", "t_token_similarity", "t_find_period", "t_concept_fields"]
    row = spark.sql("SELECT t_normalize_value_known('(5) million', '', NULL, 'euro') v, t_token_similarity(array('a', 'b'), array('b')) s, t_find_period('in H1FY24') p, t_concept_fields('Sales growth', '', NULL, NULL) c, t_find_period(NULL) n").first()
    assert (row["v"]["currency"], row["v"]["base_value"], row["s"], row["p"], row["n"]) == ("EUR", -5e6, 0.5, "H1 FY2024", None)
    assert row["c"]["concept_label"] == "Growth Rate: Sales growth" and row["c"]["is_growth"]


def test_cells_meet_in_a_shuffle(spark):
    """However small the facts' files are, no side's cells go through the driver."""
    own = written(normalize_facts(facts(spark, 60, 40)), "facts")
    plan = candidate_pairs(own, cell=7)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join" in line and "row#" in line and "column#" in line]
    assert len(joins) == 1 and "SortMergeJoin" in joins[0]


def test_pairs_carry_marks_and_no_texts(spark):
    """Asked for ids and types, cells hold marks of the facts and not their texts, and a pair makes no lists and reads no statement."""
    plan = relate(facts(spark, 60, 40)).select("fact_a", "fact_b", "type")._jdf.queryExecution().optimizedPlan().toString()
    pairs, _, sides = plan.partition("Join Inner, ")
    assert "x_fact_id" in pairs and not any(t in pairs for t in ("exists(", "filter(", "statement", "struct("))
    assert "x__period" in sides and not any(t in sides for t in ("x_statement", "x_evidence", "struct(fact_id"))


def test_wildcards_of_one_document_alone(spark):
    """The last document's facts are first in no pair, and one document has no pairs; documents between have both."""
    rows = [(f"w{d}", d, 1, "Group Ltd", "Total Revenue", f"${d} million", "FY 2020", "", "") for d in (3, 5, 9)]
    found = lambda rows: {(r["fact_a"], r["fact_b"], r["type"]) for r in relate(spark.createDataFrame(rows, FACTS)).collect()}
    assert found(rows[:1]) == set()
    assert found(rows) == {("w3", "w5", "CONTRADICTED"), ("w3", "w9", "CONTRADICTED"), ("w5", "w9", "CONTRADICTED")}
