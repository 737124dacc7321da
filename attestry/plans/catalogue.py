"""The queries, by name: each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import concept as C
from ..functions import lexicon as L
from ..functions.period import normalize_period
from ..functions.value import normalize_value
from ..operators.relate import candidate_pairs, compare, normalize_facts, relate, summary, variance
from ..scratch import written
from ..sources.statements import statements


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_pages_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    trimmed = F.transform(lines, lambda x: F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", ""))
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.size(F.filter(trimmed, lambda x: F.length(x) >= 8)).cast("long").alias("n_candidates"))


def page_blank_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").groupBy("source").agg(F.every(F.trim(F.coalesce("text", F.lit(""))) == "").alias("all_blank"), F.sum(F.length("text")).alias("chars"), F.count("*").alias("pages"))


def canonical_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _table(spark, sf_dir, "customer").select(F.concat("c_name", F.lit(" Holdings, Inc.")).alias("name")).unionByName(_table(spark, sf_dir, "supplier").select(F.concat("s_name", F.lit(" Group PLC")).alias("name"))).unionByName(_table(spark, sf_dir, "nation").select(F.concat("n_name", F.lit(" Co-op Ltd")).alias("name")))
    return names.select("name", C.canonical_entity(F.col("name")).alias("entity_key"))


def metric_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select("item_id", F.array_join(C.metric_tokens(F.col("text")), " ").alias("tokens"))


def token_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _table(spark, sf_dir, "part").select("p_name").distinct().withColumn("t", F.array_distinct(C.metric_tokens(F.col("p_name"))))
    words = names.select("p_name", F.explode("t").alias("w"), F.size("t").alias("n"))
    a, b = words.select(F.col("p_name").alias("a"), "w", F.col("n").alias("na")), words.select(F.col("p_name").alias("b"), "w", F.col("n").alias("nb"))
    both = a.join(b, "w").filter("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("common"))
    return both.select("a", "b", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("similarity"))


def _amounts(rows: DataFrame, key: str) -> DataFrame:
    """(key, raw_value, ...) of `rows` (key, r): one struct for each value, then its fields."""
    return rows.select(key, F.col("r").alias("raw_value"), normalize_value(F.col("r"), F.lit("")).alias("v")).select(key, "raw_value", "v.*")


def normalize_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("o_orderkey") % 6
    n = F.col("o_custkey").cast("string")
    raw = F.when(m == 0, F.concat(F.lit("$"), n, F.lit(" million"))).when(m == 1, F.concat(F.lit("€"), n, F.lit("bn"))).when(m == 2, F.concat(F.lit("Rs "), n, F.lit(" Cr"))).when(m == 3, F.concat(F.lit("(£"), n, F.lit(")"))).when(m == 4, F.concat(n, F.lit(" bps"))).otherwise(F.concat(n, F.lit(" employees")))
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("r"))
    return _amounts(rows, "o_orderkey")


def normalize_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.abs((F.col("c_acctbal") * 100).cast("long"))
    text = F.concat(F.expr("cast(abs(cast(c_acctbal * 100 as bigint)) div 100 as string)"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    raw = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("("), text, F.lit(")"))).otherwise(text)
    rows = _table(spark, sf_dir, "customer").select("c_custkey", raw.alias("r"))
    return _amounts(rows, "c_custkey")


def normalize_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, q, m = F.year("o_orderdate"), F.quarter("o_orderdate"), F.month("o_orderdate")
    y, q, k = y.cast("string"), q.cast("string"), F.col("o_orderkey") % 8
    text = F.when(k == 0, F.concat(F.lit("Q"), q, F.lit(" FY"), y)).when(k == 1, F.concat(F.when(m <= 6, "H1 ").otherwise("H2 "), y)).when(k == 2, F.concat(F.lit("nine months ended "), y)).when(k == 3, F.concat(F.lit("TTM "), y)).when(k == 4, F.concat(F.lit("Fiscal Year "), y)).when(k == 5, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 6, F.concat(F.lit("March 5, "), y)).otherwise(F.concat(F.lit("since "), y))
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", text.alias("period"))
    return rows.select("o_orderkey", "period", normalize_period(F.col("period")).alias("p")).select("o_orderkey", "period", "p.type", "p.key", "p.label", "p.fiscal_year")


#: Metric names that part keys are dealt over.
METRICS = ["Total Revenue", "Net Income", "Adjusted EBITDA", "Gross Margin", "EBITDA Margin", "Diluted EPS", "Basic EPS", "Revenue Growth", "Free Cash Flow", "Capex", "Total Assets", "Non-current assets", "Net Debt", "Headcount", "Active Users", "Order Book", "Scope 2 Emissions", "Clean Energy Share", "Pending Litigation", "Attrition Rate", "Express Parcel Revenue", "Operating Income", "Profit Before Tax", "Finance Cost", "Widget Quality Index", "Other Income", "Total Income", "R&D", "Tax Provision", "Shareholders Equity"]


def classify_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    metric = F.element_at(F.array(*map(F.lit, METRICS)), (F.col("p_partkey") % len(METRICS) + 1).cast("int"))
    rows = _table(spark, sf_dir, "part").select("p_partkey", metric.alias("metric"))
    c = C.classify_concept(F.col("metric"), F.lit(""))
    return rows.select("p_partkey", "metric", c.concept_id.alias("concept_id"), c.concept_family.alias("concept_family"), C.category(F.col("metric")).alias("category"))


def context_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = ["consolidated gaap audited", "standalone ifrs unaudited target", "segment non-gaap restated gross", "group net discontinued europe", "adjusted parent continuing india", "worldwide forecast gross and net", "plain words"]
    text = F.element_at(F.array(*map(F.lit, phrases)), (F.col("s_suppkey") % len(phrases) + 1).cast("int"))
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("phrase"))
    c = C.context(F.col("phrase"))
    return rows.select("s_suppkey", "phrase", *(c[f].alias(f) for f in ("basis", "scope", "operations", "audit_status", "geography", "is_estimate", "gross_or_net")))


def variance_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", variance(F.col("l_quantity"), F.col("l_quantity") + F.col("l_discount")).alias("variance_percent"))
    return rows.withColumn("within", F.col("variance_percent") <= L.TOLERANCE)


def candidate_pairs_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = candidate_pairs(written(normalize_facts(statements(spark, sf_dir)), "facts"))
    return pairs.groupBy(F.col("a.entity_key").alias("entity_key"), F.col("a.family").alias("family")).agg(F.count("*").alias("pairs"))


def comparison_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = compare(candidate_pairs(written(normalize_facts(statements(spark, sf_dir)), "facts")))
    return compared.groupBy(F.array_join("reconciling", ",").alias("reconciling"), F.array_join("reasons", ",").alias("reasons"), "comparable").agg(F.count("*").alias("pairs"))


def classify_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relate(statements(spark, sf_dir)).select("rel_id", "type", "confidence", "fact_a", "fact_b", "concept_id", "period_label", "variance_percent")


def relationship_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(relate(statements(spark, sf_dir)))


def relationship_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relate(statements(spark, sf_dir)).filter((F.col("type") == "CONTRADICTED") & F.contains(F.lower("period_label"), F.lit("1997")))
    return found.select("rel_id", "period_label", "variance_percent")


def facts_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(*map(F.lit, range(4)))).alias("d")).select((F.col("n_nationkey") * 3 + F.col("d")).alias("doc_pos")).distinct()
    counts = statements(spark, sf_dir).groupBy("doc_pos").agg(F.count("*").alias("n"))
    return docs.join(counts, "doc_pos", "left").select("doc_pos", F.coalesce("n", F.lit(0)).cast("long").alias("n_facts"))


QUERIES = {f.__name__: f for f in (relationship_summary, scan_pages_lines, page_blank_check, canonical_entities, metric_tokens, token_jaccard_pairs, normalize_money, normalize_negative, normalize_periods, classify_concepts, context_dimensions, variance_tolerance, candidate_pairs_count, comparison_matrix, classify_relationships, relationship_search, facts_per_document)}
