"""Queries that begin with text: periods, entities, metrics and amounts found in it, facts extracted from pages, and all that follows from them.

Each has its SQL beside it, which states the expected facts from the tables and not by reading the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import find
from ..functions import lexicon as L
from ..functions.value import normalize_value, trace
from ..operators import views
from ..operators.explain import explain
from ..operators.extract import extract_facts, prioritised_pages
from ..operators.relate import candidate_pairs, classify, compare, normalize_facts, relate, summary
from ..scratch import written
from ..sources.statements import pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index: Column, values: list) -> Column:
    """The value at that index, from 0."""
    return F.element_at(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), (index + 1).cast("int"))


def find_period_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, q, m = F.year("o_orderdate") + 20, F.quarter("o_orderdate").cast("string"), F.month("o_orderdate")
    yy, y = F.lpad((y % 100).cast("string"), 2, "0"), y.cast("string")
    half = F.when(m <= 6, "1").otherwise("2")
    word = F.element_at(F.array(*map(F.lit, L.ORDINALS)), F.quarter("o_orderdate"))
    texts = [F.concat(F.lit("up in the "), word, F.lit(" quarter, "), y), F.concat(q, F.lit("Q"), yy, F.lit(" results of 2001")), F.concat(F.lit("in H"), half, F.lit(" FY"), yy), F.concat(F.lit("nine months ended "), y), F.concat(F.lit("Fiscal Year '"), yy), F.concat(F.lit("as of March 5, "), y, F.lit(" and 2003")), F.concat(F.lit("since "), y), "no period at all"]
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", _pick(F.col("o_orderkey") % 8, texts).alias("text"))
    return rows.select("o_orderkey", F.coalesce(find.find_period(F.col("text")), F.lit(L.UNKNOWN_PERIOD)).alias("period"))


def infer_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    lines = [F.concat(F.lit("Northwind "), k, F.lit(" Trading Limited, a company")), F.concat(F.lit("Umbra "), k, F.lit(" announces growth")), F.lit("nothing of the kind")]
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", _pick(F.col("s_suppkey") % 3, lines).alias("line"), F.concat(F.lit("2024_annual-report_acme-unit"), k, F.lit(".v2.pdf")).alias("file"))
    return rows.select("s_suppkey", F.coalesce(find.entity_in_line(F.col("line")), find.entity_of_file(F.col("file"))).alias("entity"))


_SENTENCES = [
    ("Total revenues rose to $%s,000 million", "Total Revenue", "$%s,000 million"), ("EBITDA margin was 2%s.5 %% of sales", "Total Revenue", "2%s.5 %%"), ("Gross margin: $9 or %s%%", "Gross Margin", "%s%%"),
    ("Headcount stood at 1,%s employees", "Headcount", "1,%s employees"), ("Diluted EPS of Rs. %s.25 per share", "Diluted EPS", "Rs. %s.25 per share"), ("Pallet Turns::: 4%s.5", "Pallet Turns", None), ("Free cash flow came to EUR %s bn", "Free Cash Flow", "EUR %s b"), ("only %s words here", None, None),
]


def detect_metric_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = (F.col("p_partkey") % 900 + 100).cast("string")
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.format_string("%s", F.replace(_pick(F.col("p_partkey") % len(_SENTENCES), [s.replace("%%", "%") for s, _, _ in _SENTENCES]), F.lit("%s"), digits)).alias("line"))
    metric = rows.withColumn("metric", find.metric_in(F.col("line"))).withColumn("category", F.when(F.col("metric") == "Headcount", "workforce").otherwise("financial"))
    return metric.select("p_partkey", "metric", find.value_in(F.col("line"), F.col("metric"), F.col("category")).alias("raw_value"))


def context_qualifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = ["net of tax and annualized, excluding one-time gains", "the software tools segment, diluted", "each segment on a constant fx basis", "plain words"]
    text = _pick(F.col("s_suppkey") % 4, phrases)
    return _table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(find.qualifiers(text), "; ").alias("qualifiers"), find.scope_detail(text).alias("scope_detail"))


def normalization_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("s_suppkey") % 900 + 100).cast("string")
    raw = _pick(F.col("s_suppkey") % 4, [F.concat(F.lit("$"), k, F.lit(" million")), F.concat(F.lit("("), k, F.lit(")")), F.concat(k, F.lit(" bps")), F.lit("none")])
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", raw.alias("raw")).select("*", normalize_value(F.col("raw"), F.lit("")).alias("v"))
    return rows.select("s_suppkey", F.array_join(trace(F.col("raw"), F.col("v")), "; ").alias("steps"))


def evidence_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("s_suppkey") % 900 + 100).cast("string")
    said = _pick(F.col("s_suppkey") % 4, [" million was paid", " for 5m shares", " in thousands, or thousand", ""])
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("$"), k).alias("raw"), F.concat(F.lit("$"), k, said).alias("evidence"))
    v = rows.select("s_suppkey", normalize_value(F.col("raw"), F.col("evidence")).alias("v"))
    return v.select("s_suppkey", "v.currency", "v.scale", "v.base_value")


def extract_facts_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_facts(pages(spark, sf_dir)).select("fact_id", "page_number", "entity", "metric", "category", "raw_value", "period", "basis", "statement")


def facts_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = pages(spark, sf_dir)
    return views.page_counts(own, extract_facts(own))


def fact_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.categories(extract_facts(pages(spark, sf_dir)))


def fact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.search_facts(extract_facts(pages(spark, sf_dir)), category="financial", query="Q4 FY2018").select("fact_id", "raw_value")


def document_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = pages(spark, sf_dir)
    return views.document_catalogue(own, extract_facts(own)).select("doc_id", "document_name", "doc_pos", "n_pages", "blank", "n_facts")


def extracted_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = pages(spark, sf_dir)
    facts = extract_facts(own)
    return views.totals(own, facts, relate(facts))


def extracted_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relate(extract_facts(pages(spark, sf_dir))).select("rel_id", "type", "confidence", "entity", "period_label", "variance_percent", "period_case")


def relationship_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.ordinals(relate(extract_facts(pages(spark, sf_dir))).select("rel_id", "priority", "place"))


def relationship_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The explanation of each relationship as flat columns, and its dimension rows as one text."""
    told = explain(relate(extract_facts(pages(spark, sf_dir))))
    rows = F.array_join(F.transform("dimensions", lambda d: F.concat_ws("|", d.dimension, d.fact_a, d.fact_b, d.compatible.cast("string"))), "\n")
    return told.select("rel_id", "metric", "summary", "variance_text", F.array_join("factors", "; ").alias("factors"), rows.alias("dimensions"), F.size("steps").alias("n_steps"))


def page_prioritisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_ord"), "text")
    return prioritised_pages(docs).select("doc_id", "page_ord")


#: Values that dimensions are dealt over in the matrix queries, by the digits of a supplier's key.
_PERIODS = ["FY 2020", "Q1 FY 2020", "Q2 FY 2020", "FY 2021", "", "December 31, 2020", "H1 2020"]
_SCOPES, _BASES = ["Consolidated", "Standalone", "Segment", None], ["Non-GAAP", "GAAP", "Constant Currency", None]
_OPERATIONS, _AUDITS = ["Continuing", "Discontinued", None], ["Restated", "Audited", None]
_PLACES, _ESTIMATES, _GROSS = ["APAC", "Domestic", None], [True, False, None], ["gross", "net", "unspecified", None]
_SAYINGS = ["project approved", "project delayed", "project goes on", "failed, then completed"]


def _paired(spark: SparkSession, sf_dir: str, columns: dict[str, list], raw: str = "$5 million") -> DataFrame:
    """Facts of two documents for each supplier: the columns' values by the digits of the key in the first, of 7 times the key and 3 in the second."""
    sides = []
    for doc in (0, 1):
        code = F.col("s_suppkey") if doc == 0 else F.col("s_suppkey") * 7 + 3
        own = {}
        for name, values in columns.items():
            own[name] = _pick(code % len(values), values)
            code = F.floor(code / len(values))
        sides.append(_table(spark, sf_dir, "supplier").select(F.concat_ws("_", F.lit("f"), F.lit(doc).cast("string"), "s_suppkey").alias("fact_id"), F.lit(doc).alias("doc_pos"), F.lit(1).alias("fact_no"), F.concat(F.lit("Supplier "), F.col("s_suppkey").cast("string")).alias("entity"), F.lit("Total Revenue").alias("metric"), F.lit(raw).alias("raw_value"), F.lit("").alias("evidence"), *(v.alias(n) for n, v in ({"period": F.lit("FY 2020"), "statement": F.lit("")} | own).items())))
    return sides[0].unionByName(sides[1])


def _matrix(spark: SparkSession, sf_dir: str, columns: dict[str, list], raw: str = "$5 million") -> DataFrame:
    own = classify(compare(candidate_pairs(written(normalize_facts(_paired(spark, sf_dir, columns, raw)), "facts"))))
    return own.select(F.expr("cast(substring(fact_a, 5) as bigint)").alias("s_suppkey"), "type", "confidence", F.array_join("reconciling", ",").alias("reconciling"), "period_case")


def period_comparison_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir, {"period": _PERIODS})


def scope_basis_ops_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir, {"scope": _SCOPES, "basis": _BASES, "operations": _OPERATIONS, "audit_status": _AUDITS})


def geo_estimate_gross_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir, {"geography": _PLACES, "is_estimate": _ESTIMATES, "gross_or_net": _GROSS})


def qualitative_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir, {"statement": _SAYINGS, "period": ["FY 2020", ""]}, "on track")


def extracted_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(relate(extract_facts(pages(spark, sf_dir))))


QUERIES = {f.__name__: f for f in (find_period_in_text, infer_entity, detect_metric_value, context_qualifiers, normalization_trace, evidence_scale, extract_facts_dedup, facts_per_page, fact_categories, fact_search, document_catalogue, extracted_totals, extracted_relationships, extracted_summary, relationship_ranking, relationship_report, page_prioritisation, period_comparison_matrix, scope_basis_ops_matrix, geo_estimate_gross_matrix, qualitative_polarity)}

_FACTS = """
WITH volume AS (
  SELECT c_nationkey AS k, year(o_orderdate) + 20 AS y, CAST(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) // 1000000 AS BIGINT) AS h0
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
), told AS (
  SELECT k, y, d, CASE WHEN d = 1 THEN (k + y - 20) % 5 ELSE 0 END AS m, h0 FROM volume, (VALUES (0), (1), (2)) t(d)
), sized AS (
  SELECT *, k * 3 + d AS doc_pos, CASE WHEN d = 2 THEN h0 // 4 WHEN m = 1 THEN h0 + h0 // 200 WHEN m = 2 THEN h0 + h0 // 20 ELSE h0 END AS h FROM told
), lines AS (
  SELECT k, y, d, doc_pos, CASE WHEN y <= 2017 THEN 1 ELSE 2 END AS page, 'Total Revenue' AS metric, 'financial' AS category, m = 3 AS adj, y AS place,
    CASE WHEN m = 4 AND h * 10 >= 1000 THEN '$' || (h * 10 // 1000) || ',' || lpad(CAST(h * 10 % 1000 AS VARCHAR), 3, '0') || ' thousand'
      WHEN h >= 100000 THEN '$' || substr(CAST(h // 100 AS VARCHAR), 1, 3) ELSE '$' || (h // 100) || '.' || lpad(CAST(h % 100 AS VARCHAR), 2, '0') || ' million' END AS raw,
    CASE WHEN m = 4 AND h * 10 >= 1000 THEN CAST(h * 10 AS DOUBLE) * 1e3 WHEN h >= 100000 THEN CAST(substr(CAST(h // 100 AS VARCHAR), 1, 3) AS DOUBLE) * 1e6
      ELSE CAST((h // 100) || '.' || lpad(CAST(h % 100 AS VARCHAR), 2, '0') AS DOUBLE) * 1e6 END AS v
  FROM sized
  UNION ALL
  SELECT k, min(y), d, doc_pos, 2, 'Headcount', 'workforce', FALSE, 9999, (doc_pos + 1000) || ' employees', CAST(substr(CAST(doc_pos + 1000 AS VARCHAR), 1, 3) AS DOUBLE)
  FROM sized GROUP BY k, d, doc_pos HAVING max(y) > 2017
), facts AS (
  SELECT *, row_number() OVER (PARTITION BY doc_pos ORDER BY place) AS fact_no, 'NATION ' || k || ' Holdings Ltd' AS entity,
    CASE WHEN d = 2 THEN 'Q4 FY' || y ELSE 'FY ' || y END AS period, CASE WHEN d = 2 THEN 'FY' || y || '-Q4' ELSE 'FY' || y || '-ANNUAL' END AS pkey,
    CASE WHEN d = 2 THEN 'Q4 FY' || y ELSE 'Full Year FY' || y END AS plabel FROM lines
), named AS (
  SELECT *, 'doc_' || doc_pos || '_p' || page || '_f' || fact_no AS fact_id FROM facts
), pairs AS (
  SELECT a.fact_id AS fact_a, b.fact_id AS fact_b, a.doc_pos AS pa, a.fact_no AS na, b.doc_pos AS pb, b.fact_no AS nb, a.entity, a.metric, a.v AS va, b.v AS vb, a.raw AS ra, b.raw AS rb,
    a.adj AS adj_a, b.adj AS adj_b, a.plabel AS la, b.plabel AS lb, a.pkey = b.pkey AS same, a.y = b.y AND (a.d = 2) <> (b.d = 2) AS interim, a.y <> b.y AS years,
    CASE WHEN a.metric = 'Headcount' THEN FALSE ELSE a.adj <> b.adj END AS adj, CASE WHEN a.pkey = b.pkey THEN a.plabel ELSE a.plabel || ' vs ' || b.plabel END AS period_label
  FROM named a JOIN named b ON a.k = b.k AND a.metric = b.metric AND a.doc_pos < b.doc_pos
), judged AS (
  SELECT *, same AND NOT adj AS comparable, (CASE WHEN same AND NOT adj THEN floor(abs(va - vb) / greatest(va, vb) * 100 * 100 + 0.5) / 100 END)::DOUBLE AS variance_percent FROM pairs
), typed AS (
  SELECT *, 'rel_' || fact_a || '_' || fact_b AS rel_id, CASE WHEN same THEN 'exact' WHEN interim THEN 'interim' ELSE 'fiscal_year' END AS period_case,
    CASE WHEN comparable AND variance_percent <= 1 THEN 'CORROBORATED' WHEN comparable THEN 'CONTRADICTED' WHEN interim OR adj THEN 'RECONCILED BY CONTEXT' ELSE 'UNCERTAIN' END AS type FROM judged
)
"""
_CONFIDENCE = "CASE type WHEN 'CORROBORATED' THEN 0.98 WHEN 'CONTRADICTED' THEN 0.95 WHEN 'RECONCILED BY CONTEXT' THEN 0.92 ELSE 0.65 END::DOUBLE"
_PRIORITY = "CASE type WHEN 'CONTRADICTED' THEN 1 WHEN 'RECONCILED BY CONTEXT' THEN 2 WHEN 'CORROBORATED' THEN 3 ELSE 4 END"


def _q(value) -> str:
    return "NULL" if value is None else str(value).upper() if isinstance(value, bool) else "'" + value.replace("'", "''") + "'"


def _sides(columns: dict[str, list]) -> str:
    """CTE s: for each supplier the columns' values in both documents, as name_a and name_b."""
    out = []
    for side, code in (("a", "s_suppkey"), ("b", "(s_suppkey * 7 + 3)")):
        step = 1
        for name, values in columns.items():
            out.append(f"([{', '.join(map(_q, values))}])[({code} // {step}) % {len(values)} + 1] AS {name}_{side}")
            step *= len(values)
    return f"WITH s AS (SELECT s_suppkey, {', '.join(out)} FROM supplier)"


def _reconciled(rules: list[tuple[str, str]], rest: str = "") -> str:
    """Final SELECT of a matrix whose values agree (5 million each) in one period."""
    listed = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in rules)
    return f""", r AS (SELECT s_suppkey, array_to_string(list_filter([{listed}], lambda x: x IS NOT NULL), ',') AS reconciling FROM s)
      SELECT s_suppkey, CASE WHEN reconciling = '' THEN 'CORROBORATED' ELSE 'RECONCILED BY CONTEXT' END AS type, CASE WHEN reconciling = '' THEN 0.98 ELSE 0.92 END::DOUBLE AS confidence, reconciling, 'exact' AS period_case FROM r"""


_DETECT = " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else "replace(" + _q(v.replace("%%", "%")) + ", '%s', d)") for i, (_, _, v) in enumerate(_SENTENCES))

ORACLE_SQL = {
    "find_period_in_text": """WITH t AS (SELECT o_orderkey, CAST(year(o_orderdate) + 20 AS INT) AS y, quarter(o_orderdate) AS q, CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 2 END AS h FROM orders)
      SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'Q' || q || ' FY' || y WHEN 1 THEN 'Q' || q || ' FY' || y WHEN 2 THEN 'H' || h || ' FY' || y WHEN 3 THEN '9M FY' || y WHEN 4 THEN 'FY ' || y WHEN 5 THEN 'March 5, ' || y WHEN 6 THEN 'FY ' || y ELSE 'Unspecified Period' END AS period FROM t""",
    "infer_entity": "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'Northwind ' || s_suppkey || ' Trading Limited, a company' WHEN 1 THEN 'Umbra ' || s_suppkey ELSE 'Acme Unit' || s_suppkey || '.v2' END AS entity FROM supplier",
    "detect_metric_value": f"WITH t AS (SELECT p_partkey, CAST(p_partkey % 900 + 100 AS VARCHAR) AS d, p_partkey % {len(_SENTENCES)} AS i FROM part) SELECT p_partkey, ([{', '.join(_q(m) for _, m, _ in _SENTENCES)}])[i + 1] AS metric, CASE i {_DETECT} END AS raw_value FROM t",
    "context_qualifiers": "SELECT s_suppkey, (['Net of tax; Annualized; excluding one', 'Diluted', 'Constant FX', NULL])[s_suppkey % 4 + 1] AS qualifiers, ([NULL, 'The Software Tools', NULL, NULL])[s_suppkey % 4 + 1] AS scope_detail FROM supplier",
    "normalization_trace": """WITH t AS (SELECT s_suppkey, s_suppkey % 900 + 100 AS n FROM supplier)
      SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Read "$' || n || ' million"; Currency: USD; Unit: USD, a currency; Scale: times 1,000,000; Base value: ' || n || ',000,000 USD'
        WHEN 1 THEN 'Read "(' || n || ')"; Unit: text, a text; Negative by its sign or brackets; Base value: -' || n || ' text'
        WHEN 2 THEN 'Read "' || n || ' bps"; Unit: percent, a percentage; Basis points are hundredths of a percent; Base value: ' || rtrim(rtrim((n // 100) || '.' || lpad(CAST(n % 100 AS VARCHAR), 2, '0'), '0'), '.') || ' percent'
        ELSE 'Read "none"; Unit: text, a text; No number' END AS steps FROM t""",
    "evidence_scale": "WITH t AS (SELECT s_suppkey, CAST(s_suppkey % 900 + 100 AS DOUBLE) AS n, ([1e6, 1.0, 1e3, 1.0])[s_suppkey % 4 + 1]::DOUBLE AS scale FROM supplier) SELECT s_suppkey, 'USD' AS currency, scale, n * scale AS base_value FROM t",
    "extract_facts_dedup": _FACTS + """SELECT fact_id, page AS page_number, entity, metric, category, raw AS raw_value, period, CASE WHEN adj THEN 'Non-GAAP' END AS basis,
      entity || ' reported ' || metric || ' of ' || raw || ' for ' || period || CASE WHEN adj THEN ' on a Non-GAAP basis' ELSE '' END || '.' AS statement FROM named""",
    "facts_per_page": _FACTS + ", p AS (SELECT DISTINCT doc_pos, CASE WHEN y <= 2017 THEN 1 ELSE 2 END AS page FROM sized) SELECT 'doc_' || p.doc_pos AS doc_id, p.page AS page_number, count(named.fact_id) AS n_facts FROM p LEFT JOIN named ON p.doc_pos = named.doc_pos AND p.page = named.page GROUP BY p.doc_pos, p.page",
    "fact_categories": _FACTS + "SELECT category, count(*) AS n_facts, arg_min(doc_pos, doc_pos * 1000 + fact_no) AS first_doc, CAST(arg_min(fact_no, doc_pos * 1000 + fact_no) AS INT) AS first_no FROM named GROUP BY category",
    "fact_search": _FACTS + "SELECT fact_id, raw AS raw_value FROM named WHERE category = 'financial' AND d = 2 AND y = 2018",
    "document_catalogue": _FACTS + "SELECT 'doc_' || doc_pos AS doc_id, 'report_' || doc_pos || '.pdf' AS document_name, doc_pos, count(DISTINCT page) AS n_pages, FALSE AS blank, count(*) AS n_facts FROM named GROUP BY doc_pos",
    "extracted_totals": _FACTS + "SELECT (SELECT count(DISTINCT doc_pos) FROM sized) AS n_documents, (SELECT count(*) FROM named) AS n_facts, count(*) FILTER (WHERE type = 'CONTRADICTED') AS n_contradicted, count(*) FILTER (WHERE type = 'RECONCILED BY CONTEXT') AS n_reconciled, count(*) FILTER (WHERE type = 'CORROBORATED') AS n_corroborated, count(*) FILTER (WHERE type = 'UNCERTAIN') AS n_uncertain FROM typed",
    "extracted_relationships": _FACTS + f"SELECT rel_id, type, {_CONFIDENCE} AS confidence, entity, period_label, variance_percent, period_case FROM typed",
    "extracted_summary": _FACTS + ", k(type) AS (VALUES ('CONTRADICTED'), ('RECONCILED BY CONTEXT'), ('CORROBORATED'), ('UNCERTAIN')), n AS (SELECT k.type, count(typed.type) AS n FROM k LEFT JOIN typed ON k.type = typed.type GROUP BY 1) SELECT type, n, CAST(coalesce(floor(100 * n / nullif(sum(n) OVER (), 0)::DOUBLE + 0.5), 0) AS BIGINT) AS percent FROM n",
    "relationship_ranking": _FACTS + f"SELECT rel_id, row_number() OVER (ORDER BY {_PRIORITY}, pa, na, pb, nb) AS ordinal FROM typed",
    "relationship_report": _FACTS + """, w AS (SELECT *, CASE WHEN metric = 'Headcount' THEN 'Workforce Headcount' ELSE 'Revenue Total' END AS label, format('{:.2f}', variance_percent) || '%' AS pct,
        array_to_string(list_filter([CASE WHEN interim THEN 'an interim period against the full year' END, CASE WHEN adj THEN 'an adjusted figure against a reported one' END], lambda x: x IS NOT NULL), '; ') AS why FROM typed)
      SELECT rel_id, label AS metric, CASE type WHEN 'CORROBORATED' THEN label || ' of ' || period_label || ': the documents agree (' || pct || ' apart)' WHEN 'CONTRADICTED' THEN label || ' of ' || period_label || ': the documents conflict (' || pct || ' apart)'
          WHEN 'RECONCILED BY CONTEXT' THEN label || ': the difference is explained by ' || why ELSE label || ': can''t be compared, different fiscal years' END AS summary,
        CASE WHEN comparable THEN pct WHEN why <> '' THEN 'not comparable: ' || string_split(why, '; ')[1] ELSE 'not comparable: different fiscal years' END AS variance_text, why AS factors,
        'metric|' || metric || '|' || metric || '|true' || chr(10) || CASE WHEN metric = 'Headcount' THEN 'unit|count|count|true' ELSE 'currency|USD|USD|true' END || chr(10) || 'period|' || la || '|' || lb || '|' || same || chr(10)
          || 'scope|Consolidated|Consolidated|true' || chr(10) || 'basis|' || CASE WHEN adj_a THEN 'Non-GAAP' ELSE 'Standard' END || '|' || CASE WHEN adj_b THEN 'Non-GAAP' ELSE 'Standard' END || '|' || (NOT adj) || chr(10) || 'operations|Total|Total|true' AS dimensions,
        CAST(CASE WHEN comparable THEN 5 ELSE 3 END AS INT) AS n_steps FROM w""",
    "page_prioritisation": f"""WITH t AS (SELECT source AS doc_id, doc_id AS page_ord, coalesce(regexp_matches(text, {_q(rf'(?i){L.DATA_WORDS}')}), FALSE) AS has FROM documents),
      n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, sum(CAST(has AS INT)) OVER (PARTITION BY doc_id) AS w, sum(CAST(has AS INT)) OVER (PARTITION BY doc_id ORDER BY page_ord ROWS UNBOUNDED PRECEDING) AS r, row_number() OVER (PARTITION BY doc_id ORDER BY page_ord) AS i FROM t)
      SELECT doc_id, page_ord FROM n WHERE n <= 15 OR CASE WHEN w >= 3 THEN has AND r <= 15 ELSE i <= 15 END""",
    "period_comparison_matrix": f"""WITH p(i, kind, key, fy, q) AS (VALUES (0, 'full', 'A', 2020, 0), (1, 'part', 'Q1', 2020, 1), (2, 'part', 'Q2', 2020, 2), (3, 'full', 'B', 2021, 0), (4, '', 'unspecified', NULL, NULL), (5, 'date', 'D', NULL, NULL), (6, 'part', 'H1', 2020, 0)),
      s AS (SELECT s_suppkey, a.kind AS ka, b.kind AS kb, a.key AS xa, b.key AS xb, a.fy AS fa, b.fy AS fb, a.q AS qa, b.q AS qb FROM supplier JOIN p a ON s_suppkey % {len(_PERIODS)} = a.i JOIN p b ON (s_suppkey * 7 + 3) % {len(_PERIODS)} = b.i),
      c AS (SELECT s_suppkey, CASE WHEN xa = xb AND xa <> 'unspecified' THEN 'exact' WHEN xa = 'unspecified' OR xb = 'unspecified' THEN 'undated' WHEN fa = fb AND ((ka = 'part' AND kb = 'full') OR (ka = 'full' AND kb = 'part')) THEN 'interim'
        WHEN fa <> fb THEN 'fiscal_year' WHEN qa > 0 AND qb > 0 AND qa <> qb THEN 'quarter' ELSE 'timeframe' END AS period_case FROM s)
      SELECT s_suppkey, CASE period_case WHEN 'exact' THEN 'CORROBORATED' WHEN 'interim' THEN 'RECONCILED BY CONTEXT' ELSE 'UNCERTAIN' END AS type, CASE period_case WHEN 'exact' THEN 0.98 WHEN 'interim' THEN 0.92 ELSE 0.65 END::DOUBLE AS confidence,
        CASE period_case WHEN 'interim' THEN 'period' ELSE '' END AS reconciling, period_case FROM c""",
    "scope_basis_ops_matrix": _sides({"scope": _SCOPES, "basis": _BASES, "operations": _OPERATIONS, "audit_status": _AUDITS})
    + _reconciled([
        ("scope", "(coalesce(scope_a, 'Consolidated') = 'Consolidated' AND scope_b = 'Standalone') OR (scope_a = 'Standalone' AND coalesce(scope_b, 'Consolidated') = 'Consolidated')"),
        ("segment", "(scope_a IS NOT DISTINCT FROM 'Segment') <> (scope_b IS NOT DISTINCT FROM 'Segment')"),
        ("basis", "(basis_a IS NOT DISTINCT FROM 'Non-GAAP') <> (basis_b IS NOT DISTINCT FROM 'Non-GAAP')"),
        ("constant_currency", "(basis_a IS NOT DISTINCT FROM 'Non-GAAP') = (basis_b IS NOT DISTINCT FROM 'Non-GAAP') AND (basis_a IS NOT DISTINCT FROM 'Constant Currency') <> (basis_b IS NOT DISTINCT FROM 'Constant Currency')"),
        ("operations", "(operations_a IS NOT DISTINCT FROM 'Continuing') <> (operations_b IS NOT DISTINCT FROM 'Continuing')"),
        ("audit", "(audit_status_a IS NOT DISTINCT FROM 'Restated') <> (audit_status_b IS NOT DISTINCT FROM 'Restated')"),
    ]),
    "geo_estimate_gross_matrix": _sides({"geography": _PLACES, "is_estimate": _ESTIMATES, "gross_or_net": _GROSS})
    + _reconciled([("geography", "geography_a <> geography_b"), ("estimate", "is_estimate_a <> is_estimate_b"), ("gross_net", "gross_or_net_a <> gross_or_net_b AND gross_or_net_a <> 'unspecified' AND gross_or_net_b <> 'unspecified'")]),
    "qualitative_polarity": _sides({"statement": _SAYINGS, "period": ["FY 2020", ""]}) + """, p AS (SELECT s_suppkey, period_a = 'FY 2020' AND period_b = 'FY 2020' AS same,
        (regexp_matches(statement_a, 'delayed|failed') AND regexp_matches(statement_b, 'approved|completed')) OR (regexp_matches(statement_a, 'approved|completed') AND regexp_matches(statement_b, 'delayed|failed')) AS opposed FROM s)
      SELECT s_suppkey, CASE WHEN NOT same THEN 'UNCERTAIN' WHEN opposed THEN 'CONTRADICTED' ELSE 'CORROBORATED' END AS type, CASE WHEN NOT same THEN 0.65 WHEN opposed THEN 0.88 ELSE 0.84 END::DOUBLE AS confidence, '' AS reconciling, CASE WHEN same THEN 'exact' ELSE 'undated' END AS period_case FROM p""",
}
