"""The catalogue's queries in DuckDB SQL. Word lists come from the lexicon; the control flow is written anew."""

from __future__ import annotations

from ..functions import lexicon as L
from .catalogue import METRICS


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _cases(column: str, rules: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, {_q(rf'(?i)\b(?:{words})\b')}) THEN {_q(name)}" for name, words in rules) + f" ELSE {default} END"


_VALUE = r"""
CASE WHEN r LIKE '$%' THEN 'USD' WHEN r LIKE '€%' THEN 'EUR' WHEN r LIKE '%£%' THEN 'GBP' WHEN r LIKE 'Rs %' THEN 'INR' END AS cur,
TRY_CAST(replace(regexp_extract(r, '(\d{1,3}(?:,\d{3})*(?:\.\d+)?|\d+(?:\.\d+)?)', 1), ',', '') AS DOUBLE) * CASE WHEN r LIKE '(%)' THEN -1 ELSE 1 END AS num,
CASE WHEN r LIKE '%million' THEN 1e6 WHEN r LIKE '%bn' THEN 1e9 WHEN r LIKE '% Cr' THEN 1e7 WHEN r LIKE '%thousand' THEN 1e3 ELSE 1.0 END::DOUBLE AS sc
"""
_MONEY = """r AS raw_value, num AS numeric_value,
CASE WHEN r LIKE '%bps' THEN 'percent' WHEN cur IS NOT NULL THEN cur WHEN r LIKE '%employees' THEN 'count' ELSE 'text' END AS unit,
cur AS currency,
CASE WHEN r LIKE '%bps' THEN 'percentage' WHEN cur IS NOT NULL THEN 'currency' WHEN r LIKE '%employees' THEN 'count' ELSE 'text' END AS unit_type,
CASE WHEN r LIKE '%bps' THEN 0.01 ELSE sc END::DOUBLE AS scale,
CASE WHEN r LIKE '%bps' THEN num * 0.01::DOUBLE ELSE num * sc END AS base_value"""

_FACTS = """
WITH volume AS (
  SELECT c_nationkey AS k, year(o_orderdate) AS y, CAST(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) // 1000000 AS BIGINT) AS h
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
), told AS (
  SELECT k, y, d, CASE WHEN d = 1 THEN (k + y) % 5 ELSE 0 END AS m, h AS h0 FROM volume, (VALUES (0), (1), (2)) t(d)
), facts AS (
  SELECT k, y, d, m, k * 3 + d AS doc_pos, 'f_' || k || '_' || d || '_' || y AS fact_id,
    CASE WHEN d = 2 THEN h0 // 4 WHEN m = 1 THEN h0 + h0 // 200 WHEN m = 2 THEN h0 + h0 // 20 ELSE h0 END AS h FROM told
), valued AS (
  SELECT *, CASE WHEN m = 4 AND h * 10 >= 1000 THEN CAST(h * 10 AS DOUBLE) * 1e3
    WHEN h // 100 >= 1000 THEN CAST(substr(CAST(h // 100 AS VARCHAR), 1, 3) AS DOUBLE) * 1e6 ELSE CAST((h // 100) || '.' || lpad(CAST(h % 100 AS VARCHAR), 2, '0') AS DOUBLE) * 1e6 END AS v,
    CASE WHEN d = 2 THEN 'FY' || y || '-Q4' ELSE 'FY' || y || '-ANNUAL' END AS pkey,
    CASE WHEN d = 2 THEN 'Q4 FY' || y ELSE 'Full Year FY' || y END AS plabel
  FROM facts
), pairs AS (
  SELECT a.fact_id AS fact_a, b.fact_id AS fact_b, a.k AS k, a.v AS va, b.v AS vb, a.pkey = b.pkey AS same,
    a.y = b.y AND (a.d = 2) <> (b.d = 2) AS interim, (a.m = 3) <> (b.m = 3) AS adj,
    CASE WHEN a.pkey = b.pkey THEN a.plabel ELSE a.plabel || ' vs ' || b.plabel END AS period_label
  FROM valued a JOIN valued b ON a.k = b.k AND a.doc_pos < b.doc_pos
), judged AS (
  SELECT *, same AND NOT adj AS comparable,
    CASE WHEN same AND NOT adj THEN CASE WHEN greatest(va, vb) > 0 THEN floor(abs(va - vb) / greatest(va, vb) * 100 * 100 + 0.5) / 100 ELSE 0 END END AS variance_percent
  FROM pairs
), typed AS (
  SELECT *, CASE WHEN comparable AND variance_percent <= 1 THEN 'CORROBORATED' WHEN comparable THEN 'CONTRADICTED' WHEN interim OR adj THEN 'RECONCILED BY CONTEXT' ELSE 'UNCERTAIN' END AS type FROM judged
)
"""
_STOP = "', '".join(L.STOPWORDS)
_TOKENS = "list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda t: length(t) > 1 AND t NOT IN ('" + _STOP + "'))"
_CONCEPT = {
    "Total Revenue": ("revenue_total", "revenue", "financial"), "Net Income": ("net_profit", "profit_net", "financial"), "Adjusted EBITDA": ("ebitda_adjusted", "profit_ebitda", "financial"),
    "Gross Margin": ("margin_gross", "margin", "financial"), "EBITDA Margin": ("margin_ebitda", "margin", "financial"), "Diluted EPS": ("eps_diluted", "per_share", "financial"), "Basic EPS": ("eps_basic", "per_share", "financial"),
    "Revenue Growth": ("growth_revenue_growth", "growth_rate", "financial"), "Free Cash Flow": ("free_cash_flow", "cash_flow_fcf", "financial"), "Capex": ("capex", "capex", "financial"), "Total Assets": ("total_assets", "assets_total", "financial"),
    "Non-current assets": ("current_assets", "assets_current", "financial"), "Net Debt": ("net_debt", "debt_net", "financial"), "Headcount": ("workforce_headcount", "workforce", "workforce"), "Active Users": ("customers_count", "customers", "operational"),
    "Order Book": ("contractual_backlog", "backlog", "financial"), "Scope 2 Emissions": ("emissions_scope_2", "esg_emissions", "environmental"), "Clean Energy Share": ("renewable_energy", "esg_energy", "environmental"), "Pending Litigation": ("contingent_liability", "contingency", "financial"),
    "Attrition Rate": ("ratio_attrition_rate", "ratio", "workforce"), "Express Parcel Revenue": ("revenue_segment", "revenue", "financial"), "Operating Income": ("operating_profit", "profit_operating", "financial"), "Profit Before Tax": ("profit_before_tax", "profit_pbt", "financial"),
    "Finance Cost": ("expense_finance", "expense_finance", "financial"), "Widget Quality Index": ("generic_widget_quality_index", "domain_widget", "financial"), "Other Income": ("other_income", "income_other", "financial"), "Total Income": ("total_income", "income_total", "financial"),
    "R&D": ("expense_rd", "expense_rd", "financial"), "Tax Provision": ("expense_tax", "expense_tax", "financial"), "Shareholders Equity": ("total_equity", "equity", "financial"),
}

ORACLE_SQL = {
    "scan_pages_lines": r"""SELECT doc_id, CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS n_lines,
      CAST(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')) >= 8)) AS BIGINT) AS n_candidates FROM documents""",
    "page_blank_check": "SELECT source, bool_and(trim(coalesce(text, '')) = '') AS all_blank, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) AS pages FROM documents GROUP BY source",
    "canonical_entities": rf"""WITH n AS (SELECT c_name || ' Holdings, Inc.' AS name FROM customer UNION ALL SELECT s_name || ' Group PLC' FROM supplier UNION ALL SELECT n_name || ' Co-op Ltd' FROM nation),
      k AS (SELECT name, regexp_replace(regexp_replace(regexp_replace(lower(name), '\b(?:{L.CORPORATE})\b', '', 'g'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS e FROM n)
      SELECT name, CASE WHEN length(e) >= 2 THEN e ELSE 'primary_entity' END AS entity_key FROM k""",
    "metric_tokens": f"SELECT item_id, array_to_string({_TOKENS.format('text')}, ' ') AS tokens FROM benchmark",
    "token_jaccard_pairs": f"""WITH n AS (SELECT DISTINCT p_name, list_distinct({_TOKENS.format('p_name')}) AS t FROM part)
      SELECT a.p_name AS a, b.p_name AS b, len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))::DOUBLE AS similarity
      FROM n a JOIN n b ON a.p_name < b.p_name WHERE len(list_intersect(a.t, b.t)) > 0""",
    "normalize_money": f"""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '$' || o_custkey || ' million' WHEN 1 THEN '€' || o_custkey || 'bn' WHEN 2 THEN 'Rs ' || o_custkey || ' Cr' WHEN 3 THEN '(£' || o_custkey || ')' WHEN 4 THEN o_custkey || ' bps' ELSE o_custkey || ' employees' END AS r FROM orders),
      v AS (SELECT *, {_VALUE} FROM t) SELECT o_orderkey, {_MONEY} FROM v""",
    "normalize_negative": f"""WITH t AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '(' || x || ')' ELSE x END AS r FROM (SELECT *, (abs(trunc(c_acctbal * 100))::BIGINT // 100) || '.' || lpad(CAST(abs(trunc(c_acctbal * 100))::BIGINT % 100 AS VARCHAR), 2, '0') AS x FROM customer)),
      v AS (SELECT *, {_VALUE} FROM t) SELECT c_custkey, {_MONEY} FROM v""",
    "normalize_periods": """WITH t AS (SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 2 END AS h, strftime(o_orderdate, '%Y-%m-%d') AS iso, o_orderkey % 8 AS k FROM orders)
      SELECT o_orderkey,
        CASE k WHEN 0 THEN 'Q' || q || ' FY' || y WHEN 1 THEN 'H' || h || ' ' || y WHEN 2 THEN 'nine months ended ' || y WHEN 3 THEN 'TTM ' || y WHEN 4 THEN 'Fiscal Year ' || y WHEN 5 THEN iso WHEN 6 THEN 'March 5, ' || y ELSE 'since ' || y END AS period,
        CASE k WHEN 0 THEN 'quarter' WHEN 1 THEN 'half_year' WHEN 2 THEN 'nine_months' WHEN 3 THEN 'trailing_twelve_months' WHEN 4 THEN 'full_year' WHEN 5 THEN 'point_in_time' WHEN 6 THEN 'point_in_time' ELSE 'full_year' END AS type,
        CASE k WHEN 0 THEN 'FY' || y || '-Q' || q WHEN 1 THEN 'FY' || y || '-H' || h WHEN 2 THEN 'FY' || y || '-9M' WHEN 3 THEN 'TTM-' || y WHEN 5 THEN iso WHEN 6 THEN y || '-03-05' ELSE 'FY' || y || '-ANNUAL' END AS key,
        CASE k WHEN 0 THEN 'Q' || q || ' FY' || y WHEN 1 THEN 'H' || h || ' FY' || y WHEN 2 THEN '9M FY' || y WHEN 3 THEN 'TTM ' || y WHEN 4 THEN 'Full Year FY' || y WHEN 5 THEN 'As of ' || iso WHEN 6 THEN 'As of March 5, ' || y ELSE 'FY' || y END AS label,
        CAST(CASE WHEN k IN (5, 6) THEN NULL ELSE y END AS INTEGER) AS fiscal_year FROM t""",
    "classify_concepts": "WITH c(i, metric, concept_id, concept_family, category) AS (VALUES " + ", ".join(f"({i}, {_q(m)}, " + ", ".join(map(_q, _CONCEPT[m])) + ")" for i, m in enumerate(METRICS)) + f") SELECT p_partkey, metric, concept_id, concept_family, category FROM part JOIN c ON p_partkey % {len(METRICS)} = i",
    "context_dimensions": f"""WITH t AS (SELECT s_suppkey, (['consolidated gaap audited', 'standalone ifrs unaudited target', 'segment non-gaap restated gross', 'group net discontinued europe', 'adjusted parent continuing india', 'worldwide forecast gross and net', 'plain words'])[s_suppkey % 7 + 1] AS phrase FROM supplier)
      SELECT s_suppkey, phrase, {_cases('phrase', L.BASES, 'NULL')} AS basis, {_cases('phrase', L.SCOPES, 'NULL')} AS scope,
        CASE WHEN regexp_matches(phrase, '\\bcontinuing\\b') THEN 'Continuing' WHEN regexp_matches(phrase, '\\bdiscontinued\\b') THEN 'Discontinued' ELSE 'Total' END AS operations,
        CASE WHEN regexp_matches(phrase, '\\baudited\\b') THEN 'Audited' WHEN phrase LIKE '%unaudited%' THEN 'Unaudited' WHEN phrase LIKE '%restated%' THEN 'Restated' END AS audit_status,
        {_cases('phrase', L.GEOGRAPHIES, 'NULL')} AS geography, regexp_matches(phrase, {_q(rf'\b(?:{L.ESTIMATES})\b')}) AS is_estimate,
        CASE WHEN phrase LIKE '%gross and net%' THEN NULL WHEN regexp_matches(phrase, '\\bgross\\b') THEN 'gross' WHEN regexp_matches(phrase, '\\bnet\\b') THEN 'net' END AS gross_or_net FROM t""",
    "variance_tolerance": """WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_quantity + l_discount AS b FROM lineitem),
      v AS (SELECT *, CASE WHEN greatest(abs(a), abs(b)) > 0 THEN floor(abs(a - b) / greatest(abs(a), abs(b)) * 100 * 100 + 0.5) / 100 ELSE 0 END::DOUBLE AS variance_percent FROM t)
      SELECT l_orderkey, l_linenumber, variance_percent, variance_percent <= 1 AS "within" FROM v""",
    "candidate_pairs_count": _FACTS + "SELECT 'nation_' || k AS entity_key, 'revenue' AS family, count(*) AS pairs FROM typed GROUP BY k",
    "comparison_matrix": _FACTS + "SELECT array_to_string(list_filter([CASE WHEN interim THEN 'period' END, CASE WHEN adj THEN 'basis' END], lambda x: x IS NOT NULL), ',') AS reconciling, CASE WHEN same THEN '' ELSE 'period' END AS reasons, comparable, count(*) AS pairs FROM typed GROUP BY 1, 2, 3",
    "classify_relationships": _FACTS + "SELECT 'rel_' || fact_a || '_' || fact_b AS rel_id, type, CASE type WHEN 'CORROBORATED' THEN 0.98 WHEN 'CONTRADICTED' THEN 0.95 WHEN 'UNCERTAIN' THEN 0.65 ELSE 0.92 END::DOUBLE AS confidence, fact_a, fact_b, 'revenue_total' AS concept_id, period_label, variance_percent::DOUBLE AS variance_percent FROM typed",
    "relationship_summary": _FACTS + ", k(type) AS (VALUES ('CONTRADICTED'), ('RECONCILED BY CONTEXT'), ('CORROBORATED'), ('UNCERTAIN')), n AS (SELECT k.type, count(typed.type) AS n FROM k LEFT JOIN typed ON k.type = typed.type GROUP BY 1) SELECT type, n, CAST(coalesce(floor(100 * n / nullif(sum(n) OVER (), 0)::DOUBLE + 0.5), 0) AS BIGINT) AS percent FROM n",
    "relationship_search": _FACTS + "SELECT 'rel_' || fact_a || '_' || fact_b AS rel_id, period_label, variance_percent::DOUBLE AS variance_percent FROM typed WHERE type = 'CONTRADICTED' AND contains(lower(period_label), '1997')",
    "facts_per_document": _FACTS + ", docs AS (SELECT DISTINCT n_nationkey * 3 + d AS doc_pos FROM nation, (VALUES (0), (1), (2), (3)) t(d)) SELECT docs.doc_pos, count(valued.fact_id) AS n_facts FROM docs LEFT JOIN valued ON docs.doc_pos = valued.doc_pos GROUP BY 1",
}
