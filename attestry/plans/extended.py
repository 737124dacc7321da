"""Queries over what stands around the relationships: wildcards, known currencies, repeated ids, model answers, page files, arrivals, nested results, cards, SQL functions. Each has its SQL beside it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import sql
from ..functions.concept import concept_fields
from ..functions.value import normalize_value
from ..operators import views
from ..operators.explain import explain
from ..operators.extract import NOTICES, extract_facts, extraction_status, extraction_summary, model_facts, prompts
from ..operators.relate import classify, compare, candidate_pairs, normalize_facts, relate, summary
from ..scratch import numbered, root, written
from ..sources.datasource import PageSource
from ..sources.pages import read_json
from ..sources.statements import pages
from ..streaming.incremental import relate_stream, stored
from .catalogue import METRICS
from .extracted import _CONFIDENCE, _FACTS, _paired, _pick, _q, _table
from .extracted import ORACLE_SQL as EXTRACTED
from .oracle import _CONCEPT
from .oracle import ORACLE_SQL as BASIC


def _folder(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


def incremental_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages arrive in three micro-batches of a stream, documents whole; the store then holds what one run finds."""
    arriving, store = _folder(spark, "arriving"), _folder(spark, "store")
    own = pages(spark, sf_dir)
    own.repartition(3, "doc_id").write.parquet(arriving)
    relate_stream(spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 1).parquet(arriving), store).awaitTermination()
    return stored(spark, store).select("rel_id", "type", "confidence", "entity", "period_label", "variance_percent", "period_case")


def _page_files(spark: SparkSession, sf_dir: str) -> str:
    """The pages as JSON files, one for each ten documents, each a whole {documents: [...]}."""
    page = F.struct(F.col("page_number").alias("pageNumber"), "text", "page_ord")
    docs = pages(spark, sf_dir).groupBy("doc_pos", "document_name").agg(F.array_sort(F.collect_list(F.struct("page_ord", page.alias("p")))).alias("l"))
    doc = F.struct("doc_pos", F.struct(F.col("document_name").alias("filename"), F.transform("l", lambda x: x.p).alias("pages")).alias("d"))
    files = docs.groupBy(F.lpad(F.floor(F.col("doc_pos") / 10).cast("string"), 12, "0").alias("part")).agg(F.transform(F.array_sort(F.collect_list(doc)), lambda x: x.d).alias("documents"))
    folder = _folder(spark, "page-files")
    files.write.partitionBy("part").json(folder)
    return folder


def json_page_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_json(spark, _page_files(spark, sf_dir)).select("doc_pos", "document_name", "page_ord", "page_number", F.length("text").alias("n_chars"))


def json_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(relate(extract_facts(read_json(spark, _page_files(spark, sf_dir)))))


def page_source_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.dataSource.register(PageSource)
    return summary(relate(extract_facts(spark.read.format("pages").load(_page_files(spark, sf_dir).removeprefix("file://")))))


def wildcard_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two documents' facts; each fifth supplier's name is nothing but corporate words, so that its facts meet all others."""
    facts = _paired(spark, sf_dir, {})
    entity = F.when(F.regexp_extract("entity", r"(\d+)", 1).cast("long") % 5 == 0, "Holdings Group Inc.").otherwise(F.col("entity"))
    return relate(facts.withColumn("entity", entity)).select("fact_a", "fact_b", "type")


def currency_unit_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _paired(spark, sf_dir, {"said": _AMOUNTS}).drop("raw_value").withColumnRenamed("said", "raw_value")
    own = classify(compare(candidate_pairs(written(normalize_facts(facts), "facts"))))
    return own.select(F.expr("cast(substring(fact_a, 5) as bigint)").alias("s_suppkey"), "type", "confidence", F.array_join("reasons", ",").alias("reasons"))


_AMOUNTS = ["$5 million", "€5 million", "5%", "bps", "5%"]


def known_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", F.concat((k % 900 + 100).cast("string"), F.lit(" million")).alias("raw"), _pick(k % 4, ["EUR", "", None, None]).alias("currency"), _pick(k % 4, ["pounds", "yen", "Rupee", "widgets"]).alias("unit"))
    v = rows.select("s_suppkey", normalize_value(F.col("raw"), F.lit(""), F.col("currency"), F.col("unit")).alias("v"))
    return v.select("s_suppkey", "v.currency", "v.unit_type", "v.base_value")


def distinct_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that stand twice under one id are related once."""
    facts = _paired(spark, sf_dir, {})
    twice = facts.unionByName(facts.withColumn("fact_no", F.col("fact_no") + 1))
    return relate(twice, repeated_ids=True).select("rel_id", "type")


def valid_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts without an id or a document take no part."""
    k = F.col("fact_no")
    facts = _paired(spark, sf_dir, {}).withColumn("fact_no", F.regexp_extract("fact_id", r"(\d+)$", 1).cast("int"))
    odd = facts.withColumn("fact_id", F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.col("fact_id"))).withColumn("doc_pos", F.when(k % 5 > 0, F.col("doc_pos")))
    return relate(odd).select("rel_id", "type")


def standard_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_facts(extract_facts(pages(spark, sf_dir))).select("fact_id", "canonical_metric", "standard_key")


def extracted_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_facts(pages(spark, sf_dir)).select("fact_id", "scope", "operations", "currency", "unit", "notes", "confidence")


def concept_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").select("p_partkey", _pick(F.col("p_partkey") % len(METRICS), METRICS).alias("metric"), F.when(F.col("p_partkey") % 3 == 0, "Retail").alias("detail"))
    return rows.select("p_partkey", concept_fields(F.col("metric"), F.lit(""), F.lit(None).cast("string"), F.col("detail")).alias("c")).select("p_partkey", "c.*")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answers for the nations' documents: facts, none at all, no JSON, nothing for want of quota, no row."""
    docs = pages(spark, sf_dir).select("doc_id", "doc_pos").distinct()
    said = F.concat(F.lit('[{"pageNumber": 9, "metric": "Total Revenue", "category": "Financial", "rawValue": "$'), F.col("doc_pos").cast("string"), F.lit(' million", "evidenceText": "audited group figure", "notes": "n"}, null]'))
    case = F.col("doc_pos") % 5
    return docs.filter(case < 4).select("doc_id", F.when(case == 0, said).when(case == 1, "[]").when(case == 2, "no json").alias("payload"), F.when(case == 3, "exhausted").alias("problem"))


def extraction_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction_status(pages(spark, sf_dir), _answers(spark, sf_dir))


def first_notice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction_summary(extraction_modes(spark, sf_dir))


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = model_facts(_answers(spark, sf_dir), pages(spark, sf_dir))
    return facts.filter("mode = 'model'").select("fact_id", "fact_no", "page_number", "entity", "metric", "category", "raw_value", "period", "scope", "audit_status", "statement", "confidence", "currency", "unit", "notes")


def model_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_ord"), F.col("doc_id").alias("page_number"), "text")
    return prompts(docs).select("doc_id", F.sha2("prompt", 256).alias("prompt_sha256"))


def page_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document page 2 and page 5, which no document has, so that its first is shown."""
    own = pages(spark, sf_dir)
    wanted = own.select("doc_id", F.explode(F.array(F.lit(2), F.lit(5))).alias("page_number"))
    seen = views.page_view(own, extract_facts(own), wanted)
    return seen.select("doc_id", "asked", "page_number", F.size("facts").cast("long").alias("n_facts"), F.array_join(F.transform("facts", lambda f: f.raw_value), "; ").alias("amounts"))


def nested_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, facts and relationships of each document, taken back out of the nested rows as they were written."""
    own = pages(spark, sf_dir)
    facts = written(extract_facts(own), "facts")
    whole = written(views.nested(own, facts, relate(facts), part=10), "nested")
    count = lambda c: F.sum(F.size(c)).cast("long")
    chars = F.sum(F.aggregate("pages", F.lit(0).cast("long"), lambda a, p: a + F.length(p.text)))
    return whole.groupBy("doc_id").agg(count("pages").alias("n_pages"), chars.alias("n_chars"), count("facts").alias("n_facts"), count("relationships").alias("n_relationships"), (F.max(F.size("relationships")) <= 10).alias("bounded"))


def report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's summary and list of documents, numbered from 1."""
    own = pages(spark, sf_dir)
    facts = written(extract_facts(own), "facts")
    head = views.report_head(views.totals(own, facts, relate(facts)), views.document_catalogue(own, facts))
    return numbered(head, "line", "ordinal").select("line", F.length("section").alias("n_chars"), F.element_at(F.split("section", "\n"), -1).alias("last"))


def fact_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.fact_cards(normalize_facts(extract_facts(pages(spark, sf_dir)))).select("fact_id", "metric", "value", "period", "scope", "basis")


def relationship_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = views.relationship_cards(explain(relate(extract_facts(pages(spark, sf_dir)))))
    marks = F.array_join(F.transform("dimensions", lambda d: F.concat_ws("=", d.dimension, d.mark)), " ")
    return cards.select("rel_id", "title", "label", "variance", marks.alias("marks"), F.col("a.document").alias("document_a"), F.get(F.col("steps"), F.lit(0)).startswith("1. ").alias("numbered"))


def _in_sql(spark: SparkSession, names: list[str], rows: DataFrame) -> str:
    """Registers SQL functions and a view of `rows`; the view's name."""
    sql.register(spark, "attestry_", names)
    view = f"rows_{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(view)
    return view


def sql_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .catalogue import normalize_money

    view = _in_sql(spark, ["normalize_value"], normalize_money(spark, sf_dir).select("o_orderkey", "raw_value"))
    return spark.sql(f"SELECT o_orderkey, raw_value, v.* FROM (SELECT *, attestry_normalize_value(raw_value, '') AS v FROM {view})")


def sql_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .catalogue import normalize_periods

    view = _in_sql(spark, ["normalize_period"], normalize_periods(spark, sf_dir).select("o_orderkey", "period"))
    return spark.sql(f"SELECT o_orderkey, period, p.type, p.key, p.label, p.fiscal_year FROM (SELECT *, attestry_normalize_period(period) AS p FROM {view})")


def sql_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").select("p_partkey", _pick(F.col("p_partkey") % len(METRICS), METRICS).alias("metric"))
    view = _in_sql(spark, ["classify_concept", "metric_category"], rows)
    return spark.sql(f"SELECT p_partkey, metric, c.concept_id, c.concept_family, category FROM (SELECT *, attestry_classify_concept(metric, '') AS c, attestry_metric_category(metric) AS category FROM {view})")


def sql_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .catalogue import canonical_entities

    view = _in_sql(spark, ["canonical_entity"], canonical_entities(spark, sf_dir).select("name"))
    return spark.sql(f"SELECT name, attestry_canonical_entity(name) AS entity_key FROM {view}")


def sql_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .catalogue import context_dimensions

    view = _in_sql(spark, ["fact_context"], context_dimensions(spark, sf_dir).select("s_suppkey", "phrase"))
    return spark.sql(f"SELECT s_suppkey, phrase, c.* FROM (SELECT *, attestry_fact_context(phrase) AS c FROM {view})")


QUERIES = {f.__name__: f for f in (incremental_relationships, json_page_scan, json_relationships, page_source_relationships, wildcard_relationships, currency_unit_matrix, known_currency, distinct_relationships, valid_facts, standard_keys, extracted_context, concept_dimension, extraction_modes, first_notice, model_answers, model_prompts, page_lookup, nested_result, report_sections, fact_cards, relationship_cards, sql_values, sql_periods, sql_concepts, sql_entities, sql_context)}

_ONE = "'rel_f_0_' || s_suppkey || '_f_1_' || s_suppkey AS rel_id, 'CORROBORATED' AS type"
_SUPPLIER_FACTS = "WITH f AS (SELECT s_suppkey AS k, d, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_suppkey END AS e FROM supplier, (VALUES (0), (1)) t(d))"


def _flags() -> str:
    """VALUES rows of METRICS with the fields of their concepts."""
    rows = []
    for i, name in enumerate(METRICS):
        concept, family, _ = _CONCEPT[name]
        label = f"Growth Rate: {name}" if family == "growth_rate" else L.CONCEPT_LABELS.get(concept, name)
        rows.append(f"({i}, {_q(concept)}, {_q(family)}, {_q(label)}, {name.startswith('Adjusted')})")
    return ", ".join(rows)


ORACLE_SQL = {
    "incremental_relationships": EXTRACTED["extracted_relationships"],
    "json_page_scan": EXTRACTED["extract_facts_dedup"].split("SELECT fact_id")[0] + """, said AS (
        SELECT doc_pos, k, d, y, '- ' || CASE WHEN m = 3 THEN 'Adjusted Total Revenue' ELSE 'Total Revenue' END || ' for ' || CASE WHEN d = 2 THEN 'Q4 FY ' ELSE 'FY ' END || y || ' was '
          || CASE WHEN m = 4 AND h * 10 >= 1000 THEN '$' || (h * 10 // 1000) || ',' || lpad(CAST(h * 10 % 1000 AS VARCHAR), 3, '0') || ' thousand' ELSE '$' || (h // 100) || '.' || lpad(CAST(h % 100 AS VARCHAR), 2, '0') || ' million' END || '.' AS line FROM sized
      ), p AS (SELECT doc_pos, k, CASE WHEN y <= 2017 THEN 0 ELSE 1 END AS page_ord, string_agg(CASE WHEN y % 2 = 0 THEN line || chr(10) || '  ' || line ELSE line END, chr(10) ORDER BY y) AS body FROM said GROUP BY ALL),
      n AS (SELECT DISTINCT doc_pos, dense_rank() OVER (ORDER BY doc_pos) - 1 AS place FROM p)
      SELECT place AS doc_pos, 'report_' || p.doc_pos || '.pdf' AS document_name, CAST(page_ord AS INT) AS page_ord, CAST(page_ord + 1 AS INT) AS page_number,
        CAST(length(CASE WHEN page_ord = 0 THEN 'NATION ' || k || ' Holdings Ltd' || chr(10) || 'small' || chr(10) || 'An overview of gross profit' || chr(10) || body ELSE body || chr(10) || 'Headcount: ' || (p.doc_pos + 1000) || ' employees' END) AS INT) AS n_chars FROM p JOIN n ON p.doc_pos = n.doc_pos""",
    "json_relationships": EXTRACTED["extracted_summary"],
    "page_source_relationships": EXTRACTED["extracted_summary"],
    "wildcard_relationships": _SUPPLIER_FACTS + " SELECT 'f_0_' || a.k AS fact_a, 'f_1_' || b.k AS fact_b, 'CORROBORATED' AS type FROM f a JOIN f b ON a.d = 0 AND b.d = 1 AND (a.e IS NULL OR b.e IS NULL OR a.e = b.e)",
    "currency_unit_matrix": """WITH s AS (SELECT s_suppkey, (['USD', 'EUR', '%', 'bps', '%'])[s_suppkey % 5 + 1] AS a, (['USD', 'EUR', '%', 'bps', '%'])[(s_suppkey * 7 + 3) % 5 + 1] AS b FROM supplier)
      SELECT s_suppkey, CASE WHEN a <> b AND a IN ('USD', 'EUR') THEN 'UNCERTAIN' ELSE 'CORROBORATED' END AS type, CASE WHEN a <> b AND a IN ('USD', 'EUR') THEN 0.65 WHEN a = b AND a <> 'bps' THEN 0.98 ELSE 0.84 END::DOUBLE AS confidence,
        CASE WHEN a = b THEN '' WHEN a IN ('USD', 'EUR') THEN 'currency' ELSE 'unit' END AS reasons FROM s WHERE (a IN ('USD', 'EUR')) = (b IN ('USD', 'EUR'))""",
    "known_currency": "WITH t AS (SELECT s_suppkey, (['EUR', 'JPY', 'INR', NULL])[s_suppkey % 4 + 1] AS currency, (s_suppkey % 900 + 100)::DOUBLE * 1e6::DOUBLE AS base_value FROM supplier) SELECT s_suppkey, currency, CASE WHEN currency IS NULL THEN 'text' ELSE 'currency' END AS unit_type, base_value FROM t",
    "distinct_relationships": f"SELECT {_ONE} FROM supplier",
    "valid_facts": f"SELECT {_ONE} FROM supplier WHERE s_suppkey % 3 = 1 AND s_suppkey % 5 > 0",
    "standard_keys": _FACTS + "SELECT fact_id, CASE WHEN metric = 'Headcount' THEN 'workforce_headcount' ELSE 'revenue_total' END AS canonical_metric, 'nation_' || k || '::' || CASE WHEN metric = 'Headcount' THEN 'workforce_headcount' ELSE 'revenue_total' END || '::' || pkey AS standard_key FROM named",
    "extracted_context": _FACTS + "SELECT fact_id, 'Consolidated' AS scope, 'Total' AS operations, CASE WHEN metric <> 'Headcount' THEN 'USD' END AS currency, CASE WHEN metric = 'Headcount' THEN 'count' ELSE 'USD' END AS unit, CAST(NULL AS VARCHAR) AS notes, 0.85::DOUBLE AS confidence FROM named",
    "concept_dimension": f"""WITH c(i, concept_id, concept_family, concept_label, adj) AS (VALUES {_flags()}), t AS (SELECT p_partkey, p_partkey % 3 = 0 AS detailed, c.* FROM part JOIN c ON p_partkey % {len(METRICS)} = i)
      SELECT p_partkey, CASE WHEN detailed AND concept_family = 'revenue' THEN 'revenue_segment' ELSE concept_id END AS concept_id, concept_family, CASE WHEN detailed AND concept_family = 'revenue' THEN 'Segment Revenue' ELSE concept_label END AS concept_label,
        concept_family IN ('margin', 'ratio', 'growth_rate') AS is_ratio, concept_family = 'growth_rate' AS is_growth, concept_family = 'per_share' AS is_per_share, concept_family = 'contingency' AS is_contingent,
        concept_family = 'revenue' AND (detailed OR concept_id = 'revenue_segment') AS is_segment, CASE WHEN detailed AND concept_family = 'revenue' THEN 'Retail' END AS segment_name, adj AS is_adjusted FROM t""",
    "extraction_modes": _FACTS + f", d AS (SELECT DISTINCT doc_pos, doc_pos % 5 AS c FROM sized) SELECT 'doc_' || doc_pos AS doc_id, doc_pos, CASE WHEN c = 0 THEN 'model' ELSE 'rules' END AS mode, CASE c WHEN 0 THEN NULL WHEN 3 THEN {_q(NOTICES['exhausted'])} WHEN 4 THEN {_q(NOTICES['error'])} ELSE {_q(NOTICES['empty'])} END AS notice FROM d",
    "first_notice": f"SELECT 'rules' AS mode, {_q(NOTICES['empty'])} AS notice",
    "model_answers": _FACTS + """, d AS (SELECT doc_pos, CAST(count(DISTINCT page) AS INT) AS n FROM named WHERE doc_pos % 5 = 0 GROUP BY 1)
      SELECT 'doc_' || doc_pos || '_p9_f1' AS fact_id, CAST(1 AS INT) AS fact_no, n AS page_number, 'General' AS entity, 'Total Revenue' AS metric, 'financial' AS category, '$' || doc_pos || ' million' AS raw_value, 'Unspecified' AS period, 'Consolidated' AS scope, 'Audited' AS audit_status,
        'Total Revenue: $' || doc_pos || ' million' AS statement, 0.95::DOUBLE AS confidence, 'USD' AS currency, 'USD' AS unit, 'n' AS notes FROM d""",
    "model_prompts": f"""WITH c AS ({EXTRACTED['page_prioritisation']}) SELECT c.doc_id, sha256(string_agg('--- PAGE ' || c.page_ord || ' ---' || chr(10) || substr(coalesce(d.text, ''), 1, {L.MODEL_CHARS}), chr(10) || chr(10) ORDER BY c.page_ord)) AS prompt_sha256
      FROM c JOIN documents d ON d.doc_id = c.page_ord AND d.source = c.doc_id GROUP BY c.doc_id""",
    "page_lookup": _FACTS + """, p AS (SELECT DISTINCT doc_pos, CASE WHEN y <= 2017 THEN 1 ELSE 2 END AS page FROM sized), w AS (SELECT DISTINCT doc_pos, asked FROM p, (VALUES (2), (5)) t(asked)),
      s AS (SELECT w.doc_pos, asked, CASE WHEN bool_or(p.page = asked) THEN asked ELSE min(p.page) END AS page_number FROM w JOIN p ON w.doc_pos = p.doc_pos GROUP BY 1, 2)
      SELECT 'doc_' || s.doc_pos AS doc_id, s.asked, s.page_number, count(n.fact_id) AS n_facts, coalesce(string_agg(n.raw, '; ' ORDER BY n.fact_no), '') AS amounts FROM s LEFT JOIN named n ON n.doc_pos = s.doc_pos AND n.page = s.asked GROUP BY ALL""",
    "report_sections": _FACTS + """, c AS (SELECT doc_pos, 'doc_' || doc_pos AS doc_id, 'report_' || doc_pos || '.pdf' AS name, count(DISTINCT page) AS n_pages, count(*) AS n_facts FROM named GROUP BY doc_pos),
      t AS (SELECT (SELECT count(DISTINCT doc_pos) FROM sized) AS d, (SELECT count(*) FROM named) AS f, count(*) FILTER (WHERE type = 'CORROBORATED') AS c1, count(*) FILTER (WHERE type = 'CONTRADICTED') AS c2, count(*) FILTER (WHERE type = 'RECONCILED BY CONTEXT') AS c3, count(*) FILTER (WHERE type = 'UNCERTAIN') AS c4 FROM typed),
      l AS (SELECT *, row_number() OVER (ORDER BY doc_pos) AS i FROM c), e AS (SELECT i + 1 AS line, i || '. **' || name || '** (' || doc_id || '): ' || n_pages || ' pages, ' || n_facts || ' facts' AS s FROM l)
      SELECT CAST(1 AS BIGINT) AS line, CAST(length('# Comparison of documents' || '  ## Summary ') + length('- **Documents:**  - **Facts:**  - **Corroborated:**  - **Contradicted:**  - **Reconciled by context:**  - **Uncertain:**  ' || d || f || c1 || c2 || c3 || c4) + length(' ## Documents') AS INT) AS n_chars, '## Documents' AS last FROM t
      UNION ALL SELECT line, CAST(length(s) AS INT), s FROM e""",
    "fact_cards": _FACTS + """, s AS (SELECT *, format('{:,}', CAST(round(v) AS BIGINT)) AS shown FROM named)
      SELECT fact_id, metric, CASE WHEN metric = 'Headcount' THEN shown || ' (count)' ELSE 'USD ' || shown || ' (USD)' END AS value, plabel AS period, 'Consolidated' AS scope, CASE WHEN adj THEN 'Non-GAAP' ELSE 'Standard' END AS basis FROM s""",
    "relationship_cards": _FACTS + f""", w AS (SELECT *, {_CONFIDENCE} AS confidence, array_to_string(list_filter([CASE WHEN interim THEN 'an interim period against the full year' END, CASE WHEN adj THEN 'an adjusted figure against a reported one' END], lambda x: x IS NOT NULL), '; ') AS why FROM typed)
      SELECT rel_id, entity || ' | ' || period_label || ' | confidence ' || CAST(floor(confidence * 100 + 0.5) AS INT) || '%' AS title, CASE WHEN comparable THEN 'comparable' ELSE 'divergent' END AS label,
        CASE WHEN comparable THEN format('{{:.2f}}', variance_percent) || '% variance' WHEN why <> '' THEN 'not comparable: ' || string_split(why, '; ')[1] ELSE 'not comparable: different fiscal years' END AS variance,
        'metric=pass ' || CASE WHEN metric = 'Headcount' THEN 'unit' ELSE 'currency' END || '=pass period=' || CASE WHEN same THEN 'pass' ELSE 'fail' END || ' scope=pass basis=' || CASE WHEN adj THEN 'fail' ELSE 'pass' END || ' operations=pass' AS marks,
        substr('report_' || pa || '.pdf', 1, 20) || '...' AS document_a, TRUE AS numbered FROM w""",
    "nested_result": EXTRACTED["extract_facts_dedup"].split("SELECT fact_id")[0] + """, said AS (
        SELECT doc_pos, k, y, CASE WHEN y <= 2017 THEN 1 ELSE 2 END AS page, length('- ' || CASE WHEN m = 3 THEN 'Adjusted Total Revenue' ELSE 'Total Revenue' END || ' for ' || CASE WHEN d = 2 THEN 'Q4 FY ' ELSE 'FY ' END || y || ' was '
          || CASE WHEN m = 4 AND h * 10 >= 1000 THEN '$' || (h * 10 // 1000) || ',' || lpad(CAST(h * 10 % 1000 AS VARCHAR), 3, '0') || ' thousand' ELSE '$' || (h // 100) || '.' || lpad(CAST(h % 100 AS VARCHAR), 2, '0') || ' million' END || '.') AS n FROM sized
      ), p AS (SELECT doc_pos, page, sum(CASE WHEN y % 2 = 0 THEN 2 * n + 3 ELSE n END) + count(*) - 1 + CASE WHEN page = 1 THEN length('NATION ' || any_value(k) || ' Holdings Ltd small An overview of gross profit ') ELSE length(' Headcount: ' || (doc_pos + 1000) || ' employees') END AS chars FROM said GROUP BY 1, 2),
      d AS (SELECT doc_pos, count(*) AS n_pages, CAST(sum(chars) AS BIGINT) AS n_chars FROM p GROUP BY 1), f AS (SELECT doc_pos, count(*) AS n FROM named GROUP BY 1), r AS (SELECT pa, count(*) AS n FROM typed GROUP BY 1)
      SELECT 'doc_' || d.doc_pos AS doc_id, n_pages, n_chars, coalesce(f.n, 0) AS n_facts, coalesce(r.n, 0) AS n_relationships, TRUE AS bounded FROM d LEFT JOIN f ON f.doc_pos = d.doc_pos LEFT JOIN r ON r.pa = d.doc_pos""",
    "sql_values": BASIC["normalize_money"],
    "sql_periods": BASIC["normalize_periods"],
    "sql_concepts": BASIC["classify_concepts"],
    "sql_entities": BASIC["canonical_entities"],
    "sql_context": BASIC["context_dimensions"],
}
