"""Searches, counts and flat projections over facts, documents and relationships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.value import trace
from ..scratch import numbered
from .explain import number
from .relate import TYPES


def _anywhere(columns: list[str], query: str) -> Column:
    """The query, in any case, in one of the columns; a blank one finds all."""
    if not query.strip():
        return F.lit(True)
    return F.greatest(*(F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(query.lower())) for c in columns))


def search_relationships(explained: DataFrame, kind: str = "ALL", query: str = "") -> DataFrame:
    """Relationships of a type (ALL: any) whose metric, entity, raw values, summary or reason hold the query."""
    of_kind = F.lit(True) if kind == "ALL" else F.col("type") == kind
    return explained.filter(of_kind & _anywhere(["metric", "entity", "a.raw_value", "b.raw_value", "summary", "reason"], query))


def search_facts(facts: DataFrame, doc_id: str = "ALL", category: str = "ALL", query: str = "") -> DataFrame:
    """Facts of a document and category (ALL: any) whose metric, entity, raw value, statement, evidence or period holds the query."""
    own = facts if doc_id == "ALL" else facts.filter(F.col("doc_id") == doc_id)
    own = own if category == "ALL" else own.filter(F.col("category") == category)
    return own.filter(_anywhere(["metric", "entity", "raw_value", "statement", "evidence", "period"], query))


def page_counts(pages: DataFrame, facts: DataFrame) -> DataFrame:
    """(doc_id, page_number, n_facts) of every page, zeros included. Facts are counted before the join."""
    counts = facts.groupBy("doc_id", "page_number").agg(F.count("*").alias("n"))
    return pages.select("doc_id", "page_number").distinct().join(counts, ["doc_id", "page_number"], "left").select("doc_id", "page_number", F.coalesce("n", F.lit(0)).cast("long").alias("n_facts"))


def document_catalogue(pages: DataFrame, facts: DataFrame) -> DataFrame:
    """(doc_id, document_name, doc_pos, n_pages, n_chars, blank, n_facts): the last name seen by page, zeros included."""
    text = F.coalesce("text", F.lit(""))
    own = pages.groupBy("doc_id").agg(F.max_by("document_name", "page_ord").alias("document_name"), F.min("doc_pos").alias("doc_pos"), F.count("*").alias("n_pages"), F.sum(F.length(text)).alias("n_chars"), F.every(F.trim(text) == "").alias("blank"))
    return own.join(facts.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").withColumn("n_facts", F.coalesce("n", F.lit(0)).cast("long")).drop("n")


def categories(facts: DataFrame) -> DataFrame:
    """(category, n_facts, first_doc, first_no): distinct categories with the place where each is first seen."""
    first = F.min(F.struct("doc_pos", "fact_no"))
    return facts.groupBy("category").agg(F.count("*").alias("n_facts"), first.alias("f")).select("category", "n_facts", F.col("f.doc_pos").alias("first_doc"), F.col("f.fact_no").alias("first_no"))


def totals(pages: DataFrame, facts: DataFrame, relationships: DataFrame) -> DataFrame:
    """One row: n_documents, n_facts, and the number of relationships of each type, zeros included."""
    kinds = [F.count_if(F.col("type") == t).alias("n_" + t.split(" ")[0].lower()) for t in TYPES]
    docs, said = pages.agg(F.countDistinct("doc_id").alias("n_documents")), facts.agg(F.count("*").alias("n_facts"))
    # three rows of one, side by side
    return docs.join(F.broadcast(said)).join(F.broadcast(relationships.agg(*kinds)))


def shown_value(v: Column) -> Column:
    """A base value as it is shown: with its currency and unit, as a percentage, or N/A."""
    return F.when(v.base_value.isNull(), "N/A").when(v.unit_type == "percentage", F.concat(number(v.base_value), F.lit("%"))).otherwise(F.concat_ws(" ", v.currency, number(v.base_value), F.concat(F.lit("("), v.unit, F.lit(")"))))


def report_rows(explained: DataFrame) -> DataFrame:
    """(ordinal, section): each relationship's part of a Markdown report, in reading order.

    Written with write_report(), or by any sink of its own.
    """
    line = lambda label, value: F.concat(F.lit(f"- **{label}:** "), F.coalesce(value.cast("string"), F.lit("N/A")), F.lit("\n"))
    table = F.array_join(F.transform("dimensions", lambda d: F.concat_ws(" | ", F.lit("\n"), d.dimension, d.fact_a, d.fact_b, F.when(d.compatible, "yes").otherwise("no"), d.note)), "")
    side = lambda s: F.concat(F.lit(f"\n#### Source {s.upper()}\n"), line("Document", F.col(f"{s}.document_name")), line("Page", F.coalesce(f"{s}.page_number", F.lit(1))), line("Statement", F.col(f"{s}.statement")), line("Raw value", F.col(f"{s}.raw_value")), line("Base value", shown_value(F.col(f"{s}.v"))), line("Period", F.col(f"{s}.p.label")), line("Evidence", F.col(f"{s}.evidence")))
    text = F.concat(
        F.lit("] "), "metric", F.lit("\n"), line("Entity", F.col("entity")), line("Period", F.col("period_label")), line("Confidence", F.concat(F.round(F.col("confidence") * 100).cast("int").cast("string"), F.lit("%"))),
        line("Directly comparable", F.when(F.col("comparable"), "yes").otherwise("no")), line("Variance", F.col("variance_text")), line("Summary", F.col("summary")), line("Reason", F.col("reason")),
        F.lit("\n| dimension | A | B | compatible | note"), table, F.lit("\n"), side("a"), side("b"),
    )
    told = numbered(explained.select("priority", "place", "type", text.alias("text")), "ordinal", "priority", "place")
    return told.select("ordinal", F.concat(F.lit("### "), F.col("ordinal").cast("string"), F.lit(" ["), "type", "text").alias("section"))


def report_head(totals: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(ordinal, section): what stands before the relationships' parts: a title, the totals (totals()), and each document (document_catalogue()) in order, numbered; ordinals up to 0."""
    counts = [("Documents", "n_documents"), ("Facts", "n_facts"), ("Corroborated", "n_corroborated"), ("Contradicted", "n_contradicted"), ("Reconciled by context", "n_reconciled"), ("Uncertain", "n_uncertain")]
    top = F.concat(F.lit("# Comparison of documents\n\n## Summary\n"), *(F.concat(F.lit(f"- **{label}:** "), F.col(c).cast("string"), F.lit("\n")) for label, c in counts), F.lit("\n## Documents"))
    listed = numbered(catalogue.select("doc_pos", "doc_id", "document_name", "n_pages", "n_facts"), "at", "doc_pos")
    entry = F.concat(F.col("at").cast("string"), F.lit(". **"), "document_name", F.lit("** ("), "doc_id", F.lit("): "), F.col("n_pages").cast("string"), F.lit(" pages, "), F.col("n_facts").cast("string"), F.lit(" facts"))
    low = F.lit(-(1 << 62)).cast("long")
    return totals.select(low.alias("ordinal"), top.alias("section")).unionByName(listed.select((low + F.col("at")).alias("ordinal"), entry.alias("section")))


def ordinals(keys: DataFrame) -> DataFrame:
    """(rel_id, ordinal) of relationships (rel_id, priority, place), from 1 in the order of priority and place. Ranges are sampled, so none is much larger than others."""
    return numbered(keys.select("rel_id", "priority", "place"), "ordinal", "priority", "place").select("rel_id", "ordinal")


#: Pages, facts or relationships of a document that one row of nested() holds at most.
PART = 1000


def nested(pages: DataFrame, facts: DataFrame, relationships: DataFrame, part: int = PART) -> DataFrame:
    """The whole result as nested rows: (doc_id, doc_pos, document_name, part, pages, facts, relationships), arrays in reading order.

    A relationship is with its first document. Of a document with more than `part` pages, facts or relationships further
    ones follow in rows of parts 1, 2, ...; so no row grows with a document. Nothing is left out: exploding the arrays gives the tables back.
    Written as JSON or Parquet by any sink. doc_pos tells documents apart, in pages as in facts and relationships.
    """

    def parts(rows: DataFrame, name: str, *order: str) -> DataFrame:
        own = numbered(rows, "_at", "doc_pos", *order)
        begin = own.groupBy("doc_pos").agg(F.min("_at").alias("_begin"))
        cut = own.join(begin, "doc_pos").withColumn("part", F.floor((F.col("_at") - F.col("_begin")) / part))
        held = F.struct("_at", F.struct(*(c for c in rows.columns if c != "doc_pos")).alias("r"))
        return cut.groupBy("doc_pos", "part").agg(F.transform(F.array_sort(F.collect_list(held)), lambda x: x.r).alias(name))

    names = pages.groupBy("doc_pos").agg(F.min("doc_id").alias("doc_id"), F.max_by("document_name", "page_ord").alias("document_name"))
    rels = relationships.select(F.col("place.doc_pos").alias("doc_pos"), "rel_id", "type", "confidence", "priority", "place", "fact_a", "fact_b", "entity", "concept_id", "period_label", "variance_percent", "difference", "reconciling", "reasons", "comparable")
    whole = parts(pages.select("doc_pos", "page_ord", "page_number", "text"), "pages", "page_ord")
    for other in (parts(facts.drop("doc_id", "document_name"), "facts", "fact_no"), parts(rels, "relationships", "priority", "place")):
        whole = whole.join(other, ["doc_pos", "part"], "full")
    filled = [F.coalesce(c, F.array().cast(whole.schema[c].dataType)).alias(c) for c in ("pages", "facts", "relationships")]
    return whole.join(names, "doc_pos").select("doc_id", "doc_pos", "document_name", "part", *filled)


def page_view(pages: DataFrame, facts: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each of `wanted` (doc_id, page_number): the page with that number, or the document's first, as (doc_id, asked, page_number, text, facts).

    facts holds (fact_no, metric, raw_value, period) of the facts on the page asked for, in order; empty if none. A blank text reads NO_TEXT. Documents without pages have no row.
    """
    asked = wanted.select("doc_id", F.col("page_number").alias("asked")).distinct()
    near = F.struct((F.col("page_number") != F.col("asked")).alias("off"), "page_ord")
    page = pages.join(asked, "doc_id").groupBy("doc_id", "asked").agg(F.min_by(F.struct("page_number", "text"), near).alias("p"))
    on = facts.select("doc_id", F.col("page_number").alias("asked"), F.struct("fact_no", "metric", "raw_value", "period").alias("f")).join(asked, ["doc_id", "asked"], "left_semi")
    on = on.groupBy("doc_id", "asked").agg(F.array_sort(F.collect_list("f")).alias("facts"))
    text = F.when(F.trim(F.coalesce("p.text", F.lit(""))) == "", NO_TEXT).otherwise(F.col("p.text"))
    return page.join(on, ["doc_id", "asked"], "left").select("doc_id", "asked", "p.page_number", text.alias("text"), F.coalesce("facts", F.array().cast(on.schema["facts"].dataType)).alias("facts"))


#: What a page without text reads.
NO_TEXT = "No extractable text"


def kilobytes(size: Column) -> Column:
    """Bytes as KB with one decimal, halves up."""
    return F.format_string("%.1f KB", F.floor(size / 1024 * 10 + 0.5) / 10)


def shortened(name: Column, chars: int) -> Column:
    return F.concat(F.left(name, F.lit(chars)), F.lit("..."))


def fact_cards(facts: DataFrame) -> DataFrame:
    """Normalised facts (normalize_facts) as they are shown one by one: fact_id, metric, value, period, scope, basis, statement, evidence, trace."""
    return facts.select(
        "fact_id", "metric", shown_value(F.col("v")).alias("value"), F.col("p.label").alias("period"),
        F.coalesce(F.nullif("scope", F.lit("")), F.lit("Consolidated")).alias("scope"), F.coalesce(F.nullif("basis", F.lit("")), F.lit("Standard")).alias("basis"),
        "statement", "evidence", trace(F.col("raw_value"), F.col("v")).alias("trace"),
    )


def relationship_cards(explained: DataFrame) -> DataFrame:
    """Relationships as they are shown one by one: a title, both sides (name shortened, page, value), numbered steps, each dimension with its mark, factors."""
    side = lambda s: F.struct(shortened(F.coalesce(f"{s}.document_name", F.lit("")), 20).alias("document"), F.coalesce(f"{s}.page_number", F.lit(1)).alias("page"), shown_value(F.col(f"{s}.v")).alias("value"), F.col(f"{s}.evidence").alias("evidence"), trace(F.col(f"{s}.raw_value"), F.col(f"{s}.v")).alias("trace"))
    title = F.concat_ws(" | ", "entity", "period_label", F.concat(F.lit("confidence "), F.floor(F.col("confidence") * 100 + 0.5).cast("string"), F.lit("%")))
    steps = F.transform("steps", lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s))
    marks = F.transform("dimensions", lambda d: F.struct(d.dimension.alias("dimension"), F.when(d.compatible, "pass").otherwise("fail").alias("mark"), d.fact_a.alias("fact_a"), d.fact_b.alias("fact_b"), d.note.alias("note")))
    variance = F.when(F.col("comparable"), F.concat(F.format_number("variance_percent", 2), F.lit("% variance"))).otherwise(F.col("variance_text"))
    return explained.select("rel_id", "type", title.alias("title"), "metric", variance.alias("variance"), F.when(F.col("comparable"), "comparable").otherwise("divergent").alias("label"), side("a").alias("a"), side("b").alias("b"), steps.alias("steps"), marks.alias("dimensions"), "factors")


def write_report(explained: DataFrame, path: str, form: str = "markdown", head: DataFrame | None = None) -> None:
    """Write the report as text sorted by ordinal (markdown; report_head() first, if given), or the relationships as JSON rows (json). Files follow the partitions; reading them in name order gives the whole."""
    if form == "json":
        explained.orderBy("priority", "place").write.json(path)
    elif form == "markdown":
        rows = report_rows(explained)
        (rows if head is None else head.unionByName(rows)).orderBy("ordinal").select("section").write.text(path)
    else:
        raise ValueError(f"unknown form of report: {form}")
