"""What is said about a relationship: its dimensions side by side, why it is what it is, and the steps that led there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.find import titled
from ..functions.text import first_match

#: For each dimension that can explain a difference, what it is called in sentences.
FACTORS = {
    "period": "an interim period against the full year", "scope": "group against single company", "segment": "a segment against the whole",
    "basis": "an adjusted figure against a reported one", "constant_currency": "constant currency against reported", "operations": "continuing operations against others",
    "audit": "restated against as first reported", "geography": "different regions", "estimate": "an estimate against an actual figure", "gross_net": "gross against net",
}
PERIODS = {"exact": "Same period", "undated": "No period is given for one of them", "interim": "An interim period against the full year", "fiscal_year": "Different fiscal years", "quarter": "Different quarters", "timeframe": "Different kinds of periods"}


def number(x: Column) -> Column:
    """With thousands grouped and up to three decimals, halves away from zero."""
    grouped = F.format_number(F.signum(x) * F.floor(F.abs(x) * 1000 + 0.5) / 1000, 3)
    return F.regexp_replace(grouped, r"\.?0+\z", "")


def concept_label(concept_id: Column) -> Column:
    return titled(F.replace(concept_id, F.lit("_"), F.lit(" ")))


def dimensions() -> Column:
    """array of (dimension, fact_a, fact_b, compatible, note) over the columns of compare(). Audit status, geography, estimates and gross or net have a row only where they differ."""

    def row(name: str, field: str, differs: Column, note: Column, default: str = "") -> Column:
        side = lambda s: F.coalesce(F.nullif(F.col(f"{s}.{field}").cast("string"), F.lit("")), F.lit(default))
        return F.struct(F.lit(name).alias("dimension"), side("a").alias("fact_a"), side("b").alias("fact_b"), (~differs).alias("compatible"), note.alias("note"))

    told = lambda *names: F.greatest(*(F.col(f"told.{n}") for n in names)) if len(names) > 1 else F.col(f"told.{names[0]}")
    why = lambda *names: first_match([(F.col(f"told.{n}"), F.lit(FACTORS[n].capitalize())) for n in names], F.lit("No difference that matters"))
    money = F.col("a.unit_type") == "currency"
    rows = [
        row("metric", "metric", F.lit(False), F.concat(F.lit("One concept: "), concept_label(F.col("a.c.concept_id")))),
        F.when(money, row("currency", "v.currency", told("currency"), F.when(told("currency"), "Different currencies, and no exchange rate").otherwise("Same currency"))).otherwise(row("unit", "v.unit", told("unit"), F.when(told("unit"), "Different units").otherwise("Same unit"))),
        row("period", "p.label", F.col("period_case") != "exact", first_match([(F.col("period_case") == k, F.lit(v)) for k, v in PERIODS.items()])),
        row("scope", "scope", told("scope", "segment"), why("scope", "segment"), "Consolidated"),
        row("basis", "basis", told("basis", "constant_currency"), why("basis", "constant_currency"), "Standard"),
        row("operations", "operations", told("operations"), why("operations"), "Total"),
        *(F.when(told(n), row(n, field, told(n), why(n))) for n, field in (("audit", "audit_status"), ("geography", "geography"), ("estimate", "is_estimate"), ("gross_net", "gross_or_net"))),
    ]
    return F.array_compact(F.array(*rows))


def _detail() -> Column:
    """What keeps the facts from being compared."""
    money = F.when(F.col("told.currency"), F.concat(F.lit("different currencies ("), F.col("a.v.currency"), F.lit(", "), F.col("b.v.currency"), F.lit(") without an exchange rate")))
    unit = F.when(F.col("told.unit"), F.concat(F.lit("different units ("), F.col("a.v.unit"), F.lit(", "), F.col("b.v.unit"), F.lit(")")))
    period = first_match([(F.col("period_case") == k, F.lit(v[0].lower() + v[1:])) for k, v in PERIODS.items() if k != "exact"])
    return F.coalesce(F.nullif(F.concat_ws("; ", money, unit, period), F.lit("")), F.lit("a value is missing"))


def explain(relationships: DataFrame) -> DataFrame:
    """`relationships` (classify) with metric (the concept's label), dimensions, factors, detail, summary, reason, variance_text and steps.

    Wide; counting and filtering by type needn't compute it.
    """
    label = concept_label(F.col("concept_id"))
    factors = F.transform("reconciling", lambda n: F.element_at(F.create_map(*(F.lit(x) for kv in FACTORS.items() for x in kv)), n))
    own = relationships.select("*", label.alias("metric"), dimensions().alias("dimensions"), factors.alias("factors"), _detail().alias("detail"))
    percent = F.concat(F.format_number("variance_percent", 2), F.lit("%"))
    why = F.array_join("factors", "; ")
    spoken = ~F.col("numeric")
    said = lambda s: F.concat(F.coalesce(f"{s}.document_name", F.lit(f"Document {s.upper()}")), F.lit(", page "), F.coalesce(F.col(f"{s}.page_number"), F.lit(1)).cast("string"), F.lit(': "'), F.when(spoken, F.col(f"{s}.statement")).otherwise(F.col(f"{s}.raw_value")), F.lit('"'))
    base = lambda s: F.concat(said(s), F.lit(" = "), number(F.col(f"{s}.v.base_value")), F.lit(" "), F.col(f"{s}.v.unit"))
    reconciled, unsure = F.col("type") == "RECONCILED BY CONTEXT", F.col("type") == "UNCERTAIN"
    verdict = F.when(F.col("type") == "CORROBORATED", F.lit("agree")).otherwise("conflict")
    summary = first_match(
        [
            (F.col("comparable"), F.concat("metric", F.lit(" of "), "period_label", F.lit(": the documents "), verdict, F.lit(" ("), percent, F.lit(" apart)"))),
            (reconciled, F.concat("metric", F.lit(": the difference is explained by "), why)),
            (unsure, F.concat("metric", F.lit(": can't be compared, "), "detail")),
        ],
        F.concat("metric", F.lit(" of "), "period_label", F.lit(": the statements "), verdict),
    )
    reason = first_match(
        [
            (F.col("comparable"), F.concat(said("a"), F.lit(" against "), said("b"), F.lit(": "), percent, F.when(F.col("type") == "CORROBORATED", F.lit(" is within 1 %, what rounding may make")).otherwise(" is beyond 1 %, and nothing disclosed explains it"))),
            (reconciled, F.concat(said("a"), F.lit(" against "), said("b"), F.lit(": "), why)),
            (unsure, F.concat(said("a"), F.lit(" against "), said("b"), F.lit(": "), "detail")),
        ],
        F.concat(said("a"), F.lit(" against "), said("b"), F.when(F.col("type") == "CORROBORATED", F.lit(": no opposed outcomes")).otherwise(": opposed outcomes")),
    )
    text = first_match([(F.col("comparable"), percent), (reconciled, F.concat(F.lit("not comparable: "), F.get("factors", F.lit(0)))), (unsure, F.concat(F.lit("not comparable: "), "detail"))], F.lit("not comparable: statements without numbers"))
    steps = F.when(F.col("comparable"), F.array(base("a"), base("b"), F.concat(F.lit("Difference: "), number(F.col("difference"))), F.concat(F.lit("Share of the larger: "), percent), "reason_")).otherwise(F.array(said("a"), said("b"), "reason_"))
    return own.withColumn("reason_", reason).select(*own.columns, summary.alias("summary"), F.col("reason_").alias("reason"), text.alias("variance_text"), steps.alias("steps"))
