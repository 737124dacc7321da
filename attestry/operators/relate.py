"""Cross-document comparison: candidate pairs, semantic gate, comparability and classification.

Pairs come from one equi join on (unit type, concept family, entity); facts whose entity is the wildcard meet all others
under keys of their own. No pair is made twice, and a key of many facts is cut into the cells of a grid. Facts are
normalised once and written before they are joined with each other.
"""

from __future__ import annotations

from functools import cache, reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.concept import canonical_entity, classify_concept, metric_tokens, token_similarity
from ..functions.period import normalize_period
from ..functions.text import first_match, round2
from ..functions.value import normalize_value
from ..scratch import written

#: What is told of a fact besides; columns that are missing count as null.
TOLD = {"document_name": "string", "page_number": "int", "entity": "string", "raw_value": "string", "evidence": "string"}
#: What a caller knows of an amount besides; a unit may be a currency's term.
KNOWN = {"known_currency": "string", "known_unit": "string"}
CONTEXT = {"basis": "string", "scope": "string", "scope_detail": "string", "operations": "string", "audit_status": "string", "geography": "string", "is_estimate": "boolean", "gross_or_net": "string"}


@cache
def _normalised(known: bool) -> list[Column]:
    """The expressions that normalize_facts() adds: made once, as making them takes seconds."""
    given = [F.col(c) for c in KNOWN] if known else []
    return [
        canonical_entity("entity").alias("entity_key"),
        normalize_value(F.col("raw_value"), F.col("evidence"), *given).alias("v"),
        normalize_period(F.col("period")).alias("p"),
        classify_concept(F.col("metric"), F.col("evidence"), F.col("basis"), F.col("scope_detail")).alias("c"),
        classify_concept(F.col("metric"), F.lit(None).cast("string")).concept_id.alias("canonical_metric"),
        metric_tokens(F.coalesce("metric", F.lit(""))).alias("tokens"),
    ]


def normalize_facts(facts: DataFrame) -> DataFrame:
    """Facts (fact_id, doc_pos, fact_no, entity, metric, raw_value, period, evidence, statement, context columns) with all that pairs are compared by.

    known_currency and known_unit count where the raw value names no currency. Columns that are missing count as null. Facts with a null or empty fact_id or a null doc_pos are left out.
    """
    known = any(c in facts.columns for c in KNOWN)
    facts = facts.filter((F.coalesce("fact_id", F.lit("")) != "") & F.col("doc_pos").isNotNull())
    facts = facts.withColumns({c: F.lit(None).cast(t) for c, t in (CONTEXT | TOLD | KNOWN).items() if c not in facts.columns})
    own = facts.select("fact_id", "doc_pos", "fact_no", "metric", "statement", *CONTEXT, *TOLD, *_normalised(known))
    standard = F.concat_ws("::", "entity_key", "canonical_metric", "p.key")
    return own.select("*", F.col("v.unit_type").alias("unit_type"), F.col("c.concept_family").alias("family"), standard.alias("standard_key"))


#: Facts of either side that a cell of a large key holds, on average.
CELL = 1024


def _marks() -> dict[str, Column]:
    """What pairs are compared by, told once of each normalised fact, so that a pair only compares it."""
    low = lambda name, default: F.lower(F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(default)))
    scope, basis, operations = low("scope", "Consolidated"), low("basis", "Standard"), low("operations", "Total")
    money, domain = F.col("unit_type") == "currency", F.col("family").startswith("domain_")
    return {
        "value": F.col("v.base_value"), "currency": F.when(money, F.col("v.currency")), "unit": F.when(~money, F.col("v.unit")),
        "period": F.col("p.key"), "year": F.col("p.fiscal_year"), "quarter": F.col("p.quarter"),
        "part": F.col("p.type").isin("quarter", "half_year", "nine_months"), "full": F.col("p.type") == "full_year",
        "whole": scope.contains("consolidated") | scope.contains("group"), "alone": scope.contains("standalone") | scope.contains("parent"),
        "segment": scope.contains("segment") | scope.contains("division") | (F.coalesce("scope_detail", F.lit("")) != "") | F.col("c.is_segment"),
        "adjusted": basis.contains("non-gaap") | basis.contains("adj") | F.col("c.is_adjusted"),
        "constant_currency": basis.contains("constant currency") | basis.contains("fx-neutral"),
        "operations": operations, "continuing": operations.contains("continuing"), "restated": low("audit_status", "-").contains("restated"),
        "geography": F.col("geography"), "is_estimate": F.col("is_estimate"), "gross_or_net": F.nullif(F.col("gross_or_net"), F.lit("unspecified")),
        "positive": polarity(F.col("statement"), L.POSITIVE), "negative": polarity(F.col("statement"), L.NEGATIVE),
        "segment_name": F.when(F.col("c.is_segment"), F.lower("scope_detail")), "domain_metric": F.when(domain, F.col("canonical_metric")), "domain_tokens": F.when(domain, F.col("tokens")),
    }


def _meetings(x: DataFrame, y: DataFrame, cell: int) -> DataFrame:
    """Pairs of normalised facts of one unit type and family whose entities are equal, or one of them the wildcard: the columns of both, x_ and y_ before their names.

    One equi join: an entity's facts meet under its key, and wildcard ones meet all others under a key of their own, so that
    each pair meets under one key only. A key with more than `cell` facts on a side is laid out as a grid: each fact of x
    belongs to one row and goes to all columns, each of y to one column and all rows, and a cell is a key of the join.
    Columns stay apart, not in a struct, so that only those travel to the cells that are asked for in the end.
    """
    keys = ["unit_type", "family", "meets"]
    wild = F.col("entity_key") == L.WILDCARD_ENTITY

    def side(facts: DataFrame, name: str, own: str, other: str) -> DataFrame:
        meets = F.when(wild, F.array(F.lit("**"), F.lit(own))).otherwise(F.array(F.concat(F.lit("="), "entity_key"), F.lit(other)))
        return facts.select("unit_type", "family", F.explode(meets).alias("meets"), F.xxhash64("fact_id", "doc_pos", "fact_no").alias("_h"), *(F.col(c).alias(f"{name}_{c}") for c in facts.columns))

    one, two = side(x, "x", "*=", "=*"), side(y, "y", "=*", "*=")
    sizes = [d.groupBy(*keys).agg(F.count("*").alias(n)) for d, n in ((one, "_rows"), (two, "_columns"))]
    parts = lambda n: F.ceil(F.col(n) / cell)
    large = sizes[0].join(sizes[1], keys).filter((F.col("_rows") > cell) | (F.col("_columns") > cell)).select(*keys, parts("_rows").alias("_rows"), parts("_columns").alias("_columns"))

    def laid(rows: DataFrame, own: str, other: str) -> DataFrame:
        placed = rows.join(large, keys, "left").withColumns({n: F.coalesce(n, F.lit(1)).cast("long") for n in ("_rows", "_columns")})
        return placed.select(*keys, *rows.columns[4:], F.pmod("_h", f"_{own}s").alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"_{other}s") - 1)).alias(other))

    # the facts' files are small beside what the grid makes of them: by their size Spark would take all cells of a side through the driver
    return laid(one, "row", "column").hint("merge").join(laid(two, "column", "row"), ["row", "column", *keys])


def candidate_pairs(facts: DataFrame, kept: DataFrame | None = None, cell: int = CELL) -> DataFrame:
    """Pairs (a, b) of normalised facts, structs, of different documents (the earlier is a) that pass both gates, and of each what compare() needs (of_a, of_b).

    With `kept`, normalised facts that are related to each other already, the pairs that have a fact of `facts` at least.
    Both tables are read more than once: pass written ones, as relate() does.
    """
    marks = {f"_{n}": c for n, c in _marks().items()}
    x, y = F.col("x_doc_pos"), F.col("y_doc_pos")
    new = facts.withColumns(marks)
    if kept is None:
        # facts of the last document are first in no pair, those of the first document last in none
        ends = F.broadcast(facts.agg(F.min("doc_pos").alias("_first"), F.max("doc_pos").alias("_last")))
        met = _meetings(*(new.crossJoin(ends).filter(test).select(*new.columns) for test in ("doc_pos < _last", "doc_pos > _first")), cell).filter(x < y)
        a, b = (lambda c: F.col(f"x_{c}")), (lambda c: F.col(f"y_{c}"))
    else:
        every = new.withColumn("_kept", F.lit(False)).unionByName(kept.select(*facts.columns).withColumns(marks).withColumn("_kept", F.lit(True)))
        met = _meetings(new, every, cell).filter((x < y) | (F.col("y__kept") & (x != y)))
        a, b = ((lambda c, one=one, two=two: F.when(x < y, F.col(f"{one}_{c}")).otherwise(F.col(f"{two}_{c}"))) for one, two in ("xy", "yx"))
    own = lambda side: F.struct(*(side(c).alias(c) for c in facts.columns))
    of = lambda side: F.struct(*(side(m).alias(m[1:]) for m in marks))
    pairs = met.select(own(a).alias("a"), own(b).alias("b"), of(a).alias("of_a"), of(b).alias("of_b"))
    far = F.coalesce(F.col("of_a.domain_metric") != F.col("of_b.domain_metric"), F.lit(False)) & (token_similarity(F.col("of_a.domain_tokens"), F.col("of_b.domain_tokens")) < L.TOKEN_SIMILARITY)
    return pairs.filter(~F.coalesce(F.col("of_a.segment_name") != F.col("of_b.segment_name"), F.lit(False)) & ~F.coalesce(far, F.lit(False)))


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    """Of pairs with the same two fact ids the first by the facts' places: for facts whose ids repeat."""
    ids = Window.partitionBy(F.least("a.fact_id", "b.fact_id"), F.greatest("a.fact_id", "b.fact_id")).orderBy("a.doc_pos", "a.fact_no", "b.doc_pos", "b.fact_no")
    return pairs.withColumn("_n", F.row_number().over(ids)).filter("_n = 1").drop("_n")


def compare(pairs: DataFrame) -> DataFrame:
    """Pairs with told (a flag for each way in which the facts differ), period_case, reconciling (the dimensions that explain a difference), reasons (those that forbid comparison), numeric and comparable, and with what classify() takes from both facts.

    Whatever is taken from a and b is taken here, in one step: a query that doesn't ask for the facts themselves then never carries them.
    """
    a, b = (lambda n: F.col(f"of_a.{n}")), (lambda n: F.col(f"of_b.{n}"))
    differ = lambda name: F.coalesce(a(name) != b(name), F.lit(False))
    same_period = (a("period") == b("period")) & (a("period") != "unspecified")
    undated = (a("period") == "unspecified") | (b("period") == "unspecified")
    interim = ~same_period & ~undated & F.coalesce((a("year") == b("year")) & ((a("part") & b("full")) | (b("part") & a("full"))), F.lit(False))
    period = first_match([(same_period, F.lit("exact")), (undated, F.lit("undated")), (interim, F.lit("interim")), (differ("year"), F.lit("fiscal_year")), (differ("quarter"), F.lit("quarter"))], F.lit("timeframe"))
    entity_scope = (a("whole") & b("alone")) | (a("alone") & b("whole"))
    adjusted = a("adjusted") != b("adjusted")
    flags = {
        "period": interim, "scope": entity_scope, "segment": ~entity_scope & (a("segment") != b("segment")),
        "basis": adjusted, "constant_currency": ~adjusted & (a("constant_currency") != b("constant_currency")),
        "operations": (a("continuing") | b("continuing")) & (a("operations") != b("operations")),
        "audit": a("restated") != b("restated"),
        "geography": differ("geography"), "estimate": differ("is_estimate"), "gross_net": differ("gross_or_net"),
        "currency": differ("currency"), "unit": differ("unit"),
    }
    dimensions = list(flags)[:10]
    label = F.when(a("period") == b("period"), F.col("a.p.label")).otherwise(F.concat(F.col("a.p.label"), F.lit(" vs "), F.col("b.p.label")))
    opposed = (a("negative") & b("positive")) | (a("positive") & b("negative"))
    taken = {
        "fact_a": F.col("a.fact_id"), "fact_b": F.col("b.fact_id"), "entity": F.col("a.entity"), "concept_id": F.col("a.c.concept_id"), "period_label": label,
        "place": F.struct("a.doc_pos", "a.fact_no", F.col("b.doc_pos").alias("b_doc_pos"), F.col("b.fact_no").alias("b_fact_no")),
        "value_a": a("value"), "value_b": b("value"), "same_period": same_period, "opposed": opposed, "numeric": a("value").isNotNull() & b("value").isNotNull(),
    }
    found = ["a", "b", "period_case", *taken]
    out = pairs.select("a", "b", *(c.alias(f"told_{n}") for n, c in flags.items()), period.alias("period_case"), *(c.alias(n) for n, c in taken.items()))
    listed = lambda names: F.array_compact(F.array(*names))
    any_of = lambda names: reduce(or_, (F.coalesce(F.col(f"told_{n}"), F.lit(False)) for n in names))
    told = F.struct(*(F.col(f"told_{n}").alias(n) for n in flags))
    forbids = [F.when(F.col("told_currency"), F.lit("currency")), F.when(F.col("told_unit"), F.lit("unit")), F.when(F.col("period_case") != "exact", F.lit("period"))]
    # comparable goes by the flags: the lists are made only where they are asked for
    alike = F.coalesce("same_period", F.lit(False)) & ~any_of(["currency", "unit"])
    out = out.select(*found, told.alias("told"), listed([F.when(F.col(f"told_{n}"), F.lit(n)) for n in dimensions]).alias("reconciling"), listed(forbids).alias("reasons"), any_of(dimensions).alias("explained"), alike.alias("alike"))
    return out.select("*", (F.col("numeric") & F.col("alike") & ~F.col("explained")).alias("comparable"))


def variance(a: Column, b: Column) -> Column:
    """Percent of the larger magnitude, two decimals; 0 where both are 0."""
    top = F.greatest(F.abs(a), F.abs(b))
    return F.when(top > 0, round2(F.abs(a - b) / top * 100)).otherwise(F.lit(0.0))


def polarity(statement: Column, words: str) -> Column:
    low = F.lower(F.coalesce(statement, F.lit("")))
    return F.exists(F.array(*map(F.lit, words.split("|"))), lambda w: F.contains(low, w))


def classify(compared: DataFrame) -> DataFrame:
    """Relationships: all of `compared`, and rel_id, type, confidence, priority, both fact ids, entity, concept_id, places, variance_percent, difference, period_label."""
    a, b = F.col("value_a"), F.col("value_b")
    percent = F.when(F.col("comparable"), variance(a, b))
    said = ~F.col("numeric") & F.col("same_period")
    case = lambda kind, sure, rank: F.struct(F.lit(kind).alias("type"), F.lit(sure).alias("confidence"), F.lit(rank).alias("priority"))
    verdict = first_match(
        [
            (F.col("comparable") & (F.col("variance_percent") <= L.TOLERANCE), case("CORROBORATED", 0.98, 3)),
            (F.col("comparable"), case("CONTRADICTED", 0.95, 1)),
            (F.col("explained"), case("RECONCILED BY CONTEXT", 0.92, 2)),
            (said & F.col("opposed"), case("CONTRADICTED", 0.88, 1)),
            (said, case("CORROBORATED", 0.84, 3)),
        ],
        case("UNCERTAIN", 0.65, 4),
    )
    own = compared.select("*", percent.alias("variance_percent")).select("*", verdict.alias("r"))
    return own.select(
        F.concat_ws("_", F.lit("rel"), "fact_a", "fact_b").alias("rel_id"),
        "r.type", "r.confidence", "r.priority", "fact_a", "fact_b", "entity", "place", "concept_id", "period_label",
        "variance_percent", F.when(F.col("comparable"), F.abs(a - b)).alias("difference"), "reconciling", "reasons", "told", "period_case", "numeric", "comparable", "a", "b",
    )


def relate(facts: DataFrame, repeated_ids: bool = False) -> DataFrame:
    """All relationships between facts of different documents, unsorted; ranked() gives the reading order. With `repeated_ids`, two facts' ids are related once.

    The normalised facts are written to the scratch folder at once.
    """
    pairs = candidate_pairs(written(normalize_facts(facts), "facts"))
    return classify(compare(distinct_pairs(pairs) if repeated_ids else pairs))


def ranked(relationships: DataFrame) -> DataFrame:
    """Contradictions first, then reconciled, corroborated and uncertain ones; each kind in the order of its facts."""
    return relationships.orderBy("priority", "place")


TYPES = ["CONTRADICTED", "RECONCILED BY CONTEXT", "CORROBORATED", "UNCERTAIN"]


def summary(relationships: DataFrame) -> DataFrame:
    """(type, n, percent) of all four types, zeros included, from one pass."""
    counts = relationships.agg(F.count("*").alias("total"), *(F.count_if(F.col("type") == t).alias(f"n{i}") for i, t in enumerate(TYPES)))
    rows = counts.select("total", F.explode(F.array(*(F.struct(F.lit(t).alias("type"), F.col(f"n{i}").alias("n")) for i, t in enumerate(TYPES)))).alias("r"))
    return rows.select("r.type", "r.n", F.coalesce(F.floor(100 * F.col("r.n") / F.nullif(F.col("total"), F.lit(0)) + 0.5), F.lit(0)).cast("long").alias("percent"))
