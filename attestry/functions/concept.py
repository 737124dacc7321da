"""Metric tokens, concepts, entities and context dimensions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .text import first_match, has, has_word, let, pattern


def metric_tokens(name: Column) -> Column:
    """Words of a metric's name: lower case, longer than one character, without stop words."""
    cut = F.split(F.regexp_replace(F.lower(name), r"[^a-z0-9\s]", " "), r"\s+")
    return F.filter(cut, lambda t: (F.length(t) > 1) & ~t.isin(*L.STOPWORDS))


def token_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def concept_fields(metric: Column, evidence: Column, basis: Column | None = None, scope_detail: Column | None = None) -> Column:
    """classify_concept() with all that follows from it: struct(concept_id, concept_family, concept_label, is_ratio, is_growth, is_per_share, is_contingent, is_segment, segment_name, is_adjusted).

    Metrics without a concept of their own are labelled by their names; segment_name is the scope detail of a revenue.
    """
    detail = F.lit(None).cast("string") if scope_detail is None else scope_detail

    def fields(x: Column) -> Column:
        c = x.c
        labels = F.element_at(F.create_map(*(F.lit(v) for kv in L.CONCEPT_LABELS.items() for v in kv)), c.concept_id)
        label = F.when(c.concept_family == "growth_rate", F.concat(F.lit("Growth Rate: "), x.metric)).otherwise(F.coalesce(labels, x.metric))
        is_in = lambda *families: c.concept_family.isin(*families)
        return F.struct(
            c.concept_id.alias("concept_id"), c.concept_family.alias("concept_family"), label.alias("concept_label"),
            is_in("margin", "ratio", "growth_rate").alias("is_ratio"), is_in("growth_rate").alias("is_growth"), is_in("per_share").alias("is_per_share"), is_in("contingency").alias("is_contingent"),
            c.is_segment.alias("is_segment"), F.when(is_in("revenue"), x.detail).alias("segment_name"), c.is_adjusted.alias("is_adjusted"),
        )

    return let({"metric": metric, "detail": detail, "c": classify_concept(metric, evidence, basis, detail)}, fields)


def classify_concept(metric: Column, evidence: Column, basis: Column | None = None, scope_detail: Column | None = None) -> Column:
    """struct(concept_id, concept_family, is_adjusted, is_segment): one CASE, the first rule that holds wins."""
    given = lambda c: F.lit(None).cast("string") if c is None else c
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return let({"m": low(metric), "ev": low(evidence), "basis": given(basis), "detail": given(scope_detail)}, _flags)


def _flags(x: Column) -> Column:
    ratio = has_word(x.m, L.RATIO) | x.m.contains("%") | F.coalesce(F.lower(x.basis).contains("margin"), F.lit(False))
    adjusted = has_word(F.concat_ws(" ", x.m, x.ev), L.ADJUSTED)
    said = has_word(x.ev, "growth|yoy|cagr")
    return let({"m": x.m, "ratio": ratio, "growth": has_word(x.m, L.GROWTH) | (said & ratio), "adjusted": adjusted, "segment": has_word(x.m, L.SEGMENT) | x.detail.isNotNull(), "tokens": metric_tokens(x.m)}, _concept)


def _concept(x: Column) -> Column:
    m, ratio, growth, adjusted, segment, tokens = x.m, x.ratio, x.growth, x.adjusted, x.segment, x.tokens
    no = F.lit(False)

    def concept(name: Column, family: Column, is_adjusted: Column = no, is_segment: Column = no) -> Column:
        return F.struct(name.alias("concept_id"), family.alias("concept_family"), is_adjusted.alias("is_adjusted"), is_segment.alias("is_segment"))

    def head(prefix: str, n: int, empty: str) -> Column:
        return F.concat(F.lit(prefix), F.coalesce(F.nullif(F.array_join(F.slice(tokens, 1, n), "_"), F.lit("")), F.lit(empty)))

    rules = [(has_word(m, L.CONTINGENT), concept(F.lit("contingent_liability"), F.lit("contingency")))]
    rules += [(ratio & ~growth & has_word(m, words), concept(F.lit(name), F.lit("margin"), adjusted)) for name, words in L.MARGINS]
    rules += [(ratio & ~growth, concept(head("ratio_", 2, "unspecified"), F.lit("ratio"), adjusted)), (growth, concept(head("growth_", 2, "unspecified"), F.lit("growth_rate"), adjusted))]
    per_share = has_word(m, L.PER_SHARE)
    rules += [(per_share & m.contains("diluted"), concept(F.lit("eps_diluted"), F.lit("per_share"), adjusted)), (per_share, concept(F.lit("eps_basic"), F.lit("per_share"), adjusted))]
    late = False
    for name, family, words in L.CONCEPTS:
        late = late or name == "total_assets"  # from here on, nothing counts as adjusted
        flag = no if late else adjusted
        if name == "revenue":
            made = concept(F.when(segment, "revenue_segment").otherwise("revenue_total"), F.lit(family), flag, segment)
        elif name in ("net_profit", "ebitda", "operating_profit"):
            made = concept(F.when(adjusted, f"{name}_adjusted").otherwise(name), F.lit(family), flag)
        else:
            made = concept(F.lit(name), F.lit(family), flag)
        rules.append((has_word(m, words), made))
    generic = concept(head("generic_", 4, "unspecified"), F.concat(F.lit("domain_"), F.coalesce(F.get(tokens, F.lit(0)), F.lit("unclassified"))), adjusted)
    return first_match(rules, generic)


def canonical_entity(name: Column) -> Column:
    """The entity's key: lower case, without corporate words, `_` between words; the wildcard if under two characters are left."""
    bare = F.regexp_replace(F.lower(name), pattern(rf"\b(?:{L.CORPORATE})\b"), "")
    key = F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9]+", "_"), r"^_+|_+\z", "")
    return F.when(F.length(key) >= 2, key).otherwise(F.lit(L.WILDCARD_ENTITY))


def category(metric: Column) -> Column:
    return first_match([(has(metric, words), F.lit(name)) for name, words in L.CATEGORIES], F.lit("financial"))


def context(text: Column) -> Column:
    """struct of the context dimensions that a text states: basis, scope, operations, audit_status, geography, is_estimate, gross_or_net."""
    gross, net = has_word(text, "gross"), has_word(text, "net")
    return F.struct(
        first_match([(has_word(text, words), F.lit(name)) for name, words in L.BASES]).alias("basis"),
        first_match([(has_word(text, words), F.lit(name)) for name, words in L.SCOPES]).alias("scope"),
        first_match([(has_word(text, "continuing"), F.lit("Continuing")), (has_word(text, "discontinued"), F.lit("Discontinued"))], F.lit("Total")).alias("operations"),
        first_match([(has_word(text, "audited") & ~has_word(text, "unaudited"), F.lit("Audited")), (has_word(text, "unaudited|provisional|preliminary|unreviewed"), F.lit("Unaudited")), (has_word(text, "restated|reclassified|revised|retrospective"), F.lit("Restated"))]).alias("audit_status"),
        first_match([(has_word(text, words), F.lit(name)) for name, words in L.GEOGRAPHIES]).alias("geography"),
        has_word(text, L.ESTIMATES).alias("is_estimate"),
        first_match([(gross & ~net, F.lit("gross")), (net & ~gross, F.lit("net"))]).alias("gross_or_net"),
    )
