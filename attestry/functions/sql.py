"""The column functions as temporary SQL functions, made from their very expressions: no Python runs on rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import find
from .concept import canonical_entity, category, classify_concept, concept_fields, context, metric_tokens, token_similarity
from .period import normalize_period
from .value import normalize_value

#: Name, parameters (name, type) and the expression of each function.
FUNCTIONS: dict[str, tuple[dict[str, str], Callable[..., Column]]] = {
    "normalize_value": ({"raw": "string", "evidence": "string"}, normalize_value),
    "normalize_value_known": ({"raw": "string", "evidence": "string", "known_currency": "string", "known_unit": "string"}, normalize_value),
    "normalize_period": ({"period": "string"}, normalize_period),
    "fact_context": ({"said": "string"}, lambda said: context(F.lower(said))),
    "metric_tokens": ({"metric": "string"}, metric_tokens),
    "token_similarity": ({"one": "array<string>", "two": "array<string>"}, token_similarity),
    "classify_concept": ({"metric": "string", "evidence": "string"}, classify_concept),
    "classify_concept_in": ({"metric": "string", "evidence": "string", "basis": "string", "scope_detail": "string"}, classify_concept),
    "concept_fields": ({"metric": "string", "evidence": "string", "basis": "string", "scope_detail": "string"}, concept_fields),
    "canonical_metric": ({"metric": "string"}, lambda metric: classify_concept(metric, F.lit(None).cast("string")).concept_id),
    "canonical_entity": ({"entity": "string"}, canonical_entity),
    "metric_category": ({"metric": "string"}, category),
    "find_period": ({"said": "string"}, find.find_period),
    "find_metric": ({"line": "string"}, find.metric_in),
    "find_amount": ({"line": "string", "metric": "string", "kind": "string"}, find.value_in),
    "find_entity": ({"line": "string"}, find.entity_in_line),
    "entity_of_file": ({"file": "string"}, find.entity_of_file),
}

_LITERAL = re.compile(r"('(?:[^'\\]|\\.)*')", re.S)
#: Operators that an expression's text writes as calls; quoted, they are calls in SQL too.
_OPERATOR = re.compile(r"(?<![\w`])([-+*/%&|^~<>=!]+|and|or|in|not)(?=\()")


def expression_text(column: Column) -> str:
    """A column expression as SQL text."""
    parts = _LITERAL.split(column._jc.node().sql())
    return "".join(p if i % 2 else _OPERATOR.sub(r"`\1`", p) for i, p in enumerate(parts))


def register(spark: SparkSession, prefix: str = "", names: list[str] | None = None) -> list[str]:
    """Create a temporary SQL function for each of FUNCTIONS (or of `names`), its name after `prefix`, and return the names. Functions of these names are replaced."""
    made = []
    for name in names or list(FUNCTIONS):
        parameters, function = FUNCTIONS[name]
        arguments = spark.range(0).select(*(F.lit(None).cast(t).alias(p) for p, t in parameters.items()))
        body = function(*(F.col(p) for p in parameters))
        returns = arguments.select(body.alias("r")).schema["r"].dataType.simpleString()
        declared = ", ".join(f"{p} {t}" for p, t in parameters.items())
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({declared}) RETURNS {returns} RETURN {expression_text(body)}")
        made.append(prefix + name)
    return made
