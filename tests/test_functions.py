"""Scalar functions against tables of cases."""

import random

import pytest
from pyspark.sql import functions as F

from attestry.functions import lexicon as L
from attestry.functions.concept import canonical_entity, classify_concept, metric_tokens
from attestry.functions.period import normalize_period
from attestry.functions.text import has_word, has_word_of, stems, stems_in
from attestry.functions.value import normalize_value


def rows(spark, values, **columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.asDict() for r in df.select("i", *(c.alias(n) for n, c in columns.items())).orderBy("i").collect()]


VALUES = {
    "1234.56": (123.0, "text", None, 1.0),
    "47779": (477.0, "text", None, 1.0),
    "1,23,456": (1.0, "text", None, 1.0),
    "($12.5M)": (-12.5e6, "currency", "USD", 1e6),
    "50 bps": (0.5, "percentage", None, 0.01),
    "28.5%": (28.5, "percentage", None, 1.0),
    "₹117 million": (1.17e8, "currency", "INR", 1e6),
    "42,500 employees": (42500.0, "count", None, 1.0),
    "RSU 5": (5.0, "currency", "INR", 1.0),
    "no digits": (None, "text", None, 1.0),
    "": (None, "text", None, 1.0),
    None: (None, "text", None, 1.0),
}


def test_values(spark):
    got = rows(spark, list(VALUES), v=normalize_value(F.col("t"), F.lit("")))
    for r, (text, want) in zip(got, VALUES.items(), strict=True):
        assert (r["v"]["base_value"], r["v"]["unit_type"], r["v"]["currency"], r["v"]["scale"]) == want, text


PERIODS = {
    "4Q24": "FY2024-ANNUAL", "FY24": "FY2024-ANNUAL", "Q4 FY24": "FY2024-Q4", "six months ended June 30, 2024": "FY2024-H1",
    "2024-12-31": "2024-12-31", "TTM": "TTM", "TTM 2023": "TTM-2023", "December 31, 2024": "2024-12-31", "maybe 2024": "2024-05-01",
    "Unspecified Period": "unspecified-period", "": "unspecified", None: "unspecified", "nine months ended 2022": "FY2022-9M", "year ended 2021": "FY2021-ANNUAL",
}


def test_periods(spark):
    got = rows(spark, list(PERIODS), p=normalize_period(F.col("t")))
    for r, (text, want) in zip(got, PERIODS.items(), strict=True):
        assert r["p"]["key"] == want, text


@pytest.mark.parametrize(
    ("metric", "concept", "family"),
    [
        ("Revenue from Operations", "revenue_total", "revenue"), ("PAT profitability", "net_profit", "profit_net"), 
        ("Contingent liability reserve", "contingent_liability", "contingency"), ("Total Income", "total_income", "income_total"), ("gross profit margin", "margin_net", "margin"), ("non-operating income", "other_income", "income_other"), ("Attrition Rate", "ratio_attrition_rate", "ratio"), ("", "generic_unspecified", "domain_unclassified"),
    ],
)
def test_concepts(spark, metric, concept, family):
    got = rows(spark, [metric], c=classify_concept(F.col("t"), F.lit("")))[0]["c"]
    assert (got["concept_id"], got["concept_family"]) == (concept, family)


def test_entities_and_tokens(spark):
    names = {"Acme Corp": "acme", "ACME CLOUD TECHNOLOGIES INC": "acme_cloud", "Co-Op Bank": "op_bank", "Group Holdings Ltd": "primary_entity"}
    got = rows(spark, list(names), e=canonical_entity(F.col("t")), k=metric_tokens(F.col("t")))
    assert [r["e"] for r in got] == list(names.values())
    assert got[0]["k"] == ["acme", "corp"]


def _phrased(seed: int, n: int) -> list[str]:
    """Texts with phrases of the lexicon among other words: whole, in any case, without their blanks, or glued to letters."""
    draw = random.Random(seed)
    phrases = [p for *_, words in [*L.METRICS, *L.CONCEPTS, *L.MARGINS] for p in words.split("|")]
    changes = [str, str.upper, str.title, lambda p: p.replace(" ", ""), lambda p: p.replace(" ", " \t"), lambda p: f"x{p}", lambda p: f"{p}s", lambda p: f"é{p}", lambda p: f"({p}),", lambda p: p[:-1]]
    plain = ["the", "of", "ratio", "growth", "R", "&", "d", "Kİ", "net", "2024", "$5", "totaled", "-", "é", "Gross:", "\x0b"]
    return [" ".join(draw.choice(changes)(draw.choice(phrases)) if draw.random() < 0.3 else draw.choice(plain) for _ in range(draw.randint(0, 9))) for _ in range(n)]


def test_index_of_phrases(spark):
    """Each phrase is found where its plain rule finds it, and nowhere else; null texts hold none."""
    sets = [(words, blanks) for of, blanks in ((L.METRICS, r"\s*"), (L.CONCEPTS, " ")) for *_, words in of]
    own = sorted({s for words, _ in sets for s in stems(words)})
    df = spark.createDataFrame([(t,) for t in [*_phrased(7, 1500), "", None]], "t string").withColumn("found", stems_in(F.col("t"), own))
    both = df.select("t", *(F.struct(has_word_of(F.col("t"), F.col("found"), w, b).alias("got"), has_word(F.col("t"), w.replace(" ", b)).alias("want")).alias(f"c{i}") for i, (w, b) in enumerate(sets)))
    found = 0
    for r in both.collect():
        for i, (words, _) in enumerate(sets):
            assert r[f"c{i}"]["got"] == r[f"c{i}"]["want"], (r["t"], words)
            found += r[f"c{i}"]["got"]
    assert found > 1000
