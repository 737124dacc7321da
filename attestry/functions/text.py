"""Text helpers: ASCII word bounds, first-match rules, rounding."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[A-Za-z0-9_]"
#: A word bound as ASCII regexes have it; Java's own \b also takes letters beyond ASCII for parts of a word.
BOUND = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def pattern(text: str) -> str:
    return "(?i)" + text.replace(r"\b", BOUND)


def has(column: Column, text: str) -> Column:
    """Whether the pattern is found; false for null."""
    return F.coalesce(column.rlike(pattern(text)), F.lit(False))


def has_word(column: Column, words: str) -> Column:
    return has(column, rf"\b(?:{words})\b")


#: Letters of a word that the index of phrases goes by.
STEM = 3


def stems(words: str) -> list[str]:
    """What words of a text begin with where it holds one of the phrases `words` (plain ones, divided by |), their blanks there or not."""
    found = set()
    for phrase in words.split("|"):
        parts = phrase.split(" ")
        found |= {re.match(r"\w+", "".join(parts[:n]))[0][:STEM].lower() for n in range(1, len(parts) + 1)}
    return sorted(found)


def stems_in(column: Column, of: list[str]) -> Column:
    """Those of the stems `of` that words of a text begin with, in one pass: what an index of many phrases is asked for."""
    begun = F.transform(F.regexp_extract_all(column, F.lit(f"{WORD}+"), F.lit(0)), lambda w: F.lower(F.left(w, F.lit(STEM))))
    return F.filter(begun, lambda w: w.isin(*of))


def has_word_of(column: Column, found: Column, words: str, blanks: str = " ") -> Column:
    """has_word() of the phrases `words`, `blanks` between their words, tried only where `found`, the text's stems_in(), has a stem of theirs."""
    near = F.coalesce(F.arrays_overlap(found, F.array(*map(F.lit, stems(words)))), F.lit(False))
    return near & has_word(column, words.replace(" ", blanks))


def grab(column: Column, text: str, group: int = 1) -> Column:
    """The group of the first match; null where nothing (or nothing but an empty string) is found."""
    return F.nullif(F.regexp_extract(column, pattern(text), group), F.lit(""))


def first_match(rules: list[tuple[Column, Column]], default: Column | None = None) -> Column:
    """The value of the first rule whose condition holds: one CASE WHEN."""
    out = F.when(*rules[0])
    for rule in rules[1:]:
        out = out.when(*rule)
    return out if default is None else out.otherwise(default)


def round2(x: Column) -> Column:
    """Two decimals, halves up."""
    return F.floor(x * 100 + 0.5) / 100


def let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """body over a struct of `values`, each of which is computed once however often the body names it."""
    return F.get(F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), body), F.lit(0))
