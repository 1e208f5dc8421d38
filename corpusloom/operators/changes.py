"""What changed between two wordings of a statement, and which class an outcome belongs to; Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.operators import facets

#: Patterns in lower case; DuckDB reads them alike.
NUMBERS = r"(\d+(?:[.,]\d+)*)"
NEGATIONS = r"\b(not|no|never|none|neither|nor|without|cannot|could not|fails? to)\b"
HEDGES = r"\b(may|might|could|suggests?|suggestive|appears?|likely|possibly|perhaps|uncertain|limited|preliminary|weak)\b"


def _all(text: Column, pattern: str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1))))


def meaning_changes(before: Column, after: Column) -> Column:
    """The kinds of change, in this order: number, negation, qualification, scope; an empty array where none is.

    A number counts if either side has one that the other has not; a negation if
    their number of kinds differs; a qualification if the later text lost one; a
    scope if both state one and they differ.
    """
    a, b = facets.values(before, facets.SCOPE), facets.values(after, facets.SCOPE)
    found = (
        F.when(_all(before, NUMBERS) != _all(after, NUMBERS), "number"),
        F.when(F.size(_all(before, NEGATIONS)) != F.size(_all(after, NEGATIONS)), "negation"),
        F.when(F.size(F.array_except(_all(before, HEDGES), _all(after, HEDGES))) > 0, "qualification"),
        F.when(F.coalesce(a != b, F.lit(False)), "scope"),
    )
    return F.array_compact(F.array(*found))


def is_narrowing(before: Column, after: Column) -> Column:
    """Whether the later text only tightens: no number, negation or hedge of the earlier one is lost, and something is added."""
    kept = [F.size(F.array_except(_all(before, p), _all(after, p))) == 0 for p in (NUMBERS, NEGATIONS, HEDGES)]
    added = [F.size(F.array_except(_all(after, p), _all(before, p))) > 0 for p in (NUMBERS, HEDGES)]
    return kept[0] & kept[1] & kept[2] & (added[0] | added[1])


def error_class(status: Column) -> Column:
    """The class of a request's status: ok, rate_limited, rejected, unavailable, or unknown."""
    return F.when(status.between(200, 299), "ok").when(status == 429, "rate_limited").when(status.between(400, 499), "rejected").when(status >= 500, "unavailable").otherwise("unknown")
