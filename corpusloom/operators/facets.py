"""Contexts in which an amount is stated, read from its sentence as sets; an empty set is null: unstated.

Kinds: period (calendar years and spans as y2010 or y2010-2015, durations as
d12weeks), per (what an amount is per), baseline, method, scope (whom it is about).
All are Column expressions over the text, so they stay in whole-stage code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns by kind, for texts in lower case; the first group is the value. DuckDB reads them alike.
YEARS = r"\b((?:19|20)\d\d)\b"
SPANS = r"\b((?:19|20)\d\d\s?[-–]\s?(?:19|20)\d\d)\b"
DURATIONS = r"\b(\d+\s(?:days?|weeks?|months?|years?))\b"
PER = r"(?:\bper\s|/\s?)(day|week|month|year|kg|kilogram|person|capita|litre|serving|dose|hour)\b"
BASELINE = r"\b(?:from|at|versus|than|relative to|compared with)\s(baseline|placebo|control|controls|usual care)\b"
METHOD = r"\b(trial|cohort|survey|registry|meta-analysis|case-control|pilot|observational|randomised|randomized|double-blind)\b"
SCOPE = r"\b(?:in|among|of|for)\s((?:[a-z-]+\s)?(?:adults|teenagers|women|men|children|infants|students|athletes|workers|staff|nurses|patients|people|volunteers|parents))\b"

PERCENT, YEAR = r"\d+(?:\.\d+)?%", r"\b(?:19|20)\d\d\b"


def places(text: Column, pattern: str) -> Column:
    """Array of struct(start, end, value) of a pattern's matches, in code points, in order."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    long = lambda parts: F.aggregate(parts, F.lit(0), lambda n, x: n + F.length(x))
    start = lambda i: long(F.slice(between, 1, i + 1)) + long(F.slice(found, 1, i))
    index = F.when(F.size(found) > 0, F.sequence(F.lit(0), F.size(found) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(index, lambda i: F.struct(start(i).alias("start"), (start(i) + F.length(F.get(found, i))).alias("end"), F.get(found, i).alias("value")))


def owners(facet: Column, mentions: Column, preceding: bool = False) -> Column:
    """The values of the mentions that a facet belongs to (structs of start, end, value; mentions in order).

    One before all mentions belongs to all. With `preceding` (what an amount is per),
    it belongs to the last mention before it, else to the first. Else it belongs to
    the nearest, on a tie to the one before it.
    """
    gap = lambda m: F.greatest(F.lit(0), m["start"] - facet["end"], facet["start"] - m["end"])
    before = lambda m: m["end"] <= facet["start"]
    rank = lambda m: F.struct((F.when(before(m), 0).otherwise(1) if preceding else gap(m)).alias("d"), F.when(before(m), 0).otherwise(1).alias("f"), F.when(before(m), -m["start"]).otherwise(m["start"]).alias("s"), m["value"].alias("v"))
    nearest = F.array(F.array_min(F.transform(mentions, rank))["v"])
    if preceding:
        return nearest
    return F.when(facet["end"] <= F.get(mentions, F.lit(0))["start"], F.transform(mentions, lambda m: m["value"])).otherwise(nearest)


def covering(text: Column, target: Column, mentions: Column) -> Column:
    """The first mention (struct of start, end, value) that overlaps the first occurrence of `target`; null without one."""
    at = F.instr(text, target) - 1
    return F.get(F.filter(mentions, lambda m: (at >= 0) & (m["start"] < at + F.length(target)) & (at < m["end"])), F.lit(0))


def values(text: Column, pattern: str) -> Column:
    """The distinct first groups of a pattern, sorted; null without one."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1))))
    return F.when(F.size(found) > 0, found)


def periods(text: Column) -> Column:
    """Spans, years outside any span, and durations, each marked by its kind; null without one."""
    low = F.lower(text)
    spans = F.transform(F.regexp_extract_all(low, F.lit(SPANS), F.lit(1)), lambda x: F.concat(F.lit("y"), F.regexp_replace(x, r"\s?[-–]\s?", "-")))
    years = F.transform(F.regexp_extract_all(F.regexp_replace(low, SPANS, " "), F.lit(YEARS), F.lit(1)), lambda x: F.concat(F.lit("y"), x))
    durations = F.transform(F.regexp_extract_all(low, F.lit(DURATIONS), F.lit(1)), lambda x: F.concat(F.lit("d"), F.regexp_replace(F.regexp_replace(x, r"\s", ""), r"s$", "")))
    found = F.array_sort(F.array_distinct(F.concat(spans, years, durations)))
    return F.when(F.size(found) > 0, found)


def facets(text: Column) -> Column:
    """struct(period, per, baseline, method, scope) of a sentence or text."""
    return F.struct(periods(text).alias("period"), values(text, PER).alias("per"), values(text, BASELINE).alias("baseline"), values(text, METHOD).alias("method"), values(text, SCOPE).alias("scope"))


def context_tokens(f: Column) -> Column:
    """All facets as sorted kind:value texts; an empty array without any."""
    kinds = ("period", "per", "baseline", "method", "scope")
    def marked(kind: str) -> Column:
        return F.transform(F.coalesce(f[kind], F.array().cast("array<string>")), lambda x: F.concat(F.lit(f"{kind}:"), x))

    return F.array_sort(F.concat(*map(marked, kinds)))
