"""Decision tables over verdicts, relations and citations, as Column expressions.

Every table is an ordered chain: the first rule that fires decides, and an unknown
(null) input fires none, so it falls to the last, cautious answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Verdicts that rest on evidence, and the relations that may carry each, the first choice first.
ANCHORS = {"supported": ("supports",), "partially_supported": ("supports", "contradicts"), "contradicted": ("contradicts",)}
#: Statuses from the most to the least cautious.
CAUTION = ("not_evaluated", "contested", "insufficient_evidence", "citation_not_confirmed", "supported_by_cited_source")


def enforced_relation(stated: Column, text: Column, quote: Column) -> Column:
    """The stated relation if its quotation stands word for word in the text, else neutral."""
    return F.when((F.length(quote) > 0) & F.contains(text, quote), F.coalesce(stated, F.lit("neutral"))).otherwise("neutral")


def anchored(df: DataFrame, claim: str, verdict: str, relation: str, passage: str, order: str) -> DataFrame:
    """claim, verdict, anchor: the first passage, in `order`, whose relation may carry the claim's verdict; null without one.

    A verdict's second relation counts only where no passage has the first. One
    partial aggregation, whatever the number of passages of a claim.
    """
    place = F.lit(None).cast("int")
    for name, accepted in ANCHORS.items():
        for k, r in enumerate(accepted):
            place = F.when((F.col(verdict) == name) & (F.col(relation) == r), F.lit(k)).otherwise(place)
    best = F.min(F.when(place.isNotNull(), F.struct(place.alias("k"), F.col(order).alias("o"), F.col(passage).alias("p"))))
    return df.groupBy(claim, verdict).agg(best.alias("best")).select(claim, verdict, F.col("best.p").alias("anchor"))


def downgraded(verdict: Column, anchor: Column) -> tuple[Column, Column]:
    """(verdict, whether it was taken back): one that rests on evidence needs an anchor, else not_enough_evidence."""
    back = verdict.isin(*ANCHORS) & anchor.isNull()
    return F.when(back, "not_enough_evidence").otherwise(verdict), F.coalesce(back, F.lit(False))


def citation_assessment(conflict: Column, required: Column, citations: Column, valid: Column, verdict: Column) -> Column:
    """conflicting, not_required, missing, valid, partially_valid or invalid, from counts of a claim's citations."""
    return (
        F.when(conflict, "conflicting")
        .when(~required, "not_required")
        .when(citations == 0, "missing")
        .when(valid == 0, "invalid")
        .when((verdict == "partially_supported") | (valid < citations), "partially_valid")
        .otherwise("valid")
    )


def passage_outcome(relation: Column, verdict: Column) -> Column:
    """supports, partially_supports, contradicts or does_not_establish: quotation and verdict must agree."""
    return (
        F.when((relation == "supports") & (verdict == "supported"), "supports")
        .when((relation == "supports") & (verdict == "partially_supported"), "partially_supports")
        .when((relation == "contradicts") & verdict.isin("contradicted", "partially_supported"), "contradicts")
        .otherwise("does_not_establish")
    )


def claim_status(pool: Column, outcomes: Column) -> Column:
    """A claim's status from the pool's verdict and the outcomes (an array) of the passages it cites."""
    has = lambda *names: F.arrays_overlap(outcomes, F.array(*[F.lit(n) for n in names]))
    return (
        F.when(pool.isNull() | (pool == "not_evaluated"), "not_evaluated")
        .when((pool == "contradicted") | has("contradicts"), "contested")
        .when(pool.isin("unsupported", "not_enough_evidence"), "insufficient_evidence")
        .when(has("supports", "partially_supports"), "supported_by_cited_source")
        .when(has("not_evaluated"), "not_evaluated")
        .otherwise("citation_not_confirmed")
    )


def placement(status: Column, partial: Column, important: Column) -> Column:
    """Where a claim of this status stands in a report."""
    return (
        F.when(status == "supported_by_cited_source", F.when(partial, "qualified").otherwise("body"))
        .when(status.isin("citation_not_confirmed", "contested"), status)
        .when(status == "insufficient_evidence", F.when(important, "unresolved").otherwise("unverified_list"))
        .otherwise("not_evaluated")
    )


def most_cautious(status: Column) -> Column:
    """The most cautious status of a group (an aggregate)."""
    return F.min_by(status, F.array_position(F.array(*[F.lit(c) for c in CAUTION]), status))


def cell_status(present: Column, available: Column, claims: Column, judged: Column) -> Column:
    """missing, unavailable, no_claims, error or judged: what became of a cell of an evaluation."""
    return F.when(~present, "missing").when(~available, "unavailable").when(claims == 0, "no_claims").when(judged == 0, "error").otherwise("judged")


def agreed(verdict: Column, expected: Column, acceptable: Column) -> Column:
    """Whether a verdict is among the acceptable ones, by default the expected one alone."""
    return F.array_contains(F.coalesce(acceptable, F.array(expected)), verdict)
