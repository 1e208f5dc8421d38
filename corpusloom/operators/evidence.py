"""Claims and their evidence: alignment by labels, validity of citations, precedence, priority, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def best_by(precedence: list[str], value: Column) -> Column:
    """The value of a group that comes first in `precedence` (an aggregate); values outside it come last."""
    place = F.array_position(F.array(*[F.lit(v) for v in precedence]), value)
    return F.min_by(value, F.when(place > 0, place).otherwise(len(precedence) + 1))


def aligned(left: DataFrame, right: DataFrame, group: str, left_id: str, right_id: str, margin: int) -> DataFrame:
    """Each left row (labels) with the right row (markers) of its group that holds all its labels and fits best.

    A fit is the share of the markers that the labels use; the best must be ahead
    of the second by `margin` hundredths, else the row stays unaligned. Candidates
    come by one label, so a group is not paired with itself: rows without labels
    align with nothing.
    """
    first = left.select(group, left_id, "labels", F.array_min("labels").alias("_k")).filter("_k is not null")
    there = right.select(group, F.col(right_id), F.col("markers"), F.explode(F.array_distinct("markers")).alias("_k"))
    pairs = first.join(there, [group, "_k"]).filter(F.size(F.array_except("labels", "markers")) == 0)
    fit = F.floor(F.size(F.array_distinct("labels")) * 100 / F.size(F.array_distinct("markers")))
    w = Window.partitionBy(group, left_id).orderBy(F.desc("fit"), right_id)
    ranked = pairs.withColumn("fit", fit).withColumn("_n", F.row_number().over(w)).withColumn("_next", F.lead("fit").over(w))
    return ranked.filter((F.col("_n") == 1) & (F.col("_next").isNull() | (F.col("fit") - F.col("_next") >= margin))).select(group, left_id, right_id, "fit")


def validated(citations: DataFrame, evidence: DataFrame, claim: str, source: str, passage: str, order: str) -> DataFrame:
    """Citations with the first supporting passage of the cited source: `valid` with it, `misattributed` without, `fabricated` without a source."""
    first = evidence.groupBy(claim, source).agg(F.min_by(passage, order).alias("supporting"))
    status = F.when(F.col(source).isNull(), "fabricated").when(F.col("supporting").isNull(), "misattributed").otherwise("valid")
    return citations.join(first, [claim, source], "left").withColumn("status", status)


def prioritised(df: DataFrame, group: str, order: list[Column], cap: int) -> DataFrame:
    """`rank` from 0 by priority and whether a row falls within the cap."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    return df.withColumn("rank", rank).withColumn("evaluated", F.col("rank") < cap)


def coverage_status(total: Column, supported: Column, contested: Column) -> Column:
    """gap without claims, contested if any is, well from half supported, else mixed."""
    return F.when(total == 0, "gap").when(contested > 0, "contested").when(supported * 2 >= total, "well").otherwise("mixed")
