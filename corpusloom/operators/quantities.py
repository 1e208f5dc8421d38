"""Comparing stated amounts: tolerance, context, nearest counterpart and the class of a pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed value: the share of a value by which an approximate one may be off.
APPROXIMATE = 0.1


def step_of(numeral: Column) -> Column:
    """The place value of a numeral's last digit: 1 for `12`, 0.1 for `1.5`."""
    decimals = F.length(F.regexp_extract(numeral, r"[.,](\d+)$", 1))
    return F.pow(F.lit(10.0), -decimals)


def tolerance(value: Column, step: Column, approximate: Column) -> Column:
    """Half a step, and for approximate values their share on top."""
    return step / 2 + F.when(approximate, F.abs(value) * APPROXIMATE).otherwise(0.0)


def differ(a: Column, b: Column) -> Column:
    """Whether two stated contexts (sorted arrays, null: unstated) are not the same; unknown never differs."""
    return F.coalesce(a != b, F.lit(False))


def denominators_differ(a: Column, b: Column) -> Column:
    """Whether what two amounts are per has nothing in common, or is stated on one side only."""
    return F.when(a.isNull() & b.isNull(), False).when(a.isNull() | b.isNull(), True).otherwise(~F.arrays_overlap(a, b))


def periods_differ(a: Column, b: Column) -> Column:
    """Whether two stated periods differ and can be compared: calendar with calendar, duration with duration."""
    kind = lambda p: F.array_distinct(F.transform(p, lambda x: F.substring(x, 1, 1)))
    return F.coalesce((a != b) & F.arrays_overlap(kind(a), kind(b)), F.lit(False))


def pair_class(a: Column, b: Column) -> Column:
    """The class of two amounts: structs of value, low, high, step, approximate, dimension, unit, stated, and the facets.

    The first of six rules that fires: different_measure (dimension, denominator, or
    one number with different units), different_period (period, baseline),
    different_scope (method, scope), agree (the values overlap within rounding,
    approximation and range), disagree (only where period and scope are stated and
    equal and baseline and method are stated on both sides or neither), unresolved.
    A denominator stated on one side only is a different measure; any other context
    stated on one side only is unknown. An unknown value is unresolved.
    """
    room = tolerance(a["value"], a["step"], a["approximate"]) + tolerance(b["value"], b["step"], b["approximate"])
    low = lambda x: F.coalesce(x["low"], x["value"])
    high = lambda x: F.coalesce(x["high"], x["value"])
    overlap = (low(a) - room <= high(b)) & (low(b) - room <= high(a))
    same_number = (a["unit"] != b["unit"]) & (a["stated"] == b["stated"]) & (F.abs(a["value"] - b["value"]) > 1e-9 * F.greatest(F.abs(a["value"]), F.abs(b["value"])))
    both = lambda n: a[n].isNotNull() & b[n].isNotNull()
    settled = (a["baseline"].isNull() == b["baseline"].isNull()) & (a["method"].isNull() == b["method"].isNull())
    known_unit = (a["dimension"] != "number") | a["per"].isNotNull()
    return (
        F.when(a["value"].isNull() | b["value"].isNull(), "unresolved")
        .when((a["dimension"] != b["dimension"]) | denominators_differ(a["per"], b["per"]) | same_number, "different_measure")
        .when(periods_differ(a["period"], b["period"]) | differ(a["baseline"], b["baseline"]), "different_period")
        .when(differ(a["method"], b["method"]) | differ(a["scope"], b["scope"]), "different_scope")
        .when(overlap, "agree")
        .when(known_unit & both("period") & (a["period"] == b["period"]) & both("scope") & settled, "disagree")
        .otherwise("unresolved")
    )


def nearest(left: DataFrame, right: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Each left row with its nearest right row of the same keys by relative gap, ties by `name`.

    The neighbours of a value in sorted order are the only candidates, found by a
    union and two window functions, so no group is paired with itself.
    """
    both = left.select(*keys, F.col(value).alias("_v"), F.col(name).alias("_n"), F.lit(0).alias("_side")).unionByName(right.select(*keys, F.col(value).alias("_v"), F.col(name).alias("_n"), F.lit(1).alias("_side")))
    w = Window.partitionBy(*keys).orderBy("_v", F.desc("_side"), "_n")
    other = F.when(F.col("_side") == 1, F.struct("_v", "_n"))
    below = F.last(other, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    above = F.first(other, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    placed = both.withColumn("_b", below).withColumn("_a", above).filter("_side = 0")
    gap = lambda c: F.abs(F.col("_v") - F.col(c)["_v"]) / F.greatest(F.abs(F.col("_v")), F.abs(F.col(c)["_v"]), F.lit(1e-12))
    pick = F.when(F.col("_b").isNull(), F.col("_a")).when(F.col("_a").isNull(), F.col("_b")).when(gap("_a") < gap("_b"), F.col("_a")).otherwise(F.col("_b"))
    return placed.withColumn("_p", pick).filter("_p is not null").select(*keys, F.col("_n").alias(name), F.col("_v").alias(value), F.col("_p")["_n"].alias(f"other_{name}"), F.col("_p")["_v"].alias(f"other_{value}"))
