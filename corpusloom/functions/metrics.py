"""Rates, ranking measures and intervals as aggregate Columns. A rate of nothing is null, never 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACES = 4


def ratio(part: Column, whole: Column, places: int = PLACES) -> Column:
    """part / whole, rounded half up; null where whole is 0."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), places)


def rate(condition: Column, among: Column | None = None, places: int = PLACES) -> Column:
    """The share of rows where `condition` holds, among those where `among` does."""
    if among is None:
        return ratio(F.count_if(condition), F.count(F.lit(1)), places)
    return ratio(F.count_if(condition & among), F.count_if(among), places)


def precision_at(relevant: Column, place: Column, k: int) -> Column:
    """Relevant ones among the first k, over as many as there are of them."""
    return ratio(F.count_if(relevant & (place <= k)), F.count_if(place <= k))


def ndcg_at(relevant: Column, place: Column, k: int) -> Column:
    """Discounted gain of the first k over that of the same items in the best order; null without a relevant one."""
    gain = F.sum(F.when((place <= k) & relevant, 1 / F.log2(place + 1)).otherwise(0.0))
    hits = F.count_if(relevant & (place <= k)).cast("int")
    best = F.aggregate(F.sequence(F.lit(1), F.greatest(hits, F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1)))
    return F.round(F.when(hits > 0, gain / best), PLACES)


def wilson(part: Column, whole: Column, z: float = 1.96) -> Column:
    """struct(low, high): the score interval of a share, within [0, 1], three places; null where whole is 0."""
    n = F.nullif(whole.cast("double"), F.lit(0.0))
    p = part / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    bound = lambda c: F.when(n.isNotNull(), F.round(c, 3))
    return F.struct(bound(F.greatest(F.lit(0.0), centre - half)).alias("low"), bound(F.least(F.lit(1.0), centre + half)).alias("high"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, summed left to right in double; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def is_hallucination(verdict: Column) -> Column:
    """Whether a claim is unsupported or contradicted; unknown is neither."""
    return F.coalesce(verdict.isin("unsupported", "contradicted"), F.lit(False))


def unsupported_rate(verdict: Column) -> Column:
    """The share of all claims, judged or not, that are unsupported or contradicted."""
    return rate(is_hallucination(verdict))


def is_ratio(metric: Column) -> Column:
    """Whether a figure of this name is a share."""
    return metric.rlike(r"_(?:rate|precision|recall|coverage)$")


def compared(df: DataFrame, a: str, b: str, better: dict[str, str], name: str = "metric") -> DataFrame:
    """`df` with difference and relative difference of two columns (null where the base is 0), and better, worse or equal by which way is better."""
    up = F.lit(False)
    for metric, way in better.items():
        up = F.when(F.col(name) == metric, F.lit(way == "higher")).otherwise(up)
    gap = F.round(F.col(a) - F.col(b), PLACES)
    direction = F.when(gap == 0, "equal").when((F.col(a) > F.col(b)) == up, "better").when(gap.isNotNull(), "worse")
    return df.select(name, a, b, gap.alias("difference"), F.round(F.try_divide(F.col(a) - F.col(b), F.col(b)), PLACES).alias("relative"), direction.alias("direction"))
