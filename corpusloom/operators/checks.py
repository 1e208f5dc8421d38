"""Constraints as data: frames of the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def breaking(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """rule, key of every row for which a rule is not true; a rule that is null (unknown) is kept."""
    names = F.array_compact(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()]))
    return df.select(F.col(key).cast("string").alias("key"), F.explode(names).alias("rule")).select("rule", "key")


def repeated(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(name).alias("rule"), F.concat_ws("|", *keys).alias("key"))


def dangling(df: DataFrame, key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """Distinct non-null references without a parent."""
    refs = df.select(F.col(key).alias("_k")).filter("_k is not null").distinct()
    return refs.join(parent.select(F.col(parent_key).alias("_k")).distinct(), "_k", "left_anti").select(F.lit(name).alias("rule"), F.col("_k").cast("string").alias("key"))


def transitions(df: DataFrame, group: str, order: list[str], status: str, allowed: list[tuple[str | None, str]]) -> DataFrame:
    """Rows whose status may not follow the one before; (None, s) allows s at the start."""
    w = Window.partitionBy(group).orderBy(*order)
    pair = df.withColumn("before", F.lag(status).over(w))
    ok = F.lit(False)
    for a, b in allowed:
        ok = ok | ((F.col("before").isNull() if a is None else F.col("before") == a) & (F.col(status) == b))
    return pair.filter(~F.coalesce(ok, F.lit(False)))
