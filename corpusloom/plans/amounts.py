"""Queries of the unit conversion operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import units
from corpusloom.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """row_id, dimension, amount_milli of every amount stated in a pool chunk."""
    return units.p1_found(table(spark, d, "pool_chunks"), table(spark, d, "unit_factors"))


def p1_by_unit(spark: SparkSession, d: str) -> DataFrame:
    """Per dimension and unit as stated: chunks, amounts, smallest and largest value in the common unit."""
    found = units.stated_amounts(table(spark, d, "pool_chunks"), table(spark, d, "unit_factors"))
    return found.groupBy("dimension", "unit", "common_unit").agg(
        F.countDistinct("row_id").alias("chunks"), F.count("*").alias("amounts"), F.min("amount_milli").alias("least_milli"), F.max("amount_milli").alias("most_milli")
    )


QUERIES = {"p1_found": p1_found, "p1_by_unit": p1_by_unit}
ORACLE: dict[str, str] = {}
