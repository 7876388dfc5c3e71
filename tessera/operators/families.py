"""Families of interchangeable pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group(pieces: DataFrame, key: list[str]) -> DataFrame:
    """Members and first piece of each family of a job, numbered in order of first occurrence."""
    g = pieces.groupBy("job_id", *key).agg(F.count(F.lit(1)).alias("members"), F.min("ord").alias("first_ord"))
    return g.withColumn("family", F.row_number().over(Window.partitionBy("job_id").orderBy("first_ord")).cast("long"))


def class_key(*columns: str):
    """One key for pieces that can stand for each other."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def distinct_shapes(pieces: DataFrame, key: list[str]) -> DataFrame:
    """Shapes to be measured once, with a representative; results join back on the key."""
    return pieces.groupBy(*key).agg(F.count(F.lit(1)).alias("pieces"), F.min("piece_id").alias("representative"))
