"""Joins that look one record up for another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_of(left: DataFrame, right: DataFrame, on: Column, key: str, order: str, value: str) -> DataFrame:
    """``left`` with the value of the last right row of its key, empty where there is none."""
    last = right.groupBy(F.col(key).alias("_key")).agg(F.max_by(value, order).alias(value))
    return left.join(last, on == F.col("_key"), "left").drop("_key").withColumn(value, F.coalesce(value, F.lit("")))


def first_by_hash(rows: DataFrame, key: str, content: str) -> DataFrame:
    """Per row the first key, in order, of the rows with the same content; rows without content are left out.

    Hashes are reduced to one row each before the join, so a hot group costs its members once.
    """
    hashed = rows.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("_hash")).where("_hash is not null")
    first = hashed.groupBy("_hash").agg(F.min(key).alias("target"))
    return hashed.join(first, "_hash").select(key, "target")
