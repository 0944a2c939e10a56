"""Totals, rates and digests of record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def conditions(rows: DataFrame, total: str, **named: Column) -> DataFrame:
    """One row: how many rows there are and how many meet each condition."""
    return rows.agg(F.count("*").alias(total), *(F.count_if(c).alias(name) for name, c in named.items()))


def rate(hits: Column, misses: Column) -> Column:
    """Share of hits, 0 where there is nothing."""
    return F.coalesce(F.try_divide(hits, hits + misses), F.lit(0.0))


def collected(files: DataFrame, size: Column, error: Column) -> DataFrame:
    """Number and bytes of collected files, and whether none had an error."""
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("size_bytes"), (F.count(error) == 0).alias("success"))


def lines(text: Column) -> Column:
    """How many lines are not blank."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")).cast("long")


def directory_hash(files: DataFrame, directory: str, name: Column, digest: Column) -> DataFrame:
    """SHA-256 over the names and digests of a directory's files in the order of their names.

    The order makes it one value of all files: a directory's names and digests meet in
    one task, some 100 bytes a file.
    """
    found = files.groupBy(directory).agg(F.array_sort(F.collect_list(F.struct(name.alias("n"), digest.alias("d")))).alias("_files"))
    told = F.array_join(F.transform("_files", lambda f: F.concat(f["n"], f["d"])), "")
    return found.select(directory, F.sha2(told.cast("binary"), 256).alias("digest"))


def within_budget(rows: DataFrame, size: str, recency: list[str], most: float, share: float = 0.8) -> DataFrame:
    """What stays when the least recent rows are dropped until ``share`` of ``most`` holds the rest."""
    recent = Window.orderBy(*(F.desc(c) for c in recency)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_reached", F.sum(size).over(recent)).where(F.col("_reached") <= share * most).drop("_reached")
