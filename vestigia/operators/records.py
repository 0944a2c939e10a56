"""Filters, pages, scopes, joins and sessions over record tables."""

from __future__ import annotations

import base64
import fnmatch
import json
import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed


def parse_time(value: str | None, now: datetime | None = None) -> datetime | None:
    """``7d``, ``12h``, ``30m`` before now, or an ISO time; anything else is no filter."""
    if not value:
        return None
    if value[-1] in "dhm":
        unit = {"d": "days", "h": "hours", "m": "minutes"}[value[-1]]
        return (now or datetime.now(UTC)) - timedelta(**{unit: int(value[:-1])}) if value[:-1].isdigit() else None
    try:
        return datetime.fromisoformat(value.replace("Z", "+00:00"))
    except ValueError:
        return None


def between(df: DataFrame, timestamp: str, since=None, until=None) -> DataFrame:
    """Rows from ``since`` to ``until``, both included; rows without a time always stay."""
    at = F.col(timestamp)
    for limit, keeps in ((since, at.__ge__), (until, at.__le__)):
        if limit is not None:
            df = df.where(at.isNull() | keeps(F.lit(limit)))
    return df


def key_contains(df: DataFrame, column: str, part: str) -> DataFrame:
    return df.where(F.contains(F.lower(column), F.lit(part.lower())))


def page(df: DataFrame, order: list[str], limit: int, after: tuple | None = None) -> DataFrame:
    """The next ``limit`` rows in order after a key; a top-k per task, never a global sort."""
    if after is not None:
        key = F.lit(False)
        for name, value in reversed(list(zip(order, after, strict=True))):
            key = (F.col(name) > F.lit(value)) | ((F.col(name) == F.lit(value)) & key)
        df = df.where(key)
    return df.orderBy(*order).limit(limit)


def encode_cursor(offset: int, time: str | None, record: str | None, count: int) -> str:
    told = json.dumps({"o": offset, "t": time, "r": record, "n": count}, separators=(",", ":"))
    return base64.urlsafe_b64encode(told.encode()).decode()


def decode_cursor(token: str) -> dict:
    try:
        return json.loads(base64.urlsafe_b64decode(token))
    except ValueError as e:
        raise ValueError("not a cursor") from e


def cursor(offset: Column, time: Column, record: Column, count: Column) -> Column:
    told = F.format_string('{"o":%d,"t":"%s","r":"%s","n":%d}', offset, time, record, count)
    # Spark breaks base64 into lines of 76 characters; what has no counterpart is left out.
    return F.translate(F.base64(F.encode(told, "utf-8")), "+/\r\n", "-_")


def catalogue(spark: SparkSession) -> DataFrame:
    rows = [(i, t, c, p, list(paths), glob) for i, (t, c, p, paths, glob) in enumerate(fixed.ARTIFACTS)]
    return spark.createDataFrame(rows, "pos int, artifact_type string, category string, priority int, paths array<string>, file_pattern string")


def in_scope(artifacts: DataFrame, scope: str | None) -> DataFrame:
    """Artifacts of a preset; an empty list in it allows all. Ordered by priority."""
    categories, types, _ = fixed.SCOPES[scope] if scope else ((), (), 0)
    if categories:
        artifacts = artifacts.where(F.col("category").isin(*categories))
    if types:
        artifacts = artifacts.where(F.col("artifact_type").isin(*types))
    return artifacts.orderBy("priority", "pos")


def collect(files: DataFrame, spark: SparkSession, scope: str | None = None) -> DataFrame:
    """Files (path, content) of a scope with their type, hashes and, if too large, the reason."""
    largest = (fixed.SCOPES[scope][2] if scope else 100) * 1024 * 1024
    rules = []
    for row in in_scope(catalogue(spark), scope).collect():  # 18 rows at most
        rules += [(row.artifact_type, _glob(p, row.file_pattern)) for p in row.paths]
    kind = F.coalesce(*(F.when(F.col("path").rlike(pattern), name) for name, pattern in rules))
    size = F.length("content").cast("bigint")
    return (
        files.withColumn("artifact_type", kind)
        .where("artifact_type is not null")
        .select("path", "artifact_type", size.alias("size_bytes"), F.when(size > largest, "exceeds size limit").alias("skipped"), F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))
    )


def _glob(path: str, inside: str | None) -> str:
    star = lambda p: re.escape(p).replace(r"\*", "[^/]*")
    last = path.rsplit("/", 1)[-1]
    if inside and "*" not in last:
        return f"(?i)^{star(path)}/{star(inside)}$"
    return f"(?i)^{star(path)}(/.*)?$" if "." not in last and not inside and not fnmatch.fnmatch(last, "*[$*]*") else f"(?i)^{star(path)}$"


def first_match(left: DataFrame, right: DataFrame, key: str, name: str, other: str, order: str) -> DataFrame:
    """For each left row the first right row, in ``order``, where one name contains the other.

    The right side is a catalogue; a left row with no match is returned with nulls.
    """
    on = F.contains(F.col(name), F.col(other)) | F.contains(F.col(other), F.col(name))
    joined = left.join(right, on, "left")
    values = [c for c in right.columns if c != order]
    return joined.groupBy(key, name).agg(F.min_by(F.struct(*values), order).alias("m")).select(key, name, "m.*")


def blocks(lines: DataFrame, file: str, number: str, starts: Column) -> DataFrame:
    """Adds ``block``: how many starting lines the file had up to this one."""
    window = Window.partitionBy(file).orderBy(number).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("block", F.sum(F.when(starts, 1).otherwise(0)).over(window))
