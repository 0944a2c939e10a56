"""Playbooks, plugins and the shape of what is shown: filters, orders, totals and pages."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from ..functions import fixed


def runs(rows: DataFrame, status: str | None = None, playbook: str | None = None) -> DataFrame:
    """Runs with the status and of the playbook, the latest first, those that never started last."""
    for name, value in (("status", status), ("playbook_id", playbook)):
        if value is not None:
            rows = rows.where(F.col(name) == F.lit(value))
    return rows.orderBy(F.desc_nulls_last("started_at"))


def started_since(rows: DataFrame, since) -> DataFrame:
    """Runs that started at a time or later; unlike records, those without a time go."""
    return rows.where(F.col("started_at") >= F.lit(since))


def plugins_for_artifact(plugins: DataFrame, artifact: str) -> DataFrame:
    """Enabled plugins one of whose capabilities is for the kind of artifact."""
    return plugins.where(F.col("enabled") & F.exists("capabilities", lambda c: c["artifact_type"] == F.lit(artifact)))


def plugins_for_extension(plugins: DataFrame, extension: str) -> DataFrame:
    """Enabled plugins one of whose capabilities lists the file extension, in any letter case."""
    listed = lambda c: F.exists(c["file_extensions"], lambda e: F.lower(e) == F.lit(extension.lower()))
    return plugins.where(F.col("enabled") & F.exists("capabilities", listed))


def execution_order(steps: Column) -> Column:
    """Ids of an array of (step_id, depends_on) in an order that respects the dependencies.

    Of the steps that are ready the first in the array comes next. Null where steps
    wait for each other, or for one that is not there. Playbooks are rows, so that many
    are ordered at once; work grows with the square of the steps of one.
    """
    none = F.array().cast("array<string>")

    def next_of(done: Column) -> Column:
        ready = F.filter(steps, lambda s: ~F.array_contains(done, s["step_id"]) & (F.size(F.array_except(F.coalesce(s["depends_on"], none), done)) == 0))
        return F.concat(done, F.transform(F.slice(ready, 1, 1), lambda s: s["step_id"]))

    found = F.aggregate(F.transform(steps, lambda s: s["step_id"]), none, lambda done, _: next_of(done))
    return F.when(F.size(found) == F.size(steps), found)


def step_totals(results: DataFrame, *by: str) -> DataFrame:
    """How many steps ended well, failed, or neither, and how many records they gave."""
    ended = lambda *names: F.count_if(F.coalesce(F.col("status"), F.lit("")).isin(*names))
    totals = (ended("success").alias("succeeded"), ended("failed").alias("failed"), (F.count("*") - ended("success", "failed")).alias("skipped"))
    return results.groupBy(*by).agg(*totals, F.coalesce(F.sum("records_processed"), F.lit(0)).cast("long").alias("records_processed"))


def passed(rows: DataFrame, condition: Column) -> DataFrame:
    """One row: how many rows were looked at, met the condition, and were skipped."""
    met = F.count_if(condition)
    return rows.agg(F.count("*").alias("processed"), met.alias("output"), (F.count("*") - met).alias("skipped"))


def distinct_names(named: Iterable[DataFrame], by: str, most: int = 20) -> DataFrame:
    """Per ``by`` the first ``most`` different non-empty names of several (by, name) tables, in order."""
    tables = iter(named)
    rows = next(tables)
    for other in tables:
        rows = rows.unionByName(other)
    # Distinct first: only different names meet in a group, and of them a task keeps what it shows.
    rows = rows.where("name <> ''").groupBy(by, "name").agg(F.lit(1).alias("_one")).groupBy(by)
    return rows.agg(F.count("*").alias("n_names"), F.slice(F.array_sort(F.collect_list("name")), 1, most).alias("names"))


def next_page(rows: DataFrame, order: list[str], limit: int, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """A page of ``limit`` rows, and one row that tells where the next begins.

    One row more than the page is looked at, so that a last page that is just full has
    no next one. ``next_offset`` is null there.
    """
    seen = rows.orderBy(*order).offset(offset).limit(limit + 1)
    more = seen.agg((F.count("*") > limit).alias("has_more")).withColumn("next_offset", F.when(F.col("has_more"), F.lit(offset + limit).cast("long")))
    return seen.limit(limit), more


def without_nulls(record: Column) -> Column:
    """A record as JSON without its null fields."""
    return F.to_json(record, {"ignoreNullFields": "true"})


def at_path(schema: StructType, path: str) -> Column:
    """The value at a dotted path; null where the record has no such field."""
    kind: DataType = schema
    value = None
    for part in path.split("."):
        if not isinstance(kind, StructType) or part not in kind.names:
            return F.lit(None)
        value = F.col(f"`{part}`") if value is None else value.getField(part)
        kind = kind[part].dataType
    return value


def shown_columns(schema: StructType) -> list[str]:
    """Columns to show: by what tells the kind of a record, else the first six."""
    if "data" in schema.names and isinstance(schema["data"].dataType, StructType):
        data = schema["data"].dataType.names
        for mark, columns in fixed.SHOWN_COLUMNS.items():
            if mark in data:
                return list(columns)
    return schema.names[:6]


def shown(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The columns to show, named by their paths."""
    return rows.select(*(at_path(rows.schema, c).alias(c) for c in columns or shown_columns(rows.schema)))
