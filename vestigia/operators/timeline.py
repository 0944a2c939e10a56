"""One time line of records from many sources. Rows without a time are left out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import basename, clipped
from . import risk


def _events(df: DataFrame, key: str, timestamp: str, source: str, **columns: Column) -> DataFrame:
    text = lambda k, default=None: columns.get(k, F.lit(default).cast("string")).alias(k)
    return df.where(F.col(timestamp).isNotNull()).select(
        F.col(timestamp).cast("timestamp").alias("timestamp"),
        F.col(key).cast("string").alias("record_id"),
        F.lit(source).alias("source"),
        *(text(k) for k in ("event_type", "description", "actor", "target", "action", "outcome")),
        text("severity", "info"),
        columns.get("tags", F.array().cast("array<string>")).alias("tags"),
    )


def severity(event_id: Column) -> Column:
    of = lambda level: [i for i, e in fixed.EVENTS.items() if e[2] == level]
    return F.when(event_id.isin(of("high")), "high").when(event_id.isin(of("medium")), "medium").otherwise("info")


def _lookup(event_id: Column, at: int, default: Column) -> Column:
    known = F.create_map(*(F.lit(x) for i, e in fixed.EVENTS.items() for x in (i, e[at])))
    return F.coalesce(F.try_element_at(known, event_id.cast("int")), default)


def event_log(df: DataFrame, key: str, timestamp: str, event_id: Column, **columns: Column) -> DataFrame:
    told = F.concat(F.lit("Event ID "), event_id.cast("string"))
    return _events(
        df, key, timestamp, "evtx", event_type=_lookup(event_id, 0, F.lit("security_event")), description=_lookup(event_id, 1, told),
        action=F.concat(F.lit("EventID:"), event_id.cast("string")), severity=severity(event_id), **columns,
    )


def executions(df: DataFrame, key: str, timestamp: str, source: str, path: Column) -> DataFrame:
    name = basename(F.coalesce(path, F.lit("unknown")))
    return _events(df, key, timestamp, source, event_type=F.lit("execution"), description=F.concat(F.lit("Program executed: "), name), target=path, action=F.lit("execute"), tags=F.array(F.lit("execution")))


def files(df: DataFrame, key: str, timestamp: str, name: Column, deleted: Column, stomped: Column) -> DataFrame:
    tags = F.when(stomped, F.array(F.lit("file"), F.lit("timestomping"))).otherwise(F.array(F.lit("file")))
    return _events(
        df, key, timestamp, "mft", event_type=F.lit("file_activity"), description=F.concat(F.lit("File activity: "), name), target=name,
        action=F.when(deleted, "file_delete").otherwise("file_modify"), severity=F.when(stomped, "medium").otherwise("info"), tags=tags,
    )


def visits(df: DataFrame, key: str, timestamp: str, url: Column, title: Column) -> DataFrame:
    told = F.concat(F.lit("Web visit: "), F.coalesce(F.nullif(title, F.lit("")), F.left(url, F.lit(50))))
    return _events(df, key, timestamp, "browser", event_type=F.lit("web_activity"), description=told, target=url, action=F.lit("web_visit"), tags=F.array(F.lit("web")))


def commands(df: DataFrame, key: str, timestamp: str, command: Column) -> DataFrame:
    found = risk.powershell(command)
    return _events(
        df, key, timestamp, "powershell", event_type=F.lit("command_execution"), description=F.concat(F.lit("PowerShell: "), clipped(command, 80)),
        action=F.lit("execute"), severity=risk.powershell_severity(found), tags=F.concat(F.array(F.lit("powershell")), found),
    )


def changes(df: DataFrame, key: str, timestamp: str, name: Column, reasons: Column) -> DataFrame:
    """Entries of a change journal; ``reasons`` is an array of names."""
    told = F.array_join(reasons, ", ")
    return _events(df, key, timestamp, "usnjrnl", event_type=F.lit("file_activity"), description=F.concat(F.lit("File change: "), name, F.lit(" ("), told, F.lit(")")), target=name, action=told, tags=F.array(F.lit("file")))


def shortcuts(df: DataFrame, key: str, timestamp: str, target: Column) -> DataFrame:
    return _events(
        df, key, timestamp, "lnk", event_type=F.lit("file_access"), description=F.concat(F.lit("Shortcut accessed: "), target), target=target,
        action=F.lit("shortcut_access"), tags=F.array(F.lit("user_activity")),
    )


#: What introduces a persistent program in its description, by source; fixed values.
PERSISTENT = {"scheduledtasks": "Scheduled Task: ", "services": "Service: ", "wmi": "WMI Persistence: "}


def persistence(df: DataFrame, key: str, timestamp: str, source: str, name: Column, indicators: Column) -> DataFrame:
    return _events(
        df, key, timestamp, source, event_type=F.lit("persistence"), description=F.concat(F.lit(PERSISTENT[source]), name), target=name, action=F.lit("persistence"),
        severity=F.when(F.size(indicators) > 0, "high").otherwise("info"), tags=F.concat(F.array(F.lit("persistence")), indicators),
    )


def activities(df: DataFrame, key: str, timestamp: str, source: str) -> DataFrame:
    """Records of any other source."""
    return _events(df, key, timestamp, source, event_type=F.lit("activity"), description=F.lit(f"Activity from {source}"))


def merged(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
