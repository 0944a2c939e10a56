"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from .session import MEMORY_CONF, apply_memory


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.

    Where ``spark.checkpoint.dir`` is unset a temporary folder is made and kept in the
    session's settings, on a local master only: executors elsewhere could not read it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("vestigia.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="vestigia-")
        spark.conf.set("vestigia.shared.dir", found)
    return found.rstrip("/")


#: Spark's switch for removing a query's shuffle files as soon as the query is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_recorders: list[list[DataFrame]] = []


@contextlib.contextmanager
def recorded() -> Iterator[list[DataFrame]]:
    """The tables that are materialized inside, for a caller who knows when nothing reads them any more."""
    tables: list[DataFrame] = []
    _recorders.append(tables)
    try:
        yield tables
    finally:
        _recorders.remove(tables)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` once as Parquet in the shared folder and reads it back.

    Cuts the lineage like ``checkpoint()``, survives lost executors, and gives
    later joins real table sizes and column pruning. The shuffle files of the write
    go with it: nothing reads them again once the table stands.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vestigia/{label}-{uuid.uuid4().hex}"
    before = {key: spark.conf.get(key, None) for key in (CLEANUP, *MEMORY_CONF)}
    spark.conf.set(CLEANUP, "true")
    apply_memory(spark)
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    out = spark.read.schema(df.schema).parquet(path)
    out._vestigia_path = path
    for tables in _recorders:
        tables.append(out)
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes materialized tables that nothing will read again."""
    for table in tables:
        path = getattr(table, "_vestigia_path", None)
        if path is not None:
            jvm = table.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
