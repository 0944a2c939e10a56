"""Tables of embedded SQLite files, and the queries over them."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import times

ROWS = 8192
#: Names of visit types; fixed values.
VISIT_TYPES = {1: "link", 2: "typed", 3: "bookmark", 4: "embed", 5: "redirect_permanent", 6: "redirect_temporary", 7: "download", 8: "framed_link"}
DESTINATION = "downloads/destinationFileURI"
_KINDS = {"bigint": (int, pa.int64()), "double": ((int, float), pa.float64()), "string": (str, pa.string()), "binary": (bytes, pa.binary())}


def _records(content: bytes, name: str, columns: list[str]) -> Iterator[list[tuple]]:
    """Rows of a table in lists of bounded length; columns that it lacks are null."""
    if content[:16] != b"SQLite format 3\0":
        return
    con = sqlite3.connect(":memory:")
    try:
        # Read as a file without a write-ahead log, which is another file and not at hand.
        con.deserialize(content[:18] + b"\1\1" + content[20:])
        con.text_factory = lambda b: b.decode("utf-8", "replace")
        quoted = name.replace('"', '""')
        there = {r[1].lower() for r in con.execute(f'PRAGMA table_info("{quoted}")')}
        if not there:
            return
        wanted = ", ".join('"{}"'.format(c.replace('"', '""')) if c.lower() in there else "NULL" for c in columns)
        rows = con.execute(f'SELECT {wanted} FROM "{quoted}"')
        while found := rows.fetchmany(ROWS):
            yield found
    except sqlite3.DatabaseError:
        return
    finally:
        con.close()


def sqlite_table(rows: DataFrame, name: str, schema: str) -> DataFrame:
    """(path, the columns of ``schema``) for each row of a table in the files (path, content).

    A file without the table, or that is no database, has none; what is read before a
    damaged page stays. Values of another type than the column's are null.
    """
    fields = StructType.fromDDL(schema).fields
    names = [f.name for f in fields]
    kinds = [_KINDS[f.dataType.simpleString()] for f in fields]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                for found in _records(content.as_py() or b"", name, names):
                    columns = [pa.array([v if isinstance(v, kind) else None for v in x], to) for x, (kind, to) in zip(zip(*found, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * len(found), pa.string()), *columns], ["path", *names])

    return rows.select("path", "content").mapInArrow(work, f"path string, {schema}")


def _whole(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def visits(urls: DataFrame, visits: DataFrame) -> DataFrame:
    """Visits of urls (path, id, ...), with the urls that have none; the latest first, those without a visit last."""
    v = visits.select("path", F.col("url").alias("id"), "visit_time", "transition")
    found = urls.join(v, ["path", "id"], "left").orderBy(F.desc_nulls_last("visit_time"))
    return found.select(
        "path", "url", "title", _whole(F.col("visit_count")).alias("visit_count"), times.from_webkit(F.col("visit_time")).alias("visit_time"), times.from_webkit(F.col("last_visit_time")).alias("last_visit"), "transition"
    )


def places(places: DataFrame, visits: DataFrame) -> DataFrame:
    """Visits of places, with the places that have none; types without a name are unknown."""
    names = F.create_map(*(F.lit(x) for pair in VISIT_TYPES.items() for x in pair))
    v = visits.select("path", F.col("place_id").alias("id"), "visit_date", F.col("visit_type").cast("int").alias("visit_type"))
    found = places.join(v, ["path", "id"], "left").orderBy(F.desc_nulls_last("visit_date"))
    kind = F.coalesce(F.try_element_at(names, F.col("visit_type")), F.lit("unknown"))
    return found.select("path", "url", F.coalesce("title", F.lit("")).alias("title"), _whole(F.col("visit_count")).alias("visit_count"), times.from_mozilla(F.col("visit_date")).alias("visit_time"), kind.alias("transition"))


def downloads(annos: DataFrame, places: DataFrame, attributes: DataFrame) -> DataFrame:
    """(path, url, content, date_added) of annotations that name a download's destination, the latest first."""
    wanted = attributes.where(F.col("name") == DESTINATION).select("path", F.col("id").alias("anno_attribute_id"))
    found = annos.join(wanted, ["path", "anno_attribute_id"], "left_semi").join(places.select("path", F.col("id").alias("place_id"), "url"), ["path", "place_id"])
    return found.orderBy(F.desc_nulls_last("dateAdded")).select("path", "url", "content", F.col("dateAdded").alias("date_added"))


def cache_totals(entries: DataFrame, records: Column, data: Column, created: Column) -> DataFrame:
    """One row: entries, records, size of the data, oldest and newest."""
    return entries.agg(
        F.count("*").alias("total_entries"), _whole(F.sum(records)).alias("total_records"), _whole(F.sum(F.length(data))).alias("total_size"), F.min(created).alias("oldest"), F.max(created).alias("newest")
    )
