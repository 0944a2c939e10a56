"""Registered queries over embedded databases and settings files."""

from __future__ import annotations

import sqlite3

import pyarrow as pa
from pyspark.sql import functions as F

from .catalogue import query, table
from .sources import databases, texts


def _database(events: pa.Table) -> pa.Table:
    """A database of two tables that holds the given events."""
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE e (id INTEGER, kind TEXT, odd)")
    con.executemany("INSERT INTO e VALUES (?, ?, ?)", [(i, k, i if i % 2 else "x") for i, k in zip(events["event_id"].to_pylist(), events["event_type"].to_pylist(), strict=True)])
    con.commit()
    path = str(events["part"][0].as_py())
    return pa.table({"path": [path], "content": pa.array([con.serialize()], pa.binary())})


@query("SELECT event_id AS id, event_type AS kind, CASE WHEN event_id % 2 = 1 THEN event_id END AS odd, NULL::BIGINT AS lacking FROM events")
def scan_sqlite(spark, sf_dir):
    """Databases of 500 rows each, with values of two types in a column and without one that is asked for."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.floor(F.col("event_id") / 500).alias("part"))
    files = events.groupBy("part").applyInArrow(_database, "path string, content binary")
    return databases.sqlite_table(files, "e", "id long, kind string, odd long, lacking long").drop("path")


@query("SELECT c_name AS url, c_custkey AS visit_count, o_orderkey * 1000000 AS us FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def visits_of_urls(spark, sf_dir):
    urls = table(spark, sf_dir, "customer").select(F.lit("h").alias("path"), F.col("c_custkey").alias("id"), F.col("c_name").alias("url"), F.lit("t").alias("title"), F.col("c_custkey").alias("visit_count"), F.lit(0).cast("long").alias("last_visit_time"))
    of = table(spark, sf_dir, "orders").select(F.lit("h").alias("path"), F.col("o_custkey").alias("url"), (F.col("o_orderkey") * 1000000 + 11644473600000000).alias("visit_time"), F.lit(1).alias("transition"))
    return databases.visits(urls, of).select("url", "visit_count", F.unix_micros("visit_time").alias("us"))


@query("""SELECT c_name AS url, nullif(o_orderkey, 0) * 1000000 AS us, CASE o_orderkey % 9 WHEN 1 THEN 'link' WHEN 2 THEN 'typed' WHEN 3 THEN 'bookmark' WHEN 4 THEN 'embed' WHEN 5 THEN 'redirect_permanent'
    WHEN 6 THEN 'redirect_temporary' WHEN 7 THEN 'download' WHEN 8 THEN 'framed_link' ELSE 'unknown' END AS transition FROM customer LEFT JOIN orders ON c_custkey = o_custkey""")
def visits_of_places(spark, sf_dir):
    urls = table(spark, sf_dir, "customer").select(F.lit("h").alias("path"), F.col("c_custkey").alias("id"), F.col("c_name").alias("url"), F.lit(None).cast("string").alias("title"), F.col("c_custkey").alias("visit_count"))
    of = table(spark, sf_dir, "orders").select(F.lit("h").alias("path"), F.col("o_custkey").alias("place_id"), (F.col("o_orderkey") * 1000000).alias("visit_date"), (F.col("o_orderkey") % 9).alias("visit_type"))
    return databases.places(urls, of).select("url", F.unix_micros("visit_time").alias("us"), "transition")


@query("SELECT c_name AS url, o_orderpriority AS content, o_orderkey AS date_added FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 3 = 0")
def downloads_of_places(spark, sf_dir):
    places = table(spark, sf_dir, "customer").select(F.lit("h").alias("path"), F.col("c_custkey").alias("id"), F.col("c_name").alias("url"))
    annos = table(spark, sf_dir, "orders").select(F.lit("h").alias("path"), F.col("o_custkey").alias("place_id"), (F.col("o_orderkey") % 3).alias("anno_attribute_id"), F.col("o_orderpriority").alias("content"), F.col("o_orderkey").alias("dateAdded"))
    attributes = spark.createDataFrame([("h", 0, databases.DESTINATION), ("h", 1, "other"), ("g", 2, databases.DESTINATION)], "path string, id long, name string")
    return databases.downloads(annos, places, attributes).select("url", "content", "date_added")


@query("SELECT count(*) AS total_entries, coalesce(sum(n_chars), 0)::BIGINT AS total_records, coalesce(sum(length(text)), 0)::BIGINT AS total_size, min(doc_id) AS oldest, max(doc_id) AS newest FROM documents")
def cache_statistics(spark, sf_dir):
    return databases.cache_totals(table(spark, sf_dir, "documents"), F.col("n_chars"), F.col("text"), F.col("doc_id"))


@query("""SELECT event_id, CASE WHEN event_id % 3 > 0 THEN 'h' || event_id END AS server, CASE event_id % 3 WHEN 1 THEN 3389 WHEN 2 THEN 3000 + event_id % 100 END AS port, CASE WHEN event_id % 3 > 0 THEN 'u' || event_id END AS username, CASE WHEN event_id % 3 > 0 THEN '' END AS domain, '16' AS bpp FROM events""")
def scan_desktop_settings(spark, sf_dir):
    i = F.col("event_id")
    n = i.cast("string")
    port = F.when(i % 3 == 2, F.concat(F.lit(":"), (3000 + i % 100).cast("string"))).otherwise(F.lit(""))
    server = F.when(i % 3 > 0, F.concat(F.lit("h"), n, port)).otherwise(F.lit(""))
    content = F.concat(F.lit("; x:s:y\r\nsession bpp:i:32\r\nFull Address:s:"), server, F.lit("\r\n username:s: u"), n, F.lit("\r\nsession bpp:i:16\r\n\r\n"))
    found = texts.desktop_settings(table(spark, sf_dir, "events").select(n.alias("path"), F.encode(content, "UTF-16LE").alias("content")))
    return found.select(F.col("path").cast("long").alias("event_id"), "server", "port", "username", "domain", F.col("settings")["session bpp"].alias("bpp"))
