"""Registered queries over playbooks, plugins, totals and shown columns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalogue import query, table
from .operators import control

RUNS = """SELECT o_orderkey AS run_id, o_orderpriority AS playbook_id, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' ELSE 'running' END AS status,
    CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate END AS started_at FROM orders"""


def _runs(spark, sf_dir) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "failed").otherwise("running")
    started = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate").cast("timestamp"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("playbook_id"), status.alias("status"), started.alias("started_at"))


@query(f"SELECT run_id, playbook_id, status, epoch_us(started_at) AS us FROM ({RUNS}) WHERE status = 'success' AND playbook_id = '5-LOW'")
def playbook_runs(spark, sf_dir):
    return control.runs(_runs(spark, sf_dir), "success", "5-LOW").select("run_id", "playbook_id", "status", F.unix_micros("started_at").alias("us"))


@query(f"SELECT run_id, epoch_us(started_at) AS us FROM ({RUNS}) WHERE started_at >= TIMESTAMP '1996-01-01'")
def history_since(spark, sf_dir):
    return control.started_since(_runs(spark, sf_dir), datetime(1996, 1, 1)).select("run_id", F.unix_micros("started_at").alias("us"))


@query(f"SELECT playbook_id, count_if(status = 'success') AS succeeded, count_if(status = 'failed') AS failed, count_if(status = 'running') AS skipped, sum(run_id % 100)::BIGINT AS records_processed FROM ({RUNS}) GROUP BY 1")
def playbook_step_totals(spark, sf_dir):
    return control.step_totals(_runs(spark, sf_dir).withColumn("records_processed", F.col("run_id") % 100), "playbook_id")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 's1,s2,s3,s4,s5' WHEN event_id % 3 = 1 THEN 's5,s4,s3,s2,s1' WHEN event_id % 2 = 0 THEN 's2,s1,s5,s3,s4' END AS step_order FROM events""")
def playbook_order(spark, sf_dir):
    """Playbooks of five steps: without dependencies, each step after its follower, some after others, and in a circle."""
    waits = {
        "free": [[], [], [], [], []],
        "chain": [["s2"], ["s3"], ["s4"], ["s5"], []],
        "mixed": [["s2"], [], ["s5"], ["s3", "s1"], ["s1"]],
        "circle": [["s2"], ["s1"], [], [], ["s3"]],
    }
    steps = {k: F.array(*(F.struct(F.lit(f"s{i}").alias("step_id"), F.array(*map(F.lit, d)).cast("array<string>").alias("depends_on")) for i, d in enumerate(w, 1))) for k, w in waits.items()}
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.when(i % 3 == 0, steps["free"]).when(i % 3 == 1, steps["chain"]).when(i % 2 == 0, steps["mixed"]).otherwise(steps["circle"]).alias("steps"))
    return rows.select("event_id", F.array_join(control.execution_order(F.col("steps")), ",").alias("step_order"))


@query("""SELECT event_id, 'artifact' AS found_by FROM events WHERE event_id % 3 <> 0 AND event_type = 'click' UNION ALL
    SELECT event_id, 'extension' FROM events WHERE event_id % 3 <> 0 AND event_id % 4 = 1""")
def plugin_search(spark, sf_dir):
    i = F.col("event_id")
    listed = lambda *x: F.array(*x).cast("array<string>")
    capabilities = F.array(
        F.struct(F.col("event_type").alias("artifact_type"), listed().alias("file_extensions")),
        F.struct(F.lit("mft").alias("artifact_type"), listed(F.lit(".bin"), F.concat(F.lit(".Ext"), (i % 4).cast("string"))).alias("file_extensions")),
    )
    plugins = table(spark, sf_dir, "events").select("event_id", (i % 3 != 0).alias("enabled"), capabilities.alias("capabilities"))
    by_artifact = control.plugins_for_artifact(plugins, "click").select("event_id", F.lit("artifact").alias("found_by"))
    return by_artifact.unionByName(control.plugins_for_extension(plugins, ".eXT1").select("event_id", F.lit("extension").alias("found_by")))


@query("SELECT count(*) AS processed, count_if(event_type = 'click') AS output, count(*) - count_if(event_type = 'click') AS skipped FROM events")
def metrics_of_filter(spark, sf_dir):
    return control.passed(table(spark, sf_dir, "events"), F.col("event_type") == "click")


@query("""WITH n AS (SELECT DISTINCT user_id % 7 AS k, name FROM (SELECT user_id, event_type AS name FROM events UNION ALL SELECT user_id, 'app' || event_id % 60 FROM events))
    SELECT k, count(*) AS n_names, array_to_string(list_slice(list_sort(list(name)), 1, 20), ',') AS names FROM n GROUP BY 1""")
def distinct_apps(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("k"), "event_id", "event_type")
    names = (F.col("event_type"), F.concat(F.lit("app"), (F.col("event_id") % 60).cast("string")))
    found = control.distinct_names((rows.select("k", name.alias("name")) for name in names), "k")
    return found.select("k", "n_names", F.array_join("names", ",").alias("names"))


@query("SELECT 40 AS page_offset, count(*) > 90 AS has_more, CASE WHEN count(*) > 90 THEN 90 END::BIGINT AS next_offset FROM events")
def next_cursor(spark, sf_dir):
    _, more = control.next_page(table(spark, sf_dir, "events"), ["ts", "event_id"], 50, 40)
    return more.select(F.lit(40).alias("page_offset"), "has_more", "next_offset")


def _records(spark, sf_dir) -> DataFrame:
    data = F.struct("event_id", F.col("event_type").alias("channel"), F.col("user_id").alias("record_number"))
    return table(spark, sf_dir, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("timestamp"), data.alias("data"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("note"))


@query('SELECT epoch_us(ts) AS "timestamp", event_id AS data_event_id, event_type AS data_channel, user_id AS data_record_number FROM events')
def shown_columns(spark, sf_dir):
    found = control.shown(_records(spark, sf_dir))
    return found.toDF(*(c.replace(".", "_") for c in found.columns))


@query("""SELECT event_id, '{"event_id":' || event_id || CASE WHEN event_id % 2 = 0 THEN ',"note":"' || event_type || '"' ELSE '' END || '}' AS told FROM events""")
def envelope_without_nulls(spark, sf_dir):
    rows = _records(spark, sf_dir).select(F.col("data.event_id").alias("event_id"), "note")
    return rows.select("event_id", control.without_nulls(F.struct("event_id", "note")).alias("told"))
