"""Orders and missing parts that a comparison of sorted rows can't tell."""

from pyspark.sql import functions as F

from vestigia.operators import control


def test_runs_latest_first_unstarted_last(spark):
    rows = spark.createDataFrame([("a", 1), ("b", None), ("c", 3)], "run_id string, started_at int").withColumn("status", F.lit("x")).withColumn("playbook_id", F.lit("p"))
    assert [r.run_id for r in control.runs(rows, "x").collect()] == ["c", "a", "b"]
    assert control.runs(rows, "y").collect() == []


def test_order_is_null_for_unknown_steps_and_empty_for_none(spark):
    rows = spark.createDataFrame([(1, [("a", ["zz"])]), (2, []), (3, [("a", ["b"]), ("b", None)])], "k int, steps array<struct<step_id:string,depends_on:array<string>>>")
    found = dict(rows.select("k", control.execution_order(F.col("steps"))).collect())
    assert found == {1: None, 2: [], 3: ["b", "a"]}


def test_full_last_page_has_no_next(spark):
    for limit, told in ((9, (True, 9)), (10, (False, None)), (11, (False, None))):
        rows, more = control.next_page(spark.range(10), ["id"], limit)
        assert rows.count() == min(limit, 10) and tuple(more.first()) == told


def test_paths_without_a_field_are_null(spark):
    rows = spark.range(1).select(F.struct(F.lit("k").alias("key_path")).alias("data"))
    assert [tuple(r) for r in control.shown(rows).collect()] == [("k", None, None, None)]
    assert control.shown_columns(spark.range(1).schema) == ["id"]
