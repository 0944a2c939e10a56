"""Each registered query against its SQL in another engine, value by value."""

from pathlib import Path

import duckdb
import pytest

from vestigia import catalogue, control_queries, database_queries, record_queries  # noqa: F401
from vestigia.plans.session import apply_semantics

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_equals_sql(spark, duck, name):
    found = catalogue.QUERIES[name](apply_semantics(spark), SF)
    names = sorted(found.columns)
    rows = sorted((tuple(map(str, r)) for r in found.select(names).collect()))
    want = duck.execute(catalogue.ORACLES[name])
    order = [[d[0] for d in want.description].index(n) for n in names]
    assert len(want.description) == len(names)
    assert rows == sorted(tuple(str(r[i]) for i in order) for r in want.fetchall()) and rows


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_empty_tables(spark, name, tmp_path):
    for path in Path(SF).glob("*.parquet"):
        spark.read.parquet(str(path)).limit(0).write.parquet(f"{tmp_path}/{path.name}")
    catalogue.QUERIES[name](spark, str(tmp_path)).collect()
