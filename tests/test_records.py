"""Cursors that the small test tables are too short or too full to tell apart."""

import duckdb
import pytest

from vestigia import catalogue
from vestigia.operators import records
from vestigia.plans.session import apply_semantics

BIG = 2**63 - 1
IDS = (0, 7, 9999, 10_000, 99_999, 6_000_000, BIG, -BIG)


@pytest.fixture
def events(tmp_path):
    """Cursors of 49 bytes and more, on both sides of 57, after which Spark breaks the line of base64."""
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT)")
    at = "2024-01-01 00:00:11.172425"
    rows = [(i, at, u) for i in IDS for u in (0, 149, 1499, BIG)]
    con.executemany("INSERT INTO events VALUES (?, ?, ?)", [*rows, (None, at, 1), (1, None, 1), (2, at, None), (3, "1960-01-01", 5), (None, None, None)])
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    return con


def test_cursor_token_of_any_length_and_nulls_equals_sql(spark, events, tmp_path):
    found = catalogue.QUERIES["cursor_token"](apply_semantics(spark), str(tmp_path)).select("event_id", "token").collect()
    want = events.execute(f"SELECT event_id, token FROM ({catalogue.ORACLES['cursor_token']})").fetchall()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))


def test_cursor_equals_the_plain_one(spark):
    texts = ["", "ÿ?>~" * 3, "x" * 500]
    made = spark.createDataFrame([(i, t) for i in IDS for t in texts], "o bigint, r string")
    for o, r, token in made.select("o", "r", records.cursor(made.o, made.r, made.r, made.o)).collect():
        assert records.decode_cursor(token) == {"o": o, "t": r, "r": r, "n": o}
        assert not r.isascii() or token == records.encode_cursor(o, r, r, o)
