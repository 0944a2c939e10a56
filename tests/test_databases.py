"""Files that are no whole databases, and settings without a server."""

import sqlite3

from vestigia.sources import databases, texts


def test_files_without_the_table_give_no_rows(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "a.db")
    con.execute("PRAGMA journal_mode=WAL")
    con.execute('CREATE TABLE "t ""x" (id INTEGER, name TEXT, data BLOB)')
    con.executemany('INSERT INTO "t ""x" VALUES (?, ?, ?)', [(1, "a", b"\0"), (None, None, None), (2**40, "é" * 5000, b"")])
    con.commit()
    con.execute("PRAGMA wal_checkpoint(TRUNCATE)")
    con.close()
    whole = (tmp_path / "a.db").read_bytes()
    rows = spark.createDataFrame([("a", whole), ("cut", whole[:4096]), ("none", None), ("empty", b""), ("text", b"abc" * 99)], "path string, content binary")
    found = databases.sqlite_table(rows, 't "x', "name string, id long, data binary, more double")
    assert {tuple(r) for r in found.where("path = 'a'").collect()} == {("a", "a", 1, b"\0", None), ("a", None, None, None, None), ("a", "é" * 5000, 2**40, b"", None)}
    assert {r.path for r in found.collect()} <= {"a", "cut"}
    assert databases.sqlite_table(rows, "other", "id long").count() == 0


def test_settings_without_server_and_with_a_bad_port(spark):
    rows = spark.createDataFrame([("a", b"username:s:me\n"), ("b", b"full address:s:h:x\nfull address:i:9\ndomain:s:d\na:i:b:s:c"), ("c", None), ("d", b"")], "path string, content binary")
    found = {r.path: r for r in texts.desktop_settings(rows).collect()}
    assert tuple(found["a"])[2:] == (None, None, None, None) and found["a"].settings == {"username": "me"}
    assert tuple(found["b"])[2:] == ("h", 3389, "", "d") and found["b"].settings["a:i:b"] == "c"
    assert found["c"].settings is None and found["d"].settings == {}
