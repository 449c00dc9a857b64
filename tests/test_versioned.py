"""Versioned tables: atomic changes, conflicts, revisions and the stream sink."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docloom.sources.versioned import Conflict, VersionedTable

ROW = "id long, v string, at int"


def rows_of(table, version=None):
    return sorted(tuple(r) for r in table.read(version).collect())


def test_upsert_append_and_old_versions(spark, tmp_path):
    t = VersionedTable.create(spark, f"file://{tmp_path}/t", ROW, ["id"], parts=4)
    assert rows_of(t) == []
    assert t.append(spark.createDataFrame([(i, "a", 1) for i in range(10)], ROW)) == 1
    assert t.upsert(spark.createDataFrame([(3, "b", 2), (4, "old", 0), (50, "new", 1), (3, "c", 3)], ROW), "at") == 2
    want = {i: ("a", 1) for i in range(10)} | {3: ("c", 3), 50: ("new", 1)}
    assert rows_of(t) == sorted((i, *x) for i, x in want.items())
    assert rows_of(t, 1) == [(i, "a", 1) for i in range(10)]
    again = VersionedTable(spark, t.path)
    assert (again.keys, again.parts, again.version()) == (["id"], 4, 2)
    assert [h["op"] for h in again.history()] == ["create", "append", "upsert"]
    with pytest.raises(Conflict):
        VersionedTable.create(spark, t.path, ROW)
    assert t.upsert(spark.createDataFrame([], ROW), "at") == 3
    assert len(rows_of(t)) == 11
    t.vacuum()
    assert len(rows_of(t)) == 11


def test_a_change_rewrites_only_its_parts(spark, tmp_path):
    t = VersionedTable.create(spark, f"file://{tmp_path}/t", ROW, ["id"], parts=8)
    t.append(spark.createDataFrame([(i, "a", 1) for i in range(100)], ROW))
    before = t._manifest(1)["files"][0]
    t.upsert(spark.createDataFrame([(7, "b", 2)], ROW), "at")
    old, new = t._manifest(2)["files"]
    assert old["folder"] == before["folder"] and len(old["parts"]) == 7 and len(new["parts"]) == 1
    assert t.read(only=new["parts"]).count() < 100


def test_two_writers_of_one_part(spark, tmp_path):
    t = VersionedTable.create(spark, f"file://{tmp_path}/t", ROW, ["id"], parts=4)
    t.append(spark.createDataFrame([(i, "a", 1) for i in range(20)], ROW))
    base = t.version()
    part = {i: p for i, p in t.read().select("id", t._part()).collect()}
    same = next(i for i in range(1, 20) if part[i] == part[0])
    other = next(i for i in range(1, 20) if part[i] != part[0])
    t.upsert(spark.createDataFrame([(0, "first", 2)], ROW), "at", base=base)
    with pytest.raises(Conflict):
        t.upsert(spark.createDataFrame([(same, "second", 2)], ROW), "at", base=base)
    t.upsert(spark.createDataFrame([(other, "third", 2)], ROW), "at", base=base)  # another part: put behind
    got = dict(r[:2] for r in rows_of(t))
    assert (got[0], got[same], got[other]) == ("first", "a", "third")
    # an append to a part that is being rewritten is not lost
    base = t.version()
    t.append(spark.createDataFrame([(0, "added", 9)], ROW))
    with pytest.raises(Conflict):
        t.upsert(spark.createDataFrame([(0, "late", 3)], ROW), "at", base=base)


def test_a_number_is_taken_once(spark, tmp_path):
    t = VersionedTable.create(spark, f"file://{tmp_path}/t", ROW)
    m = {"op": "x", "files": [], "changed": [], "txn": {}}
    assert t._claim(1, m) and not t._claim(1, m)
    assert t.version() == 1


def test_a_writer_that_dies_leaves_the_version_before(spark, tmp_path):
    t = VersionedTable.create(spark, f"file://{tmp_path}/t", ROW, ["id"], parts=2)
    t.append(spark.createDataFrame([(i, "a", 1) for i in range(5)], ROW))
    bad = spark.createDataFrame([(1, "b", 2)], ROW).withColumn("v", F.raise_error(F.lit("killed")).cast("string"))
    with pytest.raises(Exception, match="killed"):
        t.upsert(bad, "at")
    with pytest.raises(Exception, match="killed"):
        t.rewrite(spark.createDataFrame([(1, "b", 2)], ROW), lambda old, new: old.withColumn("v", F.raise_error(F.lit("killed")).cast("string")))
    assert t.version() == 1 and rows_of(t) == [(i, "a", 1) for i in range(5)]


def test_revisions(spark, tmp_path):
    t = VersionedTable.create(spark, f"file://{tmp_path}/t", "key string, body string, revision long", ["key"], parts=2)
    edit = "key string, body string, at int, expected long"
    got = {tuple(r) for r in t.revise(spark.createDataFrame([("a", "one", 1, None), ("b", "one", 1, 4)], edit)).collect()}
    assert got == {("a", 1, "created", 1), ("b", 1, "conflict", 0)}
    base = t.version()
    first = t.revise(spark.createDataFrame([("a", "two", 1, 1), ("a", "three", 2, 1)], edit), base=base)
    assert {tuple(r) for r in first.collect()} == {("a", 1, "written", 2), ("a", 2, "conflict", 1)}
    with pytest.raises(Conflict):  # two writers of one revision: the second is refused
        t.revise(spark.createDataFrame([("a", "four", 1, 1)], edit), base=base)
    assert {r.outcome for r in t.revise(spark.createDataFrame([("a", "five", 1, 1)], edit)).collect()} == {"conflict"}
    assert rows_of(t) == [("a", "two", 2)]


def test_replaced_chunks(spark, tmp_path):
    schema = "document_id long, chunk_index long, content string, sanitization_state string"
    t = VersionedTable.create(spark, f"file://{tmp_path}/t", schema, ["document_id"], parts=4)
    t.append(spark.createDataFrame([(d, c, "raw", s) for d in range(4) for c, s in enumerate(["pending", "sanitized", "blocked"])], schema))
    t.replace_chunks(spark.createDataFrame([(2, 0, "redacted", "sanitized")], schema))
    assert [r for r in rows_of(t) if r[0] == 2] == [(2, 0, "redacted", "sanitized"), (2, 2, "raw", "blocked")]
    assert len(rows_of(t)) == 11


def test_stream_batches_are_written_once(spark, tmp_path):
    src = f"{tmp_path}/in"
    t = VersionedTable.create(spark, f"file://{tmp_path}/t", ROW, ["id"], parts=2)
    log = VersionedTable.create(spark, f"file://{tmp_path}/log", ROW)
    upsert, append = t.batch_sink("s", lambda rows, txn: t.upsert(rows, "at", txn)), log.batch_sink("s", lambda rows, txn: log.append(rows, txn))
    for i in range(2):
        spark.createDataFrame([(j, f"v{i}", i) for j in range(3)], ROW).write.mode("append").parquet(src)
        stream = spark.readStream.schema(ROW).parquet(src).writeStream.option("checkpointLocation", f"{tmp_path}/c").foreachBatch(lambda df, n: (upsert(df, n), append(df, n))).trigger(availableNow=True).start()
        stream.awaitTermination()
    for again in (0, 1):  # a batch that is tried again
        rows = spark.createDataFrame([(9, "twice", 9)], ROW)
        upsert(rows, again), append(rows, again)
        assert t.upsert(rows, "at", ("s", again)) is None and log.append(rows, ("s", again)) is None
    assert rows_of(t) == [(j, "v1", 1) for j in range(3)]
    assert len(rows_of(log)) == 6
