"""Sinks, vaults, notes and ordering on small fixtures."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from docloom.operators import records
from docloom.streaming import loops


def test_rows_are_appended(spark, tmp_path):
    path = f"file://{tmp_path}/spans"
    for n in (2, 3):
        records.append(spark.range(n), path)
    assert spark.read.parquet(path).count() == 5


def test_vaults_of_other_versions_or_entities_are_refused(spark):
    good = '{"version":1,"entries":{"[IP_A]":{"entity":"IP","original":"1.2.3.4"}}}'
    raw = [good, good.replace("1,", "2,", 1), good.replace('"IP"', '"SHOE"'), "no json", None, good.replace('"original"', '"other"')]
    rows = spark.createDataFrame(list(enumerate(raw)), "i int, raw string").select("i", records.opened_vault(F.col("raw")).alias("v")).collect()
    assert [r.i for r in rows if r.v is not None] == [0]
    assert rows[0].v["[IP_A]"].original == "1.2.3.4"


def test_memory_notes(spark):
    rows = spark.createDataFrame([(0, "plain"), (1, "write to a@b.org and c@d.org"), (2, "a@b.org " * 9000), (3, None)], "i int, t string")
    got = {r.i: (r.verdict, r.found, r.first) for r in records.guard_memory(rows, "t").collect()}
    assert got == {0: ("accept", 0, None), 1: ("identifiers", 2, "EMAIL"), 2: ("too_large", 0, None), 3: ("accept", 0, None)}


def test_call_hashes_are_those_of_sorted_json(spark):
    calls = [("read_file", {"path": "a.txt", "start_line": "420", "end_line": "150"}), ("read_file", {"path": "b", "start_line": "x"}), ("write_file", {"path": "p", "body": 'q"\n'}), ("grep", {"pattern": "x", "noise": "1"}), ("other", {"z": "1", "a": "2"}), ("none", {})]
    keys = ["a.txt:0-2", "b:0-0", json.dumps(calls[2][1], sort_keys=True), '{"pattern": "x"}', '{"a": "2", "z": "1"}', "{}"]
    want = hashlib.md5(json.dumps(sorted(f"{n}:{k}" for (n, _), k in zip(calls, keys, strict=True))).encode()).hexdigest()[:12]
    df = spark.createDataFrame([(calls,), (calls[::-1],)], "calls array<struct<name:string,args:map<string,string>>>")
    assert [r.h for r in df.select(loops.stable_hash(F.col("calls")).alias("h")).collect()] == [want, want]


def test_truncation_notes_and_tags(spark):
    rows = spark.createDataFrame([(True, 10, 3), (False, 10, 0), (None, 1, 1)], "t boolean, r int, d int").select(records.truncation(F.col("t"), F.col("r"), F.col("d")).alias("n")).collect()
    assert [r.n and (r.n.partial, r.n.tokens_dropped) for r in rows] == [(True, 3), None, None]
    forced = records.tagged(spark.createDataFrame([("x", "T1")], "jurisdiction string, data_level string"), extracted=True).first()
    assert (forced.jurisdiction, forced.source_level, forced.data_level, forced.sanitization_state) == ("china_mainland", "auxiliary_db", "T3", "pending")
