"""Scratch folders belong to the block and the thread that their operator was called in."""

from __future__ import annotations

import threading

from docloom.llm import runtime


def exists(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def test_a_block_clears_its_own_folders_only(spark):
    outer = runtime.Scratch(spark, "outer")
    outer.table(spark.range(3))
    inside, go = {}, threading.Event()

    def other() -> None:
        with runtime.cleared():
            inside["other"] = runtime.Scratch(spark, "other")
            inside["other"].table(spark.range(3))
            go.wait(60)
            inside["seen"] = exists(spark, inside["other"].path)

    t = threading.Thread(target=other)
    t.start()
    with runtime.cleared():
        mine = runtime.Scratch(spark, "mine")
        mine.table(spark.range(3))
        with runtime.cleared():
            deep = runtime.Scratch(spark, "deep")
            deep.table(spark.range(3))
        assert exists(spark, mine.path) and not exists(spark, deep.path)
    assert exists(spark, outer.path) and not exists(spark, mine.path)
    go.set()
    t.join()
    assert inside["seen"] and not exists(spark, inside["other"].path)
    assert exists(spark, outer.path)


def test_spread_left_join_keeps_all_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(runtime, "HOT", 2)
    left = spark.range(4000).select((F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 50)).alias("k"))
    scratch = runtime.Scratch(spark, "t")
    keys = scratch.table(left.where("k != 7").groupBy("k").agg(F.count("*").alias("n")))
    got = runtime.spread_join(left, keys, ["k"], "n", 4000, "left").collect()
    assert len(got) == 4000 and all((r.n is None) == (r.k == 7) for r in got)
