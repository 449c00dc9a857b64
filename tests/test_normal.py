"""Text without separators and windows put together agree with the whole text; recent threads agree with a model."""

from __future__ import annotations

import random
import re
from collections import OrderedDict

from pyspark.sql import functions as F

from docloom.functions import spans as S
from docloom.functions.entities import NARROW, RULES, SEPARATORS, WIDE
from docloom.functions.normal import hits_within, stripped
from docloom.operators import drafts
from docloom.operators.detect import detect
from docloom.streaming import loops

PLAIN = {"CN_ID": "[0-9]{17}[0-9Xx]", "USCC": "[0-9A-HJ-NPQRTUWXY]{18}", "CN_MOBILE": "(?:86)?1[3-9][0-9]{9}", "BANK_CARD": "[0-9]{12,19}"}


def test_positions_are_mapped_back(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice(SEPARATORS + WIDE + NARROW + "文 \n") for _ in range(rng.randint(0, 60)))) for i in range(100)] + [(900, ""), (901, None), (902, "－－")]
    got = spark.createDataFrame(rows, "i int, text string").select("i", "text", stripped(F.col("text")).alias("n")).collect()
    for r in got:
        if r.text is None:
            assert r.n is None
            continue
        kept = [(c, j) for j, c in enumerate(r.text) if c not in SEPARATORS]
        assert r.n["at"] == [j for _, j in kept]
        assert r.n["text"] == "".join(c for c, _ in kept).translate(str.maketrans(WIDE, NARROW))


def test_every_spaced_rule_has_the_hits_of_the_map(spark):
    rng = random.Random(2)
    digits = "0123456789" + WIDE[:10] + "86135"
    rows = []
    for i in range(400):
        parts = [rng.choice(["文", "x", "X", "Ｘ", "110105194912310", "86 138", "4111-1111", "91350100M"]) if rng.random() < 0.15 else rng.choice(digits) + rng.choice(["", "", "", " ", "-", "－", "·", "\t"]) for _ in range(rng.randint(5, 60))]
        rows.append((i, "".join(parts)))
    df = spark.createDataFrame(rows, "i int, text string").withColumn("n", stripped(F.col("text")))
    for code, pattern in PLAIN.items():
        (rule,) = [r for r in RULES if r.code == code and r.mode == "spaced"]
        got = df.select(S.hits(F.col("text"), rule.pattern).alias("a"), hits_within(F.col("n"), F.col("text"), pattern).alias("b")).collect()
        assert any(r.a for r in got)
        for r in got:
            assert [(x.start, x.end) for x in r.a] == [(x.start, x.end) for x in r.b], code


def test_overlapping_spans_are_united(spark):
    rows = [(1, "A", 0, 5), (1, "A", 3, 9), (1, "A", 9, 12), (1, "B", 4, 8), (1, "A", 20, 30), (1, "A", 21, 22), (1, "A", 25, 33), (2, "A", 1, 2), (2, "A", 1, 2)]
    got = drafts.united(spark.createDataFrame(rows, "doc int, entity string, start int, end int"), ["doc", "entity"]).collect()
    assert {tuple(r) for r in got} == {(1, "A", 0, 9), (1, "A", 9, 12), (1, "B", 4, 8), (1, "A", 20, 33), (2, "A", 1, 2)}


def test_windows_find_what_the_whole_text_has(spark):
    rng = random.Random(3)
    rows = []
    for i in range(30):
        words = [rng.choice(["word", "x", "user.name@mail.example.org", "a@b.cd", "192.168.1.17", "8.8.8.8.8"]) for _ in range(rng.randint(0, 200))]
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows + [(99, None)], "doc_id int, text string")
    find = lambda d, c: detect(d, c, codes=["EMAIL", "IP"], most=None)
    whole = find(df, "text").select("doc_id", F.explode_outer("matches").alias("m")).where("m is not null").select("doc_id", "m.entity", "m.start", "m.end")
    assert {tuple(r) for r in drafts.by_windows(df, "doc_id", "text", 200, 80, find).collect()} == {tuple(r) for r in whole.collect()} != set()


def test_recent_threads_agree_with_an_ordered_dict(spark, tmp_path):
    rng = random.Random(4)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    calls = [(f"t{min(int(rng.expovariate(0.25)), 15)}", i, rng.choice(["read", "write"]), rng.choice("ab")) for i in range(400)]
    source, out = f"{tmp_path}/in", []
    for b in range(4):
        spark.createDataFrame(calls[100 * b : 100 * b + 100], "thread_id string, seq long, tool string, hash string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("thread_id string, seq long, tool string, hash string").parquet(source)
        query = loops.detect_recent(stream, most=5).writeStream.option("checkpointLocation", f"{tmp_path}/ck").foreachBatch(lambda df, n: out.extend(df.collect())).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    model: OrderedDict[str, tuple] = OrderedDict()
    want, forgotten = [], 0
    for thread, seq, tool, hash_ in calls:
        state, same, used, action = loops.judged(model.pop(thread, ([], [], [], [])), hash_, tool)
        model[thread] = state
        if len(model) > 5:
            model.popitem(last=False)
            forgotten += 1
        want.append((thread, seq, same, used, action))
    assert forgotten > 20 and re.match("t", want[0][0])
    assert sorted(tuple(r) for r in out) == sorted(want, key=lambda r: (r[0], r[1]))
