"""Raking, sampling, packing and the pipeline."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import mixing, packing
from docloom.llm.runtime import Scratch, components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_raked_weights_hold_all_marginals(spark):
    rng = random.Random(3)
    cells = [(f"s{a}", f"l{b}", f"t{c}", rng.randint(1, 10_000)) for a in range(5) for b in range(3) for c in range(4)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    targets = {}
    for by, n in (("source", 5), ("lang", 3), ("topic", 4)):
        raw = [rng.random() + 0.1 for _ in range(n)]
        targets[by] = {f"{by[0]}{i}": x / sum(raw) for i, x in enumerate(raw)}
    frames = {by: spark.createDataFrame(list(t.items()), f"{by} string, target double") for by, t in targets.items()}
    got = mixing.rake(df, frames, Scratch(spark, "test")).collect()
    weight = np.zeros((5, 3, 4))
    for r in got:
        weight[int(r.source[1]), int(r.lang[1]), int(r.topic[1])] = r.weight
    for axis, by in enumerate(targets):
        rest = tuple(k for k in range(3) if k != axis)
        assert weight.sum(rest) == pytest.approx([targets[by][f"{by[0]}{i}"] for i in range(weight.shape[axis])], abs=1e-5)
    # raking keeps the cross ratios of the seed table
    seed = np.array([c[3] for c in cells], float).reshape(5, 3, 4)
    ratio = np.log(weight / seed)
    inner = ratio - ratio[:1] - ratio[:, :1] + ratio[:1, :1]
    assert np.abs(inner - inner[:, :, :1]).max() < 1e-6


def test_marginals_of_the_sample_approach_their_targets(spark):
    rows = [(i, "w " * (1 + i % 30), ["en", "de", None][i % 3], f"src{min(i % 12, 3)}", i) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic long")
    goal = {"lang": spark.createDataFrame([("=en", 0.2), ("=de", 0.3), ("null", 0.5)], "lang string, target double")}
    got = mixing.mix(docs, share=0.3, targets=goal)
    assert got.columns == ["doc_id", "text", "lang", "source", "topic", "n_tokens", "weight", "probability", "sampled"]
    rows_ = got.collect()
    assert len(rows_) == len(rows)
    total = sum(r.n_tokens for r in rows_)
    assert total == sum(1 + i % 30 for i in range(6000))
    taken = [r for r in rows_ if r.sampled]
    assert sum(r.n_tokens for r in taken) == pytest.approx(0.3 * total, rel=0.08)
    by = defaultdict(int)
    for r in taken:
        by[r.lang] += r.n_tokens
    size = sum(by.values())
    assert [by[k] / size for k in ("en", "de", None)] == pytest.approx([0.2, 0.3, 0.5], abs=0.04)
    again = mixing.mix(docs, share=0.3, targets=goal).where("sampled").select("doc_id").collect()
    assert {r.doc_id for r in again} == {r.doc_id for r in taken}


def test_mixing_of_odd_rows(spark):
    kinds = "doc_id long, text string, lang string, source string, weight string"
    rows = [(None, None, None, None, "w"), (1, "", "en", "a", "w"), (2, " \t\n\r\x0b\x0c", "en", "a", "w"), (3, "one two", "en", "b", "w"), (3, "one two", "en", "b", "w"), (4, "a\u00a0b c", "de", "b", "w")]
    got = sorted(mixing.mix(spark.createDataFrame(rows, kinds), share=1.0).collect(), key=lambda r: r.doc_id or 0)
    assert [r.n_tokens for r in got] == [0, 0, 0, 2, 2, 2]
    assert [r.probability > 0 for r in got] == [False, False, False, True, True, True]
    assert mixing.mix(spark.createDataFrame([], kinds)).count() == 0
    nothing = mixing.mix(spark.createDataFrame(rows[:2], kinds)).collect()
    assert [r.sampled for r in nothing] == [False, False]


@pytest.mark.parametrize("shard_tokens", [4_000_000, 2_000])
def test_packing_is_a_partition_of_all_tokens(spark, shard_tokens):
    rng = random.Random(6)
    rows = [(i, "w " * int(rng.paretovariate(0.7)) if i % 20 else None, i) for i in range(400)]
    rows = [(i, t and t[:60_000], k) for i, t, k in rows] + [(None, "a b", 1), (3, "again", 1), (3, "again", 1)]
    sizes = (16, 64, 256, 1000)
    got = packing.best_fit(spark.createDataFrame(rows, "doc_id long, text string, bin_id long"), sizes=sizes, shard_tokens=shard_tokens).collect()
    want = sorted((i is None, i or 0, len((t or "").split()) + 1) for i, t, _ in rows)
    tokens: dict = defaultdict(int)
    for r in got:
        tokens[r.doc_id] += r.length
        assert r.start == r.piece * sizes[-1]
        assert 0 < r.length <= sizes[-1]
    every: dict = defaultdict(int)
    for null, i, n in want:
        every[None if null else i] += n
    assert tokens == every
    bins = defaultdict(list)
    for r in got:
        bins[r.bin_id].append(r)
    for pieces in bins.values():
        pieces.sort(key=lambda r: r.offset)
        end = 0
        for r in pieces:
            assert r.offset == end
            end += r.length
        assert {r.capacity for r in pieces} == {min(s for s in sizes if s >= end)}
    padded = sum(p[0].capacity for p in bins.values())
    assert sum(tokens.values()) >= (0.9 if shard_tokens > 10_000 else 0.6) * padded


def test_pack_takes_the_tightest_bin():
    rng = np.random.default_rng(2)
    lengths = np.sort(rng.integers(1, 101, 400))[::-1]
    where, offset, caps = packing.pack(lengths, [100], 0)
    room: list[int] = []
    for n, b, o in zip(lengths.tolist(), where.tolist(), offset.tolist(), strict=True):
        fits = [r for r in room if r >= n]
        if fits:
            assert room[b] == min(fits)
        else:
            assert b == len(room)
            room.append(100)
        assert o == 100 - room[b]
        room[b] -= n
    assert set(caps.tolist()) == {100}


def test_packing_of_an_empty_table(spark):
    got = packing.best_fit(spark.createDataFrame([], "doc_id long, text string"))
    assert got.columns == ["doc_id", "piece", "start", "length", "bin_id", "capacity", "offset"]
    assert got.count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, i) for i in range(1001, 1200)] + [(5000 + rng.randrange(300), 5000 + rng.randrange(300)) for _ in range(200)] + [(9, 9)]
    parent: dict[int, int] = {}
    for a, b in edges:
        parent.setdefault(a, a), parent.setdefault(b, b)
    for _ in range(300):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()
    assert len(got) == len({r.node for r in got})
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert {r.node: r.component for r in got} == {k: v for k, v in parent.items() if k not in alone}


def test_pipeline_stages_follow_each_other(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scratch, was = Scratch(spark, "test"), docs
    for name, stage in pipeline.STAGES:
        now = scratch.table(stage(spark, was, SF), name)
        if name == "packing":
            lengths = {r.doc_id: r.n for r in now.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
            assert lengths == {r.doc_id: len(WORD.findall(r.text or "")) + 1 for r in was.collect()}
        else:
            assert now.dtypes == docs.dtypes
            ids = {r.doc_id for r in was.select("doc_id").collect()}
            left = {r.doc_id for r in now.select("doc_id").collect()}
            assert left <= ids
            assert len(left) < len(ids) or name == "substring_dedup"
            assert now.where("n_chars != length(text)").count() == 0
        was = now
    assert sorted(map(tuple, pipeline.run(spark, SF).collect())) == sorted(map(tuple, was.collect()))


def test_repeated_ids_are_spread_over_shards(spark):
    """Rows of one id (or none) and one length are dealt like any others."""
    rows = spark.range(40_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("w " * 20).alias("text")).repartition(4)
    got = packing.best_fit(rows, shard_tokens=42_000).groupBy(F.shiftright("bin_id", 32).alias("shard")).agg(F.sum("length").alias("n")).collect()
    assert len(got) == 20
    assert max(r.n for r in got) < 1.3 * 42_000
    assert sum(r.n for r in got) == 40_000 * 21


CLASH = "doc_id long, text string, lang string, source string, n_chars long, n_words int, topic string, weight double, kept boolean, row string, id long, bin_id string"


def odd_documents(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    prose = lambda n: " ".join(f"word{rng.randrange(5000)}" for _ in range(n))
    texts = [prose(120) for _ in range(12)]
    texts[5] = texts[4]
    texts[7] = texts[6] + " more"
    passage = prose(70)
    texts[8], texts[9] = f"{texts[8]} {passage}", f"{passage} {texts[9]}"
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, prose(90)), (None, texts[0]), (None, None), (20, None), (21, ""), (22, " \n"), (23, prose(30_000)), (4, prose(100))]
    return [(i, t, rng.choice(["en", None]), rng.choice(["a", None]), len(t or ""), 1, "t", 0.5, False, "r", 9, None) for i, t in rows]


@pytest.mark.parametrize("rows", [odd_documents(1), []])
def test_every_stage_takes_odd_rows(spark, tmp_path, rows):
    """Nulls, empty and long texts, repeated rows and ids, an empty table, clashing columns."""
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 0, 1), (2, None, None)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, CLASH)
    got = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, f"file://{tmp_path}")
        assert name == "packing" or out.dtypes == docs.dtypes
        got[name] = out.collect()
        if not rows:
            assert got[name] == []
        elif name != "packing":
            assert {(r.n_words, r.topic, r.weight, r.row, r.id) for r in got[name]} == {(1, "t", 0.5, "r", 9)}
    if rows:
        ids = lambda name: sorted((r.doc_id is None, r.doc_id or 0, len(r.text or "")) for r in got[name])
        size = {(i, len(t or "")) for i, t, *_ in rows}
        assert {(r.doc_id, len(r.text or "")) for r in got["quality_rules"]} == {(i, n) for i, n in size if n > 20}
        # 5 copies a text of 4, 7 is near 6; id 3 keeps one of two equal rows and its other text, id 4 both texts
        near = ids("near_dedup")
        assert len(near) == len(rows) - 3 and (False, 7, len(rows[7][1])) not in near
        assert sum(1 for n in near if n[1] == 3) == 2 and sum(1 for n in near if n[1] in (4, 5)) == 2
        cut = {r.doc_id: r.n_chars for r in got["substring_dedup"]}
        assert cut[9] < rows[9][4] and cut[8] == rows[8][4]
        assert sum(r.length for r in got["packing"]) == sum(len((t or "").split()) + 1 for _, t, *_ in rows)


def test_targets_that_cannot_be_met_are_told(spark):
    rows = [(i, "w " * 10, "en", "a" if i % 2 else "b") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    goal = {"lang": spark.createDataFrame([("=en", 0.5), ("=de", 0.5)], "lang string, target double")}
    assert mixing.mix(docs, targets=goal, with_off=True).first().off > 0.1
    fine = mixing.mix(docs, share=1.0, with_text=False, with_off=True)
    assert "text" not in fine.columns and fine.first().off < 1e-6
    assert {(r.margin, r.value): round(r.expected, 6) for r in mixing.achieved(fine).collect()} == {("source", "a"): 0.5, ("source", "b"): 0.5, ("lang", "en"): 1.0, ("topic", "prose"): 1.0}
    given = mixing.mix(docs, topic=F.col("source")).select("topic").distinct().collect()
    assert {r.topic for r in given} == {"a", "b"}


def test_raking_matches_plain_iteration(spark):
    """Weights against iterative proportional fitting of a table in numpy."""
    rng = np.random.default_rng(1)
    seed = rng.integers(1, 50, (3, 2, 2)).astype(float)
    goals = [rng.dirichlet(np.ones(n)) for n in seed.shape]
    want = seed.copy()
    for _ in range(400):
        for axis, goal in enumerate(goals):
            rest = tuple(k for k in range(3) if k != axis)
            want *= (goal / want.sum(rest)).reshape([-1 if k == axis else 1 for k in range(3)])
    cells = spark.createDataFrame([(str(a), str(b), str(c), int(seed[a, b, c])) for a in range(3) for b in range(2) for c in range(2)], "source string, lang string, topic string, tokens long")
    targets = {by: spark.createDataFrame([(str(i), float(x)) for i, x in enumerate(g)], f"{by} string, target double") for by, g in zip(("source", "lang", "topic"), goals, strict=True)}
    for r in mixing.rake(cells, targets, Scratch(spark, "test")).collect():
        assert r.weight == pytest.approx(want[int(r.source), int(r.lang), int(r.topic)], abs=1e-5)
