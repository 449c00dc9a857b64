"""The vector index: recall, rows touched, added rows, odd rows."""

from __future__ import annotations

import numpy as np
import pytest

from docloom.operators import retrieve, vectors
from docloom.operators.vectors import VectorIndex, recall

CHUNK = "document_id long, chunk_index int, embedding array<float>"


def grouped(seed: int, n: int = 1500, dim: int = 24) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(0).normal(size=(30, dim))
    v = centres[rng.integers(0, 30, n)] + 0.25 * rng.normal(size=(n, dim))
    return [(seed * 100_000 + i, i % 3, [float(x) for x in r]) for i, r in enumerate(v)]


def test_recall_of_old_and_added_rows(spark, tmp_path):
    old, new = grouped(1), grouped(2)
    odd = [(9, 0, None), (10, 0, [0.0] * 24), (11, 0, [1.0]), (12, 0, [float("nan")] * 24), (13, 0, [None] * 24)]
    index = VectorIndex.create(spark.createDataFrame(old + odd, CHUNK), f"file://{tmp_path}/i")
    index.add(spark.createDataFrame(old + odd, CHUNK))
    first = index.table._manifest(1)["files"][0]
    index.add(spark.createDataFrame(new, CHUNK))
    assert index.table._manifest(2)["files"][0] == first  # nothing was built again
    rows = spark.createDataFrame(old + new, CHUNK)
    asked = spark.createDataFrame([(i, list(map(float, r[2]))) for i, r in enumerate((old + new)[::60])] + [(900, None), (901, [0.0] * 24), (902, [1.0])], "query_id long, q array<double>")
    probes = index.tune(10, 0.97)
    hits, touched = index.search(asked, 10, probes)
    exact = retrieve.semantic_each(rows, asked, 10)
    got = recall(hits, exact).first()
    assert got.queries == 50 and got.recall >= 0.9
    assert probes <= 8 and 0 < max(r.rows for r in touched.collect()) < 1500
    true = {(r.query_id, r.document_id, r.chunk_index): r.score for r in exact.collect()}
    for r in hits.collect():
        assert r.score == pytest.approx(true.get((r.query_id, r.document_id, r.chunk_index), r.score), abs=2e-6)
    # all cells and a long list: the exact result
    whole, _ = VectorIndex(spark, f"file://{tmp_path}/i").search(asked, 10, 10_000, refine=300)
    assert recall(whole, exact).first().recall == 1.0


def test_without_queries_or_rows(spark, tmp_path):
    index = VectorIndex.create(spark.createDataFrame(grouped(1)[:5], CHUNK), f"file://{tmp_path}/i", cells=1)
    asked = spark.createDataFrame([(1, [1.0] * 24)], "query_id long, q array<double>")
    assert index.search(asked, 3)[0].count() == 0
    index.add(spark.createDataFrame(grouped(1)[:5], CHUNK))
    assert index.search(asked, 3)[0].count() == 3
    assert index.search(asked.limit(0), 3)[0].count() == 0
    with pytest.raises(ValueError, match="no vector"):
        VectorIndex.create(spark.createDataFrame([], CHUNK), f"file://{tmp_path}/j")


def test_held_hits_count_in_the_blocks_of_queries(spark, tmp_path, monkeypatch):
    assert vectors.blocks_of(1_000_000, 64, 24, 80) * vectors.BLOCK_BYTES >= 1_000_000 * 80 * 28
    index = VectorIndex.create(spark.createDataFrame(grouped(1), CHUNK), f"file://{tmp_path}/i")
    index.add(spark.createDataFrame(grouped(1), CHUNK))
    asked = spark.createDataFrame([(i, list(map(float, r[2]))) for i, r in enumerate(grouped(1)[::300])], "query_id long, q array<double>")
    key = lambda df: sorted(map(tuple, df.collect()))
    whole = [key(x) for x in index.search(asked, 3)]
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 4096)
    assert vectors.blocks_of(asked.count(), 24, 8, 12) > 1
    assert [key(x) for x in index.search(asked, 3)] == whole
