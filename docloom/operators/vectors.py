"""Approximate nearest vectors: coarse cells with byte residuals, re-ranked exactly.

Centroids are fitted once on a bounded sample.  Every vector of length one goes to its nearest
cell with what is left of it (the residual) as bytes and a scale.  Rows are sorted by cell, cut by
range so that a crowded cell is spread over files, and appended as runs: new rows need no rebuild.

A search looks at the ``probes`` nearest cells of each query.  It reads cells and bytes only,
shortlists by the approximate cosine, and scores the shortlist with the vectors themselves.
``semantic_each`` in ``retrieve`` stays as the exact way.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import written
from ..sources.versioned import VersionedTable
from .retrieve import _matrix, cosine, first_k, semantic_each

CELLS = "cell int, document_id long, chunk_index int, residual binary, scale float, embedding array<float>"
SAMPLE = 50_000  # vectors that centroids are fitted on
BLOCK_BYTES = 192 << 20  # of queries that go to the tasks at once, with the hits that a task holds for them
HIT_BYTES = 28 * 6  # a held hit, and the copies while hits are sorted


def blocks_of(queries: int, dim: int, probes: int, held: int) -> int:
    """In how many blocks queries go to the tasks, when each brings ``held`` hits."""
    return max(1, ceil(queries * (8 * (dim + probes) + held * HIT_BYTES) / BLOCK_BYTES))


def assigner(centroids):
    """Arrow batches of (document_id, chunk_index, embedding) to rows of CELLS; vectors without a direction get none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centroids.value
        for batch in batches:
            good, v = _matrix(batch.column(2), c.shape[1])
            if not len(v):
                continue
            cell = np.argmax(v @ c.T, axis=1)
            left = v - c[cell]
            scale = np.maximum(np.abs(left).max(axis=1), 1e-12) / 127
            code = np.rint(left / scale[:, None]).astype(np.int8)
            kept = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell, pa.int32()), kept.column(0), kept.column(1), pa.array([x.tobytes() for x in code], pa.binary()), pa.array(scale, pa.float32()), kept.column(2)],
                ["cell", "document_id", "chunk_index", "residual", "scale", "embedding"],
            )

    return run


def shortlister(asks, k: int):
    """Rows (cell, document_id, chunk_index, residual, scale) to each query's k best of the task by approximate cosine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, centroids, first, probing = asks.value
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0))

        def best(x):
            order = np.lexsort((x[2], x[1], -x[3], x[0]))
            x = tuple(a[order] for a in x)
            place = np.arange(len(order)) - np.searchsorted(x[0], x[0])
            return tuple(a[place < k] for a in x)

        for batch in batches:
            cell = batch.column(0).to_numpy()
            doc, part = (batch.column(i).to_numpy() for i in (1, 2))
            codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int8).reshape(len(cell), -1)
            scale = batch.column(4).to_numpy().astype(np.float64)
            for c in np.unique(cell):
                mine, rows = probing[first[c] : first[c + 1]], np.flatnonzero(cell == c)
                if not len(mine):
                    continue
                got = (q[mine] @ codes[rows].T) * scale[rows] + (q[mine] @ centroids[c])[:, None]
                top = np.argpartition(-got, k - 1, axis=1)[:, :k] if len(rows) > k else np.broadcast_to(np.arange(len(rows)), got.shape)
                new = np.repeat(mine, top.shape[1]), doc[rows][top].ravel(), part[rows][top].ravel(), np.take_along_axis(got, top, 1).ravel()
                held = best(tuple(np.concatenate(x) for x in zip(held, new, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[held[0]]), pa.array(held[1]), pa.array(held[2], pa.int32()), pa.array(held[3])], ["query_id", "document_id", "chunk_index", "score"])

    return run


class VectorIndex:
    """An index in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.table = spark, path, VersionedTable(spark, f"{path}/rows")
        self.centroids = np.array(spark.read.parquet(f"{path}/centroids").orderBy("cell").toArrow().column("centre").to_pylist(), np.float64)

    @classmethod
    def create(cls, chunks: DataFrame, path: str, cells: int | None = None) -> VectorIndex:
        """An empty index with centroids fitted on at most SAMPLE vectors of ``chunks``, the lowest by a hash of the id.

        ``cells`` is the root of the number of sampled vectors unless told.  All vectors of an index
        have the length that most of the sample has.
        """
        spark = chunks.sparkSession
        usable = chunks.where(cosine(F.col("embedding"), F.col("embedding")).between(0.5, 1.5)).select("document_id", F.col("embedding").cast("array<double>").alias("e"))
        rows = written(usable.orderBy(F.xxhash64("document_id"), "document_id").limit(SAMPLE), "sample")
        sizes = rows.groupBy(F.size("e").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
        if sizes is None:
            raise ValueError("no vector to fit centroids on")
        norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x))
        rows = rows.where(F.size("e") == sizes["dim"]).select(array_to_vector(F.transform("e", lambda x: x / norm)).alias("features"))
        k = max(1, min(cells or ceil(sqrt(sizes["n"])), sizes["n"]))
        centres = KMeans(k=k, seed=1, maxIter=15).fit(rows).clusterCenters() if k > 1 else [np.array(rows.first()[0].toArray())]
        spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centroids")
        VersionedTable.create(spark, f"{path}/rows", CELLS)
        return cls(spark, path)

    def add(self, chunks: DataFrame) -> None:
        """Indexes (document_id, chunk_index, embedding) as one more run; no vector that is there moves."""
        held = self.spark.sparkContext.broadcast(self.centroids)
        rows = chunks.where("embedding is not null").select(F.col("document_id").cast("long"), F.col("chunk_index").cast("int"), F.col("embedding").cast("array<float>"))
        made = written(rows.mapInArrow(assigner(held), CELLS), "cells")
        self.table.append(made.repartitionByRange("cell", "document_id", "chunk_index").sortWithinPartitions("cell", "document_id", "chunk_index"))

    def tune(self, k: int, target: float = 0.95, sample: int = 200) -> int:
        """How many cells to look at, so that ``target`` of the k nearest are among them.

        Measured against the exact search for ``sample`` of the index's own vectors.  Vectors in
        clear groups need few cells; without any structure most of them are needed.
        """
        rows = self.table.read().select("document_id", "chunk_index", "cell", "embedding")
        asked = written(rows.orderBy(F.xxhash64("document_id", "chunk_index"), "document_id").limit(sample).select(F.xxhash64("document_id", "chunk_index").alias("query_id"), F.col("embedding").alias("q")), "asked")
        near = semantic_each(rows, asked, k).join(rows.select("document_id", "chunk_index", "cell"), ["document_id", "chunk_index"]).join(asked, "query_id").select("q", "cell").toArrow()
        if not near.num_rows:
            return len(self.centroids)
        q, cell = np.array(near.column("q").to_pylist(), np.float64), near.column("cell").to_numpy()
        close = q @ self.centroids.T
        place = np.sort((close > np.take_along_axis(close, cell[:, None], 1)).sum(axis=1))
        return int(place[min(len(place) - 1, ceil(target * len(place)) - 1)]) + 1

    def search(self, queries: DataFrame, k: int, probes: int = 8, refine: int = 4) -> tuple[DataFrame, DataFrame]:
        """(hits, touched): the k best of (query_id, q) among ``probes`` cells, and rows looked at by query.

        ``hits`` are (query_id, document_id, chunk_index, score) by exact cosine of the ``refine`` * k
        best by residuals.  Queries go to the tasks in blocks of BLOCK_BYTES at most, counting the hits held for them.
        """
        dim, sc = self.centroids.shape[1], self.spark.sparkContext
        given = written(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("q").cast("array<double>").alias("q")).where(F.size("q") == dim), "queries")
        count = given.count()
        blocks = blocks_of(count, dim, probes, refine * k)
        short, touched = None, None
        sizes = written(self.table.read().groupBy("cell").agg(F.count("*").alias("n")), "sizes")
        for i in range(blocks):
            some = given.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toArrow().combine_chunks()
            good, q = _matrix(some.column("q").combine_chunks() if some.num_rows else pa.array([], pa.list_(pa.float64())), dim)
            ids = some.column("query_id").to_numpy()[good] if some.num_rows else np.zeros(0, np.int64)
            m = min(probes, len(self.centroids))
            near = np.argpartition(-(q @ self.centroids.T), m - 1, axis=1)[:, :m]
            order = np.argsort(near.ravel(), kind="stable")
            first = np.searchsorted(near.ravel()[order], np.arange(len(self.centroids) + 1))
            asks = sc.broadcast((ids, q, self.centroids, first, np.repeat(np.arange(len(ids)), m)[order]))
            rows = self.table.read().select("cell", "document_id", "chunk_index", "residual", "scale")
            used = np.unique(near).tolist()
            rows = rows.where(F.col("cell").isin(used)) if len(used) < len(self.centroids) else rows
            found = written(first_k(rows.mapInArrow(shortlister(asks, refine * k), "query_id long, document_id long, chunk_index int, score double"), refine * k, "query_id"), "short")
            looked = self.spark.createDataFrame(pa.table({"query_id": np.repeat(ids, m), "cell": near.ravel().astype(np.int32)}))
            looked = written(looked.join(sizes, "cell").groupBy("query_id").agg(F.sum("n").alias("rows")), "touched")
            short, touched = (found, looked) if short is None else (short.unionByName(found), touched.unionByName(looked))
        vectors = self.table.read().select("document_id", "chunk_index", "embedding")
        exact = short.drop("score").join(vectors, ["document_id", "chunk_index"]).join(given, "query_id")
        exact = exact.select("query_id", "document_id", "chunk_index", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
        return first_k(exact, k, "query_id"), touched


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, recall): the share of exact hits that were found; a hit of the same score as the last counts."""
    last = exact.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    hit = found.join(last, "query_id", "right").groupBy("query_id", "n").agg(F.count_if(F.col("score") >= F.col("least")).alias("hits"))
    return hit.agg(F.count("*").alias("queries"), (F.sum(F.least("hits", "n")) / F.sum("n")).alias("recall"))
