"""Ranked lexical search over a two-level quantised index of document shards.

The index is a folder of shards, one row each: some thousand consecutive documents with their
ids and lengths, their distinct terms, and the postings of each term in two levels.  Level one
is a byte for each posting, its *impact* rounded upwards; level two is the exact count of the
term in the document.  The levels are columns of their own, so what needs bounds only does not
read the other.

A search runs three passes over the index, each a scan without a shuffle of postings, so a term
that stands in every document weighs on no single task:

1. lexicon only: in how many documents each term of the queries stands;
2. level one: bytes times term weights give each document an upper bound, and one step less a
   lower bound; each task hands on its k best lower bounds of a query, and the k-th best of all
   of them is the query's threshold;
3. both levels: every document whose upper bound reaches the threshold is scored again with
   exact integers from level two.  None is left out, however many copies tie.

Terms are ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import Scratch
from .words import buffer_of, runs

#: Byte of a term, lower-cased, or 0 for a byte between terms.
FOLD = np.zeros(256, np.uint8)
FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
FOLD[0x80:] = np.arange(0x80, 0x100)

SCALE = 1_000_000  # no term's share of a score, before its weight, reaches this
STEP = -(-SCALE // 255)
SHARD_BYTES = 2 << 20
SHARD_DOCS = 4096
PAIRS = 1 << 21  # posting and query pairs, and cells of a score table, that a task holds at once

INDEX = "ids array<long>, lengths array<int>, terms array<string>, counts array<int>, docs binary, impacts binary, tf binary"


def term_runs(data: np.ndarray, row: np.ndarray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """(terms in order, terms of each text) of consecutive texts in ``data``, cut at ``row``."""
    folded = FOLD[data]
    solid = np.zeros(len(data) + 1, bool)
    solid[1:] = folded != 0
    edge = ~solid[:-1]
    cut = row[:-1]
    edge[cut[cut < len(data)]] = True  # a term ends where its text does
    start = np.flatnonzero(solid[1:] & edge)
    kept = np.concatenate([[0], np.cumsum(solid[1:])])
    offsets = np.concatenate([kept[start], kept[-1:]]).astype(np.int64)
    terms = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(folded[solid[1:]]))
    return terms, np.diff(np.searchsorted(start, row))


def slices(texts: pa.Array, most_bytes: int, most_rows: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of a column in order; a longer text stands alone."""
    data, row = buffer_of(texts)
    lo, n = 0, len(row) - 1
    while lo < n:
        hi = int(np.searchsorted(row, row[lo] + most_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), lo + most_rows, n)
        yield lo, hi, data[row[lo] : row[hi]], row[lo : hi + 1] - row[lo]
        lo = hi


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of (text) to (texts with a term, terms)."""
    for batch in batches:
        with_term = total = 0
        for _, _, data, row in slices(batch.column(0), SHARD_BYTES, len(batch)):
            _, n = term_runs(data, row)
            with_term, total = with_term + int((n > 0).sum()), total + int(n.sum())
        yield pa.RecordBatch.from_pydict({"n": [with_term], "l": [total]})


def shares(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """A posting's share of a score, before the term's weight."""
    m = 100 - 75 + (75 * n * documents) // max(terms, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def indexer(documents: int, terms: int):
    """Arrow batches of (id, text) to shards (INDEX)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, row in slices(batch.column(1), SHARD_BYTES, SHARD_DOCS):
                words, n = term_runs(data, row)
                coded = words.dictionary_encode()
                if not len(coded):
                    continue
                code = coded.indices.to_numpy().astype(np.int64)
                key, tf = np.unique(code * len(n) + np.repeat(np.arange(len(n)), n), return_counts=True)
                term, doc = np.divmod(key, len(n))
                impact = -(-shares(tf, n[doc].astype(np.int64), documents, terms) // STEP)
                one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
                lists = [
                    pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), batch.column(0).slice(lo, hi - lo).cast(pa.int64())), one(n, pa.int32()),
                    pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary.cast(pa.string())), one(np.bincount(term), pa.int32()),
                ]
                raw = [doc.astype(np.uint16).tobytes(), impact.astype(np.uint8).tobytes(), tf.astype(np.uint32).tobytes()]
                yield pa.RecordBatch.from_arrays([*lists, *[pa.array([x], pa.binary()) for x in raw]], ["ids", "lengths", "terms", "counts", "docs", "impacts", "tf"])

    return run


class RankIndex:
    """An index in a folder, with the statistics it was built with."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        stats = spark.read.json(f"{path}/stats").first()
        self.documents, self.terms = stats["documents"], stats["terms"]

    @classmethod
    def build(cls, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> RankIndex:
        """Indexes all rows.  Null texts have no terms; rows that repeat an id are documents of their own."""
        text = F.col(f"`{text_col}`")
        count = docs.select(text).mapInArrow(measured, "n long, l long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("documents"), F.coalesce(F.sum("l"), F.lit(0)).alias("terms"))
        documents, terms = count.first()
        docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text")).mapInArrow(indexer(documents, terms), INDEX).write.parquet(f"{path}/shards")
        docs.sparkSession.range(1, numPartitions=1).select(F.lit(documents).cast("long").alias("documents"), F.lit(terms).cast("long").alias("terms")).write.json(f"{path}/stats")
        return cls(docs.sparkSession, path)

    def read(self, *columns: str) -> DataFrame:
        return self.spark.read.schema(INDEX).parquet(f"{self.path}/shards").select(*columns)

    def search(self, queries: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = 10, at_once: int = 200_000) -> DataFrame:
        """(id, rank, doc_id, score): the k best documents with a score above 0 of each query row.

        Equal scores go by ascending document id, null ids last.  Rows of queries that repeat an
        id are searched for each by itself, and so are null ids.  Queries without a known term
        find nothing.  Queries go to the tasks in blocks of at most ``at_once`` of their terms; a
        single query with more is a block of its own.
        """
        scratch = Scratch(self.spark, "search")
        base = scratch.table(queries.select(F.monotonically_increasing_id().alias("q"), F.col(f"`{id_col}`").alias("item"), F.col(f"`{text_col}`").alias("text")), "queries")
        asked = scratch.table(base.select("q", "text").mapInArrow(query_terms, "q long, term string, times long"), "asked")
        sizes = asked.groupBy("q").agg(F.count("*").alias("n"))
        total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        lanes = sizes.withColumn("lane", F.pmod(F.xxhash64("q"), F.lit(max(1, -(-total // at_once)))))
        before = F.sum("n").over(Window.partitionBy("lane").orderBy("q")) - F.col("n")
        blocks = lanes.withColumn("block", F.floor(before / at_once).cast("int"))
        asked = scratch.table(asked.join(blocks.select("q", "lane", "block"), "q"), "blocks")
        found = None
        for lane, block in sorted((r["lane"], r["block"]) for r in asked.select("lane", "block").distinct().toArrow().to_pylist()):
            some = asked.where((F.col("lane") == lane) & (F.col("block") == block)).select("q", "term", "times").toArrow().combine_chunks()
            hits = scratch.table(self._block(some, k, scratch), "hits")
            found = hits if found is None else found.unionByName(hits)
        if found is None:
            found = self.spark.createDataFrame([], "q long, doc_id long, score long")
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        top = found.withColumn("rank", place).where(F.col("rank") <= k)
        return base.select("q", "item").join(top, "q").select(F.col("item").alias(id_col), "rank", "doc_id", "score")

    def _block(self, asked: pa.Table, k: int, scratch: Scratch) -> DataFrame:
        sc = self.spark.sparkContext
        coded = asked.column("term").combine_chunks().dictionary_encode()
        code, order = coded.indices.to_numpy(), np.unique(asked.column("q").to_numpy())
        query, times = np.searchsorted(order, asked.column("q").to_numpy()), asked.column("times").to_numpy()
        lexicon = sc.broadcast(coded.dictionary)
        seen = self.read("terms", "counts").mapInArrow(counter(lexicon), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        df = np.zeros(len(coded.dictionary), np.int64)
        df[seen.column("term").to_numpy()] = seen.column("df").to_numpy()
        weight = np.array([math.floor(1000 * math.log((2 * self.documents + 2) / (2 * int(n) + 1))) for n in df], np.int64)
        by = np.argsort(code, kind="stable")
        first = np.searchsorted(code[by], np.arange(len(df) + 1))
        asks = sc.broadcast((coded.dictionary, order, first, query[by], (weight[code] * times)[by]))
        bounds = self.read("ids", "terms", "counts", "docs", "impacts").mapInArrow(lower_bounds(asks, k), "q long, low long")
        best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("low")))
        least = scratch.table(bounds, "bounds").withColumn("n", best).where(F.col("n") == k).select("q", "low").toArrow()
        need = np.zeros(len(order), np.int64)
        need[np.searchsorted(order, least.column("q").to_numpy())] = least.column("low").to_numpy()
        return self.read("ids", "lengths", "terms", "counts", "docs", "impacts", "tf").mapInArrow(rescored(asks, sc.broadcast(need), k, self.documents, self.terms), "q long, doc_id long, score long")


def query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of (q, text) to (q, term, times)."""
    for batch in batches:
        for lo, hi, data, row in slices(batch.column(1), SHARD_BYTES, SHARD_DOCS):
            words, n = term_runs(data, row)
            coded = words.dictionary_encode()
            size = max(1, len(coded.dictionary))
            key, times = np.unique(np.repeat(np.arange(hi - lo), n) * size + coded.indices.to_numpy(), return_counts=True)
            whose, term = np.divmod(key, size)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(whose)), coded.dictionary.take(pa.array(term)).cast(pa.string()), pa.array(times, pa.int64())], ["q", "term", "times"])


def counter(lexicon):
    """Shards' (terms, counts) to (term, documents) of the terms in a broadcast list, summed by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = lexicon.value
        df = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for i in range(len(batch)):
                at = pc.index_in(wanted, value_set=batch.column(0)[i].values.cast(wanted.type))
                here = at.is_valid().to_numpy(zero_copy_only=False)
                df[here] += batch.column(1)[i].values.to_numpy()[at.drop_null().to_numpy()]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "df"])

    return run


class Matches:
    """Postings of a shard for the terms of a block of queries."""

    def __init__(self, batch: pa.RecordBatch, i: int, asks):
        wanted, self.order, self.first, self.query, self.weight = asks
        self.ids = batch.column("ids")[i].values
        at = pc.index_in(wanted, value_set=batch.column("terms")[i].values.cast(wanted.type))
        self.asked = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        counts = batch.column("counts")[i].values.to_numpy().astype(np.int64)
        ends = np.cumsum(counts)
        term = at.drop_null().to_numpy()
        self.count, self.begin = counts[term], ends[term] - counts[term]
        self.docs = np.frombuffer(batch.column("docs")[i].as_buffer(), np.uint16)
        self.impacts = np.frombuffer(batch.column("impacts")[i].as_buffer(), np.uint8)

    def parts(self) -> Iterator[tuple[int, int, Callable]]:
        """(first query, last query + 1, pairs) in parts of bounded size.

        ``pairs()`` gives each pair's query (from 0), weight and posting, in bounded arrays.
        """
        n = len(self.order)
        step = max(1, PAIRS // max(1, len(self.ids)))
        asks = self.first[self.asked + 1] - self.first[self.asked]
        owner, ask = np.repeat(np.arange(len(self.asked)), asks), runs(self.first[self.asked], asks)
        query = self.query[ask]
        for lo in range(0, n, step):
            mine = np.flatnonzero((query >= lo) & (query < lo + step))
            size = self.count[owner[mine]]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(size) // PAIRS)) + 1, [len(mine)]])

            def pairs(lo=lo, mine=mine, size=size, cut=cut) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
                for x, y in zip(cut[:-1], cut[1:], strict=True):
                    some, many = mine[x:y], size[x:y]
                    yield np.repeat(query[some] - lo, many), np.repeat(self.weight[ask[some]], many), runs(self.begin[owner[some]], many)

            yield lo, min(lo + step, n), pairs

    def bounds(self, n: int, pairs: Callable) -> tuple[np.ndarray, np.ndarray]:
        """(upper, lower) bound of each of n queries with each document."""
        cells = n * len(self.ids)
        upper, slack = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
        for query, weight, posting in pairs():
            cell = query * len(self.ids) + self.docs[posting]
            np.add.at(upper, cell, weight * self.impacts[posting])
            np.add.at(slack, cell, weight)
        upper *= STEP
        return upper.reshape(n, -1), np.maximum(upper - STEP * slack, 0).reshape(n, -1)


def lower_bounds(asks, k: int):
    """Shards to each query's k best lower bounds in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = asks.value[1]
        best = np.zeros((len(order), k), np.int64)
        for batch in batches:
            for i in range(len(batch)):
                shard = Matches(batch, i, asks.value)
                for lo, hi, pairs in shard.parts():
                    _, low = shard.bounds(hi - lo, pairs)
                    both = np.concatenate([best[lo:hi], low], axis=1)
                    best[lo:hi] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        q, j = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(order[q]), pa.array(best[q, j])], ["q", "low"])

    return run


def rescored(asks, need, k: int, documents: int, terms: int):
    """Shards to the exact scores of documents whose upper bound reaches the query's need; k a query and task."""
    far = np.iinfo(np.int64).max  # the place of a null id

    def first_k(q: np.ndarray, doc: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, ...]:
        by = np.lexsort((doc, -score, q))
        q, doc, score = q[by], doc[by], score[by]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        return q[place < k], doc[place < k], score[place < k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, least = asks.value[1], need.value
        held = tuple(np.zeros(0, np.int64) for _ in range(3))
        for batch in batches:
            for i in range(len(batch)):
                shard = Matches(batch, i, asks.value)
                ids = shard.ids.fill_null(far).to_numpy()
                length = batch.column("lengths")[i].values.to_numpy().astype(np.int64)
                tf = np.frombuffer(batch.column("tf")[i].as_buffer(), np.uint32)
                for lo, hi, pairs in shard.parts():
                    upper, _ = shard.bounds(hi - lo, pairs)
                    wanted = ((upper > 0) & (upper >= least[lo:hi, None])).ravel()
                    if not wanted.any():
                        continue
                    score = np.zeros(wanted.size, np.int64)
                    for query, weight, posting in pairs():
                        cell = query * len(ids) + shard.docs[posting]
                        in_ = wanted[cell]
                        p = posting[in_]
                        np.add.at(score, cell[in_], weight[in_] * shares(tf[p].astype(np.int64), length[shard.docs[p]], documents, terms))
                    at = np.flatnonzero(score)
                    new = lo + at // len(ids), ids[at % len(ids)], score[at]
                    held = first_k(*(np.concatenate(x) for x in zip(held, new, strict=True)))
        q, doc, score = held
        yield pa.RecordBatch.from_arrays([pa.array(order[q]), pa.array(doc, mask=doc == far), pa.array(score)], ["q", "doc_id", "score"])

    return run


def rank(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best of all documents for each query, over an index of this call."""
    scratch = Scratch(docs.sparkSession, "rankindex")
    return RankIndex.build(docs, scratch.folder("index")).search(queries, k=k)
