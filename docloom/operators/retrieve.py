"""Gated semantic, lexical and hybrid retrieval over chunk tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GATE = ("sanitized", "never")
LEVELS = ("T1", "T2", "T3", "T4")
HAN = "一-鿿"


def ceiling(value: str | None) -> str:
    """Absent is T3; a value that is no level is an error and never widens."""
    if value is None:
        return "T3"
    level = value.strip().upper()
    if level not in LEVELS:
        raise ValueError(f"unknown data level {value!r}")
    return level


def admitted(level: Column, top: str | None) -> Column:
    """Levels up to the ceiling; an unreadable level counts as T4."""
    return F.coalesce(level, F.lit("T4")).isin(*LEVELS[: LEVELS.index(ceiling(top)) + 1])


def gated(chunks: DataFrame, tenant: int | str, matter: int | str | None = None, top: str | None = None, jurisdiction: str | None = None, source_level: str | None = None) -> DataFrame:
    """The only view of chunks that searches read: gate, scope and ceiling before any limit."""
    out = chunks.where(F.coalesce("sanitization_state", F.lit("pending")).isin(*GATE)).where(F.col("tenant_id") == tenant).where(admitted(F.col("data_level"), top))
    for name, value in (("matter_id", matter), ("jurisdiction", jurisdiction), ("source_level", source_level)):
        out = out.where(F.col(name) == value) if value is not None else out
    return out


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.try_divide(dot, norm(a) * norm(b))


def semantic(chunks: DataFrame, vector: list[float] | DataFrame, k: int) -> DataFrame:
    """Top k by cosine; ``vector`` is a list or a one-row DataFrame with a column ``q``."""
    if isinstance(vector, list):
        chunks = chunks.withColumn("q", F.array(*[F.lit(float(x)) for x in vector]))
    else:
        chunks = chunks.crossJoin(F.broadcast(vector.select("q").limit(1)))
    scored = chunks.where("embedding is not null").withColumn("score", F.round(cosine(F.col("embedding"), F.col("q")), 6)).drop("q")
    return scored.orderBy(F.desc("score"), "document_id", "chunk_index").limit(k)


def _matrix(column: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(which vectors have ``dim`` numbers and a length, those vectors at length one)."""
    values = column.to_pylist()
    good = np.array([v is not None and len(v) == dim and None not in v for v in values], bool)
    rows = np.array([v for v, g in zip(values, good, strict=True) if g], np.float64).reshape(-1, dim)
    norm = np.sqrt((rows * rows).sum(axis=1))
    solid = np.isfinite(norm) & (norm > 0)
    good[np.flatnonzero(good)[~solid]] = False
    return good, rows[solid] / norm[solid, None]


def _nearest(queries, k: int, at_once: int = 256):
    """Arrow batches of (document_id, chunk_index, embedding) to the task's top k of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = queries.value
        score, doc, part = np.full((len(ids), k), -(1 << 40)), np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k), np.int64)
        for batch in batches:
            good, v = _matrix(batch.column(2), q.shape[1])
            d, c = (batch.column(i).to_numpy(zero_copy_only=False)[good].astype(np.int64) for i in (0, 1))
            order = np.lexsort((c, d))
            d, c, v = d[order], c[order], v[order]
            if not len(d):
                continue
            for lo in range(0, len(ids), at_once):
                s = slice(lo, lo + at_once)
                got = np.rint(q[s] @ v.T * 1e6).astype(np.int64)
                if len(d) > k:  # ties go to the smaller id, which stands first
                    best = np.argpartition((np.arange(len(d)) - (got << 20)), k - 1, axis=1)[:, :k]
                else:
                    best = np.broadcast_to(np.arange(len(d)), got.shape)
                a, b, e = (np.concatenate(x, axis=1) for x in ((score[s], np.take_along_axis(got, best, 1)), (doc[s], d[best]), (part[s], c[best])))
                top = np.lexsort((e, b, -a), axis=-1)[:, :k]
                score[s], doc[s], part[s] = (np.take_along_axis(x, top, 1) for x in (a, b, e))
        row, col = np.nonzero(score > -(1 << 40))
        for lo in range(0, len(row), 50_000):
            at = row[lo : lo + 50_000], col[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(ids[at[0]]), pa.array(doc[at]), pa.array(part[at].astype(np.int32)), pa.array(score[at] / 1e6)], ["query_id", "document_id", "chunk_index", "score"])

    return run


def first_k(rows: DataFrame, k: int, *by: str) -> DataFrame:
    """The k rows of the best score, of each ``by`` where given."""
    order = [F.desc("score"), "document_id", "chunk_index"]
    if not by:
        return rows.orderBy(*order).limit(k)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def semantic_each(chunks: DataFrame, queries: DataFrame, k: int, at_once: int = 64 << 20) -> DataFrame:
    """(query_id, document_id, chunk_index, score): top k chunks by cosine for each of (query_id, q).

    Every query meets every chunk.  Queries go to the tasks in passes of ``at_once`` bytes at most,
    and each task hands on its k best of a query.  Vectors without a cosine are no hits.
    """
    spark = chunks.sparkSession
    given = queries.select(F.col("query_id").cast("long").alias("query_id"), "q").where("q is not null")
    size = given.agg(F.coalesce(F.sum(8 + 8 * F.size("q") + 24 * k), F.lit(0))).first()[0]
    rows = chunks.where("embedding is not null").select(F.col("document_id").cast("long").alias("document_id"), F.col("chunk_index").cast("int").alias("chunk_index"), "embedding")
    out, passes = None, max(1, -(-size // at_once))
    for i in range(passes):
        some = given.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i).toArrow().combine_chunks()
        vectors = some.column("q").combine_chunks() if some.num_rows else pa.array([], pa.list_(pa.float64()))
        for dim in sorted({len(v) for v in vectors.to_pylist() if v}) or [1]:
            good, q = _matrix(vectors, dim)
            held = spark.sparkContext.broadcast((some.column("query_id").to_numpy()[good].astype(np.int64), q))
            hits = rows.mapInArrow(_nearest(held, k), "query_id long, document_id long, chunk_index int, score double")
            out = hits if out is None else out.unionByName(hits)
    return first_k(out, k, "query_id")


def tokens(text: Column) -> Column:
    """Lower-cased words, each Han character one of its own."""
    spread = F.regexp_replace(F.lower(text), f"([{HAN}])", " $1 ")
    return F.filter(F.split(spread, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def phrase_count(text: Column, query: Column) -> Column:
    """Number of places where the query's tokens stand next to each other."""
    t, q = tokens(text), tokens(query)
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(t) - F.size(q) + 1, F.lit(1))), lambda i: F.slice(t, i, F.size(q)) == q)
    return F.when((F.size(q) > 0) & (F.size(t) >= F.size(q)), F.size(at)).otherwise(0)


def lexical(chunks: DataFrame, query: str, k: int) -> DataFrame:
    """Top k chunks that hold the phrase; score n / (n + 1) of n places, our own rank."""
    padded = F.concat(F.lit(" "), F.array_join(tokens(F.col("content")), " "), F.lit(" "))
    q = F.concat(F.lit(" "), F.array_join(tokens(F.lit(query)), " "), F.lit(" "))
    n = phrase_count(F.col("content"), F.lit(query))
    hit = chunks.where(padded.contains(q)).withColumn("score", F.round(n / (n + 1), 6))
    return hit.orderBy(F.desc("score"), "document_id", "chunk_index").limit(k)


def query_terms(query: str) -> list[str]:
    """Words of three letters or more; the single characters of tokens with Han ones."""
    out = []
    for token in re.findall(r"[^\W_]+", query):
        han = re.search(f"[{HAN}]", token)
        out += [c.lower() for c in token if re.match(f"[{HAN}]", c)] if han else ([token.lower()] if len(token) >= 3 else [])
    return list(dict.fromkeys(out))


def merged(semantic_hits: DataFrame, lexical_hits: DataFrame, k: int, budget: int = 12_000, weights: tuple[float, float] = (0.6, 0.4), by: tuple[str, ...] = ()) -> DataFrame:
    """Scores of equal content added up, top k, and the texts cut to a budget of characters.

    All this for each ``by`` (the query) where given.
    """
    cols = [*by, "document_id", "chunk_index", "content", "score"]
    legs = [hits.select(*cols).withColumn("score", F.col("score") * w).withColumn("leg", F.lit(i)) for i, (hits, w) in enumerate(zip((semantic_hits, lexical_hits), weights, strict=True))]
    both = legs[0].unionByName(legs[1]).groupBy(*by, "content").agg(F.round(F.sum("score"), 6).alias("score"), F.min(F.struct("leg", "document_id", "chunk_index")).alias("at"))
    top = first_k(both.select(*by, "at.document_id", "at.chunk_index", "content", "score"), k, *by)
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "document_id", "chunk_index")  # over k rows
    used = F.coalesce(F.sum(F.length("content")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = top.withColumn("position", F.row_number().over(order)).withColumn("content", F.substring(F.col("content"), F.lit(1), F.greatest(budget - used, F.lit(0)).cast("int")))
    return cut.where("content != ''")


def promoted(hits: DataFrame, query: str, veto: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """Hits with any query term first (``rank`` from 1); none at all when no hit has one."""
    terms = query_terms(query)
    has = F.lit(False)
    for t in terms:
        has = has | F.lower("content").contains(t)
    out = hits.withColumn("matched", has)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("matched"), "position")))
    if veto and terms:
        out = out.withColumn("any", F.max("matched").over(Window.partitionBy(*(by or [F.lit(1)])))).where("any").drop("any")
    return out


def hybrid(chunks: DataFrame, query: str, vector, k: int, budget: int = 12_000) -> DataFrame:
    return promoted(merged(semantic(chunks, vector, k), lexical(chunks, query, k), k, budget), query)


def hybrid_each(chunks: DataFrame, vectors: DataFrame, query: str, queries: DataFrame, k: int, budget: int = 12_000) -> DataFrame:
    """Hybrid search for each of (query_id, q); all share the words of ``query``.

    ``vectors`` (document_id, embedding) hold for all chunks of a document, so that the k best
    documents that have a chunk also hold the k best chunks, among the first k of each.
    """
    by = ("query_id",)
    whole = chunks.where("chunk_index = 0").select("document_id", "chunk_index").join(vectors, "document_id")
    near = semantic_each(whole, queries, k).drop("chunk_index")
    hits = first_k(near.join(chunks.where(F.col("chunk_index") < k).select("document_id", "chunk_index", "content"), "document_id"), k, *by)
    words = queries.select("query_id").crossJoin(F.broadcast(lexical(chunks, query, k)))
    return promoted(merged(hits, words, k, budget, by=by), query, by=by)


def empty_reason(documents: Column, searchable: Column, found: Column) -> Column:
    return F.when(found > 0, None).when(documents == 0, "no_documents").when(searchable == 0, "nothing_sanitized").otherwise("no_match")
