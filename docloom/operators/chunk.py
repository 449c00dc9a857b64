"""Byte-bounded chunks of documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST, MOST, SENTENCE = 500, 1500, 50
ENDS = ".?!"


def sentences(paragraph: str) -> list[str]:
    """Cut behind . ? ! once more than 50 bytes have gathered; pieces are trimmed."""
    out, start, size = [], 0, 0
    for i, c in enumerate(paragraph):
        size += len(c.encode())
        if c in ENDS and size > SENTENCE:
            out.append(paragraph[start : i + 1])
            start, size = i + 1, 0
    out.append(paragraph[start:])
    return [s for s in map(str.strip, out) if s]


def chunks(text: str) -> list[str]:
    """Paragraphs packed to 500 bytes or more and, where sentences allow, 1500 at most."""
    done: list[str] = []
    cur, size = [], 0  # pieces of the open chunk with the separators before them, and bytes

    def flush() -> None:
        nonlocal size
        if cur:
            done.append("".join(cur))
        cur.clear()
        size = 0

    def add(piece: str, joint: str) -> None:
        nonlocal size
        cur.append(joint + piece if cur else piece)
        size += len(cur[-1].encode())

    for p in filter(None, map(str.strip, text.split("\n\n"))):
        n = len(p.encode())
        if cur and size + n > MOST:
            flush()
        if n > MOST:
            flush()
            for s in sentences(p):
                if cur and size + len(s.encode()) > MOST:
                    flush()
                add(s, " ")
        else:
            add(p, "\n\n")
        if size >= LEAST:
            flush()
    flush()
    return done


def chunk(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_index from 0, content); null and blank texts give no chunk."""
    slim = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.col(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [chunks(t) for t in batch.column(1).to_pylist()]
            n = [len(c) for c in cut]
            rows = pa.array([i for i, k in enumerate(n) for _ in range(k)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array([j for k in n for j in range(k)], pa.int32()), pa.array([x for c in cut for x in c], pa.string())], [id_col, "chunk_index", "content"])

    schema = T.StructType([slim.schema[0], T.StructField("chunk_index", T.IntegerType()), T.StructField("content", T.StringType())])
    return slim.mapInArrow(run, schema)
