"""Best-fit packing of documents into sequences of several permitted lengths.

Documents longer than the largest capacity are cut into pieces of it.  Pieces are dealt over
shards of bounded size; in a shard, longest first, a piece goes into the open bin that it
leaves the least room in.  If it fits none, a bin is opened whose size costs least for each
token that it can be expected to hold, given what is still to be packed.  Several policies
(all sizes, or all up to each size) are tried together; the cheapest after every bin has been
downsized to the smallest capacity that holds its contents is returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch
from .words import blocks

OUT = "id long, piece int, start long, length long, bin_id long, capacity long, offset long"


def cost(capacity: int, overhead: int) -> int:
    """Of one bin: its padded length and a fixed share."""
    return capacity + overhead


def pack(lengths: np.ndarray, sizes: list[int], overhead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, capacity) of each piece; ``lengths`` fall from first to last, none is over sizes[-1]."""
    top = sizes[-1]
    counts = np.bincount(lengths, minlength=top + 1)
    left = np.cumsum(counts * np.arange(top + 1))  # tokens in pieces of at most each length, not packed yet
    room: list[list[int]] = [[] for _ in range(top + 1)]  # bins by free room
    mask = 0
    where, offset, fill = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    choice: dict[int, int] = {}
    current = -1
    for i, n in enumerate(lengths.tolist()):
        if n != current:
            if current >= 0:
                left[current:] -= current * counts[current]
            current, choice = n, {}
        above = mask >> n
        if above:
            free = n + (above & -above).bit_length() - 1
            bin_ = room[free].pop()
            if not room[free]:
                mask ^= 1 << free
            offset[i] = fill[bin_]
        else:
            if n not in choice:
                choice[n] = min((s for s in sizes if s >= n), key=lambda s: (cost(s, overhead) / (n + min(s - n, int(left[s - n]))), s))
            free, bin_ = choice[n], len(fill)
            fill.append(0)
        where[i] = bin_
        fill[bin_] += n
        free -= n
        if free:
            room[free].append(bin_)
            mask |= 1 << free
    caps = np.array(sizes)[np.searchsorted(sizes, np.array(fill, np.int64))] if fill else np.zeros(0, np.int64)
    return where, offset, caps[where] if len(where) else where


def packer(sizes: list[int], overhead: int):
    """One shard of (shard, id, n_tokens) to its packed pieces."""
    top = sizes[-1]

    def run(group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy(zero_copy_only=False)
        null = np.array(group.column("id").is_null().to_pylist(), bool)
        ids = np.where(null, 0, ids).astype(np.int64)
        number = group.column("row").to_numpy()
        total = group.column("n_tokens").to_numpy()
        pieces = np.maximum(-(-total // top), 1)
        row = np.repeat(np.arange(len(ids)), pieces)
        index = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = index * top
        length = np.minimum(total[row] - start, top)
        order = np.lexsort((index, number[row], ids[row], -length))
        row, index, start, length = row[order], index[order], start[order], length[order]
        best = None
        for k in range(1, len(sizes) + 1):
            if length.size and length[0] > sizes[k - 1]:
                continue
            made = pack(length, sizes[:k], overhead)
            _, first = np.unique(made[0], return_index=True)
            price = int(sum(cost(int(c), overhead) for c in made[2][first]))
            if best is None or price < best[0]:
                best = (price, made)
        bins, offset, caps = best[1]
        shard = int(group.column("shard")[0].as_py())
        return pa.table({"id": pa.array(ids[row], mask=null[row]), "piece": index.astype(np.int32), "start": start, "length": length, "bin_id": bins + (shard << 32), "capacity": caps, "offset": offset})

    return run


def token_counter(batches):
    """Arrow batches of (id, text) to (id, n_tokens, row): words and one end; row numbers differ."""
    row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
    for batch in batches:
        parts = [block.n_words + 1 for _, _, block in blocks(batch.column(1))]
        n = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(np.arange(row, row + len(n)))], ["id", "n_tokens", "row"])
        row += len(n)


def best_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: tuple[int, ...] = (256, 512, 1024, 2048, 4096), overhead: int = 8, shard_tokens: int = 4_000_000) -> DataFrame:
    """One row per piece: id, piece, start, length, bin_id, capacity, offset.

    A piece holds tokens ``start`` to ``start + length`` of its document (words
    ``[^\\x20\\x09-\\x0D]+`` and one end) and lies at ``offset`` in its bin; no bin holds more
    than its ``capacity``, and no smaller permitted capacity would hold its contents.

    Null and empty texts have one token, the end.  Null ids stay null.  Rows that repeat an id
    are packed one by one.  Rows are dealt to shards by a written row number, whatever their ids
    and lengths.  A shard holds about ``shard_tokens`` tokens (or one longer text), and so at
    most as many rows, each of three numbers.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    counted = scratch.table(slim.mapInArrow(token_counter, "id long, n_tokens long, row long"), "tokens")
    total = counted.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    dealt = counted.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("long"))
    out = dealt.groupBy("shard").applyInArrow(packer(sorted(sizes), overhead), OUT)
    return out.withColumnRenamed("id", id_col)
